"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For each prefix of a piece's bytes exactly one token can end a valid encoding of that prefix: the one whose
pair with the last token of what stands before it is left alone by the merges. `last[i]` holds that token for
the first i bytes. Reading back from the end gives the encoding; bytes can be appended at the cost of the new
bytes alone; and after an edit only the bytes are encoded again from the edit on until `last` agrees with the
old array over the longest token's length, for from there on both run alike.

The tokens that may end a prefix come from an automaton over the vocabulary, longest first.

A text is split by the tokenizer's pattern and every match is a piece of its own; long texts are matched in parts, and
no more than a part's pieces are held beside the ids. A piece that is itself in the vocabulary is that one token.
Null counts as empty: no tokens. Rows are treated one by one, so repeated ids stay; other columns are not read,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

#: Pieces that a worker remembers of late, and as many older ones.
CACHE = 150_000
#: Token pairs, moves of the automaton and beginnings of pieces that it remembers; beyond these, it starts anew.
PAIRS, MOVES, HEADS = 400_000, 400_000, 60_000
#: Bytes that the remembered beginnings of pieces have.
HEAD = 6
#: Matches of a text that are encoded at a time.
PART = 1 << 18

_coders: dict[tuple[str, str], "Coder"] = {}


class Vocabulary:
    """Ranks of byte strings, and which two tokens can stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.pairs: dict[int, bool] = {}
        self.edge: dict[int, tuple[list[bytes], list[bytes], bool]] = {}
        if not all(bytes([c]) in ranks for c in range(256)):
            raise ValueError("the vocabulary lacks a byte")
        self._build([b for b in ranks if len(b) == 1 or self.merge(b) == [ranks[b]]])

    def _build(self, made: list[bytes]) -> None:
        """The automaton that tells at each place which tokens end there, longest first: of those that merges can make,
        for others only stand for a whole piece. A move is known by its state and byte."""
        self.trie: dict[int, int] = {}
        own, up = [0], [-1]
        for b in made:
            node = 0
            for c in b:
                key = node << 8 | c
                node = self.trie.setdefault(key, len(own))
                if node == len(own):
                    own.append(0)
                    up.append(key)
            own[node] = len(b)
        # tokens by length: states for shorter beginnings come first
        depth = [0] * len(own)
        for node in range(1, len(own)):
            depth[node] = depth[up[node] >> 8] + 1
        self.fail, self.ends = [0] * len(own), [()] * len(own)
        text: list[bytes] = [b""] * len(own)
        for node in sorted(range(1, len(own)), key=depth.__getitem__):
            above, c = up[node] >> 8, up[node] & 255
            text[node] = text[above] + bytes((c,))
            if above:
                at = self.fail[above]
                while (to := self.trie.get(at << 8 | c)) is None and at:
                    at = self.fail[at]
                self.fail[node] = to or 0
            more = self.ends[self.fail[node]]
            self.ends[node] = ((own[node], self.ranks[text[node]]), *more) if own[node] else more
        self.moves = dict(self.trie)

    def move(self, key: int) -> int:
        """The state after a state and a byte."""
        state, c = key >> 8, key & 255
        while (to := self.trie.get(state << 8 | c)) is None and state:
            state = self.fail[state]
        if len(self.moves) > len(self.trie) + MOVES:
            self.moves = dict(self.trie)
        self.moves[key] = to or 0
        return to or 0

    def merge(self, data: bytes) -> list[int]:
        """The definition: join the neighbours of lowest rank, leftmost first, until none is in the vocabulary."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get = self.ranks.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def edges(self, token: int) -> tuple[list[bytes], list[bytes], bool]:
        """What stands at the left and at the right edge of a token's bytes while the merges make it, and whether
        ranks rise along both edges."""
        known = self.edge.get(token)
        if known is None:
            data = self.bytes_of[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            left, right = parts[:1], parts[-1:]
            while len(parts) > 1:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                left += [parts[0]] * (parts[0] != left[-1])
                right += [parts[-1]] * (parts[-1] != right[-1])
            rise = all([*map(self.ranks.get, x[1:])] == sorted(map(self.ranks.get, x[1:])) for x in (left, right))
            known = self.edge[token] = (left, right, rise)
        return known

    def together(self, a: int, b: int) -> bool:
        """Whether the merges of both tokens' bytes, one after the other, end with just these two.

        Only a merge across the border could part them. While both are made from bytes, the border sees one
        edge of each; a merge of the two comes first if its rank is below that of the next merge on the left, and
        not above that of the next on the right.
        """
        left, right = self.edges(b), self.edges(a)
        if not (left[2] and right[2]):
            return self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        left, right, get, never = left[0], right[1], self.ranks.get, 1 << 60
        i, j, last_i, last_j = 0, 0, len(right) - 1, len(left) - 1
        while True:
            across = get(right[i] + left[j], never)
            next_i = get(right[i + 1]) if i < last_i else never
            next_j = get(left[j + 1]) if j < last_j else never
            if across < next_i and across <= next_j:
                return False
            if next_i <= next_j:
                if next_i == never:
                    return True
                i += 1
            else:
                j += 1

    def extend(self, data: bytes, last: list[int], state: int | None = None) -> int:
        """Finds the last token of each prefix that `last` lacks, trying longer tokens first.

        state: of the automaton after what `last` covers, if it is known; that after all data is returned.
        """
        moves, ends, known, done = self.moves.get, self.ends, self.pairs.get, len(last) - 1
        if state is None:
            state = 0
            for c in data[max(0, done - self.longest) : done]:
                state = self.move(state << 8 | c)
        for end, c in enumerate(data[done:], done + 1):
            key = state << 8 | c
            state = moves(key)
            if state is None:
                state = self.move(key)
                moves = self.moves.get
            for length, token in ends[state]:
                if length == end:
                    break
                pair = last[end - length] << 32 | token
                fits = known(pair)
                if fits:
                    break
                if fits is None:
                    if len(self.pairs) > PAIRS:
                        self.pairs.clear()
                    fits = self.pairs[pair] = self.together(pair >> 32, token)
                    if fits:
                        break
            last.append(token)
        return state

    def read(self, data: bytes, last: list[int]) -> list[int]:
        out, at = [], len(data)
        while at:
            out.append(last[at])
            at -= len(self.bytes_of[out[-1]])
        return out[::-1]


class PrefixEncoding:
    """The encoding of one piece, kept as the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last, self.state = vocabulary, b"", [-1], 0
        self.append(data)

    def append(self, more: bytes) -> "PrefixEncoding":
        self.data += more
        self.state = self.vocabulary.extend(self.data, self.last, self.state)
        return self

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replaces data[start:end]; returns how many prefixes were encoded again."""
        old, shift, self.last = self.last, len(new) - (end - start), self.last[: start + 1]
        self.data = self.data[:start] + new + self.data[end:]
        same, done, fixed, state = 0, 0, start + len(new), None
        while len(self.last) <= len(self.data):
            state = self.vocabulary.extend(self.data[: len(self.last)], self.last, state)
            done += 1
            at = len(self.last) - 1
            same = same + 1 if at > fixed + self.vocabulary.longest and self.last[at] == old[at - shift] else 0
            if same >= self.vocabulary.longest:
                self.last += old[at - shift + 1 :]
                break
        else:
            self.state = self.state if state is None else state
        return done

    def ids(self) -> list[int]:
        whole = self.vocabulary.ranks.get(self.data)
        return self.vocabulary.read(self.data, self.last) if whole is None else [whole]


class Pieces(dict):
    """The ids of pieces, as little-endian 32-bit integers, made when first asked for.

    When there are too many, they become the old ones, from which those that are met again come back.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.old: dict[str, bytes] = {}
        self.heads: dict[bytes, tuple[list[int], int]] = {}

    def solve(self, data: bytes) -> list[int]:
        """The ids of a piece that isn't one token: goes on from what is known of its first bytes."""
        head = data[:HEAD]
        known = self.heads.get(head)
        if known is None:
            last = [-1]
            known = last, self.vocabulary.extend(head, last, 0)
            if len(self.heads) > HEADS:
                self.heads.clear()
            self.heads[head] = known
        last = known[0].copy()
        self.vocabulary.extend(data, last, known[1])
        return self.vocabulary.read(data, last)

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            data = piece.encode()
            ids = self.vocabulary.ranks.get(data)
            if ids is None:
                ids = self.solve(data)
                out = pack(f"<{len(ids)}I", *ids)
            else:
                out = pack("<I", ids)
            if len(data) > 256:
                return out
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()
        self[piece] = out
        return out

    def forget(self) -> None:
        for held in (super(), self.old, self.heads, self.vocabulary.pairs):
            held.clear()


class Coder:
    def __init__(self, path: str, pattern: str):
        import regex

        self.vocabulary = Vocabulary(common.rank_file(path))
        self.matches = regex.compile(pattern).finditer
        self.find = regex.compile(pattern).findall
        self.pieces = Pieces(self.vocabulary)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get = self.pieces.__getitem__
        if len(text) <= PART:
            return b"".join(map(get, self.find(text)))
        found, out = (m[0] for m in self.matches(text)), []
        while part := list(islice(found, PART)):
            out.append(b"".join(map(get, part)))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        of, array = self.vocabulary.bytes_of.__getitem__, np.frombuffer(ids, "<u4")
        return b"".join(b"".join(map(of, array[i : i + PART].tolist())) for i in range(0, len(array), PART))


def coder(path: str, pattern: str) -> Coder:
    return _coders.get((path, pattern)) or _coders.setdefault((path, pattern), Coder(path, pattern))


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def id_lists(ids: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def encode(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ranks: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """The columns `keep` with ids (array of int) of each row's text."""
    names, path, pattern = list(keep), common.tokenizer_path(ranks), pattern or default_pattern()
    out, arrow = common.schema_of(docs, names, "ids array<int>")

    def run(batches):
        c = coder(path, pattern)
        for batch in batches:
            column = batch.column(len(names))
            for lo, hi in common.steps(common.utf8(column)[1]):
                ids = [c.encode(x or "") for x in column.slice(lo, hi - lo).to_pylist()]
                yield common.columns(batch, lo, hi, names, {"ids": id_lists(ids)}, arrow)
        c.pieces.forget()

    return common.mapped(docs.select(*names, F.col(text)), run, out)


def decode(encoded: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), ranks: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """The columns `keep` with text, decoded from ids; null ids give empty text, broken UTF-8 a replacement sign."""
    names, path, pattern = list(keep), common.tokenizer_path(ranks), default_pattern()
    out, arrow = common.schema_of(encoded, names, "text string")

    def run(batches):
        c = coder(path, pattern)
        for batch in batches:
            texts = [c.decode(np.array(x or [], "<u4").tobytes()).decode("utf-8", "replace") for x in batch.column(len(names)).to_pylist()]
            yield common.columns(batch, 0, batch.num_rows, names, {"text": pa.array(texts, pa.string())}, arrow)

    return common.mapped(encoded.select(*names, F.col(ids)), run, out)


def digests(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ranks: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encodes each text and decodes the ids: n_tokens, and the SHA-256 of the ids and of the decoded bytes; with_ids: and ids."""
    names, path, pattern = list(keep), common.tokenizer_path(ranks), pattern or default_pattern()
    out, arrow = common.schema_of(docs, names, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)

    def sha(parts: Iterable[bytes]) -> pa.Array:
        return pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string())

    def run(batches):
        c = coder(path, pattern)
        for batch in batches:
            column = batch.column(len(names))
            for lo, hi in common.steps(common.utf8(column)[1]):
                ids = [c.encode(x or "") for x in column.slice(lo, hi - lo).to_pylist()]
                more = {"n": np.array([len(x) // 4 for x in ids], np.int64), "i": sha(ids), "d": sha(map(c.decode, ids))}
                yield common.columns(batch, lo, hi, names, more | ({"ids": id_lists(ids)} if with_ids else {}), arrow)
        c.pieces.forget()

    return common.mapped(docs.select(*names, F.col(text)), run, out)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids, their number, and the digests of the ids and of what they decode to.

    Every row gives a row, repeated ones too; null texts have no ids.
    """
    names = tuple(c for c in ("doc_id", "lang", "source") if c in docs.columns)
    return digests(docs, keep=names, with_ids=True)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document by byte_bpe_multi_50k.tiktoken and of what they decode to."""
    return digests(common.table(spark, sf_dir, "documents"))
