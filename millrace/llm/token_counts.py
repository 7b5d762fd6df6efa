"""Token counts: how many tokens a sentencepiece model makes of each text, without keeping the tokens.

Arrow batches are cut into steps of about equal bytes. In each step every text is split where no piece of
the vocabulary can cross: before a space that follows another character. The library then encodes the
distinct segments that have not been met yet, in one batch, and only their lengths are kept.

Null and empty texts have 0 bytes and 0 tokens. Rows are counted one by one, so repeated ids stay. Other
columns are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

#: The model writes spaces so; a space in a text and this character are the same to it.
SPACE = "▁"
#: Segments whose lengths a worker remembers; beyond it, it starts anew.
CACHE = 300_000
#: Characters of a long text that are split at a time.
PART = 1 << 20

_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")
_counters: dict[str, "Counter"] = {}


class Counter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece of this model crosses from a character to a space: there is no safe boundary")
        self.alone = len(self.model.encode("a ")) - len(self.model.encode("a"))
        self.known: dict[str, int] = {}

    def parts(self, text: str) -> Iterator[list[str]]:
        """Lists of segments of the text as the model sees it: with a space in front."""
        seen, at = SPACE + text.replace(" ", SPACE) if text else "", 0
        while at < len(seen):
            end = at + PART
            if end < len(seen):  # back, else on, to a boundary
                cut = next((m.end() - 1 for m in re.finditer(f"[^{SPACE}]{SPACE}", seen[end - 4096 : end])), -1)
                if cut >= 0:
                    end = end - 4096 + cut
                else:
                    m = re.compile(f"[^{SPACE}]{SPACE}").search(seen, end)
                    end = m.end() - 1 if m else len(seen)
            yield _SEGMENT.findall(seen[at:end])
            at = end

    def learn(self, segments: set[str]) -> None:
        if len(self.known) > CACHE:
            self.known = {}
        new = [s for s in segments if s not in self.known]
        for s, ids in zip(new, self.model.encode([s[1:] for s in new], num_threads=1) if new else ()):
            self.known[s] = len(ids) or self.alone

    def count(self, texts: list[str]) -> list[int]:
        """The lengths of the texts; short ones share their batch of new segments."""
        out, held, segments = [0] * len(texts), [], set()
        for i, text in enumerate(texts):
            if len(text) > PART:
                for part in self.parts(text):
                    known = self.known
                    self.learn(set(part))
                    if known is not self.known:
                        held and self.learn(segments)
                    out[i] += sum(map(self.known.__getitem__, part))
            else:
                for part in self.parts(text):
                    held.append((i, part))
                    segments.update(part)
        self.learn(segments)
        if any(s not in self.known for s in segments):  # cleared on the way
            self.learn(segments)
        for i, part in held:
            out[i] += sum(map(self.known.__getitem__, part))
        return out


def token_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), model: str = "piece_bpe_32k.model") -> DataFrame:
    """The columns `keep` with n_bytes (UTF-8) and n_tokens of each row's text."""
    names, path = list(keep), common.tokenizer_path(model)
    out, arrow = common.schema_of(docs, names, "n_bytes long, n_tokens long")

    def run(batches):
        counter = _counters.get(path) or _counters.setdefault(path, Counter(path))
        for batch in batches:
            column = batch.column(len(names))
            _, offsets = common.utf8(column)
            for lo, hi in common.steps(offsets, 1 << 20):
                lengths = counter.count([x or "" for x in column.slice(lo, hi - lo).to_pylist()])
                yield common.columns(batch, lo, hi, names, {"b": offsets[lo + 1 : hi + 1] - offsets[lo:hi], "t": pa.array(lengths, pa.int64())}, arrow)

    return common.mapped(docs.select(*names, F.col(text)), run, out)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by piece_bpe_32k.model, and whether they are over 4096."""
    return token_counts(common.table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 4096)
