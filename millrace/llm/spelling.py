"""Spelling variant grouping: words one edit apart, found in a trie of letter counts.

Words are counted over all documents, and each is arranged by successive counts: of all its letters, of the letters of
each of some groups, and of each single letter. A trie over these counts has the words in its leaves. A word looks for
those near to it by going down with a budget: one letter more and one less (replaced), one more (inserted) or one less
(deleted). At a node it takes the child of its own count, the next larger one if a surplus of one is left, and the next
smaller one if a deficit is left; the count of all letters tells which of the two there may be. What the leaves hold is
verified as exactly one inserted, deleted or replaced code point.

The upper part of the trie deals the words out: a node with more than `PAGE` words (or 1/16384 of them, if that is more)
is split into its children, level by level, so at most 16,384 nodes of a level are split, which is what is sent to all
tasks. Nodes that are not split are pages. Every word is dealt to its own page and, as a question, to each page that its
budget reaches; a page with very many questions takes them in blocks. In a page all questions go down its part of the
trie together, depth first. A leaf that is split to the last letter, of very many anagrams, has no page: a question there
knows which letter is replaced, so it forms what could be meant (no more strings than it has letters) and joins them
by equality. Each page gives for each question the number of near words and the best one, so pairs are never listed.

Null texts have no words. A run that h (see `counted`) marks loses one code point; a null id marks nothing. Repeated rows
count each. Other columns are not read, whatever their names. A very long text is one step of its own. An empty table
gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

#: Words of a page, at least, and the most nodes of a level that are split.
PAGE, NODES = 4096, 1 << 14
#: Words of a leaf that is not divided further.
LEAF = 8
#: Questions that a page takes at a time.
QUESTIONS = 1 << 16
#: Levels of the trie that are counted at a time.
SPAN = 8
#: Different words that a task counts before it hands them on.
HELD = 1 << 18
#: The letter groups of the upper levels.
GROUPS = ("e", "a", "ns", "io", "rl", "td", "um", "cghp")

#: Columns: the number of letters, the groups and all others, the letters that words can hold.
_LETTERS = [*range(97, 123), *range(0xC0, 0x100)]
_COARSE = 2 + len(GROUPS)
WIDTH = _COARSE + len(_LETTERS)
_GROUP = np.full(256, _COARSE - 1, np.int64)
for _i, _g in enumerate(GROUPS):
    _GROUP[[ord(c) for c in _g]] = 1 + _i
_LETTER = np.full(256, 0, np.int64)
_LETTER[_LETTERS] = _COARSE + np.arange(len(_LETTERS))

_RUN = np.zeros(256, bool)
_RUN[65:91] = _RUN[97:123] = _RUN[0xC3] = True

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, np.uint32(0xEDB88320) ^ (_CRC >> np.uint32(1)), _CRC >> np.uint32(1))


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of letters, within the texts; letters over ASCII begin with the byte 0xC3."""
    k = np.zeros(len(data) + 2, bool)
    k[1:-1] = _RUN[data]
    k[2:-1] |= data[:-1] == 0xC3
    edge = k[1:] != k[:-1]
    inner = offsets[1:-1]
    both = k[inner] & k[inner + 1]  # a run on either side of a text's end
    start, end = np.flatnonzero(edge & k[1:]), np.flatnonzero(edge & k[:-1])
    if both.any():
        cut = np.unique(inner[both])
        start, end = np.union1d(start, cut), np.union1d(end, cut)
    return start, end


def crc32(data: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The crc32 of data[start : start + size], going on from the crc32 `state`; rows by size, longest first."""
    state = state ^ np.uint32(0xFFFFFFFF)
    for at in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -at))  # rows that are longer
        state[:n] = _CRC[(state[:n] ^ data[start[:n] + at]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    return state ^ np.uint32(0xFFFFFFFF)


def words_of(data: np.ndarray, offsets: np.ndarray, ids: list[str | None], odds: int, least: int) -> dict[bytes, int]:
    """How often each word of `least` letters or more stands in the texts, after deletions."""
    low = common.LOWER[data]
    start, end = runs(low, offsets)
    lead = np.concatenate([[0], np.cumsum(low == 0xC3)])
    letters = end - start - (lead[end] - lead[start])
    long = letters >= least
    start, end, letters = start[long], end[long], letters[long]
    row = np.searchsorted(offsets, start, "right") - 1
    h = np.zeros(len(start), np.uint64)
    for lo, hi in common.steps(np.r_[start, end[-1:]]) if len(start) else ():
        base = start[lo]
        h[lo:hi] = common.span_hash(common.prefix_hash(low[base : end[hi - 1]]), start[lo:hi] - base, end[lo:hi] - base)
    h = common.mix(h)
    with np.errstate(over="ignore"):
        of_row = common.mix(h + np.uint64(common.BASE) * row.astype(np.uint64))
    _, first, times = np.unique(of_row, return_index=True, return_counts=True)
    order = np.argsort(start[first] - end[first], kind="stable")
    first, times = first[order], times[order]
    state = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    crc = crc32(low, start[first], end[first] - start[first], state[row[first]])
    marked = (crc % odds == 0) & np.array([i is not None for i in ids], bool)[row[first]]
    raw, out = low.tobytes(), {}
    for i, n, c in zip(first[marked].tolist(), times[marked].tolist(), crc[marked].tolist()):
        word = raw[start[i] : end[i]].decode()
        at = c % len(word)
        if len(word) > least:
            word = (word[:at] + word[at + 1 :]).encode()
            out[word] = out.get(word, 0) + n
    some, times = first[~marked], times[~marked]
    _, own, inverse = np.unique(h[some], return_index=True, return_inverse=True)
    total = np.bincount(inverse, times, len(own)).astype(np.int64)
    for s, e, n in zip(start[some[own]].tolist(), end[some[own]].tolist(), total.tolist()):
        word = raw[s:e]
        out[word] = out.get(word, 0) + n
    return out


def counted(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", odds: int = 97, least: int = 5, times: int = 3) -> DataFrame:
    """(word, n): the words of `least` letters or more that stand `times` times or more.

    h is the crc32 of '<doc_id>:<run>'; where `odds` divides it, the run's letter at h modulo its length is deleted.
    """

    def rows(held: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        held: dict[bytes, int] = {}
        for batch in batches:
            data, offsets = common.utf8(batch.column(1))
            ids = batch.column(0).to_pylist()
            for lo, hi in common.steps(offsets):
                for word, n in words_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ids[lo:hi], odds, least).items():
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield rows(held)
                    held = {}
        if held:
            yield rows(held)

    found = common.mapped(docs.select(F.col(doc_id).cast("string"), F.col(text)), run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


class Words:
    """Words as letters in a row, and their counts by column."""

    def __init__(self, words: list[str]):
        self.codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.size) - self.size
        row = np.repeat(np.arange(len(words)) * WIDTH, self.size)
        counts = np.bincount(row + _GROUP[self.codes], minlength=len(words) * WIDTH) + np.bincount(row + _LETTER[self.codes], minlength=len(words) * WIDTH)
        self.counts = counts.reshape(-1, WIDTH)
        self.counts[:, 0] = self.size
        self.counts = self.counts.astype(np.int32)


def step(level: int, apart: np.ndarray, up: np.ndarray, down: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, ...]:
    """Which questions go on to a child, apart letters from their own count, and what is left of their budgets.

    longer: by how many letters the child's words are longer. Groups and single letters have a budget each.
    """
    if level == 0:
        return np.abs(apart) <= 1, apart >= 0, apart <= 0, apart
    if level == _COARSE:
        up, down = longer >= 0, longer <= 0
    return (apart == 0) | ((apart == 1) & up) | ((apart == -1) & down), up & (apart != 1), down & (apart != -1), longer


def child(node: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The node below by its count."""
    with np.errstate(over="ignore"):
        return common.mix(node * np.uint64(common.BASE) + count.astype(np.uint64) + np.uint64(1))


def among(values: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Whether each value is one of the sorted nodes."""
    at = np.searchsorted(nodes, values)
    return at < len(nodes) if not len(nodes) else nodes[np.minimum(at, len(nodes) - 1)] == values


def placed(counts: np.ndarray, split: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The node that each word is dealt to, and whether that is split to the last letter."""
    node = np.zeros(len(counts), np.uint64)
    go = np.arange(len(node))
    for level, nodes in enumerate(split):
        go = go[among(node[go], nodes)]
        if level < WIDTH:
            node[go] = child(node[go], counts[go, level])
    hot = np.zeros(len(node), bool)
    if len(split) > WIDTH:
        hot[go] = True
    return node, hot


def reached(counts: np.ndarray, split: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(question, node, hot, column that is one more, column that is one less) for all nodes within the questions' budgets."""
    n = len(counts)
    q, node, up, down = np.arange(n), np.zeros(n, np.uint64), np.ones(n, bool), np.ones(n, bool)
    longer, more, less = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
    out = []
    for level, nodes in enumerate([*split, np.zeros(0, np.uint64)]):
        go = among(node, nodes)
        hot = np.full(len(q), level == WIDTH) & go
        done = ~go | hot
        out.append((q[done], node[done], hot[done], more[done], less[done]))
        q, node, up, down, longer, more, less = (x[go & ~hot] for x in (q, node, up, down, longer, more, less))
        if level == WIDTH or not len(q):
            break
        parts = []
        for apart in (0, 1, -1):
            use, u, d, by = step(level, np.full(len(q), apart, np.int32), up, down, longer)
            use &= counts[q, level] + apart >= 0
            mark = lambda x, on: np.where(on & (level >= _COARSE), np.int32(level), x)[use]
            parts.append((q[use], child(node[use], (counts[q, level] + apart)[use]), u[use], d[use], by[use], mark(more, apart == 1), mark(less, apart == -1)))
        q, node, up, down, longer, more, less = (np.concatenate(x) for x in zip(*parts))
    return tuple(np.concatenate(x) for x in zip(*out))


def candidates(words: np.ndarray, asked: np.ndarray):
    """Pairs (question, word) of the leaves that the questions reach, depth first; both by their counts."""
    n = len(asked)
    stack = [(np.arange(len(words)), np.arange(n), np.ones(n, bool), np.ones(n, bool), np.zeros(n, np.int32), 0)]
    while stack:
        w, q, up, down, longer, level = stack.pop()
        if len(w) <= LEAF or level == WIDTH:
            for at in range(0, len(w), max(1, (1 << 20) // len(q))):
                some = w[at : at + max(1, (1 << 20) // len(q))]
                yield np.repeat(q, len(some)), np.tile(some, len(q))
            continue
        own, theirs = words[w, level], asked[q, level]
        for count in np.unique(own):
            use, u, d, by = step(level, count - theirs, up, down, longer)
            if use.any():
                stack.append((w[own == count], q[use], u[use], d[use], by[use], level + 1))


def one_edit(a: Words, b: Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether words i of a and j of b differ by exactly one inserted, deleted or replaced letter."""
    least, most = np.minimum(a.size[i], b.size[j]), np.maximum(a.size[i], b.size[j])
    ends = (a.codes[a.start[i]] == b.codes[b.start[j]]) | (a.codes[a.start[i] + a.size[i] - 1] == b.codes[b.start[j] + b.size[j] - 1])
    some = np.flatnonzero((ends | (most == 1)) & (most - least <= 1))
    same = []
    for first, by in ((lambda x, k: x.start[k], 1), (lambda x, k: x.start[k] + x.size[k] - 1, -1)):
        alike, go, at = np.zeros(len(some), np.int64), np.arange(len(some)), 0
        x, y = first(a, i[some]), first(b, j[some])
        while len(go):
            go = go[least[some[go]] > at]
            go = go[a.codes[x[go] + by * at] == b.codes[y[go] + by * at]]
            at += 1
            alike[go] = at
        same.append(alike)
    out = np.zeros(len(i), bool)
    out[some] = (same[0] + same[1] >= most[some] - 1) & (same[0] < most[some])
    return out


def meant(word: str, more: int, less: int) -> list[str]:
    """What the word becomes with one letter of column `less` replaced by that of column `more`; 0: none."""
    new = chr(_LETTERS[more - _COARSE]) if more else ""
    if not less:
        return sorted({word[:i] + new + word[i:] for i in range(len(word) + 1)}) if new else []
    old = chr(_LETTERS[less - _COARSE])
    return sorted({word[:i] + new + word[i + 1 :] for i, c in enumerate(word) if c == old})


def splits(words: DataFrame) -> list[np.ndarray]:
    """The nodes that are split, by level, each level sorted; SPAN further levels are counted at a time."""
    n = words.count()
    most = max(PAGE, n // NODES)
    split = [np.zeros(1, np.uint64)] if n > most else []
    more = bool(split)
    while more and len(split) <= WIDTH:

        def run(batches, split=tuple(split)):
            for batch in batches:
                counts = Words(batch.column(0).to_pylist()).counts
                node = np.zeros(len(counts), np.uint64)
                for level, nodes in enumerate(split):
                    use = among(node, nodes)
                    counts = counts[use]
                    node = child(node[use], counts[:, level])
                for level in range(len(split), min(len(split) + SPAN, WIDTH + 1)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), level, np.int32)), pa.array(node.view(np.int64))], names=["level", "node"])
                    if level < WIDTH:
                        node = child(node, counts[:, level])

        found = common.mapped(words.select("word"), run, "level int, node long").groupBy("level", "node").count().where(F.col("count") > most).collect()
        for level in range(len(split), min(len(split) + SPAN, WIDTH + 1)):
            nodes = np.sort(np.array([r["node"] for r in found if r["level"] == level], np.int64).view(np.uint64))
            more = more and len(nodes) > 0
            if more:
                split.append(nodes)
    return split


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): of the words (word, n) that have near ones, their number and the most frequent, a struct (less, form), less = -n."""
    spark = words.sparkSession
    split = spark.sparkContext.broadcast(splits(words))

    def deal(batches):
        for batch in batches:
            node, hot = placed(Words(batch.column(0).to_pylist()).counts, split.value)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *batch.columns], names=["page", "word", "n"]).filter(pa.array(~hot))

    def ask(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                own = batch.column(0).slice(lo, 1000)
                q, node, hot, _, _ = reached(Words(own.to_pylist()).counts, split.value)
                yield pa.RecordBatch.from_arrays([pa.array(node[~hot].view(np.int64)), own.take(pa.array(q[~hot]))], names=["page", "asked"])

    def form(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                own = batch.column(0).slice(lo, 1000).to_pylist()
                q, _, hot, more, less = reached(Words(own).counts, split.value)
                pairs = [(own[i], x) for i, m, l in zip(q[hot].tolist(), more[hot].tolist(), less[hot].tolist()) for x in meant(own[i], m, l)]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], names=["asked", "word"])

    def search(asked: pa.Table, page: pa.Table) -> pa.Table:
        ns, names = page["n"].to_pylist(), page["word"].to_pylist()
        order = sorted(range(len(ns)), key=lambda k: (-ns[k], names[k]))
        names, ns = [names[k] for k in order], np.array(ns, np.int64)[order]
        questions = asked["asked"].combine_chunks()
        a, b = Words(questions.to_pylist()), Words(names)
        n, best = np.zeros(len(a.size), np.int64), np.full(len(a.size), len(names), np.int64)
        for i, j in candidates(b.counts, a.counts) if names and len(a.size) else ():
            good = one_edit(a, b, i, j)
            n += np.bincount(i[good], minlength=len(n))
            np.minimum.at(best, i[good], j[good])
        some = np.flatnonzero(n)
        return pa.table([questions.take(pa.array(some)), pa.array(n[some]), pa.array(ns[best[some]]), pa.array(names, pa.string()).take(pa.array(best[some]))], names=["word", "n_near", "n", "form"])

    asked = common.mapped(words.select("word"), ask, "page long, asked string")
    crowded = common.staged(asked.groupBy("page").count().where(F.col("count") > QUESTIONS).select(F.col("page").alias("own"), F.ceil(F.col("count") / QUESTIONS).alias("blocks")))
    pages = common.mapped(words.select("word", "n"), deal, "page long, word string, n long").withColumn("block", F.lit(0).cast("long"))
    if crowded.isEmpty():
        asked = asked.withColumn("block", F.lit(0).cast("long"))
    else:
        asked = asked.join(crowded, F.col("page") == F.col("own"), "left").select("page", "asked", F.coalesce(F.pmod(F.xxhash64("asked"), "blocks"), F.lit(0)).cast("long").alias("block"))
        copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("blocks") - 1, F.lit(0)).cast("long")))
        pages = pages.drop("block").join(crowded, F.col("page") == F.col("own"), "left").select("page", "word", "n", copies.alias("block"))
    found = asked.groupBy("page", "block").cogroup(pages.groupBy("page", "block")).applyInArrow(search, "word string, n_near long, n long, form string")
    found = found.select("word", "n_near", F.struct((-F.col("n")).alias("less"), "form").alias("best"))
    if len(split.value) > WIDTH:
        pairs = common.mapped(words.select("word"), form, "asked string, word string").join(words, "word")
        found = found.unionByName(pairs.select(F.col("asked").alias("word"), F.lit(1).cast("long").alias("n_near"), F.struct((-F.col("n")).alias("less"), F.col("word").alias("form")).alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form that is reached from each word with one, by doubling steps; forms (word, form) have no circles."""
    ways = common.staged(forms.select("word", F.col("form").alias("root")))
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ways = common.staged(ways.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if ways.where("moved").isEmpty():
            return ways.select("word", "root")
        ways = ways.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n), which are distinct.

    A word's form is its most frequent near word, ties to the smallest, if it is `ratio` times as frequent or more.
    """
    near = words.join(near_words(words), "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    found = common.staged(near.select("word", F.when(enough, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, -F.col("best.less")).alias("form_n")))
    out = found.join(roots(found.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their near words, forms and roots."""
    return spelling_variants(common.staged(counted(common.table(spark, sf_dir, "documents"))))


ORACLE_SQL = """
    WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
    r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL),
    h AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 | (unicode(c) >> 6), 128 | (unicode(c) & 63)] END))),
        lambda s, b: xor(t[(xor(s, b) & 255) + 1], s >> 8)), 4294967295) AS h FROM r, t),
    w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    v AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
    e AS MATERIALIZED (SELECT a.word, b.word AS near, b.n FROM v a JOIN v b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.rest = w.word UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.rest = w.word),
    f AS (SELECT word, count(*) AS n_near, min({'less': -n, 'form': near}) AS best FROM e GROUP BY word),
    g AS MATERIALIZED (SELECT w.word, CASE WHEN -best.less >= 2 * n THEN best.form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 2 * n THEN -best.less END AS form_n FROM w LEFT JOIN f USING (word)),
    p(word, root, d) AS (SELECT word, form, 1 FROM g WHERE form IS NOT NULL UNION ALL SELECT p.word, g.form, d + 1 FROM p JOIN g ON g.word = p.root WHERE g.form IS NOT NULL)
    SELECT g.word, form, coalesce(x.root, g.word) AS root, n, n_near, form_n FROM g LEFT JOIN (SELECT word, arg_max(root, d) AS root FROM p GROUP BY word) x USING (word)"""
