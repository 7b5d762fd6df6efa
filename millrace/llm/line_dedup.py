"""Line dedup: lines that an earlier line equals up to one edit are taken out, by a deletion-neighbourhood join.

The bound on edits grows with a line's length: 0 from `exact` characters on, `edits` (0 or 1; insertions, deletions
and substitutions of code points) from `least` on, for one edit may be all that a short line says ('Page 1', 'Page 2').
A line is dropped if any line before it, in any document, is within both lines' bounds. The query and the stage take 1
for `exact`: copies of all lines but empty ones go. Before means: by document id, null last, then by the hash of the
text, for different texts with one id or with none, then by line number. The
rule looks at all earlier lines, kept or not, so the result doesn't depend on any order of work; of equal lines the
first stays.

Equal lines meet by hash. For the others, two rounds of coarse neighbourhoods find the lines that can have a
neighbour at all: with a line cut into blocks, two lines one edit apart agree in everything but one block, so each
line emits, for each block, the hash of what remains when that block is deleted. Lines that share no such key with
another line have no neighbour. The few that are left emit all variants with one character deleted, as hashed keys:
with the place of the deletion (equal for lines that differ by a substitution) and without (equal to the hash of the
shorter line where one has an insertion). The earliest line of each key stands for it, so no pairs within a key are
built; what is found is verified by the edit distance of the texts themselves.

Keys are only aggregated, and combined before the shuffle, so a key that many lines share isn't gathered; keys that two
lines share become a filter of bounded size, and then an exact join, of the lines that have one. Only the documents
that lose lines are shuffled. Long texts are read in pieces that end with a line.

Null texts stay null and have no lines. An empty text is one empty line. Rows that agree in id and text are treated
alike, and neither stands before the other. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

#: Lines with fewer characters have no neighbours at one edit.
LEAST = 20
#: From so many characters on, the query and the stage drop equal lines: all but empty ones.
EXACT = 1
#: Blocks of the two coarse rounds.
BLOCKS = (2, 16)
#: Characters of text that are read at a time; a longer line is read on its own.
PART = 1 << 18

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def parts(texts: list[str | None]) -> Iterator[list[tuple[int, int, str]]]:
    """Lists of (row, number of the first line, whole lines) of about PART characters."""
    held, size = [], 0
    for row, text in enumerate(texts):
        at, number, end = 0, 0, len(text or "")
        while at < end:
            cut = end
            if end - at > PART:
                cut = text.rfind("\n", at, at + PART)
                cut = cut if cut >= 0 else text.find("\n", at + PART)
                cut = cut if cut >= 0 else end
            part = text[at:cut]
            held.append((row, number, part))
            number += part.count("\n") + 1
            at, size = cut + 1, size + len(part)
            if size >= PART:
                yield held
                held, size = [], 0
    if held:
        yield held


class Lines:
    """The lines with `least` characters or more of some parts, and their hashes."""

    def __init__(self, parts: list[tuple[int, int, str]], least: int):
        rows, numbers, sizes = (np.array(x, np.int64) for x in zip(*((r, n, len(t)) for r, n, t in parts)))
        self.flat = "\n".join(t for _, _, t in parts)
        codes = np.frombuffer(self.flat.encode("utf-32-le", "surrogatepass"), np.uint32)
        cut = np.flatnonzero(codes == 10)
        start, end = np.r_[0, cut + 1], np.r_[cut, len(codes)]
        first = np.cumsum(np.r_[0, sizes + 1])[:-1]
        part = np.searchsorted(first, start, "right") - 1
        number = np.arange(len(start)) - np.searchsorted(start, first)[part] + numbers[part]
        use = end - start >= max(least, 1)
        self.start, self.end, self.row, self.number = start[use], end[use], rows[part][use], number[use]
        self.size = self.end - self.start
        self.prefix = common.prefix_hash(codes)
        self.plain = common.span_hash(self.prefix, self.start, self.end)
        self.hash = common.mix(self.plain).view(np.int64)

    def text(self, line: int) -> str:
        return self.flat[self.start[line] : self.end[line]]

    def block_keys(self, blocks: int) -> np.ndarray:
        """For each line the keys with one block deleted, as the shorter and as the longer line of a pair."""
        out = []
        with np.errstate(over="ignore"):
            for longer in (0, 1):
                short = self.size - longer
                for j in range(blocks):
                    left, right = self.start + short * j // blocks, self.end - (short - short * (j + 1) // blocks)
                    key = common.span_hash(self.prefix, self.start, left) * _C[0] + common.span_hash(self.prefix, right, self.end) * _C[1]
                    out.append(common.mix(key + short.astype(np.uint64) * _C[2] + np.uint64(j + 1) * _C[3]))
        return np.stack(out, 1).view(np.int64)

    def variants(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, role, key) of all variants: role 0 with the place of the deletion, 1 without, 2 the line itself."""
        line = np.repeat(np.arange(len(self.size)), self.size)
        place = np.arange(len(line)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        start, end = self.start[line], self.end[line]
        with np.errstate(over="ignore"):
            left = common.span_hash(self.prefix, start, start + place)
            after = start + place + 1
            right = (self.prefix[end] - self.prefix[after]) * common.powers(len(self.prefix))[1][start + 1]
            kept = left + right
            fixed = common.mix(kept * _C[0] + place.astype(np.uint64) * _C[1] + self.size[line].astype(np.uint64) * _C[2])
            free, own = common.mix(kept ^ _C[3]), common.mix(self.plain ^ _C[3])
        n = len(self.size)
        role = np.repeat(np.array([0, 1, 2], np.int32), [len(line), len(line), n])
        return np.concatenate([line, line, np.arange(n)]), role, np.concatenate([fixed, free, own]).view(np.int64)


def lists(keys: np.ndarray, use: np.ndarray | None = None) -> pa.Array:
    """The keys of each line; empty where use is False."""
    use = np.ones(len(keys), bool) if use is None else use
    ends = np.cumsum(np.r_[0, use * keys.shape[1]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[use].ravel()))


def occurrences(docs: DataFrame, least: int, edits: int, exact: int) -> DataFrame:
    """A row for each line: hash, document (id, row), number, and its keys of the first coarse round, if it is not too short."""

    def run(batches):
        for batch in batches:
            for part in parts(batch.column(2).to_pylist()):
                x = Lines(part, min(least, exact))
                keys = x.block_keys(BLOCKS[0]) if edits else np.zeros((len(x.row), 0), np.int64)
                take = pa.array(x.row)
                yield pa.RecordBatch.from_arrays([pa.array(x.hash), batch.column(0).take(take), batch.column(1).take(take), pa.array(x.number.astype(np.int32)), lists(keys, x.size >= least)], names=["line", "id", "row", "number", "keys"])

    return common.mapped(docs.select("id", "row", "text"), run, f"line long, id {docs.schema['id'].dataType.simpleString()}, row long, number int, keys array<long>")


def meeting(keyed: DataFrame) -> DataFrame:
    """The lines (line, keys) that share a key with another line: (line)."""
    each = keyed.select("line", F.explode("keys").alias("key"))
    shared = common.staged(each.groupBy("key").agg(F.min("line").alias("lo"), F.max("line").alias("hi")).where("lo <> hi").select("key"))
    bits = keyed.sparkSession.sparkContext.broadcast(common.bitmap(shared, "key", hashed=True))

    def run(batches):
        for batch in batches:
            keys, ends = batch.column(1).values, batch.column(1).offsets.to_numpy()
            use = ends[0] + np.flatnonzero(common.inside(bits.value, keys.to_numpy()[ends[0] : ends[-1]]))
            line = np.searchsorted(ends, use, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(line)), keys.take(pa.array(use))], names=["line", "key"])

    some = common.mapped(keyed.select("line", "keys"), run, "line long, key long")
    return some.join(shared, "key", "left_semi").select("line").distinct()


def texts_of(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """(line, text) of the wanted lines. A filter of bounded size picks them on a pass over the documents."""
    bits = docs.sparkSession.sparkContext.broadcast(common.bitmap(wanted, "line", hashed=True))

    def run(batches):
        seen = common.Seen()
        for batch in batches:
            for part in parts(batch.column(0).to_pylist()):
                x = Lines(part, least)
                some = np.flatnonzero(common.inside(bits.value, x.hash))
                some = some[seen.new(x.hash[some])]
                yield pa.RecordBatch.from_arrays([pa.array(x.hash[some]), pa.array([x.text(i) for i in some], pa.string())], names=["line", "text"])

    found = common.mapped(docs.select("text"), run, "line long, text string")
    return found.join(wanted, "line", "left_semi").groupBy("line").agg(F.first("text").alias("text"))


def alone(texts: list[str]) -> Iterator[tuple[int, int, list[tuple[int, int, str]]]]:
    """Ranges of lines, and each line as a part of its own."""
    sizes = np.cumsum([0, *map(len, texts)])
    for lo, hi in common.steps(sizes, PART):
        yield lo, hi, [(i, 0, t) for i, t in enumerate(texts[lo:hi])]


def coarse(lines: DataFrame, blocks: int) -> DataFrame:
    """(line, keys) of lines (line, text)."""

    def run(batches):
        for batch in batches:
            for lo, hi, part in alone(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists(Lines(part, 1).block_keys(blocks))], names=["line", "keys"])

    return common.mapped(lines.select("line", "text"), run, "line long, keys array<long>")


def neighbourhood(lines: DataFrame) -> DataFrame:
    """(line, at, role, key): all variants of lines (line, at, text)."""
    at = lines.schema["at"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo, _, part in alone(batch.column(2).to_pylist()):
                line, role, key = Lines(part, 1).variants()
                for a in range(0, max(len(line), 1), 200_000):
                    part = slice(a, a + 200_000)
                    take = pa.array(line[part] + lo)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(role[part]), pa.array(key[part])], names=["line", "at", "role", "key"])

    return common.mapped(lines.select("line", "at", "text"), run, f"line long, at {at}, role int, key long")


def near_lines(docs: DataFrame, first: DataFrame, least: int) -> DataFrame:
    """(line): those of the distinct lines (line, at, keys) that an earlier one equals but for one edit."""
    some = common.staged(meeting(first))
    texts = common.staged(texts_of(docs, some, least))
    some = common.staged(meeting(coarse(texts, BLOCKS[1])))
    lines = common.staged(texts.join(some, "line", "left_semi").join(first.select("line", "at"), "line"))
    variants = common.staged(neighbourhood(lines))
    earliest = lambda role: F.min(F.when(F.col("role") == role, F.struct("at", "line")))
    keys = variants.groupBy("key").agg(*(earliest(k).alias(f"e{k}") for k in (0, 1, 2)), F.min("line").alias("lo"), F.max("line").alias("hi")).where("lo <> hi")
    # with place: the earliest of all; without: the line itself for those with an insertion, and the other way round
    partner = F.when(F.col("role") == 0, F.col("e0")).when(F.col("role") == 1, F.col("e2")).otherwise(F.col("e1"))
    met = variants.join(keys, "key").select("line", "at", partner.alias("e")).where("e.at < at and e.line <> line")
    pairs = met.select("line", F.col("e.line").alias("other")).distinct()
    both = pairs.join(lines.select("line", "text"), "line").join(lines.select(F.col("line").alias("other"), F.col("text").alias("near")), "other")
    return both.where(F.levenshtein("text", "near", 1).between(0, 1)).select("line").distinct()


def dropped_lines(docs: DataFrame, least: int = LEAST, edits: int = 1, exact: int | None = None) -> DataFrame:
    """(id, row, numbers): the numbers of the lines to take out of documents (id, row, text)."""
    if edits not in (0, 1):
        raise ValueError("edits must be 0 or 1")
    found = common.staged(occurrences(docs, least, edits, least if exact is None else exact))
    at = F.struct(F.col("id").isNull().alias("last"), "id", "row", "number")
    first = common.staged(found.groupBy("line").agg(F.min(at).alias("at"), F.first("keys").alias("keys"), F.count("*").alias("n")))
    if edits:
        near = common.settled(docs.sparkSession, lambda: near_lines(docs, first, least)).withColumn("near", F.lit(True))
        bad = first.select("line", "at", "n").join(near, "line", "left").withColumn("near", F.coalesce("near", F.lit(False)))
    else:
        bad = first.select("line", "at", "n", F.lit(False).alias("near"))
    bad = bad.where("n > 1 or near")
    out = found.select("line", "id", "row", "number", at.alias("own")).join(bad, "line").where("near or own > at")
    return out.groupBy("id", "row").agg(F.collect_list("number").alias("numbers"))


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, edits: int = 1, exact: int | None = None) -> DataFrame:
    """All columns of docs as the struct _doc, with n_lines, n_dropped and text, what is left of each document.

    exact: characters from which on equal lines are dropped; the same as least, if not given.
    """
    rows = docs.select(F.struct("*").alias("_doc"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    drops = common.settled(docs.sparkSession, lambda: dropped_lines(rows.select("id", "row", "text"), least, edits, exact))
    bits = docs.sparkSession.sparkContext.broadcast(common.bitmap(drops.select(F.xxhash64("id", "row").alias("key")), "key", hashed=True))
    keyed = rows.select("_doc", "id", "row", F.xxhash64("id", "row").alias("key"))

    drops = drops.select(F.col("id").alias("of"), F.col("row").alias("its"), "numbers")
    # the text goes through the shuffle once, inside _doc
    joined = common.parted(keyed, "key", bits, True).join(drops, F.col("id").eqNullSafe(F.col("of")) & (F.col("row") == F.col("its")), "left").select("_doc", "numbers")
    out, arrow = common.schema_of(joined, ["_doc"], "n_lines long, n_dropped long, text string")
    field = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            column = batch.column(0).field(field)
            for lo, hi in common.steps(common.utf8(column)[1]):
                lines, dropped, left = [], [], []
                for t, numbers in zip(column.slice(lo, hi - lo).to_pylist(), batch.column(1).slice(lo, hi - lo).to_pylist()):
                    lines.append(0 if t is None else t.count("\n") + 1)
                    dropped.append(len(gone := frozenset(numbers or ())))
                    left.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone) if gone else t)
                yield common.columns(batch, lo, hi, ["_doc"], {"n": np.array(lines, np.int64), "d": np.array(dropped, np.int64), "t": pa.array(left, pa.string())}, arrow)

    whole = F.col("_doc").getField(text)
    n_lines = F.coalesce(F.char_length(whole) - F.char_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    same = common.parted(keyed, "key", bits, False).select("_doc", n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), whole.alias("text"))
    return same.unionByName(common.mapped(joined, run, out))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier line equals, or if they are not short, equals up to one edit."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, exact=EXACT).select("_doc.doc_id", "n_lines", "n_dropped", "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without repeated lines; those of which nothing but white space is left go."""
    found = line_dedup(docs, exact=EXACT).where((F.col("n_dropped") == 0) | F.col("text").rlike("(?U)\\S"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("_doc.n_chars"))}
    return found.select(*(new.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns))


ORACLE_SQL = """
    WITH l AS MATERIALIZED (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
    f AS MATERIALIZED (SELECT line, length(line) AS n, count(*) AS times, min({'last': doc_id IS NULL, 'd': doc_id, 'i': i}) AS pos FROM l WHERE line <> '' GROUP BY line),
    v AS MATERIALIZED (SELECT line, pos, n, i, substr(line, 1, i - 1) || substr(line, i + 1) AS rest FROM (SELECT line, pos, n, unnest(range(1, n + 1)) AS i FROM f WHERE n >= 20)),
    near AS (SELECT a.line FROM v a JOIN v b ON a.rest = b.rest AND a.i = b.i AND a.n = b.n WHERE b.pos < a.pos
             UNION SELECT a.line FROM v a JOIN f b ON a.rest = b.line WHERE b.n >= 20 AND b.pos < a.pos
             UNION SELECT a.line FROM f a JOIN v b ON b.rest = a.line WHERE a.n >= 20 AND b.pos < a.pos),
    bad AS (SELECT line, pos, near.line IS NOT NULL AS near FROM f LEFT JOIN near USING (line) WHERE times > 1 OR near.line IS NOT NULL),
    o AS (SELECT l.doc_id, l.i, l.line, bad.line IS NOT NULL AND (bad.near OR {'last': l.doc_id IS NULL, 'd': l.doc_id, 'i': l.i} > bad.pos) AS gone FROM l LEFT JOIN bad ON bad.line = l.line),
    t AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text FROM o GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, t.text FROM documents d LEFT JOIN t USING (doc_id)"""
