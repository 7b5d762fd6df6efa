"""Benchmark decontamination by a distributed positional inverted index.

The documents are indexed once, in shards: each row of the stored index covers a few megabytes of whole documents and
has, for every word that occurs there, the sorted list of its positions. Shards are dealt by documents, so no word,
however common, gathers in one task, and any test set can be searched in the same index. Counts of the test set's
words over all shards give the order of rarity. A phrase is found from its rarest word: the positions of each further
word, less its offset in the phrase, are intersected with the starts that are left, and most phrases end after one or
two lists. A proximity search takes the same lists and returns the shortest stretches that hold all of its words.

The test set is taken in blocks of bounded size; only a block's words and phrases are broadcast, and a further
block costs a further search. Words are maximal runs of 0-9, a-z and bytes over 127, after lower-casing A-Z.
Windows are the runs of `window` words of an item; an item with fewer words, but not none, is one window.

Null and empty texts have no words and are never hit. A very long text makes a shard of its own. Items with the same id
count once, equal items are searched once. Rows of the documents are treated one by one, so repeated ids stay. Other
columns are not read, whatever their names, and those in `keep` come back as they are. An empty test set hits nothing,
and an empty table of documents gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

#: Bytes of test texts in a block, about, and of documents in a shard.
BLOCK_BYTES, SHARD_BYTES = 4 << 20, 2 << 20

#: A row of the index is a whole shard, and Spark decodes a row group of nested columns at once: so row groups hold a few rows,
#: however much a task reads or writes.
SMALL_GROUPS = {"parquet.block.row.count.limit": "4"}

_WORD = np.zeros(256, np.uint8)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and for each text where its own begin; the last entry is their number."""
    return common.words(data, offsets, _WORD)


def words_of(texts: list[str | None]) -> list[np.ndarray]:
    hashes, at = words(*common.utf8(pa.array(texts, pa.string())))
    return [hashes[a:b] for a, b in zip(at, at[1:])]


def build_index(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The stored index: a row for each shard, with its documents and the positions of all words.

    A document's positions begin at `first`; one position is left free after each document. `terms` are the sorted
    hashes of the words, `gaps` the differences of all positions, term after term; `ends` is where each term's end.
    """
    names = list(keep)
    own = common.schema_of(docs, names, "n_words long, first int")[0]
    schema = f"docs array<{own.simpleString()}>, terms array<long>, ends array<int>, gaps array<int>"
    rows, texts = common.reading(docs, names, text)

    def run(batches):
        for batch in batches:
            data, offsets = common.utf8(texts(batch))
            for lo, hi in common.steps(offsets, SHARD_BYTES):
                term, at = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                n = np.diff(at)
                order = np.argsort(term, kind="stable")
                position = order + np.searchsorted(at, order, "right") - 1
                term = term[order]
                edge = np.flatnonzero(term[1:] != term[:-1]) + 1
                edge = np.append(edge, len(term)) if len(term) else edge
                structs = pa.StructArray.from_arrays(
                    [batch.column(x).slice(lo, hi - lo) for x in names] + [pa.array(n, pa.int64()), pa.array((at[:-1] + np.arange(len(n))).astype(np.int32))], names=[*names, "n_words", "first"]
                )
                lists = [structs, pa.array(term[edge - 1].view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (edge, np.diff(position, prepend=0)))]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists], names=["docs", "terms", "ends", "gaps"])

    with common.settings(docs.sparkSession, SMALL_GROUPS):
        return common.staged(common.mapped(rows, run, schema))


def places(terms: np.ndarray, ends: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Where the postings of each word of the vocabulary (sorted hashes) begin and end in a shard."""
    out = np.zeros((len(vocabulary), 2), np.int64)
    terms = terms.view(np.uint64)
    at = np.searchsorted(terms, vocabulary)
    known = np.flatnonzero(at < len(terms))
    known = known[terms[at[known]] == vocabulary[known]]
    at = at[known]
    out[known, 1] = ends[at]
    out[known[at > 0], 0] = ends[at[at > 0] - 1]
    return out


def term_counts(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each word of the vocabulary occurs in all shards."""
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for terms, ends in zip(batch.column(0), batch.column(1)):
                total += np.diff(places(terms.values.to_numpy(), ends.values.to_numpy(), shared.value))[:, 0]
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], names=["term", "n"])

    found = common.mapped(index.select("terms", "ends"), run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary), np.int64)
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    return out


class Shard:
    """The postings of one row of the index, for the words of a vocabulary."""

    def __init__(self, terms: np.ndarray, ends: np.ndarray, gaps: np.ndarray, vocabulary: np.ndarray):
        self.positions = np.cumsum(gaps, dtype=np.int64)
        self.at = places(terms, ends, vocabulary)

    def has(self) -> np.ndarray:
        return self.at[:, 1] > self.at[:, 0]

    def list(self, term: int) -> np.ndarray:
        return self.positions[self.at[term, 0] : self.at[term, 1]]

    def phrase(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Where the words stand one after the other, by intersection from the rarest."""
        starts = None
        for k in np.argsort(counts[terms], kind="stable"):
            here = self.list(terms[k]) - k
            if starts is None:
                starts = here
            else:
                small, large = (starts, here) if len(starts) <= len(here) else (here, starts)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                starts = small[large[at] == small] if len(large) else small[:0]
            if not len(starts):
                break
        return starts

    def near(self, terms: np.ndarray, counts: np.ndarray, within: int) -> list[tuple[int, int]]:
        """The shortest stretches of at most `within` positions that hold each word, as start and end."""
        need = {int(t): int((terms == t).sum()) for t in terms}
        rare = self.list(min(need, key=lambda t: counts[t]))
        lists = []
        for t in need:
            p = self.list(t)
            at = np.searchsorted(rare, p)
            close = np.minimum(np.abs(p - rare[np.minimum(at, len(rare) - 1)]), np.abs(p - rare[np.maximum(at - 1, 0)])) < within if len(rare) else np.zeros(len(p), bool)
            lists += [(int(x), t) for x in p[close]]
        lists.sort()
        out, have, lo, full = [], defaultdict(int), 0, 0
        for p, t in lists:
            have[t] += 1
            full += have[t] == need[t]
            while full == len(need):
                start, first = lists[lo]
                if have[first] == need[first]:  # the stretch can't begin later
                    if p + 1 - start <= within and (not out or out[-1][0] < start):
                        out.append((start, p + 1))
                    full -= 1
                have[first] -= 1
                lo += 1
        return out


def search(index: DataFrame, vocabulary: np.ndarray, queries: list[tuple[str, np.ndarray, int | None]], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each document: the columns `keep`, n_words, items (ids of the queries that it matches), starts and ends of matches.

    queries: (id, hashes of words, None for an exact phrase or the most words that a match may span). Stretches of
    exact phrases that touch are joined. A word that isn't in the vocabulary matches nothing.
    """
    counts = term_counts(index, vocabulary)
    phrases = defaultdict(set)
    spans = []
    for name, h, within in queries:
        at = np.minimum(np.searchsorted(vocabulary, h), max(len(vocabulary) - 1, 0))
        if len(h) and len(vocabulary) and (vocabulary[at] == h).all():
            if within is None:
                phrases[at.astype(np.int32).tobytes()].add(name)
            else:
                spans.append((at, within, name))
    lengths = defaultdict(list)
    for key in phrases:
        lengths[len(key) // 4].append(key)
    tables = {m: (np.frombuffer(b"".join(keys), np.int32).reshape(-1, m), [sorted(phrases[k]) for k in keys]) for m, keys in lengths.items()}
    shared = index.sparkSession.sparkContext.broadcast((vocabulary, counts, tables, spans))
    fields = index.schema["docs"].dataType.elementType
    out, arrow = common.schema_of(index.sparkSession.createDataFrame([], fields), [*keep, "n_words"], "items array<string>, starts array<int>, ends array<int>")

    def run(batches):
        vocabulary, counts, tables, spans = shared.value
        for batch in batches:
            for r in range(batch.num_rows):
                docs, terms, ends, gaps = (batch.column(i)[r].values for i in range(4))
                shard = Shard(terms.to_numpy(), ends.to_numpy(), gaps.to_numpy(), vocabulary)
                first = docs.field(docs.type.get_field_index("first")).to_numpy()
                n = docs.field(docs.type.get_field_index("n_words")).to_numpy()
                has, found, cover, more = shard.has(), set(), np.zeros(first[-1] + n[-1] + 2, np.int32), []
                for m, (rows, names) in tables.items():
                    for w in np.flatnonzero(has[rows].all(1)):
                        starts = shard.phrase(rows[w], counts)
                        if len(starts):
                            np.add.at(cover, starts, 1)
                            np.add.at(cover, starts + m, -1)
                            found.update((d, x) for d in np.unique(np.searchsorted(first, starts, "right") - 1).tolist() for x in names[w])
                for at, within, name in spans:
                    if has[at].all():
                        for s, e in shard.near(at, counts, within):
                            d = int(np.searchsorted(first, s, "right")) - 1
                            if e <= first[d] + n[d]:
                                found.add((d, name))
                                more.append((d, s, e))
                edge = np.flatnonzero(np.diff((np.cumsum(cover) > 0).astype(np.int8), prepend=0))
                stretches = [(int(np.searchsorted(first, s, "right")) - 1, int(s), int(e)) for s, e in edge.reshape(-1, 2)] + more
                items, starts, ends = ([[] for _ in n] for _ in range(3))
                for d, x in sorted(found):
                    items[d].append(x)
                for d, s, e in sorted(stretches):
                    starts[d].append(s - int(first[d]))
                    ends[d].append(e - int(first[d]))
                own = [docs.field(docs.type.get_field_index(x)) for x in [*keep, "n_words"]]
                new = [pa.array(items, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(own + new, arrow)], schema=arrow)

    return common.mapped(index.select("docs", "terms", "ends", "gaps"), run, out)


def decontaminate(docs: DataFrame, tests: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """The columns `keep` with n_words, items (sorted ids of items with a window in the text), starts and ends of hit stretches of words."""
    items = tests.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(item_text).alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    if blocks > 1:
        docs, keep = docs.withColumn("_row", F.monotonically_increasing_id()), (*keep, "_row")
    index = build_index(docs, text, keep)
    found = []
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()
        queries = []
        for row, h in zip(rows, words_of([r["text"] for r in rows])):
            queries += [(row["id"], h[i : i + window], None) for i in range(max(len(h) - window + 1, min(len(h), 1)))]
        vocabulary = np.unique(np.concatenate([q[1] for q in queries])) if queries else np.zeros(0, np.uint64)
        found.append(search(index, vocabulary, queries, keep))
    if blocks == 1:
        return found[0].withColumn("items", F.array_sort("items"))
    every = found[0]
    for x in found[1:]:
        every = every.union(x)
    lists = [F.flatten(F.collect_list(x)).alias(x) for x in ("items", "starts", "ends")]
    merged = every.groupBy("_row").agg(*(F.first(x).alias(x) for x in (*keep[:-1], "n_words")), *lists)
    return merged.drop("_row").withColumn("items", F.array_sort(F.array_distinct("items")))


def hit_words():
    """How many words the stretches of a row cover."""
    each = F.zip_with("starts", "ends", lambda s, e: F.sequence(s, e - 1))
    return F.size(F.array_distinct(F.flatten(each))).cast("long")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that stand in a window of a benchmark item, and the items."""
    found = decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.concat_ws(",", "items"), 256)
    hit = found.select("doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"))
    return hit.withColumn("contaminated", F.col("n_hit") > 0)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no window of a benchmark item stands.

    Every row is decided by its own text: repeated rows and ids stay or go together, all columns come back as they were.
    """
    spark, digest = docs.sparkSession, F.unhex(F.sha2("text", 256))  # null texts have none and are never hit
    items = common.table(spark, sf_dir, "benchmark")
    # the index knows texts by their digests and is deleted when the hit ones are known, so it holds no second copy of the documents
    hits = common.settled(spark, lambda: decontaminate(docs.select(digest.alias("digest"), "text"), items, keep=("digest",)).where(F.size("items") > 0).select("digest").distinct())
    bits = spark.sparkContext.broadcast(common.bitmap(hits, "digest"))
    if not bits.value.any():
        return docs
    keyed = docs.select(F.struct("*").alias("_doc"), digest.alias("digest"), F.xxhash64(digest).alias("key"))
    # only rows that the filter takes in, the hit ones and few others, go through a join
    rest = common.parted(keyed, "key", bits, True).join(hits, "digest", "left_anti")
    return common.parted(keyed, "key", bits, False).select("_doc.*").unionByName(rest.select("_doc.*"))


ORACLE_SQL = """
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
    bw AS (SELECT DISTINCT item_id, w[i : i + least(len(w), 10) - 1] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT len(win) AS m FROM bw),
    dw AS (SELECT doc_id, i, m, w[i : i + m - 1] AS win FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
    h AS (SELECT doc_id, i, m, item_id FROM dw JOIN bw USING (win)),
    words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
    its AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items, sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)"""
