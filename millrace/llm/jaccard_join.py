"""N-gram Jaccard join: a metric-space join of word-shingle sets, exact, by recursion over Voronoi regions.

1 - Jaccard is a metric. Documents with equal sets are one point. Two points within distance r = 1 - t share one at
least of the first |A| - ceil(t|A|) + 1 shingles of each in any fixed order, so each such shingle opens a region
that holds all points of which it is a first one, and no link is lost. The order puts rare shingles first (by a
count sketch of fixed size over all documents), so passages that many documents share open no regions.

A region then joins itself recursively. Some of its points become pivots, and all others get their distance to
each. Links to pivots merge components. A region whose points lie in one component is done. Otherwise each point
goes to the Voronoi region of its nearest pivot if that is within 2r, else to a rest region, and boundary points
are copied to the other regions that the triangle inequality leaves open: a point at d(x,p) from its own pivot p can
have a link in q's region only if d(x,q) <= min(d(x,p) + 2r, 3r); one with d(x,p) <= r has none in the rest region.
Pivots leave, their number grows from round to round, and the recursion ends when no region has two components.
Sets are compared only if their parities (for each of 512 groups of shingles, whether the set holds an odd number) leave
the distance open: parities that differ in k groups mean k different shingles at least.

Every step of the recursion is a DataFrame join or a combined aggregate, so no region is gathered in a task; joins on
keys that may be hot are plain ones that adaptive execution splits, or salted. Only the first regions go through a
window by region once, which streams and spills, to find the points that can have a partner there by their sizes.

Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return, after lower-casing
A-Z. Fewer words than a shingle make one shingle of all of them; null, empty and blank texts have the empty set and
link with nothing. Sets and points are known by 64-bit hashes. Rows are treated one by one: repeated ids stay, equal
texts link whatever their ids, and a null id is no component's smallest. Other columns are not read, whatever their
names. Very long texts are hashed in pieces. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.llm import common

#: Counters of the sketch, in how many pieces it is added up, and of how many tasks at a time.
SKETCH_BITS, PIECES, FAN = 21, 32, 64
#: Pivots of a region that its points are dealt by, and are linked to in the first round; each further round links to
#: GROWTH times as many.
PIVOTS, GROWTH = 4, 16
#: Places where the pairs of one pivot are compared.
SALTS = 32
#: 64-bit words of a set's parity.
PARITY = 8
#: Words of a shingle and percent of a link in the pipeline's stage; the query has its own.
SIZE, PERCENT = 5, 80

_WORD = np.ones(256, np.uint8)
_WORD[[32, 9, 10, 11, 12, 13]] = 0


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, sorted within each text, and where each text's own begin."""
    rows = len(offsets) - 1
    word, at = common.words(data, offsets, _WORD)
    n = np.diff(at)
    made = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    owner = np.repeat(np.arange(rows), made)
    first = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(made)[:-1]]), made) + np.arange(len(owner))
    h = np.zeros(len(owner), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            use = first + k < at[1:][owner]
            h[use] = h[use] * np.uint64(common.BASE) + word[first[use] + k]
    h = common.mix(h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(rows + 1))


def points(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each text's set; 0 for the empty set."""
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(common.mix(h ^ np.uint64(0x5851F42D4C957F2D)))])
        out = common.mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64))
    return np.where(np.diff(at) > 0, out, np.uint64(0)).view(np.int64)


def measure(docs: DataFrame, size: int, text: str, keep: list[str]) -> tuple[DataFrame, np.ndarray]:
    """The columns `keep` with n_shingles and point of each row, and the sketch of how common shingles are."""
    own, _ = common.schema_of(docs, keep, "n_shingles long, point long, piece int, counts binary")
    # rows of the sketch have null in all other columns
    own = T.StructType([T.StructField(f.name, f.dataType) for f in own])
    arrow = to_arrow_schema(own)
    width = (1 << SKETCH_BITS) // PIECES

    def run(batches):
        sketch, seen, met = np.zeros(1 << SKETCH_BITS, np.int64), common.Seen(), False
        for batch in batches:
            data, offsets = common.utf8(batch.column(len(keep)))
            for lo, hi in common.steps(offsets):
                h, at = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                point = points(h, at)
                new, met = seen.new(point), True
                sketch += np.bincount((h[np.repeat(new, np.diff(at))] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
                empty = [pa.nulls(hi - lo, pa.int32()), pa.nulls(hi - lo, pa.binary())]
                yield common.columns(batch, lo, hi, keep, {"n": np.diff(at), "p": point, "i": empty[0], "c": empty[1]}, arrow)
        if met:
            nulls = [pa.nulls(PIECES, f.type) for f in arrow][:-2]
            parts = [pa.compress(x.astype(np.uint32).tobytes(), "zstd", asbytes=True) for x in sketch.reshape(PIECES, width)]
            yield pa.RecordBatch.from_arrays([*nulls, pa.array(range(PIECES), pa.int32()), pa.array(parts, pa.binary())], schema=arrow)

    both = common.staged(common.mapped(docs.select(*keep, F.col(text)), run, own))

    def add(pdf):
        import pandas as pd

        total = np.zeros(width, np.int64)
        for x in pdf["counts"]:
            total += np.frombuffer(pa.decompress(x, width * 4, "zstd", asbytes=True), np.uint32)
        # counters stop at the largest number: they only tell common from rare
        counts = np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()
        return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "counts": [pa.compress(counts, "zstd", asbytes=True)]})

    parts = both.where("piece is not null").select("piece", "counts")
    tasks = parts.where("piece = 0").count()
    while tasks > FAN:  # in a tree: a group holds what some tasks counted
        tasks = -(-tasks // FAN)
        parts = common.staged(parts.groupBy("piece", F.pmod(F.xxhash64("counts"), F.lit(tasks))).applyInPandas(add, "piece int, counts binary"))
    sketch = np.zeros((PIECES, width), np.int64)
    for row in parts.groupBy("piece").applyInPandas(add, "piece int, counts binary").collect():
        sketch[row["piece"]] = np.frombuffer(pa.decompress(row["counts"], width * 4, "zstd", asbytes=True), np.uint32)
    return both.where("piece is null").drop("piece", "counts"), sketch.ravel()


def regions(docs: DataFrame, sketch: np.ndarray, size: int, percent: int, text: str) -> DataFrame:
    """The first regions: a row (region, point, n, most) for each first shingle of each point.

    most is the largest partner that the row can stand for: with `at` shingles before it, the first shingle that a
    pair shares leaves it n - at common ones at most.
    """
    # logarithmic classes of commonness are enough to put the common ones last
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(np.log2(np.maximum(sketch, 1)) * 4, 255).astype(np.uint8))

    def run(batches):
        commonness, seen = shared.value, common.Seen()
        for batch in batches:
            data, offsets = common.utf8(batch.column(0))
            for lo, hi in common.steps(offsets):
                h, at = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                n, point = np.diff(at), points(h, at)
                new = seen.new(point)  # not dealt by this task of late
                first = np.where(new & (n > 0), n - (percent * n + 99) // 100 + 1, 0)
                owner = np.repeat(np.arange(hi - lo), n)
                order = np.lexsort((h, commonness[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], owner))
                place = np.arange(len(h)) - at[:-1][owner]
                use = place < first[owner]
                take, own = order[use], owner[use]
                most = (100 + percent) * (n[own] - place[use]) // percent - n[own]
                yield pa.RecordBatch.from_arrays([pa.array(h[take].view(np.int64)), pa.array(point[own]), pa.array(n[own].astype(np.int32)), pa.array(most.astype(np.int32))], names=["region", "point", "n", "most"])

    return common.mapped(docs.select(F.col(text)), run, "region long, point long, n int, most int")


def fitting(rows: DataFrame) -> DataFrame:
    """The points of first regions that may have a partner there by their sizes.

    Of a pair the smaller set must allow for the larger one, so it allows for its own size: it is a full member. A row
    stays if it is full and the next larger set is within what it allows for, or if some full, not larger set allows
    for it and, should it not be full itself, some full set is small enough.
    """
    size = W.partitionBy("region").orderBy("n", "point")
    before = size.rowsBetween(W.unboundedPreceding, -1)
    # copies of a point from different tasks stand side by side
    once = rows.withColumn("copy", F.lag("point").over(size)).where("copy is null or copy <> point")
    full = F.col("most") >= F.col("n")
    beside = once.withColumn("next", F.lead("n").over(size)).withColumn("allowed", F.max(F.when(full, F.col("most"))).over(before)).withColumn("least", F.min(F.when(full, F.col("n"))).over(before))
    larger = full & (F.col("next") <= F.col("most"))
    smaller = (F.col("allowed") >= F.col("n")) & (full | (F.col("least") <= F.col("most")))
    return beside.where(F.coalesce(larger, F.lit(False)) | F.coalesce(smaller, F.lit(False))).select("region", "point", "n", "most")


def of_several(members: DataFrame, rows: DataFrame, what: str) -> DataFrame:
    """The members of regions in which, by rows, `what` has two values."""
    several = rows.groupBy("region").agg(F.min(what).alias("lo"), F.max(what).alias("hi")).where("lo <> hi").select("region")
    return members.join(several, "region", "left_semi")


def pivots_of(members: DataFrame, count: int, deal: int) -> DataFrame:
    """Up to `count` points of each region, from small components and of those that share much with others first:
    (region, pivot, m, allows, other, first), first for those that points are dealt by.

    Every point has one of `count` slots, and each slot its least point, so that no region is sorted.
    """
    if deal:
        crowd = members.groupBy("region", "component").agg(F.count("*").alias("crowd"))
        members = members.join(crowd, ["region", "component"])
    else:  # every point is a component of its own
        members = members.withColumn("crowd", F.lit(1))
    draw = F.xxhash64("point", F.lit(deal))
    best = members.groupBy("region", F.pmod(draw, F.lit(count)).alias("slot")).agg(F.min(F.struct("crowd", ((F.col("n") - F.col("most")) / F.col("n")).alias("apart"), draw.alias("draw"), "point", "n", "most", "component")).alias("p"))
    return best.select("region", F.col("p.point").alias("pivot"), F.col("p.n").alias("m"), F.col("p.most").alias("allows"), F.col("p.component").alias("other"), (F.col("slot") < PIVOTS).alias("first"))


def sets_of(docs: DataFrame, measured: DataFrame, candidates: DataFrame, size: int, text: str, doc_id: str) -> DataFrame:
    """(point, n, parity, shingles) of the candidates, each from one document."""
    chosen = common.staged(measured.join(candidates, "point", "left_semi").groupBy("point").agg(F.min(doc_id).alias("id")).select(F.xxhash64("id").alias("id")))
    bits = docs.sparkSession.sparkContext.broadcast(common.bitmap(chosen, "id", hashed=True))

    def run(batches):
        seen = common.Seen()
        for batch in batches:
            wanted = common.inside(bits.value, batch.column(0).to_numpy())
            data, offsets = common.utf8(batch.column(1).filter(pa.array(wanted)))
            for lo, hi in common.steps(offsets):
                h, at = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                point = points(h, at)
                use = np.flatnonzero(seen.new(point))
                n = np.diff(at)[use]
                values = np.concatenate([h[at[i] : at[i + 1]] for i in use]) if len(use) else h[:0]
                group = np.repeat(np.arange(len(use)) * 64 * PARITY, n) + (values % np.uint64(64 * PARITY)).astype(np.int64)
                odd = (np.bincount(group, minlength=len(use) * 64 * PARITY) & 1).astype(np.uint8)
                words = np.packbits(odd, bitorder="little").view("<i8").reshape(-1, PARITY)
                ends = pa.array(np.cumsum(np.r_[0, n]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(point[use]), *map(pa.array, words.T), pa.ListArray.from_arrays(ends, pa.array(values.view(np.int64)))], names=["point", *PARITIES, "shingles"])

    found = common.mapped(docs.select(F.xxhash64(doc_id), F.col(text)), run, f"point long, {', '.join(x + ' long' for x in PARITIES)}, shingles array<long>")
    return found.join(candidates, "point", "left_semi").groupBy("point").agg(*(F.first(x).alias(x) for x in (*PARITIES, "shingles")))


PARITIES = [f"p{i}" for i in range(PARITY)]


def distances(pairs: DataFrame, sets: DataFrame, parities: DataFrame, percent: int) -> DataFrame:
    """Of pairs (point, pivot, n, m): those that may be as alike as percent by their parities, with the size of the
    intersection and of the union."""
    rows = pairs
    for own, mark in (("point", "a"), ("pivot", "b")):
        rows = rows.join(parities.select(F.col("point").alias(own), *(F.col(x).alias(f"{mark}_{x}") for x in PARITIES)), own)
    unlike = sum((F.bit_count(F.col(f"a_{x}").bitwiseXOR(F.col(f"b_{x}"))) for x in PARITIES), F.lit(0))
    both = F.col("n").cast("long") + F.col("m")
    near = common.staged(rows.where((both - unlike) * 100 >= (both + unlike) * percent).select("point", "pivot"))
    # the points' sets are dealt by point already; a pivot's set goes to all places where its pairs are
    near = near.withColumn("salt", F.pmod(F.xxhash64("point"), F.lit(SALTS)))
    one = near.join(sets.select("point", F.col("shingles").alias("a")), "point")
    other = near.select("pivot", "salt").distinct().join(sets.select(F.col("point").alias("pivot"), F.col("shingles").alias("b")), "pivot")
    same = F.size(F.array_intersect("a", "b"))
    return one.join(other, ["pivot", "salt"]).select("point", "pivot", same.alias("same"), (F.size("a") + F.size("b") - same).alias("all"))


def components(links: DataFrame) -> DataFrame:
    """(point, component): the smallest point reachable over links (point, pivot); only for points with a link.

    Each round gives every point the smallest label of its neighbours and then that label's own label.
    """
    edges = common.staged(links.select(F.col("point").alias("a"), F.col("pivot").alias("b")).union(links.select("pivot", "point")).distinct())
    labels = common.staged(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("label")))
    while True:
        near = edges.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, "a").select("a", "label", F.least("label", "near").alias("next"))
        jump = lower.join(labels.select(F.col("a").alias("next"), F.col("label").alias("further")), "next", "left")
        new = common.staged(jump.select("a", F.least("next", F.coalesce("further", "next")).alias("label"), (F.col("label") != F.least("next", F.coalesce("further", "next"))).alias("moved")))
        labels = new.select("a", "label")
        if new.where("moved").isEmpty():
            return labels.select(F.col("a").alias("point"), F.col("label").alias("component"))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(point, component) after further links: only the components that they touch are joined anew."""
    named = links.select(F.col("point").alias("x"), F.col("pivot").alias("y"))
    for own, name in (("x", "a"), ("y", "b")):
        named = named.join(labels.select(F.col("point").alias(own), F.col("component").alias(name)), own, "left").withColumn(name, F.coalesce(name, own))
    joints = common.staged(named.where("a <> b").select(F.col("a").alias("point"), F.col("b").alias("pivot")).distinct())
    if joints.isEmpty():
        return labels
    new = components(joints)
    moved = labels.join(new.select(F.col("point").alias("component"), F.col("component").alias("to")), "component", "left").select("point", F.coalesce("to", "component").alias("component"))
    return common.staged(moved.union(new.join(labels, "point", "left_anti")))


def linked_points(docs: DataFrame, size: int, percent: int, keep: tuple[str, ...] = ("id",)) -> tuple[DataFrame, DataFrame]:
    """Of documents with id and text: the columns `keep` with n_shingles and point of each row, and (point, component)
    of the points with a link.

    Links within a component are looked at only as far as they are needed to tell components apart.
    """
    measured, sketch = measure(docs, size, "text", list(keep))
    r = (100 - percent) / 100
    members = common.staged(fitting(regions(docs, sketch, size, percent, "text"))).withColumn("component", F.col("point"))
    candidates = common.staged(members.select("point").distinct())
    sets = common.bucketed(sets_of(docs, measured, candidates, size, "text", "id"), "point")
    parities = common.staged(sets.drop("shingles"))
    labels = docs.sparkSession.createDataFrame([], "point long, component long")
    count, deal, known = PIVOTS, 0, None
    like = lambda least: F.least("n", "m") * 100 >= F.greatest("n", "m") * least  # noqa: E731  sizes that leave a distance open
    far = 100 - 3 * (100 - percent)  # 3r, where no link is
    while not members.isEmpty():
        chosen = common.staged(pivots_of(members, count, deal))
        pairs = members.join(chosen, "region").where(like(percent) & (F.col("component") != F.col("other")) & (F.col("m") <= F.col("most")) & (F.col("n") <= F.col("allows")))
        each = pairs.groupBy(F.least("point", "pivot").alias("x"), F.greatest("point", "pivot").alias("y")).agg(F.min(F.struct("point", "pivot", "n", "m")).alias("p"))
        found = common.staged(distances(each.select("p.*"), sets, parities, percent))
        labels = merged(labels, found.where(F.col("same") * 100 >= F.col("all") * percent))
        # what is left: points that were no pivots, in regions that still hold two components
        rest = members.drop("component").join(chosen.select("region", F.col("pivot").alias("point")), ["region", "point"], "left_anti")
        rest = common.staged(rest.join(labels, "point", "left").withColumn("component", F.coalesce("component", "point")))
        left = common.staged(of_several(rest, rest, "component"))
        if left.isEmpty():
            break
        # windows reach to 3r: distances to the centres that the rest is dealt by, as far as they are smaller
        centres = chosen.where("first")
        beside = left.join(centres, "region").where(like(far)).select("point", "pivot", "n", "m").distinct()
        known = common.staged(distances(beside, sets, parities, far))
        members = common.staged(voronoi(left, centres, known, r))
        count, deal = GROWTH * count, deal + 1
    return measured, labels


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest id that is reachable over links."""
    measured, labels = linked_points(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), size, percent)
    ids = measured.where("n_shingles > 0").groupBy("point").agg(F.min("id").alias("id"))
    classes = ids.join(labels, "point", "left").withColumn("component", F.coalesce("component", "point"))
    smallest = classes.groupBy("component").agg(F.min("id").alias("component_id"))
    by_point = classes.join(smallest, "component").select("point", "component_id")
    # only sets that stand in several rows need the join; a set of one row alone in its component is its own
    out = measured.join(by_point, "point", "left")
    return out.select(F.col("id").alias(doc_id), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def voronoi(left: DataFrame, chosen: DataFrame, known: DataFrame, r: float) -> DataFrame:
    """The regions of the next round: (region, point, n, most, component)."""
    slack = 1e-9
    far = known.select("point", "pivot", (1 - F.col("same") / F.col("all")).alias("d"))
    near = left.join(chosen.select("region", "pivot"), "region", "left").join(far, ["point", "pivot"], "left")
    near = near.withColumn("d", F.coalesce("d", F.lit(1.0)))  # further than 3r, or a region without centres
    home = near.groupBy("region", "point", "n", "most", "component").agg(F.min(F.struct("d", "pivot")).alias("best"), F.collect_list(F.struct("d", "pivot")).alias("every"))
    d, own = F.col("best.d"), F.when(F.col("best.d") <= 2 * r + slack, F.col("best.pivot"))
    open_ = F.filter("every", lambda x: x["d"] <= F.least(F.when(own.isNotNull(), d + 2 * r).otherwise(F.lit(3 * r)), F.lit(3 * r)) + slack)
    homes = F.array_compact(F.array(own))
    rest = F.when(own.isNull() | (d > r - slack), F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<long>"))
    to = F.array_distinct(F.concat(homes, F.transform(open_, lambda x: x["pivot"]), rest))
    dealt = home.select("region", "point", "n", "most", "component", F.explode(to).alias("to"))
    dealt = common.staged(dealt.select(F.xxhash64("region", "to").alias("region"), "point", "n", "most", "component"))
    mixed = dealt.groupBy("region").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("point", "most")).alias("print"), F.sum(F.xxhash64("point", "most", F.lit(1)).cast("decimal(38,0)")).alias("total")).where("lo <> hi")
    one = mixed.groupBy("size", "print", "total").agg(F.min("region").alias("region")).select("region")  # equal regions once
    return dealt.join(one, "region", "left_semi").select("region", "point", "n", "most", "component")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of Jaccard 0.85 or more on 4-word shingles."""
    return jaccard_components(common.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, under links of 0.8 or more on 5-word shingles: that with the smallest id, and of those the
    one with the smallest hash of its text. Rows with a null id stay, and so do texts that link with nothing.

    A row is known by its id and the hash of its text; of rows that agree in both the one with the smallest columns stays.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), F.col("text").alias("text"))
    measured, labels = linked_points(rows, SIZE, PERCENT, ("id", "key"))
    alike = measured.where("id is not null and n_shingles > 0").groupBy("point", "id", "key").agg(F.count("*").alias("rows"))
    of_point = alike.groupBy("point").agg(F.min(F.struct("id", "key", "rows")).alias("first"))
    of_group = of_point.join(labels, "point", "left").groupBy(F.coalesce("component", "point").alias("component")).agg(F.min("first").alias("first"))
    firsts = common.staged(of_group.select("first.*"))
    wordless = ~F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    free = F.col("id").isNull() | wordless
    kept = rows.where(~free).drop("text").join(firsts.drop("rows"), ["id", "key"], "left_semi")
    many = firsts.where("rows > 1").drop("rows")
    if not many.isEmpty():
        once = kept.join(many, ["id", "key"], "left_semi").groupBy("id", "key").agg(F.min("_doc").alias("_doc"))
        kept = kept.join(many, ["id", "key"], "left_anti").unionByName(once)
    return kept.select("_doc.*").unionByName(rows.where(free).select("_doc.*"))


ORACLE_SQL = """
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(w[i : i + 3]) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
    e AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
    r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other)
    SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id
    FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""
