"""Exact top-k by inner product: best-first search in a paged M-tree.

Vectors become integers, floor(scale * x), shorter ones padded with zeros. One more coordinate, the root of the
largest squared length less the vector's own, turns inner products into distances: for a query with 0 there, a
greater inner product is a smaller Euclidean distance, so a metric tree can search.

The tree has two levels of routing objects over leaf pages. Routing objects come from a sample of bounded size
(`SAMPLE` rows); every row is then dealt to its nearest one. Nodes keep covering radii, and all entries keep the
distance to their parent. A large leaf is cut into rings by that distance, and a ring into pages of about `PAGE` entries;
a ring knows the least and greatest distance that it holds. A query goes through the leaves in order of the least
possible distance, in rounds: its nearest leaf first, then `GROWTH` times as many in each further round, each round with
the bound that the k-th best so far gives. |d(q,parent) - d(child,parent)| - radius spares distances to nodes, the same
difference spares whole rings of a leaf, and inner products within a page. Visits are rows (query, page), joined with the queries and pages in Spark and searched in groups of
bounded size; nothing but the sample and the routing objects goes through the driver.

Vectors that are null or hold null or non-finite components, and rows with a null id, take no part. Whole numbers and
scores beyond 64 bits are held at the ends of that range. Rows with the query's id are the query's own. Several query
rows with one id count once (the least vector). Ties go to smaller ids; repeated rows are candidates each; fewer than
k candidates give fewer rows. An empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm import common

#: Rows that the routing objects are chosen from, the most routing objects of leaves, and entries of a page.
SAMPLE, LEAVES, PAGE = 4096, 1024, 256
#: Queries of a block that searches a page together.
BLOCK = 512
#: Slack of distances, relative to the largest one, against rounding; of squared ones.
SLACK, SQUARED_SLACK = 1e-9, 1e-12
#: How many times as many leaves each round of a search visits.
GROWTH = 16
#: The most rings of a leaf.
RINGS = 64


def integers(rows: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v array<bigint>) of the rows that take part."""
    x = F.transform(vector, lambda c: c.cast("double"))
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(c * scale))
    return rows.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & sound).select(F.col(vec_id).alias("vec_id"), whole.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as the rows of a matrix, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False) if len(column) else np.zeros(0, np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


def lifted(v: np.ndarray, most: int) -> np.ndarray:
    """With the further coordinate that makes all squared lengths `most`."""
    v = v.astype(float)
    return np.c_[v, np.sqrt(np.maximum(most - (v * v).sum(1), 0))]


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all rows of b."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


class Tree:
    """The routing objects: `inner` ones over `leaf` ones."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.leaf = self._spread(sample, leaves)
        self.inner = self._spread(self.leaf, max(1, int(len(self.leaf) ** 0.5)))
        d = gaps(self.leaf, self.inner)
        self.parent = d.argmin(1)
        self.parent_distance = d.min(1)
        self.radius = np.zeros(len(self.leaf))
        self.entries = np.zeros(len(self.leaf), np.int64)
        self.rings: dict[int, np.ndarray] = {}  # by leaf: least and greatest distance, first page and number of pages of each ring

    @staticmethod
    def _spread(points: np.ndarray, count: int) -> np.ndarray:
        """Points far from each other: each next one is farthest from those chosen."""
        chosen, far = [0], np.full(len(points), np.inf)
        while True:
            far = np.minimum(far, np.sqrt(((points - points[chosen[-1]]) ** 2).sum(1)))
            if len(chosen) == min(count, len(points)) or far.max() <= 0:
                return points[chosen]
            chosen.append(int(far.argmax()))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = gaps(x, self.leaf)
        at = d.argmin(1)
        return at, np.sqrt(((x - self.leaf[at]) ** 2).sum(1))

    def settle(self, radius: dict[int, tuple[float, int]]) -> "Tree":
        """Takes over the covering radius and number of entries of each leaf."""
        for node, (r, n) in radius.items():
            self.radius[node], self.entries[node] = r, n
        self.inner_radius = np.zeros(len(self.inner))
        full = self.entries > 0
        np.maximum.at(self.inner_radius, self.parent[full], (self.parent_distance + self.radius)[full])
        return self

    def visit(self, q: np.ndarray, bound: float) -> list[tuple[int, float]]:
        """The leaves that may hold something within the bound, nearest first, with their distances."""
        out = []
        inner = np.sqrt(((self.inner - q) ** 2).sum(1))
        slack = SLACK * (1 + np.abs(inner).max() + (bound if np.isfinite(bound) else 0))
        for i in np.argsort(inner - self.inner_radius):
            if inner[i] - self.inner_radius[i] > bound + slack:
                break
            spared = np.abs(inner[i] - self.parent_distance) - self.radius > bound + slack
            for n in np.flatnonzero((self.parent == i) & (self.entries > 0) & ~spared):
                d = float(np.sqrt(((self.leaf[n] - q) ** 2).sum()))
                if d - self.radius[n] <= bound + slack:
                    out.append((d - self.radius[n], int(n), d))
        return [(n, d) for _, n, d in sorted(out)]

    def pages(self, node: int, d: float, bound: float) -> np.ndarray:
        """The pages of a leaf at distance d whose rings may hold something within the bound."""
        lo, hi, first, count = self.rings[node].T
        slack = SLACK * (1 + d + (bound if np.isfinite(bound) else 0))
        some = np.flatnonzero((lo <= d + bound + slack) & (hi >= d - bound - slack))
        return np.concatenate([np.arange(first[i], first[i] + count[i]) for i in some] or [np.zeros(0)]).astype(np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        worst = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= worst)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))


def dots(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, exact as long as they fit into 64 bits, else the end of that range."""
    most = float(np.abs(v.astype(float)).max(initial=0)) * float(np.abs(q.astype(float)).max(initial=0)) * max(len(q), 1)
    if most < 2**52:
        return (v.astype(float) @ q.astype(float)).astype(np.int64)
    if most < 2**62:
        return v @ q
    return np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in v.astype(object) @ q.astype(object)], np.int64)


def searched(visits: DataFrame, asked: DataFrame, pages: DataFrame, width: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best k of each visit (query_id, node, page, block, d, reach, floor) in its page.

    d is the query's distance to the node's routing object, reach how far from the query a result may be, and floor the
    k-th best score so far: what is below it comes to nothing, so it isn't returned.
    """
    needed = visits.select(F.col("node").alias("n"), F.col("page").alias("p"), F.col("block").alias("b")).distinct()
    entries = needed.join(pages, (F.col("n") == F.col("node")) & (F.col("p") == F.col("page"))).select("n", "p", "b", "parent", "vec_id", "v")

    def search(queries: pa.Table, page: pa.Table) -> pa.Table:
        order = np.argsort(page["parent"].to_numpy(), kind="stable")
        parent, ids = page["parent"].to_numpy()[order], page["vec_id"].to_numpy()[order]
        v, q = matrix(page["v"], width)[order], matrix(queries["q"], width)
        out: list[tuple[np.ndarray, ...]] = []
        d, reach, own = queries["d"].to_numpy(), queries["reach"].to_numpy(), queries["query_id"].to_numpy()
        floor = pc.fill_null(queries["floor"], -(2**63)).to_numpy()
        slack = SLACK * (1 + d + np.where(np.isfinite(reach), reach, 0))
        lo, hi = np.searchsorted(parent, d - reach - slack), np.searchsorted(parent, d + reach + slack, "right")
        for i in np.flatnonzero(hi > lo):
            part = slice(lo[i], hi[i])
            scores = dots(v[part], q[i])
            use = np.flatnonzero((ids[part] != own[i]) & (scores >= floor[i]))
            at = use[best(ids[part][use], scores[use], k)]
            out.append((np.full(len(at), own[i]), ids[part][at], scores[at]))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(x, pa.int64()) for x in cols], names=["query_id", "vec_id", "score"])

    full = visits.join(asked.select("query_id", "q"), "query_id")
    return full.groupBy("node", "page", "block").cogroup(entries.groupBy("n", "p", "b")).applyInArrow(search, "query_id long, vec_id long, score long")


def top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vector_topk(rows: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with all rows but its own."""
    every = common.staged(integers(rows, vec_id, vector, scale).withColumn("length", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))
    facts = every.agg(F.count("*").alias("n"), F.max("length").alias("most"), F.max(F.size("v")).alias("width")).first()
    asked = integers(queries, vec_id, vector, scale).groupBy("vec_id").agg(F.min("v").alias("q")).withColumnRenamed("vec_id", "query_id")
    if not facts["n"]:
        return asked.limit(0).select("query_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("score"))
    sizes = asked.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("width")).first()
    n, most, width = facts["n"], facts["most"], max(facts["width"], sizes["width"] or 0)
    blocks = max(1, -(-sizes["n"] // BLOCK))
    few = every.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    tree = Tree(np.unique(lifted(matrix(few["v"], width), most), axis=0), min(LEAVES, -(-n // PAGE)))
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def deal(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 8192):
                part = batch.slice(lo, 8192)
                node, parent = shared.value.nearest(lifted(matrix(part.column(1), width), most))
                yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int32)), pa.array(parent), part.column(0), part.column(1)], names=["node", "parent", "vec_id", "v"])

    leaves = common.staged(common.mapped(every.select("vec_id", "v"), deal, "node int, parent double, vec_id long, v array<long>"))
    stats = leaves.groupBy("node").agg(F.max("parent").alias("radius"), F.count("*").alias("n")).collect()
    tree.settle({r["node"]: (r["radius"], r["n"]) for r in stats})
    # a row for each leaf, then for each of its rings: LEAVES * RINGS at most
    spark = rows.sparkSession
    sizes = spark.createDataFrame([(r["node"], float(r["radius"]), min(RINGS, -(-r["n"] // PAGE))) for r in stats], "node int, radius double, rings int")
    ring = F.when(F.col("radius") > 0, F.least(F.floor(F.col("parent") / F.col("radius") * F.col("rings")).cast("int"), F.col("rings") - 1)).otherwise(F.lit(0))
    ringed = leaves.join(F.broadcast(sizes), "node").withColumn("ring", ring).drop("radius", "rings")
    found = ringed.groupBy("node", "ring").agg(F.min("parent").alias("lo"), F.max("parent").alias("hi"), F.count("*").alias("n")).orderBy("node", "ring").collect()
    firsts, total = [], {}
    for r in found:
        first, own = total.get(r["node"], 0), -(-r["n"] // PAGE)
        firsts.append((r["node"], r["ring"], first, own))
        total[r["node"]] = first + own
        tree.rings.setdefault(r["node"], []).append((r["lo"], r["hi"], first, own))
    tree.rings = {node: np.array(x) for node, x in tree.rings.items()}
    dealt = F.broadcast(spark.createDataFrame(firsts, "node int, ring int, first int, own int"))
    pages = ringed.join(dealt, ["node", "ring"]).withColumn("page", (F.col("first") + F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("own"))).cast("int")).drop("ring", "first", "own")
    ready = rows.sparkSession.sparkContext.broadcast(tree)
    schema = "query_id long, node int, page int, d double, reach double, floor long, block int"

    def visits(lo: int, hi: int):
        """Of queries (query_id, q, floor): the pages of their lo-th to hi-th nearest leaves, as far as they are within reach."""

        def run(batches):
            tree = ready.value
            for batch in batches:
                q = matrix(batch.column(1), width).astype(float)
                for i, (own, floor, block) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)))):
                    size = (q[i] ** 2).sum() + most
                    reach = np.inf if floor is None else float(np.sqrt(max(size - 2 * floor, 0) + SQUARED_SLACK * size))
                    rows_ = [(n, p, d) for n, d in tree.visit(np.append(q[i], 0.0), reach)[lo:hi] for p in tree.pages(n, d, reach).tolist()]
                    for at in range(0, len(rows_), 4096):
                        part = list(zip(*rows_[at : at + 4096]))
                        m = len(part[0])
                        yield pa.RecordBatch.from_arrays([
                            pa.array([own] * m, pa.int64()), pa.array(part[0], pa.int32()), pa.array(part[1], pa.int32()),
                            pa.array(part[2], pa.float64()), pa.array([reach] * m, pa.float64()), pa.array([floor] * m, pa.int64()), pa.array([block] * m, pa.int32()),
                        ], names=["query_id", "node", "page", "d", "reach", "floor", "block"])

        return run

    asked = common.staged(asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")))
    found, lo, hi = None, 0, 1
    while True:
        bound = asked.withColumn("floor", F.lit(None).cast("long"))
        if found is not None:  # k results give a bound; fewer give none
            seed = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
            bound = asked.join(seed, "query_id", "left").withColumn("floor", F.when(F.col("n") >= k, F.col("least")))
        dealt = bound.select("query_id", "q", "floor", "block").repartition(common.parallel(rows.sparkSession))
        todo = common.staged(common.mapped(dealt, visits(lo, hi), schema))
        if found is not None and todo.isEmpty():
            break
        new = searched(todo, asked, pages, width, k)
        found = common.staged(top(new if found is None else found.select("query_id", "vec_id", "score").unionByName(new), k))
        if hi >= len(tree.leaf):
            break
        lo, hi = hi, hi + (hi - lo) * GROWTH
    return found.select("query_id", "rank", "vec_id", "score")


def op8_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest scores of every vector whose id is divisible by 50, against all other vectors."""
    rows = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector_topk(rows, rows.where("vec_id % 50 = 0"))


ORACLE_SQL = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
