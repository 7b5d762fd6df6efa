"""Centroid clustering over subvector dictionaries: Lloyd's rounds in whole numbers, exact.

Vectors become integers, floor(scale * x), and are encoded once, without loss, in pages of up to `PAGE` vectors. A page
holds its vectors as blocks of dimensions: each block has a dictionary of its distinct subvectors and a code for each
vector. A block begins with all dimensions and is halved until its distinct subvectors are no more than half of the
page's vectors, or it is one dimension wide; so repeated vectors cost one entry, and others share numbers. Each page
keeps its own dictionaries, for the distinct subvectors of all vectors have no bound.

A round computes for each dictionary entry its squared distances to that block of all centroids, once, and a vector's
distances are sums of these by its codes. Sums for the next centroids come from how often each entry's code went to each
centroid. Pages are read where they lie, nothing but `k` rows of sums and counts comes from each round, and these are
added up by an aggregate in Spark; the driver holds k centroids.

Vectors of another length than `dims`, null ones and those with null or non-finite components take no part. Components
are held within 64 bits; sums and distances are exact, and a distance or inertia beyond 64 bits comes as the greatest
number of that size. A row with a null id takes part, but is no first centroid. Repeated rows count each; first
centroids of one id are taken by vector, least first. With fewer than k vectors there are so many centroids. An empty
table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

#: Vectors of a page.
PAGE = 8192
#: Components that are smaller than this have exact distances and sums of a page in 64 bits.
SMALL = 1 << 24
#: The greatest number of 64 bits.
MOST = (1 << 63) - 1

Block = tuple[int, np.ndarray, np.ndarray]  # first dimension, dictionary, codes


def integers(rows: DataFrame, vec_id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, v array<bigint>) of the rows that take part."""
    x = F.transform(vector, lambda c: c.cast("double"))
    sound = (F.size(vector) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.where(F.col(vector).isNotNull() & sound).select(F.col(vec_id).alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def encode(v: np.ndarray) -> list[Block]:
    """The blocks of a page of vectors."""
    out, todo = [], [(0, v.shape[1])]
    while todo:
        lo, hi = todo.pop()
        part = np.ascontiguousarray(v[:, lo:hi])
        distinct, codes = np.unique(part[:, 0] if hi - lo == 1 else part.view(f"V{part.itemsize * (hi - lo)}")[:, 0], return_inverse=True)
        if hi - lo > 1 and 2 * len(distinct) > len(v):
            todo += [((lo + hi) // 2, hi), (lo, (lo + hi) // 2)]
        else:
            out.append((lo, distinct.view(np.int64).reshape(-1, hi - lo), codes.ravel().astype(np.int32)))
    return out


def partial_distances(blocks: list[Block], centroids: np.ndarray) -> np.ndarray:
    """Squared distances of a page's vectors to all centroids: of each dictionary entry once, added up by code."""
    total = 0
    for lo, distinct, codes in blocks:
        apart = distinct[:, None, :] - centroids[None, :, lo : lo + distinct.shape[1]]
        total = total + (apart * apart).sum(2)[codes]
    return total


def sums(blocks: list[Block], nearest: np.ndarray, k: int) -> np.ndarray:
    """The sums of a page's vectors by centroid: dictionary entries times how often their code goes to each."""
    parts = []
    for _, distinct, codes in blocks:
        times = np.bincount(codes * k + nearest, minlength=len(distinct) * k).reshape(-1, k)
        parts.append(times.astype(distinct.dtype).T @ distinct)
    return np.concatenate(parts, 1)


def exactly(blocks: list[Block], centroids: np.ndarray) -> tuple[list[Block], np.ndarray]:
    """The same numbers, without a bound if they need more than 64 bits in sums or squares."""
    if max([int(np.abs(centroids).max()), *(int(np.abs(d.astype(float)).max()) for _, d, _ in blocks)]) < SMALL:
        return blocks, centroids.astype(np.int64)
    return [(lo, d.astype(object), c) for lo, d, c in blocks], centroids.astype(object)


PAGES = "ids array<bigint>, blocks array<struct<first: int, width: int, entries: array<bigint>, codes: array<int>>>"


def pages(vectors: DataFrame, dims: int, size: int) -> DataFrame:
    """The encoded pages of (vec_id, v), of up to `size` vectors."""

    def page(ids: pa.Array, v: np.ndarray) -> pa.RecordBatch:
        blocks = encode(v)
        found = [{"first": lo, "width": d.shape[1], "entries": d.ravel(), "codes": codes} for lo, d, codes in blocks]
        kind = pa.list_(pa.struct([("first", pa.int32()), ("width", pa.int32()), ("entries", pa.list_(pa.int64())), ("codes", pa.list_(pa.int32()))]))
        return pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([found], kind)], names=["ids", "blocks"])

    def run(batches):
        ids, parts, n = [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                ids.append(part.column(0))
                parts.append(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                n += part.num_rows
                if n >= size:
                    yield page(pa.concat_arrays(ids), np.concatenate(parts))
                    ids, parts, n = [], [], 0
        if n:
            yield page(pa.concat_arrays(ids), np.concatenate(parts))

    return common.mapped(vectors.select(F.col("vec_id").cast("bigint"), "v"), run, PAGES)


def read(batches) -> Iterator[tuple[pa.Array, list[Block]]]:
    """The ids and blocks of each page."""
    for batch in batches:
        for i in range(batch.num_rows):
            blocks = batch.column(1).slice(i, 1).flatten()
            first, width, entries, codes = (blocks.field(f) for f in range(4))
            yield batch.column(0).slice(i, 1).flatten(), [
                (lo, entries.slice(j, 1).flatten().to_numpy().reshape(-1, w), codes.slice(j, 1).flatten().to_numpy()) for j, (lo, w) in enumerate(zip(first.to_pylist(), width.to_pylist()))
            ]


def moved(encoded: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round."""
    k, dims = centroids.shape

    def run(batches):
        for _, blocks in read(batches):
            exact, c = exactly(blocks, centroids)
            nearest = partial_distances(exact, c).argmin(1).astype(np.int64)
            total, n = sums(exact, nearest, k), np.bincount(nearest, minlength=k)
            some = np.flatnonzero(n)
            flat = pa.array([str(x) for x in total[some].ravel()], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, dims).astype(np.int32)), pa.array(np.tile(np.arange(dims), len(some)).astype(np.int32)), pa.array(np.repeat(n[some], dims)), flat], names=["cluster", "at", "n", "total"])

    found = common.mapped(encoded, run, "cluster int, at int, n long, total string")
    # k * dims rows at most, whatever the number of vectors
    out = centroids.astype(object)
    for r in found.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[r["cluster"], r["at"]] = int(r["total"]) // r["n"]
    return out


def centroid_clustering(rows: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3", vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that takes part, and the last centroids.

    The first centroids are the k vectors with the smallest sha256 of '<seed>:<vec_id>'.
    """
    vectors = integers(rows, vec_id, vector, dims, scale)
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.where("vec_id is not null").withColumn("draw", draw).orderBy("draw", "v").limit(k).collect()
    if not first:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), np.zeros((0, dims), object)
    encoded = common.staged(pages(vectors, dims, PAGE))
    centroids = np.array([r["v"] for r in first], object)
    for _ in range(rounds):
        after = moved(encoded, centroids)
        if (after == centroids).all():  # further rounds would find the same
            break
        centroids = after

    def run(batches):
        for ids, blocks in read(batches):
            far = partial_distances(*exactly(blocks, centroids))
            nearest = far.argmin(1)
            distance = np.minimum(far[np.arange(len(far)), nearest], MOST).astype(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(nearest.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return common.mapped(encoded, run, "vec_id long, cluster int, distance long"), centroids


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector of 64 components after 10 rounds with 8 centroids, and the inertia."""
    found, centroids = centroid_clustering(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    found = common.staged(found)
    own = {r["cluster"]: int(r["own"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # one row for each centroid: 8 at most
    rows = [(i, min(n, MOST), min(sum(own.values()), MOST), digests[i]) for i, n in own.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024) -> str:
    """The rounds one after another, each a pair of common table expressions."""
    parts = [f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v AS m FROM v WHERE vec_id IS NOT NULL QUALIFY c < {k})"""]  # fmt: skip
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, v, min({{'d': d, 'c': c}}) AS b FROM (SELECT vec_id, v, rid, c, CAST(list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
        FROM (SELECT *, row_number() OVER () AS rid FROM v), c{i}) GROUP BY rid, vec_id, v)""")
        if i < rounds:
            parts.append(f"""u{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT b.c AS c, unnest(v) AS x, unnest(range({dims})) AS i FROM a{i}) GROUP BY c, i) GROUP BY c),
    c{i + 1} AS MATERIALIZED (SELECT c{i}.c AS c, coalesce(u{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN u{i} ON u{i}.c = c{i}.c)""")
    last = f"a{rounds}"
    return ",\n    ".join(parts) + f"""
    SELECT vec_id, CAST(b.c AS INTEGER) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(m, ',')) AS centroid_sha256 FROM {last} JOIN c{rounds} ON c = b.c"""


ORACLE_SQL = _oracle()
