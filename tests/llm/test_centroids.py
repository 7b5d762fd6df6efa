"""Centroid clustering over subvector dictionaries, against plain rounds in whole numbers."""

import hashlib
import random

import numpy as np
import pytest

from millrace.llm import centroids


def plain(rows, k, rounds, dims, scale):
    """(vec_id, cluster, distance) of each row, and the centroids."""
    good = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in good if i is not None)
    cs = [v for _, v in first[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = [[v for _, v in good if nearest(v)[1] == j] for j in range(len(cs))]
        cs = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(own, cs)]
    return sorted(((i, (n := nearest(v))[1], min(n[0], 2**63 - 1)) for i, v in good), key=str), cs


@pytest.mark.parametrize("seed,page", [(1, 8192), (2, 7)])
def test_rounds_are_the_plain_ones(spark, monkeypatch, seed, page):
    rng = random.Random(seed)
    monkeypatch.setattr(centroids, "PAGE", page)
    rows = [(i, [rng.choice([-0.5, 0.1, 0.3, rng.random()]) for _ in range(4)]) for i in range(60)]
    rows += [(7, [1.0, 2.0, 3.0, 4.0]), (None, [0.1] * 4), (100, None), (101, [0.1] * 3), (102, [0.1, None, 0.1, 0.1]), (103, [float("nan")] * 4), (104, [float("inf")] * 4)]
    rows += [(200 + i, [0.25, -0.25, 0.5, 0.5]) for i in range(40)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, cluster string")
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    got, last = centroids.centroid_clustering(frame, k=5, rounds=4, dims=4)
    want, cs = plain(rows, 5, 4, 4, 1024)
    assert sorted(map(tuple, got.collect()), key=str) == want and last.tolist() == cs


def test_few_and_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    got, cs = centroids.centroid_clustering(none, dims=2)
    assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance"] and len(cs) == 0
    two = spark.createDataFrame([(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [5.0, 1.0])], "vec_id long, embedding array<double>")
    got, cs = centroids.centroid_clustering(two, dims=2)
    assert sorted(map(tuple, got.collect())) == plain([(1, [0.0, 1.0])] * 2 + [(2, [5.0, 1.0])], 8, 10, 2, 1024)[0] and len(cs) == 3


def test_numbers_beyond_64_bits(spark):
    rows = [(i, [x, y]) for i, (x, y) in enumerate([(1e15, 0.0), (1e15, 1.0), (-1e15, 3.0), (0.5, 0.25), (9e30, 0.0), (-1e12, -7.0)])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, _ = centroids.centroid_clustering(frame, k=2, rounds=3, dims=2)
    want, _ = plain([(i, [min(x, 2.0**53) for x in v]) for i, v in rows], 2, 3, 2, 1024)
    assert [r[:2] for r in sorted(map(tuple, got.collect()))] == [r[:2] for r in want]


def test_blocks_are_lossless_and_share_what_repeats():
    rng = np.random.default_rng(1)
    v = rng.integers(-50, 50, (500, 64))
    v[100:450] = v[0]
    blocks = centroids.encode(v)
    assert len(blocks) == 1 and len(blocks[0][1]) == 150
    v = rng.integers(-50, 50, (500, 64))
    blocks = centroids.encode(v)
    assert all(d.shape[1] == 1 and len(d) <= 100 for _, d, _ in blocks) and [lo for lo, _, _ in blocks] == list(range(64))
    assert (np.concatenate([d[c] for _, d, c in blocks], 1) == v).all()
