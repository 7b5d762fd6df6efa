"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal updates.

A text is a stream of tokens: runs of letters, digits and other signs of languages, and runs of punctuation.
Features are hashed one- and two-token n-grams of the lower-cased tokens, and of the tokens' shapes (lower
case, capital, upper case, digits, the punctuation itself), and a token that repeats the one before it or before a sign. A feature's value is log(1 + its count), and each
text's vector has length 1. A score is the sparse dot product with the weights, through the logistic function.

Training takes about `most` labelled rows, chosen by a hash of the id (a documented bound; scoring covers every
whole text). Its rows are dealt to a fixed number of shards; each shard runs FTRL over its rows from the shared
state, and the states are averaged after each round. Weights have a fixed size and are broadcast.

Rows with null text or null label are not learned from; an id with several labels has the largest. Null and empty texts
get the score of the bias alone. Without any label the score is 0.5. Very long texts are read in pieces that end with
white space, over which n-grams don't reach. Rows are scored one by one, so repeated ids stay; other columns are not read,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

BITS = 18
#: Labelled rows that training takes, about, and the shards and rounds it runs.
MOST, SHARDS, ROUNDS = 9000, 6, 4
#: FTRL-proximal: learning rate, its smoothing, and the L1 and L2 penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.005, 0.01

#: Kinds of bytes: 0 white space and controls, 1 word, 2 punctuation.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 2
_KIND[128:] = 1
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _KIND[_lo:_hi] = 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all texts: the row, the bucket and the value of each feature, by row."""
    rows = len(offsets) - 1
    if rows == 1 and len(data) > common.STEP_BYTES:  # a long text: piece by piece
        every = np.zeros(1 << BITS, np.int64)
        for a, b in common.pieces(data, _KIND == 0):
            key, count = counted(data[a:b], np.array([0, b - a]))
            every[key] += count
        key = np.flatnonzero(every)
        count = every[key]
    else:
        key, count = counted(data, offsets)
    owner, bucket, value = key >> BITS, key & ((1 << BITS) - 1), np.log1p(count)
    length = np.sqrt(np.bincount(owner, value * value, rows))
    return owner, bucket, value / length[owner]


def counted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features that occur (row << BITS | bucket), in order, and how often."""
    start, end = common.runs(data, offsets, _KIND)
    row = np.searchsorted(offsets, start, "right") - 1
    word = common.mix(common.span_hash(common.prefix_hash(common.LOWER[data]), start, end))
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    lower = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122) | (data >= 128))])
    first = (data[start] >= 65) & (data[start] <= 90)
    n_up, n_low = upper[end] - upper[start], lower[end] - lower[start]
    shape = np.where(n_up + n_low == 0, 1, np.where(n_low == 0, 2, np.where(first, 3, 4))).astype(np.uint64)
    shape = np.where(_KIND[data[start]] == 2, word, shape)
    with np.errstate(over="ignore"):
        two = row[1:] == row[:-1]
        again = two & (word[1:] == word[:-1])
        later = (row[2:] == row[:-2]) & (word[2:] == word[:-2]) & (_KIND[data[start[2:]]] == 1)
        parts = [word, word[:-1][two] * np.uint64(3) + word[1:][two], shape + np.uint64(77), shape[:-1][two] * np.uint64(5) + shape[1:][two] + np.uint64(99), np.full(again.sum(), 55, np.uint64), np.full(later.sum(), 55, np.uint64)]
    owner = np.concatenate([row, row[:-1][two], row, row[:-1][two], row[:-1][again], row[:-2][later]])
    bucket = (common.mix(np.concatenate(parts)) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.unique(owner << BITS | bucket, return_counts=True)


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl(examples: list[tuple[int, np.ndarray, np.ndarray]], z: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass over (label, buckets, values); the last bucket of z and n is the bias."""
    z, n, bias = z.copy(), n.copy(), len(z) - 1
    for label, buckets, values in examples:
        at, x = np.append(buckets, bias), np.append(values, 1.0)
        w = weights(z[at], n[at])
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
        z[at] += g - sigma * w
        n[at] += g * g
    return z, n


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as 32-bit numbers, compressed: most buckets of a state are 0."""
    return pa.compress(np.concatenate(arrays).astype("<f4").tobytes(), "zstd", asbytes=True)


def unpack(packed: bytes, count: int) -> np.ndarray:
    size = count * ((1 << BITS) + 1)
    return np.frombuffer(pa.decompress(packed, 4 * size, "zstd", asbytes=True), "<f4").astype(float).reshape(count, -1)


def fit(labelled: DataFrame, text: str = "text", label: str = "quality", doc_id: str = "doc_id", most: int = MOST, shards: int = SHARDS, rounds: int = ROUNDS) -> np.ndarray:
    """Weights by bucket; the last one is the bias. labelled: one row for each labelled text."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col(doc_id).cast("string").alias("id"), F.col(label).cast("int").alias("label"), F.col(text).alias("text")).where("text is not null and label is not null and id is not null")
    size = rows.count()
    z = n = np.zeros((1 << BITS) + 1)
    if not size:
        return z
    spread = F.crc32(F.concat(F.lit("fit"), F.col("id")))
    sample = rows.where(spread / F.lit(2.0**32) * size < most)

    def extract(batches):
        for batch in batches:
            data, offsets = common.utf8(batch.column(2))
            for lo, hi in common.steps(offsets):
                owner, bucket, value = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                ends = np.searchsorted(owner, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(value.astype(np.float32))),
                ], names=["id", "label", "buckets", "values"])

    schema = "id string, label int, buckets array<int>, `values` array<float>"
    kept = common.staged(common.mapped(sample, extract, schema).withColumn("shard", F.crc32(F.concat(F.lit("deal"), F.col("id"))) % shards))
    for turn in range(rounds):
        state = spark.sparkContext.broadcast(pack(z, n))

        def learn(pdf):
            import pandas as pd

            order = pdf.assign(h=pd.util.hash_array(pdf["id"].to_numpy(object)) ^ np.uint64(turn * 0x9E3779B9)).sort_values(["h", "id"])
            got = ftrl([(a, np.asarray(b, np.int64), np.asarray(v, float)) for a, b, v in zip(order["label"], order["buckets"], order["values"])], *unpack(state.value, 2))
            return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "size": [len(pdf)], "state": [pack(*got)]})

        found = sorted(kept.groupBy("shard").applyInPandas(learn, "shard long, size long, state binary").collect())
        state.destroy()
        total = sum(r["size"] for r in found)
        z, n = sum(r["size"] / total * unpack(r["state"], 2) for r in found)
    return weights(z, n)


def score(docs: DataFrame, w: np.ndarray, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` with score, the probability of label 1."""
    names = list(keep)
    shared = docs.sparkSession.sparkContext.broadcast(w)
    out, arrow = common.schema_of(docs, names, "score double")

    def run(batches):
        w = shared.value
        for batch in batches:
            data, offsets = common.utf8(batch.column(len(names)))
            for lo, hi in common.steps(offsets):
                owner, bucket, value = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                dot = np.bincount(owner, w[bucket] * value, hi - lo) + w[-1]
                yield common.columns(batch, lo, hi, names, {"score": 1 / (1 + np.exp(-np.clip(dot, -35, 35)))}, arrow)

    return common.mapped(docs.select(*names, F.col(text)), run, out)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from the labels of rows that are not held out."""
    docs, labels = (common.table(spark, sf_dir, x) for x in ("documents", "labels"))
    known = labels.where(~common.held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    w = fit(docs.select("doc_id", "text").join(known, "doc_id"))
    scored = score(docs, w)
    return scored.select("doc_id", common.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
