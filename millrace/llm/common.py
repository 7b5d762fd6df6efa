"""What the text operators share: byte-balanced Arrow batches, vectorised words and hashes, staged tables."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import session

#: Bytes of text that one numpy step works on; a longer text is a step of its own, which is read in pieces of this size.
STEP_BYTES = 1 << 19

#: The most rows and bytes of a batch that goes to Python.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}

#: With it, Spark deletes the shuffle files of an execution when that ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Odd multiplier of the polynomial hash modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)

#: The folders that stages of this thread staged for themselves, and whether one is at work.
_own = threading.local()

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session.table(session.ship(spark), sf_dir, name)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only a local session may lack that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    if getattr(_own, "within", False):
        _own.folders.append(path)
    return path


def tidy(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage of a pipeline whose input, the last stage's output, has been written: it first deletes the folders that earlier
    stages staged for their own work in this thread. What its input still reads, or may read unseen, stays."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        earlier, _own.folders = getattr(_own, "folders", []), []
        files = docs.inputFiles() if earlier else []
        plan = docs._jdf.queryExecution().withCachedData().toString() if earlier else ""
        unseen = not files or "InMemoryRelation" in plan or "LogicalRDD" in plan
        for folder in earlier:
            if unseen or any(folder.rsplit("/", 1)[1] in file for file in files):
                _own.folders.append(folder)
            else:
                delete(spark, folder)
        _own.within = True
        try:
            return stage(spark, docs, sf_dir)
        finally:
            _own.within = False

    return run


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: later reads survive lost executors and repeat no work.

    What was shuffled for it is deleted then and doesn't wait for the driver's garbage collection.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    with settings(spark, {CLEANUP: "true"}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for the time of a block."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def settled(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """What build returns, staged; the folders that build staged on the way are deleted then. They must not be read later."""
    outer, within = getattr(_own, "folders", []), getattr(_own, "within", False)
    _own.folders, _own.within, done = [], True, []
    try:
        out = staged(build())
        done, _own.folders = _own.folders[:-1], _own.folders[-1:]
    finally:
        _own.folders, _own.within = outer + _own.folders if within else outer, within
    for folder in done:
        delete(spark, folder)
    return out


def packed(docs: DataFrame) -> DataFrame:
    """All columns as one struct `_doc`, so that no name can clash; its text is the column `_doc.text`."""
    return docs.select(F.struct("*").alias("_doc"))


def reading(docs: DataFrame, names: list[str], text: str) -> tuple[DataFrame, Callable[[pa.RecordBatch], pa.Array]]:
    """docs with the columns `names` and the text, and what takes the texts from a batch of it.

    A text inside a struct of `names` isn't sent to Python a second time.
    """
    outer, _, inner = text.partition(".")
    if inner and outer in names:
        own, field = names.index(outer), docs.schema[outer].dataType.names.index(inner)
        return docs.select(*names), lambda batch: batch.column(own).field(field)
    return docs.select(*names, F.col(text)), lambda batch: batch.column(len(names))


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow, with this package on the executors, in batches that are bounded by rows and by bytes.

    A worker process lives on for later tasks; after each one it gives back the memory that it no longer uses.
    """
    spark = session.ship(df.sparkSession)
    for key, value in BATCH.items():
        spark.conf.set(key, value)

    def bounded(batches):
        yield from run(batches)
        release()

    return df.mapInArrow(bounded, schema)


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library keeps what it has
        pass


def held_out(doc_id: str = "doc_id"):
    """True for the rows that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def bucketed(df: DataFrame, by: str) -> DataFrame:
    """df written to the shared folder in buckets of a column and read again: joins by it need no shuffle of this side."""
    spark = df.sparkSession
    path, name = shared_dir(spark), f"bucketed_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).sortBy(by).format("parquet").option("path", path).saveAsTable(name)
    return spark.table(name)


class Seen:
    """What a task has met of late: a value that comes again within the last `most` different ones is not new."""

    def __init__(self, most: int = 1 << 16):
        self.most, self.values = most, set()

    def new(self, values: np.ndarray) -> np.ndarray:
        """Whether each value is met for the first time."""
        if len(self.values) > self.most:
            self.values.clear()
        out = np.zeros(len(values), bool)
        out[np.unique(values, return_index=True)[1]] = True
        out &= np.array([v not in self.values for v in values.tolist()], bool)
        self.values.update(values.tolist())
        return out


def parallel(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, STEP_BYTES + 1024)
        with np.errstate(over="ignore"):
            _powers = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (BASE, _INVERSE))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit hashes."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the offsets of the texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `most` bytes; one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = BASE**s times the hash of data[s:e]."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; equal spans have equal hashes wherever they stand. Not mixed."""
    with np.errstate(over="ignore"):
        return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def runs(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes of one kind other than 0; kind: by byte value. Runs end with their text."""
    k = kind[data]
    if not len(k):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(len(k) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(k[1:], k[:-1], out=edge[1:-1])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    real = k[start] != 0
    return start[real], end[real]


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of one kind other than 0, and for each text where its own begin; the last entry is their number.

    fold: what each byte counts as, before its kind is looked up. Data are read in pieces of bounded size; a run that
    reaches over the end of a piece is put together from its parts, so its hash doesn't depend on where pieces end.
    """
    hashes, starts, last, size = [], [], -1, 0  # of the run before: where it ends and how long it is
    for lo in range(0, len(data), STEP_BYTES):
        part = fold[data[lo : lo + STEP_BYTES]]
        own = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, lo + len(part), "right")] - lo
        start, end = runs(part, own, kind)
        h = span_hash(prefix_hash(part), start, end)
        if len(start) and start[0] == 0 and last == lo and not (len(own) and own[0] == 0) and kind[part[0]] == kind[fold[data[lo - 1]]]:
            with np.errstate(over="ignore"):
                hashes[-1][-1] += np.uint64(pow(BASE, size, 1 << 64)) * h[0]
            last, size = lo + int(end[0]), size + int(end[0])
            start, end, h = start[1:], end[1:], h[1:]
        if len(start):
            hashes.append(h)
            starts.append(start + lo)
            last, size = lo + int(end[-1]), int(end[-1] - start[-1])
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return mix(h), np.searchsorted(np.concatenate(starts) if starts else np.zeros(0, np.int64), offsets)


def pieces(data: np.ndarray, gap: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of `most` bytes or less that end after a byte of gap, if there is one in the last half."""
    lo = 0
    while lo < len(data):
        hi = min(lo + most, len(data))
        if hi < len(data):
            at = np.flatnonzero(gap[data[hi - most // 2 : hi]])
            hi = hi - most // 2 + int(at[-1]) + 1 if len(at) else hi
        yield lo, hi
        lo = hi


def columns(batch: pa.RecordBatch, lo: int, hi: int, names: list[str], more: dict[str, np.ndarray | pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    """The given columns of rows lo to hi with further ones."""
    own = [batch.column(n).slice(lo, hi - lo) for n in names]
    new = [x if isinstance(x, pa.Array) else pa.array(x) for x in more.values()]
    return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(own + new, schema)], schema=schema)


def schema_of(df: DataFrame, names: list[str], more: str):
    """The Spark schema of the columns `names` of df and of `more` (DDL), and the same for Arrow."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark_schema = StructType([df.schema[n] for n in names] + StructType.fromDDL(more).fields)
    return spark_schema, to_arrow_schema(spark_schema)


def bitmap(values: DataFrame, column: str, hashed: bool = False) -> np.ndarray:
    """A filter that takes values in by one bit of their hash: for each value its bit is set, for most others not.

    Its size follows the number of values, from 2**16 bits to 2**27 (16 MB). The values are read twice: pass a staged table.
    """
    bits = min(27, max(16, int(values.count()).bit_length() + 4))
    number = F.col(column) if hashed else F.xxhash64(column)
    rows = values.select((number.bitwiseAND((1 << bits) - 1) + 1).alias("v")).select(F.bitmap_bucket_number("v").alias("b"), F.bitmap_bit_position("v").alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)[: len(out)]
    return out


def parted(rows: DataFrame, key: str, bits: Broadcast, within: bool) -> DataFrame:
    """The rows whose key, a column of hashes, the filter takes in, or the others."""
    at = rows.columns.index(key)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(inside(bits.value, batch.column(at).to_numpy()) == within))

    return mapped(rows, run, rows.schema)


def inside(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bits of these hashes are set."""
    at = hashes & (8 * len(bits) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def rank_file(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizers have the file; a path is returned as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
