"""A data source of its own: Arrow files that a manifest lists with their statistics, read and written in parallel.

Format "listed", option path: a folder that the driver and all executors reach, local or in a store that pyarrow knows.
Each task writes files of up to `ROWS` rows under names that no other attempt uses, and reports them; the commit puts
them into the manifest at once, so files of lost or repeated tasks never count. A file's entry has its rows and, for
each column, the number of nulls and the least and greatest value. A read plans one partition for each file that the
filters leave possible; Spark still applies the filters to the rows. As a stream, offsets count the manifest's files.
"""

from __future__ import annotations

import datetime as dt
import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

#: Spark plans a stream's source in a Python process of its own, which gets no packages; so this module goes by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a file, and characters up to which texts have statistics.
ROWS, LONGEST = 1 << 18, 256
MANIFEST = "_manifest.json"


def place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def manifest(path: str) -> dict:
    fs, folder = place(path)
    if fs.get_file_info(f"{folder}/{MANIFEST}").type == pafs.FileType.NotFound:
        return {"schema": None, "files": []}
    with fs.open_input_stream(f"{folder}/{MANIFEST}") as f:
        return json.loads(f.read())


def plain(value):
    """A value as JSON has it, by which values of one type compare as Spark compares them; None: not comparable."""
    if isinstance(value, dt.datetime):
        zone = value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)
        return (zone - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)
    if isinstance(value, dt.date):
        return value.toordinal()
    if isinstance(value, str):
        return value if len(value) <= LONGEST else None
    return value if isinstance(value, (bool, int, float)) and value == value else None


def statistics(table: pa.Table) -> dict:
    """By column: nulls, least, greatest. NaN is greater than all numbers, so a column that holds it has no greatest value."""
    out = {}
    for name, column in zip(table.column_names, table.columns):
        own = {"nulls": column.null_count, "least": None, "greatest": None}
        if not pa.types.is_nested(column.type) and not pa.types.is_binary(column.type) and column.null_count < len(column):
            odd = pa.types.is_floating(column.type) and pc.any(pc.is_nan(column)).as_py()
            if not odd:
                found = pc.min_max(column).as_py()
                own |= {"least": plain(found["min"]), "greatest": plain(found["max"])}
        out[name] = own
    return out


@dataclass
class File(ds.InputPartition):
    name: str


@dataclass
class Written(ds.WriterCommitMessage):
    files: list


def possible(entry: dict, f: ds.Filter) -> bool:
    """Whether a file may hold a row that passes the filter, by its statistics."""
    own = entry["columns"].get(".".join(f.attribute)) if hasattr(f, "attribute") else None
    if own is None:
        return True
    if isinstance(f, ds.IsNull):
        return own["nulls"] > 0
    if own["nulls"] == entry["rows"]:
        return False  # nothing but null passes no other comparison
    least, greatest = own["least"], own["greatest"]
    values = f.value if isinstance(f, ds.In) else [getattr(f, "value", None)]
    values = [plain(v) for v in values]
    if least is None or greatest is None or any(v is None for v in values):
        return True
    if isinstance(f, (ds.EqualTo, ds.In)):
        return any(least <= v <= greatest for v in values)
    if isinstance(f, ds.GreaterThan):
        return greatest > values[0]
    if isinstance(f, ds.GreaterThanOrEqual):
        return greatest >= values[0]
    if isinstance(f, ds.LessThan):
        return least < values[0]
    if isinstance(f, ds.LessThanOrEqual):
        return least <= values[0]
    if isinstance(f, ds.StringStartsWith):
        return least[: len(f.value)] <= f.value <= greatest[: len(f.value)]
    return True


USED = (ds.EqualTo, ds.In, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual, ds.StringStartsWith, ds.IsNull, ds.IsNotNull)


def batches(path: str, name: str) -> Iterator[pa.RecordBatch]:
    fs, folder = place(path)
    with fs.open_input_file(f"{folder}/{name}") as f:
        reader = pa.ipc.open_file(f)
        for i in range(reader.num_record_batches):
            yield reader.get_batch(i)


class Reader(ds.DataSourceReader):
    def __init__(self, path: str):
        self.path, self.filters = path, []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        """Files are left out by the filters; their rows are for Spark to filter."""
        self.filters = [f for f in filters if isinstance(f, USED)]
        yield from filters

    def partitions(self) -> list[File]:
        return [File(e["name"]) for e in manifest(self.path)["files"] if all(possible(e, f) for f in self.filters)] or [File("")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        return batches(self.path, partition.name) if partition.name else iter(())


class StreamReader(ds.DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(manifest(self.path)["files"])}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return [File(e["name"]) for e in manifest(self.path)["files"][start["files"] : end["files"]]]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        return batches(self.path, partition.name)


class Writer(ds.DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = place(self.path)
        fs.create_dir(folder, recursive=True)
        files, held, n = [], [], 0

        def close() -> None:
            table = pa.Table.from_batches(held)
            name = f"{uuid.uuid4().hex}.arrow"
            with fs.open_output_stream(f"{folder}/{name}") as out, pa.ipc.new_file(out, table.schema) as f:
                f.write_table(table, max_chunksize=1 << 14)
            files.append({"name": name, "rows": len(table), "columns": statistics(table)})

        for batch in iterator:
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS:
                close()
                held, n = [], 0
        if n:
            close()
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, folder = place(self.path)
        fs.create_dir(folder, recursive=True)
        before = manifest(self.path)
        old = [] if self.overwrite else before["files"]
        if old and before["schema"] != self.schema.jsonValue():
            raise ValueError("rows to be appended must have the schema of those that are there")
        new = {"schema": self.schema.jsonValue(), "files": [*old, *(f for m in messages if m for f in m.files)]}
        name = f"{folder}/{uuid.uuid4().hex}.json"
        with fs.open_output_stream(name) as f:
            f.write(json.dumps(new).encode())
        fs.move(name, f"{folder}/{MANIFEST}")

    def abort(self, messages: list) -> None:
        fs, folder = place(self.path)
        for m in messages:
            for f in m.files if m else ():
                fs.delete_file(f"{folder}/{f['name']}")


class Listed(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "listed"

    def schema(self) -> T.StructType:
        found = manifest(self.options["path"])["schema"]
        if found is None:
            raise ValueError(f"no table at {self.options['path']}")
        return T.StructType.fromJson(found)

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"])

    def streamReader(self, schema: T.StructType) -> StreamReader:
        return StreamReader(self.options["path"])

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known; filters reach its reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Listed)
