"""Table functions in Python: they take whole tables, partitioned and ordered, and make their schema from the arguments."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def _text(argument: AnalyzeArgument, name: str) -> str:
    if not isinstance(argument.value, str):
        raise ValueError(f"{name} must be a constant text")
    return argument.value


@F.udtf
class SessionsOf:
    """sessions_of(TABLE(rows) PARTITION BY (key) ORDER BY (time), time, gap, keep): a row for each session of a partition.

    time: the name of the time column; a session ends where the next row is more than `gap` seconds later. keep: names,
    comma-joined, of columns whose first value in the session is returned. Then come begins, ends and n. Rows stream
    through, and what is held is the session that is open; it is returned at the end of the partition. Rows with a null
    time are left out.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, time: AnalyzeArgument, gap: AnalyzeArgument, keep: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument must be a table")
        kinds = {f.name: f.dataType for f in rows.dataType.fields}
        names, when = [n.strip() for n in _text(keep, "keep").split(",") if n.strip()], _text(time, "time")
        for n in [*names, when]:
            if n not in kinds:
                raise ValueError(f"the table has no column {n}")
        if not isinstance(kinds[when], (T.TimestampType, T.TimestampNTZType)):
            raise ValueError(f"{when} must be a timestamp")
        fields = [T.StructField(n, kinds[n]) for n in names]
        return AnalyzeResult(T.StructType([*fields, T.StructField("begins", kinds[when]), T.StructField("ends", kinds[when]), T.StructField("n", T.LongType())]))

    def __init__(self) -> None:
        self.kept: tuple | None = None

    def eval(self, rows: Row, time: str, gap: int, keep: str) -> Iterator[tuple]:
        now = rows[time]
        if now is None:
            return
        if self.kept is not None and (now - self.last).total_seconds() <= gap:
            self.last, self.n = now, self.n + 1
            return
        yield from self.terminate()
        self.kept, self.first, self.last, self.n = tuple(rows[c.strip()] for c in keep.split(",") if c.strip()), now, now, 1

    def terminate(self) -> Iterator[tuple]:
        if self.kept is not None:
            yield (*self.kept, self.first, self.last, self.n)


@F.udtf(returnType="part: string")
class Parts:
    """parts_of(text, sign): a row for each part of a text; none for null."""

    def eval(self, text: str, sign: str) -> Iterator[tuple]:
        if text is not None:
            for part in text.split(sign):
                yield (part,)


def register(spark: SparkSession) -> None:
    """Makes the table functions known to SQL."""
    spark.udtf.register("sessions_of", SessionsOf)
    spark.udtf.register("parts_of", Parts)
