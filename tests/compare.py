"""Rows of a Spark query beside those of its SQL in DuckDB."""

import glob
import os

import duckdb
import numpy as np


def database(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def text(v):
    if isinstance(v, np.generic):
        v = v.item()
    if v is None or str(v) in ("<NA>", "NaT", "nan"):
        return "null"
    if isinstance(v, float):
        return repr(round(v, 6))
    return str(v)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(map(text, r)) for r in frame[names].astype(object).values.tolist())


def same(query, sql, spark, sf_dir, con):
    names, got = rows(query(spark, sf_dir).toPandas())
    wanted_names, wanted = rows(con.sql(sql).df())
    number = lambda r: tuple(x[:-2] if x.endswith(".0") else x for x in r)  # noqa: E731  nullable integers come as floats
    assert names == wanted_names
    assert sorted(map(number, got)) == sorted(map(number, wanted))
