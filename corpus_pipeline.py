"""A corpus pipeline of text operators: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import byte_bpe, common, decontamination, jaccard_join, language_id, line_dedup

STAGES = [
    ("language ID", common.tidy(language_id.stage)),
    ("line dedup", common.tidy(line_dedup.stage)),
    ("n-gram Jaccard join", common.tidy(jaccard_join.stage)),
    ("benchmark decontamination", common.tidy(decontamination.stage)),
    ("byte-level BPE encoding and decoding", common.tidy(byte_bpe.stage)),
]
#: Learned models and digests have no SQL; tests hold every stage against brute force, plain loops or the library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir))
    return docs
