import pytest

from millrace.llm import common

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = common.table(spark, SF, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.staged(stage(spark, docs, SF))
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert sorted(out.doc_id) == sorted(r[0] for r in docs.select("doc_id").collect())
    assert (out.n_tokens == out.ids.map(len)).all()


def test_run_on_rows_with_nulls(spark, tmp_path):
    docs = common.table(spark, SF, "documents").limit(30)
    odd = spark.createDataFrame([(None, None, None, None, None), (10_001, "", None, "s", 0), (10_002, "123 !!", "en", None, 6)], docs.schema)
    docs.union(odd).write.parquet(str(tmp_path / "documents.parquet"))
    common.table(spark, SF, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert 0 < out.count() <= 30


def test_a_stage_deletes_what_the_last_ones_staged(spark, tmp_path):
    import os

    there = lambda: {f for f in common._own.folders if os.path.exists(f.removeprefix("file:"))}
    docs = common.table(spark, SF, "documents")
    steps = [f for name, f in corpus_pipeline.STAGES if name in ("line dedup", "benchmark decontamination")]
    steps[0](spark, docs, SF).write.parquet(str(tmp_path / "out"))
    staged = there()
    steps[1](spark, spark.read.parquet(str(tmp_path / "out")), SF).count()
    assert staged and not any(os.path.exists(f.removeprefix("file:")) for f in staged)
    again = steps[0](spark, docs, SF)  # not written: what it reads stays
    n = again.count()
    assert steps[1](spark, again, SF).count() <= n == again.count()


def test_decontamination_stages_no_text_and_deletes_its_index(spark, monkeypatch):
    import os

    made, plain = [], common.staged

    def staged(df):
        made.append(plain(df))
        return made[-1]

    monkeypatch.setattr(common, "staged", staged)
    docs = common.table(spark, SF, "documents")
    stage = dict(corpus_pipeline.STAGES)["benchmark decontamination"]
    kept = stage(spark, docs, SF)
    assert not any("text" in x.schema.simpleString() for x in made)
    there = [f for f in common._own.folders if os.path.exists(f.removeprefix("file:"))]
    assert len(made) == 2 and len(there) == 1 and made[1].columns == ["digest"] and made[1].count()
    assert 0 < kept.count() < docs.count()

