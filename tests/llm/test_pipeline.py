"""The pipeline against its stages by brute force."""

import corpus_pipeline
from tallyhouse.llm import queries
from tests.llm.test_groups import groups

SF = "/root/testdata/sf0.001"
COLUMNS = {"doc_id", "text", "lang", "source", "n_chars"}


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frames.append(corpus_pipeline.staged(stage(spark, frames[-1], SF)))
        assert set(frames[-1].columns) == COLUMNS
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in frames]
    judged = {r.doc_id: r.kept for r in queries.op1_quality_rules(spark, SF).collect()}
    assert ids[1] == {i for i, kept in judged.items() if kept}
    assert ids[2] == ids[1]
    rows = frames[2].orderBy("doc_id").collect()
    least = groups([r.text for r in rows])
    assert ids[3] == {rows[i].doc_id for i in {c for _, c in least.values()}}
    bench = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {
        r.doc_id for r in frames[3].collect()
        if any(f" {b} " in f" {' '.join(r.text.lower().split())} " for b in bench)
    }
    assert not leaked & ids[4]
    assert len(ids[3] - ids[4] - leaked) <= 2
    last = corpus_pipeline.STAGES[-1][1](spark, frames[4], SF)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))


def test_nulls_repeats_and_no_rows(spark):
    docs = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", None, None, 0), (1, "a", "en", "s", 1)],
        spark.read.parquet(f"{SF}/documents.parquet").schema,
    )
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            df_out = stage(spark, df, SF)
            assert df_out.count() <= 3
