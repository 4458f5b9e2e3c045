"""What operators keep in the Python workers that they share."""

import tracemalloc

import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tallyhouse.llm import bpe, codec, jaccard, tables

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_an_operator_drops_what_others_hold():
    codec.digester(PATH)
    assert bpe.load.cache_info().currsize
    assert list(tables.alone(lambda batches: batches)(iter("ab"))) == ["a", "b"]
    assert not codec.digester.cache_info().currsize
    assert not bpe.load.cache_info().currsize


def test_a_remembered_word_is_small():
    digester = codec.Digester(PATH)
    text = " ".join("".join(chr(97 + i // 26**k % 26) for k in range(5)) for i in range(40_000))
    digester.digest(text)
    known, digester.known = digester.known, {}
    digester.word("a")
    assert len(known) == 40_000
    tracemalloc.start()
    again = digester.digest(text)
    taken = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert again == digester.digest(text)
    assert taken < 160 * len(known)


def test_a_chunk_of_shingles_is_held_once(spark, monkeypatch):
    class Frame:
        sparkSession = spark

        def mapInArrow(self, run, schema):
            return run

    class Context:
        get = classmethod(lambda cls: cls)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(jaccard, "TaskContext", Context)
    run = jaccard.route(Frame(), "bigint", 16, 5)
    texts = [" ".join(map(str, range(i, i + 1000))) for i in range(0, 1_100_000, 1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc", "text"])
    list(run(iter([batch.slice(0, 10)])))
    tracemalloc.start()
    docs = sum(len(r["ids"] or []) for b in run(iter([batch])) for r in b.select(["ids"]).to_pylist())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert docs == len(texts)
    assert most < 48 * jaccard.CHUNK


def test_rows_come_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(3000).coalesce(1).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    try:
        corpus_pipeline.quality_rules(spark, docs.withColumnRenamed("id", "doc_id"), "")
        found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
    finally:
        spark.conf.unset(key)
    assert sum(found) > 30_000_000
    assert max(found) < tables.BATCH + 100_000
