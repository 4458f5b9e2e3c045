"""The corpus pipeline: five operators in a row, each on all its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)``. All but the last return the columns
of ``docs`` for the rows they keep; the last encodes them. What a stage decides
takes effect in the next one: rejected, copied and leaked documents are gone, and
texts have lost their repeated lines.

Documents are told apart by ``doc_id``. Rows that share an id are judged each,
and stay or go together where a stage decides by id. Nulls and empty texts have
the results that the operators state; a document that loses all its lines stays
as an empty text. An empty table gives no rows.

All stages share the executors' Python workers, so the session is set to keep them
small (``lean``), and the stages drop what others have left in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import decontaminate, jaccard, lines, quality
from tallyhouse.llm.queries import encoded_digests
from tallyhouse.llm.tables import lean, staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy."""
    lean(spark)
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that other documents keep."""
    return lines.rewrite(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the least id."""
    lean(spark)
    return jaccard.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item has leaked."""
    lean(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their decoded text, as counts and digests."""
    lean(spark)
    return encoded_digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", bpe_codec),
]

#: The latent search and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
