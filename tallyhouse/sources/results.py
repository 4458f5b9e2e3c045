"""Result formats: tab-separated (default), CSV, one JSON array, JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions.columns import quoted
from tallyhouse.sources.store import staged

FORMATS = ("tsv", "json", "csv", "ndjson")


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text: delimited files hold scalars only."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(
        [
            F.to_json(quoted(f.name)).alias(f.name)
            if isinstance(f.dataType, nested)
            else quoted(f.name)
            for f in df.schema.fields
        ]
    )


def json_line(df: DataFrame) -> Column:
    """A row as one JSON object; NULL values are written out."""
    return F.to_json(
        F.struct(*[quoted(c) for c in df.columns]), {"ignoreNullFields": "false"}
    )


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(json_line(df).alias("line"))


def write_result(df: DataFrame, path: str, format: str = "tsv") -> None:
    """Write a query result.

    Every format is written by all tasks in parallel, and part files keep the
    order of a sorted result. ``json`` writes parts whose concatenation by name
    is one array: lines carry their separator, the brackets are parts of their own.
    """
    if format not in FORMATS:
        raise ValueError(f"unknown format {format!r}, expected one of {FORMATS}")
    if format == "tsv":
        _flat(df).write.option("sep", "\t").option("header", "true").option(
            "emptyValue", ""
        ).csv(path)
    elif format == "csv":
        _flat(df).write.option("header", "true").csv(path)
    elif format == "ndjson":
        json_lines(df).write.text(path)
    else:
        _write_json_array(df, path)


def _write_json_array(df: DataFrame, path: str) -> None:
    spark = df.sparkSession
    bracket = spark.range(1, numPartitions=1)
    # Written once: a second run of the query could number or return other rows.
    rows = staged(
        df.select(F.monotonically_increasing_id().alias("n"), json_line(df).alias("line"))
    )
    # Only the number of the first row reaches the driver: it takes no separator.
    first = rows.agg(F.min("n").alias("n")).first().n
    separator = F.when(F.col("n") == F.lit(first), "").otherwise(",")
    bracket.select(F.lit("[").alias("line")).write.text(f"{path}/0_open")
    ordered = rows.repartitionByRange("n").sortWithinPartitions("n")
    ordered.select(F.concat(separator, "line").alias("line")).write.text(f"{path}/1_rows")
    bracket.select(F.lit("]").alias("line")).write.text(f"{path}/2_close")
