"""Configuration items and key listings from JSON lines, and their clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions.jsontext import json_value
from tallyhouse.schemas import CAPTURE_TIME, IDENTIFIERS, SPINE, STAGING, TAG_ENTRIES

#: What an item looks like when its tags still need checking.
_RAW_TAGS = T.StructType(
    [
        T.StructField("tags", T.StringType()) if f.name == "tags" else f
        for f in STAGING.fields
    ]
)


def read_items(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Spine rows from JSON lines whose tags are ``{key, value}`` entries.

    The schema is given, so nothing is inferred and an empty file simply has no
    rows. A value that does not convert fails the load.
    """
    staged = spark.read.schema(STAGING).option("mode", "FAILFAST").json(path)
    return staged_to_spine(staged)


def read_raw_items(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """As :func:`read_items`, for listings whose ``tags`` may be something other
    than an array (some record types deliver ``{}``)."""
    raw = spark.read.schema(_RAW_TAGS).option("mode", "FAILFAST").json(path)
    return staged_to_spine(raw.withColumn("tags", sanitized_tags(F.col("tags"))))


def read_identifiers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Key listing from JSON lines."""
    return spark.read.schema(IDENTIFIERS).option("mode", "FAILFAST").json(path)


def sanitized_tags(tags_json: Column) -> Column:
    """Tag entries from JSON text: anything present but not an array is ``[]``."""
    entries = F.when(
        F.ltrim(tags_json).startswith("["), F.from_json(tags_json, TAG_ENTRIES)
    ).otherwise(F.array().cast(TAG_ENTRIES))
    return F.when(tags_json.isNotNull(), entries)


def tags_map(entries: Column) -> Column:
    """``{key, value}`` entries as a map. A repeated key is an error."""
    return F.map_from_entries(entries)


def staged_to_spine(staged: DataFrame) -> DataFrame:
    """Staged rows with tags turned into a map, in spine column order."""
    return staged.withColumn("tags", tags_map(F.col("tags"))).select(SPINE.names)


def normalized_item(
    configuration: Column, supplementary: Column
) -> tuple[Column, Column]:
    """``(configuration, supplementaryConfiguration)`` JSON text of a fetched item.

    ``configuration`` arrives as a string and ``supplementary`` as a map of
    strings, each of which may or may not hold JSON. Text that is no JSON is kept
    as a JSON string; a missing map becomes an empty object.
    """
    values = F.transform_values(
        supplementary, lambda _, v: F.try_parse_json(json_value(v))
    )
    return (
        json_value(configuration),
        F.coalesce(F.to_json(values), F.lit("{}")),
    )


def normalized_items(items: DataFrame) -> DataFrame:
    """Items of the per-resource fetch as spine rows.

    That fetch returns no tags and no relationships, so both are empty.
    """
    configuration, supplementary = normalized_item(
        F.col("configuration"), F.col("supplementaryConfiguration")
    )
    fixed = {
        "configuration": configuration,
        "supplementaryConfiguration": supplementary,
        "tags": F.create_map().cast(SPINE["tags"].dataType),
        "relationships": F.array().cast(SPINE["relationships"].dataType),
    }
    present = {c.lower() for c in items.columns}
    columns = []
    for field in SPINE.fields:
        if field.name in fixed:
            value = fixed[field.name]
        elif field.name.lower() in present:
            value = F.col(field.name).cast(field.dataType)
        else:
            value = F.lit(None).cast(field.dataType)
        columns.append(value.alias(field.name))
    return items.select(columns)


def changed_since(items: DataFrame, cutoff, time: str = CAPTURE_TIME) -> DataFrame:
    """Items captured strictly after ``cutoff``; all items when it is None.

    With a cutoff, items that carry no capture time are left out. The comparison
    is a plain column-to-literal one, so it reaches the file scan.
    """
    if cutoff is None:
        return items
    limit = cutoff if isinstance(cutoff, Column) else F.lit(cutoff)
    return items.filter(F.col(time) > limit)


def spread(scanned: DataFrame) -> DataFrame:
    """Rows of a scan over all cores, where the files give fewer splits than that.

    A compressed file, or one with a single row group, is one task however much
    work its rows need. With at least one split per core nothing is moved.
    """
    cores = scanned.sparkSession.sparkContext.defaultParallelism
    splits = scanned.rdd.getNumPartitions()
    return scanned if splits >= cores else scanned.repartition(cores)
