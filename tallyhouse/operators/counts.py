"""Counts and listings of types, accounts and regions.

All are aggregations with map-side partials: what is shuffled is one row per
group and task, however large a group is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.schemas import CAPTURE_TIME
from tallyhouse.sources.items import changed_since


def type_counts(spine: DataFrame) -> DataFrame:
    return spine.groupBy("resourceType").agg(F.count("*").alias("n"))


def modified_counts(spine: DataFrame, cutoff, time: str = CAPTURE_TIME) -> DataFrame:
    """Rows per type captured after the cutoff."""
    return type_counts(changed_since(spine, cutoff, time))


def total(counts: DataFrame) -> DataFrame:
    """Sum over a count table."""
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def unselectable_types(all_types: DataFrame, selectable: DataFrame) -> DataFrame:
    """Types that are counted but cannot be selected in bulk."""
    return all_types.select("resourceType").subtract(selectable.select("resourceType"))


def distinct_regions(spine: DataFrame) -> DataFrame:
    return spine.select("awsRegion").distinct()


def resource_types(spine: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """Distinct types of the spine and of the custom tables."""
    types = spine.select("resourceType").distinct()
    if custom is None:
        return types
    return types.union(custom.select("resourceType")).distinct()
