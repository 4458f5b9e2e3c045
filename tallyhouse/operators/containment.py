"""Joins through lists: a row refers to others by a list of their ids.

Written as "list contains id" such a join has no equality to hash on and becomes
a nested loop. Exploding the list gives an equi-join that moves only a row number
and an id; the wide row joins the result once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def list_pairs(rows: DataFrame, key: str, ids: Column, alias: str = "id") -> DataFrame:
    """Distinct ``(key, id)`` pairs of a list column. NULL ids are dropped.

    The list is made distinct within its row, so no shuffle is needed.
    """
    return rows.select(
        key, F.explode(F.array_compact(F.array_distinct(ids))).alias(alias)
    )


def contained_values(
    rows: DataFrame,
    key: str,
    ids: Column,
    lookup: DataFrame,
    lookup_id: str,
    value: str,
    output: str,
) -> DataFrame:
    """``rows`` plus the sorted list of ``value`` of all lookup rows whose id is in
    the row's list; NULL when there is none.

    ``key`` must be unique in ``rows``. Each lookup row counts once per row, also
    when its id is repeated in the list. A NULL value is not listed.
    """
    found = (
        list_pairs(rows, key, ids)
        .join(lookup.select(F.col(lookup_id).alias("id"), F.col(value).alias("_v")), "id")
        .groupBy(key)
        .agg(F.array_sort(F.collect_list("_v")).alias(output))
    )
    return rows.drop(output).join(found, key, "left")
