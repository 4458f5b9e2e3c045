"""Shared inputs and output shapes of the showcase queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from showcase.fixtures import fixture, spine_fixture
from tallyhouse.operators.derive import derive_type, type_schemas
from tallyhouse.schemas import CAPTURE_TIME, table_name

#: How both engines print a capture time.
TIME_SQL = "strftime(captureTime, '%Y-%m-%d %H:%M:%S.%f')"
#: Oracle columns that :func:`brief` matches.
BRIEF_SQL = f"""arn, accountId, resourceType, resourceId, resourceName, stateId,
       nameTag, {TIME_SQL} AS captureTime"""


def time_text(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def brief(spine: DataFrame, *extra: str | Column) -> DataFrame:
    """Scalar columns of spine rows, for comparison."""
    return spine.select(
        "arn",
        "accountId",
        "resourceType",
        "resourceId",
        "resourceName",
        F.col("configurationStateId").alias("stateId"),
        F.try_element_at("tags", F.lit("Name")).alias("nameTag"),
        time_text(CAPTURE_TIME).alias("captureTime"),
        *extra,
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spine_fixture(spark, sf_dir, "fx_changes")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "fx_accounts")


def typed(spine: DataFrame, resource_type: str) -> DataFrame:
    """Derived table of one type, its schema inferred from all its rows."""
    rows = spine.filter(F.col("resourceType") == resource_type)
    return derive_type(rows, type_schemas(rows)[resource_type])


def resolver(spark: SparkSession, sf_dir: str, **tables: DataFrame):
    """Table names of the demo inventory. Typed tables are derived on demand."""
    from showcase.fixtures import DEMO_TYPES

    types = {table_name(t): t for t in DEMO_TYPES}

    def find(name: str) -> DataFrame:
        if name in tables:
            return tables[name]
        if name == "accounts":
            return accounts(spark, sf_dir)
        spine = changes(spark, sf_dir)
        return spine if name == "resources" else typed(spine, types[name])

    return find
