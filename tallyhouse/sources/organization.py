"""Accounts, organizational units and managed policies from landed listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.jsontext import decoded_document
from tallyhouse.schemas import SOURCE_ROW, TAG_ENTRIES

OU_TYPE = "AWS::Organizations::OrganizationalUnit"
OU_REGION = "global"


def named_accounts(listing: DataFrame) -> DataFrame:
    """``(accountId, accountName)``; entries without an id are dropped."""
    return listing.select("accountId", "accountName").filter(
        F.col("accountId").isNotNull()
    )


def unit_rows(
    units: DataFrame, tags: DataFrame, management_account: str, captured_at: Column
) -> DataFrame:
    """Source rows of organizational units of every depth.

    ``units`` has ``id, arn, name, parentId``; ``tags`` has ``unitId, key,
    value``. Tags belong to units by id, never by listing order. The tree itself
    is kept only as the parent id in ``configuration``.
    """
    per_unit = tags.groupBy(F.col("unitId").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("key", "value"))).alias("tags")
    )
    columns = {
        "arn": F.col("arn"),
        "accountId": F.lit(management_account),
        "awsRegion": F.lit(OU_REGION),
        "resourceType": F.lit(OU_TYPE),
        "resourceId": F.col("id"),
        "resourceName": F.col("name"),
        "capturedAt": captured_at,
        "tags": F.coalesce(F.col("tags"), F.array()).cast(TAG_ENTRIES),
        "configuration": F.to_json(
            F.struct(F.col("parentId").alias("ParentId")),
            {"ignoreNullFields": "false"},
        ),
    }
    return units.join(per_unit, "id", "left").select(
        [columns[f.name].cast(f.dataType).alias(f.name) for f in SOURCE_ROW.fields]
    )


def policy_versions(listing: DataFrame) -> DataFrame:
    """``(arn, defaultVersionId)``; both are required."""
    return listing.select("arn", "defaultVersionId").filter(
        F.col("arn").isNotNull() & F.col("defaultVersionId").isNotNull()
    )


def policy_documents(fetched: DataFrame) -> DataFrame:
    """Fetched policies with their URL-encoded ``document`` decoded to JSON."""
    return fetched.select(
        "arn",
        "defaultVersionId",
        decoded_document(F.col("document")).alias("policyDocument"),
    )
