"""Fixed schemas of the inventory and the rule that names derived tables."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import types as T

#: Logical key of a resource. Region is not part of it.
KEY = ["accountId", "resourceType", "resourceId"]

CAPTURE_TIME = "configurationItemCaptureTime"
STATE_ID = "configurationStateId"
JSON_COLUMNS = ["configuration", "supplementaryConfiguration"]

RELATIONSHIPS = T.ArrayType(
    T.StructType(
        [
            T.StructField("relationshipName", T.StringType()),
            T.StructField("resourceType", T.StringType()),
            T.StructField("resourceId", T.StringType()),
            T.StructField("resourceName", T.StringType()),
        ]
    )
)
TAG_ENTRIES = T.ArrayType(
    T.StructType(
        [T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]
    )
)
TAG_MAP = T.MapType(T.StringType(), T.StringType())


def _spine_fields(tags: T.DataType) -> T.StructType:
    text = T.StringType()
    return T.StructType(
        [
            T.StructField("arn", text),
            T.StructField("accountId", text),
            T.StructField("awsRegion", text),
            T.StructField("resourceType", text),
            T.StructField("resourceId", text),
            T.StructField("resourceName", text),
            T.StructField("availabilityZone", text),
            T.StructField("resourceCreationTime", T.TimestampType()),
            T.StructField(CAPTURE_TIME, T.TimestampType()),
            T.StructField("configurationItemStatus", text),
            T.StructField(STATE_ID, text),
            T.StructField("tags", tags),
            T.StructField("relationships", RELATIONSHIPS),
            # JSON is kept as text: it stays orderable and comparable, and a
            # STRING field read from a JSON object keeps the object's text.
            T.StructField("configuration", text),
            T.StructField("supplementaryConfiguration", text),
        ]
    )


#: The wide table every record lands in.
SPINE = _spine_fields(TAG_MAP)
#: Records as JSON lines deliver them: tags are still {key, value} entries.
STAGING = _spine_fields(TAG_ENTRIES)
#: Key listing that is authoritative for what still exists.
IDENTIFIERS = T.StructType([T.StructField(c, T.StringType()) for c in KEY])
#: One snapshot object: every item of one account and region.
SNAPSHOT_ENVELOPE = T.StructType(
    [T.StructField("configurationItems", T.ArrayType(SPINE))]
)
ACCOUNTS = T.StructType(
    [
        T.StructField("accountId", T.StringType()),
        T.StructField("accountName", T.StringType()),
    ]
)
MANAGED_POLICIES = T.StructType(
    [
        T.StructField("arn", T.StringType()),
        T.StructField("defaultVersionId", T.StringType()),
        T.StructField("policyDocument", T.StringType()),
        T.StructField("policyStatements", T.ArrayType(T.StringType())),
    ]
)
#: What a source outside the configuration recorder has to supply.
SOURCE_ROW = T.StructType(
    [
        T.StructField("arn", T.StringType()),
        T.StructField("accountId", T.StringType()),
        T.StructField("awsRegion", T.StringType()),
        T.StructField("resourceType", T.StringType()),
        T.StructField("resourceId", T.StringType()),
        T.StructField("resourceName", T.StringType()),
        T.StructField("capturedAt", T.TimestampType()),
        T.StructField("tags", TAG_ENTRIES),
        T.StructField("configuration", T.StringType()),
    ]
)

_TYPE_PREFIX = "AWS::"


def table_name(resource_type: str) -> str:
    """Name of the derived table of a resource type.

    Every leading vendor prefix is dropped, ``::`` becomes ``_`` and the rest is
    lower-cased.
    """
    while resource_type.startswith(_TYPE_PREFIX):
        resource_type = resource_type[len(_TYPE_PREFIX):]
    return resource_type.replace("::", "_").lower()


def table_names(resource_types: Iterable[str]) -> dict[str, str]:
    """``{resource type: table name}``; raises when two types share a table.

    The naming rule is not injective, and writing two types to one table would
    silently drop one of them.
    """
    claims = table_claims(resource_types)
    clashes = {t: r for t, r in claims.items() if len(r) > 1}
    if clashes:
        raise ValueError(f"resource types share a derived table name: {clashes}")
    return {r[0]: t for t, r in claims.items()}


def table_claims(resource_types: Iterable[str]) -> dict[str, list[str]]:
    """``{table name: resource types that would be written to it}``."""
    claims: dict[str, list[str]] = defaultdict(list)
    for resource_type in sorted(set(resource_types)):
        claims[table_name(resource_type)].append(resource_type)
    return dict(claims)
