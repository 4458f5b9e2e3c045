"""Rows and types supplied by sources other than the configuration recorder."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.schemas import CAPTURE_TIME, SPINE, TAG_MAP


class Semantics(Enum):
    """How a source's rows relate to the stored rows of the types it claims."""

    #: The rows are the complete set: stored rows it did not deliver go away.
    AUTHORITATIVE = "authoritative"
    #: Rows are added or replaced; the others stay.
    MERGE = "merge"


@dataclass(frozen=True)
class Source:
    """A source, the types it owns and the function that produces its rows.

    ``load`` gets the session and the stored tables by name (so that a source can
    compare versions before it fetches) and returns rows of
    :data:`~tallyhouse.schemas.SOURCE_ROW`. Raising means "failed": nothing
    lands and the stored rows stay. Returning no rows means "there are none".
    """

    name: str
    resource_types: Sequence[str]
    semantics: Semantics
    load: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    enabled: bool = True


def claimed_types(sources: Sequence[Source]) -> list[str]:
    """Types owned by enabled sources. A disabled source claims nothing, so its
    rows fall back to the key listing and are reaped by the next build."""
    return sorted({t for s in sources if s.enabled for t in s.resource_types})


def source_rows_to_spine(rows: DataFrame) -> DataFrame:
    """Source rows as spine rows.

    The capture time is the time of observation. Relationships are empty,
    ``supplementaryConfiguration`` is an empty object (never NULL) and columns
    that only the recorder can fill are NULL.
    """
    given: dict[str, Column] = {
        CAPTURE_TIME: F.col("capturedAt"),
        "tags": F.map_from_entries(F.col("tags")).cast(TAG_MAP),
        "relationships": F.array().cast(SPINE["relationships"].dataType),
        "supplementaryConfiguration": F.lit("{}"),
        **{
            c: F.col(c)
            for c in (
                "arn",
                "accountId",
                "awsRegion",
                "resourceType",
                "resourceId",
                "resourceName",
                "configuration",
            )
        },
    }
    return rows.select(
        [
            given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in SPINE.fields
        ]
    )
