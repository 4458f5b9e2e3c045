import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tallyhouse.schemas import SPINE, STAGING  # noqa: E402
from tallyhouse.sources.items import staged_to_spine  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def item(resource_type="AWS::EC2::Instance", resource_id="i-1", **given):
    """One configuration item as its JSON line."""
    row = {
        "arn": f"arn:{resource_id}",
        "accountId": "111111111111",
        "awsRegion": "eu-west-1",
        "resourceType": resource_type,
        "resourceId": resource_id,
        "resourceName": None,
        "configurationItemCaptureTime": "2026-01-10T00:00:00Z",
        "configurationStateId": "1",
        "tags": [],
        "relationships": [],
        "configuration": {},
        "supplementaryConfiguration": {},
    }
    return row | given


@pytest.fixture
def spine(spark):
    """Spine rows from items, by the same reader files go through."""

    def make(*items):
        if not items:
            return spark.createDataFrame([], SPINE)
        lines = spark.createDataFrame([(json.dumps(i),) for i in items], "value string")
        parsed = lines.select(F.from_json("value", STAGING).alias("row")).select("row.*")
        return staged_to_spine(parsed)

    return make


@pytest.fixture
def keys(spark):
    def make(*rows):
        return spark.createDataFrame(
            list(rows), "accountId string, resourceType string, resourceId string"
        )

    return make


def ids(df, column="resourceId"):
    return sorted(r[column] for r in df.collect())
