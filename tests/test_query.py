import pytest
from pyspark.sql import functions as F

from tallyhouse.plans.query import (
    Query,
    account_facets,
    facet_values,
    field_facets,
    key_facets,
    key_value,
)

from .conftest import ids, item


@pytest.fixture
def tables(spark, spine):
    rows = spine(
        item(resource_id="i-1", resourceName="web-1", tags=[{"key": "Name", "value": "w"}]),
        item(resource_id="i-2", resourceName=None, accountId="2"),
        item("AWS::S3::Bucket", "b-1", resourceName="logs", accountId="3", awsRegion="us-east-1"),
    )
    accounts = spark.createDataFrame(
        [("111111111111", "prod"), ("2", None)], "accountId string, accountName string"
    )
    typed = rows.filter("resourceType = 'AWS::EC2::Instance'").withColumn("vpcId", F.lit("vpc"))
    held = {
        "resources": rows,
        "accounts": accounts,
        "ec2_instance": typed,
        "iam_role": rows,
        "ec2_subnet": typed.withColumn("cidrBlock", F.lit("c")).withColumn("availableIpAddressCount", F.lit(1)),
    }
    return held.__getitem__


def unnamed(tables):
    return lambda n: tables(n).withColumn("accountName", F.lit(None).cast("string")) if n == "accounts" else tables(n)


def test_default_columns(tables):
    assert Query().run(tables).columns == ["resourceType", "accountId", "accountName", "awsRegion", "resourceId", "resourceName"]
    assert Query().run(unnamed(tables)).columns == ["resourceType", "accountId", "awsRegion", "resourceId", "resourceName"]
    assert Query().run(tables).count() == 3


def test_typed_columns_and_extras(tables):
    base = ["accountId", "accountName", "awsRegion", "resourceId", "resourceName"]
    assert Query(resource_type="AWS::EC2::Instance").run(tables).columns == base
    assert Query(resource_type="AWS::IAM::Role").run(tables).columns == [*base, "arn"]
    assert Query(resource_type="AWS::EC2::Subnet").run(tables).columns == [
        *base, "vpcId", "cidrBlock", "availabilityZone", "availableIpAddressCount",
    ]
    extras = {"ec2_subnet": ["tags['Name'] AS tagName"]}
    out = Query(resource_type="AWS::EC2::Subnet", extra_columns=extras).run(tables)
    assert out.columns == [*base, "tagName"]


def test_fields_are_verbatim_and_all_wins(tables):
    out = Query(fields=["resourceId", "upper(awsRegion) AS r"]).run(tables)
    assert out.columns == ["resourceId", "r"]
    every = Query(fields=["resourceId"], all_fields=True).run(tables)
    assert every.columns == [*tables("resources").columns, "accountName"]


def test_exclude_ignores_case(tables):
    assert Query(exclude=["ACCOUNTID", "nothing"]).run(tables).columns == [
        "resourceType", "accountName", "awsRegion", "resourceId", "resourceName",
    ]
    assert "arn" not in Query(all_fields=True, exclude=["ARN"]).run(tables).columns
    with pytest.raises(ValueError, match="nothing"):
        Query(all_fields=True, exclude=["nothing"]).run(tables)


@pytest.mark.parametrize(
    "query, expected",
    [
        (Query(accounts=["prod", "3"]), ["b-1", "i-1"]),
        (Query(where=[("awsRegion", "eu-west-1")]), ["i-1", "i-2"]),
        (Query(where=[("awsRegion", "eu-west-1' OR '1'='1")]), []),
        (Query(where=[("accountName", "prod"), ("resourceId", "i-2")]), []),
        (Query(where_raw=["resourceId = 'i-1' OR resourceId = 'b-1'", "awsRegion LIKE 'us%'"]), ["b-1"]),
        (Query(ids=["^i", "b"]), ["b-1", "i-1", "i-2"]),
        (Query(names=["web", "g"]), ["b-1", "i-1"]),
        (Query(ids=["-1"], names=["logs"]), ["b-1"]),
        (Query(where_raw=["resourceName <> 'logs'"]), ["i-1"]),
    ],
)
def test_filters(tables, query, expected):
    assert ids(query.run(tables)) == expected


def test_sort_puts_nulls_last_in_both_directions(tables):
    def order(**given):
        return [r.resourceId for r in Query(**given).run(tables).collect()]

    assert order(sort=["resourceName"]) == ["b-1", "i-1", "i-2"]
    assert order(sort=["resourceName"], reverse=True) == ["i-1", "b-1", "i-2"]
    assert order(sort=["awsRegion", "resourceId"], reverse=True) == ["b-1", "i-2", "i-1"]
    assert order(fields=["resourceId", "length(resourceName) AS n"], sort=["n"])[0] == "b-1"
    assert order(fields=["resourceId"], sort=["awsRegion", "resourceId"])[-1] == "b-1"


def test_user_sql_sees_input(tables):
    query = Query(where=[("awsRegion", "eu-west-1")], sql="WITH a AS (SELECT * FROM input) SELECT count(*) AS n FROM a;")
    assert query.run(tables).first().n == 2
    with pytest.raises(ValueError, match="not a single SELECT"):
        Query(sql="DROP TABLE x").run(tables)


def test_key_value():
    assert key_value("a=b=c") == ("a", "b=c")
    for bad in ("a", "=b", "a="):
        with pytest.raises(ValueError):
            key_value(bad)


def test_facets(tables, spark):
    values = facet_values(Query(where=[("awsRegion", "eu-west-1")], ids=["none"]), tables, "resourceId", "i-")
    assert [r.resourceId for r in values.collect()] == ["i-1", "i-2"]
    assert [r.candidate for r in key_facets(Query(), tables, "awsRegion=us").collect()] == ["awsRegion=us-east-1"]
    keys = ids(key_facets(Query(), tables), "candidate")
    assert "arn=" in keys and "tags=" not in keys and "resourceCreationTime=" not in keys
    pairs = {(r.candidate, r.help) for r in account_facets(tables("accounts")).collect()}
    assert pairs == {("111111111111", "prod"), ("2", None), ("prod", "111111111111")}
    assert "accountName" in ids(field_facets(tables("resources")), "column_name")


def test_filters_reach_the_scan(spark, tables, tmp_path):
    tables("resources").write.parquet(str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    out = Query(where=[("awsRegion", "eu-west-1")]).run(lambda n: stored if n == "resources" else tables(n))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(awsRegion,eu-west-1)" in plan and "configuration:" not in plan
