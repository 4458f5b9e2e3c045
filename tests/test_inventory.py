import json

import pytest
from pyspark.sql import functions as F

from tallyhouse import BuildSettings, Inventory, Query, Semantics, Source
from tallyhouse.plans.builtin import default_registry
from tallyhouse.plans.inventory import SKIP, SNAPSHOTS, BuildInputs
from tallyhouse.plans.transforms import CustomTable, sql_transform
from tallyhouse.schemas import SOURCE_ROW
from tallyhouse.sources.manifest import Conflict
from tallyhouse.streaming.feed import ChangeFeed, item_stream, latest_state

from .conftest import ids, item

OU = "AWS::Organizations::OrganizationalUnit"


@pytest.fixture
def inventory(spark, tmp_path):
    return Inventory(spark, str(tmp_path / "inventory"))


def units(*names, semantics=Semantics.AUTHORITATIVE, enabled=True, fail=False):
    def load(spark, tables):
        rows = [(f"arn:{n}", "1", "global", OU, n, n, None, [], '{"ParentId":"r-1"}') for n in names]
        df = spark.createDataFrame(rows, SOURCE_ROW)
        if fail:
            # Fails on its rows, not when the plan is made.
            return df.withColumn("arn", F.raise_error(F.lit("refused")).cast("string"))
        return df.withColumn("capturedAt", F.lit("2026-07-17 00:00:00").cast("timestamp"))

    return Source("units", [OU], semantics, load, enabled)


def inputs(spine, *items, listed=None, **given):
    rows = spine(*items)
    keys = rows if listed is None else spine(*listed)
    return BuildInputs(items=rows, identifiers=keys.select("accountId", "resourceType", "resourceId"), **given)


def test_incremental_builds(inventory, spine, spark):
    first = inventory.build(
        inputs(
            spine,
            item(resource_id="a", configuration={"state": {"name": "running"}}),
            item(resource_id="b", configuration={"state": {"name": "stopped"}}, tags=[{"key": "Name", "value": "bee"}]),
            accounts=spark.createDataFrame([("111111111111", "prod")], "accountId string, accountName string"),
        )
    )
    assert first.counts == {"INSERT": 2, "UPDATE": 0, "DELETE": 0}
    table = {r.resourceId: r for r in inventory.table("ec2_instance").collect()}
    assert table["a"].state == "running" and table["b"].resourceName == "bee"
    assert "tagName" in inventory.table("ec2_instance").columns

    second = inventory.build(
        inputs(
            spine,
            item(resource_id="b", configurationItemCaptureTime="2026-01-11T00:00:00Z", configuration={"state": {"name": "gone"}}),
            item(resource_id="c", configurationItemCaptureTime="2026-01-11T00:00:00Z"),
            item(resource_id="ancient", configurationItemCaptureTime="2020-01-01T00:00:00Z"),
            listed=[item(resource_id="b"), item(resource_id="c")],
        )
    )
    assert second.counts == {"INSERT": 1, "UPDATE": 1, "DELETE": 1}
    assert ids(inventory.spine()) == ["b", "c"]
    assert inventory.table("ec2_instance").filter("resourceId = 'b'").first().state == "gone"
    assert [tuple(r) for r in inventory.table("accounts").collect()] == [("111111111111", "prod")]
    assert inventory.query(Query(accounts=["prod"])).count() == 2
    inventory.compact()
    assert ids(inventory.spine()) == ["b", "c"]


def test_sources_land_fail_and_release(inventory, spine):
    recorded = inputs(spine, item(resource_id="i-1"))
    report = inventory.build(recorded, BuildSettings(sources=[units("ou-1", "ou-2")]))
    assert report.status("source") == {"units": "landed"}
    assert ids(inventory.spine()) == ["i-1", "ou-1", "ou-2"]

    failed = inventory.build(recorded, BuildSettings(sources=[units("ou-9", fail=True)]))
    assert failed.status("source") == {"units": "failed"}
    assert ids(inventory.spine()) == ["i-1", "ou-1", "ou-2"]

    inventory.build(recorded, BuildSettings(sources=[units("ou-3", semantics=Semantics.MERGE)]))
    assert ids(inventory.spine()) == ["i-1", "ou-1", "ou-2", "ou-3"]

    inventory.build(recorded, BuildSettings(mode=SKIP, sources=[units("ou-7")]))
    assert ids(inventory.spine()) == ["i-1", "ou-1", "ou-2", "ou-3"]

    inventory.build(recorded, BuildSettings(sources=[units()]))
    assert ids(inventory.spine()) == ["i-1"]
    assert not inventory.store.exists("organizations_organizationalunit")


def test_a_disabled_source_releases_its_rows(inventory, spine):
    recorded = inputs(spine, item(resource_id="i-1"))
    inventory.build(recorded, BuildSettings(sources=[units("ou-1")]))
    inventory.build(recorded, BuildSettings(sources=[units("ou-1", enabled=False)]))
    assert ids(inventory.spine()) == ["i-1"]


def test_a_recorded_type_cannot_be_claimed(inventory, spine):
    with pytest.raises(ValueError, match=OU):
        inventory.build(inputs(spine, item(OU, "ou-1")), BuildSettings(sources=[units("ou-1")]))
    assert not inventory.store.exists("resources")


def test_snapshots_replace_the_spine(inventory, spine):
    inventory.build(inputs(spine, item(resource_id="old")))
    inventory.build(BuildInputs(snapshots=spine(item(resource_id="x"), item("AWS::S3::Bucket", "y"))), BuildSettings(mode=SNAPSHOTS, sources=[units("ou-1")]))
    assert ids(inventory.spine()) == ["ou-1", "x", "y"]
    assert ids(inventory.resource_types(), "resourceType") == ["AWS::EC2::Instance", OU, "AWS::S3::Bucket"]


def test_rebuild_forgets_and_ignores_the_cutoff(inventory, spine):
    inventory.build(inputs(spine, item(resource_id="a")))
    old = item(resource_id="b", configurationItemCaptureTime="2020-01-01T00:00:00Z")
    inventory.build(inputs(spine, old), BuildSettings(rebuild=True))
    assert ids(inventory.spine()) == ["b"]


def test_build_of_nothing(inventory, spine):
    report = inventory.build(inputs(spine))
    assert report.counts == {"INSERT": 0, "UPDATE": 0, "DELETE": 0}
    assert inventory.spine().count() == 0 and inventory.cutoff() is None


def test_managed_policies_are_kept_across_builds(inventory, spine, spark, tmp_path):
    def policies(*rows):
        return spark.createDataFrame(list(rows), "arn string, defaultVersionId string, document string")

    one = "%7B%22Statement%22%3A%7B%22Effect%22%3A%22Allow%22%7D%7D"
    inventory.build(inputs(spine, item(), policies=policies(("a", "v1", one), ("b", "v1", one))))
    inventory.build(inputs(spine, item(), policies=policies(("b", "v2", "%7B%7D"))))
    inventory.build(inputs(spine, item()))
    got = {r.arn: (r.defaultVersionId, r.policyStatements) for r in inventory.table("aws_managed_policy").collect()}
    assert got == {"a": ("v1", ['{"Effect":"Allow"}']), "b": ("v2", [])}


    def generations(table):
        return [c for c in (tmp_path / "inventory" / table).iterdir() if c.name.startswith("gen=")]

    assert len(generations("accounts")) == 2
    # The spine was never changed after the first build, the policies once.
    assert len(generations("resources")) == 1 and len(generations("aws_managed_policy")) == 2


def test_custom_tables_and_failing_ones(inventory, spine):
    settings = BuildSettings(
        custom_tables=[
            CustomTable("Custom::ByAccount", "SELECT accountId, count(*) AS n FROM ec2_instance GROUP BY accountId", ["ec2_instance"]),
            CustomTable("Custom::Broken", "SELECT nope FROM ec2_instance", ["ec2_instance"]),
            CustomTable("Custom::Absent", "SELECT 1", ["s3_bucket"]),
        ]
    )
    report = inventory.build(inputs(spine, item(), item(resource_id="i-2")), settings)
    assert report.status("custom") == {
        "Custom::ByAccount": "written",
        "Custom::Broken": "failed",
        "Custom::Absent": "skipped: missing dependency",
    }
    row = inventory.table("custom_byaccount").first()
    assert (row.n, row.resourceType) == (2, "Custom::ByAccount")
    assert "Custom::ByAccount" in ids(inventory.resource_types(), "resourceType")
    inventory.build(inputs(spine, item()))
    assert ids(inventory.resource_types(), "resourceType") == ["AWS::EC2::Instance"]
    assert not inventory.store.exists("custom_byaccount")


def test_transforms_that_fail_on_a_value_leave_the_table_as_derived(inventory, spine):
    casts = [sql_transform(f"cast{c}", "ec2_instance", f"SELECT *, cast(resourceId AS int) AS {c} FROM {{table}}") for c in "mn"]
    registry = default_registry(user=casts)
    report = inventory.build(inputs(spine, item(configuration={"k": 1})), BuildSettings(registry=registry))
    assert report.status("table")["ec2_instance"] == "written as derived"
    assert inventory.table("ec2_instance").first().k == 1
    assert "n" not in inventory.table("ec2_instance").columns


def test_colliding_and_unreadable_types_leave_the_others(inventory, spine):
    rows = spine(item("AWS::A::B", "1"), item("A::B", "2"), item(), item("AWS::S3::Bucket", "b"))
    broken = F.when(F.col("resourceId") == "b", '{"k": 1, "k": 2}').otherwise(F.col("configuration"))
    rows = rows.withColumn("configuration", broken)
    keys = rows.select("accountId", "resourceType", "resourceId")
    report = inventory.build(BuildInputs(items=rows, identifiers=keys))
    status = report.status("table")
    assert status["a_b"] == status["s3_bucket"] == "failed" and status["ec2_instance"] == "written"
    assert inventory.spine().count() == 4


def test_sql_over_other_tables(inventory, spine):
    inventory.build(inputs(spine, item(configuration={"size": "s"}), item("AWS::S3::Bucket", "b")))
    joined = "SELECT i.resourceId, t.size FROM input i JOIN ec2_instance t ON t.resourceId = i.resourceId"
    assert [tuple(r) for r in inventory.query(Query(sql=joined)).collect()] == [("i-1", "s")]
    assert inventory.query(Query(sql="SELECT * FROM resourceTypes")).count() == 2
    assert inventory.query(Query(sql="SELECT * FROM regions")).first()[0] == "eu-west-1"


def test_transforms_may_read_accounts_and_resources(inventory, spine, spark):
    accounts = spark.createDataFrame([("111111111111", "prod")], "accountId string, accountName string")
    sql = "SELECT t.*, a.accountName AS owner, (SELECT count(*) FROM resources) AS n FROM {table} t LEFT JOIN accounts a ON a.accountId = t.accountId"
    registry = default_registry(user=[sql_transform("owner", "ec2_instance", sql, ["ec2_instance", "accounts", "resources"])])
    report = inventory.build(inputs(spine, item(), accounts=accounts), BuildSettings(registry=registry))
    assert report.status("transform")["owner:ec2_instance,accounts,resources"] == "applied"
    assert inventory.table("ec2_instance").first().n == 1


def test_custom_tables_over_custom_tables_and_their_old_rows(inventory, spine):
    second = CustomTable("Custom::Second", "SELECT n + 1 AS m FROM custom_first", ["custom_first"])
    first = CustomTable("Custom::First", "SELECT count(*) AS n FROM ec2_instance", ["ec2_instance"])
    own = CustomTable("AWS::EC2::Instance", "SELECT 1 AS x")
    report = inventory.build(inputs(spine, item()), BuildSettings(custom_tables=[second, first, own]))
    assert report.status("custom") == {"Custom::First": "written", "Custom::Second": "written", "AWS::EC2::Instance": "failed"}
    assert inventory.table("custom_second").first().m == 2
    broken = CustomTable("Custom::First", "SELECT nope FROM ec2_instance", ["ec2_instance"])
    report = inventory.build(inputs(spine, item()), BuildSettings(custom_tables=[second, broken]))
    assert report.status("custom") == {"Custom::First": "failed", "Custom::Second": "written"}
    assert inventory.table("custom_first").first().n == 1


def test_upsert_reads_and_filters_no_more_than_it_must(inventory, spine):
    from tallyhouse.operators.merge import missing_keys, upsert_newer

    inventory.build(inputs(spine, item(), item("AWS::S3::Bucket", "b")))
    stored = inventory.spine()
    merged = upsert_newer(stored, spine(item(resource_id="i-2")))
    keys = stored.select("accountId", "resourceType", "resourceId").limit(1)

    def scans(df):
        plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return [p for p in plan.split("\n\n") if "Scan parquet" in p and "ReadSchema" in p]

    assert all("configuration" not in p and "tags" not in p for p in scans(missing_keys(merged, keys)))
    filtered = scans(merged.filter("resourceType = 'AWS::S3::Bucket'"))
    assert filtered and all("resourceType" in p.split("PartitionFilters")[1] for p in filtered if "configuration" in p)


def test_a_lost_pointer_is_found_again(inventory, spine):
    import os

    inventory.build(inputs(spine, item()))
    root = inventory.store.root.removeprefix("file:")
    os.rename(f"{root}/ec2_instance/CURRENT", f"{root}/ec2_instance/CURRENT.{'0' * 32}")
    assert ids(inventory.table("ec2_instance")) == ["i-1"]


# -- versions --------------------------------------------------------------------

NEWER = "2026-02-01T00:00:00Z"


def test_only_changed_types_are_rewritten(inventory, spine):
    bucket = item("AWS::S3::Bucket", "b", configuration={"name": "one"})
    inventory.build(inputs(spine, item(), bucket, item("AWS::SNS::Topic", "t")))
    first, tables = inventory.resources.current(), {n: inventory.store.generation(n) for n in inventory.store.names()}
    changed = bucket | {"configuration": {"name": "two"}, "configurationItemCaptureTime": NEWER}
    report = inventory.build(inputs(spine, item(), changed, listed=[item(), changed]))
    second = inventory.resources.current()
    assert report.counts == {"INSERT": 0, "UPDATE": 1, "DELETE": 1}
    assert second.number == first.number + 1 and set(second.parts) == {"AWS::EC2::Instance", "AWS::S3::Bucket"}
    assert second.parts["AWS::EC2::Instance"] == first.parts["AWS::EC2::Instance"]
    assert second.parts["AWS::S3::Bucket"] != first.parts["AWS::S3::Bucket"]
    status = report.status("table")
    assert status["ec2_instance"] == status["aws_managed_policy"] == "unchanged" and status["s3_bucket"] == "written"
    assert inventory.store.generation("ec2_instance") == tables["ec2_instance"]
    assert not inventory.store.exists("sns_topic")
    assert inventory.table("s3_bucket").first()["name"] == "two"
    # Nothing new at all: no version, no table.
    third = inventory.build(inputs(spine, item(), changed))
    assert inventory.resources.current() == second and third.counts == {"INSERT": 0, "UPDATE": 0, "DELETE": 0}
    assert set(third.status("table").values()) - {"written"} == {"unchanged"}


def test_other_transforms_and_tables_beside_make_a_table_stale(inventory, spine):
    items = [item(), item("AWS::S3::Bucket", "b"), item("AWS::SNS::Topic", "t")]
    both = sql_transform(
        "both", "ec2_instance", "SELECT i.*, (SELECT count(*) FROM sns_topic) AS topics FROM {table} i",
        dependencies=["ec2_instance", "sns_topic"],
    )
    settings = BuildSettings(registry=default_registry(user=[both]))
    inventory.build(inputs(spine, *items))
    report = inventory.build(inputs(spine, *items), settings)
    assert set(report.status("table").values()) == {"written"}
    assert inventory.table("ec2_instance").first().topics == 1
    more = item("AWS::SNS::Topic", "u", configurationItemCaptureTime=NEWER)
    report = inventory.build(inputs(spine, *items, more), settings)
    assert {n for n, s in report.status("table").items() if s == "unchanged"} == {"s3_bucket", "aws_managed_policy"}
    assert inventory.table("ec2_instance").first().topics == 2
    report = inventory.build(inputs(spine, *items, more, listed=items[:2]), settings)
    assert report.status("transform")["both:ec2_instance,sns_topic"] == "skipped: missing dependency"
    assert "topics" not in inventory.table("ec2_instance").columns


def test_only_the_failing_transform_is_left_out(inventory, spine):
    good = sql_transform("good", "ec2_instance", "SELECT *, 1 AS one FROM {table}")
    bad = sql_transform("bad", "ec2_instance", "SELECT *, CAST(resourceId AS INT) AS n FROM {table}")
    settings = BuildSettings(registry=default_registry(user=[bad, good]))
    report = inventory.build(inputs(spine, item(resource_id="x", tags=[{"key": "Name", "value": "ex"}])), settings)
    assert report.status("table")["ec2_instance"] == "written without a failed transform"
    row = inventory.table("ec2_instance").first()
    assert row.one == 1 and row.resourceName == "ex" and "n" not in row.asDict()
    # It is not taken for finished: the next build tries again.
    assert inventory.build(inputs(spine, item(resource_id="x")), settings).status("table")["ec2_instance"] != "unchanged"


def test_a_version_is_published_once(inventory, spine):
    table = inventory.resources
    base = table.current()
    table.replace(spine(item(resource_id="a")), base)
    with pytest.raises(Conflict):
        table.replace(spine(item(resource_id="b")), base)
    assert not inventory.store.files.publish(table._path(1), "{}")
    assert ids(inventory.spine()) == ["a"]
    table.drop()
    assert not table.exists() and table.current().number == 2
    with pytest.raises(ValueError, match="outside"):
        table.rewrite(table.current(), ["AWS::S3::Bucket"], lambda stored: spine(item()))


def test_expiry_keeps_what_newer_versions_share(inventory, spine):
    table = inventory.resources
    first = table.replace(spine(item(), item("AWS::S3::Bucket", "b"), item(None, "n")), table.current())
    assert set(first.parts) == {"AWS::EC2::Instance", "AWS::S3::Bucket", None}
    for n in range(3):
        table.rewrite(table.current(), ["AWS::S3::Bucket"], lambda s, n=n: spine(item("AWS::S3::Bucket", f"b{n}")))
    table.expire(2)
    assert ids(inventory.spine()) == ["b2", "i-1", "n"]
    assert ids(table.read(only=[None])) == ["n"]
    assert len(table._numbers()) == 2


# -- streaming -------------------------------------------------------------------


def land(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_streams_do_not_meet_and_half_batches_wait(inventory, spark, spine, tmp_path):
    inventory.build(inputs(spine, item(resource_id="z")))
    feed = ChangeFeed(inventory.store)
    for name in ("one", "two"):
        land(tmp_path / name, "1.json", item(resource_id=name))
        feed.start(item_stream(spark, str(tmp_path / name)), str(tmp_path / f"{name}-offsets")).awaitTermination()
    assert ids(feed.current()) == ["one", "two", "z"]
    half = tmp_path / "inventory" / "_changes" / "batch=x-00000000000000000000"
    half.mkdir()
    (half / "part-0.parquet").write_bytes(b"half a file")
    assert len(feed.batches()) == 2 and feed.compact() == 2
    assert half.exists() and ids(inventory.spine()) == ["one", "two", "z"]


def test_a_crash_after_the_commit_brings_nothing_back(inventory, spine, monkeypatch):
    """The folders of folded batches stay; a build that reaps their rows is final."""
    z, b = item(resource_id="z"), item(resource_id="b", configurationItemCaptureTime=NEWER)
    inventory.build(inputs(spine, z))
    feed = ChangeFeed(inventory.store)
    feed.append(spine(b, item(resource_id="n1", accountId=None)), 0)
    with monkeypatch.context() as patch:
        patch.setattr(feed._files, "delete", lambda path: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError, match="crash"):
            feed.compact()
    assert ids(inventory.spine()) == ["b", "n1", "z"] and feed.batches() == []
    inventory.build(inputs(spine, z, listed=[z]))
    feed.append(spine(b, item(resource_id="n1", accountId=None)), 0)
    assert feed.batches() == [] and feed.compact() == 0
    assert ids(inventory.spine()) == ids(feed.current()) == ["z"]
    assert not [f for f in inventory.store.files.children(feed.folder) if f.startswith("batch=")]


def test_a_crash_before_the_commit_loses_nothing(inventory, spine, monkeypatch):
    inventory.build(inputs(spine, item(resource_id="z")))
    feed = ChangeFeed(inventory.store)
    feed.append(spine(item(resource_id="b")), 0)
    with monkeypatch.context() as patch:
        patch.setattr(feed.resources, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError, match="crash"):
            feed.compact()
    assert len(feed.batches()) == 1 and ids(inventory.spine()) == ["z"]
    assert feed.compact() == 1 and ids(inventory.spine()) == ["b", "z"]


def test_a_build_and_a_compaction_race(inventory, spine, monkeypatch):
    """The build reads, the compaction commits, the build commits: nothing is lost."""
    z, y = item(resource_id="z"), item(resource_id="y")
    bucket = item("AWS::S3::Bucket", "fed", configurationItemCaptureTime=NEWER)
    inventory.build(inputs(spine, z))
    feed = ChangeFeed(inventory.store)
    feed.append(spine(item(resource_id="n1", accountId=None), bucket), 0)
    commit, raced = inventory.resources.commit, []

    def late(base, *given, **named):
        if not raced:
            raced.append(feed.compact())
        return commit(base, *given, **named)

    monkeypatch.setattr(inventory.resources, "commit", late)
    inventory.build(inputs(spine, z, y, listed=[z, y, bucket, item(resource_id="n1", accountId=None)]))
    assert raced == [1]
    # A listing cannot name a key with a NULL: the build reaps that row, and for good.
    assert ids(inventory.spine()) == ["fed", "y", "z"]
    assert feed.batches() == [] and ids(feed.current()) == ["fed", "y", "z"]


def test_change_feed(inventory, spark, spine, tmp_path):
    inventory.build(inputs(spine, item(resource_id="a", configurationStateId="old")))
    feed = ChangeFeed(inventory.store)
    landing, checkpoint = tmp_path / "landing", str(tmp_path / "offsets")
    newer = "2026-02-01T00:00:00Z"
    land(landing, "1.json", item(resource_id="a", configurationItemCaptureTime=newer, configurationStateId="new"), item(resource_id="b"))
    stream = item_stream(spark, str(landing))
    feed.start(stream, checkpoint).awaitTermination()
    land(landing, "2.json", item(resource_id="a", configurationItemCaptureTime="2026-01-20T00:00:00Z", configurationStateId="late"))
    feed.start(stream, checkpoint).awaitTermination()

    def state():
        return {r.resourceId: r.configurationStateId for r in feed.current().collect()}

    assert len(feed.batches()) == 2
    assert state() == {"a": "new", "b": "1"}
    assert ids(inventory.spine()) == ["a"]
    late = item(resource_id="a", configurationItemCaptureTime="2026-01-20T00:00:00Z")
    run = feed.batches()[0].removeprefix("batch=").rpartition("-")[0]
    feed.append(spine(late, item(resource_id="n1", accountId=None), item(resource_id="n2", accountId=None)), 1, run)
    assert len(feed.batches()) == 2
    assert feed.compact() == 2 and feed.compact() == 0
    # Delivered once more after it was folded in: nothing happens.
    feed.append(spine(item(resource_id="n1", accountId=None)), 1, run)
    assert feed.batches() == []
    assert state() == {"a": "new", "b": "1", "n1": "1", "n2": "1"}
    assert ids(inventory.spine()) == ["a", "b", "n1", "n2"]


def test_streaming_latest_state(spark, tmp_path):
    landing = tmp_path / "landing"
    land(
        landing,
        "1.json",
        item(resource_id="a", configurationStateId="1"),
        item(resource_id="a", configurationStateId="2", configurationItemCaptureTime="2026-03-01T00:00:00Z"),
        item(resource_id="a", configurationStateId="3", configurationItemCaptureTime="2026-02-01T00:00:00Z"),
        item(resource_id="b"),
    )
    query = (
        latest_state(item_stream(spark, str(landing)))
        .writeStream.format("memory").queryName("state").outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {r.resourceId: r.configurationStateId for r in spark.table("state").collect()}
    assert got == {"a": "2", "b": "1"}
