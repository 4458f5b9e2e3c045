from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import merge
from tallyhouse.operators.counts import unselectable_types
from tallyhouse.schemas import SPINE
from tallyhouse.sources.store import staged

from .conftest import ids, item

OU = "AWS::Organizations::OrganizationalUnit"


def actions(df):
    return sorted((r.resourceId, r.merge_action, r.configurationStateId) for r in df.collect())


def test_newer_wins_older_and_equal_stay(spine):
    stored = spine(
        item(resource_id="a", configurationStateId="old"),
        item(resource_id="b", configurationStateId="old"),
        item(resource_id="c", configurationStateId="old"),
        item(resource_id="d", configurationStateId="old"),
    )
    new = spine(
        item(resource_id="a", configurationItemCaptureTime="2026-01-11T00:00:00Z", configurationStateId="new"),
        item(resource_id="b", configurationStateId="new"),
        item(resource_id="c", configurationItemCaptureTime=None, configurationStateId="new"),
        item(resource_id="e", configurationStateId="new"),
    )
    assert actions(merge.upsert_newer(stored, new)) == [
        ("a", "UPDATE", "new"),
        ("b", "KEEP", "old"),
        ("c", "KEEP", "old"),
        ("d", "KEEP", "old"),
        ("e", "INSERT", "new"),
    ]


def test_source_duplicates_reduce_to_latest_then_greatest_state(spine):
    new = spine(
        item(configurationStateId="1"),
        item(configurationStateId="2"),
        item(configurationItemCaptureTime=None, configurationStateId="9"),
        item(configurationItemCaptureTime="2026-01-09T00:00:00Z", configurationStateId="8"),
    )
    assert actions(merge.upsert_newer(spine(), new)) == [("i-1", "INSERT", "2")]


def test_source_duplicates_can_be_refused(spine):
    new = spine(item(), item())
    with pytest.raises(Exception, match="more than one source row"):
        merge.upsert_newer(spine(), new, on_duplicate="error").collect()


def test_null_keys_never_match(spine):
    stored = spine(item(accountId=None, configurationStateId="old"))
    new = spine(
        item(accountId=None, configurationItemCaptureTime="2027-01-01T00:00:00Z", configurationStateId="n1"),
        item(accountId=None, configurationItemCaptureTime="2027-01-01T00:00:00Z", configurationStateId="n2"),
    )
    got = [(a, s) for _, a, s in actions(merge.upsert_newer(stored, new))]
    assert sorted(got) == [("INSERT", "n1"), ("INSERT", "n2"), ("KEEP", "old")]


def test_repeated_stored_key_is_updated_in_each_row(spine):
    stored = spine(item(configurationStateId="a"), item(configurationStateId="b"))
    new = spine(item(configurationItemCaptureTime="2027-01-01T00:00:00Z", configurationStateId="n"))
    assert [a for _, a, _ in actions(merge.upsert_newer(stored, new))] == ["UPDATE", "UPDATE"]


def test_staged_upsert_is_the_same(spine):
    stored = spine(item(resource_id="a"), item(resource_id="b"))
    new = spine(item(resource_id="b", configurationItemCaptureTime="2027-01-01T00:00:00Z"), item(resource_id="c"))
    plain = actions(merge.upsert_newer(stored, new))
    assert actions(merge.upsert_newer(stored, new, stage=staged, cluster_by="resourceType")) == plain


@pytest.mark.parametrize("stage", [None, staged])
def test_reaping_spares_claimed_types(spine, keys, stage):
    stored = spine(
        item(resource_id="i-live"), item(resource_id="i-stale"), item(OU, "ou-1"), item(None, "untyped")
    )
    listed = keys(("111111111111", "AWS::EC2::Instance", "i-live"))
    assert ids(merge.reap_missing(stored, listed, [OU], stage)) == ["i-live", "ou-1", "untyped"]
    assert ids(merge.reap_missing(stored, listed, [], stage)) == ["i-live"]


def test_cutoff_ignores_claimed_types(spine):
    stored = spine(
        item(configurationItemCaptureTime="2026-01-10T00:00:00Z"),
        item(OU, "ou-1", configurationItemCaptureTime="2026-07-17T00:00:00Z"),
    )

    def cutoff(claimed):
        return merge.incremental_cutoff(stored, claimed).first().cutoff

    assert cutoff([OU]) == datetime(2026, 1, 9)
    assert cutoff([]) == datetime(2026, 7, 16)
    assert merge.incremental_cutoff(stored.filter(F.col("resourceType") == OU), [OU]).first().cutoff is None


def test_land_merge_replaces_whatever_the_age(spine):
    stored = spine(item(OU, "ou-1", configurationStateId="old"), item(OU, "ou-2"))
    rows = spine(
        item(OU, "ou-1", configurationStateId="new", configurationItemCaptureTime="2020-01-01T00:00:00Z"),
        item(OU, "ou-3"),
    )
    out = merge.land_merge(stored, rows)
    assert ids(out) == ["ou-1", "ou-2", "ou-3"]
    assert out.filter("resourceId = 'ou-1'").first().configurationStateId == "new"


def test_land_authoritative_clears_only_claimed_types(spine):
    stored = spine(item(OU, "ou-gone"), item(OU, "ou-1"), item(resource_id="i-1"), item(None, "untyped"))
    assert ids(merge.land_authoritative(stored, spine(item(OU, "ou-1")), [OU])) == ["i-1", "ou-1", "untyped"]
    assert ids(merge.land_authoritative(stored, spine(), [OU])) == ["i-1", "untyped"]


def test_keyed_replace_and_stale_versions(spark):
    schema = "arn string, defaultVersionId string, policyDocument string"
    stored = spark.createDataFrame([("a", "v1", "1"), ("b", "v1", "1")], schema)
    new = spark.createDataFrame([("b", "v2", "2"), ("c", "v1", "1"), ("b", "v3", "3")], schema)
    out = merge.keyed_replace(stored, new, "arn", "defaultVersionId")
    assert sorted((r.arn, r.defaultVersionId) for r in out.collect()) == [("a", "v1"), ("b", "v3"), ("c", "v1")]
    listing = spark.createDataFrame([("a", "v1"), ("b", "v2"), ("x", "v1")], "arn string, defaultVersionId string")
    assert ids(merge.stale_versions(listing, stored), "arn") == ["b", "x"]


def test_accounts_follow_the_spine(spark, spine):
    schema = "accountId string, accountName string"
    old = spark.createDataFrame([("1", "one"), ("2", "two"), ("9", "gone")], schema)
    listed = spark.createDataFrame([("1", "new"), ("2", None), ("3", "three"), ("7", "unused")], schema)
    rows = spine(*[item(accountId=a) for a in ("1", "1", "2", "3", "4", None)])

    def names(df):
        return {r.accountId: r.accountName for r in df.collect()}

    assert names(merge.accounts_refresh(old, rows, listed)) == {"1": "new", "2": "two", "3": "three", "4": None}
    assert names(merge.accounts_refresh(old, rows, None)) == {"1": "one", "2": "two", "3": None, "4": None}


def test_claims_of_recorded_types_are_refused(spine):
    recorded = spine(item(OU, "ou-1"), item())
    merge.check_claims(recorded, ["Other::Type"])
    with pytest.raises(ValueError, match=OU):
        merge.check_claims(recorded, [OU])


def test_merge_counts(spine, keys):
    stored = spine(item(resource_id="a"), item(resource_id="b"))
    new = spine(item(resource_id="a", configurationItemCaptureTime="2027-01-01T00:00:00Z"), item(resource_id="c"))
    merged = merge.upsert_newer(stored, new)
    missing = merge.missing_keys(stored, keys(("111111111111", "AWS::EC2::Instance", "a")))
    got = {r.merge_action: r.n for r in merge.merge_counts(merged, missing).collect()}
    assert got == {"UPDATE": 1, "KEEP": 1, "INSERT": 1, "DELETE": 1}


def test_unselectable_types(spine):
    every = spine(item("A", "1"), item("B", "2"))
    assert ids(unselectable_types(every, spine(item("A", "1"))), "resourceType") == ["B"]


def test_upsert_of_a_hot_key_against_brute_force(spark):
    """A third of all incoming rows share one key."""
    n = 3000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("resourceId"),
        ((F.col("id") * 7919) % n).alias("at"),
        F.col("id").cast("string").alias("configurationStateId"),
    )
    wide = rows.select(
        [
            {
                "accountId": F.lit("1"),
                "resourceType": F.lit("T"),
                "resourceId": F.col("resourceId"),
                "configurationStateId": F.col("configurationStateId"),
                "configurationItemCaptureTime": F.timestamp_seconds("at"),
            }.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in SPINE.fields
        ]
    )
    best = {}
    for r in rows.collect():
        best[r.resourceId] = max(best.get(r.resourceId, (-1, "")), (r.at, r.configurationStateId))
    got = {r.resourceId: r.configurationStateId for r in merge.latest_per_key(wide).collect()}
    assert got == {k: v[1] for k, v in best.items()}
