"""Deletions and expiry in the streaming newest state."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tallyhouse.schemas import STATE_ID
from tallyhouse.streaming.live import LiveKeys, live_changes, use_rocksdb

from .conftest import item


@pytest.fixture
def stream(spark, spine, tmp_path):
    """Runs one more micro-batch of items; returns its changes as (key, id, change)."""
    landing, changes = tmp_path / "landing", []
    use_rocksdb(spark)

    def run(*items, **given):
        spine(*items).coalesce(1).write.mode("append").parquet(str(landing))
        rows = spark.readStream.schema(spine().schema).parquet(str(landing))
        live = live_changes(rows, F.col(STATE_ID).startswith("gone"), **given)

        def keep(batch, number):
            changes.extend((r.resourceId, r[STATE_ID], r.change) for r in batch.collect())

        changes.clear()
        query = (
            live.writeStream.foreachBatch(keep).outputMode("update")
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return sorted(changes, key=str)

    run.state = lambda: (
        spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "cp")).count()
    )
    return run


def at(key, day, state):
    return item(resource_id=key, configurationStateId=state, configurationItemCaptureTime=f"2026-01-{day:02d}T00:00:00Z")


def test_newest_row_and_deletions(stream):
    assert stream(at("a", 1, "1"), at("a", 3, "3"), at("a", 2, "2"), at("b", 2, "1"), late="30 days") == [
        ("a", "3", "upsert"),
        ("b", "1", "upsert"),
    ]
    # Older, repeated, deleted, and older than the deletion.
    assert stream(at("a", 2, "9"), at("a", 3, "3"), at("b", 4, "gone"), late="30 days") == [("b", "gone", "delete")]
    assert stream(at("b", 3, "2"), late="30 days") == []
    assert stream(at("b", 5, "3"), late="30 days") == [("b", "3", "upsert")]
    assert stream.state() == 2


def test_marks_of_deletions_go_and_late_rows_stay_out(stream):
    stream(at("a", 1, "1"), at("b", 1, "1"), late="1 day")
    stream(at("b", 2, "gone"), late="1 day")
    assert stream.state() == 2
    stream(at("a", 9, "2"), late="1 day")
    stream(at("a", 9, "3"), late="1 day")
    assert stream.state() == 1
    assert stream(at("b", 1, "5"), late="1 day") == []
    assert stream.state() == 1


def test_keys_expire(stream):
    days = {"late": "1 day", "expire_after_ms": 3 * 86_400_000}
    stream(at("a", 1, "1"), at("b", 1, "1"), **days)
    stream(at("a", 3, "2"), **days)
    first = stream(at("a", 6, "3"), **days)
    assert sorted({*first, *stream(at("a", 6, "4"), **days)}, key=str) == [
        ("a", "3", "upsert"), ("a", "4", "upsert"), ("b", None, "delete"),
    ]
    assert stream.state() == 1


def test_ties_and_nulls(stream):
    got = stream(at("a", 1, "1"), at("a", 1, "2"), at("a", 1, "2"), item(resource_id=None), late="1 day")
    assert got == [("a", "2", "upsert"), (None, "1", "upsert")]


class _Handle:
    """A group's state in memory; counts how often it is asked."""

    def __init__(self):
        self.texts, self.timers, self.asked = [], set(), 0

    def getListState(self, *_):
        return self

    def get(self):
        self.asked += 1
        return iter(list(self.texts))

    def put(self, texts):
        self.asked, self.texts = self.asked + 1, list(texts)

    def appendValue(self, text):
        self.asked += 1
        self.texts.append(text)

    def clear(self):
        self.asked, self.texts = self.asked + 1, []

    def registerTimer(self, due):
        self.asked += 1
        self.timers.add(due)

    def deleteTimer(self, due):
        self.asked += 1
        self.timers.remove(due)


def test_state_is_asked_per_group_not_per_key():
    handle, live = _Handle(), LiveKeys(["_row"], None)
    live.init(handle)
    take = Row("_time", "_group", "_key", "_id", "_gone", "_row")
    day = datetime(2026, 1, 1, tzinfo=timezone.utc)

    def batch(keys, hour, gone=False):
        handle.asked = 0
        rows = (take(day + timedelta(hours=hour), 0, f"k{k}", "1", gone, f"row {k} {hour}") for k in keys)
        out = list(live.handleInputRows((0,), rows, TimerValues(-1, 0)))
        return [(r["_key"], r["_row"], r.change) for r in out]

    assert batch(range(500), 5) == [(f"k{k}", f"row {k} 5", "upsert") for k in range(500)]
    assert handle.asked == 2
    whole = len(handle.texts[0][0])
    assert batch(range(10), 6) == [(f"k{k}", f"row {k} 6", "upsert") for k in range(10)]
    # What changed is added; the rest is not written again.
    assert handle.asked == 2
    assert len(handle.texts) == 2
    assert len(handle.texts[1][0]) < whole / 10
    assert batch(range(12), 5) == []
    assert len(batch(range(100, 400), 7, gone=True)) == 300
    assert len(handle.texts) == 1
    assert handle.asked == 3
    assert batch(range(100, 400), 6) == []
    # One timer wakes the group once: all its marks go.
    (due,) = handle.timers
    assert due == int((day + timedelta(hours=7)).timestamp() * 1000) + 1
    handle.asked = 0
    assert list(live.handleExpiredTimer((0,), TimerValues(-1, due + 5), ExpiredTimerInfo(due))) == []
    assert handle.asked == 2
    assert len(json.loads(handle.texts[0][0])["keys"]) == 200
    # Small changes come together again.
    for hour in range(8, 40):
        assert batch([7], hour) == [("k7", f"row 7 {hour}", "upsert")]
        assert len(handle.texts) <= 16
    assert batch([7], 38) == []


def test_many_keys_in_few_groups(stream):
    days = {"late": "1 day", "expire_after_ms": 4 * 86_400_000, "groups": 2}
    names = [f"n{k:02d}" for k in range(40)]
    assert stream(*[at(n, 2, "2") for n in names], *[at(n, 1, "1") for n in names], **days) == [
        (n, "2", "upsert") for n in names
    ]
    assert stream(*[at(n, 1, "9") for n in names], *[at(n, 3, "gone") for n in names[:10]], **days) == [
        (n, "gone", "delete") for n in names[:10]
    ]
    # The watermark passes the deletions' marks, then the keys not captured again.
    got = stream(*[at(n, 5, "5") for n in names[10:15]], **days)
    assert got == [(n, "5", "upsert") for n in names[10:15]]
    got = [*stream(at("new", 8, "8"), **days), *stream(at("new", 8, "9"), **days)]
    assert sorted(got, key=str) == sorted(
        [*((n, None, "delete") for n in names[15:]), ("new", "8", "upsert"), ("new", "9", "upsert")], key=str
    )
    assert stream(at(names[0], 2, "x"), **days) == []
    got = [*stream(at("new", 20, "a"), **days), *stream(at("new", 20, "b"), **days)]
    assert sorted(got, key=str) == sorted(
        [*((n, None, "delete") for n in names[10:15]), ("new", "a", "upsert"), ("new", "b", "upsert")], key=str
    )
    assert stream.state() == 1


def test_rows_cross_unchanged(spark, tmp_path):
    use_rocksdb(spark)
    rows = spark.sql("""
        SELECT 'a' AS accountId, 't' AS resourceType, id AS resourceId, 'arn "q" \\\\ \\n\\t' || id AS arn,
               CASE id WHEN 'r1' THEN timestamp '1970-01-01 00:00:01.123456' WHEN 'r2' THEN timestamp '9999-12-30 01:02:03.000001' END
                 AS configurationItemCaptureTime,
               CASE WHEN id = 'r1' THEN NULL ELSE '\\u00e4\\u4e2d\\U0001F600' END AS configurationStateId,
               CASE WHEN id = 'r1' THEN map('Name', cast(NULL AS string), 'b', '', 'a', '{}') WHEN id = 'r2' THEN map() END AS tags,
               CASE WHEN id = 'r1' THEN array(named_struct('x', '1', 'n', cast(NULL AS bigint)), NULL) WHEN id = 'r2' THEN array() END AS parts,
               CASE WHEN id = 'r1' THEN '' END AS configuration,
               9223372036854775807 AS `a.long`, cast(-1 AS tinyint) AS tiny, id = 'r1' AS flag,
               cast(0.1 AS double) AS real, cast(1.10 AS decimal(38,18)) AS exact, date '1900-01-01' AS day,
               array(cast('1.5' AS float)) AS reals, map(1, timestamp '2026-01-01 00:00:00.000001') AS times, X'00ff' AS bytes
        FROM VALUES ('r1'), ('r2'), (NULL) AS v(id)""")
    rows.write.parquet(str(tmp_path / "in"))
    got = []
    live = live_changes(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), F.lit(None).cast("boolean"))
    assert live.columns == [*rows.columns, "change"]
    assert [k for _, k in live.dtypes[:-1]] == [k for _, k in rows.dtypes]

    def keep(batch, number):
        got.extend(batch.collect())

    live.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(
        availableNow=True
    ).start().awaitTermination()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((*r, "upsert") for r in rows.collect()), key=str)
