"""Streaming newest row per key with deletions, in state that shrinks again.

The state of a key is the capture time and state id of its newest row, not the row:
what a batch changes is emitted and need not be kept. A deleted key leaves a mark
behind, as an older row may still come and must not bring it back. Once the
watermark is past the deletion such a row is late and Spark leaves it out, so the
mark goes then. State is thus one small entry per live key and per recent deletion.

Spark asks for much per group and per access to its state: a message each way, a
parsed schema, and a table of its own for what the group emits. Keys are therefore
dealt into groups by their hash. A group's entries are one text, to which changes
are added as further texts until these are half of it; then they become one again.
What Python only passes on, the rows themselves, crosses as one text of each row.

Timers and deletions need the RocksDB state store, see :func:`use_rocksdb`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    IntegralType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from tallyhouse.schemas import CAPTURE_TIME, KEY, STATE_ID

UPSERT, DELETE = "upsert", "delete"
#: Texts of a group's state at most.
_PARTS = 16
_START, _MICRO = datetime(1970, 1, 1, tzinfo=timezone.utc), timedelta(microseconds=1)
_TO_JSON = {"ignoreNullFields": "false"}
_FROM_JSON = {"mode": "FAILFAST", "maxStringLen": str(2**31 - 1)}
_STATE = StructType([StructField("keys", StringType())])
_STORE = "spark.sql.streaming.stateStore"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """A batch writes what it changed, whole copies are made beside it from time to time,
    and all partitions on an executor share one bound on the store's memory."""
    spark.conf.set(f"{_STORE}.providerClass", _ROCKSDB)
    spark.conf.set(f"{_STORE}.rocksdb.changelogCheckpointing.enabled", "true")
    spark.conf.set(f"{_STORE}.rocksdb.boundedMemoryUsage", "true")
    # A partition's least share of that bound; else hundreds of partitions fill it at once.
    spark.conf.set(f"{_STORE}.rocksdb.writeBufferSizeMB", "1")


def live_changes(
    items: DataFrame,
    deleted: Column,
    late: str = "1 day",
    expire_after_ms: int | None = None,
    groups: int = 4096,
) -> DataFrame:
    """Changes of the newest state per key: ``items`` columns and ``change``.

    A row newer than all before it is emitted once, as ``upsert``, or as ``delete``
    where ``deleted`` holds; older and repeated ones change nothing. Rows may come
    ``late`` behind the newest capture time. With ``expire_after_ms`` a key that
    nothing captured for so long is deleted, with all but its key NULL. Rows without
    a capture time are older than all others; those with a NULL in the key form
    keys of their own kind. Use the output mode ``update``.

    A batch reads the groups it touches as a whole. A stream of very many keys wants
    more ``groups``, of some thousand keys each; their number belongs to the checkpoint.
    """
    key = StructType([StructField(str(n), items.schema[name].dataType) for n, name in enumerate(KEY)])
    rest = [f for f in items.schema.fields if f.name not in KEY]
    times = {f.name for f in rest if isinstance(f.dataType, TimestampType)}
    # Of the row's text; times are in it as microseconds.
    exact = StructType(
        [StructField(f.name, LongType() if f.name in times else f.dataType) for f in rest if f.name in times or _exact(f.dataType)]
    )
    other = {f.name: f"_other_{n}" for n, f in enumerate(rest) if f.name not in exact.names}
    texts = [F.unix_micros(_column(c)).alias(c) if c in times else _column(c) for c in exact.names]
    rows = items.select(
        F.col(CAPTURE_TIME).alias("_time"),
        F.pmod(F.xxhash64(*KEY), F.lit(groups)).alias("_group"),
        F.to_json(F.struct(*[F.col(c).alias(str(n)) for n, c in enumerate(KEY)]), _TO_JSON).alias("_key"),
        F.col(STATE_ID).alias("_id"),
        F.coalesce(deleted, F.lit(False)).alias("_gone"),
        F.to_json(F.struct(*texts), _TO_JSON).alias("_row"),
        *[_column(c).alias(alias) for c, alias in other.items()],
    )
    kinds = ["_key string, _row string", *(f"{other[c]} {items.schema[c].dataType.simpleString()}" for c in other)]
    changes = (
        rows.withWatermark("_time", late)
        .groupBy("_group")
        .transformWithState(
            LiveKeys(["_row", *other.values()], expire_after_ms), ", ".join([*kinds, "change string"]), "Update", "EventTime"
        )
        .withColumns({"_key": F.from_json("_key", key, _FROM_JSON), "_row": F.from_json("_row", exact, _FROM_JSON)})
    )
    values = {c: F.timestamp_micros(F.col("_row")[c]) if c in times else F.col("_row")[c] for c in exact.names}
    values |= {c: F.col("_key")[str(n)] for n, c in enumerate(KEY)} | {c: F.col(alias) for c, alias in other.items()}
    return changes.select(*[values[c].alias(c) for c in [*KEY, *(f.name for f in rest)]], "change")


class LiveKeys(StatefulProcessor):
    """Newest captures of a group's keys, cleared by a timer when they can no longer matter."""

    def __init__(self, passed: list[str], expire_after_ms: int | None):
        self.passed, self.expire_after_ms = passed, expire_after_ms

    def init(self, handle) -> None:
        self.handle = handle
        # Texts of {"timer": when the group's timer is due, "keys": {key: [captured, id,
        # gone, due]}}. A later text replaces keys of earlier ones, with null it drops them.
        self.last = handle.getListState("last", _STATE)
        self.row = Row("_key", *self.passed, "change")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest: dict[str, tuple] = {}
        at = None
        for row in rows:
            at = at or {c: n for n, c in enumerate(row.__fields__)}
            time, id_ = row[at["_time"]], row[at["_id"]]
            captured = 0 if time is None else (time - _START) // _MICRO
            rank = captured, id_ is not None, id_ or ""
            name = row[at["_key"]]
            if name not in newest or newest[name][0] < rank:
                newest[name] = rank, row
        known, sizes, timer = self._read()
        soon = timerValues.getCurrentWatermarkInMs() + 1
        changed: dict[str, list | None] = {}
        for name, (rank, row) in newest.items():
            last = known.get(name)
            if last is not None and rank <= (last[0], last[1] is not None, last[1] or ""):
                continue
            captured, gone = rank[0], row[at["_gone"]]
            wait = 1 if gone else self.expire_after_ms
            due = None if wait is None else max(captured // 1000 + wait, soon)
            changed[name] = [captured, row[at["_id"]], gone, due]
            yield self.row(name, *[row[at[c]] for c in self.passed], DELETE if gone else UPSERT)
        if changed:
            self._keep(known, sizes, changed, self._wake(timer, changed))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        known, sizes, _ = self._read()
        changed = {name: None for name, (*_, due) in known.items() if due is not None and due <= now}
        for name in changed:
            if not known[name][2]:
                yield self.row(name, *[None] * len(self.passed), DELETE)
        left = {name: last for name, last in known.items() if name not in changed}
        self._keep(known, sizes, changed, self._wake(None, left))

    def _wake(self, timer: int | None, changed: dict) -> int | None:
        """The group's timer: the only one, due no later than any of its keys."""
        due = min((last[3] for last in changed.values() if last[3] is not None), default=None)
        if due is None or (timer is not None and timer <= due):
            return timer
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)
        return due

    def _read(self) -> tuple[dict, list[int], int | None]:
        """Keys, keys in each text, and the timer."""
        parts = [json.loads(text) for (text,) in self.last.get()]
        sizes = [len(part["keys"]) for part in parts]
        if not parts:
            return {}, sizes, None
        known = parts[0]["keys"]
        for part in parts[1:]:
            known.update(part["keys"])
        if len(parts) > 1:
            known = {name: last for name, last in known.items() if last is not None}
        return known, sizes, parts[-1]["timer"]

    def _keep(self, known: dict, sizes: list[int], changed: dict, timer: int | None) -> None:
        if sizes and len(sizes) < _PARTS and 2 * (sum(sizes[1:]) + len(changed)) < sizes[0]:
            self.last.appendValue((_text(changed, timer),))
            return
        left = {name: last for name, last in (known | changed).items() if last is not None}
        if left:
            self.last.put([(_text(left, timer),)])
        else:
            self.last.clear()

    def close(self) -> None:
        pass


def _text(keys: dict, timer: int | None) -> str:
    return json.dumps({"timer": timer, "keys": keys}, ensure_ascii=False, separators=(",", ":"))


def _column(name: str) -> Column:
    return F.col(f"`{name}`")


def _exact(kind: DataType) -> bool:
    """Whether JSON holds such values exactly: texts, whole numbers, and what is made of them."""
    if isinstance(kind, StructType):
        return all(_exact(f.dataType) for f in kind.fields)
    if isinstance(kind, MapType):
        return isinstance(kind.keyType, StringType) and _exact(kind.valueType)
    if isinstance(kind, ArrayType):
        return _exact(kind.elementType)
    return isinstance(kind, (StringType, BooleanType, IntegralType))
