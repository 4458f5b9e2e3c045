"""Keeping the spine current: upserts, reaping, replacement, diffs.

Parquet has no MERGE, so each operator is a join that returns the new content of
the table. Three rules hold throughout:

* wide spine rows stay on the streamed side of left/semi/anti joins. These are
  the joins in which Spark may broadcast the other side when it is small and
  split a skewed key of this side when it is not;
* the incoming side is reduced to one row per key by an aggregation, which
  combines before it shuffles, so repeated copies of one key never meet in a task;
* a key with a NULL part never equals another key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.schemas import CAPTURE_TIME, KEY, STATE_ID

Stage = Callable[[DataFrame], DataFrame]


def complete(keys: Sequence[str]) -> Column:
    """Whether no part of the key is NULL."""
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def _fingerprint(df: DataFrame, skip: Sequence[str]) -> Column:
    """Hash of a row's scalar columns, so that ties break the same way each run."""
    plain = [
        f.name
        for f in df.schema.fields
        if f.name not in skip
        and not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))
    ]
    return F.xxhash64(*plain) if plain else F.lit(0)


def latest_per_key(
    df: DataFrame,
    keys: Sequence[str] = KEY,
    order: Sequence[str] = (CAPTURE_TIME, STATE_ID),
) -> DataFrame:
    """One row per key: the greatest by ``order`` (NULL is lowest).

    Partial aggregation keeps one candidate per key and input partition, so a key
    that holds a third of all rows costs no more shuffle than any other.
    """
    rank = F.struct(
        *[F.col(c) for c in order if c in df.columns],
        _fingerprint(df, [*keys, *order]).alias("_tie"),
    )
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), rank).alias("_row"))
        .select(*keys, "_row.*")
        .select(df.columns)
    )


def unique_source(
    df: DataFrame,
    keys: Sequence[str] = KEY,
    order: Sequence[str] = (CAPTURE_TIME, STATE_ID),
    on_duplicate: str = "latest",
) -> DataFrame:
    """Incoming rows with complete keys, one per key.

    ``on_duplicate="error"`` fails the job when a key occurs twice.
    """
    known = df.filter(complete(keys))
    if on_duplicate == "latest":
        return latest_per_key(known, keys, order)
    if on_duplicate != "error":
        raise ValueError("on_duplicate is 'latest' or 'error'")
    rest = [c for c in df.columns if c not in keys]
    checked = F.when(
        F.count("*") > 1,
        F.raise_error(F.concat_ws(" ", F.lit("more than one source row for"), *keys)),
    ).otherwise(F.first(F.struct(*rest)))
    return (
        known.groupBy(*keys)
        .agg(checked.alias("_row"))
        .select(*keys, "_row.*")
        .select(df.columns)
    )


def upsert_newer(
    stored: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str] = KEY,
    time: str = CAPTURE_TIME,
    order: Sequence[str] = (CAPTURE_TIME, STATE_ID),
    on_duplicate: str = "latest",
    stage: Stage | None = None,
    cluster_by: str | None = None,
) -> DataFrame:
    """Content of ``stored`` after a conditional upsert, plus ``merge_action``.

    A stored row is replaced when the incoming row of its key is strictly newer
    (``UPDATE``), otherwise kept (``KEEP``); incoming rows of unknown keys are
    added (``INSERT``). Incoming rows with a NULL in the key match nothing and
    are all added.

    ``stage`` may write the reduced incoming rows to a table first; a small delta
    is then broadcast and the stored rows are not shuffled at all. ``cluster_by``
    groups the added rows by a column before they are written; stored rows already
    come from files grouped that way.
    """
    columns = stored.columns
    incoming = incoming.select(columns)
    fresh = unique_source(incoming, keys, order, on_duplicate)
    if stage:
        fresh = stage(fresh)
    offered = fresh.select(*keys, F.struct(*columns).alias("_new"))
    matched = stored.join(offered, list(keys), "left")
    newer = F.coalesce(F.col(f"_new.{time}") > F.col(time), F.lit(False))
    # Keys are equal on both sides, so they stay plain columns: filters on them
    # reach the scan, and only the columns that are asked for are read.
    kept = matched.select(
        *[
            F.col(c) if c in keys else F.when(newer, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
            for c in columns
        ],
        F.when(newer, "UPDATE").otherwise("KEEP").alias("merge_action"),
    )
    # Keys only: which incoming keys are stored already.
    known = _distinct_keys(
        stored.select(*keys).join(fresh.select(*keys), list(keys), "left_semi"), keys
    )
    added = (
        fresh.join(known, list(keys), "left_anti")
        .select(columns)
        .unionByName(incoming.filter(~complete(keys)))
        .withColumn("merge_action", F.lit("INSERT"))
    )
    if cluster_by:
        added = added.hint("rebalance", cluster_by)
    return kept.unionByName(added)


def effective_changes(
    stored: DataFrame,
    fresh: DataFrame,
    keys: Sequence[str] = KEY,
    time: str = CAPTURE_TIME,
) -> DataFrame:
    """Rows of ``fresh`` that change ``stored``, with ``merge_action``.

    ``fresh`` has one row per complete key. A row of an unknown key, or with a NULL
    in its key, is an ``INSERT``; one that is newer than the stored row an
    ``UPDATE``; others change nothing and are left out. Only keys and times of the
    stored rows are read, and those that match are few before they are joined back.
    """
    matched = stored.select(*keys, F.col(time).alias("_had")).join(
        fresh.select(*keys), list(keys), "left_semi"
    )
    had = matched.groupBy(F.struct(*keys).alias("_key")).agg(
        F.max("_had").alias("_had"), F.lit(True).alias("_known")
    )
    joined = fresh.join(had.select("_key.*", "_had", "_known"), list(keys), "left")
    newer = F.coalesce(F.col(time) > F.col("_had"), F.lit(False))
    action = F.when(F.col("_known").isNull(), "INSERT").when(newer, "UPDATE")
    return joined.select(*fresh.columns, action.alias("merge_action")).filter(
        "merge_action IS NOT NULL"
    )


def apply_changes(
    stored: DataFrame, changed: DataFrame, keys: Sequence[str] = KEY
) -> DataFrame:
    """``stored`` with the rows of :func:`effective_changes` in place of their own."""
    return (
        stored.join(changed.select(*keys), list(keys), "left_anti")
        .select(stored.columns)
        .unionByName(changed.select(stored.columns))
    )


def _distinct_keys(joined: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of a join's result.

    Grouping by one struct of the keys asks for a partitioning the join does not
    have. That adds an exchange of already distinct keys, and leaves Spark free to
    split a skewed key of the join, which it may not do when the join's own
    partitioning serves the aggregation.
    """
    return joined.select(F.struct(*keys).alias("_key")).distinct().select("_key.*")


def _reapable(claimed: Sequence[str]) -> Column:
    """Rows the key listing has authority over: those of unclaimed types. With
    claims, a NULL type is neither claimed nor unclaimed and stays."""
    if not claimed:
        return F.lit(True)
    return F.coalesce(~F.col("resourceType").isin(list(claimed)), F.lit(False))


def missing_keys(
    stored: DataFrame, identifiers: DataFrame, claimed: Sequence[str] = ()
) -> DataFrame:
    """Distinct keys of stored rows the listing no longer has. Reads three columns."""
    unlisted = (
        stored.select(*KEY)
        .filter(_reapable(claimed))
        .join(identifiers.select(*KEY), KEY, "left_anti")
    )
    return _distinct_keys(unlisted, KEY)


def reap_missing(
    stored: DataFrame,
    identifiers: DataFrame,
    claimed: Sequence[str] = (),
    stage: Stage | None = None,
) -> DataFrame:
    """``stored`` without the rows whose key is absent from ``identifiers``.

    Rows of claimed types are kept: another source owns them.

    The listing is as long as the spine has keys. With ``stage`` the missing keys
    are found from the key columns alone and written to a table; being few, they
    are then broadcast, and the wide rows are not shuffled.
    """
    if stage:
        return without_keys(stored, stage(missing_keys(stored, identifiers, claimed)))
    reapable = _reapable(claimed)
    listed = stored.filter(reapable).join(identifiers.select(*KEY), KEY, "left_semi")
    if not claimed:
        return listed.select(stored.columns)
    return listed.select(stored.columns).unionByName(stored.filter(~reapable))


def without_keys(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """``stored`` without the rows of the given keys; here NULL parts do match."""
    same = reduce(lambda a, b: a & b, [stored[k].eqNullSafe(keys[k]) for k in KEY])
    return stored.join(keys, same, "left_anti")


def merge_counts(merged: DataFrame, reaped: DataFrame | None = None) -> DataFrame:
    """Rows per merge action; ``reaped`` are the keys removed by the listing."""
    actions = merged.select("merge_action")
    if reaped is not None:
        actions = actions.unionByName(
            reaped.select(F.lit("DELETE").alias("merge_action"))
        )
    return actions.groupBy("merge_action").agg(F.count("*").alias("n"))


def land_merge(
    stored: DataFrame, fetched: DataFrame, keys: Sequence[str] = KEY
) -> DataFrame:
    """Replace stored rows of fetched keys whatever their age, add the new keys
    and delete nothing."""
    columns = stored.columns
    fetched = fetched.select(columns)
    fresh = unique_source(fetched, keys)
    return (
        stored.join(fresh.select(*keys), list(keys), "left_anti")
        .select(columns)
        .unionByName(fresh)
        .unionByName(fetched.filter(~complete(keys)))
    )


def land_authoritative(
    stored: DataFrame, fetched: DataFrame, claimed: Sequence[str]
) -> DataFrame:
    """Replace all rows of the claimed types by the fetched ones, in one step.

    No fetched rows means the types are empty now, and their rows go.
    """
    gone = F.coalesce(F.col("resourceType").isin(list(claimed)), F.lit(False))
    return stored.filter(~gone).unionByName(fetched.select(stored.columns))


def keyed_replace(
    stored: DataFrame, incoming: DataFrame, key: str, version: str | None = None
) -> DataFrame:
    """Insert rows, replacing those with the same primary key."""
    incoming = incoming.select(stored.columns)
    fresh = unique_source(incoming, [key], [version] if version else [])
    return (
        stored.join(fresh.select(key), key, "left_anti")
        .select(stored.columns)
        .unionByName(fresh)
    )


def stale_versions(
    listing: DataFrame, stored: DataFrame, key: str = "arn", version: str = "defaultVersionId"
) -> DataFrame:
    """Listed versions that are not stored: new keys and changed versions."""
    return listing.join(stored.select(key, version), [key, version], "left_anti")


def accounts_refresh(
    accounts: DataFrame, spine: DataFrame, listed: DataFrame | None
) -> DataFrame:
    """Accounts after a build: exactly those on the spine.

    A listed name replaces the stored one; where no name is listed the stored one
    stays. ``listed`` is None when names were not fetched.
    """
    ids = spine.select("accountId").filter(F.col("accountId").isNotNull()).distinct()
    old = accounts.select("accountId", F.col("accountName").alias("_old"))
    out = ids.join(old, "accountId", "left")
    if listed is None:
        return out.select("accountId", F.col("_old").alias("accountName"))
    new = listed.groupBy("accountId").agg(F.max("accountName").alias("_new"))
    return out.join(new, "accountId", "left").select(
        "accountId", F.coalesce("_new", "_old").alias("accountName")
    )


def incremental_cutoff(
    stored: DataFrame, claimed: Sequence[str] = (), overlap: timedelta = timedelta(days=1)
) -> DataFrame:
    """One row, ``cutoff``: newest capture of unclaimed types minus the overlap.

    NULL means "fetch everything". Claimed rows carry the time they were fetched
    at, which says nothing about what the recorder has seen since.
    """
    return (
        stored.filter(_reapable(claimed))
        .agg(F.max(CAPTURE_TIME).alias("newest"))
        .select((F.col("newest") - F.lit(overlap)).alias("cutoff"))
    )


def claim_collisions(recorded: DataFrame, claimed: Sequence[str]) -> DataFrame:
    """Recorded types that a source claims as well."""
    return (
        recorded.select("resourceType")
        .filter(F.col("resourceType").isin(list(claimed)))
        .distinct()
    )


def check_claims(recorded: DataFrame, claimed: Sequence[str]) -> None:
    """Raise when a claimed type is recorded: landing would delete recorded rows."""
    if not claimed:
        return
    hits = sorted(r.resourceType for r in claim_collisions(recorded, claimed).collect())
    if hits:
        raise ValueError(
            "resource types are recorded and also claimed by a source: " + ", ".join(hits)
        )
