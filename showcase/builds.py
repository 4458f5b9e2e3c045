"""Whole builds, versions of the spine and the change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from showcase.common import BRIEF_SQL, accounts, brief, changes, time_text
from showcase.fixtures import DELTA_SINCE, spine_fixture
from showcase.registry import query
from tallyhouse.operators.merge import latest_per_key
from tallyhouse.plans.inventory import SNAPSHOTS, BuildInputs, BuildSettings, Inventory
from tallyhouse.plans.query import Query
from tallyhouse.plans.transforms import CustomTable, sql_transform
from tallyhouse.plans import builtin
from tallyhouse.schemas import CAPTURE_TIME, KEY, STATE_ID
from tallyhouse.sources.store import work_folder
from tallyhouse.streaming.feed import ChangeFeed, latest_state
from tallyhouse.streaming.live import UPSERT, live_changes, use_rocksdb

#: What the second build of the day brings: changes of one type only.
_ONE_TYPE = "Demo::App::error"


def _inventory(spark: SparkSession) -> Inventory:
    return Inventory(spark, f"{work_folder(spark)}/inventory")


def _first_build(spark: SparkSession, d: str) -> Inventory:
    inventory = _inventory(spark)
    stored = spine_fixture(spark, d, "fx_stored")
    inventory.build(BuildInputs(items=stored, identifiers=stored.select(*KEY), accounts=accounts(spark, d)))
    return inventory


_ONE_TYPE_SQL = f"""
later AS (
    SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY accountId, resourceType, resourceId
                                     ORDER BY captureTime DESC, stateId DESC) AS rn
        FROM fx_changes WHERE resourceType = '{_ONE_TYPE}' AND captureTime > timestamp '{DELTA_SINCE}'
    ) WHERE rn = 1
), now AS (
    SELECT s.* FROM fx_stored s LEFT JOIN later l USING (accountId, resourceType, resourceId)
    WHERE l.accountId IS NULL OR l.captureTime <= s.captureTime
    UNION ALL
    SELECT l.* FROM later l LEFT JOIN fx_stored s USING (accountId, resourceType, resourceId)
    WHERE s.accountId IS NULL OR l.captureTime > s.captureTime
)"""


@query(
    "build_incremental",
    f"""WITH {_ONE_TYPE_SQL}
        SELECT lower(replace(resourceType, '::', '_')) AS name, count(*) AS n,
               max({{time}}) AS newest,
               CASE WHEN resourceType = '{_ONE_TYPE}' THEN 'written' ELSE 'unchanged' END AS status
        FROM now GROUP BY resourceType""".replace(
        "{time}", "strftime(captureTime, '%Y-%m-%d %H:%M:%S.%f')"
    ),
)
def build_incremental(spark, d):
    """A second build whose items touch one type: only that type is written."""
    inventory = _first_build(spark, d)
    delta = changes(spark, d).filter(F.col("resourceType") == _ONE_TYPE)
    listed = inventory.spine().select(*KEY).unionByName(delta.select(*KEY))
    report = inventory.build(BuildInputs(items=delta, identifiers=listed))
    status = report.status("table")
    out = None
    for name in sorted(n for n in status if n.startswith("demo_")):
        rows = inventory.table(name).agg(
            F.lit(name).alias("name"),
            F.count("*").alias("n"),
            time_text(F.max(CAPTURE_TIME)).alias("newest"),
            F.lit(status[name]).alias("status"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@query("build_snapshots", f"SELECT {BRIEF_SQL} FROM fx_delta_latest")
def build_snapshots(spark, d):
    """A snapshots build replaces all that an earlier build has stored."""
    inventory = _first_build(spark, d)
    rows = spine_fixture(spark, d, "fx_delta_latest")
    inventory.build(BuildInputs(snapshots=rows), BuildSettings(mode=SNAPSHOTS))
    return brief(inventory.spine())


_ALL_MERGED = """
WITH merged AS (
    SELECT s.* FROM fx_stored s LEFT JOIN fx_delta_latest l USING (accountId, resourceType, resourceId)
    WHERE l.accountId IS NULL OR l.captureTime <= s.captureTime
    UNION ALL
    SELECT l.* FROM fx_delta_latest l LEFT JOIN fx_stored s USING (accountId, resourceType, resourceId)
    WHERE s.accountId IS NULL OR l.captureTime > s.captureTime
)"""


def _fed(spark, d) -> tuple[Inventory, ChangeFeed]:
    """A stored spine and four waiting batches, of which later ones hold older rows."""
    inventory = _inventory(spark)
    inventory.resources.replace(spine_fixture(spark, d, "fx_stored"), inventory.resources.current())
    feed = ChangeFeed(inventory.store)
    delta = spine_fixture(spark, d, "fx_delta")
    for n in range(4):
        feed.append(delta.filter(F.pmod(F.xxhash64("arn"), F.lit(4)) == n), n)
    return inventory, feed


@query("feed_current", f"{_ALL_MERGED} SELECT {BRIEF_SQL} FROM merged")
def feed_current(spark, d):
    return brief(_fed(spark, d)[1].current())


@query("feed_compact", f"{_ALL_MERGED} SELECT {BRIEF_SQL}, 4 AS batches, 0 AS waiting FROM merged")
def feed_compact(spark, d):
    """After a compaction, with one batch delivered again: the same rows, none waiting."""
    inventory, feed = _fed(spark, d)
    batches = feed.compact()
    feed.append(spine_fixture(spark, d, "fx_delta"), 3)
    waiting = len(feed.batches())
    return brief(inventory.spine(), F.lit(batches).alias("batches"), F.lit(waiting).alias("waiting"))


@query(
    "stream_latest",
    f"""SELECT {BRIEF_SQL} FROM fx_changes
        QUALIFY row_number() OVER (PARTITION BY accountId, resourceType, resourceId
                                   ORDER BY captureTime DESC, stateId DESC) = 1""",
)
def stream_latest(spark, d):
    """All changes as a stream of files, run until nothing is left."""
    folder = work_folder(spark)
    changes(spark, d).write.partitionBy("awsRegion").parquet(f"{folder}/landing")
    landed = spark.read.parquet(f"{folder}/landing").schema
    items = spark.readStream.schema(landed).option("maxFilesPerTrigger", 3).parquet(f"{folder}/landing")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={number}")

    (
        latest_state(items).writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        .start().awaitTermination()
    )
    # The last update of a key is its state.
    updates = spark.read.option("basePath", f"{folder}/updates").parquet(f"{folder}/updates")
    return brief(latest_per_key(updates, order=("batch",)).drop("batch"))


@query(
    "stream_live",
    f"""SELECT {BRIEF_SQL} FROM (
            SELECT * FROM fx_changes
            QUALIFY row_number() OVER (PARTITION BY accountId, resourceType, resourceId
                                       ORDER BY captureTime DESC, stateId DESC) = 1)
        WHERE right(stateId, 1) NOT IN ('0', '5')""",
)
def stream_live(spark, d):
    """All changes as a stream in which some delete their key."""
    folder = work_folder(spark)
    changes(spark, d).write.partitionBy("awsRegion").parquet(f"{folder}/landing")
    landed = spark.read.parquet(f"{folder}/landing").schema
    items = spark.readStream.schema(landed).option("maxFilesPerTrigger", 5).parquet(f"{folder}/landing")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={number}")

    use_rocksdb(spark)
    # The landing folder is in no order of time, so rows may be late by any time.
    live = live_changes(items, F.right(F.col(STATE_ID), F.lit(1)).isin("0", "5"), late="36500 days")
    (
        live.writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        .start().awaitTermination()
    )
    updates = spark.read.option("basePath", f"{folder}/updates").parquet(f"{folder}/updates")
    newest = latest_per_key(updates, order=("batch",))
    return brief(newest.filter(F.col("change") == UPSERT).drop("batch", "change"))


@query("q_sql_join_tables", """
    SELECT a.accountName, e.n, t.resources FROM (
        SELECT accountId, count(*) AS n FROM fx_stored WHERE resourceType = 'Demo::App::error' GROUP BY accountId) e
    LEFT JOIN (SELECT accountId, accountName FROM fx_accounts) a ON a.accountId = e.accountId
    LEFT JOIN (SELECT accountId, count(*) AS resources FROM fx_stored GROUP BY accountId) t ON t.accountId = e.accountId
""")
def q_sql_join_tables(spark, d):
    """User SQL over a derived table, the accounts and the spine of a built inventory."""
    inventory = _first_build(spark, d)
    return inventory.query(Query(sql="""
        SELECT a.accountName, e.n, t.resources
        FROM (SELECT accountId, count(*) AS n FROM demo_app_error GROUP BY accountId) e
        LEFT JOIN accounts a ON a.accountId = e.accountId
        LEFT JOIN (SELECT accountId, count(*) AS resources FROM resources GROUP BY accountId) t
          ON t.accountId = e.accountId"""))


@query("custom_on_custom", """
    SELECT 'Custom::Busy' AS resourceType, max(n) AS most, count(*) AS accounts FROM (
        SELECT accountId, count(*) AS n FROM fx_stored WHERE resourceType = 'Demo::App::click' GROUP BY accountId)
""")
def custom_on_custom(spark, d):
    """A custom table over another one that is defined after it."""
    inventory = _inventory(spark)
    stored = spine_fixture(spark, d, "fx_stored")
    inventory.build(
        BuildInputs(items=stored, identifiers=stored.select(*KEY)),
        BuildSettings(
            custom_tables=[
                CustomTable("Custom::Busy", "SELECT max(n) AS most, count(*) AS accounts FROM custom_clicks", ["custom_clicks"]),
                CustomTable("Custom::Clicks", "SELECT accountId, count(*) AS n FROM demo_app_click GROUP BY accountId", ["demo_app_click"]),
            ]
        ),
    )
    return inventory.table("custom_busy")


@query("t_with_accounts", """
    SELECT c.resourceId, c.accountId, a.accountName AS owner, k.n AS siblings
    FROM fx_stored c
    LEFT JOIN (SELECT accountId, accountName FROM fx_accounts) a ON a.accountId = c.accountId
    JOIN (SELECT accountId, count(*) AS n FROM fx_stored GROUP BY accountId) k ON k.accountId = c.accountId
    WHERE c.resourceType = 'Demo::App::click'
""")
def t_with_accounts(spark, d):
    """A transform that reads the accounts and the whole spine beside its own table."""
    inventory = _inventory(spark)
    stored = spine_fixture(spark, d, "fx_stored")
    owner = sql_transform(
        "owner",
        "demo_app_click",
        """SELECT c.*, a.accountName AS owner, k.n AS siblings FROM {table} c
           LEFT JOIN accounts a ON a.accountId = c.accountId
           JOIN (SELECT accountId, count(*) AS n FROM resources GROUP BY accountId) k ON k.accountId = c.accountId""",
        dependencies=["demo_app_click", "accounts", "resources"],
    )
    inventory.build(
        BuildInputs(items=stored, identifiers=stored.select(*KEY), accounts=accounts(spark, d)),
        BuildSettings(registry=builtin.default_registry(user=[owner])),
    )
    return inventory.table("demo_app_click").select("resourceId", "accountId", "owner", "siblings")
