"""Sources, upserts, reaping and the counts around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from showcase.common import BRIEF_SQL, accounts, brief, changes, time_text
from showcase.fixtures import DELTA_SINCE, fixture, spine_fixture
from showcase.registry import query
from tallyhouse.operators import counts, merge
from tallyhouse.operators.tree import hierarchy_paths
from tallyhouse.schemas import CAPTURE_TIME, SPINE
from tallyhouse.sources import items as item_source
from tallyhouse.sources.contract import source_rows_to_spine
from tallyhouse.sources.organization import unit_rows
from tallyhouse.sources.results import json_lines
from tallyhouse.sources.snapshots import latest_snapshots, read_latest_snapshots
from tallyhouse.sources.store import Files, work_folder

_CLAIMED = "Demo::App::signup"


def _stored(spark, d):
    return spine_fixture(spark, d, "fx_stored")


def _delta(spark, d):
    return spine_fixture(spark, d, "fx_delta")


# -- reading -----------------------------------------------------------------


@query("src_items", f"SELECT {BRIEF_SQL} FROM fx_changes")
def src_items(spark, d):
    """Written as JSON lines in staging form by Spark, then read as items."""
    path = f"{work_folder(spark)}/items"
    staged = changes(spark, d).withColumn("tags", F.map_entries("tags"))
    staged.write.json(path, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return brief(item_source.read_items(spark, path))


@query("src_identifiers", "SELECT accountId, resourceType, resourceId FROM fx_identifiers")
def src_identifiers(spark, d):
    path = f"{work_folder(spark)}/identifiers"
    fixture(spark, d, "fx_identifiers").write.json(path)
    return item_source.read_identifiers(spark, path)


@query(
    "latest_snapshot",
    """WITH days AS (SELECT accountId, awsRegion, dayNumber, max(path) AS path, count(*) AS objectsThatDay
                     FROM fx_snapshot GROUP BY accountId, awsRegion, dayNumber)
       SELECT accountId, awsRegion, path, objectsThatDay FROM days
       QUALIFY row_number() OVER (PARTITION BY accountId, awsRegion ORDER BY dayNumber DESC) = 1""",
)
def latest_snapshot(spark, d):
    return latest_snapshots(fixture(spark, d, "fx_snapshot")).drop("day")


#: Day folders of the demo snapshots; the newest is not the last by name.
_DAY = "CASE WHEN day(captureTime) < 10 THEN 9 WHEN day(captureTime) < 20 THEN 10 ELSE 20 END"


@query(
    "src_snapshots",
    f"""WITH days AS (SELECT *, {_DAY} AS snapshotDay FROM fx_changes)
        SELECT {BRIEF_SQL} FROM days
        QUALIFY snapshotDay = max(snapshotDay) OVER (PARTITION BY accountId, awsRegion)""",
)
def src_snapshots(spark, d):
    """Three days of compressed snapshot documents for each account and region, of
    which the newest there are found and read. A document is one file whose lines
    are its head, its items and its end."""
    folder = work_folder(spark)
    rows = changes(spark, d).withColumn("at", F.col(CAPTURE_TIME)).withColumn("snapshotDay", F.expr(_DAY.replace("captureTime", "at")))
    place = ["accountId", "awsRegion", "snapshotDay"]
    documents = [F.col(c) for c in ("configuration", "supplementaryConfiguration")]
    scalars = F.to_json(
        F.struct(*[c for c in SPINE.names if c not in ("configuration", "supplementaryConfiguration")]),
        {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"},
    )
    item = F.concat(
        F.expr("left(scalars, length(scalars) - 1)"),
        F.lit(',"configuration":'), documents[0],
        F.lit(',"supplementaryConfiguration":'), documents[1], F.lit("}"),
    )
    items = rows.withColumn("scalars", scalars).select(*place, F.lit(1).alias("part"), F.concat(F.lit(","), item).alias("value"))
    head = '{"fileVersion":"1.0","note":"a } b","configurationItems":['
    # The empty item in front lets every other one begin with a comma.
    blank = '{"resourceId":"blank"}'
    ends = rows.select(*place).distinct().select(
        *place, F.inline(F.array(
            F.struct(F.lit(0).alias("part"), F.lit(head + blank).alias("value")),
            F.struct(F.lit(2).alias("part"), F.lit("]}").alias("value")),
        )),
    )
    (
        items.unionByName(ends).repartition(*place).sortWithinPartitions(*place, "part")
        .drop("part").write.partitionBy(*place).option("compression", "gzip").text(f"{folder}/written")
    )
    files = Files(spark)
    for account in files.folders(f"{folder}/written"):
        for region in files.folders(f"{folder}/written/{account}"):
            for day in files.folders(f"{folder}/written/{account}/{region}"):
                names = [n.partition("=")[2] for n in (account, region, day)]
                files.rename(
                    f"{folder}/written/{account}/{region}/{day}",
                    f"{folder}/AWSLogs/{names[0]}/Config/{names[1]}/2024/1/{names[2]}/ConfigSnapshot",
                )
    return brief(read_latest_snapshots(spark, folder).filter("resourceId <> 'blank'"))


@query(
    "tags_map",
    "SELECT arn, nameTag AS name, awsRegion AS env, 2 AS n FROM fx_changes",
)
def tags_map(spark, d):
    entries = F.array(
        F.struct(F.lit("Name").alias("key"), F.col("nameTag").alias("value")),
        F.struct(F.lit("env").alias("key"), F.col("awsRegion").alias("value")),
    )
    tagged = fixture(spark, d, "fx_changes").withColumn("tags", item_source.tags_map(entries))
    return tagged.select(
        "arn", F.col("tags")["Name"].alias("name"), F.col("tags")["env"].alias("env"), F.size("tags").alias("n")
    )


@query(
    "tags_sanitize",
    """SELECT resourceId, CASE WHEN tagsJson LIKE '[%' THEN 2 WHEN tagsJson IS NOT NULL THEN 0 END AS n,
              CASE WHEN tagsJson LIKE '[%' THEN json_extract_string(tagsJson, '$[0].value') END AS first
       FROM fx_raw_item""",
)
def tags_sanitize(spark, d):
    tags = item_source.sanitized_tags(F.col("tagsJson"))
    return fixture(spark, d, "fx_raw_item").select(
        "resourceId", F.size(tags).alias("n"), F.get(tags, F.lit(0))["value"].alias("first")
    )


@query(
    "normalize_item",
    """SELECT resourceId, CASE WHEN json_valid(configuration) THEN configuration ELSE '"' || configuration || '"' END AS configuration,
              CASE WHEN supplement IS NULL THEN NULL ELSE json_extract_string(supplement, '$.x') END AS x,
              plain, CASE WHEN supplement IS NULL THEN 0 ELSE 2 END AS n
       FROM fx_raw_item""",
)
def normalize_item(spark, d):
    raw = fixture(spark, d, "fx_raw_item")
    supplement = F.map_filter(
        F.create_map(F.lit("json"), F.col("supplement"), F.lit("text"), F.col("plain")),
        lambda _, __: F.col("supplement").isNotNull(),
    )
    fetched = raw.withColumn("supplementaryConfiguration", supplement)
    rows = item_source.normalized_items(fetched)
    supplementary = F.col("supplementaryConfiguration")
    return (
        rows.join(raw.select("resourceId", "plain"), "resourceId")
        .select(
            "resourceId",
            "configuration",
            F.get_json_object(supplementary, "$.json.x").alias("x"),
            F.coalesce(F.get_json_object(supplementary, "$.text"), "plain").alias("plain"),
            F.size(F.map_keys(F.from_json(supplementary, "map<string,string>"))).alias("n"),
        )
    )


@query(
    "changed_since",
    f"SELECT {BRIEF_SQL} FROM fx_changes WHERE captureTime > timestamp '{DELTA_SINCE}'",
)
def changed_since(spark, d):
    return brief(item_source.changed_since(changes(spark, d), F.lit(DELTA_SINCE).cast("timestamp")))


@query(
    "changed_since_nullable",
    f"""SELECT {BRIEF_SQL} FROM fx_changes
        WHERE nameTag IS NOT NULL AND captureTime > timestamp '{DELTA_SINCE}'""",
)
def changed_since_nullable(spark, d):
    """Records without a capture time are left out once there is a cutoff."""
    tag = F.try_element_at("tags", F.lit("Name"))
    some = changes(spark, d).withColumn(CAPTURE_TIME, F.when(tag.isNotNull(), F.col(CAPTURE_TIME)))
    return brief(item_source.changed_since(some, F.lit(DELTA_SINCE).cast("timestamp")))


@query(
    "ou_rows",
    """SELECT 'arn:ou:' || t.id AS arn, '000000000001' AS accountId, 'global' AS awsRegion,
              'AWS::Organizations::OrganizationalUnit' AS resourceType, t.id AS resourceId,
              t.name AS resourceName, t.parentId, c.c_mktsegment AS segment,
              CASE WHEN c.c_custkey IS NULL THEN 0 ELSE 2 END AS n, '{}' AS supplementaryConfiguration
       FROM fx_tree t LEFT JOIN customer c ON t.id = 'ou-c' || cast(c.c_custkey AS string)""",
)
def ou_rows(spark, d):
    units = fixture(spark, d, "fx_tree").withColumn("arn", F.concat(F.lit("arn:ou:"), "id"))
    customers = spark.read.parquet(f"{d}/customer.parquet")
    unit = F.concat(F.lit("ou-c"), F.col("c_custkey").cast("string")).alias("unitId")
    tags = customers.select(
        unit, F.lit("segment").alias("key"), F.col("c_mktsegment").alias("value")
    ).union(customers.select(unit, F.lit("name"), F.col("c_name")))
    at = F.lit("2026-07-17 12:00:00").cast("timestamp")
    rows = source_rows_to_spine(unit_rows(units, tags, "000000000001", at))
    return rows.select(
        "arn", "accountId", "awsRegion", "resourceType", "resourceId", "resourceName",
        F.get_json_object("configuration", "$.ParentId").alias("parentId"),
        F.col("tags")["segment"].alias("segment"),
        F.size("tags").alias("n"),
        "supplementaryConfiguration",
    )


@query(
    "fetched_to_spine",
    f"""SELECT {BRIEF_SQL.replace('stateId', 'cast(NULL AS varchar) AS stateId')}, configuration, '{{}}' AS supplementaryConfiguration,
               0 AS links FROM fx_changes""",
)
def fetched_to_spine(spark, d):
    entry = F.struct(F.lit("Name").alias("key"), F.col("nameTag").alias("value"))
    rows = fixture(spark, d, "fx_changes").withColumn("capturedAt", F.col("captureTime").cast("timestamp")).withColumn("tags", F.array(entry))
    return brief(
        source_rows_to_spine(rows), "configuration", "supplementaryConfiguration", F.size("relationships").alias("links")
    )


@query(
    "fmt_ndjson",
    """SELECT '{"resourceId":"' || resourceId || '","resourceName":'
              || CASE WHEN resourceName IS NULL THEN 'null' ELSE '"' || resourceName || '"' END
              || ',"awsRegion":"' || awsRegion || '"}' AS line FROM fx_changes""",
)
def fmt_ndjson(spark, d):
    return json_lines(changes(spark, d).select("resourceId", "resourceName", "awsRegion"))


# -- keeping the spine current -----------------------------------------------

_LATEST_SQL = f"""SELECT {BRIEF_SQL} FROM (
    SELECT *, row_number() OVER (PARTITION BY accountId, resourceType, resourceId
                                 ORDER BY captureTime DESC, stateId DESC) AS rn FROM fx_changes) x WHERE rn = 1"""


@query("latest_per_key", _LATEST_SQL)
def latest_per_key(spark, d):
    return brief(merge.latest_per_key(changes(spark, d)))


_MERGED = """
merged AS (
    SELECT CASE WHEN n.captureTime > o.captureTime THEN n.arn ELSE o.arn END AS arn,
           o.accountId, o.resourceType, o.resourceId,
           CASE WHEN n.captureTime > o.captureTime THEN n.resourceName ELSE o.resourceName END AS resourceName,
           CASE WHEN n.captureTime > o.captureTime THEN n.stateId ELSE o.stateId END AS stateId,
           CASE WHEN n.captureTime > o.captureTime THEN n.nameTag ELSE o.nameTag END AS nameTag,
           CASE WHEN n.captureTime > o.captureTime THEN n.captureTime ELSE o.captureTime END AS captureTime,
           CASE WHEN n.captureTime > o.captureTime THEN 'UPDATE' ELSE 'KEEP' END AS merge_action
    FROM fx_stored o LEFT JOIN fx_delta_latest n
      ON o.accountId = n.accountId AND o.resourceType = n.resourceType AND o.resourceId = n.resourceId
    UNION ALL
    SELECT n.arn, n.accountId, n.resourceType, n.resourceId, n.resourceName, n.stateId, n.nameTag, n.captureTime, 'INSERT'
    FROM fx_delta_latest n ANTI JOIN fx_stored o USING (accountId, resourceType, resourceId))"""


@query("upsert_newer", f"WITH {_MERGED} SELECT {BRIEF_SQL}, merge_action FROM merged")
def upsert_newer(spark, d):
    return brief(merge.upsert_newer(_stored(spark, d), _delta(spark, d)), "merge_action")


_DOOMED = f"""
doomed AS (
    SELECT * FROM fx_stored o ANTI JOIN fx_identifiers i USING (accountId, resourceType, resourceId)
    WHERE o.resourceType <> '{_CLAIMED}')"""


@query(
    "reap_missing",
    f"""SELECT {BRIEF_SQL} FROM fx_stored o WHERE o.resourceType = '{_CLAIMED}'
        UNION ALL
        SELECT {BRIEF_SQL} FROM fx_stored o SEMI JOIN fx_identifiers i USING (accountId, resourceType, resourceId)
        WHERE o.resourceType <> '{_CLAIMED}'""",
)
def reap_missing(spark, d):
    listed = fixture(spark, d, "fx_identifiers")
    return brief(merge.reap_missing(_stored(spark, d), listed, [_CLAIMED]))


@query(
    "merge_counts",
    f"""WITH {_MERGED}, {_DOOMED}
        SELECT merge_action, count(*) AS n FROM
          (SELECT merge_action FROM merged UNION ALL SELECT 'DELETE' FROM doomed) x GROUP BY merge_action""",
)
def merge_counts(spark, d):
    stored = _stored(spark, d)
    merged = merge.upsert_newer(stored, _delta(spark, d))
    missing = merge.missing_keys(stored, fixture(spark, d, "fx_identifiers"), [_CLAIMED])
    return merge.merge_counts(merged, missing)


@query(
    "land_merge",
    f"""SELECT {BRIEF_SQL} FROM fx_stored o ANTI JOIN fx_delta_latest n USING (accountId, resourceType, resourceId)
        UNION ALL SELECT {BRIEF_SQL} FROM fx_delta_latest""",
)
def land_merge(spark, d):
    return brief(merge.land_merge(_stored(spark, d), _delta(spark, d)))


@query(
    "land_authoritative",
    f"""SELECT {BRIEF_SQL} FROM fx_stored WHERE resourceType NOT IN ('Demo::App::error', 'Demo::App::view')
        UNION ALL SELECT {BRIEF_SQL} FROM fx_delta_latest WHERE resourceType IN ('Demo::App::error', 'Demo::App::view')""",
)
def land_authoritative(spark, d):
    claimed = ["Demo::App::error", "Demo::App::view"]
    rows = spine_fixture(spark, d, "fx_delta_latest").filter(F.col("resourceType").isin(claimed))
    return brief(merge.land_authoritative(_stored(spark, d), rows, claimed))


@query(
    "empty_landing",
    f"SELECT {BRIEF_SQL} FROM fx_stored WHERE resourceType <> 'Demo::App::error'",
)
def empty_landing(spark, d):
    """An authoritative source without rows clears its types."""
    nothing = spark.createDataFrame([], _stored(spark, d).schema)
    return brief(merge.land_authoritative(_stored(spark, d), nothing, ["Demo::App::error"]))


@query(
    "claims_released",
    f"SELECT {BRIEF_SQL} FROM fx_stored o SEMI JOIN fx_identifiers i USING (accountId, resourceType, resourceId)",
)
def claims_released(spark, d):
    """Without a claim the listing decides about every type."""
    return brief(merge.reap_missing(_stored(spark, d), fixture(spark, d, "fx_identifiers")))


@query(
    "cutoff",
    f"""SELECT strftime(max(captureTime) - INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S.%f') AS cutoff
        FROM fx_stored WHERE resourceType <> '{_CLAIMED}'""",
)
def cutoff(spark, d):
    return merge.incremental_cutoff(_stored(spark, d), [_CLAIMED]).select(time_text("cutoff").alias("cutoff"))


@query(
    "accounts_refresh",
    """SELECT i.accountId, coalesce(a.accountName, CASE WHEN a.accountId IS NOT NULL THEN 'old-' || a.accountId END) AS accountName
       FROM (SELECT DISTINCT accountId FROM fx_changes) i LEFT JOIN fx_accounts a ON i.accountId = a.accountId""",
)
def accounts_refresh(spark, d):
    listed = accounts(spark, d)
    old = listed.select("accountId", F.concat(F.lit("old-"), "accountId").alias("accountName"))
    return merge.accounts_refresh(old, changes(spark, d), listed)


# Stored policies know every second version; the listing has all.
_STORED_POLICY = """stored AS (SELECT arn, CASE WHEN managed = 1 THEN defaultVersionId ELSE 'v0' END AS defaultVersionId,
                               policyDocument FROM fx_policy WHERE policyDocument <> '{}')"""


def _policies(spark, d):
    listed = fixture(spark, d, "fx_policy")
    version = F.when(F.col("managed") == 1, F.col("defaultVersionId")).otherwise("v0")
    stored = listed.filter("policyDocument <> '{}'").select(
        "arn", version.alias("defaultVersionId"), "policyDocument"
    )
    return stored, listed.select("arn", "defaultVersionId", "policyDocument")


@query(
    "policy_stale",
    f"""WITH {_STORED_POLICY} SELECT l.arn, l.defaultVersionId FROM fx_policy l
        ANTI JOIN stored s USING (arn, defaultVersionId)""",
)
def policy_stale(spark, d):
    stored, listed = _policies(spark, d)
    return merge.stale_versions(listed.select("arn", "defaultVersionId"), stored)


@query(
    "policy_upsert",
    f"""WITH {_STORED_POLICY}, fresh AS (SELECT arn, defaultVersionId, policyDocument FROM fx_policy WHERE managed = 0)
        SELECT * FROM stored s ANTI JOIN fresh f USING (arn) UNION ALL SELECT * FROM fresh""",
)
def policy_upsert(spark, d):
    stored, _ = _policies(spark, d)
    fresh = fixture(spark, d, "fx_policy").filter("managed = 0").select(stored.columns)
    return merge.keyed_replace(stored, fresh, "arn", "defaultVersionId")


@query(
    "claim_collisions",
    "SELECT DISTINCT resourceType FROM fx_changes WHERE resourceType IN ('Demo::App::view', 'Demo::App::none')",
)
def claim_collisions(spark, d):
    return merge.claim_collisions(changes(spark, d), ["Demo::App::view", "Demo::App::none"])


# -- counts and listings -----------------------------------------------------


@query("type_counts", "SELECT resourceType, count(*) AS n FROM fx_changes GROUP BY resourceType")
def type_counts(spark, d):
    return counts.type_counts(changes(spark, d))


@query(
    "modified_counts",
    f"""SELECT resourceType, count(*) AS n FROM fx_changes
        WHERE captureTime > timestamp '{DELTA_SINCE}' GROUP BY resourceType""",
)
def modified_counts(spark, d):
    return counts.modified_counts(changes(spark, d), F.lit(DELTA_SINCE).cast("timestamp"))


@query("type_totals", "SELECT count(*) AS total FROM fx_changes")
def type_totals(spark, d):
    return counts.total(counts.type_counts(changes(spark, d)))


@query("distinct_types", "SELECT DISTINCT resourceType FROM fx_changes")
def distinct_types(spark, d):
    return counts.resource_types(changes(spark, d))


@query("distinct_regions", "SELECT DISTINCT awsRegion FROM fx_changes")
def distinct_regions(spark, d):
    return counts.distinct_regions(changes(spark, d))


@query(
    "resource_types_view",
    """SELECT resourceType FROM fx_changes UNION
       SELECT 'Custom::' || awsRegion FROM fx_changes UNION SELECT DISTINCT resourceType FROM fx_stored""",
)
def resource_types_view(spark, d):
    spine = changes(spark, d)
    custom = spine.select(F.concat(F.lit("Custom::"), "awsRegion").alias("resourceType"))
    return counts.resource_types(spine, custom)


@query(
    "unselectable_types",
    f"""SELECT DISTINCT resourceType FROM fx_changes EXCEPT
        SELECT resourceType FROM fx_changes WHERE configuration = '{{}}'""",
)
def unselectable_types(spark, d):
    spine = changes(spark, d)
    return counts.unselectable_types(spine, spine.filter("configuration = '{}'"))


# -- hierarchy ---------------------------------------------------------------


@query(
    "hierarchy_path",
    """WITH RECURSIVE unit(id, name, path, depth) AS (
         SELECT id, name, '/' || name, 1 FROM fx_tree WHERE parentId LIKE 'r-%'
         UNION ALL
         SELECT t.id, t.name, u.path || '/' || t.name, u.depth + 1 FROM fx_tree t JOIN unit u ON t.parentId = u.id)
       SELECT id, name, path, depth FROM unit""",
)
def hierarchy_path(spark, d):
    return hierarchy_paths(fixture(spark, d, "fx_tree"))
