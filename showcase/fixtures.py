"""Test tables in the shape of an inventory.

Each fixture is one SQL text that Spark and the oracle engine both accept, so the
two sides of a comparison start from the same rows. ``@table`` stands for a test
table; the oracle sees tables as views, Spark reads the parquet file by path.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.schemas import CAPTURE_TIME, SPINE
from tallyhouse.sources.items import spread

#: Types of the demo spine are ``Demo::App::<event type>``.
DEMO_TYPES = [f"Demo::App::{t}" for t in ("click", "error", "purchase", "signup", "view")]

_K = "k"
_CENTS = "cast(round(value * 100) AS bigint)"
_U = "cast(user_id AS string)"

FIXTURES: dict[str, str] = {}

# Change feed: one record per event. Configuration differs by type: nested
# objects, keys that collide with spine columns, empty objects.
FIXTURES["fx_changes"] = f"""
SELECT 'arn:demo:' || cast(event_id AS string) AS arn,
       lpad(cast(user_id % 30 AS string), 12, '0') AS accountId,
       'r-' || cast(user_id % 5 AS string) AS awsRegion,
       'Demo::App::' || event_type AS resourceType,
       'u-' || {_U} || '-' || cast(cast(floor({_K} / 10) AS bigint) AS string) AS resourceId,
       CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'user-' || {_U} END AS resourceName,
       ts AS captureTime,
       lpad(cast(event_id AS string), 12, '0') AS stateId,
       CASE WHEN user_id % 2 = 0 THEN 'tag-' || {_U} END AS nameTag,
       CASE event_type
         WHEN 'error' THEN '{{"k":' || cast({_K} AS string)
              || ',"state":{{"code":' || cast({_CENTS} AS string) || ',"name":"s-' || {_U} || '"}}'
              || ',"stateReason":{{"message":"m-' || {_U} || '"}}}}'
         WHEN 'purchase' THEN '{{"Tags":[{{"key":"team","value":"t-' || {_U} || '"}}],"arn":"inner-'
              || cast(event_id AS string) || '","cents":' || cast({_CENTS} AS string) || '}}'
         WHEN 'signup' THEN '{{"Content":{{"a":' || cast({_K} AS string) || ',"b":"x-' || {_U}
              || '"}},"ParentId":"p-' || {_U} || '"}}'
         WHEN 'view' THEN CASE WHEN {_K} < 10 THEN '{{}}'
              ELSE '{{"flag":true,"k":' || cast({_K} AS string) || '}}' END
         ELSE '{{"k":' || cast({_K} AS string) || '}}' END AS configuration,
       CASE WHEN event_type = 'click' THEN '{{"extra":"e-' || {_U} || '"}}' ELSE '{{}}' END
         AS supplementaryConfiguration
FROM (SELECT *, cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) AS k FROM @events) e"""

# Accounts: 25 of the 30 the change feed has, some without a name.
FIXTURES["fx_accounts"] = """
SELECT lpad(cast(n_nationkey AS string), 12, '0') AS accountId,
       CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_name END AS accountName
FROM @nation"""

_LATEST = """
SELECT arn, accountId, awsRegion, resourceType, resourceId, resourceName, captureTime,
       stateId, nameTag, configuration, supplementaryConfiguration
FROM (SELECT *, row_number() OVER (PARTITION BY accountId, resourceType, resourceId
                                   ORDER BY captureTime DESC, stateId DESC) AS rn
      FROM fx_changes WHERE {when}) x WHERE rn = 1"""

#: Spine before the build, and what arrives since shortly before its last record.
STORED_UNTIL = "2024-01-20 00:00:00"
DELTA_SINCE = "2024-01-18 23:00:00"
LISTED_SINCE = "2024-01-08 00:00:00"

FIXTURES["fx_stored"] = _LATEST.format(when=f"captureTime < timestamp '{STORED_UNTIL}'")
FIXTURES["fx_delta"] = f"""
SELECT * FROM fx_changes WHERE captureTime > timestamp '{DELTA_SINCE}'"""
FIXTURES["fx_delta_latest"] = _LATEST.format(
    when=f"captureTime > timestamp '{DELTA_SINCE}'"
)
# Keys that still exist: whatever was seen since the first week.
FIXTURES["fx_identifiers"] = f"""
SELECT DISTINCT accountId, resourceType, resourceId FROM fx_changes
WHERE captureTime >= timestamp '{LISTED_SINCE}'"""

FIXTURES["fx_policy"] = """
SELECT 'arn:pol:' || cast(p_partkey AS string) AS arn,
       'v' || cast(p_size AS string) AS defaultVersionId,
       CASE WHEN p_size % 3 = 0 THEN '{"Statement":{"Effect":"' || p_brand || '"}}'
            WHEN p_size % 3 = 1 THEN '{"Statement":[{"Effect":"' || p_brand || '"},{"Effect":"' || p_type || '"}]}'
            ELSE '{}' END AS policyDocument,
       p_partkey % 2 AS managed
FROM @part"""
FIXTURES["fx_role"] = """
SELECT 'arn:role:' || cast(o_orderkey AS string) AS arn,
       lpad(cast(o_custkey % 30 AS string), 12, '0') AS accountId,
       'g-' || cast(o_custkey % 40 AS string) || ',g-' || cast(o_orderkey % 40 AS string) AS groupNames
FROM @orders"""
FIXTURES["fx_attached"] = """
SELECT 'arn:role:' || cast(l_orderkey AS string) AS principal,
       'arn:pol:' || cast(l_partkey AS string) AS policyArn
FROM @lineitem"""
# A group per customer and account, with one policy each.
FIXTURES["fx_group"] = """
SELECT DISTINCT lpad(cast(c_custkey % 30 AS string), 12, '0') AS accountId,
       'g-' || cast(c_custkey % 40 AS string) AS groupName,
       '{"Effect":"' || c_mktsegment || '"}' AS statement
FROM @customer"""
# Units four levels deep: regions, nations, customers, orders.
FIXTURES["fx_tree"] = """
SELECT 'ou-r' || cast(r_regionkey AS string) AS id, r_name AS name, 'r-root' AS parentId FROM @region
UNION ALL SELECT 'ou-n' || cast(n_nationkey AS string), n_name, 'ou-r' || cast(n_regionkey AS string) FROM @nation
UNION ALL SELECT 'ou-c' || cast(c_custkey AS string), c_name, 'ou-n' || cast(c_nationkey AS string) FROM @customer
UNION ALL SELECT 'ou-o' || cast(o_orderkey AS string), o_orderpriority, 'ou-c' || cast(o_custkey AS string) FROM @orders"""
FIXTURES["fx_endpoint"] = """
SELECT 'vpce-' || cast(o_orderkey AS string) AS resourceId,
       'i-' || cast(o_custkey AS string) || ',i-' || cast(o_orderkey AS string) AS interfaceIds
FROM @orders"""
FIXTURES["fx_interface"] = """
SELECT 'i-' || cast(c_custkey AS string) AS resourceId, c_name AS privateIpAddress FROM @customer
UNION ALL SELECT 'i-' || cast(s_suppkey AS string), s_name FROM @supplier"""
# Managed instances: applications as object, array or null, updates with blanks,
# the instance's own entry under its id.
FIXTURES["fx_instance"] = """
SELECT 'mi-' || cast(p_partkey AS string) AS resourceId,
       '{"one":{"Name":"' || p_name || '","Version":"' || cast(p_size AS string)
         || '","InstalledTime":"2024-01-02T03:04:05Z","Epoch":' || cast(p_size AS string) || '},'
         || '"many":[{"Name":"' || p_brand || '","InstalledTime":""},{"Name":"' || p_type || '"}],"none":null,"text":"x"}'
         AS applications,
       '{"KB1":{"installedtime":"","description":"' || p_type || '","hotfixid":"","installedby":"' || p_brand || '"},'
         || '"KB2":{"installedtime":"2024-05-06T07:08:09Z","description":"","hotfixid":"h' || cast(p_size AS string) || '","installedby":""},"KB3":null}'
         AS updates,
       '{"mi-' || cast(p_partkey AS string) || '":{"AgentType":"' || p_brand || '","ComputerName":"' || p_name
         || '"},"mi-other":{"AgentType":"other","ComputerName":"other"}}' AS information
FROM @part"""
# Patch compliance: a summary entry and two patches; ids carry a fixed prefix.
FIXTURES["fx_compliance"] = """
SELECT 'AWS::SSM::ManagedInstanceInventory/i' || cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string) AS resourceId,
       '{"Content":{"Patch":{"ComplianceSummary":{"Status":"' || l_linestatus || '","PatchGroup":"g' || cast(l_linenumber AS string)
         || '","CompliantHighCount":' || cast(l_suppkey AS string) || ',"NonCompliantLowCount":"' || cast(l_linenumber AS string) || '"},'
         || '"KB' || cast(l_partkey AS string) || '":{"Id":"p' || cast(l_partkey AS string) || '","Title":"","Severity":"' || l_returnflag
         || '","PatchState":"Installed","InstalledTime":"2024-03-04T05:06:07Z","CVEIds":"c1,c' || cast(l_suppkey AS string) || '"},'
         || '"KBx":{"Id":"x","Title":"t' || cast(l_linenumber AS string) || '","InstalledTime":"","CVEIds":null}}}}' AS item
FROM @lineitem"""
FIXTURES["fx_topic"] = """
SELECT 'topic-' || cast(o_orderkey AS string) AS resourceId,
       '{"http":{"defaultHealthyRetryPolicy":{"numRetries":' || cast(o_custkey AS string)
         || ',"backoffFunction":"linear"},"disableSubscriptionOverrides":' || CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END
         || '}}' AS delivery,
       '{"Statement":{"Sid":"' || o_orderpriority || '"}}' AS policy,
       'arn:topic:' || cast(o_orderkey AS string) AS topicArn
FROM @orders"""
FIXTURES["fx_bucket"] = """
SELECT 'b-' || cast(c_custkey AS string) AS resourceId,
       '{"id":"own-' || c_name || '","displayName":"d"}' AS owner,
       '{"status":"' || c_mktsegment || '"}' AS abac,
       '{"grants":[' || cast(c_nationkey AS string) || ']}' AS acl,
       CASE WHEN c_nationkey % 2 = 0 THEN '{"policytext":"{\\"n\\":' || cast(c_nationkey AS string) || '}"}' END AS policy
FROM @customer"""

# Paths of snapshot objects, with unpadded months and days.
FIXTURES["fx_snapshot"] = """
SELECT 's3://bucket/prefix/AWSLogs/' || lpad(cast(o_custkey % 30 AS string), 12, '0')
       || '/Config/r-' || cast(o_custkey % 5 AS string) || '/' || cast(year(o_orderdate) AS string)
       || '/' || cast(month(o_orderdate) AS string) || '/' || cast(day(o_orderdate) AS string)
       || '/ConfigSnapshot/' || cast(o_orderkey AS string) || '.json.gz' AS path,
       lpad(cast(o_custkey % 30 AS string), 12, '0') AS accountId,
       'r-' || cast(o_custkey % 5 AS string) AS awsRegion,
       year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS dayNumber
FROM @orders"""
# Items as the per-resource fetch delivers them: strings that may hold JSON.
FIXTURES["fx_raw_item"] = """
SELECT 'o-' || cast(o_orderkey AS string) AS resourceId,
       CASE WHEN o_orderstatus = 'F' THEN '{"p":"' || o_orderpriority || '"}' ELSE o_orderpriority END AS configuration,
       CASE WHEN o_orderstatus = 'O' THEN NULL ELSE '{"x":' || cast(o_custkey AS string) || '}' END AS supplement,
       o_orderpriority AS plain,
       CASE WHEN o_orderstatus = 'F' THEN '[{"key":"prio","value":"' || o_orderpriority || '"},{"key":"cust","value":"' || cast(o_custkey AS string) || '"}]'
            WHEN o_orderstatus = 'O' THEN '{}' END AS tagsJson
FROM @orders"""

#: Fixtures whose rows need much parsing.
_PARSED = {"fx_compliance", "fx_instance"}

_USES = re.compile(r"\bfx_[a-z_]+")


def _needed(names: list[str]) -> list[str]:
    """Fixtures in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in _USES.findall(FIXTURES[name]):
            if other != name:
                visit(other)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return order


def with_clause(sql: str) -> str:
    """Oracle SQL with the fixtures it uses in front, as common table expressions."""
    defined = set(re.findall(r"\b(fx_[a-z_]+)\s+AS\s+\(", sql))
    names = _needed([n for n in dict.fromkeys(_USES.findall(sql)) if n not in defined])
    ctes = ",\n".join(f"{n} AS ({FIXTURES[n].replace('@', '')})" for n in names)
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes},\n{body[len('WITH'):]}"
    return f"WITH {ctes}\n{body}"


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame over the parquet files of ``sf_dir``."""
    ctes = ",\n".join(f"{n} AS ({FIXTURES[n]})" for n in _needed([name]))
    text = re.sub(
        r"@([a-z]+)", lambda m: f"parquet.`{sf_dir}/{m.group(1)}.parquet`", ctes
    )
    # Backslashes in the shared text are literal characters.
    text = text.replace("\\", "\\\\")
    rows = spark.sql(f"WITH {text} SELECT * FROM {name}")
    return spread(rows) if name in _PARSED else rows


def as_spine(changes: DataFrame) -> DataFrame:
    """Fixture rows of the change feed's shape as full spine rows."""
    tags = F.when(
        F.col("nameTag").isNotNull(), F.create_map(F.lit("Name"), "nameTag")
    ).otherwise(F.create_map().cast("map<string,string>"))
    values = {
        CAPTURE_TIME: F.col("captureTime"),
        "configurationStateId": F.col("stateId"),
        "tags": tags,
        "relationships": F.array(),
        "availabilityZone": F.lit(None),
        "resourceCreationTime": F.lit(None),
        "configurationItemStatus": F.lit(None),
    }
    return changes.select(
        [
            values.get(f.name, F.col(f.name) if f.name in changes.columns else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in SPINE.fields
        ]
    )


def spine_fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return as_spine(fixture(spark, sf_dir, name))
