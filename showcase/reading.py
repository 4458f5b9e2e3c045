"""Query builder and facets: projections, predicates, sorting, user SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from showcase.common import BRIEF_SQL, accounts, brief, changes, resolver, typed
from showcase.registry import query
from tallyhouse.operators.merge import accounts_refresh
from tallyhouse.plans.query import (
    Query,
    account_facets,
    facet_values,
    field_facets,
    key_facets,
)

_BASE = """arn, accountId, awsRegion, resourceType, resourceId, resourceName, availabilityZone,
resourceCreationTime, configurationItemCaptureTime, configurationItemStatus, configurationStateId,
tags, relationships"""
_SCALARS = ["arn", "accountId", "awsRegion", "resourceType", "resourceId", "resourceName", "configuration"]


@query(
    "q_default",
    "SELECT resourceType, accountId, awsRegion, resourceId, resourceName FROM fx_changes",
)
def q_default(spark, d):
    unnamed = accounts(spark, d).withColumn("accountName", F.lit(None).cast("string"))
    return Query().run(resolver(spark, d, accounts=unnamed))


@query(
    "q_account_name",
    """SELECT c.resourceType, c.accountId, a.accountName, c.awsRegion, c.resourceId, c.resourceName
       FROM fx_changes c LEFT JOIN fx_accounts a ON c.accountId = a.accountId""",
)
def q_account_name(spark, d):
    return Query().run(resolver(spark, d))


@query(
    "q_typed_default",
    """SELECT c.accountId, a.accountName, c.awsRegion, c.resourceId, c.resourceName, c.arn
       FROM fx_changes c LEFT JOIN fx_accounts a ON c.accountId = a.accountId
       WHERE c.resourceType = 'Demo::App::click'""",
)
def q_typed_default(spark, d):
    clicks = typed(changes(spark, d), "Demo::App::click")
    return Query(resource_type="AWS::IAM::Role").run(resolver(spark, d, iam_role=clicks))


@query(
    "q_extra_columns",
    """SELECT c.accountId, a.accountName, c.awsRegion, c.resourceId, c.resourceName,
              cast(json_extract_string(c.configuration, '$.k') AS bigint) AS k,
              json_extract_string(c.configuration, '$.state.name') AS stateName, c.nameTag AS tagName
       FROM fx_changes c LEFT JOIN fx_accounts a ON c.accountId = a.accountId
       WHERE c.resourceType = 'Demo::App::error'""",
)
def q_extra_columns(spark, d):
    extras = {
        "demo_app_error": ["k", "state.name AS stateName", "tags['Name'] AS tagName"]
    }
    return Query(resource_type="Demo::App::error", extra_columns=extras).run(resolver(spark, d))


@query(
    "q_fields",
    "SELECT resourceId, nameTag AS tagName, upper(awsRegion) AS region FROM fx_changes",
)
def q_fields(spark, d):
    fields = ["resourceId", "tags['Name'] AS tagName", "upper(awsRegion) AS region"]
    return Query(fields=fields).run(resolver(spark, d))


@query(
    "q_all",
    """SELECT c.arn, c.accountId, c.awsRegion, c.resourceType, c.resourceId, c.resourceName,
              c.configuration, a.accountName
       FROM fx_changes c LEFT JOIN fx_accounts a ON c.accountId = a.accountId""",
)
def q_all(spark, d):
    flat = changes(spark, d).select(_SCALARS)
    return Query(all_fields=True, fields=["arn"]).run(resolver(spark, d, resources=flat))


@query(
    "q_exclude",
    """SELECT c.accountId, c.awsRegion, c.resourceType, c.resourceId, c.resourceName, a.accountName
       FROM fx_changes c LEFT JOIN fx_accounts a ON c.accountId = a.accountId""",
)
def q_exclude(spark, d):
    flat = changes(spark, d).select(_SCALARS)
    return Query(all_fields=True, exclude=["CONFIGURATION", "arn"]).run(
        resolver(spark, d, resources=flat)
    )


_NAMED = """SELECT c.resourceType, c.accountId, a.accountName, c.awsRegion, c.resourceId, c.resourceName
       FROM fx_changes c LEFT JOIN fx_accounts a ON c.accountId = a.accountId WHERE """


@query("q_accounts", _NAMED + "(c.accountId IN ('000000000003', 'NATION_5') OR a.accountName IN ('000000000003', 'NATION_5'))")
def q_accounts(spark, d):
    return Query(accounts=["000000000003", "NATION_5"]).run(resolver(spark, d))


@query("q_where", _NAMED + "c.awsRegion = 'r-2' AND c.resourceType = 'Demo::App::click'")
def q_where(spark, d):
    where = [("awsRegion", "r-2"), ("resourceType", "Demo::App::click")]
    return Query(where=where).run(resolver(spark, d))


@query(
    "q_where_raw",
    _NAMED + "(length(c.resourceId) > 5 OR c.awsRegion = 'r-1') AND (c.resourceName IS NOT NULL)",
)
def q_where_raw(spark, d):
    raw = ["length(resourceId) > 5 OR awsRegion = 'r-1'", "resourceName IS NOT NULL"]
    return Query(where_raw=raw).run(resolver(spark, d))


@query(
    "q_regex",
    _NAMED
    + """(regexp_matches(c.resourceId, '-1[0-9]-') OR regexp_matches(c.resourceId, '^u-3'))
         AND (regexp_matches(c.resourceName, '7$') OR regexp_matches(c.resourceName, '^user-1'))""",
)
def q_regex(spark, d):
    return Query(ids=["-1[0-9]-", "^u-3"], names=["7$", "^user-1"]).run(resolver(spark, d))


@query(
    "q_combined",
    _NAMED
    + """(c.accountId IN ('NATION_3', 'NATION_13', '000000000027') OR a.accountName IN ('NATION_3', 'NATION_13', '000000000027'))
         AND c.resourceType = 'Demo::App::error'
         AND (json_extract_string(c.configuration, '$.k') IS NOT NULL)
         AND (regexp_matches(c.resourceId, '^u-[0-9]+-[3-9]$'))
         AND (regexp_matches(c.resourceName, 'user'))""",
)
def q_combined(spark, d):
    return Query(
        accounts=["NATION_3", "NATION_13", "000000000027"],
        where=[("resourceType", "Demo::App::error")],
        where_raw=["get_json_object(configuration, '$.k') IS NOT NULL"],
        ids=["^u-[0-9]+-[3-9]$"],
        names=["user"],
        sort=["resourceId", "arn"],
    ).run(resolver(spark, d))


@query(
    "q_user_sql",
    """SELECT resourceType, awsRegion, count(*) AS n, count(DISTINCT accountId) AS accounts
       FROM fx_changes WHERE accountId <> '000000000000' GROUP BY resourceType, awsRegion""",
)
def q_user_sql(spark, d):
    return Query(
        where_raw=["accountId <> '000000000000'"],
        sql="""WITH counted AS (SELECT resourceType, awsRegion, count(*) AS n,
                                       count(DISTINCT accountId) AS accounts
                                FROM input GROUP BY resourceType, awsRegion)
               SELECT * FROM counted;""",
    ).run(resolver(spark, d))


_SORTED = "SELECT resourceName, resourceId, arn FROM fx_changes ORDER BY resourceName {0} NULLS LAST, arn {0} NULLS LAST"


@query("q_sort", _SORTED.format("ASC"))
def q_sort(spark, d):
    return Query(fields=["resourceName", "resourceId", "arn"], sort=["resourceName", "arn"]).run(resolver(spark, d))


@query("q_sort_reverse", _SORTED.format("DESC"))
def q_sort_reverse(spark, d):
    return Query(
        fields=["resourceName", "resourceId", "arn"], sort=["resourceName", "arn"], reverse=True
    ).run(resolver(spark, d))


@query(
    "facet_values",
    """SELECT DISTINCT resourceId FROM fx_changes
       WHERE awsRegion = 'r-2' AND resourceId LIKE 'u-1%' ORDER BY resourceId""",
)
def facet_values_query(spark, d):
    narrowed = Query(where=[("awsRegion", "r-2")], ids=["not applied"])
    return facet_values(narrowed, resolver(spark, d), "resourceId", "u-1")


@query(
    "facet_keys",
    "SELECT DISTINCT 'awsRegion=' || awsRegion AS candidate FROM fx_changes WHERE awsRegion LIKE 'r-%'",
)
def facet_keys(spark, d):
    return key_facets(Query(), resolver(spark, d), "awsRegion=r-")


@query(
    "facet_accounts",
    """WITH known AS (SELECT i.accountId, a.accountName
                      FROM (SELECT DISTINCT accountId FROM fx_changes) i
                      LEFT JOIN fx_accounts a ON i.accountId = a.accountId)
       SELECT accountId AS candidate, accountName AS help FROM known
       UNION ALL SELECT accountName, accountId FROM known WHERE accountName IS NOT NULL""",
)
def facet_accounts(spark, d):
    listed = accounts(spark, d)
    known = accounts_refresh(listed.limit(0), changes(spark, d), listed)
    return account_facets(known)


_BASE_NAMES = "('" + "'),('".join(n.strip() for n in _BASE.replace("\n", " ").split(",")) + "')"


@query(
    "facet_fields",
    f"""SELECT column_name FROM (VALUES {_BASE_NAMES}, ('accountName')) base(column_name)
        UNION
        SELECT unnest(json_keys(configuration)) FROM fx_changes WHERE resourceType = 'Demo::App::error'
        UNION
        SELECT 'supplementaryConfiguration' FROM fx_changes
        WHERE resourceType = 'Demo::App::error' AND supplementaryConfiguration = '{{}}'""",
)
def facet_fields(spark, d):
    errors = typed(changes(spark, d), "Demo::App::error")
    return field_facets(errors).select("column_name")


@query(
    "sql_window",
    f"SELECT {BRIEF_SQL} FROM fx_changes QUALIFY row_number() OVER (PARTITION BY accountId, resourceType ORDER BY captureTime DESC, stateId DESC) <= 3",
)
def sql_window(spark, d):
    """Windows and top-k are reached through user SQL."""
    ranked = Query(
        all_fields=True,
        sql="""SELECT * EXCEPT (rn) FROM (
                 SELECT *, row_number() OVER (PARTITION BY accountId, resourceType
                   ORDER BY configurationItemCaptureTime DESC, configurationStateId DESC) AS rn
                 FROM input) WHERE rn <= 3""",
    ).run(resolver(spark, d))
    return brief(ranked)
