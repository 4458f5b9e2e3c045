"""Inference, derived tables, nested functions, built-in transforms and builds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from showcase.common import accounts, changes, typed
from showcase.fixtures import DEMO_TYPES, fixture
from showcase.registry import query
from tallyhouse.functions import jsontext, lists
from tallyhouse.operators import policies
from tallyhouse.operators.containment import contained_values
from tallyhouse.operators.derive import STRINGIFIED, stringify_content, type_schemas
from tallyhouse.operators.merge import latest_per_key
from tallyhouse.plans import builtin
from tallyhouse.plans.inventory import BuildInputs, BuildSettings, Inventory
from tallyhouse.plans.query import columns_of
from tallyhouse.plans.transforms import (
    APPLIED,
    CustomTable,
    Registry,
    custom_table,
    run_transforms,
    spine_conditions,
    sql_global_transform,
    sql_transform,
)
from tallyhouse.schemas import JSON_COLUMNS, SPINE, table_name
from tallyhouse.sources.contract import Semantics, Source
from tallyhouse.sources.store import work_folder

_BASE = [c for c in SPINE.names if c not in JSON_COLUMNS]
_BASE_VALUES = ", ".join(f"('{c}')" for c in _BASE)
_BASE_LOWER = ", ".join(f"'{c.lower()}'" for c in _BASE)


def _joined(items, separator="|"):
    return F.array_join(items, separator)


# -- inference and derived tables ---------------------------------------------

_KINDS = {
    T.StringType: "VARCHAR",
    T.LongType: "BIGINT",
    T.BooleanType: "BOOLEAN",
    T.StructType: "OBJECT",
    T.ArrayType: "ARRAY",
}


@query(
    "infer_schemas",
    """SELECT DISTINCT resourceType, key AS field,
              replace(json_type(configuration, '$."' || key || '"'), 'UBIGINT', 'BIGINT') AS kind
       FROM (SELECT resourceType, configuration, unnest(json_keys(configuration)) AS key FROM fx_changes) x""",
)
def infer_schemas(spark, d):
    found = [
        (s.resource_type, f.name, _KINDS[type(f.dataType)])
        for s in type_schemas(changes(spark, d)).values()
        for f in s.types["configuration"].fields
    ]
    return spark.createDataFrame(found, "resourceType string, field string, kind string")


@query(
    "catalog_columns",
    f"""WITH keys AS (
          SELECT DISTINCT resourceType, unnest(json_keys(configuration)) AS key FROM fx_changes
          UNION SELECT DISTINCT resourceType, unnest(json_keys(supplementaryConfiguration)) FROM fx_changes
          UNION SELECT resourceType, 'configuration' FROM fx_changes WHERE configuration = '{{}}'
          UNION SELECT resourceType, 'supplementaryConfiguration' FROM fx_changes WHERE supplementaryConfiguration = '{{}}')
        SELECT lower(replace(resourceType, '::', '_')) AS table_name,
               CASE WHEN lower(key) IN ({_BASE_LOWER}) THEN key || '_1' ELSE key END AS column_name FROM keys
        UNION ALL
        SELECT lower(replace(resourceType, '::', '_')), name
        FROM (SELECT DISTINCT resourceType FROM fx_changes) t CROSS JOIN (VALUES {_BASE_VALUES}) b(name)""",
)
def catalog_columns(spark, d):
    spine = changes(spark, d)
    out = None
    for resource_type in DEMO_TYPES:
        columns = columns_of(typed(spine, resource_type)).select(
            F.lit(table_name(resource_type)).alias("table_name"), "column_name"
        )
        out = columns if out is None else out.union(columns)
    return out


@query(
    "derive_type",
    """SELECT arn, resourceId, nameTag, cast(json_extract_string(configuration, '$.k') AS bigint) AS k,
              cast(json_extract_string(configuration, '$.state.code') AS bigint) AS code,
              json_extract_string(configuration, '$.state.name') AS state,
              json_extract_string(configuration, '$.stateReason.message') AS reason
       FROM fx_changes WHERE resourceType = 'Demo::App::error'""",
)
def derive_type(spark, d):
    return typed(changes(spark, d), "Demo::App::error").select(
        "arn", "resourceId", F.col("tags")["Name"].alias("nameTag"), "k",
        F.col("state.code").alias("code"), F.col("state.name").alias("state"),
        F.col("stateReason.message").alias("reason"),
    )


@query(
    "derive_empty",
    """SELECT arn, cast(json_extract_string(configuration, '$.flag') AS boolean) AS flag,
              cast(json_extract_string(configuration, '$.k') AS bigint) AS k,
              cast(NULL AS varchar) AS configuration, cast(NULL AS varchar) AS "supplementaryConfiguration"
       FROM fx_changes WHERE resourceType = 'Demo::App::view'""",
)
def derive_empty(spark, d):
    """Empty documents keep their rows and add a NULL column of their name."""
    return typed(changes(spark, d), "Demo::App::view").select(
        "arn", "flag", "k", "configuration", "supplementaryConfiguration"
    )


_COLLISION = """SELECT arn, json_extract_string(configuration, '$.arn') AS "{0}",
       json_extract_string(configuration, '$.Tags[0].value') AS team,
       cast(json_extract_string(configuration, '$.cents') AS bigint) AS cents
       FROM fx_changes WHERE resourceType = 'Demo::App::purchase'"""


@query("derive_collision", _COLLISION.format("arn_1"))
def derive_collision(spark, d):
    table = typed(changes(spark, d), "Demo::App::purchase")
    return table.select(
        "arn", "arn_1", F.get("Tags_1", F.lit(0))["value"].alias("team"), "cents"
    )


@query(
    "g_drop_duplicates",
    """SELECT arn, 0 AS suffixed, cast(json_extract_string(configuration, '$.cents') AS bigint) AS cents
       FROM fx_changes WHERE resourceType = 'Demo::App::purchase'""",
)
def g_drop_duplicates(spark, d):
    """Both global clean-ups: the repeated tags and arn columns go."""
    table = typed(changes(spark, d), "Demo::App::purchase")
    for name in ("tags_1", "arn_1"):
        table = builtin.dropping(name)(table)
    suffixed = sum(c.lower().endswith("_1") for c in table.columns)
    return table.select("arn", F.lit(suffixed).alias("suffixed"), "cents")


@query(
    "stringify_field",
    """SELECT arn, json_type(configuration, '$.Content') AS before, 'VARCHAR' AS after,
              cast(json_extract(configuration, '$.Content') AS varchar) AS content,
              json_extract_string(configuration, '$.ParentId') AS parentId
       FROM fx_changes WHERE resourceType = 'Demo::App::signup'""",
)
def stringify_field(spark, d):
    rows = changes(spark, d).filter("resourceType = 'Demo::App::signup'")
    policy, key = next(iter(STRINGIFIED.items()))
    fixed = stringify_content(
        rows.withColumn("before", F.get_json_object("configuration", "$.Content")).withColumn("resourceType", F.lit(policy))
    )
    content = F.get_json_object("configuration", f"$.{key}")
    kind = F.schema_of_variant(F.try_variant_get(F.parse_json("configuration"), f"$.{key}", "variant"))
    return fixed.select(
        "arn",
        jsontext.json_kind(F.col("before")).alias("before"),
        F.when(kind == "STRING", "VARCHAR").otherwise(kind).alias("after"),
        content.alias("content"),
        F.get_json_object("configuration", "$.ParentId").alias("parentId"),
    )


@query(
    "g_name_from_tags",
    """SELECT arn, nameTag AS tagName, coalesce(resourceName, nameTag) AS resourceName FROM fx_changes""",
)
def g_name_from_tags(spark, d):
    return builtin.name_from_tags(changes(spark, d)).select("arn", "tagName", "resourceName")


@query(
    "cond_tags",
    "SELECT resourceType, max(nameTag IS NOT NULL) AS name_from_tags FROM fx_changes GROUP BY resourceType",
)
def cond_tags(spark, d):
    """Condition of a global transform for all tables, from one aggregation."""
    return spine_conditions(changes(spark, d), builtin.default_registry())


@query("custom_by_account", """SELECT accountId, count(*) AS errors, 'Custom::ErrorsByAccount' AS resourceType
       FROM fx_changes WHERE resourceType = 'Demo::App::error' GROUP BY accountId""")
def custom_by_account(spark, d):
    definition = CustomTable(
        "Custom::ErrorsByAccount",
        "SELECT accountId, count(*) AS errors FROM demo_app_error GROUP BY accountId",
        ["demo_app_error"],
    )
    return custom_table({"demo_app_error": typed(changes(spark, d), "Demo::App::error")}, definition)


# -- nested functions ----------------------------------------------------------

@query(
    "fn_json_kind",
    """SELECT arn, json_type(configuration) AS doc, json_type(configuration, '$.k') AS k,
              json_type(configuration, '$.Content') AS content, json_type(configuration, '$.Tags') AS tags,
              json_type(configuration, '$.flag') AS flag
       FROM fx_changes""",
)
def fn_json_kind(spark, d):
    parts = F.from_json("configuration", "map<string,string>")

    def kind(key):
        return jsontext.json_kind(parts[key]).alias(key.lower())

    return changes(spark, d).select(
        "arn", jsontext.json_kind(F.col("configuration")).alias("doc"),
        kind("k"), kind("Content"), kind("Tags"), kind("flag"),
    )


@query(
    "fn_statements",
    """SELECT arn, CASE json_type(policyDocument, '$.Statement')
                WHEN 'ARRAY' THEN cast(json_array_length(policyDocument, '$.Statement') AS bigint)
                WHEN 'OBJECT' THEN 1 ELSE 0 END AS n,
              CASE json_type(policyDocument, '$.Statement')
                WHEN 'ARRAY' THEN (json_extract(policyDocument, '$.Statement[0]'))::varchar
                WHEN 'OBJECT' THEN (json_extract(policyDocument, '$.Statement'))::varchar END AS first
       FROM fx_policy""",
)
def fn_statements(spark, d):
    found = jsontext.statements(F.col("policyDocument"))
    return fixture(spark, d, "fx_policy").select(
        "arn", F.size(found).cast("long").alias("n"), lists.list_first(found).alias("first")
    )


@query(
    "fn_url_decode",
    """SELECT doc_id, md5(text) AS digest, 'a+b c+' AS plus, '100%zz' AS kept FROM documents""",
)
def fn_url_decode(spark, d):
    """Whole texts survive encoding and decoding; ``+`` and bad escapes stay."""
    documents = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    encoded = F.replace(F.url_encode("text"), F.lit("+"), F.lit("%20"))
    return documents.select(
        "doc_id",
        F.md5(jsontext.url_decode(encoded)).alias("digest"),
        jsontext.url_decode(F.lit("a+b%20c%2B")).alias("plus"),
        jsontext.url_decode(F.lit("100%zz")).alias("kept"),
    )


@query(
    "fn_list_ops",
    """WITH x AS (SELECT l_orderkey, l_linenumber, [l_returnflag, l_linestatus, NULL, l_returnflag] AS a,
                         CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE [l_linestatus, 'z'] END AS b FROM lineitem)
       SELECT l_orderkey, l_linenumber, len(list_concat(a, b)) AS n_concat,
              array_to_string(list_sort(list_distinct(list_concat(a, b))), '|') AS uniq,
              len(flatten([a, b])) AS n_flat, a[1] AS head,
              list_contains(a, 'R') AS has_r,
              array_to_string(list_filter(list_transform(coalesce(b, []), lambda v: upper(v)), lambda v: v <> 'F'), '|') AS mapped
       FROM x""",
)
def fn_list_ops(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    a = F.array("l_returnflag", "l_linestatus", F.lit(None), "l_returnflag")
    b = F.when(F.col("l_linenumber") % 2 != 0, F.array(F.col("l_linestatus"), F.lit("z")))
    both = lists.list_concat(a, b)
    upper = F.filter(F.transform(lists.or_empty(b), F.upper), lambda v: v != "F")
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        F.size(both).cast("long").alias("n_concat"),
        _joined(F.array_sort(lists.list_distinct(both))).alias("uniq"),
        F.size(lists.list_flatten(F.array(a, b))).cast("long").alias("n_flat"),
        lists.list_first(a).alias("head"),
        F.array_contains(lists.no_nulls_empty(a), "R").alias("has_r"),
        _joined(upper).alias("mapped"),
    )


@query(
    "fn_map_ops",
    """SELECT o_orderkey, o_orderpriority AS prio, 2 AS n, o_orderpriority || '|' || o_orderstatus AS vals,
              CAST(NULL AS VARCHAR) AS missing, 'prio|status' AS keys FROM orders""",
)
def fn_map_ops(spark, d):
    entries = F.array(
        F.struct(F.lit("prio").alias("name"), F.col("o_orderpriority").alias("v")),
        F.struct(F.lit("status").alias("name"), F.col("o_orderstatus").alias("v")),
    )
    mapped = lists.map_of(entries, "name", lambda x: x["v"])
    return spark.read.parquet(f"{d}/orders.parquet").select(
        "o_orderkey",
        mapped["prio"].alias("prio"),
        F.size(F.map_entries(mapped)).alias("n"),
        _joined(F.map_values(mapped)).alias("vals"),
        F.try_element_at(mapped, F.lit("none")).alias("missing"),
        _joined(F.map_keys(mapped)).alias("keys"),
    )


@query(
    "fn_nested_update",
    """SELECT o_orderkey, nullif(CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END, '') AS prio,
              o_orderstatus AS status, coalesce(nullif(o_orderstatus, 'F'), 'none') AS shown FROM orders""",
)
def fn_nested_update(spark, d):
    blanked = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderpriority"))
    held = F.struct(blanked.alias("prio"), F.col("o_orderstatus").alias("status"))
    value = lists.with_blanks_nulled(held, ["prio", "status"])
    return spark.read.parquet(f"{d}/orders.parquet").select(
        "o_orderkey",
        value["prio"].alias("prio"),
        value["status"].alias("status"),
        F.coalesce(F.nullif(value["status"], F.lit("F")), F.lit("none")).alias("shown"),
    )


@query(
    "fn_string_ops",
    """SELECT arn, replace(resourceId, 'u-', '') AS shortId, resourceId[3:] AS tail,
              array_to_string(string_split(resourceId, '-'), '/') AS parts, lower(resourceType) AS low,
              '/' || awsRegion AS path, resourceId LIKE 'u-1%' AS likes FROM fx_changes""",
)
def fn_string_ops(spark, d):
    return changes(spark, d).select(
        "arn",
        F.replace("resourceId", F.lit("u-"), F.lit("")).alias("shortId"),
        F.substring("resourceId", 3, 2**31 - 1).alias("tail"),
        _joined(F.split("resourceId", "-"), "/").alias("parts"),
        F.lower("resourceType").alias("low"),
        F.concat(F.lit("/"), "awsRegion").alias("path"),
        F.col("resourceId").like("u-1%").alias("likes"),
    )


# -- built-in transforms --------------------------------------------------------


@query(
    "h_instance_state",
    """SELECT arn, json_extract_string(configuration, '$.state.name') AS state,
              json_extract_string(configuration, '$.stateReason.message') AS "stateReason"
       FROM fx_changes WHERE resourceType = 'Demo::App::error'""",
)
def h_instance_state(spark, d):
    table = typed(changes(spark, d), "Demo::App::error")
    return builtin.instance_state(table).select("arn", "state", "stateReason")


@query(
    "h_bucket",
    """SELECT resourceId, json_extract_string(owner, '$.id') AS owner, json_extract_string(abac, '$.status') AS "AbacStatus",
              acl AS "AccessControlList", json_extract_string(policy, '$.policytext') AS "BucketPolicy" FROM fx_bucket""",
)
def h_bucket(spark, d):
    raw = fixture(spark, d, "fx_bucket").select(
        "resourceId",
        F.from_json("owner", "struct<id:string,displayName:string>").alias("owner"),
        F.from_json("abac", "struct<status:string>").alias("AbacStatus"),
        F.from_json("acl", "struct<grants:array<bigint>>").alias("AccessControlList"),
        F.from_json("policy", "struct<policytext:string>").alias("BucketPolicy"),
    )
    return builtin.bucket(raw)


@query(
    "list_contains_join",
    """WITH ids AS (SELECT DISTINCT resourceId, unnest(string_split(interfaceIds, ',')) AS id FROM fx_endpoint),
            found AS (SELECT ids.resourceId, string_agg(n.privateIpAddress, '|' ORDER BY n.privateIpAddress) AS addresses
                      FROM ids JOIN fx_interface n ON n.resourceId = ids.id GROUP BY ids.resourceId)
       SELECT e.resourceId, f.addresses FROM fx_endpoint e LEFT JOIN found f USING (resourceId)""",
)
def list_contains_join(spark, d):
    endpoints = fixture(spark, d, "fx_endpoint")
    out = contained_values(
        endpoints,
        "resourceId",
        F.split("interfaceIds", ","),
        fixture(spark, d, "fx_interface").withColumnRenamed("resourceId", "interfaceId"),
        "interfaceId",
        "privateIpAddress",
        "addresses",
    )
    return out.select("resourceId", _joined("addresses").alias("addresses"))


_STATEMENTS_SQL = """
stmts AS (SELECT arn, unnest(CASE json_type(policyDocument, '$.Statement')
              WHEN 'ARRAY' THEN from_json(json_extract(policyDocument, '$.Statement'), '["JSON"]')
              WHEN 'OBJECT' THEN [json_extract(policyDocument, '$.Statement')] ELSE [] END)::varchar AS statement
          FROM fx_policy)"""


@query("h_policy_statements", f"WITH {_STATEMENTS_SQL} SELECT arn, statement FROM stmts")
def h_policy_statements(spark, d):
    """Documents are URL-encoded inside a version list, as the recorder has them."""
    encoded = F.replace(F.url_encode("policyDocument"), F.lit("+"), F.lit("%20"))
    versions = F.array(
        F.struct(F.lit(False).alias("isDefaultVersion"), F.lit("%7B%7D").alias("document")),
        F.struct(F.lit(True).alias("isDefaultVersion"), encoded.alias("document")),
    )
    table = fixture(spark, d, "fx_policy").select("arn", versions.alias("policyVersionList"))
    return builtin.policy_statements(table).select("arn", F.explode("policyStatements").alias("statement"))


def _policy_statements(spark, d) -> DataFrame:
    return fixture(spark, d, "fx_policy").select(
        "arn", jsontext.statements(F.col("policyDocument")).alias("policyStatements")
    )


@query(
    "effective_policy",
    f"""WITH {_STATEMENTS_SQL} SELECT DISTINCT a.principal, s.statement
        FROM fx_attached a JOIN stmts s ON a.policyArn = s.arn""",
)
def effective_policy(spark, d):
    own = fixture(spark, d, "fx_policy")
    statement_list = jsontext.statements(F.col("policyDocument")).alias("policyStatements")
    every = policies.all_policies(
        own.filter("managed = 0").select("arn", statement_list),
        own.filter("managed = 1").select("arn", statement_list),
    )
    return policies.attached_statements(fixture(spark, d, "fx_attached"), every)


@query(
    "role_policies",
    f"""WITH {_STATEMENTS_SQL},
          mine AS (SELECT r.arn, s.statement FROM fx_role r JOIN fx_policy p
                     ON p.arn = 'arn:pol:' || substr(r.arn, 10) LEFT JOIN stmts s ON s.arn = p.arn),
          known AS (SELECT DISTINCT arn FROM mine),
          every AS (SELECT arn, statement FROM mine WHERE statement IS NOT NULL
                    UNION SELECT k.arn, '{{"Effect":"' || r.accountId || '"}}' FROM known k JOIN fx_role r USING (arn))
        SELECT r.arn, x.statements, x.n FROM fx_role r LEFT JOIN
          (SELECT arn, string_agg(statement, '|' ORDER BY statement) AS statements, count(*) AS n FROM every GROUP BY arn) x USING (arn)""",
)
def role_policies(spark, d):
    """Attached and inline policies of one record: the list of a role is NULL when
    its attached arn is unknown."""
    inline = F.create_map(
        F.lit("own"),
        F.concat(F.lit('{"Statement":{"Effect":"'), "accountId", F.lit('"}}')),
    )
    roles = fixture(spark, d, "fx_role").select(
        "arn",
        F.create_map(F.lit("p"), F.concat(F.lit("arn:pol:"), F.substring("arn", 10, 100))).alias("attachedManagedPolicies"),
        inline.alias("inlinePolicies"),
    )
    out = policies.effective_statements(roles, _policy_statements(spark, d), ["arn"])
    found = F.col("effectivePolicyStatements")
    return out.select(
        "arn", _joined(found).alias("statements"), F.size(found).cast("long").alias("n")
    )


def _membership(spark, d, scoped: bool) -> DataFrame:
    users = fixture(spark, d, "fx_role").select(
        "arn", "accountId", F.split("groupNames", ",").alias("groupList"),
        F.array(F.lit('{"Effect":"own"}')).alias("effectivePolicyStatements"),
    )
    # A group may have many statement rows; the list is per group and account.
    groups = (
        fixture(spark, d, "fx_group")
        .groupBy("accountId", F.col("groupName").alias("resourceName"))
        .agg(F.array_sort(F.collect_set("statement")).alias("effectivePolicyStatements"))
    )
    out = policies.member_statements(users, groups, ["arn"], scope_by_account=scoped)
    return out.select("arn", _joined("effectivePolicyStatements").alias("statements"))


_MEMBER_SQL = """WITH m AS (SELECT arn, accountId, unnest(string_split(groupNames, ',')) AS groupName FROM fx_role),
       every AS (SELECT m.arn, g.statement FROM m JOIN fx_group g ON g.groupName = m.groupName {0}
                 UNION SELECT arn, '{{"Effect":"own"}}' FROM fx_role)
       SELECT arn, string_agg(statement, '|' ORDER BY statement) AS statements FROM every GROUP BY arn"""


@query("group_membership", _MEMBER_SQL.format("AND g.accountId = m.accountId"))
def group_membership(spark, d):
    return _membership(spark, d, True)


@query("group_membership_unscoped", _MEMBER_SQL.format(""))
def group_membership_unscoped(spark, d):
    return _membership(spark, d, False)


_PRINCIPAL_SQL = f"""WITH {_STATEMENTS_SQL},
    attached AS (
        SELECT 'iam_role' AS tab, principal AS arn, policyArn FROM fx_attached
        UNION SELECT 'iam_group', 'arn:group:' || accountId || '/' || groupName, 'arn:pol:' || substr(groupName, 3) FROM fx_group
        UNION SELECT 'iam_user', arn, 'arn:pol:' || substr(arn, 10) FROM fx_role),
    known AS (SELECT DISTINCT tab, a.arn FROM attached a JOIN fx_policy p ON p.arn = a.policyArn),
    inline AS (
        SELECT 'iam_role' AS tab, principal AS arn, '{{"Effect":"' || substr(principal, 10) || '"}}' AS statement FROM fx_attached
        UNION SELECT 'iam_group', 'arn:group:' || accountId || '/' || groupName, statement FROM fx_group
        UNION SELECT 'iam_user', arn, '{{"Effect":"' || accountId || '"}}' FROM fx_role),
    own AS (
        SELECT a.tab, a.arn, s.statement FROM attached a JOIN stmts s ON s.arn = a.policyArn
        UNION SELECT i.tab, i.arn, i.statement FROM inline i JOIN known k ON k.tab = i.tab AND k.arn = i.arn),
    member AS (SELECT arn, 'arn:group:' || accountId || '/' || unnest(string_split(groupNames, ',')) AS team FROM fx_role),
    every AS (
        SELECT * FROM own
        UNION SELECT 'iam_user', m.arn, o.statement FROM member m JOIN own o ON o.tab = 'iam_group' AND o.arn = m.team),
    texts AS (SELECT tab, arn, string_agg(statement, '|' ORDER BY statement) AS statements FROM every GROUP BY tab, arn)
    SELECT b.tab, b.arn, CASE WHEN k.arn IS NOT NULL OR b.tab = 'iam_user' THEN coalesce(t.statements, '') END AS statements
    FROM (SELECT DISTINCT tab, arn FROM attached) b
    LEFT JOIN known k ON k.tab = b.tab AND k.arn = b.arn
    LEFT JOIN texts t ON t.tab = b.tab AND t.arn = b.arn"""


@query("principal_policies", _PRINCIPAL_SQL)
def principal_policies(spark, d):
    """The whole transform of roles, groups and users, with several attachments and
    inline documents for one principal, and groups none of whose policies is known."""

    def encoded(document):
        return F.replace(F.url_encode(document), F.lit("+"), F.lit("%20"))

    def principals(df, arn, account, name, arns, statement, inline, *extra):
        """Rows of a derived table; ``arns`` and ``statement`` are aggregates."""
        document = F.concat(F.lit('{"Statement":['), F.array_join(F.collect_set(statement), ","), F.lit("]}"))
        return df.groupBy(arn.alias("arn"), account.alias("accountId"), name.alias("resourceName"), *extra).agg(
            F.transform(F.collect_set(arns), lambda a: F.struct(a.alias("policyName"), a.alias("policyArn"))).alias("attachedManagedPolicies"),
            F.array(F.struct(F.lit("inline").alias("policyName"), encoded(document).alias("policyDocument"))).alias(inline),
        ).select("*", F.lit("global").alias("awsRegion"), F.lit("T").alias("resourceType"), F.col("arn").alias("resourceId"))

    own = fixture(spark, d, "fx_policy")
    versions = F.array(F.struct(F.lit(True).alias("isDefaultVersion"), encoded("policyDocument").alias("document")))
    attached, group, role = (fixture(spark, d, f) for f in ("fx_attached", "fx_group", "fx_role"))
    tables = {
        "iam_policy": own.filter("managed = 0").select("arn", versions.alias("policyVersionList")),
        "aws_managed_policy": own.filter("managed = 1").select("arn", jsontext.statements(F.col("policyDocument")).alias("policyStatements")),
        "iam_role": principals(
            attached, F.col("principal"), F.lit("1"), F.col("principal"), F.col("policyArn"),
            F.concat(F.lit('{"Effect":"'), F.substring("principal", 10, 100), F.lit('"}')), "rolePolicyList",
        ).withColumn("assumeRolePolicyDocument", F.lit("%7B%7D")),
        "iam_group": principals(
            group, F.concat(F.lit("arn:group:"), "accountId", F.lit("/"), "groupName"), F.col("accountId"), F.col("groupName"),
            F.concat(F.lit("arn:pol:"), F.substring("groupName", 3, 100)), F.col("statement"), "groupPolicyList",
        ),
        "iam_user": principals(
            role, F.col("arn"), F.col("accountId"), F.col("arn"), F.concat(F.lit("arn:pol:"), F.substring("arn", 10, 100)),
            F.concat(F.lit('{"Effect":"'), "accountId", F.lit('"}')), "userPolicyList", F.split("groupNames", ",").alias("groupList"),
        ),
    }
    out = builtin.principal_policies(tables)
    parts = [
        out[t].select(F.lit(t).alias("tab"), "arn", _joined("effectivePolicyStatements").alias("statements"))
        for t in ("iam_role", "iam_group", "iam_user")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "g_sql_condition",
    """SELECT lower(replace(resourceType, '::', '_')) AS name, sum(CASE WHEN nameTag IS NULL THEN 1 ELSE 0 END) * 2 > count(*) AS applied,
              count(*) AS n FROM fx_changes GROUP BY resourceType""",
)
def g_sql_condition(spark, d):
    """A condition in SQL on the rows of every derived table, answered by one action."""
    spine = changes(spark, d)
    add = sql_global_transform(
        "untagged", "SELECT *, true AS mostlyUntagged FROM {table}",
        "SELECT count_if(tags['Name'] IS NULL) * 2 > count(*) FROM {table}",
    )
    run = run_transforms({table_name(t): typed(spine, t) for t in DEMO_TYPES}, Registry(user_global=[add]))
    status = {table: status for _, table, status, _ in run.report}
    parts = [
        df.agg(F.lit(name).alias("name"), F.lit(status[name] == APPLIED and "mostlyUntagged" in df.columns).alias("applied"), F.count("*").alias("n"))
        for name, df in run.tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


_ISO = "yyyy-MM-dd HH:mm:ss"


@query(
    "h_applications",
    """WITH x AS (SELECT resourceId, applications AS a FROM fx_instance)
       SELECT resourceId, 3 AS n,
              json_extract_string(a, '$.one.Name') || '|' || json_extract_string(a, '$.many[0].Name') || '|' || json_extract_string(a, '$.many[1].Name') AS names,
              json_extract_string(a, '$.one.Version') AS version, json_extract_string(a, '$.one.Epoch') AS epoch,
              '2024-01-02 03:04:05' AS installed FROM x""",
)
def h_applications(spark, d):
    rows = fixture(spark, d, "fx_instance").select(
        "resourceId",
        builtin.applications(F.from_json("applications", "map<string,string>")).alias("apps"),
    )
    one = F.get("apps", F.lit(0))
    times = F.array_compact(F.transform("apps", lambda a: F.date_format(a["InstalledTime"], _ISO)))
    return rows.select(
        "resourceId",
        F.size("apps").alias("n"),
        _joined(F.transform("apps", lambda a: a["Name"])).alias("names"),
        one["Version"].alias("version"),
        one["Epoch"].alias("epoch"),
        _joined(times).alias("installed"),
    )


@query(
    "h_windows_updates",
    """SELECT resourceId, 'KB1|KB2' AS ids, json_extract_string(updates, '$.KB1.description') AS d1,
              CAST(NULL AS VARCHAR) AS h1, json_extract_string(updates, '$.KB1.installedby') AS by1,
              json_extract_string(updates, '$.KB2.hotfixid') AS h2, '2024-05-06 07:08:09' AS t2, CAST(NULL AS VARCHAR) AS t1
       FROM fx_instance""",
)
def h_windows_updates(spark, d):
    rows = fixture(spark, d, "fx_instance").select(
        "resourceId",
        builtin.windows_updates(F.from_json("updates", "map<string,string>")).alias("u"),
    )

    def of(key, name):
        return F.try_element_at("u", F.lit(key))[name]

    return rows.select(
        "resourceId",
        _joined(F.array_sort(F.map_keys("u"))).alias("ids"),
        of("KB1", "description").alias("d1"),
        of("KB1", "hotfixid").alias("h1"),
        of("KB1", "installedby").alias("by1"),
        of("KB2", "hotfixid").alias("h2"),
        F.date_format(of("KB2", "installedtime"), _ISO).alias("t2"),
        F.date_format(of("KB1", "installedtime"), _ISO).alias("t1"),
    )


@query(
    "h_inventory_flatten",
    """SELECT resourceId, json_extract_string(information, '$."' || resourceId || '".AgentType') AS "AgentType",
              json_extract_string(information, '$."' || resourceId || '".ComputerName') AS "ComputerName" FROM fx_instance""",
)
def h_inventory_flatten(spark, d):
    instance = "struct<AgentType:string,ComputerName:string>"
    table = fixture(spark, d, "fx_instance").select(
        "resourceId",
        F.lit("x").alias("AWS:Application"),
        F.lit("x").alias("AWS:WindowsUpdate"),
        F.struct(F.from_json("information", f"map<string,{instance}>").alias("Content")).alias("AWS:InstanceInformation"),
    )
    return builtin.flatten_instance(table)


@query(
    "h_patch_summary",
    """SELECT resourceId, json_extract_string(item, '$.Content.Patch.ComplianceSummary.Status') AS status,
              json_extract_string(item, '$.Content.Patch.ComplianceSummary.PatchGroup') AS grp,
              cast(json_extract_string(item, '$.Content.Patch.ComplianceSummary.CompliantHighCount') AS int) AS high,
              cast(NULL AS int) AS medium, cast(NULL AS varchar) AS execution
       FROM fx_compliance""",
)
def h_patch_summary(spark, d):
    rows = fixture(spark, d, "fx_compliance").select(
        "resourceId", builtin.patch_summary(F.col("item")).alias("s")
    )
    return rows.select(
        "resourceId", F.col("s.Status").alias("status"), F.col("s.PatchGroup").alias("grp"),
        F.col("s.CompliantHighCount").alias("high"), F.col("s.CompliantMediumCount").alias("medium"),
        F.col("s.ExecutionType").alias("execution"),
    )


@query(
    "h_patches",
    """SELECT resourceId, key AS patch, json_extract_string(item, '$.Content.Patch.' || key || '.Id') AS id,
              nullif(json_extract_string(item, '$.Content.Patch.' || key || '.Title'), '') AS title,
              json_extract_string(item, '$.Content.Patch.' || key || '.Severity') AS severity,
              CASE WHEN key = 'KBx' THEN NULL ELSE '2024-03-04 05:06:07' END AS installed,
              replace(json_extract_string(item, '$.Content.Patch.' || key || '.CVEIds'), ',', '|') AS cves
       FROM (SELECT *, unnest(json_keys(item, '$.Content.Patch')) AS key FROM fx_compliance) x
       WHERE key <> 'ComplianceSummary'""",
)
def h_patches(spark, d):
    rows = fixture(spark, d, "fx_compliance").select(
        "resourceId", F.explode(builtin.patches(F.col("item"))).alias("patch", "p")
    )
    return rows.select(
        "resourceId", "patch", F.col("p.Id").alias("id"), F.col("p.Title").alias("title"),
        F.col("p.Severity").alias("severity"), F.date_format("p.InstalledTime", _ISO).alias("installed"),
        _joined("p.CVEIds").alias("cves"),
    )


@query(
    "h_patch_cleanup",
    """SELECT resourceId[36:] AS resourceId, 2 AS patches, json_extract_string(item, '$.Content.Patch.ComplianceSummary.PatchGroup') AS grp
       FROM fx_compliance""",
)
def h_patch_cleanup(spark, d):
    table = fixture(spark, d, "fx_compliance").withColumnRenamed("item", "AWS:ComplianceItem")
    return builtin.patch_compliance(table).select(
        "resourceId", F.size("patches").alias("patches"), F.col("complianceSummary.PatchGroup").alias("grp")
    )


@query(
    "h_sns",
    """SELECT resourceId, policy AS "Policy", cast(json_extract_string(delivery, '$.http.defaultHealthyRetryPolicy.numRetries') AS int) AS retries,
              json_extract_string(delivery, '$.http.defaultHealthyRetryPolicy.backoffFunction') AS backoff,
              cast(json_extract_string(delivery, '$.http.disableSubscriptionOverrides') AS boolean) AS disabled,
              cast(NULL AS varchar) AS header, 3 AS columns FROM fx_topic""",
)
def h_sns(spark, d):
    table = fixture(spark, d, "fx_topic").select(
        "resourceId",
        F.col("policy").alias("Policy"),
        F.col("topicArn").alias("TopicArn"),
        F.lit("x").alias("Tags_1"),
        F.col("delivery").alias("EffectiveDeliveryPolicy"),
    )
    out = builtin.topic(table)
    policy = F.col("EffectiveDeliveryPolicy.http")
    return out.select(
        "resourceId", "Policy",
        policy["defaultHealthyRetryPolicy"]["numRetries"].alias("retries"),
        policy["defaultHealthyRetryPolicy"]["backoffFunction"].alias("backoff"),
        policy["disableSubscriptionOverrides"].alias("disabled"),
        policy["defaultRequestPolicy"]["headerContentType"].alias("header"),
        F.lit(len(out.columns)).alias("columns"),
    )


# -- builds -----------------------------------------------------------------------


def _source_rows(rows: DataFrame) -> DataFrame:
    """Spine rows in the shape a source delivers."""
    return rows.select(
        "arn", "accountId", "awsRegion", "resourceType", "resourceId", "resourceName",
        F.col("configurationItemCaptureTime").alias("capturedAt"),
        F.map_entries("tags").alias("tags"), "configuration",
    )


def _fails(spark, tables):
    raise RuntimeError("listing refused")


def _built(spark, d) -> tuple[Inventory, object]:
    """A full build: recorder items, two sources (one fails), transforms, a custom
    table."""
    spine = changes(spark, d)
    recorded = spine.filter("resourceType <> 'Demo::App::signup'")
    signups = latest_per_key(spine.filter("resourceType = 'Demo::App::signup'"))
    registry = builtin.default_registry(
        user=[
            sql_transform(
                "short_id", "demo_app_click", "SELECT *, replace(resourceId, 'u-', '') AS shortId FROM {table}"
            ),
            sql_transform("broken", "demo_app_click", "SELECT nothing_like_it FROM {table}"),
            sql_transform("absent", "no_such_table", "SELECT * FROM {table}"),
            sql_transform(
                "unmet", "demo_app_error", "SELECT * FROM {table}", condition="SELECT count(*) < 0 FROM {table}"
            ),
        ],
        disabled=frozenset({"sns_topic"}),
    )
    inventory = Inventory(spark, f"{work_folder(spark)}/inventory")
    report = inventory.build(
        BuildInputs(
            items=recorded, identifiers=recorded.select("accountId", "resourceType", "resourceId"),
            accounts=accounts(spark, d),
        ),
        BuildSettings(
            sources=[
                Source("signups", ["Demo::App::signup"], Semantics.AUTHORITATIVE, lambda s, t: _source_rows(signups)),
                Source("refused", ["Demo::App::refused"], Semantics.MERGE, _fails),
            ],
            registry=registry,
            custom_tables=[
                CustomTable("Custom::ByAccount", "SELECT accountId, count(*) AS n FROM demo_app_click GROUP BY accountId", ["demo_app_click"])
            ],
        ),
    )
    return inventory, report


@query(
    "derive_report",
    """SELECT lower(replace(resourceType, '::', '_')) AS name, count(*) AS n, 'written' AS status
       FROM (SELECT DISTINCT accountId, resourceType, resourceId FROM fx_changes) k GROUP BY resourceType""",
)
def derive_report(spark, d):
    """Rows and status of each derived table after a build."""
    inventory, report = _built(spark, d)
    status = report.status("table")
    out = None
    for name in sorted(n for n in status if n.startswith("demo_")):
        rows = inventory.table(name).agg(F.count("*").alias("n")).select(
            F.lit(name).alias("name"), "n", F.lit(status[name]).alias("status")
        )
        out = rows if out is None else out.union(rows)
    return out


@query(
    "source_report",
    """SELECT 'signups' AS name, 'landed' AS status, count(*) AS n
       FROM (SELECT DISTINCT accountId, resourceType, resourceId FROM fx_changes WHERE resourceType = 'Demo::App::signup') k
       UNION ALL SELECT 'refused', 'failed', NULL""",
)
def source_report(spark, d):
    _, report = _built(spark, d)
    return report.frame(spark).filter("step = 'source'").select("name", "status", F.col("rows").alias("n"))


_TRANSFORM_STATUS = """('ec2_instance_state:ec2_instance', 'skipped: missing dependency'),
  ('s3_bucket:s3_bucket', 'skipped: missing dependency'),
  ('vpc_endpoint_addresses:ec2_vpcendpoint,ec2_networkinterface', 'skipped: missing dependency'),
  ('iam_roles_policies:iam_role,iam_user,iam_group,iam_policy,aws_managed_policy', 'skipped: missing dependency'),
  ('ssm_managedinstanceinventory:ssm_managedinstanceinventory', 'skipped: missing dependency'),
  ('ssm_patchcompliance:ssm_patchcompliance', 'skipped: missing dependency'),
  ('organizations_policy:organizations_policy', 'skipped: missing dependency'),
  ('short_id:demo_app_click', 'applied'), ('broken:demo_app_click', 'failed'),
  ('absent:no_such_table', 'skipped: missing dependency'), ('unmet:demo_app_error', 'skipped: condition not met')"""


@query(
    "t_registry_report",
    f"""SELECT name, status FROM (VALUES {_TRANSFORM_STATUS}) r(name, status)
        UNION ALL
        SELECT 'name_from_tags:' || lower(replace(resourceType, '::', '_')),
               CASE WHEN max(nameTag IS NOT NULL) THEN 'applied' ELSE 'skipped: condition not met' END
        FROM fx_changes GROUP BY resourceType
        UNION ALL
        SELECT DISTINCT g.name || lower(replace(resourceType, '::', '_')),
               CASE WHEN resourceType = 'Demo::App::purchase' THEN 'applied' ELSE 'skipped: condition not met' END
        FROM fx_changes CROSS JOIN (VALUES ('drop_tags_1:'), ('drop_arn_1:')) g(name)""",
)
def t_registry_report(spark, d):
    _, report = _built(spark, d)
    return report.frame(spark).filter("step = 'transform'").select("name", "status")
