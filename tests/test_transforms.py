import json
from datetime import datetime
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tallyhouse.plans import builtin
from tallyhouse.plans.builtin import default_registry
from tallyhouse.plans.transforms import (
    APPLIED,
    FAILED,
    NO_CONDITION,
    NO_DEPENDENCY,
    CustomTable,
    GlobalTransform,
    Registry,
    Transform,
    custom_table,
    run_transforms,
    sql_global_transform,
    sql_transform,
)

KEYS = "arn string, accountId string, awsRegion string, resourceType string, resourceId string, resourceName string"


def keyed(spark, schema, *rows):
    """Derived-table rows: (account, id, name, *rest) with the other base columns filled."""
    full = [(f"arn:{r[1]}", r[0], "eu", "T", r[1], r[2], *r[3:]) for r in rows]
    return spark.createDataFrame(full, f"{KEYS}, {schema}" if schema else KEYS)


def doc(value):
    return quote(json.dumps(value))


ALLOW = {"Effect": "Allow", "Action": "s3:*"}
DENY = {"Effect": "Deny", "Action": "a+b c"}


def iam(spark):
    versions = "policyVersionList array<struct<isDefaultVersion:boolean,document:string>>"
    own = keyed(
        spark,
        versions,
        ("1", "p-one", "One", [(False, doc({"Statement": [DENY]})), (True, doc({"Statement": ALLOW}))]),
        ("1", "p-none", "None", [(False, doc({}))]),
        ("1", "p-bad", "Bad", [(True, "%7Bnot json")]),
    )
    managed = spark.createDataFrame(
        [("arn:aws", "v1", None, [json.dumps(DENY, separators=(",", ":"))])],
        "arn string, defaultVersionId string, policyDocument string, policyStatements array<string>",
    )
    attached = "attachedManagedPolicies array<struct<policyName:string,policyArn:string>>"
    inline = "{}PolicyList array<struct<policyName:string,policyDocument:string>>"
    inl = [("in", doc({"Statement": [ALLOW, {"Effect": "Inline"}]}))]
    role = keyed(
        spark,
        f"assumeRolePolicyDocument string, {attached}, {inline.format('role')}",
        ("1", "r-1", "r", doc({"V": 1}), [("One", "arn:p-one"), ("Aws", "arn:aws")], inl),
        ("1", "r-2", "r", None, [("X", "arn:unknown")], inl),
        ("1", "r-3", "r", None, [], []),
        ("1", "r-4", "r", None, None, None),
    )
    group = keyed(
        spark,
        f"{attached}, {inline.format('group')}",
        ("1", "g-1", "admins", [("One", "arn:p-one")], [("o", doc({"Statement": {"Effect": "G1"}}))]),
        ("2", "g-2", "admins", [("Aws", "arn:aws")], []),
    )
    user = keyed(
        spark,
        f"{attached}, {inline.format('user')}, groupList array<string>",
        ("1", "u-1", "u", [("Aws", "arn:aws")], [], ["admins", "admins", "ghost"]),
        ("2", "u-2", "u", [], [], ["admins"]),
        ("1", "u-3", "u", None, None, None),
    )
    return {"iam_policy": own, "aws_managed_policy": managed, "iam_role": role, "iam_group": group, "iam_user": user}


def effects(df):
    return {
        r.resourceId: None if r.effectivePolicyStatements is None else sorted(json.loads(s)["Effect"] for s in r.effectivePolicyStatements)
        for r in df.collect()
    }


def test_policies_of_principals(spark):
    out = builtin.principal_policies(iam(spark))
    own = {r.resourceId: r.policyStatements for r in out["iam_policy"].collect()}
    assert [json.loads(s) for s in own["p-one"]] == [ALLOW] and own["p-none"] == [] and own["p-bad"] == []
    assert effects(out["iam_role"]) == {"r-1": ["Allow", "Deny", "Inline"], "r-2": None, "r-3": None, "r-4": None}
    assert effects(out["iam_group"]) == {"g-1": ["Allow", "G1"], "g-2": ["Deny"]}
    assert effects(out["iam_user"]) == {"u-1": ["Allow", "Deny", "G1"], "u-2": ["Deny"], "u-3": []}
    role = out["iam_role"].filter("resourceId = 'r-1'").first()
    assert role.attachedManagedPolicies == {"One": "arn:p-one", "Aws": "arn:aws"}
    assert json.loads(role.assumeRolePolicyDocument) == {"V": 1}
    assert set(role.inlinePolicies) == {"in"} and "_row" not in out["iam_role"].columns


def test_groups_of_other_accounts_only_when_asked(spark):
    out = builtin.principal_policies(iam(spark), scope_by_account=False)
    assert effects(out["iam_user"])["u-2"] == ["Allow", "Deny", "G1"]


def test_instance_state_tolerates_missing_fields(spark):
    df = keyed(spark, "state struct<code:int,name:string>", ("1", "i-1", None, (16, "running")))
    row = builtin.instance_state(df).first()
    assert (row.state, row.stateReason) == ("running", None)


def test_endpoint_addresses(spark):
    endpoints = keyed(
        spark,
        "networkInterfaceIds array<string>",
        ("1", "e-1", None, ["eni-1", "eni-2"]),
        ("1", "e-2", None, ["eni-9"]),
        (None, "e-3", None, ["eni-1"]),
        ("1", "e-4", None, None),
    )
    interfaces = keyed(spark, "privateIpAddress string", ("1", "eni-1", None, "10.0.0.2"), ("1", "eni-2", None, "10.0.0.1"))
    out = builtin.endpoint_addresses(endpoints, interfaces)
    got = {r.resourceId: r.privateIpAddresses for r in out.collect()}
    assert got == {"e-1": ["10.0.0.1", "10.0.0.2"], "e-2": None, "e-3": ["10.0.0.2"], "e-4": None}


def test_instance_inventory(spark):
    content = "struct<Content:map<string,string>>"
    schema = (
        f"`AWS:Application` {content}, `AWS:WindowsUpdate` {content}, "
        "`AWS:InstanceInformation` struct<Content:map<string,struct<AgentVersion:string,resourceName:string>>>"
    )
    app = {"Name": "a", "InstalledTime": "2024-01-02T03:04:05Z", "Epoch": 7}
    df = keyed(
        spark,
        schema,
        (
            "1",
            "mi-1",
            None,
            ({"x": json.dumps(app), "y": json.dumps([{"Name": "b", "InstalledTime": ""}, {"Name": "c"}]), "z": None, "w": "text"},),
            ({"KB1": json.dumps({"installedtime": "", "description": "", "hotfixid": "h"}), "KB2": None},),
            ({"mi-1": ("3.1", "host"), "mi-2": ("9", "other")},),
        ),
        ("1", "mi-2", None, None, None, None),
    )
    out = builtin.instance_inventory(df)
    assert [c for c in out.columns if ":" in c] == []
    rows = {r.resourceId: r for r in out.collect()}
    one = rows["mi-1"]
    assert [(a.Name, a.InstalledTime, a.Epoch) for a in one.applications] == [
        ("a", datetime(2024, 1, 2, 3, 4, 5), "7"),
        ("b", None, None),
        ("c", None, None),
    ]
    assert set(one.windowsUpdates) == {"KB1"}
    assert tuple(one.windowsUpdates["KB1"]) == (None, None, "h", None)
    assert (one.AgentVersion, one.resourceName_1) == ("3.1", "host")
    assert rows["mi-2"].applications == [] and rows["mi-2"].windowsUpdates is None
    assert rows["mi-2"].AgentVersion is None


def test_patch_compliance(spark):
    prefix = "AWS::SSM::ManagedInstanceInventory/"
    assert len(prefix) == builtin.COMPLIANCE_ID_PREFIX
    patch = {
        "ComplianceSummary": {"Status": "COMPLIANT", "CompliantHighCount": 3, "NonCompliantLowCount": "4"},
        "KB1": {"Id": "KB1", "Title": "", "Severity": "High", "InstalledTime": "2024-01-02T03:04:05Z", "CVEIds": "a,b"},
        "KB2": {"Id": "KB2", "Status": "", "InstalledTime": "", "CVEIds": None},
    }
    df = keyed(
        spark,
        "`AWS:ComplianceItem` string",
        ("1", prefix + "mi-1", None, json.dumps({"Content": {"Patch": patch}})),
        ("1", prefix + "mi-2", None, None),
        ("1", prefix + "mi-3", None, "no json"),
    )
    rows = {r.resourceId: r for r in builtin.patch_compliance(df).collect()}
    one = rows["mi-1"]
    assert (one.complianceSummary.Status, one.complianceSummary.CompliantHighCount, one.complianceSummary.NonCompliantLowCount) == ("COMPLIANT", 3, 4)
    assert set(one.patches) == {"KB1", "KB2"}
    assert (one.patches["KB1"].Title, one.patches["KB1"].CVEIds) == (None, ["a", "b"])
    assert one.patches["KB1"].InstalledTime == datetime(2024, 1, 2, 3, 4, 5)
    assert one.patches["KB2"].InstalledTime is None and one.patches["KB2"].CVEIds is None
    assert rows["mi-2"].patches is None and rows["mi-3"].complianceSummary is None
    assert "AWS:ComplianceItem" not in builtin.patch_compliance(df).columns


def test_topic(spark):
    df = keyed(
        spark,
        "Policy struct<Statement:array<string>>, TopicArn string, Tags_1 array<string>, "
        "EffectiveDeliveryPolicy struct<http:struct<defaultHealthyRetryPolicy:struct<numRetries:bigint,backoffFunction:string>,disableSubscriptionOverrides:boolean>>",
        ("1", "t", None, (["s"],), "arn", [], (((3, "linear"), False),)),
    )
    row = builtin.topic(df).first()
    assert json.loads(row.Policy) == {"Statement": ["s"]}
    http = row.EffectiveDeliveryPolicy.http
    assert (http.defaultHealthyRetryPolicy.numRetries, http.defaultHealthyRetryPolicy.minDelayTarget) == (3, None)
    assert http.defaultRequestPolicy is None and http.disableSubscriptionOverrides is False
    assert "TopicArn" not in row.asDict() and "Tags_1" not in row.asDict()


def test_bucket(spark):
    df = keyed(
        spark,
        "owner struct<id:string,name:string>, AccessControlList string, BucketPolicy struct<policytext:string>",
        ("1", "b", None, ("own", "n"), '{"g":1}', ('{"V":1}',)),
    )
    row = builtin.bucket(df).first()
    assert (row.owner, row.AbacStatus, row.AccessControlList, row.BucketPolicy) == ("own", None, '{"g":1}', '{"V":1}')


# -- framework -------------------------------------------------------------------


@pytest.fixture
def tables(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, val string")
    return {"one": t, "two": t}


def statuses(run):
    return {(name, table): status for name, table, status, _ in run.report}


def test_a_missing_dependency_skips(tables):
    registry = Registry(user=[Transform("t", ["one", "none"], lambda t: {"one": t["one"].limit(0)})])
    run = run_transforms(tables, registry)
    assert statuses(run) == {("t", "one,none"): NO_DEPENDENCY}
    assert run.tables["one"].count() == 2


def test_conditions_and_failures_are_isolated(tables):
    def boom(_):
        raise RuntimeError("no")

    registry = Registry(
        user=[
            Transform("off", ["one"], lambda t: {"one": t["one"].limit(0)}, lambda t: False),
            Transform("bad condition", ["one"], lambda t: {"one": t["one"].limit(0)}, boom),
            Transform("bad column", ["one"], lambda t: {"one": t["one"].select("missing")}),
            Transform("half", ["one", "two"], lambda t: {"one": t["one"].limit(0), "two": t["two"].select("missing")}),
            Transform("good", ["one"], lambda t: {"one": t["one"].withColumn("more", F.lit(1))}),
        ]
    )
    run = run_transforms(tables, registry)
    got = {name: status for name, _, status, _ in run.report}
    assert got == {"off": NO_CONDITION, "bad condition": FAILED, "bad column": FAILED, "half": FAILED, "good": APPLIED}
    assert run.tables["one"].columns == ["id", "val", "more"] and run.tables["one"].count() == 2


def test_transforms_of_one_table_compose_in_order(tables):
    registry = Registry(
        builtin=[sql_transform("first", "one", "SELECT *, id + 1 AS x FROM {table}")],
        user=[sql_transform("second", "one", "SELECT *, x * 2 AS y FROM {table};")],
    )
    run = run_transforms(tables, registry)
    assert sorted(r.y for r in run.tables["one"].collect()) == [4, 6]


def test_builtins_can_be_disabled(tables):
    names = [t.name for t in default_registry().transforms()]
    assert len(names) == len(set(names)) == 8
    assert "sns_topic" not in [t.name for t in default_registry(disabled=frozenset({"sns_topic"})).transforms()]
    user = [sql_transform("mine", "one", "SELECT * FROM {table}")]
    registry = default_registry(disable_all=True, user=user)
    assert [t.name for t in registry.transforms()] == ["mine"] and registry.global_transforms() == []


def test_global_transforms_run_on_every_table(tables):
    registry = Registry(
        user_global=[
            sql_global_transform("add", "SELECT *, 'x' AS g FROM {table}", "SELECT count(*) > 1 FROM {table}"),
            GlobalTransform("never", lambda df: df.limit(0), lambda name, df: name == "other"),
            GlobalTransform("broken", lambda df: df.select("missing")),
        ]
    )
    run = run_transforms(tables, registry)
    assert statuses(run) == {
        ("add", "one"): APPLIED,
        ("add", "two"): APPLIED,
        ("never", "one"): NO_CONDITION,
        ("never", "two"): NO_CONDITION,
        ("broken", "one"): FAILED,
        ("broken", "two"): FAILED,
    }
    assert run.tables["two"].columns == ["id", "val", "g"]


def test_sql_conditions_of_all_tables_are_one_action(spark, monkeypatch):
    actions, collect = [], DataFrame.collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda df: actions.append(df) or collect(df))
    tables = {f"t{i}": spark.range(i).selectExpr("id", "id % 2 AS val") for i in range(9)}
    run = run_transforms(tables, Registry(user_global=[sql_global_transform("add", "SELECT *, 1 AS g FROM {table}", "SELECT count(*) > 1 FROM {table}")]))
    assert len(actions) == 1
    assert {t for (_, t), s in statuses(run).items() if s == APPLIED} == {f"t{i}" for i in range(2, 9)}


def test_sql_conditions_fail_alone_and_take_any_type(spark):
    tables = {"zero": spark.range(2), "text": spark.range(2).selectExpr("'x' AS id"), "none": spark.range(0), "other": spark.range(1).toDF("x")}
    add = sql_global_transform("add", "SELECT *, 1 AS g FROM {table}", "SELECT id FROM {table} ORDER BY id")
    got = statuses(run_transforms(tables, Registry(user_global=[add])))
    assert got == {("add", "zero"): NO_CONDITION, ("add", "text"): APPLIED, ("add", "none"): NO_CONDITION, ("add", "other"): FAILED}
    raising = sql_global_transform("add", "SELECT * FROM {table}", "SELECT assert_true(id = 'x') IS NULL FROM {table}")
    late = {"good": spark.createDataFrame([("x",)], "id string"), "bad": spark.createDataFrame([("y",)], "id string")}
    got = statuses(run_transforms(late, Registry(user_global=[raising])))
    assert got == {("add", "good"): APPLIED, ("add", "bad"): FAILED}


def test_only_a_select_is_accepted(tables):
    for sql in ("DROP TABLE one", "CREATE TABLE x AS SELECT 1", "SELECT 1; SELECT 2"):
        run = run_transforms(tables, Registry(user=[sql_transform("t", "one", sql)]))
        assert statuses(run) == {("t", "one"): FAILED}
        with pytest.raises(ValueError, match="not a single SELECT"):
            custom_table(tables, CustomTable("C", sql, ["one"]))


def test_custom_table_names_itself(tables):
    out = custom_table(tables, CustomTable("Custom::Sums", "SELECT sum(id) AS s FROM one"))
    assert [tuple(r) for r in out.collect()] == [(3, "Custom::Sums")]


def test_name_from_tags_and_suffixed_columns(spark):
    df = spark.createDataFrame(
        [("i-1", None, {"Name": "web"}, 1, 2), ("i-2", "kept", {}, 1, 2)],
        "resourceId string, resourceName string, tags map<string,string>, Tags_1 int, ARN_1 int",
    )
    run = run_transforms({"t": df}, default_registry())
    assert run.tables["t"].columns == ["resourceId", "resourceName", "tags", "tagName"]
    assert {(r.resourceName, r.tagName) for r in run.tables["t"].collect()} == {("web", "web"), ("kept", None)}
    untagged = run_transforms({"t": df.filter("resourceId = 'i-2'")}, default_registry())
    assert "tagName" not in untagged.tables["t"].columns
