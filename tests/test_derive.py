import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.operators import containment, policies
from tallyhouse.operators.derive import derive_type, stringify_content, type_schemas
from tallyhouse.operators.infer import InferenceRules, column_type
from tallyhouse.operators.tree import hierarchy_paths

from .conftest import ids, item

INSTANCE = "AWS::EC2::Instance"
INVENTORY = "AWS::SSM::ManagedInstanceInventory"


def derived(spine, *items, resource_type=INSTANCE, **rules):
    rows = spine(*items)
    schemas = type_schemas(rows, **rules)
    return derive_type(rows, schemas[resource_type])


@pytest.mark.parametrize(
    "schema, ddl",
    [
        ("OBJECT<a: BIGINT, `x y`: STRING>", "a bigint, `x y` string"),
        ("OBJECT<`AWS:C`: OBJECT<VOID: BOOLEAN>>", "`AWS:C` struct<VOID:boolean>"),
        ("OBJECT<n: VOID, m: OBJECT<>, l: ARRAY<VOID>, v: VARIANT>", "n string, m map<string,string>, l array<string>, v string"),
        ("OBJECT<d: DECIMAL(2,1), e: ARRAY<OBJECT<k: DOUBLE>>>", "d double, e array<struct<k:double>>"),
    ],
)
def test_column_type(spark, schema, ddl):
    assert column_type(schema) == T.StructType.fromDDL(ddl)


def test_rules_override(spark):
    schema = "OBJECT<a: OBJECT<x: BIGINT, y: BIGINT, z: BIGINT>, t: STRING>"
    rules = InferenceRules(overrides={("T", "t"): T.TimestampType()})
    got = column_type(schema, "T", rules)
    assert got["t"].dataType == T.TimestampType()
    assert column_type(schema, "Other", rules)["t"].dataType == T.StringType()


def test_keys_become_columns_in_order(spine):
    df = derived(
        spine,
        item(configuration={"b": 1, "state": {"name": "running"}}, supplementaryConfiguration={"extra": [1]}),
        item(resource_id="i-2", configuration={"a": "x", "b": 2.5}, supplementaryConfiguration={"extra": []}),
    )
    assert df.columns[-4:] == ["a", "b", "state", "extra"]
    assert "configuration" not in df.columns
    rows = {r.resourceId: r for r in df.collect()}
    assert rows["i-1"].state.name == "running" and rows["i-1"].a is None and rows["i-2"].b == 2.5


def test_collisions_get_a_suffix(spine):
    df = derived(spine, item(configuration={"Tags": [1], "arn": "inner", "x": 1}, supplementaryConfiguration={"X": 2}))
    assert df.columns[-4:] == ["Tags_1", "arn_1", "x", "X_1"]
    row = df.first()
    assert (row.arn_1, row.x, row.X_1) == ("inner", 1, 2)


def test_empty_null_and_odd_documents_keep_their_rows(spine):
    df = derived(
        spine,
        item(resource_id="a", configuration={}),
        item(resource_id="b", configuration=None),
        item(resource_id="c", configuration={"k": 1}),
        item(resource_id="d", configuration="text"),
    )
    assert ids(df) == ["a", "b", "c", "d"]
    assert df.columns[-3:] == ["configuration", "k", "supplementaryConfiguration"]
    assert df.filter("configuration IS NOT NULL").isEmpty()


def test_conflicting_values_are_kept_as_text(spine):
    df = derived(spine, item(configuration={"v": {"a": 1}}), item(resource_id="i-2", configuration={"v": "s"}))
    got = {r.resourceId: r.v for r in df.collect()}
    assert got["i-2"] == "s" and json.loads(got["i-1"]) == {"a": 1}


def test_content_objects_stay_text(spine):
    rows = stringify_content(
        spine(
            item("AWS::Organizations::Policy", "p-1", configuration={"Content": {"z": 1, "a": 2}, "Name": "n"}),
            item("AWS::Organizations::Policy", "p-2", configuration={"Content": "plain", "Name": "n"}),
        )
    )
    df = derive_type(rows, type_schemas(rows)["AWS::Organizations::Policy"])
    got = {r.resourceId: r.Content for r in df.collect()}
    assert json.loads(got["p-1"]) == {"z": 1, "a": 2} and got["p-2"] == "plain"


def test_keys_that_are_data_do_not_become_columns(spine):
    rows = spine(
        *[
            item(
                INVENTORY,
                f"mi-{i}",
                configuration={
                    "AWS:Application": {"Content": {f"app{i}": {"Name": "n"}}},
                    "AWS:InstanceInformation": {"Content": {f"mi-{i}": {"AgentVersion": str(i)}}},
                    "Other": i,
                },
            )
            for i in range(3)
        ]
    )
    schema = type_schemas(rows)[INVENTORY].types["configuration"]
    info = schema["AWS:InstanceInformation"].dataType["Content"].dataType
    assert info == T.MapType(T.StringType(), T.StructType.fromDDL("AgentVersion string"))
    assert isinstance(schema["AWS:Application"].dataType["Content"].dataType, T.MapType)
    assert schema["Other"].dataType == T.LongType()


def test_repeated_key_does_not_multiply_rows(spine):
    assert derived(spine, item(configuration={"k": 1}), item(configuration={"k": 2})).count() == 2


# -- joins through lists -------------------------------------------------------


def test_contained_values(spark):
    rows = spark.createDataFrame(
        [("a", ["1", "2", "1"]), ("b", ["9", None]), ("c", None), ("d", [])], "key string, ids array<string>"
    )
    lookup = spark.createDataFrame(
        [("1", "ip1"), ("1", "ip1b"), ("2", "ip2"), ("3", "ip3"), ("9", None)], "id string, ip string"
    )
    out = containment.contained_values(rows, "key", F.col("ids"), lookup, "id", "ip", "ips")
    assert {r.key: r.ips for r in out.collect()} == {"a": ["ip1", "ip1b", "ip2"], "b": [], "c": None, "d": None}


def test_containment_has_no_nested_loop(spark):
    rows = spark.createDataFrame([("a", ["1"])], "key string, ids array<string>")
    lookup = spark.range(3).select(F.col("id").cast("string"), F.lit("x").alias("v"))
    out = containment.contained_values(rows, "key", F.col("ids"), lookup, "id", "v", "o")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_hot_policy_against_brute_force(spark):
    """One policy is attached to a third of all principals."""
    attachments = spark.range(3000).select(
        F.concat(F.lit("role"), (F.col("id") % 900).cast("string")).alias("principal"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") % 40).cast("string"))).alias("policyArn"),
    )
    table = [("hot", ["s-hot", "s-1"])] + [(f"p{i}", [f"s-{i % 7}"]) for i in range(30)]
    known = spark.createDataFrame(table, "arn string, policyStatements array<string>")
    got = {(r.principal, r.statement) for r in policies.attached_statements(attachments, known).collect()}
    lookup = dict(table)
    want = {(r.principal, s) for r in attachments.collect() for s in lookup.get(r.policyArn, [])}
    assert got == want


# -- hierarchy -----------------------------------------------------------------


def tree(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, name string, parentId string")


def test_paths_from_parent_ids(spark):
    nodes = tree(
        spark,
        ("ou-w", "Workloads", "ou-p"),
        ("ou-p", "Prod", "r-root"),
        ("ou-deep", "Deep", "ou-w"),
        ("ou-lost", "Lost", "ou-nowhere"),
        ("ou-x", "X", "ou-y"),
        ("ou-y", "Y", "ou-x"),
    )
    got = {r.id: (r.path, r.depth) for r in hierarchy_paths(nodes).collect()}
    assert got == {
        "ou-p": ("/Prod", 1),
        "ou-w": ("/Prod/Workloads", 2),
        "ou-deep": ("/Prod/Workloads/Deep", 3),
    }


def test_hierarchy_without_nodes_or_too_deep(spark):
    assert hierarchy_paths(tree(spark, ("a", "A", None))).count() == 0
    chain = tree(spark, ("n0", "n", "r-1"), *[(f"n{i}", "n", f"n{i-1}") for i in range(1, 5)])
    assert hierarchy_paths(chain).count() == 5


def test_hierarchy_of_any_depth_and_with_cycles(spark):
    links = [(f"n{i}", "n", f"n{i-1}") for i in range(1, 1500)]
    nodes = tree(spark, ("n0", "n", "r-1"), *links, ("c1", "c", "c2"), ("c2", "c", "c1"), ("c3", "c", "c1"))
    got = {r.id: (r.depth, r.path) for r in hierarchy_paths(nodes).collect()}
    assert got == {f"n{i}": (i + 1, "/n" * (i + 1)) for i in range(1500)}


def test_objects_of_any_width_stay_structs(spine):
    df = derived(spine, item(configuration={"o": {f"k{i}": i for i in range(300)}}))
    assert len(df.schema["o"].dataType.fields) == 300
    assert df.first().o.k299 == 299


def test_large_whole_numbers_keep_their_digits(spine):
    df = derived(spine, item(configuration={"n": 12345678901234567890, "l": [98765432109876543210]}))
    row = df.first()
    assert int(row.n) == 12345678901234567890 and int(row.l[0]) == 98765432109876543210


def test_siblings_of_ruled_keys_are_columns(spine):
    kind = INVENTORY
    content = {"i-1": {"Agent": "x"}}
    df = derived(
        spine,
        item(kind, configuration={
            "AWS:Application": {"SchemaVersion": "1.1", "Content": {"app": {"v": 1}}},
            "AWS:InstanceInformation": {"CaptureTime": "t", "Content": content},
        }),
        item(kind, "i-2", configuration={"other": 1}),
        resource_type=kind,
    )
    row = df.filter("resourceId = 'i-1'").first()
    assert row["AWS:Application"].SchemaVersion == "1.1"
    assert row["AWS:Application"].Content == {"app": '{"v":1}'}
    assert row["AWS:InstanceInformation"].CaptureTime == "t"
    assert row["AWS:InstanceInformation"].Content["i-1"].Agent == "x"
    assert "AWS:WindowsUpdate" not in df.columns


def test_documents_that_cannot_be_read_are_counted(spark, spine):
    good = spine(item(configuration={"a": 1}))
    bad = good.withColumn("configuration", F.lit('{"only": 1, "only": 2}'))
    schemas = type_schemas(good.unionByName(bad))
    assert schemas["AWS::EC2::Instance"].refused == 1
