import gzip
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyhouse.schemas import SPINE
from tallyhouse.sources import items, results, snapshots
from tallyhouse.sources.contract import source_rows_to_spine
from tallyhouse.sources.organization import named_accounts, policy_documents, policy_versions, unit_rows
from tallyhouse.sources.store import Files, Store, staged

from .conftest import ids, item


def write_lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_read_items(spark, tmp_path):
    path = write_lines(
        tmp_path / "items.json",
        [
            item(tags=[{"key": "Name", "value": "web"}], configuration={"b": 1, "a": {"c": [1, 2]}}),
            item(resource_id="i-2", tags=None, configuration=None, accountId=None),
        ],
    )
    df = items.read_items(spark, path)
    assert df.columns == SPINE.names
    rows = {r.resourceId: r for r in df.collect()}
    assert rows["i-1"].tags == {"Name": "web"}
    assert rows["i-1"].configuration == '{"b": 1, "a": {"c": [1, 2]}}'
    assert rows["i-1"].configurationItemCaptureTime == datetime(2026, 1, 10)
    assert rows["i-2"].tags is None and rows["i-2"].configuration is None


def test_a_value_that_does_not_convert_fails_the_load(spark, tmp_path):
    path = write_lines(tmp_path / "bad.json", [item(configurationItemCaptureTime="not a time")])
    with pytest.raises(Exception):
        items.read_items(spark, path).collect()


def test_empty_file_has_no_rows(spark, tmp_path):
    (tmp_path / "empty.json").write_text("")
    assert items.read_items(spark, str(tmp_path / "empty.json")).count() == 0
    assert items.read_identifiers(spark, str(tmp_path / "empty.json")).count() == 0


def test_tags_that_are_no_array_become_empty(spark, tmp_path):
    absent = item(resource_id="absent")
    del absent["tags"]
    path = write_lines(
        tmp_path / "raw.json",
        [
            item(resource_id="list", tags=[{"key": "env", "value": "prod"}]),
            item(resource_id="object", tags={}),
            absent,
        ],
    )
    tags = {r.resourceId: r.tags for r in items.read_raw_items(spark, path).collect()}
    assert tags == {"list": {"env": "prod"}, "object": {}, "absent": None}


def test_repeated_tag_key_is_an_error(spark, tmp_path):
    twice = [{"key": "a", "value": "1"}, {"key": "a", "value": "2"}]
    path = write_lines(tmp_path / "dup.json", [item(tags=twice)])
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        items.read_items(spark, path).collect()


def test_normalized_items(spark):
    schema = "resourceId string, configuration string, supplementaryConfiguration map<string,string>"
    raw = spark.createDataFrame(
        [
            ("json", '{"instanceType":"t3"}', {"a": '{"b":true}', "c": "not-json"}),
            ("text", "not-valid-json", None),
            ("none", None, {}),
        ],
        schema,
    )
    rows = {r.resourceId: r for r in items.normalized_items(raw).collect()}
    assert rows["json"].configuration == '{"instanceType":"t3"}'
    assert json.loads(rows["json"].supplementaryConfiguration) == {"a": {"b": True}, "c": "not-json"}
    assert rows["text"].configuration == '"not-valid-json"'
    assert rows["text"].supplementaryConfiguration == "{}"
    assert rows["none"].configuration is None and rows["none"].supplementaryConfiguration == "{}"
    assert rows["json"].tags == {} and rows["json"].relationships == []


def test_changed_since_is_strict_and_drops_untimed(spine):
    rows = spine(
        item(resource_id="at"),
        item(resource_id="after", configurationItemCaptureTime="2026-01-10T00:00:00.000001Z"),
        item(resource_id="untimed", configurationItemCaptureTime=None),
    )
    assert ids(items.changed_since(rows, datetime(2026, 1, 10))) == ["after"]
    assert len(ids(items.changed_since(rows, None))) == 3


def snapshot(root, account, region, day, name, content):
    folder = root / "AWSLogs" / account / "Config" / region / day / "ConfigSnapshot"
    folder.mkdir(parents=True, exist_ok=True)
    if content is not None:
        with gzip.open(folder / name, "wt") as f:
            json.dump(content, f)


def envelope(*resource_ids):
    rows = [item(resource_id=r, tags={"Name": r}, configuration={"n": 1}) for r in resource_ids]
    return {"fileVersion": "1.0", "configurationItems": rows}


def test_latest_snapshot_per_account_and_region(spark, tmp_path):
    snapshot(tmp_path, "1", "eu", "2024/9/30", "a.json.gz", envelope("old"))
    snapshot(tmp_path, "1", "eu", "2024/10/2", "a.json.gz", envelope("old"))
    snapshot(tmp_path, "1", "eu", "2024/10/10", "a.json.gz", envelope("older-same-day"))
    snapshot(tmp_path, "1", "eu", "2024/10/10", "b.json.gz", envelope("x", "y"))
    snapshot(tmp_path, "1", "eu", "2024/10/11", "c.json.gz", None)
    snapshot(tmp_path, "1", "us", "2023/1/1", "a.json.gz", envelope("z"))
    snapshot(tmp_path, "2", "eu", "2024/2/1", "a.json.gz", envelope())
    listing = snapshots.list_snapshot_paths(spark, str(tmp_path))
    chosen = snapshots.latest_snapshots(listing)
    assert {(r.accountId, r.awsRegion): r.objectsThatDay for r in chosen.collect()} == {
        ("1", "eu"): 2,
        ("1", "us"): 1,
        ("2", "eu"): 1,
    }
    rows = snapshots.read_latest_snapshots(spark, str(tmp_path))
    assert rows.columns == SPINE.names
    assert ids(rows) == ["x", "y", "z"]
    assert rows.filter("resourceId = 'x'").first().tags == {"Name": "x"}


def test_envelope_without_items_fails(spark, tmp_path):
    snapshot(tmp_path, "1", "eu", "2024/1/1", "a.json.gz", {"fileVersion": "1.0"})
    with pytest.raises(Exception, match="malformed json"):
        snapshots.read_latest_snapshots(spark, str(tmp_path)).collect()


class CountingFiles(Files):
    def __init__(self, spark):
        super().__init__(spark)
        self.listed = []

    def children(self, path):
        self.listed.append(path)
        return super().children(path)


def test_the_walk_lists_no_history(spark, tmp_path):
    for year in (2022, 2023, 2024):
        for month in (1, 2, 11):
            for day in (3, 9, 21):
                snapshot(tmp_path / "prefix", "1", "eu", f"{year}/{month}/{day}", "a.json.gz", envelope("x"))
    snapshot(tmp_path / "prefix", "1", "eu", "2024/11/30", "a.json.gz", None)
    files = CountingFiles(spark)
    found = snapshots.newest_snapshot_paths(spark, str(tmp_path), files)
    assert [f.partition("/Config/")[2] for f in found] == ["eu/2024/11/21/ConfigSnapshot/a.json.gz"]
    # Accounts, regions, years, months, days, and the objects of two days.
    assert len(files.listed) == 7
    listing = snapshots.latest_snapshots(snapshots.list_snapshot_paths(spark, str(tmp_path)))
    assert [r.path.partition("/Config/")[2] for r in listing.collect()] == [f.partition("/Config/")[2] for f in found]
    assert snapshots.newest_snapshot_paths(spark, str(tmp_path / "none")) == []


AWKWARD = {
    "head": {"configurationItems": [{"resourceId": "no"}], "text": 'a } ] " \\'},
    "configurationItems": [
        item(resource_id='q"}]', configuration={"policy": '{"a":[{"b":"}"}]}', "l": [[], [{}], "]"]}, tags={"k": "\\"}),
        item(resource_id="é}", configuration=None, supplementaryConfiguration={"deep": {"er": [{"x": {}}]}}, tags={}),
    ],
    "tail": [{"configurationItems": [1]}, "}"],
}


def plain_rows(df):
    """Rows with their JSON texts parsed, as white space in these may differ."""
    texts = ("configuration", "supplementaryConfiguration")
    return [{k: json.loads(v) if k in texts and v else v for k, v in r.asDict().items()} for r in df.collect()]


@pytest.mark.parametrize("indent", [None, 1])
def test_items_are_cut_out_of_documents(spark, tmp_path, indent):
    text = json.dumps(AWKWARD, indent=indent, ensure_ascii=False)
    with gzip.open(tmp_path / "a.json.gz", "wt", encoding="utf-8") as f:
        f.write(text + "\n")
    (tmp_path / "b.json").write_text(text, encoding="utf-8")
    streamed = snapshots.read_snapshots(spark, [str(tmp_path / "a.json.gz")])
    whole = snapshots.read_snapshots(spark, [str(tmp_path / "b.json")])
    assert streamed.schema.names == whole.schema.names
    assert plain_rows(streamed) == plain_rows(whole) and ids(streamed) == ['q"}]', "é}"]
    both = snapshots.read_snapshots(spark, [str(tmp_path / n) for n in ("a.json.gz", "b.json")])
    assert both.count() == 4 and snapshots.read_snapshots(spark, []).count() == 0


@pytest.mark.parametrize("text", ['{"configurationItems":[{"a":1', '{"configurationItems":[{"a":1}', '{"configurationItems":[1]}',
                                  '{"configurationItems":null}', '{"configurationItems":[]} x'])
def test_broken_documents_fail(spark, tmp_path, text):
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write(text)
    with pytest.raises(Exception, match="malformed json"):
        snapshots.read_snapshots(spark, [str(tmp_path / "a.json.gz")]).collect()


def test_a_long_document_is_held_by_the_item(spark, tmp_path):
    held, splitter = 0, snapshots.ItemSplitter()
    count = 0
    lines = ['{"configurationItems":['] + [json.dumps(item(resource_id=str(i), configuration={"t": "}" * 50})) + "," for i in range(5000)]
    for piece in "".join(lines).rstrip(",").__add__("]}").split("}")[:-1]:
        count += splitter.feed(piece) is not None
        held = max(held, sum(map(len, splitter._parts)))
    splitter.close()
    assert count == 5000 and held < 1000


def test_unit_rows_keep_tags_by_id(spark):
    units = spark.createDataFrame(
        [(f"ou-{i}", f"arn:{i}", f"name-{i}", "r-root" if i else None) for i in range(12)],
        "id string, arn string, name string, parentId string",
    )
    tags = spark.createDataFrame(
        [(f"ou-{i}", "Team", f"t{i}") for i in range(11, 0, -1)], "unitId string, key string, value string"
    )
    at = F.lit("2026-07-17 12:00:00").cast("timestamp")
    rows = {r.resourceId: r for r in source_rows_to_spine(unit_rows(units, tags, "1", at)).collect()}
    assert all(rows[f"ou-{i}"].tags == {"Team": f"t{i}"} for i in range(1, 12))
    assert rows["ou-0"].tags == {} and json.loads(rows["ou-0"].configuration) == {"ParentId": None}
    one = rows["ou-3"].asDict()
    assert one == {
        "arn": "arn:3",
        "accountId": "1",
        "awsRegion": "global",
        "resourceType": "AWS::Organizations::OrganizationalUnit",
        "resourceId": "ou-3",
        "resourceName": "name-3",
        "availabilityZone": None,
        "resourceCreationTime": None,
        "configurationItemCaptureTime": datetime(2026, 7, 17, 12),
        "configurationItemStatus": None,
        "configurationStateId": None,
        "tags": {"Team": "t3"},
        "relationships": [],
        "configuration": '{"ParentId":"r-root"}',
        "supplementaryConfiguration": "{}",
    }


def test_listings_require_their_ids(spark):
    accounts = spark.createDataFrame([("1", None), (None, "x")], "accountId string, accountName string")
    assert ids(named_accounts(accounts), "accountId") == ["1"]
    listed = spark.createDataFrame([("a", "v1"), ("b", None), (None, "v1")], "arn string, defaultVersionId string")
    assert ids(policy_versions(listed), "arn") == ["a"]
    fetched = spark.createDataFrame([("a", "v1", "%7B%22Version%22%3A1%7D")], "arn string, defaultVersionId string, document string")
    assert policy_documents(fetched).first().policyDocument == '{"Version":1}'


@pytest.fixture
def table(spark):
    return spark.createDataFrame([(2, "b", ["x"]), (1, None, None), (3, 'c"\t', [])], "n int, s string, l array<string>")


def read_parts(folder):
    parts = sorted(folder.rglob("part-*"), key=lambda p: str(p))
    return "".join(p.read_text() for p in parts)


def test_json_array_parts_form_one_array(table, tmp_path):
    results.write_result(table.orderBy("n"), str(tmp_path / "out"), "json")
    assert [r["n"] for r in json.loads(read_parts(tmp_path / "out"))] == [1, 2, 3]
    results.write_result(table.limit(0), str(tmp_path / "none"), "json")
    assert json.loads(read_parts(tmp_path / "none")) == []


def test_ndjson_keeps_nulls(table, tmp_path):
    results.write_result(table, str(tmp_path / "out"), "ndjson")
    rows = [json.loads(x) for x in read_parts(tmp_path / "out").splitlines()]
    assert {"n": 1, "s": None, "l": None} in rows and len(rows) == 3


def test_delimited_formats(table, tmp_path, spark):
    results.write_result(table, str(tmp_path / "tsv"))
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "tsv"))
    assert back.columns == ["n", "s", "l"] and back.count() == 3
    results.write_result(table, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).filter("l = '[\"x\"]'").count() == 1
    with pytest.raises(ValueError, match="unknown format"):
        results.write_result(table, str(tmp_path / "xml"), "xml")


def test_store_generations(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert not store.exists("t") and store.names() == []
    assert store.read("t", SPINE).isEmpty()
    with pytest.raises(KeyError):
        store.read("t")
    first = store.write("t", spark.range(3))
    second = store.write("t", first.filter("id > 0"))
    assert first.count() == 3 and second.count() == 2
    assert store.read("t").count() == 2 and store.names() == ["t"]
    with pytest.raises(Exception):
        store.write("t", spark.range(1).select(F.raise_error(F.lit("no")).cast("int").alias("id")))
    assert store.read("t").count() == 2
    store.write("t", spark.range(0))
    assert store.read("t").count() == 0
    store.expire("t", keep=1)
    assert store.read("t").count() == 0
    store.drop("t")
    assert not store.exists("t")


def test_staged_keeps_rows(spark):
    assert staged(spark.range(5)).count() == 5
