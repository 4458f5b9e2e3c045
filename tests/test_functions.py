import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions import jsontext, lists
from tallyhouse.functions.columns import conform, field_or_null, spread_names
from tallyhouse.schemas import table_name, table_names


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "text, kind",
    [
        ('{"a":1}', "OBJECT"),
        (" [1]", "ARRAY"),
        ('"x"', "VARCHAR"),
        ("true", "BOOLEAN"),
        ("null", "NULL"),
        ("12", "UBIGINT"),
        ("-3", "BIGINT"),
        ("2.5", "DOUBLE"),
        ("5-LOW", None),
        ("{oops", None),
        ("", None),
        (None, None),
    ],
)
def test_json_kind(spark, text, kind):
    assert value(spark, jsontext.json_kind(F.lit(text).cast("string"))) == kind


def test_json_value_quotes_what_is_no_json(spark):
    assert value(spark, jsontext.json_value(F.lit("not-valid-json"))) == '"not-valid-json"'
    assert value(spark, jsontext.json_value(F.lit('say "x"'))) == '"say \\"x\\""'
    assert value(spark, jsontext.json_value(F.lit('{"b":1,"a":2}'))) == '{"b":1,"a":2}'
    assert value(spark, jsontext.json_value(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize(
    "document, expected",
    [
        ('{"Statement":[{"a":1},{"b":2}]}', ['{"a":1}', '{"b":2}']),
        ('{"Statement":{"a":1}}', ['{"a":1}']),
        ('{"Statement":null}', []),
        ('{"Statement":"x"}', []),
        ("{}", []),
        (None, []),
    ],
)
def test_statements(spark, document, expected):
    assert value(spark, jsontext.statements(F.lit(document).cast("string"))) == expected


def test_url_decode_keeps_plus_and_bad_escapes(spark):
    assert value(spark, jsontext.url_decode(F.lit("a+b%20c%2B"))) == "a+b c+"
    assert value(spark, jsontext.url_decode(F.lit("100%zz"))) == "100%zz"
    assert value(spark, jsontext.url_decode(F.lit("%7B%22V%22%3A1%7D"))) == '{"V":1}'


def test_stringify_field_only_touches_objects(spark):
    def fixed(text):
        return value(spark, jsontext.stringify_field(F.lit(text), "AWS:C"))

    assert fixed('{"AWS:C":{"z":1,"a":2},"k":[1]}') == '{"AWS:C":"{\\"z\\":1,\\"a\\":2}","k":[1]}'
    assert fixed('{"AWS:C":"{text"}') == '{"AWS:C":"{text"}'
    assert fixed('{"k":1}') == '{"k":1}'


def test_canonical_json_ignores_key_order(spark):
    assert value(spark, jsontext.canonical_json(F.lit('{"b":1,"a":2}'))) == '{"a":2,"b":1}'


def test_lists_treat_null_as_missing(spark):
    one, none = F.array(F.lit(1), F.lit(None)), F.lit(None).cast("array<int>")
    assert value(spark, lists.list_concat(one, none)) == [1, None]
    assert value(spark, lists.list_concat(none, none)) == []
    assert value(spark, lists.list_flatten(F.array(one, none))) == [1, None]
    assert value(spark, lists.list_distinct(F.array(F.lit(1), F.lit(1), F.lit(None)))) == [1]
    assert value(spark, lists.list_first(F.array().cast("array<int>"))) is None


def test_map_of_rejects_repeated_keys(spark):
    entries = F.array(
        F.struct(F.lit("a").alias("k"), F.lit(1).alias("v")),
        F.struct(F.lit("a").alias("k"), F.lit(2).alias("v")),
    )
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        value(spark, lists.map_of(entries, "k", lambda x: x["v"]))


def test_conform_matches_struct_fields_and_survives_bad_values(spark):
    found = T.DataType.fromDDL("struct<N:string,extra:int,list:array<string>>")
    wanted = T.DataType.fromDDL("struct<n:int,list:array<int>,missing:boolean>")
    source = F.struct(
        F.lit("x").alias("N"), F.lit(1).alias("extra"), F.array(F.lit("4"), F.lit("y")).alias("list")
    )
    assert tuple(value(spark, conform(source, found, wanted))) == (None, [4, None], None)


def test_field_or_null_for_absent_path(spark):
    df = spark.range(1).select(F.struct(F.lit("a").alias("name")).alias("State"))
    text = T.StringType()
    assert df.select(field_or_null(df, ["state", "name"], text)).first()[0] == "a"
    assert df.select(field_or_null(df, ["state", "code"], text)).first()[0] is None
    assert df.select(field_or_null(df, ["none"], text)).first()[0] is None


def test_spread_names_suffixes_ignoring_case():
    assert spread_names(["tags", "arn"], ["Tags", "ARN", "x", "X"]) == ["Tags_1", "ARN_1", "x", "X_1"]


@pytest.mark.parametrize(
    "resource_type, name",
    [
        ("AWS::EC2::Instance", "ec2_instance"),
        ("AWS::Lambda::Function", "lambda_function"),
        ("EC2::Instance", "ec2_instance"),
        ("AWS::AWS::A::B", "a_b"),
        ("AWS::Route53Resolver::ResolverRule", "route53resolver_resolverrule"),
    ],
)
def test_table_name(resource_type, name):
    assert table_name(resource_type) == name


def test_table_name_collision_is_an_error():
    with pytest.raises(ValueError, match="a_b"):
        table_names(["AWS::A::B", "A::B"])
