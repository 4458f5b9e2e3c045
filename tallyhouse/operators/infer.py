"""Schemas of JSON columns, found from the data.

Spark merges the schemas of VARIANT values as an aggregate, so one pass finds
the schema of every resource type at once: partial results are schemas, not
records, and a type with a third of all rows is just a longer scan.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions.jsontext import TEXT_MAP, json_path
from tallyhouse.schemas import JSON_COLUMNS

_TEXT = T.StringType()

# Spelling of an inferred schema, token by token: quoted names are left alone,
# bare names get quoted, type words become column types.
_TOKEN = re.compile(
    r"`(?:[^`]|``)*`"
    r"|(?P<name>[^\s<>,:`()]+)(?=:\s)"
    r"|(?P<empty>OBJECT<>)"
    r"|(?P<object>OBJECT<)"
    r"|(?P<list>ARRAY<)"
    r"|(?P<whole>DECIMAL\(\d+,\s*0\))"
    r"|(?P<decimal>DECIMAL\(\d+,\s*\d+\))"
    r"|(?P<text>VARIANT|VOID)\b"
)
_EMPTY_OBJECT = "MAP<STRING,STRING>"


def _respell(match: re.Match) -> str:
    kind = match.lastgroup
    if kind == "name":
        return f"`{match.group()}`"
    return {
        None: match.group(),
        "whole": match.group(),
        "empty": _EMPTY_OBJECT,
        "object": "STRUCT<",
        "list": "ARRAY<",
        "decimal": "DOUBLE",
        "text": "STRING",
    }[kind]


@dataclass(frozen=True)
class InferenceRules:
    """How inferred types become column types.

    ``fixed`` maps ``(resource type, top-level key)``, or ``(resource type,
    top-level key, inner key)``, to the type of that value. Inference does not
    look into it: an object keyed by instance or patch ids would add one field per
    record to the merged schema. Its sibling keys are inferred as any others.

    ``keyed`` holds ``(resource type, top-level key, inner key)`` of objects that
    become maps with values of one inferred type.

    ``overrides`` maps ``(resource type, dotted path)`` to the type to use at that
    path.
    """

    fixed: Mapping[tuple[str, ...], T.DataType] = field(default_factory=dict)
    keyed: frozenset[tuple[str, str, str]] = frozenset()
    overrides: Mapping[tuple[str, str], T.DataType] = field(default_factory=dict)

    def blanked(self) -> dict[str, list[tuple[str, ...]]]:
        """Paths per resource type that inference does not look into."""
        out: dict[str, list[tuple[str, ...]]] = {}
        for resource_type, *path in [*self.fixed, *self.keyed]:
            out.setdefault(resource_type, []).append(tuple(path))
        return out


def inferred_schema(document: Column) -> Column:
    """Aggregate: merged schema of JSON objects, as text.

    Documents that are no object have no keys and do not take part; neither does
    invalid JSON (see :func:`refused`).
    """
    return F.schema_of_variant_agg(F.when(_is_object(document), F.try_parse_json(document)))


def refused(document: Column) -> Column:
    """Aggregate: objects that cannot be read, as they are no valid JSON, repeat a
    key or are over the parser's size limit."""
    return F.count_if(_is_object(document) & F.try_parse_json(document).isNull())


def _is_object(document: Column) -> Column:
    return F.ltrim(document).startswith("{")


#: What stands for a value that inference does not look into.
_BLANK = '""'


def blank(document: Column, paths: list[tuple[str, ...]]) -> Column:
    """A JSON object in which the values at some paths, of one or two keys, are
    empty texts. A document that has none of the keys stays as it is."""
    outer = sorted({p[0] for p in paths if len(p) == 1})
    inner: dict[str, list[str]] = {}
    for p in paths:
        if len(p) == 2 and p[0] not in outer:
            inner.setdefault(p[0], []).append(p[1])
    nothing = F.parse_json(F.lit(_BLANK))

    def without(v: Column, names: list[str]) -> Column:
        fields = F.from_json(F.to_json(v), "map<string,variant>")
        blanks = F.transform_values(fields, lambda n, x: F.when(n.isin(names), nothing).otherwise(x))
        return F.coalesce(F.try_parse_json(F.to_json(blanks)), v)

    def value(k: Column, v: Column) -> Column:
        out = v
        for key, names in inner.items():
            out = F.when(k == key, without(v, names)).otherwise(out)
        return F.when(k.isin(outer), nothing).otherwise(out) if outer else out

    changed = F.to_json(F.transform_values(F.from_json(document, "map<string,variant>"), value))
    named = F.lit(False)
    for key in {p[0] for p in paths}:
        named = named | document.contains(key)
    return F.when(named & F.try_parse_json(document).isNotNull(), F.coalesce(changed, document)).otherwise(document)


def infer_schemas(
    spine: DataFrame,
    columns: list[str] = JSON_COLUMNS,
    by: str = "resourceType",
    rules: InferenceRules = InferenceRules(),
) -> DataFrame:
    """Per type: the merged schema of each JSON column, whether any value is the
    empty object, and how many documents could not be read. One row per type."""
    aggregates = []
    for c in columns:
        document = F.col(c)
        for resource_type, paths in rules.blanked().items():
            document = F.when(
                F.col(by) == resource_type, blank(F.col(c), paths)
            ).otherwise(document)
        aggregates.append(inferred_schema(document).alias(f"{c}_schema"))
        aggregates.append(
            F.coalesce(F.max(F.col(c) == "{}"), F.lit(False)).alias(f"{c}_has_empty")
        )
        aggregates.append(refused(F.col(c)).alias(f"{c}_refused"))
    return spine.groupBy(by).agg(*aggregates)


def keyed_value_type(
    spine: DataFrame,
    resource_type: str,
    key: str,
    inner: str,
    rules: InferenceRules,
    column: str = "configuration",
) -> T.DataType:
    """Merged type of the values of an object whose keys are data."""
    content = F.get_json_object(F.col(column), json_path(key, inner))
    values = (
        spine.filter(F.col("resourceType") == resource_type)
        .select(F.explode(F.map_values(F.from_json(content, TEXT_MAP))).alias("value"))
        .agg(inferred_schema(F.col("value")).alias("schema"))
    )
    return column_type(values.first().schema, resource_type, rules)


def column_type(
    schema_text: str | None,
    resource_type: str = "",
    rules: InferenceRules = InferenceRules(),
) -> T.DataType:
    """Column type for an inferred schema.

    Conflicting and always-null values are kept as text; an object that never had
    a key is a map of text; numbers with a fraction are doubles, and whole numbers
    keep all their digits.
    """
    if schema_text is None:
        return _TEXT
    dtype = T.DataType.fromDDL(_TOKEN.sub(_respell, schema_text))
    return _ruled(dtype, resource_type, "", rules)


def _ruled(
    dtype: T.DataType, resource_type: str, path: str, rules: InferenceRules
) -> T.DataType:
    override = rules.overrides.get((resource_type, path))
    if override is not None:
        return override
    if isinstance(dtype, T.StructType):
        return T.StructType(
            [
                T.StructField(
                    f.name,
                    _ruled(
                        f.dataType,
                        resource_type,
                        f"{path}.{f.name}" if path else f.name,
                        rules,
                    ),
                )
                for f in dtype.fields
            ]
        )
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_ruled(dtype.elementType, resource_type, f"{path}[]", rules))
    return dtype
