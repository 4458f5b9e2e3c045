"""One typed table per resource type, expanded from its JSON columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions.columns import quoted, spread_names
from tallyhouse.functions.jsontext import stringify_field
from tallyhouse.operators.infer import (
    InferenceRules,
    column_type,
    infer_schemas,
    keyed_value_type,
)
from tallyhouse.schemas import JSON_COLUMNS

#: Objects that are policy or compliance *content*, kept as text (fixed values):
#: resource type -> top-level key.
STRINGIFIED = {
    "AWS::Organizations::Policy": "Content",
    "AWS::SSM::PatchCompliance": "AWS:ComplianceItem",
}

_TEXT = T.StringType()
_TEXT_MAP = T.MapType(_TEXT, _TEXT)
_INVENTORY = "AWS::SSM::ManagedInstanceInventory"

#: Objects whose keys are data: application names, update ids, instance ids.
DEFAULT_RULES = InferenceRules(
    fixed={
        (_INVENTORY, "AWS:Application", "Content"): _TEXT_MAP,
        (_INVENTORY, "AWS:WindowsUpdate", "Content"): _TEXT_MAP,
        **{key: _TEXT for key in STRINGIFIED.items()},
    },
    keyed=frozenset({(_INVENTORY, "AWS:InstanceInformation", "Content")}),
)


@dataclass(frozen=True)
class TypeSchema:
    """Columns the JSON of one resource type expands to."""

    resource_type: str
    types: dict[str, T.DataType] = field(default_factory=dict)
    has_empty: dict[str, bool] = field(default_factory=dict)
    #: Documents of the type that could not be read.
    refused: int = 0


def type_schemas(
    spine: DataFrame, rules: InferenceRules = DEFAULT_RULES
) -> dict[str, TypeSchema]:
    """Schemas of all types of the spine. One row per type reaches the driver."""
    out = {}
    inferred = infer_schemas(spine, rules=rules).filter("resourceType IS NOT NULL")
    for row in inferred.collect():
        types = {
            c: column_type(row[f"{c}_schema"], row.resourceType, rules)
            for c in JSON_COLUMNS
        }
        for path, dtype in _given_types(spine, row.resourceType, types["configuration"], rules):
            types["configuration"] = _placed(types["configuration"], path, dtype)
        out[row.resourceType] = TypeSchema(
            row.resourceType,
            types,
            {c: row[f"{c}_has_empty"] for c in JSON_COLUMNS},
            sum(row[f"{c}_refused"] for c in JSON_COLUMNS),
        )
    return out


def _given_types(
    spine: DataFrame, resource_type: str, found: T.DataType, rules: InferenceRules
) -> list[tuple[tuple[str, ...], T.DataType]]:
    """Types of the values that the rules decide instead of inference."""
    out = [
        (tuple(path), dtype)
        for (owner, *path), dtype in rules.fixed.items()
        if owner == resource_type
    ]
    for owner, key, inner in sorted(rules.keyed):
        if owner == resource_type and _at(found, (key, inner)) is not None:
            value = keyed_value_type(spine, owner, key, inner, rules)
            out.append(((key, inner), T.MapType(_TEXT, value)))
    return out


def _at(dtype: T.DataType, path: tuple[str, ...]) -> T.DataType | None:
    for key in path:
        if not isinstance(dtype, T.StructType) or key not in dtype.names:
            return None
        dtype = dtype[key].dataType
    return dtype


def _placed(dtype: T.DataType, path: tuple[str, ...], new: T.DataType) -> T.DataType:
    """``dtype`` with ``new`` at ``path``; a key that no document has stays away."""
    if _at(dtype, path) is None:
        return dtype
    if not path:
        return new
    return T.StructType(
        [
            T.StructField(f.name, _placed(f.dataType, path[1:], new) if f.name == path[0] else f.dataType)
            for f in dtype.fields
        ]
    )


def stringify_content(spine: DataFrame) -> DataFrame:
    """Keep known content objects as text inside ``configuration``.

    Inference would otherwise turn every policy's own keys into columns.
    """
    fixed = F.col("configuration")
    for resource_type, key in STRINGIFIED.items():
        fixed = F.when(
            F.col("resourceType") == resource_type,
            stringify_field(F.col("configuration"), key),
        ).otherwise(fixed)
    return spine.withColumn("configuration", fixed)


def derive_type(spine: DataFrame, schema: TypeSchema) -> DataFrame:
    """Typed table of one resource type.

    Base columns come first, then the keys of ``configuration`` and of
    ``supplementaryConfiguration``, each sorted. A key that repeats a column name
    (ignoring case) gets the suffix ``_1``. Parsing happens in place, so no row is
    lost to an empty, NULL or non-object document and none is multiplied by a
    repeated key.

    If any document of the type is ``{}``, a NULL column named after the JSON
    column is present, as an empty document is read as having just that key.
    """
    rows = spine.filter(F.col("resourceType") == schema.resource_type)
    base = [c for c in spine.columns if c not in JSON_COLUMNS]
    parsed = [quoted(c) for c in base]
    fields: list[tuple[str, str | None, T.DataType]] = []
    for c in JSON_COLUMNS:
        dtype = schema.types[c]
        names: list[tuple[str, str | None, T.DataType]] = []
        if isinstance(dtype, T.StructType):
            parsed.append(F.from_json(quoted(c), dtype).alias(f"_{c}"))
            names = [(f.name, f"_{c}", f.dataType) for f in dtype.fields]
        if schema.has_empty[c] and c not in [n for n, _, _ in names]:
            names.append((c, None, T.StringType()))
        fields += sorted(names, key=lambda n: n[0])
    renamed = spread_names(base, [name for name, _, _ in fields])
    columns = [
        (quoted(holder).getField(name) if holder else F.lit(None).cast(dtype)).alias(new)
        for (name, holder, dtype), new in zip(fields, renamed)
    ]
    return rows.select(parsed).select(*[quoted(c) for c in base], *columns)
