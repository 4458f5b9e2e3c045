"""Name handling: quoting, case-insensitive lookup and collision suffixes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> Column:
    """Column by exact name, whatever characters the name holds."""
    return F.col(quote(name))


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def actual_name(df: DataFrame, name: str) -> str | None:
    """The column of ``df`` that equals ``name`` ignoring case, if any."""
    wanted = name.lower()
    return next((c for c in df.columns if c.lower() == wanted), None)


def spread_names(taken: Iterable[str], wanted: Iterable[str]) -> list[str]:
    """Output names for ``wanted`` columns placed after ``taken`` ones.

    Names are compared without case. The second holder of a name gets the suffix
    ``_1``, the third ``_2``; the spelling of the name itself is kept.
    """
    used = {t.lower() for t in taken}
    out = []
    for name in wanted:
        candidate, n = name, 0
        while candidate.lower() in used:
            n += 1
            candidate = f"{name}_{n}"
        used.add(candidate.lower())
        out.append(candidate)
    return out


def field_type(dtype: T.DataType, path: Iterable[str]) -> T.DataType | None:
    """Type at a path of struct fields (names compared without case)."""
    for step in path:
        if not isinstance(dtype, T.StructType):
            return None
        hit = next((f for f in dtype.fields if f.name.lower() == step.lower()), None)
        if hit is None:
            return None
        dtype = hit.dataType
    return dtype


def field_or_null(df: DataFrame, path: list[str], dtype: T.DataType) -> Column:
    """Nested field as ``dtype``, or a typed NULL when the schema lacks it.

    Inferred schemas only hold what the records of a type happened to contain,
    so a transform may not assume that an optional field exists.
    """
    found = field_type(df.schema, path)
    if found is None:
        return F.lit(None).cast(dtype)
    column = quoted(actual_name(df, path[0]))
    for step in path[1:]:
        column = column.getField(step)
    return conform(column, found, dtype)


def conform(value: Column, found: T.DataType, wanted: T.DataType) -> Column:
    """``value`` of type ``found`` as ``wanted``.

    Structs are matched field by field (ignoring case, missing fields are NULL),
    lists element by element, and scalars that do not convert become NULL. Nested
    values turn into JSON text and JSON text into nested values where the types
    ask for it.
    """
    if found == wanted:
        return value
    nested = (T.StructType, T.ArrayType, T.MapType)
    if isinstance(found, T.StringType) and isinstance(wanted, nested):
        return F.try_variant_get(F.try_parse_json(value), "$", wanted.simpleString())
    if isinstance(wanted, T.StringType) and isinstance(found, nested):
        return F.to_json(value, {"ignoreNullFields": "false"})
    if isinstance(found, T.StructType) and isinstance(wanted, T.StructType):
        fields = []
        for field in wanted.fields:
            held = next(
                (f for f in found.fields if f.name.lower() == field.name.lower()), None
            )
            part = (
                F.lit(None).cast(field.dataType)
                if held is None
                else conform(value.getField(held.name), held.dataType, field.dataType)
            )
            fields.append(part.alias(field.name))
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(found, T.ArrayType) and isinstance(wanted, T.ArrayType):
        return F.transform(
            value, lambda x: conform(x, found.elementType, wanted.elementType)
        )
    if isinstance(found, T.MapType) and isinstance(wanted, T.MapType):
        return F.transform_values(
            value, lambda _, v: conform(v, found.valueType, wanted.valueType)
        )
    if isinstance(found, nested) or isinstance(wanted, nested):
        text = F.to_json(value) if isinstance(found, nested) else F.lit(None)
        return F.try_variant_get(F.try_parse_json(text), "$", wanted.simpleString())
    return value.try_cast(wanted)


def replace_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Set a column in place, keeping the spelling the table already uses."""
    return df.withColumn(actual_name(df, name) or name, value)
