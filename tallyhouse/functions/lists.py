"""List and map expressions with the inventory's NULL rules.

Spark's ``concat`` and ``flatten`` return NULL when any input is NULL and
``array_distinct`` keeps a NULL element; the inventory's transforms treat a
missing list as an empty one and never report NULL as a value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` refers to it.

    Spark shares repeated subexpressions only where all of them are sure to run;
    behind conditions and inside lambdas an expensive value would be recomputed.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def or_empty(items: Column) -> Column:
    """A NULL list becomes an empty one."""
    return F.coalesce(items, F.array())


def no_nulls_empty(items: Column) -> Column:
    """The list without NULL elements; empty for a NULL list."""
    return F.array_compact(or_empty(items))


def list_concat(*lists: Column) -> Column:
    """Concatenation in which a NULL list counts as empty."""
    return F.concat(*[or_empty(x) for x in lists])


def list_flatten(lists: Column) -> Column:
    """Flatten that skips NULL inner lists; NULL stays NULL."""
    return F.flatten(F.array_compact(lists))


def list_distinct(items: Column) -> Column:
    """Distinct non-NULL elements; NULL stays NULL."""
    return F.array_compact(F.array_distinct(items))


def list_first(items: Column) -> Column:
    """First element, NULL for an empty list."""
    return F.get(items, F.lit(0))


def map_of(entries: Column, key: str, value) -> Column:
    """Map from a list of structs: ``key`` names a field, ``value`` maps the struct.

    NULL lists give NULL. Repeated keys raise, as in ``map_from_entries``.
    """
    return F.map_from_entries(
        F.transform(
            entries, lambda x: F.struct(x[key].alias("key"), value(x).alias("value"))
        )
    )


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def with_blanks_nulled(value: Column, fields: list[str]) -> Column:
    """Struct with ``''`` replaced by NULL in the named fields; NULL stays NULL."""
    updated = value
    for name in fields:
        updated = updated.withField(name, blank_to_null(value[name]))
    return updated
