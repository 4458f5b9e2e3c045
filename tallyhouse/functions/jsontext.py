"""Functions over JSON held as text.

JSON columns of the inventory are STRING. Every function here takes and returns
Columns, parses inside the JVM and yields NULL for SQL NULL input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse.functions.lists import bound

#: ``from_json`` type that keeps every value of an object or array as JSON text.
TEXT_MAP = "map<string,string>"
TEXT_LIST = "array<string>"


#: JSON values that are neither object, array nor string.
_SCALAR = r"^\s*(-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?|true|false|null)\s*$"


def is_json(text: Column) -> Column:
    """True for valid JSON text; NULL text is not JSON.

    Plain words and numbers are told by a pattern: a parser would raise an
    exception for every text that is not JSON, which costs far more.
    """
    enclosed = F.substring(F.ltrim(text), 1, 1).isin("{", "[", '"')
    valid = F.when(enclosed, F.try_parse_json(text).isNotNull()).otherwise(
        text.rlike(_SCALAR)
    )
    return F.coalesce(valid, F.lit(False))


def json_or_null(text: Column) -> Column:
    """The text when it is valid JSON, else NULL."""
    return F.when(is_json(text), text)


def is_object(text: Column) -> Column:
    """Whether the text is a JSON object. Only text that looks like one is parsed."""
    return F.coalesce(F.ltrim(text).startswith("{") & is_json(text), F.lit(False))


def is_array(text: Column) -> Column:
    """Whether the text is a JSON array."""
    return F.coalesce(F.ltrim(text).startswith("[") & is_json(text), F.lit(False))


def typed(text: Column, path: str, ddl: str) -> Column:
    """The value at a JSON path as a nested type. A part that does not convert, or
    is missing, is NULL; the rest of the value is kept."""
    return F.try_variant_get(F.try_parse_json(text), path, ddl)


def json_kind(text: Column) -> Column:
    """Kind of the JSON value: OBJECT, ARRAY, VARCHAR, BOOLEAN, NULL or a number
    kind (UBIGINT, BIGINT, DOUBLE). SQL NULL and invalid JSON give NULL.

    For valid JSON the first character decides, so no nested schema is built.
    """
    body = F.ltrim(text)
    first = F.substring(body, 1, 1)
    number = (
        F.when(body.rlike("[.eE]"), "DOUBLE")
        .when(first == "-", "BIGINT")
        .otherwise("UBIGINT")
    )
    kind = (
        F.when(first == "{", "OBJECT")
        .when(first == "[", "ARRAY")
        .when(first == '"', "VARCHAR")
        .when(first.isin("t", "f"), "BOOLEAN")
        .when(first == "n", "NULL")
        .otherwise(number)
    )
    return F.when(is_json(text), kind)


def json_quote(text: Column) -> Column:
    """A string as a JSON string literal."""
    return F.to_json(text.cast("variant"))


def json_value(text: Column) -> Column:
    """Text that may or may not be JSON, as JSON: kept when valid, quoted otherwise."""
    return F.when(text.isNull(), F.lit(None)).otherwise(
        F.coalesce(json_or_null(text), json_quote(text))
    )


def canonical_json(text: Column) -> Column:
    """JSON with object keys sorted, for comparisons that must ignore key order."""
    return F.to_json(F.try_parse_json(text))


def json_elements(text: Column) -> Column:
    """Elements of a JSON array as JSON text. Anything but an array gives NULL."""
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, TEXT_LIST))


def wrapped_elements(text: Column) -> Column:
    """JSON array -> its elements, object -> one-element list, else empty list."""
    body = F.ltrim(text)
    return F.coalesce(
        F.when(body.startswith("["), F.from_json(text, TEXT_LIST)).when(
            body.startswith("{"), F.array(text)
        ),
        F.array().cast(TEXT_LIST),
    )


def statements(document: Column) -> Column:
    """Statements of a policy document as a list of JSON texts.

    A single statement object counts as a list of one; a missing, NULL or scalar
    ``Statement`` and a NULL document give an empty list.
    """
    return bound(F.get_json_object(document, "$.Statement"), wrapped_elements)


def url_decode(text: Column) -> Column:
    """Percent-decoding that leaves ``+`` alone and returns bad escapes unchanged."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def decoded_document(text: Column) -> Column:
    """URL-encoded JSON document as JSON text; NULL when it is no JSON."""
    return json_or_null(url_decode(text))


def json_path(*keys: str) -> str:
    """JSON path of nested object keys, each quoted."""
    return "$" + "".join(f"['{k}']" for k in keys)


def stringify_field(document: Column, key: str) -> Column:
    """Replace an OBJECT held under a top-level ``key`` by its JSON text.

    Documents without such an object are returned as they are.
    """
    inner = F.get_json_object(document, json_path(key)).cast("variant")
    parsed = F.from_json(document, "map<string,variant>")
    is_object = F.coalesce(
        F.schema_of_variant(parsed[key]).startswith("OBJECT"), F.lit(False)
    )
    rewritten = F.to_json(
        F.transform_values(parsed, lambda k, v: F.when(k == key, inner).otherwise(v))
    )
    return F.when(is_object, rewritten).otherwise(document)
