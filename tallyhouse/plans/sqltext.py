"""User SQL over named DataFrames."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping

from pyspark.errors import ParseException
from pyspark.sql import DataFrame

from tallyhouse.functions.columns import quote


def run_select(frames: Mapping[str, DataFrame], sql: str) -> DataFrame:
    """Run one query that refers to the given frames by name.

    The text stands in parentheses behind the definitions of the names it
    mentions, so nothing but a query can run; every call has views of its own,
    so concurrent calls do not meet.
    """
    used = {n: df for n, df in frames.items() if mentions(sql, n)}
    session = next(iter(frames.values())).sparkSession
    views = {name: f"v_{uuid.uuid4().hex}" for name in used}
    body = sql.strip().rstrip(";").strip()
    definitions = ", ".join(
        f"{quote(name)} AS (SELECT * FROM {view})" for name, view in views.items()
    )
    text = f"WITH {definitions} (\n{body}\n)" if views else f"(\n{body}\n)"
    for name, view in views.items():
        used[name].createOrReplaceTempView(view)
    try:
        return session.sql(text)
    except ParseException as error:
        raise ValueError(f"not a single SELECT: {body!r}") from error
    finally:
        for view in views.values():
            session.catalog.dropTempView(view)


def mentions(sql: str, name: str) -> bool:
    return re.search(rf"(?<!\w){re.escape(name)}(?!\w)", sql, re.IGNORECASE) is not None
