"""Filtered, projected and sorted queries over the spine or one typed table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions.columns import quoted
from tallyhouse.plans.sqltext import mentions, run_select
from tallyhouse.schemas import table_name

SPINE_TABLE = "resources"
ACCOUNTS_TABLE = "accounts"
DEFAULT_SQL = "SELECT * FROM input"
_COLUMNS = "column_name string, data_type string"

#: Columns shown when none are asked for (fixed values).
SPINE_COLUMNS = ["resourceType", "accountId", "awsRegion", "resourceId", "resourceName"]
TYPED_COLUMNS = ["accountId", "awsRegion", "resourceId", "resourceName"]
#: Further default columns of some types (fixed values).
TYPED_EXTRAS = {
    "AWS::IAM::Role": ["arn"],
    "AWS::EC2::VPC": ["cidrBlock"],
    "AWS::EC2::Subnet": [
        "vpcId",
        "cidrBlock",
        "availabilityZone",
        "availableIpAddressCount",
    ],
}

Tables = Callable[[str], DataFrame]


def key_value(argument: str) -> tuple[str, str]:
    """``key=value`` split at the first ``=``; both parts must be non-empty."""
    key, separator, value = argument.partition("=")
    if not separator or not key or not value:
        raise ValueError(f"expected key=value, got {argument!r}")
    return key, value


@dataclass(frozen=True)
class Query:
    """What to show of which resources.

    ``fields``, ``where_raw`` and ``sort`` take SQL expressions; everything else
    takes plain values, which are never spliced into SQL. ``exclude`` ignores
    case. In all-fields mode an unknown excluded name is an error.
    """

    resource_type: str | None = None
    accounts: Sequence[str] = ()
    fields: Sequence[str] | None = None
    all_fields: bool = False
    where: Sequence[tuple[str, str]] = ()
    where_raw: Sequence[str] = ()
    ids: Sequence[str] = ()
    names: Sequence[str] = ()
    exclude: Sequence[str] = ()
    sort: Sequence[str] = ()
    reverse: bool = False
    sql: str = DEFAULT_SQL
    extra_columns: Mapping[str, Sequence[str]] = field(default_factory=dict)

    @property
    def table(self) -> str:
        return table_name(self.resource_type) if self.resource_type else SPINE_TABLE

    def input(self, tables: Tables) -> DataFrame:
        """The filtered, sorted projection that user SQL sees as ``input``."""
        joined = with_accounts(tables(self.table), tables(ACCOUNTS_TABLE))
        return self._projected(joined, tables)

    def run(self, tables: Tables, known: Iterable[str] = ()) -> DataFrame:
        """The query's result. ``tables`` resolves a table name to a DataFrame.

        User SQL sees ``input`` and those of the ``known`` tables it mentions.
        """
        selected = self.input(tables)
        if self.sql.strip().rstrip(";").strip().lower() == DEFAULT_SQL.lower():
            return selected
        others = {n: tables(n) for n in known if n != "input" and mentions(self.sql, n)}
        return run_select(others | {"input": selected}, self.sql)

    def _projected(self, joined: DataFrame, tables: Tables) -> DataFrame:
        rows = joined
        for predicate in predicates(self):
            rows = rows.filter(predicate)
        out = self._columns(rows, tables)
        # After the projection, so that sort keys may be aliases of `fields` as
        # well as columns that are not shown.
        return out.orderBy(*self._order()) if self.sort else out

    def _order(self) -> list[Column]:
        """NULLs come last in both directions; ``reverse`` turns every field."""
        keys = [F.expr(s) for s in self.sort]
        return [
            k.desc_nulls_last() if self.reverse else k.asc_nulls_last() for k in keys
        ]

    def _columns(self, rows: DataFrame, tables: Tables) -> DataFrame:
        dropped = {e.lower() for e in self.exclude}
        if self.all_fields:
            unknown = dropped - {c.lower() for c in rows.columns}
            if unknown:
                raise ValueError(f"cannot exclude unknown columns: {sorted(unknown)}")
            return rows.select(
                [quoted(c) for c in rows.columns if c.lower() not in dropped]
            )
        names = self.fields
        if names is None:
            names = self._default_columns(has_account_names(tables(ACCOUNTS_TABLE)))
        return rows.select([F.expr(n) for n in names if n.lower() not in dropped])

    def _default_columns(self, named: bool) -> list[str]:
        if self.resource_type is None:
            names = list(SPINE_COLUMNS)
        else:
            extras = self.extra_columns.get(
                self.table, TYPED_EXTRAS.get(self.resource_type, [])
            )
            names = [*TYPED_COLUMNS, *extras]
        if named:
            names.insert(names.index("accountId") + 1, "accountName")
        return names


def with_accounts(table: DataFrame, accounts: DataFrame) -> DataFrame:
    """Table columns in their order, then ``accountName``.

    The resources stay on the streamed side: Spark broadcasts the accounts when
    their size allows, and can split an account with very many resources if not.
    """
    joined = table.join(accounts.select("accountId", "accountName"), "accountId", "left")
    return joined.select([quoted(c) for c in table.columns] + ["accountName"])


def has_account_names(accounts: DataFrame) -> bool:
    return not accounts.filter(F.col("accountName").isNotNull()).limit(1).isEmpty()


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _matches(column: str, patterns: Sequence[str]) -> Column:
    return _any([F.col(column).rlike(p) for p in patterns])


def predicates(query: Query, narrowing: bool = False) -> list[Column]:
    """All filters, to be ANDed. ``narrowing`` leaves out the id and name patterns,
    as facet values of those columns must not be limited by themselves."""
    out: list[Column] = []
    if query.accounts:
        wanted = list(query.accounts)
        out.append(
            F.col("accountId").isin(wanted) | F.col("accountName").isin(wanted)
        )
    out += [quoted(k) == F.lit(v) for k, v in query.where]
    out += [F.expr(f"({w})") for w in query.where_raw]
    if not narrowing:
        if query.ids:
            out.append(_matches("resourceId", query.ids))
        if query.names:
            out.append(_matches("resourceName", query.names))
    return out


def facet_values(
    query: Query, tables: Tables, column: str, prefix: str = ""
) -> DataFrame:
    """Sorted distinct values of a column under the query's other filters.

    ``prefix`` is matched as a LIKE pattern followed by anything.
    """
    rows = with_accounts(tables(query.table), tables(ACCOUNTS_TABLE))
    for predicate in predicates(query, narrowing=True):
        rows = rows.filter(predicate)
    return (
        rows.filter(quoted(column).like(f"{prefix}%"))
        .select(quoted(column))
        .distinct()
        .orderBy(quoted(column).asc_nulls_last())
    )


def key_facets(query: Query, tables: Tables, argument: str = "") -> DataFrame:
    """Completions of a ``key=value`` filter, as one column ``candidate``.

    Without ``=``: the text columns of the table. With it: values of that column
    that start with what follows.
    """
    key, separator, prefix = argument.partition("=")
    if separator:
        values = facet_values(query, tables, key, prefix)
        return values.select(F.concat(F.lit(f"{key}="), quoted(key)).alias("candidate"))
    table = tables(query.table)
    names = [
        (f"{f.name}=",) for f in table.schema.fields if isinstance(f.dataType, T.StringType)
    ]
    return table.sparkSession.createDataFrame(names, "candidate string")


def account_facets(accounts: DataFrame) -> DataFrame:
    """Account ids with their names, and names with their ids."""
    named = accounts.filter(F.col("accountName").isNotNull())
    return accounts.select(
        F.col("accountId").alias("candidate"), F.col("accountName").alias("help")
    ).union(named.select("accountName", "accountId"))


def field_facets(table: DataFrame) -> DataFrame:
    """Columns of a table with their types, plus the joined account name."""
    joined = table.sparkSession.createDataFrame([("accountName", "string")], _COLUMNS)
    return columns_of(table).union(joined).distinct()


def columns_of(table: DataFrame) -> DataFrame:
    """Catalogue of a table: one row per column."""
    rows = [(f.name, f.dataType.simpleString()) for f in table.schema.fields]
    return table.sparkSession.createDataFrame(rows, _COLUMNS)
