"""Registry and runner of transforms over the derived tables.

A transform is a function from tables to tables. Nothing is written between
transforms: they extend the plans of the tables, and each table is written once,
after all of them. They run in declaration order, so two transforms of the same
table always compose the same way.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions.columns import actual_name, quote
from tallyhouse.plans.sqltext import run_select

log = logging.getLogger(__name__)

Tables = Mapping[str, DataFrame]

APPLIED = "applied"
NO_DEPENDENCY = "skipped: missing dependency"
NO_CONDITION = "skipped: condition not met"
FAILED = "failed"
REPORT_SCHEMA = "name string, table string, status string, detail string"


@dataclass(frozen=True)
class Transform:
    """Changes some tables, given that all ``dependencies`` exist.

    ``apply`` returns the changed tables only. ``condition`` may look at the
    tables; False skips the transform. ``version`` changes when what the transform
    does changes, so that a build knows which tables to write anew.
    """

    name: str
    dependencies: Sequence[str]
    apply: Callable[[Tables], Mapping[str, DataFrame]]
    condition: Callable[[Tables], bool] | None = None
    version: str = ""


@dataclass(frozen=True)
class GlobalTransform:
    """Changes every table it applies to, one at a time.

    ``condition`` gets the table's name and content. Where the condition is about
    rows, ``spine_condition`` may give it as an aggregate over the spine's rows
    of a type, so that one pass over the spine answers it for all tables, or
    ``query_condition`` as a query whose first value decides; the queries of all
    tables then run side by side in one action.
    """

    name: str
    apply: Callable[[DataFrame], DataFrame]
    condition: Callable[[str, DataFrame], bool] | None = None
    spine_condition: Callable[[], Column] | None = None
    query_condition: Callable[[DataFrame], DataFrame] | None = None
    version: str = ""


@dataclass(frozen=True)
class CustomTable:
    """A further table, defined by one SELECT over the other tables."""

    name: str
    sql: str
    dependencies: Sequence[str] = ()
    description: str | None = None


@dataclass
class Registry:
    """Built-in and user transforms. Built-ins come first and can be turned off by
    name or altogether; the user's own always run."""

    builtin: Sequence[Transform] = ()
    builtin_global: Sequence[GlobalTransform] = ()
    user: Sequence[Transform] = ()
    user_global: Sequence[GlobalTransform] = ()
    disabled: frozenset[str] = frozenset()
    disable_all: bool = False

    def _kept(self, builtin, user):
        kept = [] if self.disable_all else [b for b in builtin if b.name not in self.disabled]
        return [*kept, *user]

    def transforms(self) -> list[Transform]:
        return self._kept(self.builtin, self.user)

    def global_transforms(self) -> list[GlobalTransform]:
        return self._kept(self.builtin_global, self.user_global)

    def fingerprint(self) -> str:
        """Changes when a transform comes, goes, moves or gets another version."""
        kept = [*self.transforms(), *self.global_transforms()]
        return repr([(t.name, tuple(getattr(t, "dependencies", ())), t.version) for t in kept])

    def without(self, name: str) -> Registry:
        """The same registry but for the transforms of one name."""

        def drop(some):
            return [t for t in some if t.name != name]

        return replace(
            self,
            builtin=drop(self.builtin),
            builtin_global=drop(self.builtin_global),
            user=drop(self.user),
            user_global=drop(self.user_global),
        )


@dataclass
class TransformRun:
    """Tables after the transforms, and what happened to each transform."""

    tables: dict[str, DataFrame]
    report: list[tuple[str, str, str, str | None]] = field(default_factory=list)

    def note(self, name: str, table: str, status: str, detail: object = None) -> None:
        self.report.append((name, table, status, None if detail is None else str(detail)))
        if status == FAILED:
            log.error("transform %s on %s failed: %s", name, table, detail)

    def report_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.report, REPORT_SCHEMA)


def spine_conditions(spine: DataFrame, registry: Registry) -> DataFrame | None:
    """Per resource type, a boolean column for each global transform whose
    condition can be told from the spine."""
    asked = [g for g in registry.global_transforms() if g.spine_condition]
    if not asked:
        return None
    return spine.groupBy("resourceType").agg(
        *[F.coalesce(g.spine_condition(), F.lit(False)).alias(g.name) for g in asked]
    )


def run_transforms(
    tables: Tables,
    registry: Registry,
    global_tables: Sequence[str] | None = None,
    known: Mapping[tuple[str, str], bool] = MappingProxyType({}),
) -> TransformRun:
    """Apply all transforms. A failing one leaves its tables as they were.

    ``known`` answers conditions of global transforms by (transform, table).
    """
    run = TransformRun(dict(tables))
    for t in registry.transforms():
        _run_one(run, t)
    names = list(tables) if global_tables is None else list(global_tables)
    for g in registry.global_transforms():
        present = [n for n in names if n in run.tables]
        answers = {n: known[g.name, n] for n in present if (g.name, n) in known}
        if g.query_condition is not None:
            asked = {n: run.tables[n] for n in present if n not in answers}
            answers |= query_answers(g.query_condition, asked)
        for name in present:
            _run_global(run, g, name, answers.get(name))
    return run


def query_answers(
    condition: Callable[[DataFrame], DataFrame], tables: Tables
) -> dict[str, bool | Exception]:
    """Whether the first value that ``condition`` finds in each table is true, with
    one action for all tables. A query that fails is the answer of its table only."""
    answers: dict[str, bool | Exception] = {}
    queries: dict[str, DataFrame] = {}
    for name, df in tables.items():
        try:
            queries[name] = _first_truth(condition(df)).select(F.lit(name).alias("name"), "holds")
        except Exception as error:  # noqa: BLE001 - isolation is the point
            answers[name] = error
    if not queries:
        return answers

    def run(some: Sequence[str]) -> dict[str, bool | Exception]:
        together = reduce(DataFrame.unionAll, [queries[n] for n in some])
        found = {row.name: row.holds for row in together.collect()}
        return {n: found.get(n, False) for n in some}

    try:
        return answers | run(list(queries))
    except Exception as error:  # noqa: BLE001 - one of them is to blame
        if len(queries) == 1:
            return answers | {name: error for name in queries}
    for name in queries:
        try:
            answers |= run([name])
        except Exception as error:  # noqa: BLE001
            answers[name] = error
    return answers


def _first_truth(df: DataFrame) -> DataFrame:
    """One row at most: whether the first value is neither null, zero nor empty."""
    first = df.limit(1).toDF(*[f"c{i}" for i in range(len(df.columns))])
    kind, value = first.schema[0].dataType, F.col("c0")
    if isinstance(kind, T.BooleanType):
        holds = value
    elif isinstance(kind, T.NumericType):
        holds = value != 0
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        holds = F.length(value) > 0
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        holds = F.size(value) > 0
    else:
        holds = value.isNotNull()
    return first.select(F.coalesce(holds, F.lit(False)).alias("holds"))


def _run_one(run: TransformRun, t: Transform) -> None:
    target = ",".join(t.dependencies)
    missing = [d for d in t.dependencies if d not in run.tables]
    if missing:
        run.note(t.name, target, NO_DEPENDENCY, ",".join(missing))
        return
    try:
        if t.condition is not None and not t.condition(run.tables):
            run.note(t.name, target, NO_CONDITION)
            return
        changed = dict(t.apply(run.tables))
        for df in changed.values():
            _ = df.schema  # analysis errors surface here, before anything changes
    except Exception as error:  # noqa: BLE001 - isolation is the point
        run.note(t.name, target, FAILED, error)
        return
    run.tables.update(changed)
    run.note(t.name, target, APPLIED)


def _run_global(
    run: TransformRun, g: GlobalTransform, name: str, known: bool | Exception | None
) -> None:
    df = run.tables[name]
    try:
        if isinstance(known, Exception):
            raise known
        holds = known
        if holds is None:
            holds = g.condition is None or g.condition(name, df)
        if not holds:
            run.note(g.name, name, NO_CONDITION)
            return
        changed = g.apply(df)
        _ = changed.schema
    except Exception as error:  # noqa: BLE001
        run.note(g.name, name, FAILED, error)
        return
    run.tables[name] = changed
    run.note(g.name, name, APPLIED)


def sql_transform(
    name: str,
    table: str,
    sql: str,
    dependencies: Sequence[str] | None = None,
    condition: str | None = None,
) -> Transform:
    """Transform of one table given as ``SELECT ... FROM {table}``.

    Dependencies are named as tables. ``condition`` is a query whose first value
    decides.
    """
    deps = list(dependencies) if dependencies is not None else [table]

    def query(tables: Tables, text: str) -> DataFrame:
        frames = {d: tables[d] for d in {*deps, table}}
        return run_select(frames, text.replace("{table}", quote(table)))

    def holds(tables: Tables) -> bool:
        row = query(tables, condition).first()
        return bool(row and row[0])

    return Transform(
        name,
        deps,
        lambda tables: {table: query(tables, sql)},
        holds if condition else None,
        version=f"{table}: {sql} IF {condition}",
    )


def sql_global_transform(
    name: str, sql: str, condition: str | None = None
) -> GlobalTransform:
    """Global transform given as ``SELECT ... FROM {table}``."""

    def query(df: DataFrame, text: str) -> DataFrame:
        return run_select({"this_table": df}, text.replace("{table}", "this_table"))

    return GlobalTransform(
        name,
        lambda df: query(df, sql),
        query_condition=(lambda df: query(df, condition)) if condition else None,
        version=f"{sql} IF {condition}",
    )


def has_column(name: str) -> Callable[[str, DataFrame], bool]:
    return lambda _, df: actual_name(df, name) is not None


def custom_table(tables: Tables, custom: CustomTable) -> DataFrame:
    """Columns of the custom query plus ``resourceType``, the custom table's name."""
    query = run_select(tables, custom.sql)
    return query.withColumn("resourceType", F.lit(custom.name))
