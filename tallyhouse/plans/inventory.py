"""The inventory: stored tables, the build that brings them up to date, queries."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Collection, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.jsontext import statements
from tallyhouse.operators.counts import distinct_regions, resource_types
from tallyhouse.operators.derive import (
    DEFAULT_RULES,
    derive_type,
    stringify_content,
    type_schemas,
)
from tallyhouse.operators.infer import InferenceRules
from tallyhouse.operators.merge import (
    accounts_refresh,
    apply_changes,
    check_claims,
    complete,
    effective_changes,
    incremental_cutoff,
    keyed_replace,
    land_authoritative,
    land_merge,
    latest_per_key,
    missing_keys,
    without_keys,
)
from tallyhouse.plans.builtin import default_registry
from tallyhouse.plans.query import ACCOUNTS_TABLE, SPINE_TABLE, Query
from tallyhouse.plans.transforms import (
    APPLIED,
    FAILED,
    CustomTable,
    Registry,
    TransformRun,
    custom_table,
    run_transforms,
    spine_conditions,
    NO_DEPENDENCY,
)
from tallyhouse.schemas import ACCOUNTS, KEY, MANAGED_POLICIES, SPINE, table_claims, table_name
from tallyhouse.sources.contract import (
    Semantics,
    Source,
    claimed_types,
    source_rows_to_spine,
)
from tallyhouse.sources.items import changed_since
from tallyhouse.sources.manifest import Manifest, PartitionedTable, partition_values
from tallyhouse.sources.organization import named_accounts, policy_documents
from tallyhouse.sources.store import Files, Store, staged, work_folder

log = logging.getLogger(__name__)

POLICIES_TABLE = "aws_managed_policy"
#: Policies as fetched, kept across builds; POLICIES_TABLE is derived from them.
POLICY_CACHE = "managed_policy_documents"
CUSTOM_TYPES_TABLE = "custom_resource_types"
FETCH, SNAPSHOTS, SKIP = "fetch", "snapshots", "skip"
WRITTEN = "written"
#: Written, but without its transforms, as one of them fails on a value.
UNTRANSFORMED = "written as derived"
#: Written without the one transform that fails on a value.
PARTLY = "written without a failed transform"
#: What it is derived from has not changed since it was written.
UNCHANGED = "unchanged"
#: What each derived table was last derived from.
DERIVED_STATE = "_derived_state"
REPORT_SCHEMA = "step string, name string, status string, rows long, detail string"


@dataclass
class BuildInputs:
    """What a build reads. All are DataFrames, so each can be of any size.

    ``items`` and ``identifiers`` feed a ``fetch`` build, ``snapshots`` a
    ``snapshots`` build. ``accounts`` is None when names were not fetched.
    ``policies`` has ``arn, defaultVersionId, document`` (URL-encoded).
    """

    items: DataFrame | None = None
    identifiers: DataFrame | None = None
    snapshots: DataFrame | None = None
    accounts: DataFrame | None = None
    policies: DataFrame | None = None


@dataclass
class BuildSettings:
    mode: str = FETCH
    rebuild: bool = False
    sources: Sequence[Source] = ()
    registry: Registry = field(default_factory=default_registry)
    custom_tables: Sequence[CustomTable] = ()
    rules: InferenceRules = DEFAULT_RULES
    #: Table writes that run at the same time.
    parallel_writes: int = 8
    #: Generations of each table that stay on storage, for readers of older ones.
    keep_generations: int = 2
    #: Write all derived tables, also those whose rows and transforms are the same.
    derive_all: bool = False


@dataclass
class BuildReport:
    """What each step of a build did. ``counts`` are rows per merge action."""

    rows: list[tuple[str, str, str, int | None, str | None]] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)

    def note(self, step, name, status, rows=None, detail=None) -> None:
        text = None if detail is None else str(detail)
        self.rows.append((step, name, status, rows, text))
        if status == FAILED:
            log.error("%s %s failed: %s", step, name, text)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, REPORT_SCHEMA)

    def status(self, step: str) -> dict[str, str]:
        return {name: status for s, name, status, _, _ in self.rows if s == step}


class Inventory:
    """Stored tables of one inventory below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.store = Store(spark, root)
        self.resources = spine_table(self.store)

    # -- reading -----------------------------------------------------------

    def spine(self) -> DataFrame:
        return self.resources.read()

    def table(self, name: str) -> DataFrame:
        if name == SPINE_TABLE:
            return self.spine()
        if name == ACCOUNTS_TABLE:
            return self.store.read(ACCOUNTS_TABLE, ACCOUNTS)
        return self.store.read(name)

    def query(self, query: Query) -> DataFrame:
        """User SQL may also read any stored table, ``resourceTypes`` and ``regions``."""
        views = {
            "resourceTypes": self.resource_types,
            "regions": lambda: distinct_regions(self.spine()),
        }
        stored = [n for n in self.store.names() if not n.startswith("_")]
        return query.run(
            lambda name: views[name]() if name in views else self.table(name),
            [*stored, SPINE_TABLE, ACCOUNTS_TABLE, *views],
        )

    def resource_types(self) -> DataFrame:
        custom = self.store.read(CUSTOM_TYPES_TABLE, _CUSTOM_TYPES)
        return resource_types(
            self.spine(), custom.withColumnRenamed("resource_type", "resourceType")
        )

    def cutoff(self, sources: Sequence[Source] = ()):
        """Capture time from which a fetch has to look again; None for "all"."""
        if not self.resources.exists():
            return None
        return incremental_cutoff(self.spine(), claimed_types(sources)).first().cutoff

    # -- building ----------------------------------------------------------

    def build(
        self, inputs: BuildInputs, settings: BuildSettings = BuildSettings()
    ) -> BuildReport:
        report = BuildReport()
        if settings.rebuild:
            for name in self.store.names():
                self.store.drop(name)
            self.resources.drop()
        folder = work_folder(self.spark)

        def stage(df: DataFrame) -> DataFrame:
            return staged(df, folder)

        try:
            landed = []
            if settings.mode != SKIP:
                landed = self._fetch_sources(settings.sources, stage, report)
            # The items were fetched for what is stored now, whoever commits meanwhile.
            since = self.cutoff(settings.sources) if settings.mode == FETCH else None
            # Another writer may commit meanwhile: once more, on what it wrote.
            self.resources.updated(
                lambda base: self._build_spine(base, since, inputs, settings, landed, stage, report)
            )
        finally:
            # Nothing refers to the intermediate tables once the spine is written.
            Files(self.spark).delete(folder)
        self._build_accounts(inputs, report)
        self._build_policies(inputs, report)
        tables = self._build_derived(settings, report)
        self._build_custom(settings, tables, report)
        for name in self.store.names():
            self.store.expire(name, settings.keep_generations)
        self.resources.expire(settings.keep_generations)
        return report

    def _build_spine(
        self,
        base: Manifest,
        since: datetime | None,
        inputs: BuildInputs,
        settings: BuildSettings,
        landed: Sequence[tuple[Source, DataFrame]],
        stage: Callable[[DataFrame], DataFrame],
        report: BuildReport,
    ) -> None:
        """Commit the next version of the spine, which shares with ``base`` the
        files of all resource types that nothing changes."""
        if settings.mode == SKIP:
            if not self.resources.exists():
                self.resources.commit(base, {})
            return
        if settings.mode == SNAPSHOTS:
            if inputs.snapshots is None:
                raise ValueError("a snapshots build needs snapshots")
            rows = clustered(inputs.snapshots.select(SPINE.names))
            self.resources.replace(with_landed(rows, landed), base)
            return
        if settings.mode != FETCH:
            raise ValueError(f"unknown build mode {settings.mode!r}")
        if inputs.items is None or inputs.identifiers is None:
            raise ValueError("a fetch build needs items and identifiers")

        claimed = claimed_types(settings.sources)
        check_claims(inputs.identifiers, claimed)
        items = changed_since(inputs.items, since)
        changed = spine_changes(self.resources, base, items, stage)
        keys = self.resources.read(base).select(*KEY).unionByName(changed.select(*KEY))
        doomed = stage(missing_keys(keys, inputs.identifiers, claimed))
        touched = partition_values(changed, "resourceType") | partition_values(doomed, "resourceType")
        for source, rows in landed:
            touched |= partition_values(rows, "resourceType")
            if source.semantics is Semantics.AUTHORITATIVE:
                touched |= set(source.resource_types) & set(base.parts)
        report.counts = {"INSERT": 0, "UPDATE": 0, "DELETE": 0}
        if not touched and base.number and not base.dropped:
            return
        before, after = Observation("merged"), Observation("reaped")

        def change(stored: DataFrame) -> DataFrame:
            merged = apply_changes(stored, changed.hint("rebalance", "resourceType"))
            merged = merged.observe(before, F.count("*").alias("rows"))
            spine = without_keys(merged, doomed).select(SPINE.names)
            spine = spine.observe(after, F.count("*").alias("rows"))
            return with_landed(stringify_content(spine), landed)

        self.resources.rewrite(base, touched, change)
        if touched:
            actions = {r.merge_action: r["count"] for r in changed.groupBy("merge_action").count().collect()}
            report.counts |= actions
            report.counts["DELETE"] = before.get["rows"] - after.get["rows"]

    def compact(self) -> None:
        """Rewrite the spine so that each type has few, large files again."""
        self.resources.updated(
            lambda base: self.resources.replace(clustered(self.resources.read(base)), base)
        )

    def _fetch_sources(
        self,
        sources: Sequence[Source],
        stage: Callable[[DataFrame], DataFrame],
        report: BuildReport,
    ) -> list[tuple[Source, DataFrame]]:
        """Rows of every enabled source, fully written before anything lands.

        A source that fails, at any row, contributes nothing: its stored rows
        stay and the other sources go on.
        """
        stored = {name: self.table(name) for name in self.store.names()}
        stored[SPINE_TABLE] = self.spine()

        def fetch(source: Source) -> DataFrame:
            return stage(source_rows_to_spine(source.load(self.spark, stored)))

        enabled = [s for s in sources if s.enabled]
        out = []
        for source, result in zip(
            enabled, self._in_parallel(fetch, enabled, len(enabled))
        ):
            if isinstance(result, Exception):
                report.note("source", source.name, FAILED, detail=result)
            else:
                report.note("source", source.name, "landed", result.count())
                out.append((source, result))
        return out

    def _build_accounts(self, inputs: BuildInputs, report: BuildReport) -> None:
        listed = None if inputs.accounts is None else named_accounts(inputs.accounts)
        fresh = accounts_refresh(self.table(ACCOUNTS_TABLE), self.spine(), listed)
        self.store.write(ACCOUNTS_TABLE, fresh)
        report.note("table", ACCOUNTS_TABLE, WRITTEN)

    def _build_policies(self, inputs: BuildInputs, report: BuildReport) -> None:
        """Replace fetched versions among the policies kept from earlier builds."""
        stored = self.store.read(POLICY_CACHE, MANAGED_POLICIES)
        if inputs.policies is not None:
            fetched = policy_documents(inputs.policies).withColumn(
                "policyStatements", statements(F.col("policyDocument"))
            )
            stored = keyed_replace(stored, fetched, "arn", "defaultVersionId")
        elif self.store.exists(POLICY_CACHE):
            return
        self.store.write(POLICY_CACHE, stored)
        report.note("table", POLICY_CACHE, WRITTEN)

    def _build_derived(
        self, settings: BuildSettings, report: BuildReport
    ) -> list[str]:
        """One table per type, with all transforms applied, written once each.

        A table is written when the rows of its type, another table that a transform
        puts beside it, the transforms or the inference rules have changed since it
        was written; all others stay, unread.
        """
        version = self.resources.current()
        names: dict[str, str] = {}
        for table, claimants in table_claims([t for t in version.parts if t is not None]).items():
            if len(claimants) > 1:
                report.note("table", table, FAILED, detail=f"name of several types: {claimants}")
            else:
                names[claimants[0]] = table
        tokens = {table: version.parts[t] for t, table in names.items()}
        tokens[POLICIES_TABLE] = self.store.generation(POLICY_CACHE) or ""
        others = {SPINE_TABLE: str(version.number), ACCOUNTS_TABLE: self.store.generation(ACCOUNTS_TABLE) or ""}
        state = DerivedState.read(self.store)
        print_ = repr((settings.registry.fingerprint(), settings.rules))
        stale = set(tokens)
        if not settings.derive_all and state.settings == print_:
            current = {**tokens, **others}
            stale = {
                t for t in {*current, *state.tables}
                if current.get(t) != state.tables.get(t) or (t in tokens and not self.store.exists(t))
            }
            stale = with_dependents(stale, settings.registry)
        spine = self.resources.read(version, [t for t, table in names.items() if table in stale])
        schemas = type_schemas(spine, settings.rules)
        plain: dict[str, DataFrame] = {}
        for resource_type, table in names.items():
            if table not in stale:
                report.note("table", table, UNCHANGED)
                continue
            schema = schemas[resource_type]
            if schema.refused:
                detail = f"{schema.refused} documents cannot be read"
                report.note("table", table, FAILED, detail=detail)
                continue
            try:
                plain[table] = derive_type(spine, schema)
            except Exception as error:  # noqa: BLE001 - other types go on
                report.note("table", table, FAILED, detail=error)
        of_types = list(plain)
        if POLICIES_TABLE in stale:
            plain[POLICIES_TABLE] = self.store.read(POLICY_CACHE, MANAGED_POLICIES)
        else:
            report.note("table", POLICIES_TABLE, UNCHANGED)
        # Transforms may read these two; they are not written back.
        read_only = {SPINE_TABLE: self.resources.read(version), ACCOUNTS_TABLE: self.table(ACCOUNTS_TABLE)}
        kept = {t for t in tokens if t not in stale}
        registry = settings.registry

        def transformed(registry: Registry) -> TransformRun:
            return run_transforms(
                plain | read_only, registry, of_types, self._known_conditions(spine, names, registry)
            )

        for t in registry.transforms():
            if kept & set(t.dependencies) and set(t.dependencies) <= kept | set(read_only):
                # It was applied, or found its condition unmet, when these were written.
                report.note("transform", f"{t.name}:{','.join(t.dependencies)}", UNCHANGED)
                registry = registry.without(t.name)
        run = transformed(registry)
        for name, table, status, detail in run.report:
            report.note("transform", f"{name}:{table}", status, detail=detail)
        custom = [table_name(c.name) for c in settings.custom_tables]
        self._drop_vanished([*tokens, *plain, *custom])
        written = self._write_all(plain, run, lambda name: transformed(registry.without(name)), settings, report)
        fresh = {t: tokens[t] for t in [*kept, *written]}
        DerivedState(print_, fresh | others).write(self.store)
        return [t for t in tokens if self.store.exists(t)]

    def _known_conditions(
        self, spine: DataFrame, names: Mapping[str, str], registry: Registry
    ) -> dict[tuple[str, str], bool]:
        """Conditions of global transforms for all tables, from one aggregation."""
        answers = spine_conditions(spine, registry)
        if answers is None:
            return {}
        return {
            (transform, names[row.resourceType]): holds
            for row in answers.collect()
            if row.resourceType in names
            for transform, holds in row.asDict().items()
            if transform != "resourceType"
        }

    def _drop_vanished(self, current: Sequence[str]) -> None:
        """Derived tables of types that no longer exist would show old rows. Tables
        that are still wanted but failed this time stay as they are."""
        keep = {SPINE_TABLE, ACCOUNTS_TABLE, POLICY_CACHE, CUSTOM_TYPES_TABLE, *current}
        for name in self.store.names():
            if name not in keep and not name.startswith("_"):
                self.store.drop(name)

    def _write_all(
        self,
        plain: Mapping[str, DataFrame],
        run: TransformRun,
        without: Callable[[str], TransformRun],
        settings: BuildSettings,
        report: BuildReport,
    ) -> list[str]:
        """Write the tables; returns those that were written with all transforms.

        A transform may fail on a value only when it runs. The table is then tried
        without each of its transforms in turn, the last first, and is kept as
        derived only if more than one of them fails.
        """

        def write(name: str) -> tuple[str, str | None]:
            try:
                self.store.write(name, run.tables[name])
                return WRITTEN, None
            except Exception:  # noqa: BLE001
                pass
            try:
                # It may have been the cluster: once more before anything is given up.
                self.store.write(name, run.tables[name])
                return WRITTEN, None
            except Exception as error:  # noqa: BLE001
                return without_one(name, str(error))

        def without_one(name: str, error: str) -> tuple[str, str]:
            applied = [
                t for t, tables, status, _ in run.report
                if status == APPLIED and name in tables.split(",")
            ]
            for transform in reversed(applied):
                try:
                    self.store.write(name, without(transform).tables[name])
                    report.note("transform", f"{transform}:{name}", FAILED, detail=error)
                    return PARTLY, f"transform {transform} failed: {error}"
                except Exception:  # noqa: BLE001 - another one may be to blame
                    continue
            self.store.write(name, plain[name])
            return UNTRANSFORMED, f"transforms failed, table as derived: {error}"

        names, whole = list(plain), []
        for name, result in zip(
            names, self._in_parallel(write, names, settings.parallel_writes)
        ):
            if isinstance(result, Exception):
                report.note("table", name, FAILED, detail=result)
                continue
            status, detail = result
            report.note("table", name, status, detail=detail)
            if status == WRITTEN:
                whole.append(name)
        return whole

    def _build_custom(
        self, settings: BuildSettings, tables: Sequence[str], report: BuildReport
    ) -> None:
        """Custom tables over the finished ones and over each other, and the registry
        of their names. One that fails leaves the stored table of its name."""
        available = {
            n: self.table(n)
            for n in [*tables, SPINE_TABLE, ACCOUNTS_TABLE]
            if n == SPINE_TABLE or self.store.exists(n)
        }
        taken = {*available, POLICY_CACHE, CUSTOM_TYPES_TABLE}
        written, waiting = [], []
        for custom in settings.custom_tables:
            if table_name(custom.name) in taken:
                report.note("custom", custom.name, FAILED, detail="name of another table")
            else:
                waiting.append(custom)
        while waiting:
            ready = [c for c in waiting if all(d in available for d in c.dependencies)]
            if not ready:
                break
            waiting = [c for c in waiting if c not in ready]
            for custom in ready:
                target = table_name(custom.name)
                try:
                    self.store.write(target, custom_table(available, custom))
                    report.note("custom", custom.name, WRITTEN)
                except Exception as error:  # noqa: BLE001
                    report.note("custom", custom.name, FAILED, detail=error)
                if self.store.exists(target):
                    written.append((custom.name,))
                    available[target] = self.table(target)
        for custom in waiting:
            missing = [d for d in custom.dependencies if d not in available]
            report.note("custom", custom.name, NO_DEPENDENCY, detail=",".join(missing))
            if self.store.exists(table_name(custom.name)):
                written.append((custom.name,))
        self.store.write(
            CUSTOM_TYPES_TABLE, self.spark.createDataFrame(written, _CUSTOM_TYPES)
        )

    def _in_parallel(self, fn: Callable, items: Sequence, workers: int) -> list:
        """Run Spark jobs from several threads; exceptions are returned, not raised."""

        def guarded(item):
            try:
                return fn(item)
            except Exception as error:  # noqa: BLE001
                return error

        if not items:
            return []
        task = inheritable_thread_target(self.spark)(guarded)
        with ThreadPoolExecutor(max(1, min(workers, len(items)))) as pool:
            return list(pool.map(task, items))


_CUSTOM_TYPES = "resource_type string"


def clustered(spine: DataFrame) -> DataFrame:
    """Rows of a type side by side, as files hold one type each.

    REBALANCE cuts a type with very many rows into several tasks and packs small
    types together, which a plain repartition by type would not.
    """
    return spine.hint("rebalance", "resourceType")


def spine_table(store: Store) -> PartitionedTable:
    return PartitionedTable(store, SPINE_TABLE, SPINE, "resourceType")


def spine_changes(
    resources: PartitionedTable,
    base: Manifest,
    incoming: DataFrame,
    stage: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """What incoming rows change in a version of the spine, with ``merge_action``.

    Of the stored rows only keys and times are read, and only those of the types
    that come in.
    """
    rows = incoming.select(SPINE.names)
    known = complete(KEY)
    fresh = stage(latest_per_key(rows.filter(known)).unionByName(rows.filter(~known)))
    stored = resources.read(base, partition_values(fresh, "resourceType"))
    return stage(effective_changes(stored, fresh))


def with_landed(spine: DataFrame, landed: Sequence[tuple[Source, DataFrame]]) -> DataFrame:
    for source, rows in landed:
        if source.semantics is Semantics.AUTHORITATIVE:
            spine = land_authoritative(spine, rows, source.resource_types)
        else:
            spine = land_merge(spine, rows)
    return spine


@dataclass(frozen=True)
class DerivedState:
    """What the derived tables were last written from: settings, and per table the
    data folder or generation of its source."""

    settings: str = ""
    tables: Mapping[str, str] = field(default_factory=dict)

    @staticmethod
    def read(store: Store) -> DerivedState:
        path = f"{store.root}/{DERIVED_STATE}"
        if not store.files.exists(path):
            return DerivedState()
        return DerivedState(**json.loads(store.files.read_line(path)))

    def write(self, store: Store) -> None:
        text = json.dumps({"settings": self.settings, "tables": dict(self.tables)})
        store.files.replace_line(f"{store.root}/{DERIVED_STATE}", text)


def with_dependents(stale: Collection[str], registry: Registry) -> set[str]:
    """``stale`` tables and those that a transform puts beside one of them."""
    out, grown = set(stale), True
    while grown:
        grown = False
        for t in registry.transforms():
            deps = set(t.dependencies)
            if deps & out and not deps <= out:
                out |= deps
                grown = True
    return out
