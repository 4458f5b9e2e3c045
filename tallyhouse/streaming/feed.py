"""The incremental build, run continuously.

A micro-batch must not cost a rewrite of the spine. Batches of changes are
therefore kept as small tables beside the stored spine, the current state is
the conditional upsert of those changes into it, and a compaction folds them in
from time to time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyhouse.operators.merge import apply_changes, complete, latest_per_key
from tallyhouse.plans.inventory import spine_changes, spine_table
from tallyhouse.schemas import CAPTURE_TIME, KEY, SPINE, STAGING, STATE_ID
from tallyhouse.sources.items import staged_to_spine
from tallyhouse.sources.manifest import Manifest, partition_values
from tallyhouse.sources.store import Store, staged


def item_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Spine rows from a folder in which JSON-lines files keep arriving."""
    staged = (
        spark.readStream.schema(STAGING)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("mode", "FAILFAST")
        .json(path)
    )
    return staged_to_spine(staged)


class ChangeFeed:
    """Changes waiting beside the stored spine of ``store``.

    A batch is a folder named by the run it came from and its number in that run,
    so two streams, or a stream with a new checkpoint, never meet in one. A folder
    counts once its commit marker is there. Which batches the stored spine already
    holds is part of each of its versions, and every later version inherits it, so a
    batch that is delivered again, or that a crash left behind, is not applied again.
    """

    def __init__(self, store: Store, name: str = "changes"):
        self.store = store
        self.spark = store.spark
        self.resources = spine_table(store)
        self.folder = f"{store.root}/_{name}"
        self._files = store.files

    def batches(self, version: Manifest | None = None) -> list[str]:
        """Committed batches that a version of the spine does not hold yet."""
        done = self.applied(version)
        return [
            b
            for b in self._files.children(self.folder)
            if b.startswith("batch=")
            and b not in done
            and self._files.exists(f"{self.folder}/{b}/_SUCCESS")
        ]

    def applied(self, version: Manifest | None = None) -> frozenset[str]:
        """Batches that a version of the spine holds."""
        return (version or self.resources.current()).applied

    def append(self, changes: DataFrame, batch_id: int, run: str = "run") -> None:
        """Keep one micro-batch, reduced to the newest row of each key.

        Rows with a NULL in the key match nothing and are all kept. A batch that
        is delivered again replaces its first copy.
        """
        name = f"batch={run}-{batch_id:020d}"
        if name in self.applied():
            return
        rows = changes.select(SPINE.names)
        known = complete(KEY)
        reduced = latest_per_key(rows.filter(known)).unionByName(rows.filter(~known))
        reduced.write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def changes(self, batches: list[str] | None = None) -> DataFrame:
        names = self.batches() if batches is None else batches
        if not names:
            return self.spark.createDataFrame([], SPINE)
        paths = [f"{self.folder}/{b}" for b in names]
        return self.spark.read.schema(SPINE).parquet(*paths)

    def current(self) -> DataFrame:
        """The spine with all waiting changes applied, newer captures winning."""
        version = self.resources.current()
        changed = spine_changes(self.resources, version, self.changes(self.batches(version)), staged)
        return apply_changes(self.resources.read(version), changed)

    def compact(self) -> int:
        """Fold the waiting batches into a new version of the spine.

        Only the types that the batches change are rewritten. The batches become part
        of the version in the same commit, which fails if another writer, be it a
        build, was first; the compaction is then done again on that one's version. So
        no crash and no race loses a batch or applies one twice. A batch is forgotten
        when its folder is gone and a later one of its run is held, for then it can no
        longer be delivered again.
        """
        batches = self.resources.updated(self._fold)
        for batch in batches:
            self._files.delete(f"{self.folder}/{batch}")
        return len(batches)

    def _fold(self, base: Manifest) -> list[str]:
        # Folders a crash left behind, whose changes a version holds.
        there = set(self._files.children(self.folder))
        for batch in there & base.applied:
            self._files.delete(f"{self.folder}/{batch}")
        batches = self.batches(base)
        if not batches:
            return []
        changed = spine_changes(self.resources, base, self.changes(batches), staged)
        touched = partition_values(changed, "resourceType")
        self.resources.rewrite(
            base,
            touched,
            lambda stored: apply_changes(stored, changed.hint("rebalance", "resourceType")),
            [*last_of_runs(base.applied), *batches],
        )
        return batches

    def start(self, items: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Collect a stream of spine rows; ``trigger`` as for ``writeStream``.

        The run's name is the checkpoint's own, so a restarted stream goes on
        counting where it was, and another checkpoint is another run.
        """
        run = self._run_of(checkpoint)
        return (
            items.writeStream.foreachBatch(lambda df, n: self.append(df, n, run))
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def _run_of(self, checkpoint: str) -> str:
        path = f"{checkpoint.rstrip('/')}/feed_run"
        if not self._files.exists(path):
            self._files.replace_line(path, uuid.uuid4().hex)
        return self._files.read_line(path)


def last_of_runs(batches: Iterable[str]) -> list[str]:
    """The newest batch of each run: only that one can be delivered again."""
    newest: dict[str, str] = {}
    for batch in sorted(batches):
        newest[batch.rpartition("-")[0]] = batch
    return list(newest.values())


def latest_state(items: DataFrame) -> DataFrame:
    """Streaming newest row per key. Items older than the state change nothing.

    State is one row per live key, and an update is emitted only for keys that a
    batch touched. Rows of a micro-batch combine before they reach the state.
    """
    rest = [c for c in items.columns if c not in KEY]
    rank = F.struct(CAPTURE_TIME, STATE_ID)
    return (
        items.groupBy(*KEY)
        .agg(F.max_by(F.struct(*rest), rank).alias("row"))
        .select(*KEY, "row.*")
    )
