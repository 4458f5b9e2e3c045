"""Reading tables, and files in the folder that all nodes share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.sources.store import staged, work_folder

__all__ = [
    "ASCII_SPACE", "alone", "held", "importable", "lean", "lower_ascii", "map_rows", "staged", "table", "work_folder",
]

#: The white space that separates words, ``[\x20\x09-\x0D]``.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(df: DataFrame) -> DataFrame:
    """Let Python workers import this package from where the driver has it.

    For sessions on one machine. A cluster has the package installed or gets it
    with ``--py-files``; the entry is then without effect.
    """
    env, root = df.sparkSession.sparkContext.environment, str(Path(__file__).parents[2])
    paths = env.get("PYTHONPATH", "").split(":")
    if root not in paths:
        env["PYTHONPATH"] = ":".join([*filter(None, paths), root])
    return df


#: Bytes of rows that a Python worker gets at once, where operators follow one another.
#: Spark's bound of 64 MB is held on both sides, twice while a buffer of the JVM grows.
BATCH = 1 << 22
#: C arrays from 4 MB are mapped, and so are gone once they are freed; of the rest no
#: more than 8 MB is kept. Otherwise a worker keeps what its largest task ever took.
GIVES_BACK = {"MALLOC_MMAP_THRESHOLD_": str(1 << 22), "MALLOC_TRIM_THRESHOLD_": str(1 << 23)}


def lean(spark: SparkSession) -> None:
    """Settings with which executors of a session keep little memory between operators.

    They bound memory only, no row is treated otherwise. Both are the session's, for
    Python functions of this package that are planned from now on.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    spark.sparkContext.environment.update(GIVES_BACK)


#: What this process keeps from task to task.
_held: list = []


def held(make: Callable) -> Callable:
    """``lru_cache`` for tables that a Python worker keeps for its next tasks, until
    one of them works :func:`alone`."""
    cached = lru_cache(maxsize=2)(make)
    _held.append(cached)
    return cached


def forget() -> None:
    """Drops what is :func:`held` in this process."""
    if any(cached.cache_info().currsize for cached in _held):
        for cached in _held:
            cached.cache_clear()
        gc.collect()


def alone(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for ``mapInArrow``, in a worker that first drops what is :func:`held`.

    Spark hands a worker from one operator's tasks to the next one's, and all that an
    earlier one keeps there would take its memory beside the later ones.
    """

    def emptied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        yield from run(batches)

    return emptied


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else kept.

    ``lower`` is fast and does just that where every character is one byte; the
    others go through ``translate``.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, upper, lower)
    )


def map_rows(
    df: DataFrame,
    schema: str,
    per_row: Callable[[object, bytes | None], Iterable[tuple]],
    most: int = 4096,
) -> DataFrame:
    """``per_row(key, text as UTF-8)`` gives rows of ``schema``; ``df`` is (key, text).

    Rows stream through in Arrow batches. Results leave in slices of ``most`` rows,
    so that one batch of many results is never held as a whole.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            texts = batch.column(1).cast(pa.binary())
            for key, text in zip(batch.column(0), texts):
                rows.extend(per_row(key.as_py(), text.as_py()))
                if len(rows) >= most:
                    yield as_batch(rows, out)
                    rows = []
            if rows:
                yield as_batch(rows, out)

    return importable(df).mapInArrow(run, schema)


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )
