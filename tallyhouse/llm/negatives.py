"""Hard-negative mining by exact integer products of anchor and candidate tiles.

Vectors become integers, ``floor(scale * x)``. Anchors go in blocks of bounded size
to all tasks; candidates stream by in tiles. The scores of a block and a tile are
one matrix product by Strassen's recursion: operands are padded with zeros to a
multiple of the recursion's depth, seven products of quarters replace eight, and
quarters are added as 64-bit integers. These wrap around alike in every order, so
a score is exact if it fits 64 bits; a tile in which it might not is multiplied
with Python's integers, and one that really does not fails the job.

Each anchor has a heap of its best ``positives`` rows of the same label, and for
each of these a heap of its best ``negatives`` rows of other labels in the window
``low * positive <= high_scale * negative <= high * positive``. Heaps are sorted
arrays that merge: a task keeps one per anchor over all its tiles, and what the
tasks keep is ranked by a window over few rows per anchor and task. Same-label
products are only made for the first kind and no task holds more than a block, a
tile and their product, whatever label or vector holds a third of all rows.

Defined results: rows with a null id, label or vector, or with a null or non-finite
component, take no part. Shorter vectors count as if filled up with zeros; an empty
vector is all zeros. Repeated rows are rows of their own: each repeated anchor is
mined, and copies of an anchor are its positives like any other row. Ties go to
the smaller id. Fewer rows than asked for are all returned; an anchor without
positives, and a positive without negatives, have no row. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.tables import importable, staged, work_folder

#: Bytes of a block of anchors and of a tile of candidates.
BLOCK_BYTES = 1 << 21
TILE_ROWS = 4096
#: Anchors of a block and candidates of a tile at most, so that their product is small.
BLOCK_ROWS = 1024
#: A side of a product below which Strassen's recursion does not pay.
LEAF = 32
LOWEST = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Mining:
    """What to mine. A negative's score times 100 lies between ``low`` and ``high``
    times the positive's."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: float = 256.0


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of integer matrices, by seven products of quarters at each level."""
    shape = a.shape[0], b.shape[1]
    depth, side = 0, min(*a.shape, b.shape[1])
    while side > leaf:
        side, depth = -(-side // 2), depth + 1
    step = 1 << depth
    n, k, m = (-(-s // step) * step for s in (*a.shape, b.shape[1]))
    whole = _product(_padded(a, n, k), _padded(b, k, m), depth)
    return whole[: shape[0], : shape[1]]


def _padded(x: np.ndarray, rows: int, columns: int) -> np.ndarray:
    if x.shape == (rows, columns):
        return x
    out = np.zeros((rows, columns), dtype=x.dtype)
    out[: x.shape[0], : x.shape[1]] = x
    return out


def _product(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    if not depth:
        return a @ b
    n, k, m = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:n, :k], a[:n, k:], a[n:, :k], a[n:, k:]
    b11, b12, b21, b22 = b[:k, :m], b[:k, m:], b[k:, :m], b[k:, m:]
    out = np.empty((2 * n, 2 * m), dtype=a.dtype)
    depth -= 1
    m1 = _product(a11 + a22, b11 + b22, depth)
    m2 = _product(a21 + a22, b11, depth)
    m3 = _product(a11, b12 - b22, depth)
    m4 = _product(a22, b21 - b11, depth)
    m5 = _product(a11 + a12, b22, depth)
    m6 = _product(a21 - a11, b11 + b12, depth)
    m7 = _product(a12 - a22, b21 + b22, depth)
    out[:n, :m] = m1 + m4 - m5 + m7
    out[:n, m:] = m3 + m5
    out[n:, :m] = m2 + m4
    out[n:, m:] = m1 - m2 + m3 + m6
    return out


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products, anchors by candidates, exact or an ``OverflowError``."""
    width = max(anchors.shape[1], candidates.shape[1])
    a, b = _padded(anchors, len(anchors), width), _padded(candidates, len(candidates), width)
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    # Magnitudes as floats: the least integer has no absolute value of its own type.
    most = np.abs(a.astype(np.float64)).max() * np.abs(b.astype(np.float64)).max() * width
    if most < 2.0**62:
        return strassen(a, b.T)
    exact = strassen(a.astype(object), b.T.astype(object))
    if max(exact.max(), -exact.min()) >= 2**63 - 1:
        raise OverflowError("a score does not fit 64 bits")
    return exact.astype(np.int64)


class Heaps:
    """The best ``size`` entries of each of ``n`` lists: greatest score, least id, least row.

    Entries are sorted arrays; a free place has the row -1 and sorts last.
    """

    def __init__(self, n: int, size: int):
        self.size = size
        self.score = np.full((n, size), LOWEST, dtype=np.int64)
        self.id = np.full((n, size), np.iinfo(np.int64).max, dtype=np.int64)
        self.row = np.full((n, size), -1, dtype=np.int64)

    def merge(self, score: np.ndarray, id_: np.ndarray, row: np.ndarray, lists=slice(None)) -> None:
        """Further entries, as many columns for each of ``lists``."""
        score = np.concatenate((self.score[lists], score), axis=1)
        id_ = np.concatenate((self.id[lists], id_), axis=1)
        row = np.concatenate((self.row[lists], row), axis=1)
        order = np.lexsort((row, id_, ~score, row < 0), axis=1)[:, : self.size]
        self.score[lists] = np.take_along_axis(score, order, 1)
        self.id[lists] = np.take_along_axis(id_, order, 1)
        self.row[lists] = np.take_along_axis(row, order, 1)

    def entries(self) -> Iterator[tuple[int, int, int, int]]:
        """``list, score, id, row`` of all taken places."""
        lists, places = np.nonzero(self.row >= 0)
        yield from zip(
            lists.tolist(),
            self.score[lists, places].tolist(),
            self.id[lists, places].tolist(),
            self.row[lists, places].tolist(),
        )


@dataclass
class Tile:
    """Rows side by side: their own numbers, ids, labels and vectors, by id."""

    row: np.ndarray
    id: np.ndarray
    label: np.ndarray
    vector: np.ndarray

    def take(self, chosen: np.ndarray) -> Tile:
        return Tile(self.row[chosen], self.id[chosen], self.label[chosen], self.vector[chosen])

    def __len__(self) -> int:
        return len(self.row)


def tiles(batches: Iterator[pa.RecordBatch], rows: int = TILE_ROWS) -> Iterator[Tile]:
    """Tiles of ``row, id, label, vector`` batches, smaller where vectors are long."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            widths = batch.column(3).slice(start, rows).value_lengths().to_numpy(zero_copy_only=False)
            width = max(int(widths.max(initial=0)), 1)
            fit = max(1, min(len(widths), 2 * BLOCK_BYTES // (8 * width)))
            yield _tile(batch.slice(start, fit), width)
            start += fit


def _tile(batch: pa.RecordBatch, width: int) -> Tile:
    row, id_, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    vectors = batch.column(3)
    widths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    vector = np.zeros((len(row), width), dtype=np.int64)
    vector[np.arange(width) < widths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    order = np.lexsort((row, id_))
    return Tile(row[order], id_[order], label[order], vector[order])


def best(score: np.ndarray, size: int) -> np.ndarray:
    """Columns of the ``size`` greatest of each row, in order; ties go to the left."""
    return np.argsort(~score, axis=1, kind="stable")[:, :size]


def positive_heaps(anchors: Tile, candidates: Iterator[Tile], size: int) -> Heaps:
    heaps = Heaps(len(anchors), size)
    for tile in candidates:
        for label in np.intersect1d(anchors.label, tile.label):
            lists = np.flatnonzero(anchors.label == label)
            same = tile.take(tile.label == label)
            found = scores(anchors.vector[lists], same.vector)
            # The anchor itself is no positive: one place more, then it is struck out.
            at = best(found, size + 1)
            row = same.row[at]
            row = np.where(row == anchors.row[lists, None], -1, row)
            heaps.merge(np.take_along_axis(found, at, 1), same.id[at], row, lists)
    return heaps


def window_heaps(
    anchors: Tile,
    lists: np.ndarray,
    low: np.ndarray,
    high: np.ndarray,
    candidates: Iterator[Tile],
    size: int,
) -> Heaps:
    """Best entries between ``low`` and ``high`` for each window; ``lists`` are its anchors.

    A tile's scores are sorted once per anchor; every window is a run of that order.
    """
    heaps = Heaps(len(lists), size)
    for tile in candidates:
        found = scores(anchors.vector, tile.vector)
        order = best(found, found.shape[1])
        other = np.take_along_axis(tile.label[None, :] != anchors.label[:, None], order, 1)
        # Rows of the anchor's own label go to the end of its order.
        last = np.argsort(~other, axis=1, kind="stable")
        order = np.take_along_axis(order, last, 1)
        ranked = ~np.take_along_axis(found, order, 1)
        count = other.sum(axis=1)
        places = np.arange(size)
        first = np.array(
            [ranked[a, : count[a]].searchsorted(~h) for a, h in zip(lists, high)], dtype=np.int64
        )
        at = first[:, None] + places
        there = at < count[lists][:, None]
        at = order[lists[:, None], np.minimum(at, order.shape[1] - 1)]
        score = found[lists[:, None], at]
        row = np.where(there & (score >= low[:, None]), tile.row[at], -1)
        if (row >= 0).any():
            heaps.merge(score, tile.id[at], row)
    return heaps


def quantised(
    rows: DataFrame, label: Column, mining: Mining, id_col: str, vector_col: str
) -> DataFrame:
    """``row, id, label, vector`` of the rows that take part, written to the work folder.

    ``row`` tells repeated rows apart; being written, it is the same for all reads.
    """

    def part(x: Column) -> Column:
        scaled = x.cast("double") * F.lit(mining.scale)
        refused = F.raise_error(F.lit("a scaled component does not fit 64 bits"))
        return F.when(F.abs(scaled) < F.lit(2.0**63), F.floor(scaled)).otherwise(refused.cast("long"))

    def unusable(x: Column) -> Column:
        value = x.cast("double")
        return x.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))

    vector = F.col(vector_col)
    named = rows.select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), vector.alias("vector")
    )
    usable = named.filter(
        "id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL"
    ).filter(~F.exists("vector", unusable))
    numbered = usable.select(
        F.monotonically_increasing_id().alias("row"), "id", "label", F.transform("vector", part).alias("vector")
    )
    return staged(numbered)


def mine(
    rows: DataFrame,
    label: Column,
    is_anchor: Column,
    mining: Mining = Mining(),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``label`` is over the columns of ``rows``, ``is_anchor`` over ``id``. Anchors are
    numbered by a hash of their row and taken in blocks of that number; a block that
    chance makes larger is cut where it is read. Only a block's anchors and its
    positives are ever on the driver. Each block's result is written on its own.
    """
    spark = rows.sparkSession
    candidates = quantised(rows, label, mining, id_col, vector_col)
    anchors = candidates.filter(is_anchor)
    sizes = anchors.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")
    ).first()
    folder = f"{work_folder(spark)}/negatives"
    per_block = max(1, min(block_rows, BLOCK_BYTES // (8 * max(sizes.width or 1, 1))))
    blocks = -(-sizes.n // per_block)
    spark.createDataFrame([], RESULT).write.parquet(folder)
    numbered = staged(anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(max(blocks, 1)))))
    for number in range(blocks):
        block = numbered.filter(F.col("block") == number).drop("block")
        for tile in tiles(iter(block.toArrow().combine_chunks().to_batches()), per_block):
            _mine_block(tile, candidates, mining, folder)
    return spark.read.schema(RESULT).parquet(folder)


def _mine_block(anchors: Tile, candidates: DataFrame, mining: Mining, folder: str) -> None:
    spark = candidates.sparkSession
    shared = spark.sparkContext.broadcast(anchors)
    size = mining.positives

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows(positive_heaps(shared.value, tiles(batches), size))

    found = _ranked(importable(candidates).mapInArrow(first, ENTRIES), size).collect()
    if not found:
        return
    found.sort(key=lambda r: (r.list, r.place))
    lists = np.array([r.list for r in found], dtype=np.int64)
    # Bounds as exact integers: 10 n >= 3 p and 10 n <= 9 p in the usual window.
    low = np.array([_clip(-(-mining.low * r.score // 100)) for r in found], dtype=np.int64)
    high = np.array([_clip(mining.high * r.score // 100) for r in found], dtype=np.int64)
    windows = spark.sparkContext.broadcast((lists, low, high))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows(
            window_heaps(shared.value, *windows.value, tiles(batches), mining.negatives)
        )

    ranked = _ranked(importable(candidates).mapInArrow(second, ENTRIES), mining.negatives)
    named = spark.createDataFrame(
        [(i, int(anchors.id[r.list]), r.id, r.score) for i, r in enumerate(found)],
        "list long, anchor_id long, positive_id long, positive_score long",
    )
    result = ranked.join(named, "list").select(
        "anchor_id",
        "positive_id",
        F.col("place").alias("rank"),
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
    result.write.mode("append").parquet(folder)
    shared.unpersist()
    windows.unpersist()


ENTRIES = "list long, score long, id long, row long"
RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, "
    "positive_score long, negative_score long"
)


def _clip(x: int) -> int:
    return max(LOWEST, min(x, 2**63 - 1))


def _rows(heaps: Heaps) -> Iterator[pa.RecordBatch]:
    columns = list(zip(*heaps.entries())) or [()] * 4
    names = ["list", "score", "id", "row"]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _ranked(entries: DataFrame, size: int) -> DataFrame:
    """The tasks' heaps of each list merged: the first ``size`` entries with their place."""
    order = Window.partitionBy("list").orderBy(F.desc("score"), "id", "row")
    placed = entries.withColumn("place", F.row_number().over(order))
    return placed.filter(F.col("place") <= size)
