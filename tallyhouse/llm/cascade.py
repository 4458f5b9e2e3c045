"""Exact membership by a cascade of Bloom filters, and URL rules on top of it.

The keys that may ever be asked for are known: they come from the corpus. Level 1
holds the listed keys. Level 2 holds its false positives among all other keys of
the universe, level 3 those listed keys that level 2 takes for false positives,
and so on until a level makes no mistake. A key of the universe is listed exactly
if the first level that rejects it has an even number. Asking needs no join and
no copy of either list, only the levels' bits.

Size: level 1 has the false-positive rate at which its false positives are as many
as the listed keys, every later level one half. So all levels together grow with
the listed keys and the logarithm of the universe, not with the corpus;
:class:`Cascade` refuses to grow beyond ``max_bytes``.

Rules are a host and a path prefix. A rule fits its host and all subdomains if the
path starts with the rule's; the longest fitting rule decides. Where none fits,
the url is on no list and is allowed.

Defined results: a null url, or one without ``://``, has an empty host and path
and fits no rule. Repeated rows are judged each. Other columns do not matter. An
empty table gives no rows, and an empty list no members.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.tables import importable, lower_ascii, staged

#: Rate of every level after the first.
HALF = 0.5


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix; another function for every seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class Bloom:
    """``hashes`` bits per key among ``64 * len(words)``; ``seed`` is the level."""

    words: np.ndarray
    hashes: int
    seed: int

    @staticmethod
    def shape(keys: int, rate: float) -> tuple[int, int]:
        hashes = max(1, round(-math.log2(rate)))
        bits = max(64, math.ceil(keys * hashes / math.log(2)))
        return -(-bits // 64), hashes

    @staticmethod
    def positions(a: np.ndarray, b: np.ndarray, words: int, hashes: int, seed: int) -> np.ndarray:
        a, b = mixed(a.view(np.uint64), 2 * seed), mixed(b.view(np.uint64), 2 * seed + 1)
        with np.errstate(over="ignore"):
            steps = np.arange(hashes, dtype=np.uint64)[:, None]
            return (a + steps * (b | np.uint64(1))) % np.uint64(64 * words)

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self.positions(a, b, len(self.words), self.hashes, self.seed)
        bits = (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
        return bits.all(axis=0)


def hashed(keys: DataFrame) -> DataFrame:
    return keys.select(
        "key", F.xxhash64("key").alias("a"), F.xxhash64(F.lit("second"), "key").alias("b")
    )


def fill(keys: DataFrame, words: int, hashes: int, seed: int) -> Bloom:
    """Bits of all keys: set within each task, then united per word."""

    def run(batches):
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at = np.unique(Bloom.positions(a, b, words, hashes, seed))
            word, start = np.unique(at >> np.uint64(6), return_index=True)
            if len(word):
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word.view(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"]
                )

    parts = importable(keys.select("a", "b")).mapInArrow(run, "word long, bits long")
    out = np.zeros(words, dtype=np.uint64)
    # At most one row per word, and Cascade has checked how many words there are.
    for row in parts.groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        out[row["word"]] = np.uint64(row["bits"] & (2**64 - 1))
    return Bloom(out, hashes, seed)


class Cascade:
    """Levels over ``universe``; both frames have one column, ``key``."""

    def __init__(self, universe: DataFrame, listed: DataFrame, max_bytes: int = 64 << 20):
        self.levels: list[Bloom] = []
        listed = staged(hashed(listed.select("key").distinct()))
        universe = hashed(universe.select("key"))
        n_listed, n_other = listed.count(), universe.count()
        rate = min(HALF, max(n_listed, 1) * math.sqrt(HALF) / max(n_other, 1))
        inside, outside, size = listed, None, 0
        while n_listed:
            words, hashes = Bloom.shape(n_listed, rate)
            size += 8 * words
            if size > max_bytes:
                raise ValueError(f"the filters need over {max_bytes} bytes")
            self.levels.append(fill(inside, words, hashes, len(self.levels) + 1))
            if outside is None:
                found = universe.filter(self._last("a", "b")).join(listed.select("key"), "key", "left_anti")
            else:
                found = outside.filter(self._last("a", "b"))
            inside, outside, rate = staged(found), inside, HALF
            n_listed = inside.count()

    def _last(self, a: str, b: str) -> Column:
        level = self.levels[-1]

        @F.pandas_udf("boolean")
        def holds(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(level.holds(a.to_numpy(np.int64), b.to_numpy(np.int64)))

        return holds(a, b)

    def holds(self, key: Column) -> Column:
        """Whether ``key`` is listed; false for null."""
        levels = self.levels

        @F.pandas_udf("boolean")
        def listed(a: pd.Series, b: pd.Series) -> pd.Series:
            a, b = a.to_numpy(np.int64), b.to_numpy(np.int64)
            member = np.zeros(len(a), dtype=bool)
            left = np.arange(len(a))
            for number, level in enumerate(levels, 1):
                inside = level.holds(a[left], b[left])
                if number % 2 == 0:
                    member[left[~inside]] = True
                left = left[inside]
            if len(levels) % 2:
                member[left] = True
            return pd.Series(member)

        said = listed(F.xxhash64(key), F.xxhash64(F.lit("second"), key))
        return said & key.isNotNull()


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path

    @property
    def labels(self) -> int:
        return self.host.count(".") + 1


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def keys_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> list[Column]:
    """The keys a url may be listed under, for the shapes that rules have: so many
    last labels of the host and so many first characters of the path."""
    shapes = sorted({(r.labels, len(r.path)) for r in rules})
    labels = F.size(F.split(host, r"\.", -1))
    return [
        F.when(
            (labels >= n) & (F.length(path) >= m),
            F.concat(F.substring_index(host, ".", -n), F.substr(path, F.lit(1), F.lit(m))),
        )
        for n, m in shapes
    ]


def judge(
    pages: DataFrame, rules: tuple[Rule, ...], id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """``id, host, path, rule, verdict`` for every page."""
    spark = importable(pages).sparkSession
    host, path = split_url(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    keys = keys_of(F.col("host"), F.col("path"), rules)
    none = F.lit(None).cast("string")
    universe = staged(
        rows.select(F.explode(F.array(*(keys or [none]))).alias("key"))
        .filter(F.col("key").isNotNull())
        .distinct()
    )
    fits = []
    for action in sorted({r.action for r in rules}):
        own = [(r.key,) for r in rules if r.action == action]
        cascade = Cascade(universe, spark.createDataFrame(own, "key string"))
        fits += [
            F.when(
                cascade.holds(key),
                F.struct(F.length(key).alias("size"), key.alias("rule"), F.lit(action).alias("action")),
            )
            for key in keys
        ]
    unfit = F.lit(None).cast("struct<size int, rule string, action string>")
    best = reduce(lambda a, b: F.when(b["size"] > F.coalesce(a["size"], F.lit(-1)), b).otherwise(a), fits, unfit)
    return rows.withColumn("best", best).select(
        "id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit("allow")).alias("verdict"),
    )
