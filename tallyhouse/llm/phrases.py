"""Phrase collocations by stripes: each prefix keys counters of its next words.

Texts are cut into words once and written as numbers, in rows that list their own
distinct words. Levels go from single words to the longest phrases. A task reads these
rows, groups equal runs of words with numpy and sends stripes: a prefix with a map from
next word to count. Merging adds maps element by element; the count under the empty
next word is the prefix's own total. One structure gives what is needed: extensions
are a stripe's entries, the parts of a cut are prefix totals, the words of a
language are the total of the empty prefix, and the greatest entry of a stripe (and
of those that end alike) says whether a longer phrase subsumes a shorter one.

A phrase that is found ``least`` times consists of phrases found as often, so a
level only takes runs whose two shorter ones are in a Bloom filter of the level
before. The filter has a fixed greatest size. Pairs of words, of which most are rare,
are screened first: their hashes are counted, five bytes for each, and a filter of
those found often enough joins the first one. What passes wrongly is counted
exactly and dropped, so full filters cost time and never change a result. Stripes leave a
task in rows of at most ``ROW`` entries and are shuffled whole, by prefix, so that a
prefix is sent once and not with every entry. The stripes of the prefixes that make
up a thousandth of all words or more, of which there are a thousand at most, and that
of the empty prefix are dealt to many shards by their next words. Entries are added
by an aggregation that spills, so no task holds a stripe, however common its prefix.

Scores are integer quotients of decimals of 38 digits. Defined results: null texts
are empty, null languages ``und``; repeated rows count each; an empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.hashing import BASE, mix
from tallyhouse.llm.tables import importable, staged, work_folder

#: Entries of one row of a stripe.
ROW = 4096
#: Shards of a hot prefix's stripe, and of the empty prefix's.
SHARDS, WORD_SHARDS = 64, 4096
#: A prefix is hot that has one in so many of all words.
HOT = 1000
#: Positions of a row of numbered words, and languages that wait for one in a task.
CODED, LANGS = 1 << 16, 16
#: Bytes of a row group of numbered words, which a reader has in memory as a whole.
ROW_GROUP = 1 << 24
#: Positions that a task groups at a time, and groups it keeps before it sends them.
CHUNK, KEEP = 1 << 17, 1 << 20
#: Words of which a task knows the numbers; bounds on memory, not on results.
VOCABULARY = 1 << 19
#: A Bloom filter has at most this many bits, and this many for each phrase.
MOST_BITS, BITS_EACH, PROBES = 1 << 28, 16, 4
#: Runs of so many words are screened by their hashes; longer ones have passed enough.
SCREENED = (2,)
#: Words of the corpus for each range of hashes, which one task adds up.
RANGE_WORDS = 1 << 20
#: Bits of the filter that one task sets.
SEGMENT = 1 << 20

#: A-Z lower-cased; what ends a piece becomes a line end. Fixed values.
TO_PIECES = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9
)


@dataclass(frozen=True)
class Mining:
    """Phrases of 2 to ``longest`` words found ``least`` times; those of which
    ``subsumed`` in a hundred lie in one longer phrase are dropped."""

    longest: int = 4
    least: int = 30
    subsumed: int = 80
    scale: int = 2_000_000
    top: int = 2000


# -- filters ---------------------------------------------------------------


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def run_hashes(words: list[np.ndarray]) -> np.ndarray:
    """Hashes of runs of words from the words' hashes, one array per place."""
    total = np.full(len(words[0]), len(words), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for word in words:
            total = mix(total * np.uint64(BASE) + word)
    return total


def probes(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Places of each hash in a filter whose size is a power of two."""
    step = mix(hashes) | np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(PROBES):
            yield (hashes + np.uint64(i) * step) & np.uint64(bits - 1)


def contains(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), dtype=bool)
    for place in probes(hashes, len(filter_) * 8):
        left = np.flatnonzero(found)
        at = place[left]
        byte = filter_[(at >> np.uint64(3)).astype(np.int64)]
        found[left] = (byte >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def hash_of_phrase(phrase: str) -> np.uint64:
    return run_hashes([np.array([word_hash(w)], dtype=np.uint64) for w in phrase.encode().split(b" ")])[0]


def bloom(phrases: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """A filter of ``phrase``, at most ``most_bits / 8`` bytes whatever their number."""

    def hashed(column: pa.Array) -> np.ndarray:
        return np.array([hash_of_phrase(p) for p in column.to_pylist()], dtype=np.uint64)

    return _bloom(phrases.select("phrase"), hashed, phrases.count(), most_bits)


def bloom_of_hashes(hashes: DataFrame, n: int, most_bits: int = MOST_BITS) -> np.ndarray:
    """A filter of ``n`` values of ``hash``."""
    return _bloom(hashes, lambda column: column.to_numpy(zero_copy_only=False).view(np.uint64), n, most_bits)


def _bloom(
    values: DataFrame, hashed: Callable[[pa.Array], np.ndarray], n: int, most_bits: int
) -> np.ndarray:
    """Bits are set by segments, each in the task its places are sent to.

    Values are hashed and placed by one Python function: two in a row would take two
    workers for each task, and all of them would keep memory beside the next stages.
    """
    bits = 1 << 16
    while bits < min(most_bits, n * BITS_EACH):
        bits *= 2

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(np.concatenate(list(probes(hashed(batch.column(0)), bits))))
            columns = [(place // SEGMENT).astype(np.int64), (place % SEGMENT).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["segment", "place"])

    def set_bits(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        held = np.zeros(min(SEGMENT, bits) // 8, dtype=np.uint8)
        place = table.column("place").to_numpy()
        np.bitwise_or.at(held, place >> 3, np.left_shift(1, place & 7).astype(np.uint8))
        return pa.table({"segment": [key[0].as_py()], "held": pa.array([held.tobytes()], pa.binary())})

    spread = importable(values).mapInArrow(places, "segment long, place int")
    segments = spread.distinct().groupBy("segment").applyInArrow(set_bits, "segment long, held binary")
    out = np.zeros(bits // 8, dtype=np.uint8)
    for segment in segments.toLocalIterator():
        at = segment.segment * (SEGMENT // 8)
        out[at : at + len(segment.held)] = np.frombuffer(segment.held, dtype=np.uint8)
    return out


# -- words -----------------------------------------------------------------


class Words:
    """One task's texts as rows of a language, distinct words and their numbers.

    Number 0 stands for the end of a piece, and a row ends with one, so no run of
    words lies in two rows.
    """

    def __init__(self):
        self.waiting: dict[str, list[bytes]] = defaultdict(list)

    def add(self, lang: str, text: bytes) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
        found = self.waiting[lang]
        for piece in text.translate(TO_PIECES).split(b"\n"):
            words = piece.split()
            if words:
                found += words
                found.append(b"")
                if len(found) >= CODED:
                    yield lang, *coded(found)
                    found.clear()
        if len(self.waiting) > LANGS:
            yield from self.finish()

    def finish(self) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
        for lang, found in self.waiting.items():
            if found:
                yield lang, *coded(found)
        self.waiting.clear()


def numbering() -> defaultdict[bytes, int]:
    """Numbers words in the order they are asked for; what stands between pieces has
    the number 0. It does not refer to itself, so that a worker, which takes task after
    task, is rid of it at once and not when its garbage is next collected."""
    numbers = defaultdict(count().__next__)
    numbers[b""]
    return numbers


def coded(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    numbers = numbering()
    codes = np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))
    return list(numbers), codes


def code_type(names: int) -> type:
    return np.uint16 if names <= 1 << 16 else np.uint32


def words_of(texts: DataFrame, folder: str) -> DataFrame:
    """``lang, names, codes``: numbered words of ``lang, text``, written and reread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Words()
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                for row in cut.add(lang.as_py(), text.as_py()):
                    yield as_row(*row)
        for row in cut.finish():
            yield as_row(*row)

    def as_row(lang: str, names: list[bytes], codes: np.ndarray) -> pa.RecordBatch:
        packed = codes.astype(code_type(len(names))).tobytes()
        columns = [
            pa.array([lang], pa.string()),
            pa.array([b" ".join(names[1:])], pa.binary()),
            pa.array([packed], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, CODES)

    rows = importable(texts).mapInArrow(run, "lang string, names binary, codes binary")
    path = f"{folder}/words"
    rows.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return texts.sparkSession.read.schema(rows.schema).parquet(path)


CODES = ["lang", "names", "codes"]


# -- stripes ---------------------------------------------------------------


class Stripes:
    """Runs of ``size`` words of one task's texts, grouped by language.

    ``hot`` are hashes of the prefixes whose stripes are sharded, ``often`` is a
    filter of the runs themselves. With ``ranges`` nothing but the runs' hashes is
    counted, and leaves by :meth:`screened`.
    """

    def __init__(
        self,
        size: int,
        filter_: np.ndarray | None,
        hot: np.ndarray | None = None,
        often: np.ndarray | None = None,
        ranges: int = 0,
    ):
        self.size, self.filter, self.often, self.ranges = size, filter_, often, ranges
        self.hot = np.empty(0, dtype=np.uint64) if hot is None else hot
        self._forget()

    def _forget(self) -> None:
        self.numbers = numbering()
        self.hashes = np.zeros(1, dtype=np.uint64)
        self.words: dict[str, list[np.ndarray]] = defaultdict(list)
        self.waiting: dict[str, int] = defaultdict(int)
        self.runs: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        self.kept = 0

    def add(self, lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
        """A text that has not been cut before."""
        cut = Words()
        for row in [*cut.add(lang, text), *cut.finish()]:
            yield from self.take(*row)

    def take(self, lang: str, names: list[bytes], numbered: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A row of numbered words; its numbers become the task's own."""
        own = np.fromiter(map(self.numbers.__getitem__, names), np.int32, len(names))
        codes = own[numbered]
        self.words[lang].append(codes)
        self.waiting[lang] += len(codes)
        if self.waiting[lang] >= CHUNK:
            self._group(lang)
            if self.kept >= KEEP:
                self._compact()
            if self.kept >= KEEP or len(self.numbers) >= VOCABULARY:
                yield from self.finish()

    def _hash_new(self) -> None:
        new = list(self.numbers)[len(self.hashes) :]
        if new:
            more = np.fromiter(map(word_hash, new), np.uint64, len(new))
            self.hashes = np.concatenate((self.hashes, more))

    def _group(self, lang: str) -> None:
        """Group the waiting words' runs, and the prefixes' own counts beside them."""
        codes, size = np.concatenate(self.words.pop(lang)), self.size
        self.waiting[lang] = 0
        solid = codes != 0
        if size == 1:
            self._keep(lang, [codes[solid]])
            self._keep(lang, [np.zeros(int(solid.sum()), dtype=np.int32)])
            return
        self._hash_new()
        short = size - 1
        starts = np.flatnonzero(
            np.logical_and.reduce([solid[i : len(codes) - short + 1 + i] for i in range(short)])
        )
        if self.filter is not None:
            hashes = run_hashes([self.hashes[codes[starts + i]] for i in range(short)])
            starts = starts[contains(self.filter, hashes)]
        within = np.zeros(len(codes) + 1, dtype=bool)
        within[starts] = True
        both = starts[within[starts + 1]]
        # A run of ``size`` words: the next shorter run begins one word on, in one piece.
        if self.ranges or self.often is not None:
            hashes = run_hashes([self.hashes[codes[both + i]] for i in range(size)])
            if self.ranges:
                found, counts = np.unique(hashes, return_counts=True)
                self.runs[lang].append((found, counts))
                self.kept += len(found)
                return
            both = both[contains(self.often, hashes & np.uint64(0xFFFFFFFF))]
        # Prefixes are numbered once: for their own counts and for the runs they begin.
        heads = np.stack([codes[starts + i] for i in range(short)], axis=1)
        prefix, first = numbered(heads)
        heads = heads[first]
        alone = np.concatenate((heads, np.zeros((len(heads), 1), dtype=heads.dtype)), axis=1)
        self._add(lang, alone, np.bincount(prefix, minlength=len(heads)))
        prefix, last = prefix[np.searchsorted(starts, both)], codes[both + short]
        run, first = numbered(np.stack((prefix, last), axis=1))
        runs = np.concatenate((heads[prefix[first]], last[first][:, None]), axis=1)
        self._add(lang, runs, np.bincount(run, minlength=len(first)))

    def _keep(self, lang: str, columns: list[np.ndarray]) -> None:
        runs = np.stack(columns, axis=1)
        group, first = numbered(runs)
        self._add(lang, runs[first], np.bincount(group, minlength=len(first)))

    def _add(self, lang: str, runs: np.ndarray, counts: np.ndarray) -> None:
        self.runs[lang].append((runs, counts))
        self.kept += len(runs)

    def _compact(self) -> None:
        self.kept = 0
        for lang, parts in self.runs.items():
            if self.ranges:
                found, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                counts = np.zeros(len(found), dtype=np.int64)
                np.add.at(counts, at, np.concatenate([p[1] for p in parts]))
                self.runs[lang] = [(found, counts)]
                self.kept += len(found)
                continue
            runs, counts = grouped(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            self.runs[lang] = [(runs, counts)]
            self.kept += len(runs)

    def finish(self) -> Iterator[pa.RecordBatch]:
        """Everything as stripes; the task then begins anew."""
        for lang in [k for k, v in self.words.items() if v]:
            self._group(lang)
        self._compact()
        if self.ranges:
            yield from self._screened()
            return
        used = np.zeros(len(self.numbers), dtype=bool)
        for ((runs, _),) in self.runs.values():
            used[runs] = True
        names = np.empty(len(used), dtype=object)
        for i, word in enumerate(self.numbers):
            if used[i]:
                names[i] = word.decode("utf-8")
        self._hash_new()
        for lang, ((runs, counts),) in self.runs.items():
            yield from stripe_rows(lang, runs, counts, self._shards(runs), names)
        self._forget()

    def _screened(self) -> Iterator[pa.RecordBatch]:
        """``lang, part, hashes, counts``: low halves of the hashes of each range, and
        their counts in a byte, which may stop at 255 as that is often enough."""
        for lang, ((found, counts),) in self.runs.items():
            part = (mix(found) % np.uint64(self.ranges)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, found = part[order], found[order].astype(np.uint32)
            counts = np.minimum(counts[order], 255).astype(np.uint8)
            start = np.flatnonzero(np.concatenate((np.ones(min(1, len(part)), bool), part[1:] != part[:-1])))
            for a, b in zip(start.tolist(), [*start[1:].tolist(), len(part)]):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang], pa.string()),
                        pa.array(part[a : a + 1], pa.int64()),
                        pa.array([found[a:b].tobytes()], pa.binary()),
                        pa.array([counts[a:b].tobytes()], pa.binary()),
                    ],
                    SCREEN,
                )
        self._forget()

    def _shards(self, runs: np.ndarray) -> np.ndarray:
        last = mix(self.hashes[runs[:, -1]])
        if self.size == 1:
            return (last % np.uint64(WORD_SHARDS)).astype(np.int32)
        prefixes = run_hashes([self.hashes[runs[:, i]] for i in range(self.size - 1)])
        return np.where(np.isin(prefixes, self.hot), last % np.uint64(SHARDS), 0).astype(np.int32)


def numbered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number from 0 for each row, the same for equal ones, and where each number
    is first found. Values are below 2**31."""
    group = np.zeros(len(rows), dtype=np.int64)
    n = min(1, len(rows))
    for i in range(rows.shape[1]):
        group, distinct = pd.factorize((group << 32) | rows[:, i])
        group, n = group.astype(np.int64), len(distinct)
    first = np.empty(n, dtype=np.int64)
    first[group[::-1]] = np.arange(len(group))[::-1]
    return group, first


def grouped(runs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows once, with the sum of their counts."""
    group, first = numbered(runs)
    total = np.zeros(len(first), dtype=np.int64)
    np.add.at(total, group, counts)
    return runs[first], total


def stripe_rows(
    lang: str, runs: np.ndarray, counts: np.ndarray, shards: np.ndarray, names: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """``lang, prefix, shard, words, times`` rows of at most ``ROW`` entries, prefixes side by side."""
    if not len(runs):
        return
    order = np.lexsort((shards, *runs[:, :-1].T[::-1]))
    runs, counts, shards = runs[order], counts[order], shards[order]
    edge = np.ones(len(runs), dtype=bool)
    edge[1:] = (runs[1:, :-1] != runs[:-1, :-1]).any(axis=1) | (shards[1:] != shards[:-1])
    start = np.flatnonzero(edge)
    # Within a prefix a row ends after ROW entries.
    inside = np.arange(len(runs)) - start[np.cumsum(edge) - 1]
    start = np.flatnonzero(inside % ROW == 0)
    yield from _stripe_batches(lang, runs, counts, shards, names, np.append(start, len(runs)))


def _stripe_batches(lang, runs, counts, shards, names, bounds) -> Iterator[pa.RecordBatch]:
    """Rows between ``bounds``, in batches that hold about ``16 * ROW`` entries."""
    begin = 0
    while begin < len(bounds) - 1:
        end = int(np.searchsorted(bounds, bounds[begin] + 16 * ROW, side="right")) - 1
        end = max(end, begin + 1)
        low, high = bounds[begin], bounds[end]
        heads = runs[bounds[begin:end], :-1]
        prefix = [" ".join(p) for p in names[heads].tolist()]
        edges = bounds[begin : end + 1] - low
        last = names[runs[low:high, -1]].tolist()
        words = [" ".join(last[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        times = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(counts[low:high], pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(prefix), pa.string()),
                pa.array(prefix, pa.string()),
                pa.array(shards[bounds[begin:end]], pa.int32()),
                pa.array(words, pa.string()),
                times,
            ],
            STRIPE,
        )
        begin = end


#: A stripe's next words, joined by spaces, and their counts: a compact map.
STRIPE = ["lang", "prefix", "shard", "words", "times"]


SCREEN = ["lang", "part", "hashes", "counts"]


def of_words(words: DataFrame, schema: str, make) -> DataFrame:
    """What the :class:`Stripes` of each task, made by ``make``, give for its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = make()
        for batch in batches:
            for lang, listed, packed in zip(*batch.columns):
                names = [b"", *listed.as_py().split(b" ")]
                numbered = np.frombuffer(packed.as_buffer(), code_type(len(names)))
                yield from held.take(lang.as_py(), names, numbered)
        yield from held.finish()

    return importable(words).mapInArrow(run, schema)


def stripes(
    words: DataFrame,
    size: int,
    filter_: Broadcast | None,
    hot: np.ndarray | None = None,
    often: Broadcast | None = None,
) -> DataFrame:
    """The tasks' stripes of runs of ``size`` words."""

    def make() -> Stripes:
        return Stripes(size, filter_ and filter_.value, hot, often and often.value)

    return of_words(words, "lang string, prefix string, shard int, words string, times array<int>", make)


def screen(
    words: DataFrame, size: int, filter_: Broadcast, n: int, least: int, most_bits: int
) -> np.ndarray:
    """A filter of the runs whose hashes are found ``least`` times in one language.

    The low halves of the hashes are added up by ranges of hashes, a task's own
    first; runs that share one only pass together.
    """
    ranges = 1 + n // RANGE_WORDS
    parts = of_words(
        words,
        "lang string, part long, hashes binary, counts binary",
        lambda: Stripes(size, filter_.value, ranges=ranges),
    )

    def add_up(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        low = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in table.column("hashes")])
        n = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in table.column("counts")])
        found, at = np.unique(low, return_inverse=True)
        total = np.bincount(at, weights=n, minlength=len(found))
        often = found[total >= min(least, 255)].astype(np.int64)
        return pa.table({"hash": pa.array(often, pa.int64())})

    grouped_ = importable(parts).groupBy("lang", "part").applyInArrow(add_up, "hash long")
    kept = staged(grouped_.distinct())
    return bloom_of_hashes(kept, kept.count(), most_bits)


def merged(parts: DataFrame, least: int) -> DataFrame:
    """Stripes added element by element: ``lang, prefix, next, found``, from ``least`` on."""
    whole = parts.repartition("lang", "prefix", "shard")
    pairs = F.arrays_zip(F.split("words", " ").alias("next"), F.col("times").alias("found"))
    entries = whole.select("lang", "prefix", "shard", F.inline(pairs))
    total = entries.groupBy("lang", "prefix", "shard", "next").agg(F.sum("found").alias("found"))
    return total.filter(F.col("found") >= least).drop("shard")


def hot_prefixes(level: DataFrame, words: int) -> np.ndarray:
    """Hashes of phrases that hold a thousandth of all words: a thousand at most."""
    rows = level.filter((F.col("next") != "") & (F.col("found") * HOT >= words)).select(phrase()).collect()
    return np.array([hash_of_phrase(row[0]) for row in rows], dtype=np.uint64)


# -- phrases ---------------------------------------------------------------


def levels(
    docs: DataFrame, mining: Mining, lang_col: str = "lang", text_col: str = "text", most_bits: int = MOST_BITS
) -> list[DataFrame]:
    """Merged stripes of runs of 1, 2, ... ``longest`` words, each level written."""
    spark, folder = docs.sparkSession, work_folder(docs.sparkSession)
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    words = words_of(texts, folder)
    out: list[DataFrame] = []
    for size in range(1, mining.longest + 1):
        filter_ = hot = often = None
        if out:
            n = out[0].filter("next = ''").agg(F.sum("found")).first()[0] or 0
            hot = hot_prefixes(out[-1], n)
            found = out[-1].filter("next <> ''").select(phrase().alias("phrase")).distinct()
            filter_ = spark.sparkContext.broadcast(bloom(found, most_bits))
            if size in SCREENED:
                passed = screen(words, size, filter_, n, mining.least, most_bits)
                often = spark.sparkContext.broadcast(passed)
        parts = stripes(words, size, filter_, hot, often)
        out.append(staged(merged(parts, mining.least), folder))
        for sent in (filter_, often):
            if sent is not None:
                sent.unpersist()
    return out


def phrase() -> Column:
    return F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))


def collocations(
    docs: DataFrame,
    mining: Mining = Mining(),
    lang_col: str = "lang",
    text_col: str = "text",
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases."""
    found = levels(docs, mining, lang_col, text_col, most_bits)
    words = found[0].filter("prefix = '' AND next = ''").select("lang", F.col("found").alias("n"))
    # Prefix totals are the counts of all shorter phrases.
    totals = reduce(DataFrame.unionByName, [f.filter("next = ''") for f in found[1:]]).select(
        "lang", F.col("prefix").alias("part"), F.col("found").alias("times")
    )
    entries = reduce(DataFrame.unionByName, [f.filter("next <> ''") for f in found[1:]])
    candidates = staged(
        entries.select(
            "lang", phrase().alias("phrase"), "prefix", F.col("found").alias("a"),
            F.split(phrase(), " ").alias("words"),
        )
    )
    scored = best_cuts(candidates, totals, mining.scale)
    longer = subsumption(candidates)
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(
        F.coalesce(_wide(100) * F.col("most") < _wide(mining.subsumed) * F.col("a"), F.lit(True))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long"))
    return (
        ranked.filter(F.col("rank") <= mining.top)
        .join(words, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )


def _wide(number: int) -> Column:
    return F.lit(number).cast("decimal(20,0)")


def subsumption(candidates: DataFrame) -> DataFrame:
    """``lang, phrase, most``: the greatest count of a phrase one word longer.

    That suffices: a phrase between two others is found as often as the longest.
    """
    longer = candidates.filter(F.size("words") > 2)
    without_last = F.col("prefix")
    without_first = F.expr("array_join(slice(words, 2, size(words) - 1), ' ')")
    parts = longer.select("lang", F.explode(F.array(without_last, without_first)).alias("phrase"), "a")
    return parts.groupBy("lang", "phrase").agg(F.max("a").alias("most"))


def best_cuts(candidates: DataFrame, totals: DataFrame, scale: int) -> DataFrame:
    """``lang, phrase, a, l, r, score`` at each candidate's lowest-scoring cut.

    All parts of all cuts look up their totals in one join; a part that a third of
    the phrases begin with is split by AQE, as only narrow rows of the left side
    share it.
    """
    cuts = candidates.select(
        "lang", "phrase", "a", "words", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k")
    )
    parts = cuts.select(
        "lang", "phrase", "a", "k",
        F.explode(
            F.map_from_arrays(
                F.array(F.lit("l"), F.lit("r")),
                F.array(
                    F.expr("array_join(slice(words, 1, k), ' ')"),
                    F.expr("array_join(slice(words, k + 1, size(words) - k), ' ')"),
                ),
            )
        ).alias("side", "part"),
    )
    known = parts.join(totals, ["lang", "part"])
    sides = known.groupBy("lang", "phrase", "k").agg(
        F.first("a").alias("a"),
        F.max(F.when(F.col("side") == "l", F.col("times"))).alias("l"),
        F.max(F.when(F.col("side") == "r", F.col("times"))).alias("r"),
    )
    quotient = F.expr(
        f"(CAST({scale} AS DECIMAL(18,0)) * CAST(a AS DECIMAL(20,0)))"
        " div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"
    )
    scored = sides.withColumn("score", quotient)
    lowest = F.min(F.struct("score", "k", "a", "l", "r")).alias("cut")
    return scored.groupBy("lang", "phrase").agg(lowest).select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score")
