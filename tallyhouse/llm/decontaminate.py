"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of the benchmark's words are counted over the corpus.
2. The TF-IDF matrix of all passages, windows of ``PASSAGE`` words, is sketched
   with a random test matrix, task by task, and the sums give its leading singular
   vectors (Nystrom form of the randomised SVD, one pass). Together with the items'
   own directions they span the latent space. Items of more than ``PASSAGE`` words
   are cut into segments of at most that, each with a direction of its own.
3. Overlapping windows of every document are projected there and compared with
   the segments by cosine. A window is up to twice as long as the items it is for and
   the next one begins a quarter further on, so one window is mostly a copy wherever
   that lies. Stretches of a document, and then windows, are skipped if the text
   around them, as far as step 4 would look, does not hold the words that an item has
   to leak: a bound on the alignment, as projection shrinks a window and bounds no
   cosine.
4. Candidates are aligned: the longest common subsequence of item and the text
   around the window, words weighed by their idf. An item has leaked if ``full``
   of its weight is there in order, or ``share`` and half of its answer, which is
   a column of the benchmark or else the last quarter of the item's words.

The benchmark is a query set: its items are taken in blocks of about ``BLOCK``
segments, and each block sees the whole corpus. A block's vectors are all that is sent to
the tasks; they are bounded by the block, not by the corpus. Items of one text are
searched once, and the segments of a longer item are dealt to several blocks.

Defined results: null or blank texts and items match nothing. Repeated rows are
judged each, and yield one row per document row and item. Null ids are carried.
Other columns do not matter. An empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.hashing import text_batches, word_hashes, word_hashes_of
from tallyhouse.llm.jaccard import as_arrow, as_rows
from tallyhouse.llm.tables import alone, importable, staged

PASSAGE = 64
#: Words of the shortest windows.
SHORTEST = 8
#: Words of a stretch of a document that is looked at before its windows.
SPAN = 512
BLOCK = 256
#: Singular vectors that are kept, and columns of the test matrix.
RANK, COLUMNS = 24, 32
#: Words of a lower idf than this, in over a third of all documents, are stop words
#: of the singular vectors; the search itself uses every word.
STOP = 1.0
COSINE = 0.5
SEED = 20
#: Slots of the table that finds a word's number by its hash.
SLOTS = 1 << 20
#: Words of a document that are looked at in one go.
STRETCH = 1 << 16
#: Bytes of texts that are hashed in one go: calls cost more than a short text's words.
TOGETHER = 1 << 16


@dataclass
class Items:
    """A block of benchmark items and the words they consist of."""

    ids: list
    words: list[np.ndarray]  # numbers of the items' words, in order
    answers: list[np.ndarray]  # the same for their answers
    known: np.ndarray  # hashes of all words, ascending
    parts: list[tuple[int, np.ndarray]]  # the segments of this block, with their items

    def __post_init__(self):
        self.slots = np.full(SLOTS, -1, dtype=np.int32)
        self.more = np.zeros(SLOTS, dtype=bool)
        at = (self.known & np.uint64(SLOTS - 1)).astype(np.int64)
        numbers = np.arange(len(at), dtype=np.int32)
        self.slots[at] = numbers
        self.more[at[self.slots[at] != numbers]] = True
        self.seen = np.zeros(len(at), dtype=np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 for those of no item."""
        at = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        found = self.slots[at].astype(np.int64)
        # Slots that several words share are looked up by hash.
        hit = np.flatnonzero(found >= 0)
        wrong = hit[self.known[found[hit]] != hashes[hit]]
        if len(wrong):
            found[wrong] = -1
            shared = wrong[self.more[at[wrong]]]
            place = np.minimum(np.searchsorted(self.known, hashes[shared]), len(self.known) - 1)
            same = self.known[place] == hashes[shared]
            found[shared[same]] = place[same]
        return found

    def distinct(self, numbers: np.ndarray) -> np.ndarray:
        """Each word of some item once, ascending; words of no item are left out."""
        numbers = numbers[numbers >= 0]
        order = np.arange(len(numbers))
        self.seen[numbers] = order
        once = numbers[self.seen[numbers] == order]
        once.sort()
        return once

    def numbered(self, batch: pa.RecordBatch) -> Iterator[tuple[object, bytes, np.ndarray]]:
        """Keys, texts and the numbers of their words."""
        held, size = [], 0
        for row in text_batches(batch):
            held.append(row)
            size += len(row[1])
            if size >= TOGETHER:
                yield from self._numbered(held)
                held, size = [], 0
        yield from self._numbered(held)

    def _numbered(self, rows: list[tuple[object, bytes]]) -> Iterator[tuple[object, bytes, np.ndarray]]:
        hashed = word_hashes_of([text for _, text in rows])
        if not hashed:
            return
        numbers = self.numbers(np.concatenate(hashed))
        end = 0
        for (key, text), words in zip(rows, hashed):
            start, end = end, end + len(words)
            yield key, text, numbers[start:end]


def items_of(rows: list) -> list[Items]:
    """From rows (id, text, answer); items without words are left out.

    All in one block, but for the segments of a block too many: these follow in
    further blocks, with the items they belong to.
    """
    hashed = [(r[0], word_hashes((r[1] or "").encode()), word_hashes((r[2] or "").encode())) for r in rows]
    hashed = [h for h in hashed if len(h[1])]
    parts = [(i, n) for i, h in enumerate(hashed) for n in range(-(-len(h[1]) // PASSAGE))]
    out = []
    for start in range(0, len(parts), 2 * BLOCK):
        some = parts[start : start + 2 * BLOCK]
        block = [hashed[i] for i in sorted({i for i, _ in some})]
        first = some[0][0]
        known = np.unique(np.concatenate([x for h in block for x in h[1:]]))
        words = [np.searchsorted(known, w) for _, w, _ in block]
        answers = [
            np.searchsorted(known, a) if len(a) else w[-max(1, len(w) // 4) :]
            for (_, _, a), w in zip(block, words)
        ]
        cut = [segments(w) for w in words]
        own = [(i - first, cut[i - first][n]) for i, n in some]
        out.append(Items([h[0] for h in block], words, answers, known, own))
    return out


def frequencies(rows: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """In how many documents each word is, and how many documents there are."""
    size = len(items.known)

    def run(batches) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(size, dtype=np.int64), 0
        for batch in batches:
            for _, _, numbers in items.numbered(batch):
                there = np.zeros(size + 1, dtype=bool)
                there[numbers] = True  # words of no item go to the last place
                counts += there[:-1]
                total += 1
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*found.tolist(), -1]), pa.array([*counts[found].tolist(), total])], ["word", "n"]
        )

    parts = importable(rows).mapInArrow(alone(run), "word long, n long")
    # One row per word of the block.
    summed = {r.word: r.n for r in parts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = summed.pop(-1, 0)
    df = np.zeros(size, dtype=np.int64)
    df[list(summed)] = list(summed.values())
    return df, total


def sketch(rows: DataFrame, items: Items, idf: np.ndarray) -> np.ndarray:
    """The Gram matrix of all passages times the test matrix, summed over tasks."""
    size = len(items.known)

    def run(batches) -> Iterator[pa.RecordBatch]:
        test = test_matrix(size)
        total = np.zeros((size, COLUMNS), dtype=np.float64)
        held: list[np.ndarray] = []
        base = 0

        def add():
            which, word = (np.concatenate(x) for x in zip(*held))
            starts = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
            lengths = np.diff(np.append(starts, len(which)))
            weight = idf[word].astype(np.float32)
            norm = np.sqrt(np.add.reduceat(weight * weight, starts))
            weight /= np.repeat(np.maximum(norm, 1e-9), lengths)
            image = np.add.reduceat(test[word] * weight[:, None], starts, axis=0)
            order = np.argsort(word, kind="stable")
            ordered = word[order]
            runs = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
            back = np.repeat(image, lengths, axis=0)[order] * weight[order][:, None]
            total[ordered[runs]] += np.add.reduceat(back, runs, axis=0)

        n = 0
        telling = np.append(idf >= STOP, False)
        for batch in batches:
            for _, _, numbers in items.numbered(batch):
                at = np.flatnonzero(telling[numbers])
                if not len(at):
                    continue
                held.append((at // PASSAGE + base, numbers[at]))
                base += len(numbers) // PASSAGE + 1
                n += len(at)
                if n >= STRETCH:
                    add()
                    held, n = [], 0
        if held:
            add()
        used = np.flatnonzero(total.any(axis=1))
        for part in np.array_split(used, max(1, len(used) // 1024)):
            if len(part):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), pa.array([r.tobytes() for r in total[part]], pa.binary())],
                    ["word", "row"],
                )

    def add_up(batches) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for word, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row = np.frombuffer(row)
                sums[word] = sums[word] + row if word in sums else row
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([r.tobytes() for r in sums.values()], pa.binary())],
                ["word", "row"],
            )

    parts = importable(rows).mapInArrow(alone(run), "word long, row binary")
    summed = parts.repartition("word").mapInArrow(alone(add_up), "word long, row binary")
    out = np.zeros((size, COLUMNS))
    for r in summed.toLocalIterator():  # one row per word of the block
        out[r.word] = np.frombuffer(r.row)
    return out


def test_matrix(size: int) -> np.ndarray:
    random = np.random.default_rng(SEED)
    return random.standard_normal((size, COLUMNS)).astype(np.float32)


def singular_vectors(image: np.ndarray) -> np.ndarray:
    """Leading right singular vectors of the passages from the sketched Gram matrix."""
    test = test_matrix(len(image)).astype(np.float64)
    shift = 1e-9 * max(np.linalg.norm(image), 1e-30)
    shifted = image + shift * test
    core = test.T @ shifted
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values[-1] * 1e-10 if values[-1] > 0 else np.zeros(len(values), bool)
    if not good.any():
        return np.zeros((len(image), 0))
    factor = shifted @ (vectors[:, good] / np.sqrt(values[good]))
    return np.linalg.svd(factor, full_matrices=False)[0][:, :RANK]


class Space:
    """Latent space of a block, and the search in it.

    Only words of the block's own segments have a place in it, so that its matrices
    are bounded also where an item has very many words.
    """

    def __init__(self, items: Items, idf: np.ndarray, corpus: np.ndarray, share: float, full: float):
        self.items, self.idf, self.share, self.full = items, idf, share, full
        self.owner = np.array([i for i, _ in items.parts])
        words = np.unique(np.concatenate([part for _, part in items.parts]))
        self.place = np.full(len(items.known), -1, dtype=np.int64)
        self.place[words] = np.arange(len(words))
        rows = np.zeros((len(items.parts), len(words)))
        for row, (_, part) in zip(rows, items.parts):
            used = np.unique(part)
            row[self.place[used]] = idf[used]
        basis = np.linalg.qr(np.concatenate((corpus[words], rows.T), axis=1))[0]
        self.basis = basis.astype(np.float32)
        self.vectors = unit(rows @ basis).astype(np.float32)
        self.mass = np.array([idf[w].sum() for w in items.words])
        own = sorted(set(self.owner.tolist()))
        kinds = sorted({kind_of(items.words[i]) for i in own})
        self.kinds = [Kind(self, kind, [i for i in own if kind_of(items.words[i]) == kind]) for kind in kinds]

    def leaks(self, numbers: np.ndarray) -> dict[int, tuple[float, float]]:
        """Item to cosine and share, for one document's words."""
        found: dict[int, tuple[float, float]] = {}
        for kind in self.kinds:
            for a, b, items in kind.may_leak(numbers):
                projected = self._project(numbers[a:b])
                cosines = unit(projected[None, :])[0] @ self.vectors.T
                hits: dict[int, float] = {}
                for segment in np.flatnonzero(cosines >= COSINE):
                    item = int(self.owner[segment])
                    if items[item]:
                        hits[item] = max(hits.get(item, 0.0), float(cosines[segment]))
                for item, cosine in hits.items():
                    if found.get(item, (0, 0))[1] >= self.full:
                        continue
                    length = len(self.items.words[item])
                    share = self._aligned(item, numbers[max(0, a - length) : b + length])
                    if share and share > found.get(item, (0, 0))[1]:
                        found[item] = cosine, share
        return found

    def _project(self, numbers: np.ndarray) -> np.ndarray:
        used = np.unique(numbers[numbers >= 0])
        used = used[self.place[used] >= 0]
        return self.idf[used].astype(np.float32) @ self.basis[self.place[used]]

    def _aligned(self, item: int, near: np.ndarray) -> float | None:
        """The share of the item's weight found in order, if it has leaked."""
        words, answer = self.items.words[item], self.items.answers[item]
        near = near[np.isin(near, words)]
        least = self.share * self.mass[item]
        names, counts = np.unique(words, return_counts=True)
        there = np.bincount(np.searchsorted(names, near), minlength=len(names))
        if (np.minimum(there, counts) * self.idf[names]).sum() < least:
            return None
        share = subsequence(words, near, self.idf[words]) / self.mass[item]
        if share >= self.full:
            return share
        if share < self.share:
            return None
        near = near[np.isin(near, answer)]
        said = subsequence(answer, near, self.idf[answer])
        return share if said >= 0.5 * self.idf[answer].sum() else None


def segments(words: np.ndarray) -> list[np.ndarray]:
    return np.array_split(words, -(-len(words) // PASSAGE))


def kind_of(words: np.ndarray) -> tuple[int, int]:
    """Words of a window for an item, and words around it that are looked at: powers
    of two that are no smaller than the item, the first one up to ``PASSAGE``."""
    size = 1 << (len(words) - 1).bit_length()
    return min(PASSAGE, max(SHORTEST, size)), size


class Kind:
    """The items of one kind, and where the text may hold them."""

    def __init__(self, space: Space, kind: tuple[int, int], items: list[int]):
        self.window, self.reach = kind
        self.share, self.n_items = space.share, len(space.items.ids)
        self.distinct = space.items.distinct
        self.items = np.array(items)
        # Parts of an item's weight: all its places of a word, one column per item.
        self.whole = np.zeros((len(space.idf), len(items)), dtype=np.float32)
        for column, i in enumerate(items):
            names, counts = np.unique(space.items.words[i], return_counts=True)
            self.whole[names, column] = space.idf[names] / max(space.mass[i], 1e-9) * counts

    def _enough(self, near: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Of the items in ``columns``, those whose words may leak from ``near``."""
        near = self.distinct(near)
        held = self.whole[near] if len(columns) == len(self.items) else self.whole[near[:, None], columns]
        held = held.sum(axis=0)
        return columns[held >= self.share - 1e-4]

    def may_leak(self, numbers: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Begin and end of windows, with a mask of the items that may be around them."""
        step, all_ = max(1, self.window // 4), np.arange(len(self.items))
        for span in range(0, len(numbers), SPAN):
            last = min(span + SPAN, len(numbers))
            near = numbers[max(0, span - self.reach) : last + self.window + self.reach]
            columns = self._enough(near, all_)
            if not len(columns):
                continue
            for a in range(span, last, step):
                b = min(a + self.window, len(numbers))
                fit = self._enough(numbers[max(0, a - self.reach) : b + self.reach], columns)
                if len(fit):
                    mask = np.zeros(self.n_items, dtype=bool)
                    mask[self.items[fit]] = True
                    yield a, b, mask


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def subsequence(words: np.ndarray, near: np.ndarray, weight: np.ndarray) -> float:
    """Weight of the heaviest common subsequence."""
    best = np.zeros(len(words) + 1)
    for word in near:
        taken = best[:-1] + np.where(words == word, weight, -np.inf)
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], taken))
    return float(best[-1])


def search(rows: DataFrame, key: str, space: Space, block: int) -> DataFrame:
    """``doc, item, cosine, share``, with the block and a print of the text."""
    schema = f"doc {key}, item long, cosine double, share double, print long, block int"
    out = as_arrow(schema)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc, text, numbers in space.items.numbered(batch):
                hits = space.leaks(numbers)
                print_ = xxhash.xxh64_intdigest(text) - (1 << 63) if hits else 0
                for number, (cosine, share) in hits.items():
                    found.append((doc, space.items.ids[number], cosine, share, print_, block))
            if found:
                yield as_rows(found, out)

    return importable(rows).mapInArrow(alone(run), schema)


def once_per_row(hits: DataFrame) -> DataFrame:
    """An item whose segments are in several blocks is one hit of a document row.

    Equal rows are found equally often by each block that finds them; they stay as
    many as they are.
    """
    of_block = hits.groupBy("doc", "item", "print", "block").agg(
        F.count(F.lit(1)).alias("n"), F.max("cosine").alias("cosine"), F.max("share").alias("share")
    )
    best = of_block.groupBy("doc", "item", "print").agg(
        F.max("n").alias("n"), F.max("cosine").alias("cosine"), F.max("share").alias("share")
    )
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    answer_col: str | None = None,
    *,
    share: float = 0.6,
    full: float = 0.8,
) -> DataFrame:
    """``doc, item, cosine, share``: one row per document row and leaked item."""
    key, item = (d.schema[c].dataType.simpleString() for d, c in ((docs, id_col), (benchmark, item_col)))
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    given = benchmark.select(
        F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text"), answer.alias("answer")
    )
    # Items of one text and answer are searched once, under a number.
    texts = given.select("text", "answer").distinct().withColumn("number", F.monotonically_increasing_id())
    texts = staged(texts)
    same = given["text"].eqNullSafe(texts["text"]) & given["answer"].eqNullSafe(texts["answer"])
    named = staged(given.join(texts, same).select("item", "number"))
    words = F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+"))
    n = texts.agg(F.sum(F.ceil(words / PASSAGE))).first()[0] or 0
    blocks = -(-n // BLOCK)
    place = F.pmod(F.xxhash64("number"), F.lit(max(blocks, 1)))
    found, long_items = [], False
    for block in range(blocks):
        part = [tuple(r) for r in texts.filter(place == block).select("number", "text", "answer").collect()]
        groups = items_of(part)
        long_items = long_items or len(groups) > 1
        for items in groups:
            df, total = frequencies(rows, items)
            idf = np.log((1 + total) / (1 + df)) + 0.01
            corpus = singular_vectors(sketch(rows, items, idf))
            found.append(search(rows, key, Space(items, idf, corpus, share, full), len(found)))
    if not found:
        schema = f"doc {key}, item {item}, cosine double, share double"
        return docs.sparkSession.createDataFrame([], schema)
    hits = reduce(DataFrame.unionAll, found)
    if long_items:
        hits = once_per_row(hits)
    return hits.withColumnRenamed("item", "number").join(named, "number").select("doc", "item", "cosine", "share")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` into which no item has leaked, with all their columns."""
    ids = staged(leaks(docs, benchmark, id_col, **options).select(F.col("doc").alias("leaked")).distinct())
    return docs.join(ids, docs[id_col].eqNullSafe(ids["leaked"]), "left_anti")
