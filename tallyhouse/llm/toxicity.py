"""Toxicity by compression distance to zstandard dictionaries.

A word is written as two bytes for each of its prefixes, in code points, so that
two words share bytes as far as they begin alike, in any script. The ordinary
dictionary is trained by zstandard on ordinary text. A toxic dictionary is a list
of stems and phrases, selected by how much commoner they are in toxic texts, and
then the same common segments, at the same distance from the text. It is not
trained by zstandard: that keeps what is common, and common words are the same in
toxic texts.

A window is one word, or the words of a phrase of the list, inside a short carrier that all dictionaries hold. The bytes that a toxic dictionary saves
are its evidence. One toxic dictionary has all stems, and its evidence is summed
over the text and divided by a power of its length, as ordinary texts hold some of
these stems by chance. The other has the stems that no ordinary text holds; one
window of them is enough, however long the text. A document's score is that of the
stronger evidence; both thresholds are calibrated on labelled documents that no
dictionary has seen.

Training takes a bounded sample: at most ``most_toxic`` and ``most_ordinary``
labelled documents of at most ``max_chars`` characters, the first by a hash of
the id. Scoring reads every whole text.

Defined results: a null or empty text has no windows and scores 0, as does every
text if one of the labels is missing from the sample. A label that is null or
whose document is missing is not used. Repeated rows are scored each. Other
columns do not matter. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from dataclasses import dataclass, replace
from functools import lru_cache

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.tables import map_rows

LEVEL = 9
#: Bytes of common segments that both dictionaries end with.
COMMON = 16 << 10
#: A stem is this many times commoner among toxic words, with at least this much
#: evidence (likelihood ratio, G) that the share of toxic documents with it is larger.
TIMES, EVIDENCE = 8, 20
#: Code points of a stem, and words of a phrase.
SHORTEST, LONGEST, PHRASE = 3, 32, 3
#: Windows that begin unlike every stem within so many code points save nothing.
ALIKE = 5
#: A text of n words has the evidence of all stems divided by (n + SHORT) ** POWER.
SHORT, POWER = 20, 0.7
CARRIER = 56
MEMO = 400_000
EDGE = b".,;:!?\"'()[]#*$%&|<>"
CUT = 0.7
WRONG = 5
SLOPE = 1.5


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    #: All stems, and those that no ordinary text holds, before the common segments.
    toxic: bytes
    sure: bytes
    phrases: tuple[bytes, ...]
    #: Phrases, and the first code points of all other stems.
    starts: tuple[bytes, ...]
    #: For the evidence of a whole text, and of its best windows.
    dense: float
    best: float


def words_of(text: bytes) -> list[bytes]:
    return [w for word in text.lower().split() if (w := word.strip(EDGE))]


def coded(words: bytes) -> bytes:
    """Two bytes for each prefix."""
    at, out = 0, bytearray()
    for point in words.decode("utf-8", "replace"):
        at = zlib.crc32(point.encode("utf-8", "replace"), at)
        out += (at & 0xFFFF).to_bytes(2, "big")
    return bytes(out)


def common_segments(texts: list[list[bytes]]) -> bytes:
    samples = [
        b"".join(coded(w + b" ") for w in words[i : i + 3])
        for words in texts
        for i in range(0, len(words), 3)
    ]
    try:
        return zstandard.train_dictionary(COMMON, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: they are their own dictionary
        return b"".join(dict.fromkeys(samples))[:COMMON]


def evidence(a: int, b: int, size_a: int, size_b: int) -> float:
    """G of ``a`` of ``size_a`` against ``b`` of ``size_b``; 0 if ``a`` is not more."""
    share = (a + b) / (size_a + size_b)
    if a <= share * size_a:
        return 0.0
    return 2 * (a * math.log(a / (share * size_a)) + (b and b * math.log(b / (share * size_b))))


def runs(texts: list[list[bytes]]) -> list[Counter]:
    """Of each text, the runs of words that begin at each of its words."""
    found = []
    for words in texts:
        points = [w.decode("utf-8", "replace")[:LONGEST] for w in words]
        found.append(
            Counter((" ".join(points[i : i + PHRASE]) + " ")[:LONGEST] for i in range(len(points)))
        )
    return found


def counted(texts: list[Counter], size: int, open_: set[str]) -> tuple[Counter, Counter]:
    """Prefixes of ``size`` that continue those of ``open_``: how often, in how many texts."""
    times, found = Counter(), Counter()
    for text in texts:
        here = Counter()
        for run, n in text.items():
            if len(run) >= size and (size == SHORTEST or run[: size - 1] in open_):
                here[run[:size]] += n
        times.update(here)
        found.update(here.keys())
    return times, found


def toxic_stems(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[tuple[str, bool]]:
    """Beginnings of words and phrases that set toxic documents apart, the strongest first,
    each with whether no ordinary document holds it."""
    sizes = len(toxic), len(ordinary)
    words = sum(map(len, toxic)), sum(map(len, ordinary))
    bad, good = runs(toxic), runs(ordinary)
    open_: set[str] = set()
    apart = []
    for size in range(SHORTEST, LONGEST + 1):
        times, found = counted(bad, size, open_)
        # A longer prefix is in no more texts: the others cannot reach the evidence.
        open_here = {p for p, n in found.items() if evidence(n, 0, *sizes) >= EVIDENCE}
        if not open_here:
            break
        times_good, found_good = counted(good, size, open_)
        for p in open_here:
            rate = times[p] * words[1] / max(words[0] * (times_good[p] + 0.5), 1)
            if rate > TIMES and evidence(found[p], found_good[p], *sizes) >= EVIDENCE:
                strength = evidence(times[p], times_good[p], *words)
                apart.append((-strength, " " in p[:-1], -size, p, not found_good[p]))
        open_ = open_here
    chosen: list[tuple[str, bool]] = []
    begun: set[str] = set()
    taken: set[str] = set()
    for *_, p, sure in sorted(apart):
        if " " in p[:-1] and p[-1] != " ":
            continue  # of a phrase, all words are whole
        # Of stems of which one begins the other, the strongest is taken. A phrase with
        # a word that is like a stronger stem says nothing more.
        starts = [0, *(i + 1 for i, c in enumerate(p[:-1]) if c == " ")]
        if any(p[i:] in begun or any(p[i:k] in taken for k in range(i + SHORTEST, len(p) + 1)) for i in starts):
            continue
        taken.add(p)
        chosen.append((p, sure))
        begun.update(p[:k] for k in range(SHORTEST, len(p) + 1))
    return chosen


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.memo: dict[bytes, tuple[int, int]] = {}
        self.phrases: dict[bytes, list[bytes]] = {}
        for phrase in model.phrases:
            self.phrases.setdefault(phrase.split(b" ")[0], []).append(phrase)
        carrier = model.ordinary[-CARRIER - 8 : -8]
        self.before, self.after = carrier, carrier
        self.compress = [self._compressor(d) for d in (model.ordinary, model.toxic, model.sure)]

    @staticmethod
    def _compressor(content: bytes):
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        plain = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False
        )
        return zstandard.ZstdCompressor(dict_data=known, compression_params=plain).compress

    def saved(self, window: bytes) -> tuple[int, int]:
        """Bytes by which each toxic dictionary is the better one for a window."""
        n = self.memo.get(window)
        if n is None:
            n = 0, 0
            # Others share a few bytes with a stem at most: all else is in every dictionary.
            if (window + b" ").startswith(self.model.starts):
                text = self.before + coded(window + b" ") + self.after
                ordinary, toxic, sure = (len(compress(text)) for compress in self.compress)
                n = ordinary - toxic, ordinary - sure
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[window] = n
        return n

    def window(self, words: list[bytes], i: int) -> bytes:
        """The words from the i-th on if they hold a phrase of its, or it alone."""
        run = b" ".join(words[i : i + PHRASE])
        return run if (run + b" ").startswith(tuple(self.phrases[words[i]])) else words[i]

    def features(self, words: list[bytes]) -> tuple[float, float]:
        """Evidence of all stems over the text, and of its best windows."""
        if not words:
            return -math.inf, -math.inf
        saved = [
            self.saved(self.window(words, i) if word in self.phrases else word)
            for i, word in enumerate(words)
        ]
        best = heapq.nlargest(3, (sure for _, sure in saved))
        dense = sum(all_ for all_, _ in saved if all_ > 0) / (len(words) + SHORT) ** POWER
        return dense, best[0] + sum(best) / len(best) / 10

    def score(self, text: bytes | None) -> float:
        dense, best = self.features(words_of(text or b""))
        if best == -math.inf:
            return 0.0
        over = max(best - self.model.best, (dense / max(self.model.dense, 1e-9) - 1) * 4)
        return squash(SLOPE * over)


def squash(x: float) -> float:
    """The logistic curve, through :data:`CUT` at the threshold."""
    x += math.log(CUT / (1 - CUT))
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def best_threshold(toxic: list[float], ordinary: list[float]) -> float:
    """Middle of the gap at which errors, as shares of both kinds, weigh least; a clean
    document called toxic weighs :data:`WRONG` times a missed one."""
    points = sorted({x for x in (*toxic, *ordinary) if x > -math.inf})
    cuts = [(a + b) / 2 for a, b in zip(points, points[1:])] + [(points[-1] if points else 0) + 1]

    def errors(cut: float) -> float:
        missed = sum(x < cut for x in toxic) / max(len(toxic), 1)
        wrong = sum(x >= cut for x in ordinary) / max(len(ordinary), 1)
        return missed + WRONG * wrong

    if len(cuts) > 512:
        cuts = cuts[:: len(cuts) // 512]
    least = min(map(errors, cuts))
    # All cuts that do as well form the gap; take the one in its middle.
    equal = [c for c in cuts if errors(c) == least]
    return equal[len(equal) // 2]


def fit(toxic: list[bytes], ordinary: list[bytes]) -> Model | None:
    """Two thirds of each list train the dictionaries, the rest the threshold."""
    if not toxic or not ordinary:
        return None
    bad, good = [words_of(t) for t in toxic], [words_of(t) for t in ordinary]
    held = slice(None, None, 3)
    train_bad = [w for i, w in enumerate(bad) if i % 3] or bad
    train_good = [w for i, w in enumerate(good) if i % 3] or good
    common = common_segments(train_good)
    # The strongest stems are the nearest to the text.
    stems = toxic_stems(train_bad, train_good)[::-1]
    every = b"".join(coded(p.encode()) for p, _ in stems)
    sure = b"".join(coded(p.encode()) for p, alone in stems if alone)
    phrases = tuple(p.encode() for p, _ in stems if " " in p[:-1])
    starts = tuple(sorted({(p if " " in p[:-1] else p[:ALIKE]).encode() for p, _ in stems}))
    model = Model(common, every + common, sure + common, phrases, starts, 0.0, 0.0)
    scorer = Scorer(model)
    bad_dense, bad_best = zip(*(scorer.features(w) for w in bad[held]))
    good_dense, good_best = zip(*(scorer.features(w) for w in good[held]))
    return replace(
        model,
        dense=best_threshold(bad_dense, good_dense),
        best=best_threshold(bad_best, good_best),
    )


def sample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str,
    text_col: str,
    label_col: str,
    most_toxic: int,
    most_ordinary: int,
    max_chars: int,
) -> tuple[list[bytes], list[bytes]]:
    order = F.xxhash64(F.col("id"))
    given = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))

    def first(label: int, most: int) -> DataFrame:
        return given.filter(F.col("label") == label).orderBy(order, "id").limit(most)

    # At most most_toxic + most_ordinary rows, so it may be broadcast.
    chosen = first(1, most_toxic).unionAll(first(0, most_ordinary)).distinct()
    text = F.col(text_col).cast("string")
    found = (
        docs.filter(F.length(text) <= max_chars)
        .select(F.col(id_col).alias("id"), text.alias("text"))
        .join(F.broadcast(chosen), "id")
        .select(order.alias("at"), "label", "text")
        .collect()
    )
    found = sorted(set(found))
    return [[r.text.encode() for r in found if r.label == n] for n in (1, 0)]


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    *,
    most_toxic: int = 1500,
    most_ordinary: int = 3000,
    max_chars: int = 100_000,
) -> Model | None:
    return fit(
        *sample(docs, labels, id_col, text_col, label_col, most_toxic, most_ordinary, max_chars)
    )


@lru_cache(maxsize=2)
def scorer(model: Model) -> Scorer:
    """One per Python worker and model, with its memo."""
    return Scorer(model)


def score(
    docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc, score`` for every row."""
    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return rows.select("doc", F.lit(0.0).alias("score"))
    return map_rows(
        rows, f"doc {key}, score double", lambda doc, text: [(doc, scorer(model).score(text))]
    )


def fold(id_: Column) -> Column:
    """crc32 of the id's text, modulo 3."""
    return F.crc32(id_.cast("string").cast("binary")) % 3
