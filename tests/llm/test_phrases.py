"""Collocations against counting by hand."""

import gc
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyhouse.llm import phrases

DOCS = "doc_id long, text string, lang string, prefix string, next string, found long, phrase string"


@pytest.fixture
def docs(spark):
    def make(*rows):
        return spark.createDataFrame([(i, t, lang, *[None] * 4) for i, (t, lang) in enumerate(rows)], DOCS)

    return make


def by_hand(rows, mining):
    counts, words_of = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang, text = lang or "und", text or ""
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            words_of[lang] += len(words)
            for k in range(1, mining.longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, found in counts.items():
        often = {p: a for p, a in found.items() if len(p) > 1 and a >= mining.least}
        rows_ = []
        for p, a in often.items():
            score, _, left, right = min(
                (mining.scale * a // (found[p[:k]] + found[p[k:]]), k, found[p[:k]], found[p[k:]])
                for k in range(1, len(p))
            )
            inside = [
                b for q, b in often.items()
                if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            ]
            if not any(100 * b >= mining.subsumed * a for b in inside):
                rows_.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows_)[: mining.top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, words_of[lang], -score))
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


def texts():
    draw = np.random.default_rng(3)
    vocabulary = ["the", "The", "of", "new", "york", "état", "été", "x1", "#", "😀"]
    rows = []
    for i in range(300):
        words = draw.choice(vocabulary, size=int(draw.integers(0, 60)), p=[0.25, 0.1, *[0.65 / 8] * 8])
        text = " ".join(words).replace("new york", "New  York").replace("# 😀", "#, 😀")
        rows.append((text, ["en", "fr", None, "und"][i % 4]))
    return [*rows, (None, "en"), ("", None), (" \t\n.,", "fr"), ("a\x1cb c " * 40, "de"), ("z z z z " * 30, "es")]


def test_against_counting(docs):
    rows = texts()
    mining = phrases.Mining(least=5)
    found = got(phrases.collocations(docs(*rows), mining))
    assert found == by_hand(rows, mining) and len(found) > 100


def test_longer_phrases_ties_and_a_full_filter(docs):
    rows = texts()[:150]
    mining = phrases.Mining(longest=6, least=3, subsumed=60, top=25)
    want = by_hand(rows, mining)
    assert got(phrases.collocations(docs(*rows), mining)) == want
    # 65,536 bits at least are used; a filter that says yes to all must change nothing.
    full = np.full(1 << 10, 255, dtype=np.uint8)
    assert phrases.contains(full, np.arange(100, dtype=np.uint64)).all()


def test_small_tasks_and_rows(docs, monkeypatch):
    """Grouping, sending and cutting stripes at any point changes no count."""
    rows = texts()
    the = phrases.run_hashes([np.array([phrases.word_hash(b"the")], dtype=np.uint64)])
    held, shards = phrases.Stripes(2, None, the), set()
    monkeypatch.setattr(phrases, "CHUNK", 50)
    monkeypatch.setattr(phrases, "KEEP", 40)
    monkeypatch.setattr(phrases, "ROW", 3)
    total = Counter()
    batches = [b for text, lang in rows for b in held.add(lang or "und", (text or "").encode())]
    for batch in [*batches, *held.finish()]:
        for lang, prefix, shard, words, times in zip(*(c.to_pylist() for c in batch.columns)):
            assert len(times) <= 3 and (not shard or prefix == "the")
            shards.add(shard)
            for word, n in zip(words.split(" "), times, strict=True):
                total[lang, prefix, word] += n
    want = Counter()
    for text, lang in rows:
        for piece in (text or "").encode().translate(phrases.TO_PIECES).decode().split("\n"):
            words = re.findall("[^ \t]+", piece)
            for a, b in zip(words, [*words[1:], None]):
                want[lang or "und", a, ""] += 1
                if b:
                    want[lang or "und", a, b] += 1
    assert total == want and len(shards) > 3


def test_filter_has_no_false_negatives(spark):
    found = spark.range(5000).selectExpr("concat('w', id, ' état') AS phrase")
    filter_ = phrases.bloom(found, most_bits=1 << 17)
    assert len(filter_) * 8 == 1 << 17
    hashes = phrases.run_hashes(
        [
            np.array([phrases.word_hash(f"w{i}".encode()) for i in range(5000)], dtype=np.uint64),
            np.full(5000, phrases.word_hash("état".encode()), dtype=np.uint64),
        ]
    )
    assert phrases.contains(filter_, hashes).all()
    assert phrases.contains(filter_, hashes + np.uint64(1)).mean() < 0.1


def test_words_are_gone_after_a_task():
    """Without waiting for the garbage collector, which may not run before the next task."""
    gc.collect()
    gc.disable()
    try:
        held = phrases.Stripes(2, None)
        batches = [*held.add("en", b"only here, only here"), *held.finish()]
        del held
        assert batches and not [x for x in gc.get_objects() if type(x) is defaultdict and b"here" in x]
    finally:
        gc.enable()


def test_a_filter_takes_one_worker_per_task(spark, monkeypatch):
    """A second Python function in the same stage would be a second worker, with its own memory."""
    found = spark.range(10).selectExpr("concat('w', id) AS phrase")
    calls, kind = [], type(found)
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, *a, **k: calls.append(df) or plain(df, *a, **k))
    filter_ = phrases.bloom(found)
    assert len(calls) == 1
    assert all(phrases.contains(filter_, np.array([phrases.hash_of_phrase(f"w{i}")]))[0] for i in range(10))


def test_scores_beyond_64_bits(spark):
    candidates = spark.createDataFrame(
        [("en", "a b", "a", 3 * 10**17, ["a", "b"])], "lang string, phrase string, prefix string, a long, words array<string>"
    )
    totals = spark.createDataFrame(
        [("en", "a", 9 * 10**18), ("en", "b", 3 * 10**17 + 1)], "lang string, part string, times long"
    )
    row = phrases.best_cuts(candidates, totals, 2_000_000).first()
    assert row.score == 2_000_000 * 3 * 10**17 // (9 * 10**18 + 3 * 10**17 + 1)


def test_no_rows(docs):
    assert got(phrases.collocations(docs())) == []
    assert got(phrases.collocations(docs((None, None)))) == []
