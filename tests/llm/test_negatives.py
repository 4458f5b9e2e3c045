"""Hard negatives against sorting all products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import negatives

ROWS = "vec_id long, label int, embedding array<float>, id long, row long, vector string, list long, score long"


@pytest.fixture
def vectors(spark):
    def make(rows):
        return spark.createDataFrame([(*r, *[None] * 5) for r in rows], ROWS)

    return make


def usable(rows):
    for number, (id_, label, vector) in enumerate(rows):
        if id_ is None or label is None or vector is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        yield number, id_, label, [math.floor(256 * float(np.float32(x))) for x in vector]


def by_hand(rows, every, mining=negatives.Mining()):
    kept = list(usable(rows))
    out = []
    for number, id_, label, vector in kept:
        if id_ % every:
            continue
        ranked = sorted(
            (-sum(a * b for a, b in zip(vector, v)), i, n, other) for n, i, other, v in kept if n != number
        )
        for score, positive, *_ in [r for r in ranked if r[3] == label][: mining.positives]:
            fits = [r for r in ranked if r[3] != label and -mining.low * score <= -100 * r[0] <= -mining.high * score]
            for rank, (negative_score, negative, *_) in enumerate(fits[: mining.negatives], 1):
                out.append((id_, positive, rank, negative, -score, -negative_score))
    return sorted(out)


def got(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, df.collect()))


def mine(df, every=10, **given):
    return negatives.mine(df, F.col("label"), F.col("id") % every == 0, **given)


def random_rows(n, width=9, labels=3, seed=1):
    draw = np.random.default_rng(seed)
    return [(i, int(draw.integers(labels)), draw.normal(size=width).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (33, 64, 65), (100, 130, 70), (64, 1, 64), (0, 4, 3)])
def test_strassen(shape):
    draw = np.random.default_rng(0)
    a = draw.integers(-(2**62), 2**62, size=shape[:2])
    b = draw.integers(-(2**62), 2**62, size=shape[1:])
    assert (negatives.strassen(a, b, leaf=4) == a @ b).all()


def test_scores_at_the_edge_of_64_bits():
    a = np.array([[2**62, -(2**62)]])
    assert negatives.scores(a, np.array([[1, 0], [1, 1]])).tolist() == [[2**62, 0]]
    with pytest.raises(OverflowError):
        negatives.scores(a, np.array([[2, -2]]))


def test_against_sorting(vectors):
    rows = random_rows(120)
    want = by_hand(rows, 10)
    assert got(mine(vectors(rows))) == want and len(want) > 50


def test_blocks_and_tiles(vectors, monkeypatch):
    rows = random_rows(90, width=70)
    assert got(mine(vectors(rows).repartition(7), every=3, block_rows=4)) == by_hand(rows, 3)


def test_ties_repeats_and_hot_groups(vectors):
    """A third of all rows are one vector; ids repeat with the same and other vectors."""
    hot = [(i, i % 2, [1.0, 0.5]) for i in range(40)]
    rows = [*hot, *random_rows(40, width=2), (10, 0, [1.0, 0.5]), (10, 1, [0.25, 0.25]), (10, 1, [0.25, 0.25])]
    assert got(mine(vectors(rows))) == by_hand(rows, 10)


def test_nulls_lengths_and_no_numbers(vectors):
    rows = [
        (0, 1, [1.0, 2.0]), (1, 1, [1.0]), (2, 1, []), (3, 2, [0.5, 0.5, 9.0]), (4, 2, None), (5, None, [1.0, 1.0]),
        (None, 2, [1.0, 1.0]), (6, 2, [float("nan"), 1.0]), (7, 2, [float("inf"), 1.0]), (8, 2, [None, 1.0]),
        (10, 3, [-1.0, -1.0]), (20, 3, [-0.001, 0.3]), (30, 9, [5.0]), (40, 2, [0.3, 0.3]),
    ]
    assert got(mine(vectors(rows))) == by_hand(rows, 10)


def test_negative_scores_have_reversed_windows(vectors):
    """The window of a negative positive-score is empty: 30 p <= 100 n <= 90 p has no n."""
    rows = [(0, 1, [1.0]), (1, 1, [-2.0]), (2, 2, [-1.0]), (3, 2, [1.0])]
    assert got(mine(vectors(rows))) == by_hand(rows, 10) == []


def test_no_rows_and_no_anchors(vectors):
    assert got(mine(vectors([]))) == []
    assert got(mine(vectors(random_rows(9)[1:]))) == []
    assert got(mine(vectors([(0, 1, [1.0])]))) == []
