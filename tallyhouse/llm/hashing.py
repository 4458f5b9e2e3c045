"""Hashes of words and shingles, computed for many texts at once with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tallyhouse.llm.tables import ASCII_SPACE

#: Bytes that are hashed together; longer texts are cut at white space.
PIECE = 1 << 20
#: An odd number, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[ord(c) for c in ASCII_SPACE]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: What each byte adds to a hash.
TERMS = LOWER.astype(np.uint64) + np.uint64(1)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        factors = np.full(max(n, PIECE + 1), base, dtype=np.uint64)
        factors[0] = 1
        with np.errstate(over="ignore"):
            known = _powers[base] = np.cumprod(factors)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def words_of_piece(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of one run of bytes, A-Z lower-cased."""
    return placed_words(data)[0]


def placed_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes, and where they begin."""
    if not len(data):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    solid = ~SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    with np.errstate(over="ignore"):
        terms = TERMS[data] * powers(BASE, len(data))
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(terms)))
        value = (sums[ends] - sums[starts]) * powers(INVERSE, len(data))[starts]
        return mix(value + (ends - starts).astype(np.uint64) * np.uint64(BASE)), starts


def cuts(data: np.ndarray) -> Iterator[np.ndarray]:
    start = 0
    while len(data) - start > PIECE:
        end = start + PIECE
        while end < len(data) and not SPACE[data[end]]:
            end += 1
        yield data[start:end]
        start = end
    yield data[start:]


def word_hashes(text: bytes | memoryview) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of one text."""
    data = np.frombuffer(text, dtype=np.uint8)
    if len(data) <= PIECE:
        return words_of_piece(data)
    return np.concatenate([words_of_piece(piece) for piece in cuts(data)])


def word_hashes_of(texts: list[bytes]) -> list[np.ndarray]:
    """The same for each of some texts, hashed as one."""
    if len(texts) == 1 or sum(map(len, texts)) + len(texts) > PIECE:
        return [word_hashes(text) for text in texts]
    hashes, starts = placed_words(np.frombuffer(b" ".join(texts), dtype=np.uint8))
    begins = np.cumsum([0, *(len(text) + 1 for text in texts)])
    edges = np.searchsorted(starts, begins).tolist()
    return [hashes[a:b] for a, b in zip(edges, edges[1:])]


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in order; a shorter text is one run."""
    n = min(size, len(words))
    if not n:
        return words
    total = np.full(len(words) - n + 1, n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            total = mix(total * np.uint64(BASE) + words[i : len(words) - n + 1 + i])
    return total


def text_batches(batch: pa.RecordBatch) -> Iterator[tuple[object, bytes]]:
    """Keys and texts as UTF-8; null texts are empty."""
    for key, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
        yield key.as_py(), text.as_py() or b""
