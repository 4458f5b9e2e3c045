"""Token counts by compiled transducers whose chunk maps compose.

Words run through :class:`tallyhouse.llm.bpe.Counter`, a deterministic transducer
whose transitions carry the tokens they add. White space always leads back to its
start, so the map of a chunk from any state it may be entered in is known but for
two words: :class:`Chunk` keeps the text before its first and after its last
white space and the count between. Composing two chunks is associative; texts of
over ``chunk_chars`` are dealt out in chunks, and their maps meet in a tree of
``FAN`` at a time, so no task holds a long text.

Defined results: a null or empty text has no bytes and no tokens. Strings of
special tokens inside a text count as the library takes them by default, one
token each. Repeated rows are counted each. A null id stays null. Other columns
do not matter. An empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import bpe
from tallyhouse.llm.tables import map_rows

#: Chunk maps that meet in one step. A text has under 2**31 characters, so with
#: the default chunk two steps always suffice; more are planned for smaller ones.
FAN = 256
SPACES = " \n\t"


class WordCounts:
    """Counts of words, remembered up to a bound."""

    def __init__(self, path: str):
        self.counter = bpe.counter(path)
        self.special = self.counter.merges.special
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> int:
        total, known = 0, self.known
        for section, token in bpe.sections(text, self.special):
            if token is not None:
                total += 1
                continue
            for word in bpe.words(section):
                n = known.get(word)
                if n is None:
                    if len(known) >= bpe.MEMO:
                        known.clear()
                    n = known[word] = self.counter.count(bpe.as_symbols(word))
                total += n
        return total


@lru_cache(maxsize=2)
def word_counts(path: str) -> WordCounts:
    return WordCounts(path)


class Chunk(NamedTuple):
    """What a chunk does to any state: ``tail`` is None if it holds no white space."""

    head: str
    tokens: int
    tail: str | None


def chunk_map(text: str, count: WordCounts) -> Chunk:
    first = min((i for s in SPACES if (i := text.find(s)) >= 0), default=-1)
    if first < 0:
        return Chunk(text, 0, None)
    last = max(text.rfind(s) for s in SPACES)
    return Chunk(text[:first], count(text[first:last]), text[last + 1 :])


def compose(a: Chunk, b: Chunk, count: WordCounts) -> Chunk:
    if a.tail is None:
        return Chunk(a.head + b.head, b.tokens, b.tail)
    if b.tail is None:
        return Chunk(a.head, a.tokens, a.tail + b.head)
    return Chunk(a.head, a.tokens + count(a.tail + b.head) + b.tokens, b.tail)


def total(chunk: Chunk, count: WordCounts) -> int:
    return count(chunk.head) + chunk.tokens + count(chunk.tail or "")


def count_tokens(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    chunk_chars: int = 1 << 16,
) -> DataFrame:
    """``doc, n_bytes, n_tokens`` for every row; ``path`` is on every node."""
    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    small = F.octet_length("text") <= chunk_chars

    def whole(doc, text: bytes):
        return [(doc, len(text), word_counts(path)(text.decode("utf-8", "replace")))]

    schema = f"doc {key}, n_bytes long, n_tokens long"
    short = map_rows(rows.filter(small), schema, whole)
    return short.unionAll(long_texts(rows.filter(~small), path, schema, chunk_chars))


def long_texts(rows: DataFrame, path: str, schema: str, chunk_chars: int) -> DataFrame:
    start = F.sequence(F.lit(0), F.expr(f"(length(text) - 1) div {chunk_chars}"))
    # Numbered before they are exploded, or every chunk would get its own number.
    numbered = rows.select(
        F.struct(
            F.monotonically_increasing_id().alias("row"),
            "doc",
            F.octet_length("text").cast("long").alias("n_bytes"),
        ).alias("key"),
        "text",
    )
    chunks = numbered.select(
        "key",
        F.posexplode(
            F.transform(start, lambda i: F.substr("text", i * chunk_chars + 1, F.lit(chunk_chars)))
        ).alias("n", "text"),
    ).repartition("key.row", "n")
    key = rows.schema["doc"].dataType.simpleString()
    mapped = f"key struct<row long, doc {key}, n_bytes long>, n int, head string, tokens long, tail string"

    def from_text(at, text: bytes):
        chunk = chunk_map(text.decode("utf-8", "replace"), word_counts(path))
        return [(at["key"], at["n"], *chunk)]

    at = F.struct("key", "n").alias("at")
    maps = map_rows(chunks.select(at, "text"), mapped, from_text)
    most = (2**31 // chunk_chars) + 1
    while most > 1:
        most = -(-most // FAN)
        maps = together(maps, path, mapped)

    def finish(key, _):
        key, chunk = key["key"], Chunk(key["head"], key["tokens"], key["tail"])
        return [(key["doc"], key["n_bytes"], total(chunk, word_counts(path)))]

    last = maps.select(F.struct("key", "head", "tokens", "tail"), F.lit(None).cast("string"))
    return map_rows(last, schema, finish)


def together(maps: DataFrame, path: str, schema: str) -> DataFrame:
    """Neighbouring maps composed, ``FAN`` at a time."""

    def fold(group, _):
        count = word_counts(path)
        parts = [Chunk(c["head"], c["tokens"], c["tail"]) for c in group["chunks"]]
        while len(parts) > 1:
            pairs = zip(parts[::2], parts[1::2])
            odd = parts[-1:] if len(parts) % 2 else []
            parts = [compose(a, b, count) for a, b in pairs] + odd
        return [(group["key"], group["n"], *parts[0])]

    groups = maps.groupBy("key", F.expr(f"n div {FAN}").cast("int").alias("up")).agg(
        F.array_sort(F.collect_list(F.struct("n", "head", "tokens", "tail"))).alias("chunks")
    )
    packed = F.struct("key", F.col("up").alias("n"), "chunks")
    return map_rows(groups.select(packed, F.lit(None).cast("string")), schema, fold)
