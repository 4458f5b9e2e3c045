"""Jaccard join of documents on word n-grams by T-occurrence search.

1. Shingle sets are hashed, chunk by chunk of documents, and dealt out by hash
   range. Each range counts the documents of its shingles and sends back to the
   chunks those found more than once: only these can be shared, so with the size
   of a set they are all that its overlaps need. A shingle that many documents of
   a chunk have travels once per chunk, whatever its documents.
2. A document that could reach the required overlap is a candidate. Equal sets
   are one class. Classes that share one of their rarest shingles, as many as
   prefix filtering asks for, fall into one neighbourhood.
3. Within a neighbourhood, inverted lists answer T-occurrence queries with
   DivideSkip: the short lists of a query are heap-merged, and documents found
   often enough there are looked up in the long ones by binary search, all of them in
   one list at a time, while they can still reach the threshold. A class is
   only asked about classes that it is not yet connected with.
4. Neighbourhoods of over ``most`` classes are cut into blocks, and pairs of
   blocks are tasks of their own. Before that all classes are compared with the
   most typical one; those linked with it need not be compared among themselves.

Nothing is sampled, capped or left out: two documents link exactly if
``100 * shared >= percent * union`` of their sets.

Defined results: a null or blank text has an empty set, links with nothing and is
its own component. Fewer than ``size`` words are one shingle. Rows that share an
id are nodes of their own; a component's id is its least non-null id. Other
columns do not matter. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyhouse.llm.components import stars
from tallyhouse.llm.hashing import shingles, text_batches, word_hashes
from tallyhouse.llm.tables import alone, importable, staged

#: Shingles a chunk of documents and a range of hashes hold, about.
CHUNK, RANGE = 1 << 20, 1 << 20
#: Documents of a chunk at most: their places in it take 16 bits.
CHUNK_DOCS = 1 << 14
#: A shingle in so many documents of a chunk is kept with the chunk.
OFTEN = 16
#: Short lists of fewer elements than this go through the heap.
HEAP = 4096
LOW48 = np.uint64((1 << 48) - 1)

HEADER, FOUND, FOUND_OFTEN = 0, 1, 2


def routed_schema(key: str) -> str:
    return (
        "chunk long, r int, kind int, tokens binary, at binary, n binary,"
        f" ids array<{key}>, sizes binary, prints binary"
    )


def as_arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def route(rows: DataFrame, key: str, ranges: int, size: int) -> DataFrame:
    """Chunks of documents: a header each, and their shingles by hash range."""
    schema = routed_schema(key)
    out = as_arrow(schema)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(columns, out)], schema=out
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId() << 32, 0
        docs: list[tuple] = []
        held = 0
        for batch in batches:
            for doc, text in text_batches(batch):
                tokens = np.unique(shingles(word_hashes(text), size))
                docs.append((doc, tokens))
                held += len(tokens)
                if held >= CHUNK or len(docs) >= CHUNK_DOCS:
                    # The list is emptied there.
                    yield from flush(docs, part + number)
                    held, number = 0, number + 1
        if docs:
            yield from flush(docs, part + number)

    def flush(docs: list[tuple], chunk: int) -> Iterator[pa.RecordBatch]:
        prints = [
            hashlib.blake2b(t.tobytes(), digest_size=16).digest() if len(t) else b"\0" * 16
            for _, t in docs
        ]
        first: dict[bytes, int] = {}
        for i, p in enumerate(prints):
            first.setdefault(p, i)
        mine = [(i, t) for i, (_, t) in enumerate(docs) if first[prints[i]] == i]
        # A chunk's arrays are much of a worker's memory: none stays longer than it is used.
        names = np.concatenate([t for _, t in mine])
        at = np.repeat(
            np.array([i for i, _ in mine], dtype=np.uint16), [len(t) for _, t in mine]
        )
        sizes = np.array([len(t) for _, t in docs], dtype=np.uint32)
        ids = [d for d, _ in docs]
        docs.clear(), mine.clear()
        r = names >> np.uint64(48)
        r *= np.uint64(ranges)
        r >>= np.uint64(16)
        r <<= np.uint64(48)
        names &= LOW48
        names |= r
        del r
        order = np.argsort(names, kind="stable")
        names, at = names[order], at[order]
        del order
        starts = run_starts(names)
        counts = np.diff(np.append(starts, len(names)))
        often = counts >= OFTEN
        kept = np.repeat(often, counts)
        starts, counts = starts[often], counts[often].astype(np.uint32)
        many = [names[starts], counts]
        rows = [
            (
                chunk,
                chunk % ranges,
                HEADER,
                many[0].tobytes(),
                at[kept].tobytes(),
                counts.tobytes(),
                ids,
                sizes.tobytes(),
                b"".join(prints),
            )
        ]
        yield batch_of(rows)
        rows = []
        rare = [names[~kept], at[~kept]]
        del names, at, kept
        edges = np.arange(ranges, dtype=np.uint64) << np.uint64(48)
        bounds = [np.append(np.searchsorted(x[0], edges), len(x[0])).tolist() for x in (rare, many)]
        for value in range(ranges):
            a, b = bounds[0][value : value + 2]
            if a < b:
                low = packed(rare[0][a:b])
                rows.append((chunk, value, FOUND, low, rare[1][a:b].tobytes(), None, None, None, None))
            a, b = bounds[1][value : value + 2]
            if a < b:
                low = packed(many[0][a:b])
                rows.append((chunk, value, FOUND_OFTEN, low, None, many[1][a:b].tobytes(), None, None, None))
        del rare
        if rows:
            yield batch_of(rows)

    return importable(rows).mapInArrow(alone(run), schema)


def run_starts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(ordered):
        return np.empty(0, dtype=np.int64)
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))


def packed(names: np.ndarray) -> bytes:
    """The low 48 bits of each; the rest is the range."""
    return np.ascontiguousarray(names.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked(data: bytes, r: int) -> np.ndarray:
    low = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    names = np.zeros((len(low), 8), dtype=np.uint8)
    names[:, :6] = low
    return names.reshape(-1).view(np.uint64) | np.uint64(r << 48)


def groups(batches, column: str) -> Iterator[list[dict]]:
    """Consecutive rows that agree in ``column``."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and rows[-1][column] != row[column]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def counted(routed: DataFrame, key: str) -> DataFrame:
    """Headers, and of each range back to the chunks what more than one set has."""
    schema = routed_schema(key)
    out = as_arrow(schema)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for rows in groups(headers_first(batches), "r"):
            parts = [(row, unpacked(row["tokens"], row["r"])) for row in rows]
            names = np.concatenate([n for _, n in parts])
            weights = np.concatenate(
                [
                    np.ones(len(n), dtype=np.int64)
                    if row["kind"] == FOUND
                    else np.frombuffer(row["n"], dtype=np.uint32).astype(np.int64)
                    for row, n in parts
                ]
            )
            order = np.argsort(names, kind="stable")
            ordered = names[order]
            starts = run_starts(ordered)
            total = np.add.reduceat(weights[order], starts)
            df = np.empty(len(names), dtype=np.int64)
            df[order] = np.repeat(total, np.diff(np.append(starts, len(names))))
            place, back = 0, []
            for row, own in parts:
                n = df[place : place + len(own)]
                place += len(own)
                more = n > 1
                if not more.any():
                    continue
                at = np.frombuffer(row["at"], dtype=np.uint16)[more].tobytes() if row["at"] else None
                counts = np.minimum(n[more], 2**32 - 1).astype(np.uint32).tobytes()
                back.append((row["chunk"], row["r"], row["kind"], own[more].tobytes(), at, counts, None, None, None))
                if len(back) >= 256:
                    yield as_rows(back, out)
                    back = []
            if back:
                yield as_rows(back, out)

    def headers_first(batches):
        # Headers only pass through on their way to their chunk.
        for batch in batches:
            kinds = batch.column(2).to_numpy(zero_copy_only=False)
            if (kinds == HEADER).any():
                passing.append(batch.filter(pa.array(kinds == HEADER)))
            rest = batch.filter(pa.array(kinds != HEADER))
            if rest.num_rows:
                yield rest

    passing: list[pa.RecordBatch] = []

    def both(batches) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            while passing:
                yield passing.pop()
            yield batch
        while passing:
            yield passing.pop()

    return importable(routed).mapInArrow(alone(both), schema)


def as_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def required(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any that it links with."""
    return -(-percent * n // 100)


def sets(found: DataFrame, key: str, percent: int) -> DataFrame:
    """One row per document: ``doc, n, print`` and, for candidates, ``tokens``
    (shared shingles, rarest first), ``rare`` (those of the prefix) and ``typical``
    (mean number of documents of its shingles)."""
    schema = (
        f"doc {key}, n long, print binary, tokens binary, rare array<long>, typical double"
    )
    out = as_arrow(schema)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, "chunk"):
            head = next(row for row in rows if row["kind"] == HEADER)
            sizes = np.frombuffer(head["sizes"], dtype=np.uint32)
            often = np.frombuffer(head["tokens"], dtype=np.uint64)
            spans = np.frombuffer(head["n"], dtype=np.uint32).astype(np.int64)
            ends = np.cumsum(spans)
            posts = np.frombuffer(head["at"], dtype=np.uint16)
            names, docs, dfs = [], [], []
            for row in rows:
                if row["kind"] == HEADER:
                    continue
                own = np.frombuffer(row["tokens"], dtype=np.uint64)
                df = np.frombuffer(row["n"], dtype=np.uint32)
                if row["kind"] == FOUND:
                    names.append(own), dfs.append(df)
                    docs.append(np.frombuffer(row["at"], dtype=np.uint16))
                else:
                    which = np.searchsorted(often, own)
                    names.append(np.repeat(own, spans[which])), dfs.append(np.repeat(df, spans[which]))
                    docs.append(np.concatenate([posts[ends[w] - spans[w] : ends[w]] for w in which]))
            name = np.concatenate(names) if names else np.empty(0, np.uint64)
            doc = np.concatenate(docs) if docs else np.empty(0, np.uint16)
            df = np.concatenate(dfs) if dfs else np.empty(0, np.uint32)
            order = np.lexsort((name, df, doc))
            name, doc, df = name[order], doc[order], df[order]
            bounds = np.searchsorted(doc, np.arange(len(sizes) + 1))
            result = []
            for i, (id_, n) in enumerate(zip(head["ids"], sizes.tolist())):
                a, b = bounds[i], bounds[i + 1]
                print_ = head["prints"][16 * i : 16 * i + 16] if n else None
                if n and b - a >= required(n, percent):
                    prefix = n - required(n, percent) + 1 - (n - (b - a))
                    own = name[a:b]
                    rare = own[:prefix].view(np.int64).tolist()
                    result.append((id_, n, print_, own.tobytes(), rare, float(df[a:b].mean())))
                else:
                    result.append((id_, n, print_, None, None, None))
                if len(result) >= 1024:
                    yield as_rows(result, out)
                    result = []
            if result:
                yield as_rows(result, out)

    return importable(found).mapInArrow(alone(run), schema)


class Inverted:
    """T-occurrence queries over the sets of one task."""

    def __init__(self, sizes: list[int], sets_: list[np.ndarray], percent: int):
        self.sizes, self.sets, self.percent = np.array(sizes), sets_, percent
        lengths = [len(s) for s in sets_]
        tokens = np.concatenate(sets_) if sets_ else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets_)), lengths)
        order = np.argsort(tokens, kind="stable")
        names, self.posts = tokens[order], owner[order]
        starts = run_starts(names)
        self.starts = np.append(starts, len(names))
        self.places = np.empty(len(tokens), dtype=np.int64)
        self.places[order] = np.repeat(np.arange(len(starts)), np.diff(self.starts))
        self.bounds = np.concatenate(([0], np.cumsum(lengths)))

    def linked(self, q: int, wanted: np.ndarray) -> list[int]:
        """Members of the mask ``wanted`` that link with set ``q``."""
        n, percent = int(self.sizes[q]), self.percent
        fits = wanted & (100 * self.sizes >= percent * n) & (percent * self.sizes <= 100 * n)
        if not fits.any():
            return []
        own = self.places[self.bounds[q] : self.bounds[q + 1]]
        lists = [self.posts[self.starts[p] : self.starts[p + 1]] for p in own]
        lists = sorted((l for x in lists if len(l := x[fits[x]])), key=len)
        # Sizes are within the bounds, so any link shares at least this many.
        least = required(n, percent)
        if len(lists) < least:
            return []
        longest = len(lists[-1])
        long_ = min(least - 1, int(least / (0.01 * np.log2(longest + 1) + 1)))
        short, long_lists = lists[: len(lists) - long_], lists[len(lists) - long_ :]
        found, shared = merged(short, len(self.sizes))
        for missing in range(len(long_lists) + 1):
            # Those that the remaining long lists cannot bring to the threshold are out.
            left = shared + (len(long_lists) - missing) >= least
            if not left.all():
                found, shared = found[left], shared[left]
            if not len(found) or missing == len(long_lists):
                break
            l = long_lists[missing]
            at = np.searchsorted(l, found)
            at[at == len(l)] = 0
            shared = shared + (l[at] == found)
        union = n + self.sizes[found] - shared
        return found[100 * shared >= percent * union].tolist()


def merged(lists: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of sorted lists and the number of lists each is in."""
    if sum(map(len, lists)) >= HEAP:  # a heap of so much would only be slower
        counts = np.bincount(np.concatenate(lists), minlength=most)
        found = np.flatnonzero(counts)
        return found, counts[found]
    found, counts = [], []
    for x in heapq.merge(*(l.tolist() for l in lists)):
        if found and x == found[-1]:
            counts[-1] += 1
        else:
            found.append(x)
            counts.append(1)
    return np.array(found, dtype=np.int64), np.array(counts, dtype=np.int64)


def unions(rows: list[dict], percent: int) -> list[tuple[bytes, bytes]]:
    """Links that connect what is connected among ``rows``, as a star per group.

    ``side`` null: compare all. Otherwise rows of side 0 are compared among
    themselves or, if there are rows of side 1, only with those, which are known
    to be connected with one another.
    """
    rows = sorted(rows, key=lambda r: -r["typical"])
    index = Inverted(
        [r["n"] for r in rows], [np.frombuffer(r["tokens"], dtype=np.uint64) for r in rows], percent
    )
    known = np.array([r["side"] == 1 for r in rows])
    root = np.arange(len(rows))
    if known.any():
        root[known] = np.flatnonzero(known)[0]
    later = np.ones(len(rows), dtype=bool)
    links = []
    for q in range(len(rows)):
        later[q] = False
        if known.any():
            if known[q]:
                continue
            wanted = known & (root != root[q])
        else:
            wanted = later & (root != root[q])
        if not wanted.any():
            continue
        for c in index.linked(q, wanted):
            if root[c] != root[q]:
                links.append((rows[q]["print"], rows[c]["print"]))
                root[root == root[c]] = root[q]
    return links


def search(tasks: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` found by each task, the rows that share a ``task``."""
    out = as_arrow("a binary, b binary")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, "task"):
            links = unions(rows, percent)
            if links:
                yield as_rows(links, out)

    dealt = tasks.select("task", "print", "n", "tokens", "typical", "side")
    dealt = dealt.repartition("task").sortWithinPartitions("task")
    return importable(dealt).mapInArrow(alone(run), "a binary, b binary")


def with_typical(rows: DataFrame, percent: int) -> DataFrame:
    """``print, hub, linked`` for rows with ``hub_n, hub_tokens``."""
    out = as_arrow("print binary, hub binary, linked boolean")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            result = []
            for r in batch.to_pylist():
                a = np.frombuffer(r["tokens"], dtype=np.uint64)
                b = np.frombuffer(r["hub_tokens"], dtype=np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                union = r["n"] + r["hub_n"] - shared
                result.append((r["print"], r["hub"], 100 * shared >= percent * union))
            if result:
                yield as_rows(result, out)

    return importable(rows).mapInArrow(alone(run), "print binary, hub binary, linked boolean")


def classes(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """The rows of :func:`sets`, written to the shared folder."""
    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    # Words are at least two bytes with their space: a bound on the shingles.
    length = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(1 << 16, max(16, length // (6 * RANGE)))
    routed = route(rows, key, int(ranges), size)
    dealt = routed.repartition(int(ranges), "r").sortWithinPartitions("r")
    back = counted(dealt, key).repartition("chunk").sortWithinPartitions("chunk", "kind")
    return staged(sets(back, key, percent))


def links(found: DataFrame, percent: int, most: int) -> DataFrame:
    """Links between classes that connect all that are connected: ``a, b``."""
    candidates = found.filter(F.col("tokens").isNotNull())
    # Equal sets have equal rows but for the id.
    nodes = staged(
        candidates.groupBy("print").agg(
            F.first("n").alias("n"),
            F.first("tokens").alias("tokens"),
            F.first("rare").alias("rare"),
            F.first("typical").alias("typical"),
        )
    )
    entries = nodes.select("print", F.explode("rare").alias("token"))
    heads = (
        entries.groupBy("token")
        .agg(F.min("print").alias("head"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )
    near = entries.join(heads, "token").select(F.col("print").alias("a"), F.col("head").alias("b"))
    around = stars(near)
    roots = around.select(F.col("root").alias("print"), "root").distinct()
    member = around.select(F.col("node").alias("print"), "root").unionAll(roots)
    sizes = member.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    placed = nodes.drop("rare").join(member, "print").join(sizes, "root")
    small = placed.filter(F.col("members") <= most).select(
        "*", F.col("root").alias("task"), F.lit(None).cast("int").alias("side")
    )
    return search(small, percent).unionAll(
        blocks(staged(placed.filter(F.col("members") > most)), percent, most)
    )


def blocks(large: DataFrame, percent: int, most: int) -> DataFrame:
    """Links within neighbourhoods that are too large for one task."""
    hubs = large.groupBy("root").agg(
        F.max_by(F.struct("print", "n", "tokens"), F.struct("typical", "print")).alias("hub")
    )
    compared = staged(
        with_typical(
            large.join(hubs, "root").select(
                "print",
                "n",
                "tokens",
                F.col("hub.print").alias("hub"),
                F.col("hub.n").alias("hub_n"),
                F.col("hub.tokens").alias("hub_tokens"),
            ),
            percent,
        )
    )
    sided = large.join(
        compared.select("print", F.when(F.col("linked"), 1).otherwise(0).alias("side")), "print"
    )
    many = sided.groupBy("root").agg(
        F.ceil(F.sum(1 - F.col("side")) / most).cast("int").alias("open_blocks"),
        F.ceil(F.sum("side") / most).cast("int").alias("done_blocks"),
    )
    numbered = sided.join(many, "root").withColumn(
        "block",
        F.expr("pmod(xxhash64(print), if(side = 0, open_blocks, done_blocks))").cast("int"),
    )
    # An open block meets every open block, itself included, and every done one.
    open_pairs = F.expr(
        "transform(sequence(0, open_blocks - 1), i -> named_struct("
        "'kind', 'open', 'i', least(i, block), 'j', greatest(i, block)))"
    )
    done_pairs = F.expr(
        "if(done_blocks > 0, transform(sequence(0, done_blocks - 1), i -> named_struct("
        "'kind', 'done', 'i', block, 'j', i)), array())"
    )
    from_done = F.expr(
        "if(open_blocks > 0, transform(sequence(0, open_blocks - 1), i -> named_struct("
        "'kind', 'done', 'i', i, 'j', block)), array())"
    )
    tasks = numbered.withColumn(
        "pair",
        F.explode(F.when(F.col("side") == 0, F.concat(open_pairs, done_pairs)).otherwise(from_done)),
    ).withColumn("task", F.sha2(F.concat(F.hex("root"), F.to_json("pair")), 256).cast("binary"))
    found = search(tasks, percent)
    return found.unionAll(
        compared.filter("linked").select(F.col("print").alias("a"), F.col("hub").alias("b"))
    )


def components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    size: int = 5,
    percent: int = 80,
    most: int = 2048,
) -> DataFrame:
    """``doc, n_shingles, component`` for every row."""
    found = classes(docs, id_col, text_col, size, percent)
    linked = stars(links(found, percent, most))
    rows = found.select("doc", "n", "print").join(
        linked.withColumnRenamed("node", "print"), "print", "left"
    )
    rows = rows.withColumn("root", F.coalesce("root", "print"))
    least = (
        rows.filter(F.col("root").isNotNull())
        .groupBy(F.col("root").alias("of"))
        .agg(F.min("doc").alias("component"))
    )
    return rows.join(least, F.col("root") == F.col("of"), "left").select(
        "doc",
        F.col("n").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("doc")).otherwise(F.col("component")).alias("component"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the least of their component, with all columns.

    Rows that share an id stay or go together: an id goes if one of its rows belongs
    to a component with a smaller id. A null id only goes where another id stays.
    """
    found = components(docs, id_col, text_col, **options)
    gone = staged(
        found.filter(~F.col("doc").eqNullSafe(F.col("component"))).select(F.col("doc").alias("gone")).distinct()
    )
    return docs.join(gone, docs[id_col].eqNullSafe(gone["gone"]), "left_anti")
