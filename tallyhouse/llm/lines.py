"""Line deduplication that decides on hashes and gives back bitmaps.

Texts are split once into entries of a 128-bit line hash, document and position.
The entries are range-partitioned by hash and a slice of the documents, and each
partition is sorted by hash, document and position, so that one pass over it
streams the first occurrence of every line and counts its documents. The slice
keeps a line that a third of all documents share out of one task; its slices
meet as one row each. What comes back is :func:`drop_bitmaps`: per document only
the 64-line words of its bitmap in which a line goes. A word that is absent keeps
all its lines, so a document that loses nothing has no row. Texts move only in
:func:`deduplicate`, which applies the bitmaps.

Lines are compared by key: white space of ``[\x20\x09-\x0D]`` stripped at both
ends and A-Z lower-cased. Keys of under ``min_chars`` code points never count. A
key in at least ``min_docs`` documents stays in one document only: the one with
the largest id, or with ``keep="first"`` the smallest; there all its lines stay.

Defined results: a null or empty text is one empty line. Rows that share an id
count as one document for a key, each row with its own text and bitmap. A null id
is one document that comes last in both orders, and so gives way to any other.
Other columns of the input do not matter. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.tables import ASCII_SPACE, lower_ascii

#: Into how many slices the documents of one line are dealt.
SLICES = 64


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(ASCII_SPACE)))


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc``, ``text`` and a hash of the text: rows may share an id."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc"), text.alias("text")).withColumn(
        "version", F.xxhash64("text")
    )


def entries(docs: DataFrame, min_chars: int) -> DataFrame:
    lines = docs.select(
        "doc", "version", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    )
    keys = lines.select("doc", "version", "pos", line_key(F.col("line")).alias("key"))
    return keys.filter(F.length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"),
        F.xxhash64(F.lit("second"), "key").alias("h2"),
        F.pmod(F.xxhash64("doc"), F.lit(SLICES)).cast("int").alias("slice"),
        "doc",
        "version",
        "pos",
    )


def repeated_keys(entries: DataFrame, min_docs: int, keep: str) -> DataFrame:
    """``h1, h2`` of the keys that go, and ``stays``, the document that keeps them."""
    order = F.desc_nulls_last("doc") if keep == "last" else F.asc_nulls_last("doc")
    line = Window.partitionBy("h1", "h2", "slice")
    best = F.max if keep == "last" else F.min
    return (
        entries.select("h1", "h2", "slice", "doc", "pos")
        .repartitionByRange("h1", "h2", "slice")
        .withColumn("nth", F.row_number().over(line.orderBy(order, "pos")))
        .withColumn("nth_doc", F.dense_rank().over(line.orderBy(order)))
        .groupBy("h1", "h2", "slice")
        .agg(
            F.max(F.when(F.col("nth") == 1, F.col("doc"))).alias("first"),
            F.max("nth_doc").alias("docs"),
        )
        .groupBy("h1", "h2")
        .agg(best("first").alias("stays"), F.sum("docs").alias("docs"))
        .filter(F.col("docs") >= min_docs)
        .select("h1", "h2", "stays")
    )


def drop_bitmaps(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    min_chars: int = 20,
    min_docs: int = 3,
    keep: str = "last",
) -> DataFrame:
    """Compressed bitmaps: ``doc, version, n_dropped, words``.

    ``words`` maps a word number to its 64 bits; a set bit drops line
    ``64 * word + bit``, and lines of absent words stay.
    """
    if keep not in ("first", "last"):
        raise ValueError(f"keep {keep!r}: first or last")
    found = entries(identified(docs, id_col, text_col), min_chars)
    gone = found.join(repeated_keys(found, min_docs, keep), ["h1", "h2"]).filter(
        ~F.col("doc").eqNullSafe(F.col("stays"))
    )
    bit = F.expr("shiftleft(1L, pos % 64)")
    return (
        gone.select("doc", "version", F.expr("pos div 64").cast("int").alias("word"), bit.alias("bit"))
        .repartition("doc", "version")
        .groupBy("doc", "version", "word")
        .agg(F.bit_or("bit").alias("bits"))
        .groupBy("doc", "version")
        .agg(
            F.sum(F.bit_count("bits")).alias("n_dropped"),
            F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"),
        )
    )


def deduplicate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    min_chars: int = 20,
    min_docs: int = 3,
    keep: str = "last",
) -> DataFrame:
    """Every row of ``docs``: ``doc, text`` (kept lines), ``n_lines``, ``n_dropped``."""
    rows = identified(docs, id_col, text_col)
    bitmaps = drop_bitmaps(
        docs, id_col, text_col, min_chars=min_chars, min_docs=min_docs, keep=keep
    )
    return applied(rows, bitmaps).select("doc", "text", "n_lines", "n_dropped")


def applied(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``rows`` (with ``doc, version, text``) without the lines that go."""
    bitmaps = bitmaps.select(
        F.col("doc").alias("b_doc"), F.col("version").alias("b_version"), "n_dropped", "words"
    )
    same = rows.doc.eqNullSafe(bitmaps.b_doc) & (rows.version == bitmaps.b_version)
    joined = rows.join(bitmaps, same, "left").withColumn("lines", F.split("text", "\n", -1))
    kept = F.expr(
        "filter(lines, (line, i) ->"
        " (shiftright(coalesce(try_element_at(words, i div 64), 0L), i % 64) & 1L) = 0)"
    )
    return joined.withColumns(
        {
            "text": F.when(F.col("words").isNull(), F.col("text")).otherwise(
                F.array_join(kept, "\n")
            ),
            "n_lines": F.size("lines").cast("long"),
            "n_dropped": F.coalesce("n_dropped", F.lit(0)).cast("long"),
        }
    )


def rewrite(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """``docs`` with all its columns; texts that lose no line, and nulls, are as they were."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(row, F.col(id_col).alias("doc"), text.alias("text")).withColumn(
        "version", F.xxhash64("text")
    )
    done = applied(rows, drop_bitmaps(docs, id_col, text_col, **options))
    new = F.when(F.col("n_dropped") > 0, F.col("text")).otherwise(F.col("row").getField(text_col))
    return done.select(
        *(
            (new if c == text_col else F.col("row").getField(c)).alias(c)
            for c in docs.columns
        )
    )
