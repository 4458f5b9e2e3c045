"""Chat formatting by prefix-target expansion.

Each turn becomes a segment, ``<|im_start|>role`` newline, text, ``<|im_end|>``
newline. Every assistant turn is an example of its own: all preceding segments
are its context and only its text is trainable. The contexts of a conversation
are prefixes of one another, so they are stored once, by :func:`prefixes`, and an
example says how many characters of them it takes; the output grows with the
input, not with the square of a conversation's turns. :func:`examples` has one row
per example, :func:`read_back` finds contexts and replies again in the stored text,
and :func:`materialise` spells examples out in full.

A conversation may hold a third of all rows. Its turns are cut by their number into
blocks of ``BLOCK``; positions and lengths are summed within a block and then over
one row per block, so no task has more than a block's turns and a conversation's
block totals. Only turns that repeat one number share a block however many they are.

Control strings inside texts are escaped reversibly: ``&`` becomes ``&amp;`` and
``<|`` becomes ``&lt;|`` (in roles also newline ``&#10;``), so the only ``<|`` in
the output are the template's own.

Defined results: a null role or text is empty. Turns are ordered by number, role
and text; repeated rows are turns of their own. Null numbers come first; rows of
a null conversation id form one conversation. Only the role ``assistant`` is
trainable. Other columns do not matter. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers a block of a conversation covers.
BLOCK = 256
START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(
        F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|")
    )


def unescape(text: Column) -> Column:
    return F.replace(
        F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&")
    )


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def segments(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per turn, in order of ``position`` within ``conv``.

    ``part`` is the turn's block of its conversation. ``segment`` is the formatted
    turn and ``context_chars`` the length of all segments before it. Assistant turns
    have ``example`` (from 0) and the span of their text inside the segment,
    ``loss_start`` and ``loss_chars``. ``turn_col`` is a number.
    """
    number = F.col(turn_col)
    rows = turns.select(
        # Null ids and numbers are equal inside a struct, so this one key joins them.
        F.struct(
            F.col(conv_col).alias("conv"), F.floor(number / BLOCK).alias("block")
        ).alias("part"),
        number.alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    reply = F.col("role") == "assistant"
    rows = rows.withColumn("segment", F.concat(head, body, F.lit(END)))
    sums = {
        "position": F.lit(1),
        "context_chars": F.length("segment"),
        "replies": reply.cast("int"),
    }
    totals = rows.groupBy("part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    blocks = Window.partitionBy("part.conv").orderBy("part.block")
    offsets = totals.select("part", *[_sum_before(F.col(n), blocks).alias(f"{n}_0") for n in sums])
    order = Window.partitionBy("part").orderBy("turn", "role", "text")
    return (
        rows.select("*", *[_sum_before(c, order).alias(n) for n, c in sums.items()])
        .join(offsets, "part")
        .select(
            "part",
            "part.conv",
            *[(F.col(n) + F.col(f"{n}_0")).alias(n) for n in ("position", "context_chars")],
            "segment",
            F.when(reply, F.col("replies") + F.col("replies_0")).alias("example"),
            F.when(reply, F.length(head)).alias("loss_start"),
            F.when(reply, F.length(body)).alias("loss_chars"),
        )
    )


def _sum_before(value: Column, order: Window) -> Column:
    rows = order.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(rows), F.lit(0))


def examples(segments: DataFrame) -> DataFrame:
    """One row per assistant turn.

    The example's text is the first ``context_chars`` characters of its
    conversation's segments and then ``reply``; the loss mask is the span
    ``loss_start, loss_end`` of that text. ``part`` is the block it ends in.
    """
    start = F.col("context_chars") + F.col("loss_start")
    return segments.filter(F.col("example").isNotNull()).select(
        "part",
        "conv",
        "example",
        F.col("position").alias("context_turns"),
        "context_chars",
        F.col("segment").alias("reply"),
        start.alias("loss_start"),
        (start + F.col("loss_chars")).alias("loss_end"),
    )


def prefixes(segments: DataFrame) -> DataFrame:
    """The text that examples are prefixes of: one row per block of a conversation,
    ``text`` from character ``start_chars`` and turn ``start_turn`` on."""
    turn = F.struct("position", "segment")
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(turn)), lambda t: t["segment"]), ""
    )
    return segments.groupBy("part").agg(
        F.min("context_chars").alias("start_chars"),
        F.min("position").alias("start_turn"),
        joined.alias("text"),
    )


def materialise(segments: DataFrame) -> DataFrame:
    """Examples spelled out: ``conv, example, text, loss_start, loss_end``.

    Repeats every context for each of its replies, as trainers without prefix
    sharing need it, and so has a whole conversation in a row.
    """
    fields = ("position", "segment", "context_chars", "example", "loss_start", "loss_chars")
    one = segments.groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("turns")
    )
    one = one.select("conv", "turns", F.explode("turns").alias("t"))
    start = F.col("t.context_chars") + F.col("t.loss_start")
    return one.filter(F.col("t.example").isNotNull()).select(
        "conv",
        F.col("t.example").alias("example"),
        F.array_join(
            F.transform(F.slice("turns", 1, F.col("t.position") + 1), lambda t: t["segment"]), ""
        ).alias("text"),
        start.alias("loss_start"),
        (start + F.col("t.loss_chars")).alias("loss_end"),
    )


def blocks_back(prefixes: DataFrame, examples: DataFrame) -> DataFrame:
    """What the output says of each block: ``turns`` (role, text) parsed from the
    stored text alone, ``loss_text`` cut from it by the examples' loss spans, and
    ``examples``, how many of them fit: the stored text goes on with the reply after
    exactly ``context_chars`` characters and ``context_turns`` turns."""
    spans = examples.groupBy("part").agg(
        F.array_sort(
            F.collect_list(
                F.struct("example", "context_chars", "context_turns", "loss_start", "loss_end", "reply")
            )
        ).alias("spans")
    )
    text, start = F.col("text"), F.col("start_chars")

    def cut(begin: Column, end: Column) -> Column:
        return F.substr(text, (begin - start + 1).cast("int"), (end - begin).cast("int"))

    def fits(e: Column) -> Column:
        here = e["context_chars"]
        before = F.size(F.split(cut(start, here), r"<\|im_start\|>", -1)) - 1
        same = cut(here, here + F.length(e["reply"])) == e["reply"]
        return same & (F.col("start_turn") + before == e["context_turns"])

    spans_or_none = F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType))
    replies = F.transform("spans", lambda e: cut(e["loss_start"], e["loss_end"]))
    parts = F.split(text, r"<\|im_start\|>", -1)
    return (
        prefixes.join(spans, "part", "left")
        .withColumn("spans", spans_or_none)
        .select(
            "part.conv",
            "start_chars",
            "text",
            F.transform(F.slice(parts, 2, F.size(parts)), parsed).alias("turns"),
            unescape(F.array_join(replies, "")).alias("loss_text"),
            F.size(F.filter("spans", fits)).alias("examples"),
            F.aggregate(
                "spans", F.lit(0).cast("long"), lambda n, e: n + e["context_chars"]
            ).alias("context_chars"),
        )
    )


def read_back(prefixes: DataFrame, examples: DataFrame) -> DataFrame:
    """One row per conversation: ``conv``, ``formatted``, ``turns`` and ``loss_text``
    of its blocks in order, the number of ``examples`` that fit and the sum of their
    ``context_chars``. Has a whole conversation in a row, as its digest needs."""
    blocks = blocks_back(prefixes, examples)
    fields = ("start_chars", "text", "turns", "loss_text")
    one = blocks.groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("blocks"),
        F.sum("examples").alias("examples"),
        F.sum("context_chars").alias("context_chars"),
    )
    return one.select(
        "conv",
        F.array_join("blocks.text", "").alias("formatted"),
        F.flatten("blocks.turns").alias("turns"),
        F.array_join("blocks.loss_text", "").alias("loss_text"),
        "examples",
        "context_chars",
    )


def parsed(part: Column) -> Column:
    line = F.instr(part, "\n")
    rest = F.substr(part, line + 1, F.length(part) - line - len(END))
    return F.struct(
        unescape_role(F.substr(part, F.lit(1), line - 1)).alias("role"),
        unescape(rest).alias("text"),
    )
