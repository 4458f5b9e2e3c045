"""Quality rules as a bitmask ledger.

:func:`ledger` evaluates every rule once for every document and stores what was
measured beside one word of failure bits. A policy is a versioned set of rules:
:func:`apply_policy` is a bitwise AND with the stored word, so a new policy never
reads a text again. :func:`ablation` tells what each rule of a policy costs: the
ledger is reduced to one row per distinct word of bits (at most 2 to the number
of rules, whatever the size of the corpus), and everything else is bitwise
aggregation over those rows.

Defined results: a null or empty text has no words, measures 0 everywhere and
fails ``too_few_words``. A null id stays null. Repeated rows are judged each on
their own. Other columns of the input do not matter. Whole texts are measured.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.tables import ASCII_SPACE, alone, importable, map_rows

SPACE = ASCII_SPACE.encode()
#: The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_lines long, "
    "n_dup_lines long, n_repeat_words long"
)


@dataclass(frozen=True)
class Rule:
    """A rule keeps its bit for ever; a changed rule gets a new one."""

    bit: int
    name: str
    fails: str

    @property
    def mask(self) -> int:
        return 1 << self.bit


RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        known = {r.name: r.mask for r in RULES}
        return sum(known[name] for name in set(self.rules))


BASE = Policy("base-1", ("too_few_words", "repeated_words"))
POLICIES = (
    BASE,
    Policy(
        "corpus-1",
        (
            "too_few_words",
            "repeated_words",
            "symbols",
            "repeated_lines",
            "short_words",
            "long_words",
        ),
    ),
)
CURRENT = POLICIES[-1]


def measure(text: bytes | None) -> tuple[int, ...]:
    """The values of :data:`MEASURES` for one text."""
    if not text:
        return (0,) * 6
    words = text.split()  # of bytes: at ASCII white space only
    solid = text.translate(None, SPACE)
    chars = len(solid.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = text.split(b"\n")
    filled = [line for line in lines if line.strip(SPACE)]
    repeated = len(filled) - len(set(filled))
    return len(words), chars, symbols, len(lines), repeated, repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words covered by a window of three that occurs twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    covered = end = 0
    for i, window in enumerate(windows):
        if found[window] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, the measurements and ``fail_bits``."""
    key = docs.schema[id_col].dataType.simpleString()
    measured = map_rows(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")),
        f"id {key}, {MEASURES}",
        lambda i, text: [(i, *measure(text))],
    )
    return measured.withColumnRenamed("id", id_col).withColumn("fail_bits", fail_bits())


def keep(
    docs: DataFrame, policy: Policy = CURRENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    Rows are judged where they are: each row's other columns ride along, so
    nothing is joined or shuffled.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    kind = f"struct<{', '.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in docs.schema.fields)}>"
    judged = map_batches(docs.select(row), kind, docs.columns.index(text_col))
    kept = judged.withColumn("fail_bits", fail_bits()).filter(passes(policy))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def map_batches(rows: DataFrame, kind: str, place: int) -> DataFrame:
    """``row`` unchanged, beside the measurements of its field ``place``."""
    names = [m.split()[0] for m in MEASURES.split(", ")]

    def run(batches):
        for batch in batches:
            texts = pc.struct_field(batch.column(0), [place]).cast(pa.string()).cast(pa.binary())
            measured = [measure(t.as_py()) for t in texts]
            columns = list(zip(*measured)) if measured else [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["row", *names]
            )

    return importable(rows).mapInArrow(alone(run), f"row {kind}, {MEASURES}")


def fail_bits() -> Column:
    bits = F.lit(0).cast("long")
    for rule in RULES:
        failed = F.when(F.expr(rule.fails), F.lit(rule.mask)).otherwise(F.lit(0))
        bits = bits.bitwiseOR(failed.cast("long"))
    return bits


def passes(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policy(ledger: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The ledger with ``policy`` and ``kept``."""
    return ledger.withColumn("policy", F.lit(policy.version)).withColumn(
        "kept", passes(policy)
    )


def ablation(ledger: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """What every rule of every policy does, from the stored bits alone.

    Per policy and rule: ``n_failed`` (fail the rule), ``n_only`` (fail no other
    rule of the policy, so they would be kept without it), ``n_kept`` (kept by the
    whole policy) and ``with_bits`` (union of the policy's rules that documents
    failing this one also fail). An empty ledger gives no rows.
    """
    words = ledger.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(
        *(
            F.struct(
                F.lit(p.version).alias("policy"),
                F.lit(p.mask).cast("long").alias("policy_mask"),
                F.lit(r.name).alias("rule"),
                F.lit(r.mask).cast("long").alias("rule_mask"),
            )
            for p in policies
            for r in RULES
            if p.mask & r.mask
        )
    )
    hits = F.col("fail_bits").bitwiseAND(F.col("policy_mask"))
    rule = F.col("rule_mask")
    n = F.col("n")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    return (
        words.select("fail_bits", "n", F.inline(rules))
        .groupBy("policy", "rule")
        .agg(
            total(hits.bitwiseAND(rule) != 0).alias("n_failed"),
            total(hits == rule).alias("n_only"),
            total(hits == 0).alias("n_kept"),
            F.coalesce(
                F.bit_or(F.when(hits.bitwiseAND(rule) != 0, hits)), F.lit(0).cast("long")
            ).alias("with_bits"),
        )
    )
