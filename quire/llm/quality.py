"""Rule bitmask ledger: every quality rule evaluated once, kept as bits and measurements.

``ledger`` measures each text and sets one bit per failed rule. A policy is a
versioned mask of rules; applying one, or comparing many, needs the bits
alone, never the text again. ``ablation`` counts, for any set of policies,
what each rule rejects and what only it rejects, by bitwise aggregation.

Everything is built-in expressions over the row's own text: no Python on the
executors and no shuffle but that of ``ablation``'s sums.

Defined cases: a null text counts as empty; it has no words, so it fails
``few_words``. Repeated rows are measured each by itself. Of the input's
columns, only those named like a measurement or ``fail_bits`` are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.columns import fresh, named, own

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A named test of the measurements; true means the document fails."""

    name: str
    bit: int
    fails: str


#: Integer arithmetic only, so every engine decides alike.
RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", 2, "4 * n_symbols > n_words"),
    Rule("repeated_lines", 3, "100 * n_dup_lines > 40 * n_lines"),
    Rule("short_words", 4, "word_chars < 2 * n_words"),
    Rule("long_words", 5, "word_chars > 20 * n_words"),
)

BASE = ("few_words", "repeated_windows")

#: Policies by version: the rules whose failure rejects a document.
POLICIES = {
    1: BASE,
    2: (*BASE, "many_symbols", "repeated_lines"),
    3: (*BASE, "many_symbols", "repeated_lines", "short_words", "long_words"),
}
CURRENT = 3


def mask(names: Sequence[str]) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in names)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements of every whole text.

    Repeated windows: the hashes of all three-word windows are sorted with
    their places, neighbours of equal hash are repeats, and the words that
    those windows cover are counted once.
    """
    kept = own(docs, *MEASURES)
    words, lines, windows, repeats = fresh(docs.columns, "_words", "_lines", "_windows", "_repeats")
    whole = F.coalesce(named(text), F.lit(""))
    step = docs.withColumns({
        words: F.filter(F.split(whole, SPACES, -1), lambda w: w != ""),
        lines: F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    every = F.transform(words, lambda w, i: F.struct(F.when(i < F.size(words) - 2, F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))).alias("h"), i.alias("i")))
    step = step.withColumn(windows, F.sort_array(every))

    def repeated(x: Column, i: Column) -> Column:
        return (F.get(windows, i + 1)["h"] == x["h"]) | (F.get(windows, i - 1)["h"] == x["h"])

    step = step.withColumn(repeats, F.transform(F.filter(windows, repeated), lambda x: x["i"]))
    covered = F.array_distinct(F.concat(repeats, F.transform(repeats, lambda i: i + 1), F.transform(repeats, lambda i: i + 2)))
    return step.select(
        *[named(c) for c in kept],
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(whole, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(covered).cast("long").alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Measurements and ``fail_bits``: bit r.bit is set where rule r fails."""
    step = measured(docs.select(*[named(c) for c in own(docs, "fail_bits")]), text)
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return step.withColumn("fail_bits", bits)


def verdict(bits: Column | str, names: Sequence[str]) -> Column:
    """Whether a policy of these rules keeps the document."""
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(mask(names)).cast("long")) == 0


def ablation(ledgered: DataFrame, policies: dict[int, Sequence[str]] | None = None) -> DataFrame:
    """Per policy version and rule: documents, rejected, failed (by the rule), only (by no other rule of the policy)."""
    policies = POLICIES if policies is None else policies
    per_pattern = ledgered.groupBy("fail_bits").agg(F.count("*").alias("n"))  # 2 ** rules rows at most
    bits = {r.name: r.bit for r in RULES}
    cases = [F.struct(F.lit(v).alias("version"), F.lit(n).alias("rule"), F.lit(1 << bits[n]).cast("long").alias("own"), F.lit(mask(names)).cast("long").alias("all")) for v, names in policies.items() for n in names]
    each = per_pattern.select("n", "fail_bits", F.explode(F.array(*cases)).alias("c"))
    hit = F.col("fail_bits").bitwiseAND(F.col("c.all"))
    return each.groupBy("c.version", "c.rule").agg(
        F.sum("n").alias("documents"),
        F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("rejected"),
        F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("c.own")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(hit == F.col("c.own"), F.col("n")).otherwise(0)).alias("only"),
    )
