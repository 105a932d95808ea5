"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps one bit per failed rule together with the
measurements; policies are only masks over those bits, so a new policy version or an ablation never
touches the texts again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import SPACE, let, words_of

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A failed rule sets bit ``bit`` of the ledger's mask."""

    bit: int
    name: str
    fails: str


#: ``fails`` is SQL over the measurements. Bits are never reused: a changed rule gets a new bit.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "shouting", "2 * n_upper > word_chars"),
    Rule(5, "word_length", "word_chars > 20 * n_words"),
    Rule(6, "exclamations", "3 * n_exclamations > n_words"),
)

#: Versioned policies: the rules that reject a document.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "v2": tuple(r.name for r in RULES),
}


def policy_mask(policy: str) -> int:
    bits = {r.name: 1 << r.bit for r in RULES}
    return sum(bits[name] for name in POLICIES[policy])


def repeat_words(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more in the array.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes. Only documents with a
    repeated window sort their windows.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(
        hashes,
        lambda a: F.when(
            F.size(a) >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size(a) - WINDOW),
                lambda i: F.xxhash64(*[F.get(a, i + k) for k in range(WINDOW)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )

    def positions(w: Column) -> Column:
        pairs = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twin = let(
            pairs,
            lambda s: F.filter(
                s,
                lambda p, k: (p["h"].eqNullSafe(F.get(s, k - 1)["h"]))
                | (p["h"].eqNullSafe(F.get(s, k + 1)["h"])),
            ),
        )
        return F.sort_array(F.transform(twin, lambda p: p["i"]))

    def covered(p: Column) -> Column:
        """A window adds the words up to the next repeated window, five at most."""
        steps = F.transform(
            p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))
        )
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    return let(
        windows,
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(
            let(positions(w), covered)
        ),
    )


def ledger(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, measurements and ``fail_mask``.

    Null texts count as empty; an empty text fails ``few_words`` only. Null ids, repeated rows and other
    columns of ``docs`` (dropped) change nothing: every row stands alone and nothing is shuffled.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    base = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    parts = base.select(
        "doc_id",
        let(words_of(F.col("text")), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
        )).alias("w"),
        let(lines, lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        )).alias("l"),
        (F.length("text") - count(SPACE)).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        count(r"\p{Lu}").alias("n_upper"),
        count("!").alias("n_exclamations"),
    )
    measured = parts.select(
        "doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines",
        "w.n_repeat_words", "n_upper", "n_exclamations",
    )
    mask = F.lit(0)
    for rule in RULES:
        mask = mask.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)))
    return measured.withColumn("fail_mask", mask)


def apply_policy(entries: DataFrame, policy: str) -> DataFrame:
    """Adds ``kept`` for a policy version without reading a text."""
    failed = F.col("fail_mask").bitwiseAND(F.lit(policy_mask(policy)))
    return entries.withColumn("kept", failed == 0)


def ablation(entries: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: documents it rejects, documents only it rejects, documents kept without it.

    The ledger is first reduced to one row per mask (at most 2 ** number of rules).
    """
    mask = policy_mask(policy)
    masks = entries.groupBy(F.col("fail_mask").bitwiseAND(F.lit(mask)).alias("m")).agg(
        F.count("*").alias("n")
    )
    chosen = [r for r in RULES if mask >> r.bit & 1]
    rule = F.explode(F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).alias("b")) for r in chosen
    ])).alias("r")
    rows = masks.select("m", "n", rule).select("m", "n", "r.rule", "r.b")
    kept_without = F.col("m").bitwiseAND(F.lit(mask) - F.col("b")) == 0
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    return rows.groupBy("rule").agg(
        total(F.col("m").bitwiseAND(F.col("b")) != 0).alias("rejected"),
        total(F.col("m") == F.col("b")).alias("rejected_alone"),
        total(kept_without).alias("kept_without"),
    )
