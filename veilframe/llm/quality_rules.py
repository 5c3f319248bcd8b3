"""Quality rules kept as a ledger of failure bits.

Every rule is evaluated once for each document. The ledger holds the measurements and one
bit a failed rule; policies are versioned sets of rules, applied afterwards by a bitwise
and. What a policy would keep without one of its rules follows from counts of bit patterns,
without reading a text again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.text import WHITE, WORD_GAP, only

WINDOW = 5
_WHITE_CHARS = "".join(map(chr, WHITE))


@dataclass(frozen=True)
class Rule:
    """A failed rule sets its bit. ``failed`` is an SQL condition over the measurements."""

    bit: int
    name: str
    failed: str


# The conditions are plain SQL, so that the ledger's twin in SQL can use them as well.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "capitals", "2 * n_capitals > word_chars"),
    Rule(4, "repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule(5, "short_words", "2 * word_chars < 5 * n_words"),
    Rule(6, "long_words", "word_chars > 12 * n_words"),
    Rule(7, "many_words", "n_words > 100000"),
)


@dataclass(frozen=True)
class Policy:
    """A version and the rules it enforces; other rules are recorded only."""

    version: str
    enforced: tuple[str, ...]

    def mask(self, rules: Sequence[Rule] = RULES) -> int:
        bits = {rule.name: 1 << rule.bit for rule in rules}
        return sum(bits[name] for name in self.enforced)


BASE = Policy("base", ("few_words", "repeated_words"))
SYMBOLS = Policy("base+symbols", (*BASE.enforced, "symbols"))
CURRENT = Policy("2", (*SYMBOLS.enforced, "capitals", "repeated_lines", "short_words", "long_words"))
POLICIES = (BASE, SYMBOLS, CURRENT)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words")


def _repeated_words(hashes: str, windows: str) -> Column:
    """Words inside windows that occur twice or more. Only texts with such a window are
    sorted; neighbours in the order of hashes that agree are the same window."""
    position = F.sequence(F.lit(0), F.size(windows) - 1)
    ordered = F.array_sort(F.transform(position, lambda i: F.struct(F.get(windows, i).alias("h"), i.alias("at"))))

    def shared(order: Column) -> Column:
        def same(i, j):
            return F.coalesce(F.get(order, i)["h"] == F.get(order, j)["h"], F.lit(False))

        return F.filter(F.sequence(F.lit(0), F.size(order) - 1), lambda i: same(i, i - 1) | same(i, i + 1))

    def covered(order: Column) -> Column:
        places = F.array_sort(F.transform(shared(order), lambda i: F.get(order, i)["at"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(
            places,
            start,
            lambda done, at: F.struct(
                at.alias("last"), (done["total"] + F.least(F.lit(WINDOW), at - done["last"])).alias("total")
            ),
            lambda done: done["total"],
        )

    # One-element transform: names the sorted array, so that it is computed once.
    total = F.element_at(F.transform(F.array(ordered), covered), 1)
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), total).otherwise(0)


def ledger(
    docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, measurements bigint, fail_bits bigint) of every row.

    A null text has no words and fails as an empty one does; repeated rows are measured each
    for itself; other columns, whatever their names, are not read. Windows of five words are
    compared by 64-bit hashes within one text.
    """
    rows = only(docs, id_col, text_col).toDF("id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    trimmed = F.btrim("text", F.lit(_WHITE_CHARS))
    split = rows.select(
        "id",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP)).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(_WHITE_CHARS)) != "").alias("lines"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]++", "")).alias("n_symbols"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]++", "")).alias("n_capitals"),
    )
    counted = split.select(
        "id",
        F.size("words").alias("n_words"),
        F.length(F.concat_ws("", "words")).alias("word_chars"),
        "n_symbols",
        "n_capitals",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    window = F.transform(
        F.sequence(F.lit(0), F.col("n_words") - WINDOW),
        lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)]),
    )
    windowed = counted.withColumn(
        "windows", F.when(F.col("n_words") >= WINDOW, window).otherwise(F.array().cast("array<bigint>"))
    )
    measured = windowed.withColumn("n_repeat_words", _repeated_words("hashes", "windows")).select(
        "id", *[F.col(m).cast("bigint").alias(m) for m in MEASURES]
    )
    bits = F.lit(0).cast("bigint")
    for rule in rules:
        bits = bits + F.when(F.expr(rule.failed), F.lit(1 << rule.bit).cast("bigint")).otherwise(0)
    return measured.withColumn("fail_bits", bits).withColumnRenamed("id", id_col)


def verdict(policy: Policy, rules: Sequence[Rule] = RULES) -> Column:
    """True where a ledger row fails none of the policy's rules."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("bigint")) == 0


def apply_policy(
    docs: DataFrame, policy: Policy = CURRENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` the policy keeps, in all their columns. The ledger is computed on
    the rows themselves, so no join is needed and repeated ids make no difference."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    # Exploding nothing drops a row. A filter would be pushed below the ledger, and all its
    # columns be written out again inside the condition.
    found = ledger(packed, id_col="row", text_col="text").withColumn("keeps", verdict(policy))
    kept = found.select(F.explode(F.when(F.col("keeps"), F.array("row"))).alias("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def ablation(measured: DataFrame, policies: Sequence[Policy] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(policy, rule, failing, kept, kept_without_rule): how many rows of a ledger fail each
    enforced rule, how many the policy keeps, and how many it would keep without the rule.

    Rows are first counted by their bits, of which there are at most 2^rules patterns.
    """
    patterns = measured.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    bit = {rule.name: 1 << rule.bit for rule in rules}
    cases = F.array(
        *[
            F.struct(
                F.lit(p.version).alias("policy"),
                F.lit(name).alias("rule"),
                F.lit(p.mask(rules)).cast("bigint").alias("mask"),
                F.lit(bit[name]).cast("bigint").alias("bit"),
            )
            for p in policies
            for name in p.enforced
        ]
    )
    each = patterns.select("n", "fail_bits", F.inline(cases))
    failed = F.col("fail_bits").bitwiseAND(F.col("mask"))
    without = failed.bitwiseAND(F.bitwise_not("bit"))

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    return each.groupBy("policy", "rule").agg(
        total(failed.bitwiseAND(F.col("bit")) != 0).alias("failing"),
        total(failed == 0).alias("kept"),
        total(without == 0).alias("kept_without_rule"),
    )
