"""Rule bitmask ledger: every rule is evaluated once per document; policies and ablations only read bits.

``ledger`` adds measurements and one ``fail_bits`` number to each text. A policy is a named, versioned set of rules, so it is a bit mask:
applying one, or asking what each of its rules does alone, never touches a text again.

Everything is a column expression on one row: no shuffle, no Python. A null text has no words. Repeated rows are judged alike, each for
itself. Only the columns named in ``ledger`` are read; other columns of the input pass through, and one whose name is taken by a
measurement is replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pavesa.llm.common import SPACE, word_list

SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Rule -> condition for failing. The position of a rule is its bit; append only, so that stored ledgers stay readable.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars > 20 * n_words or word_chars < 2 * n_words",
    "capitals": "2 * n_upper > word_chars",
}
BITS = {rule: 1 << i for i, rule in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version of the rules in force."""

    name: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
#: Repeated lines alone also occur in good texts (lists, refrains), so that rule is measured but not in force.
STRICT = Policy("strict-2", tuple(r for r in RULES if r != "repeated_lines"))


def _beside(items: str, by: int, fn: Callable[[Column, Column], Column]) -> Column:
    """``fn`` of each item and the one ``by`` places later (null beyond the end). It takes a column's name: an expression would be evaluated twice."""
    return F.zip_with(items, F.slice(items, F.lit(by + 1), F.lit(2**30)), fn)


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the measurements (long) and ``fail_bits`` (long): bit i is set when rule i of RULES fails.

    A window is known by one hash: hashes of words are paired and hashed three times (1, 2, 4 apart), so each word is hashed once. Windows
    found twice meet when (hash, position) pairs are sorted; their positions give the words covered. Only texts with such windows are sorted.
    """
    measured = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper"]
    others = F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in {*measured, "fail_bits"}))
    steps = df.select(others.alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.transform(word_list(F.col(text)), lambda w: F.xxhash64(w)).alias("_h1"))
    for step, (source, target) in zip((1, 2, 4), (("_h1", "_h2"), ("_h2", "_h4"), ("_h4", "_h8")), strict=True):
        steps = steps.withColumn(target, _beside(source, step, lambda a, b: F.xxhash64(a, b)))
    whole = F.size("_h1") - (WINDOW - 1)
    steps = steps.withColumn("_win", F.when(whole > 0, F.slice("_h8", F.lit(1), F.greatest(whole, F.lit(1)))).otherwise(F.array().cast("array<bigint>")))
    placed = F.sort_array(F.zip_with("_win", F.sequence(F.lit(1), F.size("_win")), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    steps = steps.withColumn("_placed", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), placed))
    twice = _beside("_placed", 1, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    steps = steps.withColumn("_starts", F.sort_array(F.array_distinct(F.flatten(F.filter(twice, lambda p: p.isNotNull())))))
    gains = _beside("_starts", 1, lambda a, b: F.when(b.isNull(), F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), b - a)))
    steps = steps.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    values = steps.select(
        "_row.*",
        F.size("_h1").cast("long").alias("n_words"),
        F.length(F.translate("_text", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(gains, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.length(F.regexp_replace("_text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
    )
    total = F.lit(0)
    for rule, bit in zip(RULES.values(), BITS.values(), strict=True):
        total = total.bitwiseOR(F.when(F.expr(rule), F.lit(bit)).otherwise(F.lit(0)))
    return values.withColumn("fail_bits", total.cast("long"))


def passes(policy: Policy) -> Column:
    """True where a ledger row fails no rule of the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def kept(df: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """The rows that pass a policy, with their own columns, whatever their names.

    The verdict is read by a generator: a filter would be pushed below the steps of the ledger and repeat them for every rule.
    """
    rows = df.select(F.struct("*").alias("_kept"), F.col(text).alias("text"))
    return ledger(rows).select(F.inline(F.when(passes(policy), F.array("_kept"))))


def ablation(rows: DataFrame, policies: tuple[Policy, ...] = (BASE, STRICT)) -> DataFrame:
    """Per policy and rule: rows that the policy keeps, rows that fail the rule, rows it alone rejects, and rows kept without it.

    Rows are first counted by bit pattern (at most 2^rules patterns, counted before the shuffle), then patterns are combined bitwise.
    An empty ledger gives zeros.
    """
    patterns = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    bits = F.col("fail_bits")
    counts = []
    for p in policies:
        for rule in p.rules:
            rest = bits.bitwiseAND(F.lit(p.mask & ~BITS[rule]).cast("long")) == 0
            failed = bits.bitwiseAND(F.lit(BITS[rule]).cast("long")) != 0
            sums = {"kept": passes(p), "failed": failed, "only_this": rest & failed, "kept_without": rest}
            counts.append(F.struct(F.lit(p.name).alias("policy"), F.lit(rule).alias("rule"), *(F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(k) for k, c in sums.items())))
    return patterns.agg(F.array(*counts).alias("r")).select(F.inline("r"))
