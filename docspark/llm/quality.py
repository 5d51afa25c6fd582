"""Quality rules as a bitmask ledger: every rule once, then policies and ablations by bit operations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import apart, let

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW, STEPS = 8, (1, 2, 4)


def repeated(words: Column) -> Column:
    """Words in WINDOW-word windows found twice or more: windows as 64-bit hashes, sorted to find equal ones.

    Starts of such windows, in order, each cover WINDOW words less the overlap with the one before.
    """

    def doubled(hashes: Column, step: int) -> Column:
        return let(hashes, lambda h: F.slice(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step))), F.lit(1), F.size(h) - step))

    windows = F.transform(words, lambda w: F.xxhash64(w))
    for step in STEPS:  # windows of 2, of 4, of 8 words: each of two halves
        windows = doubled(windows, step)

    def covered(w: Column) -> Column:
        placed = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        equal = let(placed, lambda s: F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))))
        starts = F.array_sort(F.transform(equal, lambda x: x["i"]))
        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(starts, zero, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")))["n"]

    some = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) >= WINDOW, some).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measurements of every whole text (null: no words, no lines): all in the row, without a shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    found = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated(w).alias("n_repeat_words")))
    return docs.withColumns({
        "_m": found,
        "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"),
    }).withColumns({"n_words": F.col("_m.n_words"), "n_repeat_words": F.col("_m.n_repeat_words")}).drop("_m")


def rules() -> dict[str, Column]:
    """Rule name to its failure condition over the measurements, in the order of their bits; new rules go to the end."""
    n = F.col("n_words")
    return {
        "few_words": n < 20,
        "repeated_windows": 100 * F.col("n_repeat_words") > 30 * n,
        "symbols": F.col("n_symbols") > n,
        "long_words": F.col("word_chars") > 25 * n,
        "short_words": F.col("word_chars") < 2 * n,
        "repeated_lines": 5 * F.col("n_dup_lines") > n,
    }


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: a row goes if it fails any rule in ``any_of``, or at least ``at_least`` of all rules."""

    version: str
    any_of: tuple[str, ...]
    at_least: int = 64

    def mask(self) -> int:
        return sum(1 << i for i, name in enumerate(rules()) if name in self.any_of)

    def kept(self, failed: Column) -> Column:
        return (failed.bitwiseAND(F.lit(self.mask()).cast("long")) == 0) & (F.bit_count(failed) < self.at_least)


BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = {p.version: p for p in (BASE, Policy("v1", ("few_words", "repeated_windows", "symbols", "long_words", "short_words", "repeated_lines")))}


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``failed``, a long with one bit per failed rule.

    Columns of ``docs`` named like a measurement are replaced. Null and empty texts fail few_words. Repeated rows
    get equal entries; an empty table gives an empty ledger.
    """
    bits = [F.when(cond, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, cond in enumerate(rules().values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measure(docs, text).withColumn("failed", failed)


def ablations(entries: DataFrame, policy: Policy) -> DataFrame:
    """rule, fails, fails_alone, dropped, dropped_without: what each rule of the policy does, from the bits alone.

    The ledger is first counted by bit pattern, of which there are at most 2 ** len(rules()).
    """
    patterns = entries.groupBy("failed").agg(F.count("*").alias("n"))
    mask = policy.mask()
    rows = [(name, 1 << i) for i, name in enumerate(rules()) if mask >> i & 1]
    each = patterns.withColumn("r", F.explode(F.array(*(F.struct(F.lit(a).alias("rule"), F.lit(b).cast("long").alias("bit")) for a, b in rows))))
    own, bit = F.col("failed").bitwiseAND(F.lit(mask).cast("long")), F.col("r.bit")

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0).cast("long"))

    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        total(own.bitwiseAND(bit) != 0).alias("fails"), total(own == bit).alias("fails_alone"),
        total(own != 0).alias("dropped"), total(own.bitwiseAND(F.bitwise_not(bit)) != 0).alias("dropped_without"),
    )


def keep_good(docs: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, all columns."""
    plain, names = apart(docs)
    return ledger(plain, names[text]).filter(policy.kept(F.col("failed"))).select(*names.values()).toDF(*docs.columns)
