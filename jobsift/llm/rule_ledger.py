"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each whole text. What is stored is the
measurement of each rule and one integer whose bit i says that rule i failed.
A policy is a versioned set of rules (a mask) and how many of them may fail;
any policy is then applied, and the effect of leaving out each rule computed,
from the stored bits alone, without reading a text again.

Words are the runs of characters other than \\x20 and \\x09-\\x0D.

Cases: a null text has no word, like an empty one; ratios over zero words are
zero; repeated rows are measured alike; windows are compared as text, so
a text of any length is exact; an empty table gives an empty ledger. Input
columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import slices, small_batches

SYMBOLS = re.compile(r"[#*$%&|<>]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LETTER = re.compile(r"[^\W\d_]")
MARKED = re.compile(r"!!(?=[\x20\x09-\x0D]|\Z)")
WINDOW = 5

#: Measurements, in the order of the ledger's columns.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words",
            "n_upper_words", "n_mark_words")


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL condition over the measurements


#: Bit i of the ledger belongs to rule i; new rules are added at the end only.
RULES = (
    Rule("too_short", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("too_long", "n_words > 1000000"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("few_letters", "10 * n_letter_words < 6 * n_words"),
    Rule("shouting", "10 * n_upper_words > 5 * n_words"),
    Rule("exclaiming", "10 * n_mark_words > 3 * n_words"),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A text is kept if at most ``allowed`` of the policy's rules failed."""

    version: str
    rules: tuple[str, ...]
    allowed: int = 0

    @property
    def mask(self) -> int:
        return sum(BIT[name] for name in self.rules)


BASE = Policy("base-1", ("too_short", "repeated_windows"))
#: Length alone says nothing against a text: too_long is measured, not applied.
STRICT = Policy("strict-2", tuple(name for name in BIT if name != "too_long"))


def measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = WORDS.findall(text)
    n = len(words)
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    repeated = 0
    if n > WINDOW:
        starts = [words[k:] for k in range(WINDOW)]
        if len(set(zip(*starts, strict=False))) < n - WINDOW + 1:
            windows = list(zip(*starts, strict=False))
            times = Counter(windows)
            covered = 0  # words before this place are counted already
            for i, w in enumerate(windows):
                if times[w] > 1:
                    repeated += i + WINDOW - max(covered, i)
                    covered = i + WINDOW
    mixed = [w for w in words if not w.isalpha()]
    letters = n - len(mixed) + sum(LETTER.search(w) is not None for w in mixed)
    return (n, sum(map(len, words)), len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated, len(lines),
            letters, sum(map(str.isupper, words)), len(MARKED.findall(text)))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements, failed): one row for each row of ``docs``; ``failed``
    is the bitmask of failed rules."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType([rows.schema["id"]])
    for name in MEASURES:
        schema = schema.add(name, "long")

    def run(batches):
        for part in slices(batches):
            found = list(zip(*map(measure, part.column(1).to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in found)], ["id", *MEASURES])

    bits = [F.when(F.expr(rule.fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, rule in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return rows.mapInArrow(run, schema).withColumn("failed", failed)


def kept(policy: Policy, failed: str = "failed") -> Column:
    """Whether a ledger row passes the policy, from its bits alone."""
    return F.bit_count(F.col(failed).bitwiseAND(F.lit(policy.mask).cast("long"))) <= policy.allowed


def ablations(book: DataFrame, policy: Policy) -> DataFrame:
    """What each rule of a policy does, by bitwise aggregation over the
    ledger: rows failing it, rows that fail it alone (kept without it), rows
    kept by the policy, and by the policy without it. One row for each rule,
    one pass: equal bit patterns are counted first."""
    patterns = book.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")).alias("failed")).agg(
        F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit"))
                                for name in policy.rules))).alias("r")
    each = patterns.select("failed", "n", rules).select("failed", "n", "r.rule", "r.bit")
    has = F.col("failed").bitwiseAND(F.col("bit")) != 0
    without = F.bit_count(F.col("failed").bitwiseAND(F.bitwise_not("bit"))) <= policy.allowed
    passes = F.bit_count("failed") <= policy.allowed
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0)))
    return each.groupBy("rule").agg(count(has).alias("n_failed"), count(has & without & ~passes).alias("n_alone"),
                                    count(passes).alias("n_kept"), count(without).alias("n_kept_without"))
