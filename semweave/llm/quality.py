"""Quality rules as a bitmask ledger.

Every rule is evaluated once a document. The ledger keeps the measurements and one failure bit a rule; a policy is a
versioned choice of rules, applied by one bitwise AND, and ablations are aggregates over the few distinct masks.

Defined cases: a null or empty text has zero words and fails ``few_words``; repeated rows give repeated ledger rows; an
empty table gives an empty ledger; a word is a maximal run of characters other than space and 09-0D.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semweave.llm.arrow_rows import extend_rows, free_name, map_text

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
#: Bytes that begin no code point of a word.
NO_POINT = BLANKS + bytes(range(0x80, 0xC0))
ENDS = (b"!!", b"!!.", b"!!,")

#: Rule name -> SQL condition over the measurements that is true where the rule FAILS. Bit i belongs to the i-th rule;
#: rules are only ever appended, so that stored masks stay valid.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "n_lines >= 4 and 2 * n_dup_lines > n_lines",
    "odd_word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)",
    "shouting": "10 * n_shout_words > 3 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules. A document is kept if none of them fails."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        order = list(RULES)
        return sum(1 << order.index(r) for r in set(self.rules))


BASE = Policy("base-1", ("few_words", "repeated_windows"))
STRICT = Policy("full-1", tuple(RULES))


def measure(text: bytes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_shout_words."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, NO_POINT)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeat_words(words),
        sum(w.endswith(ENDS) for w in words) if b"!!" in text else 0,
    )


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words in windows of ``width`` words that start at two places or more."""
    n = len(words)
    if n <= width:
        return 0
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(index.__getitem__, words), np.int64, n)
    key = ids[: n - width + 1].copy()
    for i in range(1, width):
        key = key * len(index) + ids[i : n - width + 1 + i]
        if i + 1 < width:  # ranks, so that the next product fits
            key = np.unique(key, return_inverse=True)[1] if len(index) > 1_500_000 else key
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shout_words")


def apply_policy(ledger: DataFrame, policy: Policy, out: str = "kept") -> DataFrame:
    """Add the policy's verdict; no rule is evaluated again."""
    return ledger.withColumn(out, F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0)


def ablate(ledger: DataFrame, policy: Policy) -> DataFrame:
    """What each rule of a policy costs: rows it fails, rows it alone fails, rows kept without it.

    The ledger is first aggregated to its distinct masks (at most 2^rules rows), so the ablation never touches documents.
    """
    masks = ledger.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    order = list(RULES)
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << order.index(r)).cast("long").alias("bit")) for r in policy.rules))
    hit = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    each = masks.select("n", hit.alias("hit"), F.explode(rules).alias("r")).select("n", "hit", "r.rule", "r.bit")
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0).cast("long")))
    return each.groupBy("rule").agg(
        count(F.col("hit").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(F.col("hit") == F.col("bit")).alias("n_failed_alone"),
        count(F.col("hit").bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"),
    )


def fail_bits(names: dict[str, str]) -> Column:
    """The ledger's bits, from measurements that stand in columns of other names."""
    conditions = [re.sub(r"[a-z]\w*_[a-z_]+", lambda m: f"`{names[m[0]]}`", c) for c in RULES.values()]
    return F.expr(" + ".join(f"if({c}, {1 << i}L, 0L)" for i, c in enumerate(conditions)))


def rule_ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id``, the measurements and ``fail_bits`` (bigint, bit i = i-th rule of RULES fails)."""
    rows = map_text(docs, lambda: measure, [(m, pa.int64(), "long") for m in MEASURES], id_col=id_col, text_col=text_col)
    return rows.withColumn("fail_bits", fail_bits({m: m for m in MEASURES}))


def with_ledger(docs: DataFrame, *, text_col: str = "text") -> tuple[DataFrame, str]:
    """Whole rows with a ledger's entry (a struct of ``fail_bits`` and the measurements), and the name of its column.

    The measurements travel beside the row in one narrow pass: no join back, so repeated or null ids can't mix.
    """
    names = {m: free_name(docs, f"ledger_{m}") for m in MEASURES}
    rows = extend_rows(docs, lambda: measure, [(names[m], pa.int64(), "long") for m in MEASURES], text_col=text_col)
    entry = F.struct(fail_bits(names).alias("fail_bits"), *(F.col(n).alias(m) for m, n in names.items()))
    name = free_name(docs, "ledger")
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns), entry.alias(name)), name


def quality_filter(docs: DataFrame, policy: Policy = STRICT, *, text_col: str = "text") -> DataFrame:
    """Whole rows of ``docs`` that the policy keeps, with all their columns: its mask on the bits of every rule."""
    rows, name = with_ledger(docs, text_col=text_col)
    kept = F.col(name)["fail_bits"].bitwiseAND(F.lit(policy.mask).cast("long")) == 0
    return rows.where(kept).select(*(F.col(f"`{c}`") for c in docs.columns))
