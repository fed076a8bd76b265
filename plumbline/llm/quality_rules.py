"""Quality rules as a ledger of bits.

Every rule is evaluated once per document. The ledger holds the measurements and one
failure bit for each rule; policies are masks over these bits, so a new policy, or
the question what a rule alone rejects, never reads a text again.

    ledger = build_ledger(docs)
    kept = apply_policy(docs_with_ledger, "v1")
    ablation(ledger, "v1")

Defined results: a null text counts as empty (no words: fails ``few_words``); text
that is white space alone likewise; repeated rows and ids are judged row by row; an
empty table gives an empty ledger; other columns of ``docs`` are never looked at.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.llm.common import SPACE, texts, utf8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"
WINDOW = 8

#: Bit i of the ledger belongs to RULES[i]: name, and when a document fails it.
#: Append only: bits that have been stored keep their meaning.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "n_dup_lines >= 5 AND 2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
]
BASE = ("few_words", "repeated_words")
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words"),
}


def mask_of(policy: str) -> int:
    names = [n for n, _ in RULES]
    return sum(1 << names.index(n) for n in POLICIES[policy])


def repeated(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words (a power of two) that the text holds
    twice or more. Windows get exact ranks by doubling: no hashing, n log n."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    width = 1
    while width < window:
        if len(rank) <= width:
            return 0
        pair = rank[:-width] * (n + 1) + rank[width:]
        distinct, rank = np.unique(pair, return_inverse=True)
        if len(distinct) == len(pair):
            return 0
        width *= 2
    twice = np.bincount(rank)[rank] > 1
    ends = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(ends, at, 1)
    np.add.at(ends, at + window, -1)
    return int((np.cumsum(ends)[:n] > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    raw = utf8(text)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    spaces = len(raw) - len(raw.translate(None, SPACE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), len(text or "") - spaces, symbols, len(lines), len(lines) - len(set(lines)), repeated(words)


@F.arrow_udf(T.StructType([T.StructField(n, T.LongType()) for n in MEASURES]))
def measures(text: pa.Array) -> pa.Array:
    rows = [measure(x.as_py()) for x in text]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))], names=list(MEASURES))


def bits() -> Column:
    """The failure bits, from the columns of MEASURES."""
    out = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(RULES):
        out = out.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return out


def build_ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, fail_bits: one row for each row of ``docs``."""
    d = texts(docs).withColumn("m", measures("text")).select("doc_id", "m.*")
    return d.withColumn("fail_bits", bits())


def passes(policy: str, column: str = "fail_bits") -> Column:
    return F.col(column).bitwiseAND(F.lit(mask_of(policy)).cast("long")) == 0


def ablation(ledger: DataFrame, policy: str) -> DataFrame:
    """rule, n_failed, n_failed_alone (kept if the rule were dropped), n_docs, n_kept.

    Documents are counted by their masked bits first, at most 2^rules rows; the rules
    are read off those counts."""
    own = ledger.select(F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy)).cast("long")).alias("bits"))
    counts = own.groupBy("bits").agg(F.count("*").alias("n"))
    names = [n for n, _ in RULES]
    rules = [F.struct(F.lit(n).alias("rule"), F.lit(1 << names.index(n)).cast("long").alias("bit")) for n in POLICIES[policy]]
    return (
        counts.select("bits", "n", F.explode(F.array(*rules)).alias("r")).select("bits", "n", "r.*").groupBy("rule")
        .agg(F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
             F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
             F.sum("n").alias("n_docs"), F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("n_kept"))
    )


def filter_docs(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows that pass the policy, with the columns they came with."""
    cols, m = docs.columns, "_measures"
    while m in cols:
        m = "_" + m
    judged = docs.withColumn(m, measures(F.col("text").cast("string")))
    fails = [F.expr(re.sub(r"[a-z]\w+", rf"{m}.\g<0>", rule)) for name, rule in RULES if name in POLICIES[policy]]
    return judged.where(~reduce(Column.__or__, fails)).select(*[F.col(f"`{c}`") for c in cols])
