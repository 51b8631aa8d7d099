"""Quality rules with a bitmask ledger.

The ledger is made once: for each document its measurements and one long whose bit i is
set if rule i fails. Policies are versioned masks over those bits, so a new policy or an
ablation reads the ledger and never the texts.

Null and empty texts measure 0 everywhere (and fail the `short` rule). Rows that repeat are
measured each on their own, also in a tie. doc_id may be null; an empty table gives no rows;
the ledger reads no other columns, whatever their names. Equal lines and words are equal byte
by byte. A text is held whole, with some 30 bytes for each of its own and no limit on its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbatch as tb
from .workers import by_batch, numbered

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

#: Rules in the order of their bits: name and the condition under which a document fails, in whole numbers.
RULES = [
    ("short", "n_words < 50"),
    ("repetitive", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    ("dup_lines", "100 * n_dup_lines > 30 * n_lines"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Versions of the policy: the rules whose failure rejects a document.
POLICIES = {
    "base": BIT["short"] | BIT["repetitive"],
    "v1": BIT["short"] | BIT["repetitive"] | BIT["symbols"] | BIT["word_length"] | BIT["dup_lines"],
}

_SYMBOL = np.zeros(256, np.int8)
_SYMBOL[list(b"#*$%&|<>")] = 1
_HEAD = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair, the same for equal pairs alone."""
    _, number = np.unique(a * (b.max(initial=0) + 1) + b, return_inverse=True)
    return number


def measure(texts: tb.Texts) -> dict[str, np.ndarray]:
    data = texts.data
    start, end, of = texts.words()
    out = {"n_words": np.bincount(of, minlength=texts.n), "word_chars": texts.sums(_HEAD[data] & ~tb.SPACE[data]), "n_symbols": texts.sums(_SYMBOL[data])}
    first, last = texts.runs(data != 10)
    line_of = texts.of(first)
    filled = np.searchsorted(start, last) > np.searchsorted(start, first)
    first, last, line_of = first[filled], last[filled], line_of[filled]
    out["n_lines"] = np.bincount(line_of, minlength=texts.n)
    _, line = texts.kinds(first, last)
    _, kept = np.unique(line * texts.n + line_of, return_index=True)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_of[kept], minlength=texts.n)

    covered = np.zeros(len(of), bool)
    if len(of) >= 3:
        _, word = texts.kinds(start, end)
        at = np.flatnonzero(of[2:] == of[:-2])
        three = _joined(_joined(_joined(word[at], word[at + 1]), word[at + 2]), of[at])
        at = at[np.bincount(three)[three] > 1]
        for j in range(3):
            covered[at + j] = True
    out["n_repeat_words"] = np.bincount(of[covered], minlength=texts.n)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in tb.pieces(batch.column("text")):
            found = measure(texts)
            rows = batch.slice(a, b - a)
            columns = [rows.column(c) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(found[c], pa.int64()) for c in MEASURES)], [*(c for c in batch.schema.names if c != "text"), *MEASURES])


def failures(rules: list[tuple[str, str]] = RULES) -> Column:
    """The mask of the failed rules, from the measurements."""
    return sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, rule) in enumerate(rules)), F.lit(0).cast("long"))


def ledger(docs: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """doc_id, the measurements and `failed`, the mask of failed rules, of each row of docs."""
    made = by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _measured, "doc_id long, " + ", ".join(f"{c} long" for c in MEASURES))
    return made.withColumn("failed", failures(rules))


def passes(policy: str = "v1", failed: str = "failed") -> Column:
    """Whether a row of the ledger is kept under a policy."""
    return F.col(failed).bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(made: DataFrame, policy: str = "v1", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """What each rule of a policy does: rule, n_failed, n_only (rejected by it alone), n_kept_without.

    The ledger is first counted by mask (2**rules rows at most); the rest is bit arithmetic on those counts.
    """
    mask = POLICIES[policy]
    counts = made.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("failed")).agg(F.count("*").alias("n"))
    table = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(rules) if mask >> i & 1]))
    each = counts.select("failed", "n", table.alias("r")).select("failed", "n", "r.*")
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    rest = F.col("failed").bitwiseAND(F.bitwise_not("bit"))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(total(hit).alias("n_failed"), total(hit & (rest == 0)).alias("n_only"), total(rest == 0).alias("n_kept_without"))


def accepted(docs: DataFrame, policy: str = "v1", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """The rows of docs that a policy keeps, with the columns of docs: one pass, no shuffle.

    The ledger's mask stands beside each row until the policy has read it. Columns of docs
    may have any name; more than one `text` is an error.
    """
    names = docs.columns
    text = names.index("text")
    rows, place = numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in tb.pieces(batch.column(text)):
                found = measure(texts)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *(pa.array(found[c], pa.int64()) for c in MEASURES)], [*place, *MEASURES])

    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in MEASURES)])
    made = by_batch(rows, run, schema).withColumn("failed", failures(rules))
    return made.where(passes(policy)).select(*place).toDF(*names)
