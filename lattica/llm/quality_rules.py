"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps a bit per failed
rule and the measurements behind it.  Policies are versioned sets of rule bits
applied to the stored ledger, and ablations are counted from the distinct
bitmasks (at most 2**rules rows) by bitwise aggregation, so neither reads the
texts again.

Defined results: a null text has no words; an empty text fails ``few_words``;
repeated rows are judged one by one; an empty table gives an empty ledger.
Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .textblock import LEAD, SPACE, TextBlock, chunks, first_in_group, mix, windows

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BANG = np.zeros(256, bool)
_BANG[[ord("!"), ord("?")]] = True

#: Bit of each rule in ``fail_bits``; the order is part of the stored format.
RULES = ("few_words", "repeated_words", "symbol_words", "upper_case", "exclaimed", "digits", "duplicate_lines", "long_words", "short_words")
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE_BITS = BIT["few_words"] | BIT["repeated_words"]
#: Versioned policies: a document is kept if it fails none of the policy's rules.
POLICIES = {
    "v1": BASE_BITS | BIT["symbol_words"] | BIT["upper_case"] | BIT["exclaimed"],
    "v2": BASE_BITS | BIT["symbol_words"] | BIT["upper_case"] | BIT["exclaimed"] | BIT["digits"] | BIT["duplicate_lines"] | BIT["long_words"] | BIT["short_words"],
}

LEDGER = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_letters long, n_bangs long, n_digits long, n_lines long, fail_bits long"


def measure(block: TextBlock) -> dict[str, np.ndarray]:
    """The base measurements and those of the further rules, one entry per text."""
    start, end, first = block.words()
    n_words = np.diff(first)
    d = block.data
    out = {
        "n_words": n_words,
        "word_chars": block.sums(LEAD[d] & ~SPACE[d]),
        "n_symbols": block.sums(_SYMBOL[d]),
        "n_upper": block.sums(_UPPER[d]),
        "n_letters": block.sums(_LETTER[d]),
        "n_bangs": block.sums(_BANG[d]),
        "n_digits": block.sums(_DIGIT[d]),
    }
    # lines with a word, equal to an earlier line of the same text
    ls, le, owner = block.lines()
    words_before = np.searchsorted(start, np.stack([ls, le]))
    live = words_before[1] > words_before[0]
    ls, le, owner = ls[live], le[live], owner[live]
    out["n_lines"] = np.bincount(owner, minlength=block.n)
    order, new = first_in_group(mix(block.hash_ranges(ls, le) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    out["n_dup_lines"] = np.bincount(owner[order[~new]], minlength=block.n)
    # words covered by 5-word windows found twice or more in their text
    h, at = windows(block.word_hashes(), first, 5)
    doc = np.repeat(np.arange(block.n), n_words)
    order, new = first_in_group(mix(h + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    twice = ~new
    twice[:-1] |= ~new[1:]
    edge = np.zeros(len(start) + 6, np.int64)
    hits = at[order[twice]]
    edge[hits] += 1
    edge[hits + 5] -= 1
    covered = np.cumsum(edge)[: len(start)] > 0
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=block.n)
    return out


def fail_bits(m: dict[str, np.ndarray]) -> np.ndarray:
    n = m["n_words"]
    failed = {
        "few_words": n < 10,
        "repeated_words": 100 * m["n_repeat_words"] > 20 * n,
        "symbol_words": 100 * m["n_symbols"] > 25 * n,
        "upper_case": (100 * m["n_upper"] > 60 * m["n_letters"]) & (m["n_letters"] >= 20),
        "exclaimed": 100 * m["n_bangs"] > 60 * n,
        "digits": 100 * m["n_digits"] > 40 * np.maximum(m["word_chars"], 1),
        "duplicate_lines": 100 * m["n_dup_lines"] > 60 * np.maximum(m["n_lines"], 1),
        "long_words": m["word_chars"] > 25 * np.maximum(n, 1),
        "short_words": (m["word_chars"] < 2 * n) & (n > 0),
    }
    bits = np.zeros(len(n), np.int64)
    for name in RULES:
        bits |= np.where(failed[name], BIT[name], 0)
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: measurements and ``fail_bits``.  No shuffle; texts pass once, in blocks of bounded size."""
    names = [f.split()[0] for f in LEDGER.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            m = measure(TextBlock.from_arrow(part.column(1)))
            m["fail_bits"] = fail_bits(m)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(m[c].astype(np.int64)) for c in names[1:])], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, LEDGER)


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Adds ``base_failed`` and ``kept`` from the stored bits alone."""
    mask = POLICIES[policy]
    return rows.withColumns({"base_failed": F.col("fail_bits").bitwiseAND(F.lit(BASE_BITS)) != 0, "kept": F.col("fail_bits").bitwiseAND(F.lit(mask | BASE_BITS)) == 0})


def with_bits(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the ledger's ``fail_bits`` as a further column ``name``; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            bits = fail_bits(measure(TextBlock.from_arrow(part.column(part.schema.get_field_index("text")))))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(bits)], [*part.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def keep(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of ``docs`` that the policy keeps by their ledger bits, all columns; no shuffle."""
    name = "fail_bits"
    while name in docs.columns:
        name += "_"
    return with_bits(docs, name).filter(F.col(name).bitwiseAND(F.lit(POLICIES[policy] | BASE_BITS)) == 0).drop(name)


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and that would be kept without it."""
    mask = POLICIES[policy]
    masks = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit")) for r, b in BIT.items() if b & mask))
    e = masks.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    return e.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
