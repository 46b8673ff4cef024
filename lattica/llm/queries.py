"""One query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, lm_mixing, minhash_dedup, packing, quality_classifier, quality_rules, suffix_dedup, toxicity, vp_ann, warc
from .oracle import ORACLE_SQL  # noqa: F401
from .shared import table

#: Pruning factor of the vector search (1: exact).
ANN_FACTOR = 1.0


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), "v1")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tok

    return bpe.encode_documents(table(spark, sf_dir, "documents"), tok.path("byte_bpe_multi_50k.tiktoken"), tok.PATTERN)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tok

    return packing.pack_documents(table(spark, sf_dir, "documents"), tok.path("byte_bpe_50k.json"), tok.PATTERN)


def _fold(n: int):
    """Remainder of the id's checksum, which says what is held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op7_lm_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lm_mixing.score(table(spark, sf_dir, "documents"), _fold(7) != 2)
    return rows.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(_fold(4) != 2).select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model, 0.3).select("doc_id", F.coalesce(_fold(4) == 2, F.lit(True)).alias("held_out"), "score", "predicted", "n_segments")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op10_vp_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_ann.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20, factor=ANN_FACTOR)


QUERIES = {"op1_minhash_dedup": op1_minhash_dedup, "op2_quality_classifier": op2_quality_classifier, "op3_quality_rules": op3_quality_rules, "op4_warc": op4_warc, "op5_byte_bpe": op5_byte_bpe, "op6_packing": op6_packing, "op7_lm_mixing": op7_lm_mixing, "op8_toxicity": op8_toxicity, "op9_suffix_dedup": op9_suffix_dedup, "op10_vp_ann": op10_vp_ann}

