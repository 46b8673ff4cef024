"""The training-corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared folder and reads it again as the next stage's
documents.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import minhash_dedup, packing, quality_classifier, quality_rules, suffix_dedup
from lattica.llm.shared import fresh_path, owned

# A stage begins once the output of the one before is written, so it first removes the intermediate tables behind that.

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have fewer than ten words and go; repeated rows and rows without an id are judged one by one; an empty table stays empty.
    """
    return quality_rules.keep(docs, "v1").select(*COLUMNS)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps.

    Null and empty texts score 0 and go; repeated rows and rows without an id are judged one by one; an empty table stays empty.
    """
    return quality_classifier.keep(docs).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the least id.

    Different texts that share an id are documents of their own here, and so are texts without an id; all but one text
    of an id and those without one come after all others, so they are kept only if no other document of their class is.
    Rows equal in id and text count once, as do rows without an id and with the same text.
    """
    with owned(spark, "pipeline"):
        nodes = minhash_dedup.with_nodes(docs)
        classes = minhash_dedup.near_duplicates(nodes.select(F.col("node").alias("doc_id"), "text"), 0.8)
    first = classes.filter("doc_id = class_id").select(F.col("doc_id").alias("node")).distinct()
    return nodes.join(first, "node", "left_semi").dropDuplicates(["node"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes or more that a document with a smaller id has; emptied documents go.

    Rows without an id keep their texts; a character that a cut splits goes whole.
    """
    with owned(spark, "pipeline"):
        cut = suffix_dedup.without_repeats(docs)
    return cut.filter(F.length("text") > 0).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 1024 ids.

    Every row that is left is packed, also one without an id; an empty table gives no pieces.
    """
    import public_tokenizers as tok

    with owned(spark, "pipeline"):
        return packing.pack_documents(docs, tok.path("byte_bpe_50k.json"), tok.PATTERN)


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("minhash_dedup", near_duplicates), ("suffix_dedup", repeated_passages), ("packing", packed)]

#: No stage but the first can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
