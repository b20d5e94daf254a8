"""The corpus pipeline: quality rules, quality classifier, SimHash near-dedup, packing.

Each stage reads what its predecessor wrote. All but the last return the columns of
``documents``; the rules also take lines over their limit out of the texts they keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast.llm import near_text, packing, quality_classifier, quality_rules
from fieldcast.llm.common import materialize


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the rules reject and lines that are boilerplate of their source.

    Rows are judged one by one, so null and repeated ids are fine; null texts go.
    """
    kept = quality_rules.keep_good(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose chance of the top grade is below a half, and those without a word.

    Rows are judged by their texts alone, so null and repeated ids are fine.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    graded = labels.select("doc_id", quality_classifier.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    return quality_classifier.keep_good(docs, quality_classifier.train(docs, graded))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies: the smallest id, null last.

    Rows are told apart by where they lie, not by their ids: a null or repeated id never
    takes a different text out. Null texts are one group of copies; an empty table stays so.
    """
    return near_text.keep_one(docs).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("simhash_near_dedup", near_dedup), ("best_fit_packing", pack)]

#: No SQL expresses the fitted classifier, the trie join or the packing; the tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
