"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every
stage's result as a table in the shared folder, from which the next one reads. All
stages but the last return the columns of ``documents``. No SQL states the quality
rules' estimates or the n-gram groups, so there is no oracle; the stages are tested
against brute force one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, mixing, ngram_join, quality_rules, sentencepiece_codec
from tidemark.llm.graph import kept


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the simple limits or lie outside their group go."""
    return quality_rules.without_rejected(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; ``n_chars`` follows the text."""
    done = line_dedup.without_frequent_lines(docs)
    return done.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest id stays."""
    return ngram_join.first_of_each_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of their blocks' slots."""
    return mixing.in_mixed_order(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, slot, n_tokens, ids. Rows in order of ``slot`` are the mix; readers do not keep the order of files.

    Rows that share id and source take their slots by text length, as the mix numbers them.
    """
    size, hash_ = F.char_length(F.coalesce("text", F.lit(""))).alias("chars"), F.xxhash64("text").alias("hash")
    done = sentencepiece_codec.encoded(docs.select("doc_id", "lang", "source", size, hash_, "text"), keep_text=False)
    done = done.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "source").orderBy("chars", "hash")))
    slots = mixing.mixed(docs).select(
        F.col("doc_id").alias("id"), F.col("source").alias("of"), "slot",
        F.row_number().over(Window.partitionBy("doc_id", "source").orderBy("slot")).alias("place"),
    )
    done = done.join(slots, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("of")) & (F.col("nth") == F.col("place")))
    return done.select("doc_id", "lang", "source", "slot", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_join", near_copies),
    ("source_mixing", mix),
    ("sentencepiece", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
