"""Exact dedup: groups of texts that are equal once A-Z is lower-cased.

Texts meet by a 128-bit hash. Which hashes occur twice is counted on hashes alone;
a blocked Bloom filter of those, of bounded size, keeps all other texts out of every
shuffle. The texts of shared hashes are grouped by hash *and* bytes, so that a
collision parts again. Aggregates run per task before the shuffle and the join back
is one that adaptive execution splits, so a text that makes up a third of all rows
is no hot group.

Defined results: NULL and empty texts are equal to each other. Rows that repeat both
id and text are one document and share its verdict. A NULL id never beats another;
a group of NULL ids alone keeps them. An empty table gives no rows. Other columns
of the input never meet the operator's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.native import bloom, hash128, lower_az, probed, renamed


def exact_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """Per row: doc_id, keep_id (of the row that stays), group_size, kept, text_sha256. ``keep``: largest or smallest id."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    best = F.max if keep == "largest" else F.min
    rows = renamed(docs, doc_id=doc_id, text=text).select("doc_id", lower_az(F.coalesce("text", F.lit(""))).alias("text"))
    rows = rows.withColumn("hash", hash128(F.col("text")))
    shared = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    marked = probed(rows, F.col("hash"), bloom(shared, F.col("hash")), "maybe")
    sha = F.sha2("text", 256).alias("text_sha256")
    alone = marked.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), sha)
    copies = marked.where("maybe")
    groups = copies.groupBy("hash", "text").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    met = copies.join(groups, ["hash", "text"]).select("doc_id", "keep_id", "group_size", sha)
    return alone.unionByName(met).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""
