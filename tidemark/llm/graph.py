"""Connected components of a graph given as an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir

MAX_ROUNDS = 60


def kept(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: a cut of lineage that outlives any executor."""
    path = shared_dir(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """id, label (the smallest id of its component) for every end of an edge (a, b).

    Each round ties every node to the least of its neighbours, first the larger
    neighbours and then the smaller; the number of edges never grows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = kept(spark, e, "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        seen = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = kept(spark, small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("label"))
    return stars.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
