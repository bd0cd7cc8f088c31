"""The change feed: reading it, and the stages every event passes before apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.documents import encode_document

FEED_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("cluster_time", T.TimestampType()),
        T.StructField("operation_type", T.StringType()),
        T.StructField("document_key", T.StringType()),
        T.StructField("full_document", T.StringType()),
    ]
)

# The operations the mirror follows.
OPERATIONS = ("insert", "update", "delete", "replace")

# Fixed value: how the source words a missing post-image.
MISSING_POST_IMAGE = "post-image was not found"


def read_feed(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The whole feed as a batch."""
    return spark.read.schema(FEED_SCHEMA).format(fmt).load(path)


def stream_feed(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    max_files: int | None = None,
    glob: str | None = None,
) -> DataFrame:
    """The same feed as a stream; position lives in the query's checkpoint."""
    reader = spark.readStream.schema(FEED_SCHEMA).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def keep_operations(feed: DataFrame) -> DataFrame:
    """Drops every event that is not an insert, update, delete or replace."""
    return feed.where(F.col("operation_type").isin(*OPERATIONS))


def select_payload(feed: DataFrame) -> DataFrame:
    """Adds ``payload``: the key alone for a delete, the post-image otherwise."""
    key_only = F.to_json(F.struct(F.col("document_key").alias("_id")))
    return feed.withColumn(
        "payload",
        F.when(F.col("operation_type") == "delete", key_only).otherwise(F.col("full_document")),
    )


def lacks_post_image() -> Column:
    """True for an update whose post-image is absent."""
    return (F.col("operation_type") == "update") & F.col("full_document").isNull()


def post_image_violations(feed: DataFrame) -> DataFrame:
    """The updates that carry no post-image."""
    return feed.where(lacks_post_image())


def require_post_images(feed: DataFrame) -> DataFrame:
    """Fails the job or stream, as it runs, on an update without post-image."""
    message = F.concat(
        F.lit(f"{MISSING_POST_IMAGE}: seq "), F.coalesce(F.col("seq").cast("string"), F.lit("?"))
    )
    return feed.withColumn(
        "full_document",
        F.when(lacks_post_image(), F.raise_error(message).cast("string")).otherwise(
            F.col("full_document")
        ),
    )


def initial_sync(snapshot: DataFrame, before_seq: int, key: str = "_id", at: Column | None = None) -> DataFrame:
    """Existing rows as insert events placed just below the feed.

    The keys of a source are distinct, so the events can share one ``seq``: only
    events of the same key are ever ordered against each other.
    """
    return snapshot.select(
        F.lit(before_seq - 1).cast("bigint").alias("seq"),
        (F.lit(None).cast("timestamp") if at is None else at).alias("cluster_time"),
        F.lit("insert").alias("operation_type"),
        F.col(key).cast("string").alias("document_key"),
        encode_document(snapshot).alias("full_document"),
    )


def sync_then_follow(snapshot: DataFrame, feed: DataFrame, before_seq: int, key: str = "_id") -> DataFrame:
    """Initial sync followed by the incremental feed, as one feed."""
    return initial_sync(snapshot, before_seq, key).unionByName(feed.select(*FEED_SCHEMA.names))
