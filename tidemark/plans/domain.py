"""The given tables seen as the engine's domain: orders, products, a change feed.

Everything here is lazy and reads whole tables; Spark prunes the columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_ONE = "2024-01-01"
LOST_IMAGE_BELOW = 5
TEXT_AMOUNT_FROM = 80
CANCELLED_STATUS = "F"
APP_CHANNEL = "1-URGENT"


# The given tables' columns; with them known, no job reads footers to find out.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's region.

    Spark broadcasts nation and region by their size; the customer side is
    broadcast or shuffled as its size says.
    """
    places = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "r_name")
    )
    return (
        table(spark, sf_dir, "orders")
        .join(places, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").cast("string").alias("_id"),
            F.col("r_name").alias("region"),
            F.col("o_totalprice").alias("amount"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderpriority").alias("channel"),
            F.col("o_orderdate").alias("orderdate"),
        )
    )


def plain_orders(spark: SparkSession, sf_dir: str, key: int | None = None) -> DataFrame:
    """Orders alone, for what needs no region; of one key only, if given."""
    source = table(spark, sf_dir, "orders")
    if key is not None:
        source = source.where(F.col("o_orderkey") == F.lit(key))
    return source.select(
        F.col("o_orderkey").cast("string").alias("_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("channel"),
        F.col("o_orderdate").alias("orderdate"),
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their brand as the product."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("product"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("amount"),
    )


def _operation() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind == "signup", "insert")
        .when(kind.isin("purchase", "click"), "update")
        .when(kind == "error", "delete")
        .otherwise(kind)
    )


def _document(amount: Column, extra: Column | None = None) -> Column:
    parts = [
        F.lit('{"_id":"'),
        F.col("user_id").cast("string"),
        F.lit('","amount":'),
        amount,
        F.lit(',"kind":"'),
        F.col("event_type"),
        F.lit('","props":'),
        F.col("props"),
    ]
    return F.concat(*parts, *([extra] if extra is not None else []), F.lit("}"))


def feed(
    spark: SparkSession,
    sf_dir: str,
    lost_images: bool = False,
    mixed_types: bool = False,
    late_field: bool = False,
    key: int | None = None,
) -> DataFrame:
    """The events table as a change feed, with ``commit_id`` one per day.

    Options give the feed the defects the engine handles, derived from the rows'
    own values: updates of small value without post-image, amounts written as text
    or as decimal, and a field that appears from day 11 on. ``key`` gives the events of
    one key alone, by a predicate that the scan sees.
    """
    value = F.col("value").cast("string")
    amount = value
    if mixed_types:
        amount = (
            F.when(F.col("value") >= TEXT_AMOUNT_FROM, F.concat(F.lit('"'), value, F.lit('"')))
            .when(F.col("value") < LOST_IMAGE_BELOW, F.concat(F.lit('{"$numberDecimal":"'), value, F.lit('"}')))
            .otherwise(value)
        )
    day = (F.date_diff(F.col("ts"), F.lit(DAY_ONE)) + 1).cast("bigint")
    bonus = F.when(day > 10, F.concat(F.lit(',"bonus":'), value)).otherwise("") if late_field else None
    operation = _operation()
    absent = operation == "delete"
    if lost_images:
        absent = absent | ((operation == "update") & (F.col("value") < LOST_IMAGE_BELOW))
    source = table(spark, sf_dir, "events")
    if key is not None:
        source = source.where(F.col("user_id") == F.lit(key))
    return source.select(
        F.col("event_id").alias("seq"),
        F.col("ts").alias("cluster_time"),
        operation.alias("operation_type"),
        F.col("user_id").cast("string").alias("document_key"),
        F.when(~absent, _document(amount, bonus)).alias("full_document"),
        day.alias("commit_id"),
        F.col("value").alias("amount"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed's kept events as typed change rows with their commit."""
    from tidemark.operators.apply import to_changes
    from tidemark.sources.feed import keep_operations

    return to_changes(keep_operations(feed(spark, sf_dir)), "commit_id", "amount", "k")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit per day, committed when the day's last event came."""
    return (
        feed(spark, sf_dir)
        .groupBy("commit_id")
        .agg(F.max("cluster_time").alias("committed_at"))
    )


def poll_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as one poll of its user's sample; ten days per operation."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    start = micros.cast("double") / F.lit(1e6)
    day = F.dayofmonth("ts")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("sample_id"),
        F.when(day <= 10, "insert").when(day <= 20, "update").otherwise("delete").alias("op"),
        start.alias("poll_start"),
        (start + F.col("value") / F.lit(100.0).cast("double")).alias("poll_end"),
        F.when(F.col("event_type").isin("purchase", "click"), 1).otherwise(0).cast("bigint").alias("n_rows"),
        F.col("event_type").alias("status"),
        F.get_json_object("props", "$.k").cast("bigint").alias("bytes"),
    )
