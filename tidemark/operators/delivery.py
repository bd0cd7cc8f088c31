"""Proofs about delivery: order, exactly-once resume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.spread import WIDTH, previous_in_group
from tidemark.operators.apply import latest


def time_reversals(feed: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per key: events seen, and how often ``cluster_time`` stepped back from one to the next."""
    rows = feed.select("document_key", "seq", "cluster_time")
    stepped = previous_in_group(rows, ["document_key"], "seq", F.col("cluster_time"), "_earlier", width)
    return stepped.groupBy("document_key").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("cluster_time") < F.col("_earlier")).alias("reversals"),
    )


def ordering_check(feed: DataFrame, final: DataFrame, expected: DataFrame | None = None, width: int = WIDTH) -> DataFrame:
    """Per key: time never goes back, all events came, the last post-image is the final document.

    ``final`` has document_key and full_document; ``expected`` document_key and
    expected_events, without which any count is accepted.
    """
    last = latest(feed.select("document_key", "seq", "full_document"), ["document_key"]).select(
        "document_key", F.col("full_document").alias("_last")
    )
    ends = final.select("document_key", F.col("full_document").alias("_final"))
    checked = time_reversals(feed, width).join(last, "document_key").join(ends, "document_key", "left")
    wanted = F.col("events")
    if expected is not None:
        checked = checked.join(expected.select("document_key", "expected_events"), "document_key", "left")
        wanted = F.coalesce(F.col("expected_events"), F.lit(0))
    monotonic = F.col("reversals") == 0
    equal = F.col("_last").eqNullSafe(F.col("_final"))
    return checked.select(
        "document_key",
        "events",
        monotonic.alias("cluster_time_monotonic"),
        equal.alias("last_event_equals_final"),
        ((F.col("events") == wanted) & monotonic & equal).alias("ok"),
    )


def ordering_summary(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count(F.lit(1)).alias("keys"),
        F.sum("events").cast("bigint").alias("events"),
        F.count_if(~F.col("cluster_time_monotonic")).alias("out_of_order_keys"),
        F.count_if(~F.col("last_event_equals_final")).alias("unequal_keys"),
        F.bool_and("ok").alias("ok"),
    )


def _compared(expected: DataFrame, delivered: DataFrame) -> DataFrame:
    """One row: how many were expected and delivered, and how many were not where they belong."""
    sides = expected.select("position", F.col("id").alias("_want"), F.lit(True).alias("_w")).join(
        delivered.select("position", F.col("id").alias("_got"), F.lit(True).alias("_g")), "position", "full_outer"
    )
    return sides.agg(
        F.count("_w").alias("expected"),
        F.count("_g").alias("delivered"),
        F.count_if(F.col("_w") & ~(F.coalesce(F.col("_g"), F.lit(False)) & F.col("_want").eqNullSafe(F.col("_got")))).alias(
            "misplaced"
        ),
    )


def exactly_once(
    expected: DataFrame, delivered: DataFrame, seen_before: DataFrame, expected_before: DataFrame
) -> DataFrame:
    """Compares what a consumer got, up to its break and after it, with what it should have.

    All have position (0-based) and id. ``before`` tells that the first part came as
    expected; ``ok`` that both did and that nothing came besides.
    """
    compared = _compared(expected, delivered)
    first = _compared(expected_before, seen_before)
    fine = first.select((F.col("misplaced") == 0) & (F.col("delivered") == F.col("expected"))).scalar()
    per_id = delivered.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    seen = seen_before.select("id", F.lit(1).alias("_seen")).dropDuplicates(["id"])
    repeats = (
        per_id.join(seen, "id", "left")
        .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)) + F.count("_seen"))
        .scalar()
    )
    return compared.select(
        "expected",
        "delivered",
        (F.col("misplaced") == 0).alias("missed_delivered"),
        repeats.cast("bigint").alias("duplicates"),
        F.greatest(F.lit(0), F.col("delivered") - F.col("expected")).cast("bigint").alias("extra"),
        fine.alias("before"),
        (fine & (F.col("misplaced") == 0) & (F.col("delivered") == F.col("expected"))).alias("ok"),
    )
