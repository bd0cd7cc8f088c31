"""How long a write takes to become visible, and how that sums up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.spread import nearest_rank

# A cycle's writes in order.
CYCLE = ("insert", "update", "delete")
TIMEOUT_S = 120.0
# A sample with more than this part of all polls is spread; so there are fewer such samples than that.
PARTS = 1000
SAMPLE = ("sample_id", "op")


def reflects(expected_status: Column) -> Column:
    """Whether a poll shows the write: one row, one row of that status, or no row."""
    return (
        F.when(F.col("op") == "insert", F.col("n_rows") == 1)
        .when(F.col("op") == "update", (F.col("n_rows") == 1) & F.col("status").eqNullSafe(expected_status))
        .when(F.col("op") == "delete", F.col("n_rows") == 0)
        .otherwise(False)
    )


def _hot(counts: DataFrame, parts: int) -> DataFrame:
    """The samples with more than one in ``parts`` of all polls, fewer than ``parts``, and into how many each is cut."""
    share = counts.agg(F.sum("n")).scalar() / F.lit(parts)
    return counts.withColumn("_share", share).where(F.col("n") > F.col("_share")).select(
        *SAMPLE, F.ceil(F.col("n") / F.col("_share")).cast("bigint").alias("_salts")
    )


def _with_group_values(polls: DataFrame, per_group: DataFrame, hot: DataFrame) -> DataFrame:
    """Joins one row per sample onto its polls; the polls of a hot sample are spread, and only its row is copied."""
    salts = F.coalesce("_salts", F.lit(1).cast("bigint"))
    spread = polls.join(F.broadcast(hot), [*SAMPLE], "left").withColumn(
        "_salt", F.pmod(F.xxhash64("poll_start", "poll_end"), salts)
    )
    copies = per_group.join(F.broadcast(hot), [*SAMPLE], "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))
    )
    return spread.drop("_salts").join(copies.drop("_salts"), [*SAMPLE, "_salt"]).drop("_salt")


def propagation(
    polls: DataFrame, expected_status: Column, timeout_s: float = TIMEOUT_S, parts: int = PARTS
) -> DataFrame:
    """First poll of each write that shows it, or the timeout.

    Polls of one sample run one after another.  The last poll that counts is the
    first one that shows the write or ends past the timeout.  Every step is an
    aggregation that combines before its shuffle, so a sample with very many
    polls is never gathered. Polls are counted along with the starts; a sample that holds
    more than one in ``parts`` of them is spread over as many tasks as its share asks for.
    """
    marked = polls.withColumn("hit", reflects(expected_status))
    counts = marked.groupBy(*SAMPLE).agg(F.min("poll_start").alias("start"), F.count(F.lit(1)).alias("n"))
    hot, starts = _hot(counts, parts), counts.drop("n")
    timed = _with_group_values(marked, starts, hot)
    stopping = F.col("hit") | (F.col("poll_end") - F.col("start") >= F.lit(timeout_s))
    stops = timed.groupBy(*SAMPLE).agg(
        F.min("start").alias("start"), F.min(F.when(stopping, F.col("poll_start"))).alias("stop")
    )
    counted = _with_group_values(marked, stops, hot).where(
        F.col("stop").isNull() | (F.col("poll_start") <= F.col("stop"))
    )
    at_stop = F.col("poll_start") == F.col("stop")
    return (
        counted.groupBy(*SAMPLE)
        .agg(
            F.min("start").alias("start"),
            F.coalesce(F.bool_or(at_stop & F.col("hit")), F.lit(False)).alias("ok"),
            F.max(F.when(at_stop, F.col("poll_end"))).alias("_end"),
            F.max(F.when(F.col("poll_start") < F.col("stop"), F.col("poll_start"))).alias("_previous"),
            F.count(F.lit(1)).alias("polls"),
            F.sum("bytes").cast("bigint").alias("bytes"),
        )
        .select(
            *SAMPLE,
            "ok",
            F.when(F.col("ok"), F.round(F.col("_end") - F.col("start"), 2)).alias("visible_s"),
            F.when(
                F.col("ok"), F.round(F.col("_end") - F.coalesce(F.col("_previous"), F.col("start")), 2)
            ).alias("window_s"),
            F.when(~F.col("ok"), F.round(F.col("_end") - F.col("start"), 2)).alias("waited_s"),
            "polls",
            "bytes",
        )
    )


def cycle_steps(results: DataFrame) -> DataFrame:
    """The steps a cycle reached: after the first timeout nothing is attempted.

    A sample has at most three steps, so its window is three rows.
    """
    step = F.array_position(F.array(*[F.lit(op) for op in CYCLE]), F.col("op"))
    earlier = (
        Window.partitionBy("sample_id").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        results.withColumn("_step", step)
        .withColumn("_fine", F.coalesce(F.min("ok").over(earlier), F.lit(True)))
        .where("_fine")
        .drop("_step", "_fine")
    )


def latency_summary(samples: DataFrame, digits: int = 2) -> DataFrame:
    """n, converged, timeouts, p50, p95, max, mean and bytes per operation.

    ``samples`` has op, ok, visible_s, bytes.  A percentile is an actual sample.
    """
    scale = F.lit(float(10**digits)).cast("double")
    seen = samples.where("ok").select("op", F.bround(F.col("visible_s") * scale, 0).cast("bigint").alias("ticks"))
    ranks = nearest_rank(seen, "op", "ticks", {"p50": 0.50, "p95": 0.95})
    visible = F.when(F.col("ok"), F.col("visible_s"))
    totals = samples.groupBy("op").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("ok")).alias("converged"),
        F.count_if(~F.col("ok")).alias("timeouts"),
        F.round(F.max(visible), digits).alias("max"),
        F.round(F.avg(visible), digits).alias("mean"),
        F.sum("bytes").cast("bigint").alias("bytes"),
    )
    return totals.join(ranks, "op", "left").select(
        "op",
        "n",
        "converged",
        "timeouts",
        (F.col("p50") / scale).alias("p50"),
        (F.col("p95") / scale).alias("p95"),
        "max",
        "mean",
        "bytes",
    )


def commit_latency(feed: DataFrame, commits: DataFrame) -> DataFrame:
    """Milliseconds from each event's write to the commit that made it visible."""
    joined = feed.join(commits.select("commit_id", "committed_at"), "commit_id")
    micros = F.timestamp_diff("MICROSECOND", F.col("cluster_time"), F.col("committed_at"))
    return joined.select(
        F.col("operation_type").alias("op"),
        F.lit(True).alias("ok"),
        (micros.cast("double") / F.lit(1000.0).cast("double")).alias("visible_s"),
        F.lit(0).cast("bigint").alias("bytes"),
    )
