"""Is the mirror right, and is it safe: convergence, duplicates, lag, preflight."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import cut, redact
from tidemark.operators.changes import reconcile_unequal
from tidemark.operators.digests import BUCKETS
from tidemark.operators.reports import key_counts
from tidemark.sources.feed import post_image_violations

# The states the monitoring shows.
CONVERGED = "convergido"
DUPLICATED = "tabela duplicada"
PROPAGATING = "propagando"
DIVERGENT = "divergente"
OFFLINE = "iceberg offline"

LAG_UNKNOWN = "desconhecido"
LAG_LOST = "critico"
LAG_WARNING = "alerta"
LAG_OK = "ok"
LAG_SAFE_SHARE = 0.2

OK, WARNING, FAILED = "ok", "alerta", "falha"
MODE_FULL = "completo"
MODE_SOURCE_ONLY = "somente_mongodb"
MODE_FAILED = "com_falha"
SOURCE_MISSING = "the collection does not exist"
LAKE_MISSING = "the table does not exist"
NOT_THERE = ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND")
DETAIL_LIMIT = 200


def convergence_state(source_total: Column, lake_total: Column, lake_distinct: Column) -> Column:
    """One of five states from three counts; NULL lake counts mean it is offline."""
    return (
        F.when(lake_total.isNull(), OFFLINE)
        .when((lake_total == source_total) & (lake_distinct == source_total), CONVERGED)
        .when(lake_total > lake_distinct, DUPLICATED)
        .when(lake_total != source_total, PROPAGATING)
        .otherwise(DIVERGENT)
    )


def convergence(source: DataFrame, lake: DataFrame | None, key: str = "_id") -> DataFrame:
    """Source and lake counts side by side with the state they add up to."""
    total = source.agg(F.count(F.lit(1)).alias("origem_total"))
    if lake is None:
        nothing = F.lit(None).cast("bigint")
        both = total.withColumns({"lake_total": nothing, "lake_distintos": nothing})
    else:
        counts = key_counts(lake, key).select(F.struct("total", "distintos")).scalar()
        both = total.withColumn("_lake", counts).select(
            "origem_total",
            F.col("_lake.total").alias("lake_total"),
            F.col("_lake.distintos").alias("lake_distintos"),
        )
    return both.withColumn(
        "estado", convergence_state(F.col("origem_total"), F.col("lake_total"), F.col("lake_distintos"))
    )


def content_convergence(
    source: DataFrame, lake: DataFrame | None, key: str = "_id", buckets: int = BUCKETS
) -> DataFrame:
    """:func:`convergence`, and how many keys are missing, extra or hold other fields.

    Tables of equal counts whose rows differ are ``divergente``. Rows are compared in those
    buckets of keys alone whose digests differ; of a table that holds a key twice the counts speak.
    """
    counted = convergence(source, lake, key)
    none = F.lit(None).cast("bigint")
    if lake is None:
        return counted.withColumns({"faltando": none, "sobrando": none, "diferentes": none})
    found = reconcile_unequal(lake, source, key, buckets).agg(
        F.count_if(F.col("action") == "insert").alias("faltando"),
        F.count_if(F.col("action") == "delete").alias("sobrando"),
        F.count_if(F.col("action") == "replace").alias("diferentes"),
    )
    both = counted.withColumn("_found", found.select(F.struct(*found.columns)).scalar())
    unlike = F.col("_found.faltando") + F.col("_found.sobrando") + F.col("_found.diferentes") > 0
    return both.select(
        "origem_total", "lake_total", "lake_distintos",
        F.when((F.col("estado") == CONVERGED) & unlike, DIVERGENT).otherwise(F.col("estado")).alias("estado"),
        "_found.faltando", "_found.sobrando", "_found.diferentes",
    )


def duplicates(table: DataFrame, key: str = "_id") -> DataFrame:
    """Keys held by more than one row."""
    return (
        table.groupBy(key)
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )


def _seconds_between(later: Column, earlier: Column) -> Column:
    """Difference of two timestamps, with or without zone, as seconds."""
    micros = F.timestamp_diff("MICROSECOND", earlier, later)
    return micros.cast("double") / F.lit(1_000_000.0).cast("double")


def lag_state(positions: DataFrame) -> DataFrame:
    """Adds margin, window and state to rows of checkpoint, feed_start, feed_end."""
    margin = _seconds_between(F.col("checkpoint"), F.col("feed_start"))
    window = _seconds_between(F.col("feed_end"), F.col("feed_start"))
    share_small = (window <= 0) | (F.try_divide(margin, window) < LAG_SAFE_SHARE)
    return positions.withColumns(
        {
            "margem_segundos": F.round(margin, 1),
            "janela_segundos": F.round(window, 1),
            "estado": F.when(F.col("checkpoint").isNull(), LAG_UNKNOWN)
            .when(F.col("checkpoint") < F.col("feed_start"), LAG_LOST)
            .when(share_small, LAG_WARNING)
            .otherwise(LAG_OK),
        }
    )


def feed_lag(feed: DataFrame, committed: DataFrame) -> DataFrame:
    """Lag of a mirror: last committed ``cluster_time`` against the retained feed."""
    checkpoint = committed.agg(F.max("cluster_time")).scalar()
    window = feed.agg(F.min("cluster_time").alias("feed_start"), F.max("cluster_time").alias("feed_end"))
    return lag_state(window.select(checkpoint.alias("checkpoint"), "feed_start", "feed_end"))


Opened = DataFrame | Callable[[], DataFrame] | None


def look(opened: Opened) -> tuple[DataFrame | None, str | None, bool]:
    """The frame, if a row of it can be read or it is empty; else why not, and whether it is not there at all.

    A callable opens what it returns only now, so a table that is gone is found here.
    """
    if opened is None:
        return None, "unreadable", False
    try:
        frame = opened() if callable(opened) else opened
        frame.take(1)
    except AnalysisException as error:
        return None, str(error), error.getCondition() in NOT_THERE
    except Exception as error:  # noqa: BLE001 -- whatever a reader raises, the check says so
        return None, str(error), False
    return frame, None, False


def preflight_checks(spark: SparkSession, feed: Opened, dlq: Opened, lake: Opened) -> DataFrame:
    """One row per check: item, state, detail. Source, queue and lake are opened and read.

    A lost connection to the source ends the checks; a source that does not exist fails, and
    the others are still looked at. Error texts are redacted and cut.
    """

    def fixed(item: str, state: str, error: str | None = None) -> DataFrame:
        detail = cut(redact(F.lit(error).cast("string")), DETAIL_LIMIT)
        return spark.range(1).select(F.lit(item).alias("item"), F.lit(state).alias("estado"), detail.alias("detalhe"))

    events, error, missing = look(feed)
    if events is None and not missing:
        return fixed("source", FAILED, error)
    found = fixed("source", OK)
    if events is None:
        found = fixed("source", FAILED, SOURCE_MISSING)
    else:
        broken = F.count(F.lit(1))
        found = found.unionByName(
            post_image_violations(events).agg(
                F.lit("post-images").alias("item"),
                F.when(broken == 0, OK).otherwise(FAILED).alias("estado"),
                F.when(broken > 0, F.concat(broken.cast("string"), F.lit(" update(s) without post-image"))).alias("detalhe"),
            )
        )
    rejected, error, _ = look(dlq)
    if rejected is None:
        found = found.unionByName(fixed("dead-letter queue", FAILED, error))
    else:
        queued = F.count(F.lit(1))
        found = found.unionByName(
            rejected.agg(
                F.lit("dead-letter queue").alias("item"),
                F.when(queued == 0, OK).otherwise(WARNING).alias("estado"),
                F.when(queued > 0, F.concat(queued.cast("string"), F.lit(" documento(s) rejeitado(s)"))).alias("detalhe"),
            )
        )
    _, error, missing = look(lake)
    reachable = fixed("lake", OK) if error is None else fixed("lake", WARNING, LAKE_MISSING if missing else error)
    return found.unionByName(reachable)


def preflight_verdict(checks: DataFrame) -> DataFrame:
    """``ok`` speaks of the source alone; the mode says whether the whole circuit stands.

    A filled dead-letter queue sets ``avisos`` and leaves ``ok`` alone.
    """
    ok = F.count_if(F.col("estado") == FAILED) == 0
    lake_up = F.count_if((F.col("item") == "lake") & (F.col("estado") == OK)) > 0
    return checks.agg(
        ok.alias("ok"),
        F.when(ok & lake_up, MODE_FULL).when(ok, MODE_SOURCE_ONLY).otherwise(MODE_FAILED).alias("modo"),
        (F.count_if(F.col("estado") == WARNING) > 0).alias("avisos"),
    )
