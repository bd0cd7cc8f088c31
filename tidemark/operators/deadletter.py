"""Looking into the dead-letter queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLES = 3
LATEST = 5


def _document_id() -> Column:
    return F.coalesce(F.get_json_object("doc", "$._id"), F.lit("?"))


def _reason() -> Column:
    return F.coalesce(F.col("err_info.reason"), F.lit("unknown"))


def queued(dlq: DataFrame) -> DataFrame:
    return dlq.agg(F.count(F.lit(1)).alias("dlq"))


def samples(dlq: DataFrame, rows: int = SAMPLES) -> DataFrame:
    """A few rejects as document id and reason, oldest first so that it is repeatable."""
    return (
        dlq.orderBy("dlq_time", "doc").limit(rows).select(_document_id().alias("doc_id"), _reason().alias("reason"))
    )


def newest(dlq: DataFrame, rows: int = LATEST) -> DataFrame:
    return (
        dlq.orderBy(F.desc("dlq_time"), "doc")
        .limit(rows)
        .select("dlq_time", _document_id().alias("doc_id"), _reason().alias("reason"))
    )


def reasons(dlq: DataFrame) -> DataFrame:
    return dlq.groupBy(_reason().alias("reason")).agg(F.count(F.lit(1)).alias("documents"))
