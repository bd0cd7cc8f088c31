"""The business questions asked of the mirror.

Frames carry the order fields ``_id, region, product, quantity, amount, status,
channel, orderdate``; result columns keep the names the reports are known by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import lenient_double

# Fixed values of the order domain.
CANCELLED = "CANCELADO"
APP = "APP"
BUSINESS_ROWS = 25
STATUS_ROWS = 3
PAGE_ROWS = 199
LOOKUP_FIELDS = ("_id", "status", "amount")
DETAIL_FIELDS = ("_id", "status", "amount", "channel", "paymentmethod")


def orders_by_region(orders: DataFrame) -> DataFrame:
    return (
        orders.groupBy("region")
        .agg(F.count(F.lit(1)).alias("orders"), F.sum("amount").alias("revenue"))
        .orderBy(F.desc("revenue"), "region")
    )


def find_order(orders: DataFrame, order_id: str, key: str = "_id") -> DataFrame:
    """All fields of one order: one row, or none once it is deleted."""
    return orders.where(F.col(key) == F.lit(order_id))


def find_fields(orders: DataFrame, order_id: str, fields: tuple[str, ...] = LOOKUP_FIELDS) -> DataFrame:
    """The named fields of one order, only those being read."""
    return orders.where(F.col("_id") == F.lit(order_id)).select(*fields)


def _by_month(orders: DataFrame, *measures: Column) -> DataFrame:
    """Measures per region and month; the month is a date until it is shown."""
    return (
        orders.groupBy("region", F.trunc("orderdate", "month").alias("mes"))
        .agg(*measures)
        .withColumn("mes", F.date_format("mes", "yyyy-MM"))
    )


def _percent(hits: Column, total: Column) -> Column:
    return F.round(F.lit(100.0).cast("double") * hits / total, 2)


def business_question(
    orders: DataFrame, cancelled: str = CANCELLED, app: str = APP, rows: int = BUSINESS_ROWS
) -> DataFrame:
    """Revenue, average ticket, share cancelled and share by app per region and month."""
    total = F.count(F.lit(1))
    return (
        _by_month(
            orders,
            total.alias("pedidos"),
            F.round(F.sum("amount"), 2).alias("receita"),
            F.round(F.avg("amount"), 2).alias("ticket_medio"),
            _percent(F.count_if(F.col("status") == cancelled), total).alias("pct_cancelado"),
            _percent(F.count_if(F.col("channel") == app), total).alias("pct_app"),
        )
        .orderBy(F.desc("receita"), "region", "mes")
        .limit(rows)
    )


def business_question_counts(
    orders: DataFrame, cancelled: str = CANCELLED, app: str = APP, rows: int = BUSINESS_ROWS
) -> DataFrame:
    """The operational form of the same question: unrounded sums, and counts for shares."""
    return (
        _by_month(
            orders,
            F.count(F.lit(1)).alias("pedidos"),
            F.sum("amount").alias("receita"),
            F.avg("amount").alias("ticket_medio"),
            F.count_if(F.col("status") == cancelled).alias("cancelados"),
            F.count_if(F.col("channel") == app).alias("via_app"),
        )
        .orderBy(F.desc("receita"), "region", "mes")
        .limit(rows)
    )


def top_products(orders: DataFrame) -> DataFrame:
    """Orders, units and revenue per product with its share of all revenue.

    The grand total is a scalar subquery over the per-product rows, so no window
    gathers the products in one task.  It totals every measure: with the same
    columns below it, its aggregation is the one already made, not a second scan.
    """
    per_product = orders.groupBy("product").agg(
        F.count(F.lit(1)).alias("pedidos"),
        F.sum("quantity").cast("bigint").alias("unidades"),
        F.sum("amount").alias("_revenue"),
    )
    grand = per_product.agg(F.struct(*[F.sum(c).alias(c) for c in per_product.columns[1:]])).scalar()
    return (
        per_product.select(
            "product",
            "pedidos",
            "unidades",
            F.round("_revenue", 2).alias("receita"),
            _percent(F.col("_revenue"), grand["_revenue"]).alias("pct_receita_total"),
        )
        .orderBy(F.desc("receita"), "product")
    )


def key_counts(orders: DataFrame, key: str = "_id") -> DataFrame:
    """Rows and distinct non-NULL keys; fewer keys than rows means duplicates."""
    per_key = orders.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    return per_key.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).cast("bigint").alias("total"), F.count(key).alias("distintos")
    )


def approximate_key_counts(orders: DataFrame, key: str = "_id", error: float = 0.02) -> DataFrame:
    """As :func:`key_counts` without a shuffle by key; for dashboards."""
    return orders.agg(
        F.count(F.lit(1)).alias("total"), F.approx_count_distinct(key, error).alias("distintos")
    )


def status_distribution(orders: DataFrame, rows: int | None = None) -> DataFrame:
    counted = (
        orders.groupBy("status")
        .agg(F.count(F.lit(1)).alias("pedidos"))
        .orderBy(F.desc("pedidos"), "status")
    )
    return counted.limit(rows) if rows else counted


def tolerant_totals(orders: DataFrame) -> DataFrame:
    """Count, revenue and date range; an amount that is no number counts as 0."""
    return orders.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.round(F.sum(lenient_double(F.col("amount"))), 2), F.lit(0.0)).alias("receita"),
        F.min("orderdate").alias("primeiro_pedido"),
        F.max("orderdate").alias("ultimo_pedido"),
    )


def table_columns(table: DataFrame, commit: Column | None = None) -> DataFrame:
    """One row per column: position, name, type, how many rows have it and the first ``commit`` that does."""
    column = lambda f: F.col("`{}`".format(f.name.replace("`", "``")))
    since = lambda f: F.min(F.when(column(f).isNotNull(), commit)) if commit is not None else F.lit(None).cast("bigint")
    told = [
        F.struct(
            F.lit(i).alias("posicao"),
            F.lit(f.name).alias("nome"),
            F.lit(f.dataType.simpleString()).alias("tipo"),
            F.count(column(f)).alias("preenchidos"),
            since(f).alias("desde"),
        )
        for i, f in enumerate(f for f in table.schema.fields if not f.name.startswith("__"))
    ]
    return table.agg(F.array(*told).alias("columns")).select(F.inline("columns"))


def page(result: DataFrame, rows: int = PAGE_ROWS) -> tuple[DataFrame, bool]:
    """At most ``rows`` rows of a result, and whether it has more."""
    return result.limit(rows), result.limit(rows + 1).count() > rows


def page_frame(result: DataFrame, rows: int = PAGE_ROWS) -> DataFrame:
    """The page with its ``truncated`` flag as a column, in one pass over the result.

    One row beyond the page is read; the page, of fixed size, is gathered in order.
    """
    probe = result.limit(rows + 1).agg(F.collect_list(F.struct("*")).alias("_page"))
    return probe.select(
        F.explode(F.slice("_page", 1, rows)).alias("_row"), (F.size("_page") > rows).alias("truncated")
    ).select("_row.*", "truncated")
