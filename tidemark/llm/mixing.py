"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in id order, fill blocks of a fixed text volume. With weight
``w = units / period``, block ``b`` (from 0) is released at slot ``floor(b / w)`` and
due by slot ``ceil((b + 1) / w)``; one block runs per slot, the released one with the
earliest deadline first. Since the weights sum to one, every deadline holds and at
no slot is a source a whole block away from its share. The schedule repeats after
``period`` slots, so one period is worked out, by a fold over its slots, and every
block's slot follows from it. When a source has no block left its slots fall away
and the others move up; nothing is dropped or repeated.

A source that holds a third of all rows is numbered in slices of the id order, each
with the volume of the slices before it; no window holds a whole source. The table
that is broadcast has ``period`` rows of one number per source, whatever the data.

Defined results: NULL sources form one source of their own; NULL and empty texts have
volume 0 and sit in the block their place gives them. NULL ids come first. Rows that
repeat an id go by text length; equal ones are interchangeable. A source without text,
or with a weight of 0 or less, gets the smallest weight, one unit. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.native import field, packed, quoted, unpacked

BLOCK_CHARS = 100_000
PERIOD = 1_000
#: Exponent of a source's volume in its default weight: between its share (1) and an equal part (0).
SOFTEN = 0.5
SLICE_ROWS = 100_000
#: Bounds the search expression; beyond it slices grow, and their windows spill.
MAX_SLICES = 1_024


def _slice(rows: DataFrame, rows_per_slice: int) -> DataFrame:
    """``__slice``: a number that never falls with the id and parts the rows about evenly."""
    n = rows.count()
    wanted = min(max(16, math.ceil(n / rows_per_slice)), MAX_SLICES)
    marks = rows.agg(F.percentile_approx("doc_id", [i / wanted for i in range(1, wanted)], 10 * wanted)).first()[0]
    marks = sorted(set(marks or []))

    def place(low: int, high: int) -> Column:
        """Binary search as one expression."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col("doc_id") < marks[middle], place(low, middle)).otherwise(place(middle + 1, high))

    return rows.withColumn("__slice", F.when(F.col("doc_id").isNull(), 0).otherwise(place(0, len(marks))))


def in_blocks(docs: DataFrame, *, doc_id: str, source: str, text: str, block_chars: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """doc_id, source, chars, block: the block in which each document starts."""
    rows = docs.select(
        F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(source)).alias("source"),
        F.char_length(F.coalesce(F.col(quoted(text)), F.lit(""))).cast("long").alias("chars"),
    )
    rows = _slice(rows, slice_rows)
    parts = rows.groupBy("source", "__slice").agg(F.sum("chars").alias("__part"))
    ahead = Window.partitionBy("source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("__source"), F.col("__slice").alias("__at"), F.coalesce(F.sum("__part").over(ahead), F.lit(0)).alias("__ahead"))
    rows = rows.join(parts, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__slice") == F.col("__at")))
    within = Window.partitionBy("source", "__slice").orderBy(F.col("doc_id").asc_nulls_first(), "chars").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__ahead") + F.coalesce(F.sum("chars").over(within), F.lit(0))
    return rows.select("doc_id", "source", "chars", (before / block_chars).cast("long").alias("block"))


def _period(placed: DataFrame, weights: dict | None, period: int, soften: float) -> DataFrame:
    """One row per slot of the period: whose it is, which of the source's slots, its number, and what came before it per source."""
    volume = placed.groupBy("source").agg(F.sum("chars").alias("volume"), (F.max("block") + 1).alias("blocks"))
    if weights is None:
        wish = F.pow(F.col("volume").cast("double"), F.lit(float(soften)))
    else:
        table = {k: float(v) for k, v in weights.items() if k is not None}
        wish = F.lit(0.0)
        for name, value in table.items():
            wish = F.when(F.col("source") == name, F.lit(value)).otherwise(wish)
        wish = F.when(F.col("source").isNull(), F.lit(float(weights.get(None, 0.0)))).otherwise(wish)
    volume = volume.withColumn("wish", F.greatest(wish, F.lit(0.0)))
    # One row for all sources: as long as the list of sources, which is a mixture's own size.
    all_sources = volume.agg(F.sort_array(F.collect_list(F.struct(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("none"), "source", "blocks", "wish"))).alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x["wish"])
    share = lambda x: F.when(F.col("total") > 0, x["wish"] / F.col("total")).otherwise(F.lit(0.0))
    one = all_sources.select("s", total.alias("total")).where(F.size("s") > 0)
    one = one.select("s", F.transform("s", lambda x: F.greatest(F.lit(1), F.floor(share(x) * period + 0.5)).cast("long")).alias("units"), F.transform("s", lambda x: x["blocks"]).alias("blocks"))
    one = one.withColumn("period", F.aggregate("units", F.lit(0).cast("long"), lambda a, x: a + x))
    start = F.struct(
        F.transform("units", lambda x: F.lit(0).cast("long")).alias("done"),
        F.array().cast("array<struct<who:int,earlier:array<bigint>>>").alias("slots"),
    )

    def due(done: Column, i: Column) -> Column:
        return F.struct(_floor((F.get(done, i) + 1) * F.col("period") + F.get("units", i) - 1, F.get("units", i)).alias("due"), i.alias("i"))

    def step(state: Column, slot: Column) -> Column:
        released = F.filter(F.sequence(F.lit(0), F.size("units") - 1), lambda i: _floor(F.get(state["done"], i) * F.col("period"), F.get("units", i)) <= slot)
        pick = F.array_min(F.transform(released, lambda i: due(state["done"], i)))["i"]
        # A one-element array binds the pick, so that it is worked out once.
        return F.get(F.transform(F.array(pick), lambda who: F.struct(
            F.transform(state["done"], lambda d, i: d + (i == who).cast("long")).alias("done"),
            F.concat(state["slots"], F.array(F.struct(who.alias("who"), state["done"].alias("earlier")))).alias("slots"),
        )), F.lit(0))

    slots = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("period") - 1), start, step, lambda state: state["slots"])
    one = one.select("s", "units", "blocks", "period", slots.alias("slots"))
    slot = one.select("s", "units", "blocks", "period", F.posexplode_outer("slots").alias("at", "slot"))  # outer: else Spark works the fold out twice, to filter first
    slot = slot.select("s", "units", "blocks", "period", "at", F.col("slot.who").alias("who"), F.col("slot.earlier").alias("earlier"))
    return slot.select(
        F.get("s", F.col("who"))["source"].alias("__source"), F.get("units", F.col("who")).alias("units"), "period",
        F.get("earlier", F.col("who")).alias("__nth"), "at", F.col("units").alias("__units"), F.col("blocks").alias("__blocks"), "earlier",
    )


def _floor(a: Column, b: Column) -> Column:
    return ((a - F.pmod(a, b)) / b).cast("long")


def mixed(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: dict | None = None,
          block_chars: int = BLOCK_CHARS, period: int = PERIOD, soften: float = SOFTEN, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Per row: doc_id, source, block, units and period (the weight), released, due (in the endless schedule) and slot (the block's place in the mix).

    ``weights`` gives the target per source, a short list by nature; without it a
    source weighs its volume to the power ``soften``.
    """
    placed = in_blocks(docs, doc_id=doc_id, source=source, text=text, block_chars=block_chars, slice_rows=slice_rows)
    slots = _period(placed, weights, period, soften)
    units_of = slots.where("__nth = 0").select(F.col("__source").alias("__s"), F.col("units").alias("__u"))
    rows = placed.join(F.broadcast(units_of), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    rows = rows.withColumn("__n", F.pmod("block", "__u")).withColumn("__cycle", _floor(F.col("block"), F.col("__u")))
    rows = rows.join(F.broadcast(slots), F.col("source").eqNullSafe(F.col("__source")) & (F.col("__n") == F.col("__nth")))
    taken = F.zip_with(F.zip_with("__units", "earlier", lambda u, e: u * F.col("__cycle") + e), "__blocks", lambda a, b: F.least(a, b))
    return rows.select(
        "doc_id", "source", "block", "units", "period",
        _floor(F.col("block") * F.col("period"), F.col("units")).alias("released"),
        _floor((F.col("block") + 1) * F.col("period") + F.col("units") - 1, F.col("units")).alias("due"),
        F.aggregate(taken, F.lit(0).cast("long"), lambda a, x: a + x).alias("slot"),
    )


def in_mixed_order(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """The documents, all columns, range-partitioned and sorted by their block's slot: files read in order give the mix."""
    slots = mixed(docs, doc_id=doc_id, source=source, text=text, **how)
    places = slots.groupBy("doc_id").agg(F.min("slot").alias("slot"))
    ordered = packed(docs).join(places, field(doc_id).eqNullSafe(F.col("doc_id")), "left").select("row", "slot", field(doc_id).alias("id"))
    return unpacked(ordered.repartitionByRange("slot", "id").sortWithinPartitions("slot", "id"), docs.columns)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, length(coalesce(text, '')) AS chars FROM documents
), b AS MATERIALIZED (
  SELECT *, coalesce(sum(chars) OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, chars
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 100000 AS block FROM d
), v AS (
  SELECT source, sqrt(sum(chars)::DOUBLE) AS wish, max(block) + 1 AS blocks FROM b GROUP BY source
), u AS MATERIALIZED (
  SELECT *, greatest(1, floor(wish / (SELECT sum(wish) FROM v) * 1000 + 0.5))::BIGINT AS units,
    row_number() OVER (ORDER BY coalesce(source, ''), source IS NULL) AS i FROM v
), c AS MATERIALIZED (
  SELECT list(units ORDER BY i) AS us, sum(units)::BIGINT AS p FROM u
), sim(t, done, pick) AS (
  SELECT 0::BIGINT, list_transform(us, lambda x: 0::BIGINT), 0::BIGINT FROM c
  UNION ALL
  SELECT t + 1, list_transform(done, lambda x, i: CASE WHEN i = k THEN x + 1 ELSE x END), k FROM (
    SELECT t, done, p, list_sort(list_filter(list_transform(range(1, len(us) + 1),
      lambda i: {'due': ((done[i] + 1) * p + us[i] - 1) // us[i], 'i': i, 'rel': (done[i] * p) // us[i]}), lambda x: x.rel <= t))[1].i AS k
    FROM sim, c WHERE t < p)
), slots AS (
  SELECT t - 1 AS at, pick, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth FROM sim WHERE t > 0
), blocks AS (
  SELECT u.source, u.i, g.block, u.units, (g.block // u.units) * (SELECT p FROM c) + s.at AS virtual
  FROM u, LATERAL (SELECT unnest(range(0, u.blocks)) AS block) g, slots s
  WHERE s.pick = u.i AND s.nth = g.block % u.units
), placed AS (
  SELECT *, row_number() OVER (ORDER BY virtual) - 1 AS slot FROM blocks
)
SELECT b.doc_id, b.source, b.block, q.units, c.p AS period, (b.block * c.p) // q.units AS released,
  ((b.block + 1) * c.p + q.units - 1) // q.units AS due, q.slot
FROM b, placed q, c WHERE b.source IS NOT DISTINCT FROM q.source AND b.block = q.block
"""
