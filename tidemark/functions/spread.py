"""Ordered work that would gather a hot group in one task, split into ranges of bounded size.

A window ``PARTITION BY key ORDER BY seq`` puts all rows of one key in one task.
Where one key may hold a third of the feed, these helpers count the keys first. Keys
of at most ``width`` rows are left to a plain window. The rows of larger ones are cut
into ranges of the order column by its quantiles in that very key, whatever its
values are; work is done inside the ranges, and one row per range is carried
across the borders. The results are exact.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 1_000_000
#: Most ranges of one key; beyond, ranges grow instead.
RANGES = 10_000
CELL = 4096


def _with_range(frame: DataFrame, bounds: Column, most: int, order: str) -> DataFrame:
    """Adds ``__range``: how many of the rising bounds (at most ``most``) lie below the value.

    Found by halving, each step a projection of its own since it names the one before
    twice: a row costs the logarithm of the bounds, in compiled code.
    """
    frame, step = frame.withColumn("__range", F.lit(0)), 1 << max(0, most.bit_length() - 1)
    while step:
        beyond = F.get(bounds, F.col("__range") + F.lit(step - 1)) < F.col(order)
        frame = frame.withColumn("__range", F.col("__range") + F.when(beyond, step).otherwise(0))
        step //= 2
    return frame


def _bounds(rows: DataFrame, keys: list[str], order: str, ranges: int) -> DataFrame:
    """Per key, bounds that part its rows into so many ranges about evenly. Digests are merged; no key's rows meet."""
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    return rows.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.percentile_approx(order, shares, F.lit(max(1000, 10 * ranges))))).alias("__bounds"))


def _ranged(frame: DataFrame, keys: list[str], order: str, width: int) -> DataFrame | None:
    """The rows with ``__range``, rising with ``order`` inside a key; None if no key has more than ``width`` rows."""
    counts = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    most = counts.agg(F.max("__n")).first()[0] or 0
    if most <= width:
        return None
    same = [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)]
    own = [F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]
    large = counts.where(F.col("__n") > width).select(*own)
    ranges = min(RANGES, -(-most // width))
    bounds = _bounds(frame.select(*keys, order).join(large, same, "left_semi"), keys, order, ranges)
    bounded = frame.join(bounds.select(*own, "__bounds"), same, "left")
    return _with_range(bounded, F.col("__bounds"), ranges, order).drop("__bounds", *[f"__key{i}" for i in range(len(keys))])


def _carried(rows: DataFrame, borders: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with their range's row of ``borders``; NULL keys have theirs."""
    names = [*keys, "__range"]
    renamed = borders.withColumnsRenamed({k: f"__of{i}" for i, k in enumerate(names)})
    same = [F.col(k).eqNullSafe(F.col(f"__of{i}")) for i, k in enumerate(names)]
    return rows.join(renamed, same).drop(*[f"__of{i}" for i in range(len(names))])


def previous_in_group(
    frame: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int = WIDTH
) -> DataFrame:
    """Adds ``name``: ``value`` of the row before, per key by ``order`` (a number)."""
    ranged = _ranged(frame, keys, order, width)
    if ranged is None:
        return frame.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))
    rows = ranged.withColumn("__value", value)
    inside = Window.partitionBy(*keys, "__range").orderBy(order)
    across = Window.partitionBy(*keys).orderBy("__range")
    borders = (
        rows.groupBy(*keys, "__range")
        .agg(F.max_by(F.struct("__value"), order).alias("__last"))
        .select(*keys, "__range", F.lag("__last").over(across).alias("__carry"))
    )
    looked = rows.withColumn("__first", F.row_number().over(inside) == 1).withColumn("__lag", F.lag("__value").over(inside))
    return (
        _carried(looked, borders, keys)
        .withColumn(name, F.when(F.col("__first"), F.col("__carry.__value")).otherwise(F.col("__lag")))
        .drop("__value", "__range", "__first", "__lag", "__carry")
    )


def filled_before(
    frame: DataFrame, keys: list[str], order: str, columns: list[str], prefix: str = "_before_", width: int = WIDTH
) -> DataFrame:
    """Adds, for each column, the last non-NULL value in the key's rows before this one."""
    ranged = _ranged(frame, keys, order, width)
    if ranged is None:
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return frame.withColumns({f"{prefix}{c}": F.last(c, ignorenulls=True).over(before) for c in columns})
    across = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    borders = (
        ranged.groupBy(*keys, "__range")
        .agg(
            *[
                F.max_by(F.struct(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__last_{c}")
                for c in columns
            ]
        )
        .select(
            *keys,
            "__range",
            *[F.last(f"__last_{c}", ignorenulls=True).over(across).alias(f"__carry_{c}") for c in columns],
        )
    )
    looked = ranged.withColumns({f"__in_{c}": F.last(c, ignorenulls=True).over(inside) for c in columns})
    return (
        _carried(looked, borders, keys)
        .withColumns({f"{prefix}{c}": F.coalesce(F.col(f"__in_{c}"), F.col(f"__carry_{c}.{c}")) for c in columns})
        .drop("__range", *[f"__in_{c}" for c in columns], *[f"__carry_{c}" for c in columns])
    )


def with_position(frame: DataFrame, order: str, name: str = "position", width: int = WIDTH) -> DataFrame:
    """Adds the 0-based rank by a distinct number column over the whole frame.

    The bounds of the ranges and how many rows lie before each are worked out here, once:
    at most ``RANGES`` numbers each. Every later use of the result shares them, so it costs
    one shuffle by range, and no two uses can be cut differently.
    """
    rows = frame.agg(F.count(F.lit(1))).first()[0]
    least = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(2, min(RANGES, max(least, -(-rows // width))))
    found = _bounds(frame.select(order), [], order, ranges).first()[0] or []
    bounds = F.lit(found).cast(T.ArrayType(frame.schema[order].dataType))
    ranged = _with_range(frame, bounds, len(found), order)
    sizes = dict(ranged.groupBy("__range").count().collect())
    starts = [0, *accumulate(sizes.get(i, 0) for i in range(len(found)))]
    inside = Window.partitionBy("__range").orderBy(order)
    start = F.get(F.lit(starts).cast("array<bigint>"), F.col("__range"))
    return ranged.withColumn(name, start + F.row_number().over(inside) - 1).drop("__range")


def nearest_rank(
    frame: DataFrame, group: str, ticks: str, quantiles: dict[str, float], cell: int = CELL
) -> DataFrame:
    """The sample at index ``round_half_even(q * (n - 1))`` of each group's sorted ticks.

    ``ticks`` are integers.  Equal ones are counted first; the ranks are then
    found over cells of ``cell`` ticks and, inside the one cell that holds the
    wanted rank, over its ticks.  No task sorts a group's samples.
    """
    counted = (
        frame.groupBy(group, ticks)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__cell", F.floor(F.col(ticks) / F.lit(cell)).cast("bigint"))
    )
    by_cell = Window.partitionBy(group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q"))
            for name, q in quantiles.items()
        ]
    )
    cells = (
        counted.groupBy(group, "__cell")
        .agg(F.sum("__n").alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(by_cell), F.lit(0)))
        .withColumn("__total", F.sum("__n").over(Window.partitionBy(group)))
        .withColumn("__q", F.explode(wanted))
        .withColumn("__index", F.bround(F.col("__q.q") * (F.col("__total") - 1), 0).cast("bigint"))
        .where((F.col("__index") >= F.col("__before")) & (F.col("__index") < F.col("__before") + F.col("__n")))
        .select(group, "__cell", F.col("__q.name").alias("__name"), (F.col("__index") - F.col("__before")).alias("__rest"))
    )
    by_tick = Window.partitionBy(group, "__cell", "__name").orderBy(ticks).rowsBetween(Window.unboundedPreceding, -1)
    picked = (
        counted.join(cells, [group, "__cell"])
        .withColumn("__before", F.coalesce(F.sum("__n").over(by_tick), F.lit(0)))
        .where((F.col("__rest") >= F.col("__before")) & (F.col("__rest") < F.col("__before") + F.col("__n")))
    )
    return picked.groupBy(group).agg(
        *[F.max(F.when(F.col("__name") == name, F.col(ticks))).alias(name) for name in quantiles]
    )
