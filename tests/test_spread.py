"""The sliced helpers against plain windows and plain sorting, with one hot key."""

import random

import pytest

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import spread
from tidemark.functions.spread import filled_before, nearest_rank, previous_in_group, with_position


def hot_rows(spark, n=600):
    random.seed(5)
    rows = [("hot" if i % 3 else f"k{random.randrange(20)}", i * 3 - 200, random.choice([None, float(i), i + 0.5])) for i in range(n)]
    return spark.createDataFrame(rows, "key string, seq bigint, v double").repartition(5)


def test_previous_in_group(spark):
    rows = hot_rows(spark)
    plain = rows.withColumn("p", F.lag("v").over(Window.partitionBy("key").orderBy("seq")))
    for width in (7, 10**6):
        assert sorted(previous_in_group(rows, ["key"], "seq", F.col("v"), "p", width).collect(), key=str) == sorted(plain.collect(), key=str)


def test_filled_before(spark):
    rows = hot_rows(spark)
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    plain = rows.withColumn("_before_v", F.last("v", ignorenulls=True).over(w))
    got = filled_before(rows, ["key"], "seq", ["v"], width=11)
    assert sorted(got.collect(), key=str) == sorted(plain.collect(), key=str)


def test_with_position(spark):
    rows = hot_rows(spark).select("seq")
    got = [(r.seq, r.position) for r in with_position(rows, "seq", width=13).orderBy("seq").collect()]
    assert got == [(i * 3 - 200, i) for i in range(600)]


@pytest.mark.parametrize("values", [[i * 2**32 for i in range(300)], [i**7 for i in range(300)], [-(2**62), *range(299)]])
def test_ranges_follow_the_values_whatever_their_spread(spark, values):
    """Thinly and unevenly spread numbers: ranges of about the asked size, far fewer than rows."""
    rows = spark.createDataFrame([("hot" if i % 2 else None, v) for i, v in enumerate(values)] + [("cold", 1)], "key string, seq bigint")
    sizes = [r["count"] for r in spread._ranged(rows, ["key"], "seq", 30).groupBy("key", "__range").count().collect()]
    assert max(sizes) <= 60 and len(sizes) <= 2 * 6 + 1
    plain = rows.withColumn("p", F.lag("seq").over(Window.partitionBy("key").orderBy("seq")))
    got = previous_in_group(rows, ["key"], "seq", F.col("seq"), "p", 30)
    assert sorted(got.collect(), key=str) == sorted(plain.collect(), key=str)
    placed = with_position(rows.where("key is null or key = 'hot'"), "seq", width=30)
    assert [(r.seq, r.position) for r in placed.orderBy("position").collect()] == [(v, i) for i, v in enumerate(sorted(values))]


@pytest.mark.parametrize("bounds", [[], [3], [3, 5], [0, 2, 5, 7, 8], list(range(0, 75, 3)), [i**3 for i in range(64)]])
def test_ranges_count_the_bounds_below(spark, bounds):
    rows = spark.createDataFrame([(i,) for i in [None, *range(-2, 90)]], "seq bigint")
    got = spread._with_range(rows, F.lit(bounds).cast("array<bigint>"), len(bounds), "seq").collect()
    assert all(r["__range"] == (0 if r.seq is None else sum(b < r.seq for b in bounds)) for r in got)


def test_a_row_is_placed_by_halving_and_shuffled_once(spark):
    """No look at every bound for every row, and no second reading of the rows to tell where a range starts."""
    placed = with_position(spark.range(1000).select(F.col("id").alias("seq")), "seq", width=13)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "Join" not in plan and plan.count("Exchange") == 1
    by_key = spread._ranged(hot_rows(spark), ["key"], "seq", 11)
    assert "filter(" not in by_key._jdf.queryExecution().optimizedPlan().toString()
    assert with_position(spark.range(0), "id").collect() == []


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-500, 500), min_size=1, max_size=60))
def test_nearest_rank(spark, values):
    frame = spark.createDataFrame([("g", v) for v in values], "g string, t bigint")
    row = nearest_rank(frame, "g", "t", {"p50": 0.5, "p95": 0.95}, cell=16).first()
    ordered = sorted(values)
    assert row.p50 == ordered[round(0.5 * (len(values) - 1))] and row.p95 == ordered[round(0.95 * (len(values) - 1))]
