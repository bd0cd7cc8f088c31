"""Convergence, lag, propagation, latency, order and delivery on the golden cases."""

from pyspark.sql import functions as F

from tidemark.operators import convergence, delivery, propagation, reports


def test_convergence_states(spark):
    cases = [(5000, 5000, 5000, "convergido"), (12, 48, 12, "tabela duplicada"), (5001, 5000, 5000, "propagando"), (5, None, None, "iceberg offline")]
    frame = spark.createDataFrame([c[:3] for c in cases], "s bigint, t bigint, d bigint")
    got = frame.select(convergence.convergence_state(F.col("s"), F.col("t"), F.col("d")).alias("e"))
    assert [r.e for r in got.collect()] == [c[3] for c in cases]


def test_convergence_of_frames(spark):
    source, lake = spark.sql("select id as `_id` from range(12)"), spark.sql("select id as `_id` from range(12)")
    four = lake.unionByName(lake).unionByName(lake).unionByName(lake)
    assert convergence.convergence(source, lake).first().estado == "convergido"
    assert tuple(convergence.convergence(source, four).first()) == (12, 48, 12, "tabela duplicada")
    assert convergence.convergence(source, None).first().estado == "iceberg offline"
    assert {r.copies for r in convergence.duplicates(four).collect()} == {4} and convergence.duplicates(lake).count() == 0


def test_a_null_key_reads_as_duplicate(spark):
    row = reports.key_counts(spark.sql("select * from values (1L), (2L), (null) as t(`_id`)")).first()
    assert (row.total, row.distintos) == (3, 2)


def test_lag_states(spark):
    cases = [(None, 0, 1000, "desconhecido"), (-1, 0, 1000, "critico"), (100, 0, 1000, "alerta"), (199, 0, 1000, "alerta"),
             (200, 0, 1000, "ok"), (500, 0, 1000, "ok"), (1500, 0, 1000, "ok"), (5, 5, 5, "alerta")]
    frame = spark.createDataFrame([c[:3] for c in cases], "checkpoint bigint, feed_start bigint, feed_end bigint")
    frame = frame.select(*[F.timestamp_seconds(c).alias(c) for c in frame.columns])
    assert [r.estado for r in convergence.lag_state(frame).collect()] == [c[3] for c in cases]


def test_preflight_modes(spark, make_feed):
    empty = spark.createDataFrame([], "doc string")
    full = spark.createDataFrame([("d",)], "doc string")
    fine, broken = make_feed((1, "insert", "a", "{}")), make_feed((1, "update", "a", None))

    def verdict(feed, dlq, lake):
        return tuple(convergence.preflight_verdict(convergence.preflight_checks(spark, feed, dlq, lake)).first())

    assert verdict(fine, empty, fine) == (True, "completo", False)
    assert verdict(fine, full, fine) == (True, "completo", True)
    assert verdict(fine, empty, None) == (True, "somente_mongodb", True)
    assert verdict(broken, empty, fine) == (False, "com_falha", False)
    assert verdict(None, empty, fine) == (False, "com_falha", False)


POLL = "sample_id string, op string, poll_start double, poll_end double, n_rows bigint, status string, bytes bigint"


def measured(spark, polls, timeout=30.0, salts=3):
    frame = spark.createDataFrame(polls, POLL)
    return {(r.sample_id, r.op): r for r in propagation.propagation(frame, F.lit("EM_TRANSPORTE"), timeout, salts).collect()}


def test_propagation_cases(spark):
    got = measured(spark, [
        ("a", "insert", 0.0, 1.0, 0, None, 1000), ("a", "insert", 3.0, 4.0, 1, "P", 1000), ("a", "insert", 6.0, 7.0, 1, "P", 1000),
        ("late", "insert", 0.0, 31.0, 0, None, 10), ("late", "insert", 33.0, 34.0, 1, "P", 10),
        ("slow", "delete", 0.0, 45.0, 0, None, 5),
        ("upd", "update", 0.0, 1.0, 1, "P", 1), ("upd", "update", 2.0, 3.5, 1, "EM_TRANSPORTE", 1),
    ])
    a = got["a", "insert"]
    assert (a.ok, a.visible_s, a.window_s, a.polls, a.bytes) == (True, 4.0, 4.0, 2, 2000)
    assert (got["late", "insert"].ok, got["late", "insert"].polls, got["late", "insert"].waited_s) == (False, 1, 31.0)
    assert got["slow", "delete"].ok and got["slow", "delete"].visible_s == 45.0
    assert got["upd", "update"].window_s == 3.5


def test_cycle_stops_at_the_first_timeout(spark):
    frame = spark.createDataFrame([("s", "insert", True), ("s", "update", False), ("s", "delete", True), ("t", "insert", True)], "sample_id string, op string, ok boolean")
    assert sorted((r.sample_id, r.op) for r in propagation.cycle_steps(frame).collect()) == [("s", "insert"), ("s", "update"), ("t", "insert")]


def test_latency_summary(spark):
    rows = [("insert", True, 5.0), ("insert", True, 7.0), ("insert", True, 9.0), ("update", True, 20.0), ("update", False, None), ("update", True, 22.0),
            ("delete", True, 30.0), ("delete", True, 40.0), ("none", False, None)]
    frame = spark.createDataFrame([(*r, 10) for r in rows], "op string, ok boolean, visible_s double, bytes bigint")
    got = {r.op: r for r in propagation.latency_summary(frame).collect()}
    i = got["insert"]
    assert (i.n, i.converged, i.timeouts, i.p50, i.p95, i["max"], i["mean"], i.bytes) == (3, 3, 0, 7.0, 9.0, 9.0, 7.0, 30)
    assert (got["update"].converged, got["update"].timeouts, got["update"].bytes) == (2, 1, 30)
    assert got["delete"].n == 2 and got["delete"].p50 == 30.0 and got["none"].p50 is None


def test_ordering(spark, make_feed):
    feed = make_feed(*[(i, "update", "k", f'{{"n":{i}}}') for i in range(100)], (200, "update", "other", "{}"))
    final = spark.createDataFrame([("k", '{"n":99}'), ("other", "{}")], "document_key string, full_document string")
    expected = spark.createDataFrame([("k", 100), ("other", 1)], "document_key string, expected_events bigint")
    summary = delivery.ordering_summary(delivery.ordering_check(feed, final, expected, width=7)).first()
    assert (summary.keys, summary.events, summary.out_of_order_keys, summary.unequal_keys, summary.ok) == (2, 101, 0, 0, True)
    back = feed.withColumn("cluster_time", F.when(F.col("seq") == 49, F.lit(0).cast("timestamp")).otherwise(F.col("cluster_time")))
    row = {r.document_key: r for r in delivery.time_reversals(back, width=7).collect()}
    assert row["k"].reversals == 1 and row["other"].reversals == 0
    stale = final.replace('{"n":99}', '{"n":98}')
    assert not delivery.ordering_summary(delivery.ordering_check(feed, stale)).first().ok


def test_exactly_once(spark):
    def listed(ids):
        return spark.createDataFrame(list(enumerate(ids)), "position bigint, id string")

    seen = listed([f"r{i}" for i in range(20)])
    missed = [f"r{i}" for i in range(20, 50)]
    assert tuple(delivery.exactly_once(listed(missed), listed(missed), seen, seen).first()) == (30, 30, True, 0, 0, True, True)
    late = delivery.exactly_once(listed(missed), listed(missed), seen.where("position > 0"), seen).first()
    assert not late.before and late.missed_delivered and not late.ok
    repeated = delivery.exactly_once(listed(missed), listed(missed + ["r49", "r3"]), seen, seen).first()
    assert (repeated.missed_delivered, repeated.duplicates, repeated.extra, repeated.ok) == (True, 2, 2, False)
    lost = delivery.exactly_once(listed(missed), listed(missed[1:]), seen, seen).first()
    assert not lost.missed_delivered and not lost.ok


def test_tolerant_totals(spark):
    frame = spark.createDataFrame([("10.0",), ("20.5",), ("30.25",), (None,), ("abc",)], "amount string").withColumn("orderdate", F.lit(None).cast("timestamp"))
    row = reports.tolerant_totals(frame).first()
    assert (row.total, row.receita) == (5, 60.75)
    assert reports.tolerant_totals(frame.limit(0)).first().receita == 0.0


def test_page(spark):
    frame = spark.range(200)
    rows, truncated = reports.page(frame)
    assert rows.count() == 199 and truncated and not reports.page(spark.range(199))[1]
    assert reports.page_frame(spark.range(5)).first().truncated is False


def test_only_hot_samples_are_spread(spark):
    counts = spark.createDataFrame([("hot", "insert", 900), ("warm", "insert", 60), ("cold", "insert", 40)], "sample_id string, op string, n bigint")
    assert [tuple(r) for r in propagation._hot(counts, 10).collect()] == [("hot", "insert", 9)]
    assert propagation._hot(counts.where("n < 0"), 10).count() == 0
    polls = [("hot", "insert", float(i), i + 0.5, int(i == 40), None, 1) for i in range(60)] + [(f"c{i}", "insert", 0.0, 1.0, 1, None, 2) for i in range(20)]
    got, whole = measured(spark, polls, 100.0, 4), measured(spark, polls, 100.0, 1)
    assert got == whole and (got["hot", "insert"].polls, got["hot", "insert"].visible_s, got["hot", "insert"].bytes) == (41, 40.5, 41)
    assert all(got[f"c{i}", "insert"].polls == 1 for i in range(20))
