"""Writes as events."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import changes
from tidemark.plans.mirror import Mirror
from tidemark.session import shared_dir


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


@pytest.fixture
def current(spark):
    return spark.createDataFrame([("a", 1.0, "N"), ("b", 2.0, None), ("c", None, "S")], "`_id` string, amount double, status string")


def test_eight_identical_inserts_leave_one_event(spark, current):
    docs = spark.createDataFrame([("z", i, 9.0, "N") for i in range(8)], "`_id` string, seq bigint, amount double, status string")
    assert rows(changes.upsert(current, docs, width=3), "_id", "seq", "operation_type") == [("z", 0, "insert")]


def test_upsert_kinds_and_order_within_a_batch(spark, current):
    docs = spark.createDataFrame(
        [("a", 1, 1.0, "N"), ("b", 2, 2.0, "N"), ("b", 3, 2.0, "N"), ("b", 4, 2.0, None), ("c", 5, None, "S"), ("n", 6, 1.0, "X"), ("n", 7, 2.0, "X")],
        "`_id` string, seq bigint, amount double, status string",
    )
    for width in (2, 10**6):
        assert rows(changes.upsert(current, docs, width=width), "seq", "operation_type") == [
            (2, "replace"), (4, "replace"), (6, "insert"), (7, "replace"),
        ]


def test_patch_merges_in_order_and_returns_unknown_keys(spark, current):
    patches = spark.createDataFrame(
        [("a", 1, None, "E"), ("a", 2, 5.0, None), ("a", 3, 5.0, "E"), ("q", 4, 1.0, None)],
        "`_id` string, seq bigint, amount double, status string",
    )
    events, unmatched = changes.patch(current, patches, width=2)
    assert rows(events, "_id", "seq", "amount", "status") == [("a", 1, 1.0, "E"), ("a", 2, 5.0, "E")]
    assert rows(unmatched, "_id") == [("q",)]
    with pytest.raises(changes.UnknownKey):
        changes.patch_existing(current, patches)


def test_patch_may_bring_a_new_field(spark, current):
    patches = spark.createDataFrame([("a", 1, 0.9)], "`_id` string, seq bigint, fraudScore double")
    event = changes.patch_existing(current, patches).first()
    assert (event.amount, event.status, event.fraudScore) == (1.0, "N", 0.9)


def test_delete_only_existing_keys(spark, current):
    keys = spark.createDataFrame([("a",), ("a",), ("nope",)], "`_id` string")
    assert rows(changes.delete_keys(current, keys, 7), "_id", "operation_type", "seq") == [("a", "delete", 7)]


def test_reset_is_idempotent_through_the_mirror(spark):
    fields = "`_id` string, amount double, status string"
    seed = spark.createDataFrame([("s1", 1.0, "N"), ("s2", 2.0, "N"), ("s3", 3.0, None)], fields)
    live = spark.createDataFrame([("s1", 1.0, "N"), ("s2", 9.0, "N"), ("PED-AOVIVO-001", 5.0, "E"), ("PED-AOVIVO-002", 6.0, "E"), ("stray", 7.0, None)], fields)
    mirror = Mirror(spark, shared_dir(spark, "reset"), buckets=4)
    mirror.initial_sync(live)
    actions = changes.reconcile(mirror.state(), seed)
    report = changes.reconcile_report(actions, ["PED-AOVIVO-001", "PED-AOVIVO-002"], baseline=seed, dlq=mirror.dlq()).first()
    assert report.ok and report.dlq_cleared == 0
    assert (report.live_removed, report.strays_removed, report.seed_upserted, report.total, report.unchanged) == (2, 1, 2, 3, 1)
    events = changes.as_feed(changes.reconcile_events(mirror.state(), seed, 10), F.current_timestamp())
    assert rows(events, "document_key", "operation_type") == [
        ("PED-AOVIVO-001", "delete"), ("PED-AOVIVO-002", "delete"), ("s2", "replace"), ("s3", "insert"), ("stray", "delete"),
    ]
    mirror.apply(events)
    assert changes.reconcile_events(mirror.state(), seed, 11).count() == 0
