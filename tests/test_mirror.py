"""The table on disk: golden cycle, versions, replay, lateness, rebuild, streaming."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import StreamingQueryException

from pyspark.sql import functions as F

from tidemark.operators import apply, deadletter
from tidemark.operators.apply import UnknownSnapshot, list_snapshots
from tidemark.operators.convergence import convergence
from tidemark.plans.mirror import Mirror, RebuildRefused
from tidemark.session import shared_dir
from tidemark.sources.feed import FEED_SCHEMA, stream_feed
from tidemark.streaming.follow import follow

NOON = datetime(2026, 8, 24, 12, 0, tzinfo=timezone.utc)
TV = {"_id": "PED-AOVIVO-001", "region": "SP", "product": 'Smart TV 50"', "quantity": 1, "amount": 2399.00,
      "status": "PROCESSANDO", "channel": "APP", "paymentMethod": "PIX"}
SENT = {**TV, "amount": 2159.10, "status": "EM_TRANSPORTE"}
NOTE = {"_id": "PED-AOVIVO-002", "region": "RJ", "product": 'Notebook 15"', "quantity": 1, "amount": 4299.00,
        "status": "EM_ANALISE", "channel": "SITE", "paymentMethod": "CREDITO", "fraudScore": 0.92}


def mirror_of(spark, **kw):
    return Mirror(spark, shared_dir(spark, "mirror"), **{"buckets": 4, **kw})


def state(frame):
    return sorted((tuple(sorted(r.asDict(recursive=True).items())) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def cycle(spark):
    from tests.conftest import FEED

    def one(seq, op, key, doc):
        return spark.createDataFrame([(seq, NOON, op, key, json.dumps(doc) if doc else None)], FEED)

    mirror = mirror_of(spark)
    steps = [(1, "insert", TV["_id"], TV), (2, "update", TV["_id"], SENT), (3, "delete", TV["_id"], None), (4, "insert", NOTE["_id"], NOTE)]
    for n, step in enumerate(steps, start=1):
        assert mirror.apply(one(*step), committed_at=NOON + timedelta(minutes=n)) == n
    return mirror


def test_golden_versions(cycle):
    seen = [[(r["_id"], r.status, r.amount) for r in cycle.state(v).collect()] for v in (1, 2, 3, 4)]
    assert seen == [
        [(TV["_id"], "PROCESSANDO", 2399.00)],
        [(TV["_id"], "EM_TRANSPORTE", 2159.10)],
        [],
        [(NOTE["_id"], "EM_ANALISE", 4299.00)],
    ]
    assert cycle.lookup(TV["_id"]).count() == 0 and cycle.lookup(TV["_id"], 2).first().amount == 2159.10
    assert cycle.lookup(NOTE["_id"]).first().fraudScore == 0.92
    assert "fraudScore" in cycle.state(4).columns and "fraudScore" not in cycle.state(1).columns


def test_golden_history(cycle):
    rows = [tuple(r)[0:1] + tuple(r)[2:] for r in list_snapshots(cycle.snapshots()).collect()]
    assert rows == [(4, "append", "1", "0"), (3, "delete", "0", "1"), (2, "overwrite", "1", "1"), (1, "append", "1", "0")]
    past = [(r.snapshot_id, r.existed, r.amount) for r in cycle.history(TV["_id"]).collect()]
    assert past == [(1, True, 2399.00), (2, True, 2159.10), (3, False, None), (4, False, None)]


def test_as_of_instant_and_unknown_versions(cycle):
    assert cycle.state_at("2026-08-24 12:02:30+00:00").first().amount == 2159.10
    for wrong in (0, 5, -1, 2**63, 10**80):
        with pytest.raises(UnknownSnapshot):
            cycle.state(wrong)
    with pytest.raises(UnknownSnapshot):
        cycle.state_at("2026-08-24 12:00:00+00:00")


def test_sql_over_registered_views(spark, cycle):
    cycle.register("orders_now")
    assert spark.sql("select status from orders_now where `_id` = :id", args={"id": NOTE["_id"]}).first()[0] == "EM_ANALISE"
    assert spark.sql("select count(*) from orders_now_snapshots where summary['deleted-records'] = '1'").first()[0] == 2
    assert [r.nome for r in cycle.columns().collect()][:2] == ["_id", "amount"]


def random_events(n=300, keys=25, seed=3):
    rng, events = random.Random(seed), []
    for seq in range(1, n + 1):
        key = "hot" if rng.random() < 0.35 else f"k{rng.randrange(keys)}"
        op = rng.choice(["insert", "update", "update", "replace", "delete", "noise"])
        doc = {"_id": key, "amount": seq / 4}
        if rng.random() < 0.3:
            doc["extra"] = seq
        events.append((seq, op, key, None if op == "delete" else json.dumps(doc)))
    return events


def expected_state(events):
    docs = {}
    for _, op, key, doc in sorted(events):
        if op == "delete":
            docs.pop(key, None)
        elif op != "noise":
            docs[key] = json.loads(doc)
    return {(k, d["amount"], d.get("extra")) for k, d in docs.items()}


def actual_state(mirror, version=None):
    rows = mirror.state(version).collect()
    assert len(rows) == len({r["_id"] for r in rows})
    return {(r["_id"], r.amount, r.extra) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_batching_late_and_repeated_events_give_the_same_state(spark, make_feed, seed):
    events = random_events(seed=seed)
    late = events[:]
    random.Random(seed).shuffle(late)
    batches = [late[:100], late[100:200] + late[50:60], late[200:]]
    mirror = mirror_of(spark)
    for n, batch in enumerate(batches):
        mirror.apply(make_feed(*batch))
        if n == 1:
            assert mirror.write_base() == 2
    assert actual_state(mirror) == expected_state(events)
    assert {(r["_id"], r.amount, r.extra) for r in mirror.lookup("hot").collect()} == {
        row for row in expected_state(events) if row[0] == "hot"
    }
    counts = mirror.snapshots().selectExpr(
        "cast(sum(cast(summary['added-records'] as bigint) - cast(summary['deleted-records'] as bigint)) as bigint) as n"
    )
    assert counts.first().n == mirror.state().count()
    first = [e for e in batches[0]]
    assert actual_state(mirror, 1) == expected_state(first)


def test_base_leaves_reads_alone(spark, make_feed):
    events = random_events(120)
    mirror = mirror_of(spark)
    mirror.apply(make_feed(*events[:60]))
    mirror.apply(make_feed(*events[60:]))
    before, first = state(mirror.state()), state(mirror.state(1))
    mirror.write_base()
    assert state(mirror.state()) == before and state(mirror.state(1)) == first
    mirror.apply(make_feed((500, "delete", "hot", None)))
    assert mirror.lookup("hot").count() == 0 and mirror.lookup("hot", 2).count() == len([r for r in before if ("_id", "hot") in r])


def test_retry_of_a_batch_is_skipped_and_a_torn_one_repeated(spark, make_feed):
    mirror = mirror_of(spark)
    feed = make_feed((1, "insert", "a", '{"_id":"a","amount":1.0}'))
    assert mirror.apply(feed, "s", 0) == 1
    assert mirror.apply(feed, "s", 0) == 1 and mirror.commits().count() == 1
    # A crash after the change files and before the marker leaves them unmarked.
    torn = mirror.state().selectExpr("'zzz' as `_id`", "99L as __seq", "cast(null as timestamp) as __at", "true as __alive", "5.0D as amount")
    torn.write.parquet(f"{mirror._home}/changes/__commit=2")
    assert [r["_id"] for r in mirror.state().collect()] == ["a"] and mirror.snapshots().count() == 1
    assert mirror.apply(make_feed((2, "insert", "b", '{"_id":"b","amount":2.0}')), "s", 1) == 2
    assert sorted(r["_id"] for r in mirror.state().collect()) == ["a", "b"]


def test_many_commits_are_sealed_and_rolled_up_in_runs(spark, make_feed):
    mirror = mirror_of(spark, run_commits=2)
    events = [(1, "a", 1), (2, "b", 2), (3, "a", 3), (4, "c", 4), (5, "b", 5)]
    for n, key, value in events:
        assert mirror.apply(make_feed((n, "insert", key, '{"n":%d}' % value)), "s", n) == n
    assert mirror._sealed() == 2 and [r["__commit"] for r in mirror.commits().orderBy("__commit").collect()] == [1, 2, 3, 4, 5]
    assert mirror.apply(make_feed((5, "insert", "b", '{"n":5}')), "s", 5) == 5
    assert mirror.apply(make_feed((4, "insert", "c", '{"n":4}')), "s", 4) == 4
    assert [c.path for c in mirror._tail(None).pieces] == ["rollups/__level=2/__run=0", "changes/__commit=5"]
    assert [c.path for c in mirror._tail(3).pieces] == ["rollups/__level=1/__run=0", "changes/__commit=3"]

    def seen(version):
        return {(r["_id"], r.n) for r in mirror.state(version).collect()}

    assert [seen(v) for v in (1, 2, 3, 4, 5)] == [
        {("a", 1)}, {("a", 1), ("b", 2)}, {("a", 3), ("b", 2)}, {("a", 3), ("b", 2), ("c", 4)}, {("a", 3), ("b", 5), ("c", 4)},
    ]
    assert mirror.snapshots().count() == 5 and mirror.write_base() == 5 and seen(None) == seen(5)
    again = Mirror(spark, mirror.root)
    assert again.run_commits == 2 and again._head()["__commit"] == 5 and again._head().base_at == 5


@pytest.mark.parametrize("roll_rows", [10**6, 7])
def test_counts_and_histories_by_levels_are_those_of_the_whole_log(spark, make_feed, roll_rows):
    """Late, repeated and rejected events over three levels of runs, with a base amid; runs rolled up or too large for it."""
    events = random_events(140, keys=8, seed=9)
    rng = random.Random(4)
    late = sorted(events, key=lambda e: e[0] + rng.choice([0, 0, 0, 40]))
    mirror = mirror_of(spark, run_commits=3, roll_rows=roll_rows)
    for n in range(14):
        batch = late[n * 10 : n * 10 + 10] + (late[:5] if n == 8 else [])
        if n == 6:
            batch = [(1000 + n, "insert", "bad", "no document")]
        mirror.apply(make_feed(*batch), "s", n)
        if n == 4:
            mirror.write_base()
    fresh = Mirror(spark, mirror.root)
    log = fresh.changes()
    assert log.count() == sum(r.rows for r in fresh.commits().collect())
    want = apply.snapshots(log, fresh.versions(), collapsed=True)
    for one in (mirror, fresh):
        assert state(one.snapshots().withColumn("summary", F.to_json("summary"))) == state(want.withColumn("summary", F.to_json("summary")))
    for key in ("hot", "k3", "nobody"):
        whole = apply.key_history(log, fresh.versions(), key, collapsed=True)
        assert state(fresh.history(key)) == state(whole)
    for version in (1, 3, 5, 6, 9, 14):
        assert actual_state(fresh, version) == {(r.key, r.amount, r.extra) for r in apply.state_as_of(log, version).collect()}


def _read(frame):
    """The files a plan opens."""
    return len(frame.inputFiles())


def test_files_and_jobs_do_not_grow_with_the_number_of_commits(spark, make_feed):
    mirror = mirror_of(spark, run_commits=3)
    tracker, opened, jobs = spark.sparkContext.statusTracker(), {}, {}
    for n in range(1, 32):
        spark.sparkContext.setJobGroup(f"commit-{n}", "")
        mirror.apply(make_feed((n, "insert", f"k{n % 7}", '{"n":%d}' % n)), "old" if n == 1 else "s", n)
        jobs[n] = len(tracker.getJobIdsForGroup(f"commit-{n}"))
        if n in (5, 31):
            one = Mirror(spark, mirror.root)
            opened[n] = [_read(one.commits()), _read(one.state()), _read(one.changes("k1")), _read(one.snapshots())]
    spark.sparkContext.setJobGroup("rest", "")
    assert all(late <= early + 3 * 3 for early, late in zip(opened[5], opened[31])), opened
    plain = [jobs[n] for n in range(2, 32) if (n - 1) % 3]
    assert max(plain) == min(plain) <= 6, jobs
    # The one batch of a stream that ended long ago is still known.
    again = Mirror(spark, mirror.root)
    assert again.apply(make_feed((1, "insert", "k1", '{"n":1}')), "old", 1) == 1 and again.commits().count() == 31


def test_a_run_sealed_before_a_crash_is_gone_on_from(spark, make_feed):
    mirror = mirror_of(spark, run_commits=2)
    for n in (1, 2):
        mirror.apply(make_feed((n, "insert", f"k{n}", '{"n":%d}' % n)), "s", n)
    mirror._seal(0, mirror.schema())
    again = Mirror(spark, mirror.root)
    assert again.apply(make_feed((2, "insert", "k2", '{"n":2}')), "s", 2) == 2
    assert again.apply(make_feed((3, "insert", "k3", '{"n":3}')), "s", 3) == 3
    assert Mirror(spark, mirror.root).state().count() == 3 and mirror.snapshots().count() == 3


def test_key_lookups_use_sorted_files_with_bloom_filters(spark, make_feed):
    import glob

    import pyarrow.parquet as pq

    mirror = mirror_of(spark, run_commits=2)
    for n in range(1, 4):
        mirror.apply(make_feed(*[(n * 100 + i, "insert", f"k{(i * 7) % 60:02d}", '{"n":%d}' % i) for i in range(60)]))
    (path,) = glob.glob(f"{mirror._home.removeprefix('file:')}/rollups/__level=1/__run=0/*.parquet")
    keys = pq.read_table(path).column("_id").to_pylist()
    assert keys == sorted(keys) and len(keys) == 120
    plan = mirror.history("k07")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(_id,k07)" in plan
    with open(path, "rb") as file:
        assert pq.ParquetFile(file).metadata.row_group(0).column(0).path_in_schema == "_id"
    assert mirror.history("k07").count() == 3


def test_batch_without_events_commits_nothing(spark, make_feed):
    mirror = mirror_of(spark)
    assert mirror.apply(make_feed((1, "noise", "a", "{}"))) is None
    with pytest.raises(UnknownSnapshot):
        mirror.state()


def test_rejects_are_kept_shown_and_cleared(spark, make_feed):
    mirror = mirror_of(spark)
    mirror.apply(make_feed((1, "insert", "a", '{"_id":"a","amount":1.5}'), (2, "update", "a", '{"_id":"a","amount":"x"}')))
    mirror.apply(make_feed((3, "insert", "b", '{"_id":"b","amount":{"$numberDecimal":"2"}}')))
    assert mirror.state().first().amount == 1.5 and mirror.versions().count() == 1
    assert deadletter.queued(mirror.dlq()).first().dlq == 2
    assert deadletter.newest(mirror.dlq()).first().reason == "Decimal128"
    assert {r.doc_id for r in deadletter.samples(mirror.dlq()).collect()} == {"a", "b"}
    assert mirror.clear_dlq() == 2 and mirror.dlq().count() == 0 and mirror.clear_dlq() == 0
    mirror.apply(make_feed((4, "insert", "c", "nope")))
    assert mirror.dlq().count() == 1


def test_schema_grows_and_keeps_old_columns(spark, make_feed):
    mirror = mirror_of(spark)
    mirror.apply(make_feed((1, "insert", "a", '{"_id":"a","x":1}')))
    mirror.apply(make_feed((2, "insert", "b", '{"_id":"b","y":"n"}')))
    assert state(mirror.state()) == [
        (("_id", "a"), ("x", 1), ("y", None)),
        (("_id", "b"), ("x", None), ("y", "n")),
    ]
    mirror.apply(make_feed((3, "insert", "c", '{"_id":"c","x":"text"}')))
    assert mirror.dlq().count() == 1 and mirror.schema().simpleString() == "struct<x:bigint,y:string>"


def test_initial_sync_then_feed_and_guarded_rebuild(spark, make_feed):
    source = spark.sql("select string(id) as `_id`, double(id) as amount from range(1, 13)")
    mirror = mirror_of(spark)
    assert mirror.initial_sync(source, committed_at=NOON) == 1
    with pytest.raises(RebuildRefused):
        mirror.initial_sync(source)
    mirror.apply(make_feed((1, "update", "3", '{"_id":"3","amount":33.5}'), (2, "delete", "4", None), (3, "insert", "99", '{"_id":"99","amount":1.0}')))
    assert mirror.state().count() == 12 and mirror.lookup("3").first().amount == 33.5 and mirror.lookup("4").count() == 0
    assert [tuple(r)[2:] for r in list_snapshots(mirror.snapshots()).collect()] == [("overwrite", "2", "2"), ("append", "12", "0")]
    assert [r.existed for r in mirror.history("4").collect()] == [True, False]
    with pytest.raises(RebuildRefused):
        mirror.rebuild(source)
    mirror.rebuild(source, confirm=True)
    assert convergence(source, mirror.state()).first().estado == "convergido"
    again = Mirror(spark, mirror.root)
    assert again.epoch == 2 and again.buckets == 4 and again.state().count() == 12


def test_initial_sync_follows_the_rules_of_the_feed(spark, make_feed):
    source = spark.sql("""
        select * from values
          ('a', 1, cast(1.5 as float), date'2026-01-02', timestamp_ntz'2026-01-02 03:04:05', array(1, 2), map('k.1', 1), named_struct('x.y', 1, 'd', date'2026-01-03'), cast(null as decimal(9,2)), 'p', cast(null as string), 'q'),
          ('b', 2, null, null, null, null, null, null, cast(1.5 as decimal(9,2)), 'p', null, 'q'),
          ('c', 3, null, null, null, null, null, null, null, 'p', 'reserved', 'q'),
          (null, 4, null, null, null, null, null, null, null, 'p', null, 'q'),
          ('d', 5, null, null, null, null, null, null, null, 'p', null, 'q'),
          ('d', 6, null, null, null, null, null, null, null, 'p', null, 'q')
        as t(`_id`, n, f, d, z, l, m, s, money, `a.b`, `__seq`, `back`)""").withColumnRenamed("back", "back`tick")
    mirror = mirror_of(spark)
    mirror.initial_sync(source, committed_at=NOON)
    reasons = sorted(r.err_info.reason for r in mirror.dlq().collect())
    assert reasons == ["Decimal128", "duplicate document key", "duplicate document key", "no document key", "reserved field name"]
    mirror.apply(make_feed((5, "insert", "e", '{"_id":"e","n":7,"a.b":"late","new":true}')))
    mirror.write_base()
    rows = {r["_id"]: r.asDict(recursive=True) for r in Mirror(spark, mirror.root).state().collect()}
    assert set(rows) == {"a", "e"} and rows["a"]["n"] == 1 and rows["a"]["f"] == 1.5 and rows["a"]["l"] == [1, 2]
    assert rows["a"]["d"].isoformat() == "2026-01-02T00:00:00" and rows["a"]["z"].isoformat() == "2026-01-02T03:04:05"
    assert rows["a"]["m"] == {"k_1": 1} and rows["a"]["s"]["x_y"] == 1 and rows["a"]["back`tick"] == "q"
    assert rows["e"]["a_b"] == "late" and rows["e"]["n"] == 7 and rows["e"]["new"] is True


def test_a_sync_in_chunks_goes_on_beside_the_feed_and_after_a_break(spark, make_feed):
    source = spark.sql("select string(100 + id) as `_id`, double(id) as amount from range(40) union all select null, 0.5 union all select '105', 9.5")
    mirror, asked = mirror_of(spark, run_commits=2), []

    def position():
        """The feed has three events before the third chunk, where the sync breaks off once."""
        if len(asked) == 2:
            asked.append(None)
            raise ConnectionError
        asked.append(10 * len(asked))
        return asked[-1]

    with pytest.raises(ConnectionError):
        mirror.sync_in_chunks(source, ["110", "120", "130"], position)
    # Of the synced ranges and of those to come; 125 is deleted before its chunk is read, 126 after.
    mirror.apply(make_feed((11, "update", "101", '{"_id":"101","amount":-1.0}'), (12, "delete", "102", None), (13, "delete", "125", None), (14, "insert", "200", '{"_id":"200","amount":-2.0}')))
    later = source.where("`_id` is null or `_id` <> '125'")
    again = Mirror(spark, mirror.root)
    assert again.sync_in_chunks(later, ["110", "120", "130"], position) == [1, 2, 4, 5]
    again.apply(make_feed((50, "delete", "126", None), (51, "update", "127", '{"_id":"127","amount":-3.0}')))
    want = {str(100 + i): float(i) for i in range(40) if i not in (2, 5, 25, 26)} | {"101": -1.0, "127": -3.0, "200": -2.0}
    assert {r["_id"]: r.amount for r in again.state().collect()} == want
    assert sorted(r.err_info.reason for r in again.dlq().collect()) == ["duplicate document key"] * 2 + ["no document key"]
    assert again.sync_in_chunks(later, ["110", "120", "130"], position) == [1, 2, 4, 5]


@pytest.mark.parametrize("name", ["a`b", 'say "x"', "line\nbreak", "", "\U0001f600", "it's"])
def test_any_field_name_can_be_written_and_read(spark, make_feed, name):
    document = json.dumps({"_id": "k", name: 1, "o": {name: [2]}})
    mirror = mirror_of(spark)
    mirror.apply(make_feed((1, "insert", "k", document)))
    mirror.write_base()
    mirror.apply(make_feed((2, "update", "k", json.dumps({"_id": "k", name: 3}))))
    assert mirror.state().first()[name] == 3 and mirror.lookup("k").first()[name] == 3
    assert mirror.history("k").count() == 2 and mirror.snapshots().count() == 2 and mirror.dlq().count() == 0


def test_wrapped_values_without_a_reading_are_set_aside(spark, make_feed):
    mirror = mirror_of(spark)
    mirror.apply(
        make_feed(
            (1, "insert", "1", '{"at":{"$date":"2026-01-01T00:00:00Z"},"n":{"$numberLong":"5"},"t":{"$timestamp":{"t":10,"i":1}},"u":{"$uuid":"ab"}}'),
            (2, "insert", "2", '{"at":{"$date":"no date"}}'),
            (3, "insert", "3", '{"n":{"$numberLong":"many"}}'),
            (4, "insert", "4", '{"at":null,"r":{"$regularExpression":{"pattern":"a.b","options":"i"}}}'),
        )
    )
    assert {r["_id"] for r in mirror.state().collect()} == {"1", "4"} and mirror.dlq().count() == 2
    assert mirror.lookup("4").first().r == "/a.b/i" and mirror.lookup("1").first().t.second == 10


def _write(feed, where):
    feed.select(*FEED_SCHEMA.names).coalesce(1).write.mode("append").parquet(where)


def test_stream_resumes_where_it_stopped(spark, make_feed):
    root = shared_dir(spark, "stream")
    mirror = Mirror(spark, f"{root}/mirror", buckets=4)
    events = [(i, "insert", f"r{i:02d}", json.dumps({"_id": f"r{i:02d}", "n": i})) for i in range(50)]
    _write(make_feed(*events[:20]), f"{root}/feed")
    follow(mirror, stream_feed(spark, f"{root}/feed"), f"{root}/cp").awaitTermination()
    assert mirror.changes().count() == 20
    _write(make_feed(*events[20:]), f"{root}/feed")
    follow(mirror, stream_feed(spark, f"{root}/feed"), f"{root}/cp").awaitTermination()
    second = mirror.changes().where("commit_id = 2")
    assert [r.n for r in second.orderBy("seq").collect()] == list(range(20, 50))
    follow(mirror, stream_feed(spark, f"{root}/feed"), f"{root}/cp").awaitTermination()
    assert mirror.commits().count() == 2
    # A new checkpoint replays everything; by key and seq the state stays the same.
    before = state(mirror.state())
    follow(mirror, stream_feed(spark, f"{root}/feed"), f"{root}/cp2", base_min_rows=10).awaitTermination()
    assert mirror.commits().count() == 3 and state(mirror.state()) == before


def test_stream_fails_on_missing_post_image_and_goes_on_with_dlq(spark, make_feed):
    root = shared_dir(spark, "images")
    mirror = Mirror(spark, f"{root}/mirror", buckets=4)
    _write(make_feed((1, "insert", "a", '{"_id":"a"}'), (2, "update", "a", None)), f"{root}/feed")
    with pytest.raises(StreamingQueryException):
        follow(mirror, stream_feed(spark, f"{root}/feed"), f"{root}/cp").awaitTermination()
    assert mirror.commits().count() == 0
    follow(mirror, stream_feed(spark, f"{root}/feed"), f"{root}/cp", missing_post_image="dlq").awaitTermination()
    assert mirror.state().count() == 1 and mirror.dlq().first().err_info.reason == "post-image was not found"


def test_lookup_reads_one_bucket_and_current_state_does_not_shuffle_the_base(spark, make_feed):
    source = spark.sql("select string(id) as `_id`, double(id) as amount, 'x' as other from range(1, 2000)")
    mirror = mirror_of(spark)
    mirror.initial_sync(source)
    mirror.apply(make_feed((1, "delete", "3", None)))
    plan = mirror.lookup("77")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__bucket" in plan and "EqualTo(_id,77)" in plan
    plan = mirror.state().select("amount")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "other" not in plan
