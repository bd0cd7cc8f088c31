"""Every operator as a registered query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import names, text
from tidemark.functions.spread import with_position
from tidemark.operators import (
    apply,
    changes,
    convergence,
    deadletter,
    delivery,
    propagation,
    reports,
)
from tidemark.operators.conform import ALIVE, AT, conform
from tidemark.plans import domain
from tidemark.plans.mirror import Mirror
from tidemark.session import shared_dir
from tidemark.sources import feed as feeds
from tidemark.streaming.follow import follow

MIDWAY = 20
BASELINE = 15
RETAINED_FROM_DAY = 5
POLL_TIMEOUT_S = 172800.0
DEFECT_SCHEMA = T.StructType(
    [
        T.StructField("amount", T.DoubleType()),
        T.StructField("kind", T.StringType()),
        T.StructField("props", T.StructType([T.StructField("k", T.LongType())])),
    ]
)
EVOLVED_SCHEMA = T.StructType([*DEFECT_SCHEMA.fields, T.StructField("bonus", T.DoubleType())])
# Optional fields of the documents of many forms.
FORM_BITS = 14
# How far apart a sparse feed's ``seq`` are, and the rows from which a key is cut into ranges there.
SPARSE = 2**32
LARGE_KEY = 4
FEED_COLUMNS = ("seq", "operation_type", "document_key")


def _cents(frame: DataFrame, *columns: str) -> DataFrame:
    """Rounds sums of doubles, whose last digits depend on the order of addition."""
    return frame.withColumns({c: F.round(c, 2) for c in columns})


# --- feed to table -----------------------------------------------------------------


def feed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.feed(spark, sf_dir).select(*FEED_COLUMNS, "cluster_time", "full_document")


def initial_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the existing collection, then the feed; state after both."""
    existing = domain.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("_id"), F.col("c_acctbal").alias("amount")
    )
    incoming = feeds.keep_operations(domain.feed(spark, sf_dir))
    whole = feeds.sync_then_follow(existing, incoming, before_seq=0)
    amount = F.get_json_object("full_document", "$.amount").cast("double").alias("amount")
    return apply.current_state(apply.to_changes(whole, amount))


def operation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.keep_operations(domain.feed(spark, sf_dir)).select(*FEED_COLUMNS)


def payload_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = feeds.keep_operations(domain.feed(spark, sf_dir))
    return feeds.select_payload(kept).select("seq", "operation_type", "payload")


def post_image_requirement(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = feeds.post_image_violations(domain.feed(spark, sf_dir, lost_images=True))
    return broken.groupBy("document_key").agg(F.count(F.lit(1)).alias("violations"))


def sanitised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field names holding dots and dollars at the root, in a struct and in an array."""
    source = domain.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order.key"),
        F.struct(F.col("o_totalprice").alias("$price"), F.col("o_orderstatus").alias("st.at")).alias("nested"),
        F.array(F.struct(F.col("o_orderpriority").alias("p.$r"))).alias("items"),
    )
    clean = names.sanitise(source)
    return clean.select("order_key", "nested._price", "nested.st_at", F.col("items")[0]["p__r"].alias("p__r"))


def sanitised_key_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.table(spark, sf_dir, "pages").select(
        "page_id", names.safe_name_column(F.col("url")).alias("safe_name")
    )


def schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field that appears on day 11 is a new column, NULL in earlier rows."""
    kept = feeds.keep_operations(domain.feed(spark, sf_dir, late_field=True))
    typed = conform(kept.where("operation_type <> 'delete'")).accepted
    return typed.select("_id", F.col("__seq").alias("seq"), "amount", "kind", F.col("props.k").alias("k"), "bonus")


def _defective(spark: SparkSession, sf_dir: str):
    kept = feeds.keep_operations(domain.feed(spark, sf_dir, lost_images=True, mixed_types=True))
    return conform(kept, DEFECT_SCHEMA, missing_post_image="dlq")


def type_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per verdict; nothing stops at a bad one."""
    reason = F.coalesce(F.col("__reason"), F.lit("accepted"))
    return _defective(spark, sf_dir).checked.groupBy(reason.alias("verdict")).agg(F.count(F.lit(1)).alias("documents"))


def many_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in as many forms as there are keys (up to 2^14), some of them misfits: verdict and fields held, counted."""
    bits = [F.col("document_key").cast("bigint").bitwiseAND(F.lit(1 << i)) > 0 for i in range(FORM_BITS)]
    text = F.when(F.col("document_key").cast("bigint") % 5 == 0, '"n"').otherwise("1")
    held = [F.when(bit, F.concat(F.lit(f',"b{i}":'), text if i == 0 else F.lit("1"))).otherwise("") for i, bit in enumerate(bits)]
    document = F.concat(F.lit('{"_id":"'), "document_key", F.lit('","amount":'), F.col("amount").cast("string"), *held, F.lit("}"))
    kept = feeds.keep_operations(domain.feed(spark, sf_dir)).where("operation_type <> 'delete'")
    known = T.StructType([T.StructField("b0", T.LongType())])
    judged = conform(kept.withColumn("full_document", document), known)
    # The columns that the forms have brought: small tables have no key of the higher bits.
    held = [F.col(c).isNotNull().cast("bigint") for c in judged.accepted.columns if c.startswith("b")]
    fitting = judged.accepted.select(F.lit("accepted").alias("verdict"), reduce(add, held).alias("fields"))
    misfits = judged.rejected.select(F.lit("rejected").alias("verdict"), F.lit(None).cast("bigint").alias("fields"))
    return fitting.unionByName(misfits).groupBy("verdict", "fields").agg(F.count(F.lit(1)).alias("documents"))


def _dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _defective(spark, sf_dir).rejected.select(
        F.col("cluster_time").alias("dlq_time"), F.struct("reason").alias("err_info"), "doc"
    )


def dead_letter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deadletter.queued(_dead_letters(spark, sf_dir))


def dead_letter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deadletter.samples(_dead_letters(spark, sf_dir))


def dead_letter_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deadletter.newest(_dead_letters(spark, sf_dir))


def keyed_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply.current_state(domain.change_log(spark, sf_dir).drop("commit_id"))


def _feed_files(spark: SparkSession, sf_dir: str, where: str, files: int, days: str = "true") -> None:
    """Writes the feed as ordered files for the file stream to find."""
    rows = domain.feed(spark, sf_dir).where(days).select(*[F.col(f.name).cast(f.dataType) for f in feeds.FEED_SCHEMA])
    rows.repartitionByRange(files, "seq").write.mode("overwrite").parquet(where)


def _stored_state(mirror: Mirror) -> DataFrame:
    return mirror.state().select("_id", "amount", "kind", F.col("props.k").alias("k"))


def commit_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole feed committed in batches through the table on disk, read back."""
    mirror = Mirror(spark, shared_dir(spark, "mirror"), buckets=8)
    feed = domain.feed(spark, sf_dir).select(*feeds.FEED_SCHEMA.names, "commit_id")
    for low, high in ((1, 10), (11, 20), (21, 2**31)):
        mirror.apply(feed.where(F.col("commit_id").between(low, high)))
        if low == 11:
            mirror.write_base()
    return _stored_state(mirror)


def stream_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as a stream: stopped after the first files, resumed from its checkpoint."""
    root = shared_dir(spark, "stream")
    files, checkpoint = f"{root}/feed", f"{root}/checkpoint"
    _feed_files(spark, sf_dir, files, 4)
    mirror = Mirror(spark, f"{root}/mirror", buckets=8)
    for glob in ("part-0000[01]*", "*.parquet"):
        stream = feeds.stream_feed(spark, files, max_files=2, glob=glob)
        follow(mirror, stream, checkpoint).awaitTermination()
    return _stored_state(mirror)


def synced_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of ``orders`` synced in chunks while the feed is committed between them; state after both."""
    mirror = Mirror(spark, shared_dir(spark, "synced"), buckets=8, run_commits=4)
    source = domain.table(spark, sf_dir, "orders")
    feed = domain.feed(spark, sf_dir).select(*feeds.FEED_SCHEMA.names, "commit_id")
    low, high = source.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    bounds = [low + (high - low) * i // 4 for i in (1, 2, 3)]
    # The first chunks are read when nothing of the feed has come, and then the sync breaks off.
    mirror.sync_in_chunks(source.where(F.col("o_orderkey") < bounds[1]), bounds[:1], lambda: -1, key="o_orderkey")
    mirror.apply(feed.where("commit_id <= 15"))
    mirror.sync_in_chunks(source, bounds, lambda: -1, key="o_orderkey")
    mirror.apply(feed.where("commit_id > 15"))
    state = mirror.state()
    return state.withColumn("k", F.col("props.k")).drop("props")


def guarded_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stale table replaced from the source once confirmed."""
    source = domain.plain_orders(spark, sf_dir)
    mirror = Mirror(spark, shared_dir(spark, "rebuild"), buckets=8)
    mirror.initial_sync(source.where("status <> 'P'"))
    mirror.rebuild(source, confirm=True)
    return mirror.state()


# --- reports -----------------------------------------------------------------------


def orders_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cents(reports.orders_by_region(domain.orders(spark, sf_dir)), "revenue")


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.find_order(domain.table(spark, sf_dir, "orders"), 7, key="o_orderkey")


def projected_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is compared as the scan has it, so that the scan can skip by it."""
    return reports.find_fields(domain.plain_orders(spark, sf_dir, key=7), "7", ("_id", "status", "amount", "channel"))


def parameterised_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by SQL text with a bound parameter."""
    domain.table(spark, sf_dir, "orders").createOrReplaceTempView("tidemark_orders")
    sql = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM tidemark_orders WHERE o_orderkey = :id"
    return spark.sql(sql, args={"id": 7})


def evolved_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one key before and after the new column came; no other key's documents are judged."""
    own = domain.feed(spark, sf_dir, late_field=True, key=8)
    typed = conform(feeds.keep_operations(own).where("operation_type <> 'delete'"), EVOLVED_SCHEMA).accepted
    return typed.select("_id", F.col("__seq").alias("seq"), "amount", "kind", F.col("props.k").alias("k"), "bonus")


def business_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.business_question(domain.orders(spark, sf_dir), domain.CANCELLED_STATUS, domain.APP_CHANNEL)


def business_question_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = reports.business_question_counts(domain.orders(spark, sf_dir), domain.CANCELLED_STATUS, domain.APP_CHANNEL)
    return _cents(raw, "receita", "ticket_medio")


def top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_products(domain.order_lines(spark, sf_dir))


def key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.key_counts(domain.table(spark, sf_dir, "lineitem"), "l_orderkey")


def status_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.status_distribution(domain.plain_orders(spark, sf_dir))


def status_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_channel = domain.plain_orders(spark, sf_dir).select(F.col("channel").alias("status"))
    return reports.status_distribution(by_channel, reports.STATUS_ROWS)


def tolerant_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts as text, some with a unit or no number at all."""
    amount = F.col("amount").cast("decimal(18,2)").cast("string")
    drifted = domain.plain_orders(spark, sf_dir).withColumn(
        "amount",
        F.when(F.col("status") == "P", F.concat(amount, F.lit("d")))
        .when(F.col("channel") == "5-LOW", F.lit("NaN"))
        .when(F.col("channel") == "2-HIGH", F.lit(None).cast("string"))
        .otherwise(amount),
    )
    return reports.tolerant_totals(drifted)


def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = apply.snapshots(domain.change_log(spark, sf_dir), domain.commits(spark, sf_dir))
    return apply.list_snapshots(history)


def snapshot_history_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the events arrive three commits late; superseded rows count nowhere."""
    late = domain.change_log(spark, sf_dir).withColumn(
        "commit_id", F.col("commit_id") + F.when(F.col("amount") < 50, 3).otherwise(0)
    )
    return apply.snapshot_changes(late)


def _late_mirror(spark: SparkSession, sf_dir: str) -> Mirror:
    """The feed committed in thirds of ten days, half of its events three commits late, in runs of three on levels."""
    mirror = Mirror(spark, shared_dir(spark, "late"), buckets=8, run_commits=3)
    third = F.floor((F.col("commit_id") - 1) / 3).cast("bigint") + F.when(F.col("amount") < 50, 3).otherwise(0)
    columns, files = [F.col(f.name).cast(f.dataType) for f in feeds.FEED_SCHEMA], shared_dir(spark, "late-feed")
    # Each batch in files of its own, so that a commit reads its own events and no others.
    domain.feed(spark, sf_dir).select(*columns, third.alias("third")).write.mode("overwrite").partitionBy("third").parquet(files)
    feed = spark.read.schema(T.StructType([*feeds.FEED_SCHEMA, T.StructField("third", T.LongType())])).parquet(files)
    for (one,) in feed.select("third").distinct().orderBy("third").collect():
        mirror.apply(feed.where(F.col("third") == one).drop("third"), "late", one)
        if one == 4:
            mirror.write_base()
    return mirror


def table_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of the table on disk: counts worked out as runs were sealed, and for the open run."""
    history = _late_mirror(spark, sf_dir).snapshots()
    return apply.list_snapshots(history).drop("committed_at")


def table_key_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key of the table on disk in each of its snapshots."""
    history = _late_mirror(spark, sf_dir).history("8")
    return history.select("snapshot_id", "key", "existed", "amount", F.col("props.k").alias("k"))


def version_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply.state_as_of(domain.change_log(spark, sf_dir), apply.check_version(domain.commits(spark, sf_dir), 7))


def timestamp_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = apply.version_at(domain.commits(spark, sf_dir), "2024-01-13 12:00:00")
    return apply.state_as_of(domain.change_log(spark, sf_dir), version)


def key_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply.key_history(domain.change_log(spark, sf_dir), domain.commits(spark, sf_dir), "8")


def key_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply.key_versions(domain.change_log(spark, sf_dir))


def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evolved feed's columns as its documents have them, with the day each first appeared."""
    kept = feeds.keep_operations(domain.feed(spark, sf_dir, late_field=True))
    rows = conform(kept).accepted.where(ALIVE)
    day = (F.date_diff(F.col(AT), F.lit(domain.DAY_ONE)) + 1).cast("bigint")
    return reports.table_columns(rows, day)


def result_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = domain.plain_orders(spark, sf_dir).orderBy(F.desc("amount"), "_id")
    return reports.page_frame(ranked).select("_id", "amount", "truncated")


# --- monitoring --------------------------------------------------------------------


def convergence_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current source against an up-to-date, a lagging, a duplicated and no lake."""
    log = domain.change_log(spark, sf_dir)
    now, earlier = apply.current_state(log.drop("commit_id")), apply.state_as_of(log, 4)
    lakes = {"current": now, "lagging": earlier, "duplicated": now.unionByName(earlier), "offline": None}
    rows = [
        convergence.convergence(now, lake, "key").withColumn("lake", F.lit(name)) for name, lake in lakes.items()
    ]
    result = rows[0]
    for row in rows[1:]:
        result = result.unionByName(row)
    return result


def content_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source against an equal lake, one of equal counts in which rows differ, and one that lags."""
    log = domain.change_log(spark, sf_dir)
    now, earlier = apply.current_state(log.drop("commit_id")).drop("seq"), apply.state_as_of(log, 4).drop("seq")
    other = F.when(F.col("k") % 10 == 7, F.col("amount") + 1).otherwise(F.col("amount"))
    lakes = {"equal": now, "altered": now.withColumn("amount", other), "lagging": earlier, "offline": None}
    rows = [convergence.content_convergence(now, lake, "key").withColumn("lake", F.lit(name)) for name, lake in lakes.items()]
    return reduce(DataFrame.unionByName, rows)


def table_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that stands at day 20, its base at day 15, against the source of day 30: what it lacks."""
    mirror = Mirror(spark, shared_dir(spark, "differing"), buckets=64)
    feed = domain.feed(spark, sf_dir).select(*feeds.FEED_SCHEMA.names, "commit_id")
    mirror.apply(feed.where("commit_id <= 15"))
    mirror.write_base()
    mirror.apply(feed.where("commit_id BETWEEN 16 AND 20"))
    now = apply.current_state(domain.change_log(spark, sf_dir).drop("commit_id"))
    return mirror.differences(now.select(F.col("key").alias("_id"), "amount"))


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convergence.duplicates(domain.table(spark, sf_dir, "events"), "user_id")


def lag_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint at the end of each commit against a feed retained from day 5 on."""
    retained = domain.feed(spark, sf_dir).where(F.col("commit_id") >= RETAINED_FROM_DAY)
    window = retained.agg(
        F.struct(F.min("cluster_time").alias("feed_start"), F.max("cluster_time").alias("feed_end"))
    ).scalar()
    positions = (
        domain.commits(spark, sf_dir)
        .withColumn("_window", window)
        .select("commit_id", F.col("committed_at").alias("checkpoint"), "_window.feed_start", "_window.feed_end")
    )
    return convergence.lag_state(positions).select("commit_id", "margem_segundos", "janela_segundos", "estado")


def feed_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that followed the feed's files up to day 20, against what the feed retains from day 5 on."""
    root = shared_dir(spark, "lag")
    _feed_files(spark, sf_dir, f"{root}/feed", 4, "commit_id <= 20")
    mirror = Mirror(spark, f"{root}/mirror", buckets=8)
    follow(mirror, feeds.stream_feed(spark, f"{root}/feed", max_files=2), f"{root}/checkpoint").awaitTermination()
    lag = mirror.lag(domain.feed(spark, sf_dir).where(F.col("commit_id") >= RETAINED_FROM_DAY))
    return lag.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("checkpoint", "feed_start", "feed_end")})


def _checks(spark: SparkSession, sf_dir: str, **others: Callable[[], DataFrame]) -> DataFrame:
    opened = {
        "feed": lambda: domain.feed(spark, sf_dir, lost_images=True),
        "dlq": lambda: _dead_letters(spark, sf_dir),
        "lake": lambda: domain.plain_orders(spark, sf_dir),
    }
    return convergence.preflight_checks(spark, **(opened | others))


def preflight_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report when the source is gone, when its connection is lost and when the lake is gone."""

    def gone() -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/no_such_table.parquet")

    def lost() -> DataFrame:
        raise ConnectionError("no answer from mongodb+srv://reader:word@cluster0.ab1cd.mongodb.net/shop")

    cases = {"source gone": {"feed": gone}, "source lost": {"feed": lost}, "lake gone": {"lake": gone}}
    reports_ = [_checks(spark, sf_dir, **case).withColumn("falta", F.lit(name)) for name, case in cases.items()]
    return reduce(DataFrame.unionByName, reports_)


def preflight_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checks(spark, sf_dir)


def preflight_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convergence.preflight_verdict(_checks(spark, sf_dir))


def _propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propagation.propagation(domain.poll_log(spark, sf_dir), F.lit("purchase"), POLL_TIMEOUT_S)


def write_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _propagation(spark, sf_dir)


def cycle_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propagation.cycle_steps(_propagation(spark, sf_dir)).select("sample_id", "op", "ok")


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = domain.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("op"),
        (F.col("value") < 90).alias("ok"),
        F.col("value").alias("visible_s"),
        F.get_json_object("props", "$.k").cast("bigint").alias("bytes"),
    )
    return propagation.latency_summary(samples)


def commit_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = feeds.keep_operations(domain.feed(spark, sf_dir))
    return propagation.latency_summary(propagation.commit_latency(kept, domain.commits(spark, sf_dir)), digits=1)


def event_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole feed beside what a table had, and what was counted, on day 29: stale where day 30 came after."""
    kept = feeds.keep_operations(domain.feed(spark, sf_dir))
    earlier = kept.where("commit_id <= 29")
    final = apply.latest(earlier, ["document_key"]).select("document_key", "full_document")
    expected = earlier.groupBy("document_key").agg(F.count(F.lit(1)).alias("expected_events"))
    return delivery.ordering_check(kept, final, expected)


def exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A consumer down from day 21 on, whose resume replays day 20 at the end."""
    before, missed, replayed = _consumption(spark, sf_dir)
    after = missed.agg(F.count(F.lit(1))).scalar()
    again = replayed.select((F.col("position") + after).alias("position"), "id")
    return delivery.exactly_once(missed, missed.unionByName(again), before, before)


def _consumption(spark: SparkSession, sf_dir: str, apart: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Positions and ids of what was consumed up to day 20, of what came after, and of day 20 alone."""
    ids = domain.feed(spark, sf_dir).select((F.col("seq") * F.lit(apart).cast("bigint")).alias("seq"), "commit_id")
    parts = [with_position(ids.where(days), "seq") for days in ("commit_id <= 20", "commit_id > 20", "commit_id = 20")]
    return tuple(part.select("position", F.col("seq").alias("id")) for part in parts)


def exactly_once_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`exactly_once`, of a feed whose ``seq`` is thinly spread."""
    before, missed, replayed = _consumption(spark, sf_dir, SPARSE)
    after = missed.agg(F.count(F.lit(1))).scalar()
    again = replayed.select((F.col("position") + after).alias("position"), "id")
    return delivery.exactly_once(missed, missed.unionByName(again), before, before)


def lost_and_swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resume that swaps its first two events and loses its third, after a first part that lost its second."""
    before, missed, _ = _consumption(spark, sf_dir)
    place = F.col("position")
    moved = F.when(place == 0, 1).when(place == 1, 0).otherwise(place).cast("bigint")
    got = missed.where(place != 2).select(moved.alias("position"), "id")
    return delivery.exactly_once(missed, got, before.where(place != 1), before)


def secret_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text redacted, as a digest, and the error text cut after redaction."""
    cleaned = domain.table(spark, sf_dir, "documents").select("doc_id", text.redact(F.col("text")).alias("redacted"))
    return cleaned.select("doc_id", F.md5("redacted").alias("redacted_md5"), text.cut(F.col("redacted")).alias("message"))


def masking_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = domain.table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.col("c_name").alias("contactEmail"),
        F.struct(F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("apiToken")).alias("account"),
        F.array(F.struct(F.col("c_name").alias("Password"), F.col("c_nationkey").alias("nation"))).alias("logins"),
    )
    masked = names.mask_by_name(source)
    return masked.select(
        "c_custkey",
        "contactEmail",
        "account.balance",
        "account.apiToken",
        F.col("logins")[0]["Password"].alias("Password"),
        F.col("logins")[0]["nation"].alias("nation"),
    )


def identifier_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, addresses, whole texts and numbers judged as order, query and snapshot ids."""
    values = (
        domain.table(spark, sf_dir, "customer").select(F.translate("c_name", "#", "-").alias("value"))
        .unionByName(domain.table(spark, sf_dir, "pages").select(F.col("url").alias("value")))
        .unionByName(domain.table(spark, sf_dir, "documents").select(F.col("text").alias("value")))
        .unionByName(domain.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("value")))
    )
    value = F.col("value")
    judged = values.select(
        F.md5(value).alias("value_md5"),
        text.is_order_id(value).alias("order_id"),
        text.is_query_id(value).alias("query_id"),
        text.is_snapshot_id(value).alias("snapshot_id"),
    )
    return judged.groupBy("value_md5", "order_id", "query_id", "snapshot_id").agg(F.count(F.lit(1)).alias("copies"))


# --- building changes --------------------------------------------------------------


def _midway(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = apply.state_as_of(domain.change_log(spark, sf_dir), MIDWAY)
    return state.select(F.col("key").alias("_id"), "amount", "k")


def _later(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    events = domain.feed(spark, sf_dir).where(F.col("commit_id") > MIDWAY)
    return events.where(F.col("operation_type").isin(*kinds)).withColumnRenamed("document_key", "_id")


def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _later(spark, sf_dir, "insert", "update").select("_id", "seq", "amount", "k")
    return changes.upsert(_midway(spark, sf_dir), documents)


def upsert_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`upsert_documents`, of a feed whose ``seq`` is thinly spread, and with every key a large one."""
    seq = (F.col("seq") * F.lit(SPARSE).cast("bigint")).alias("seq")
    documents = _later(spark, sf_dir, "insert", "update").select("_id", seq, "amount", "k")
    return changes.upsert(_midway(spark, sf_dir), documents, width=LARGE_KEY)


def upsert_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current documents written once more, and a few raised: only those are events."""
    now = _midway(spark, sf_dir)
    raised = F.when(F.col("amount") > 50, F.col("amount") + 1).otherwise(F.col("amount"))
    return changes.upsert(now, now.withColumn("amount", raised).withColumn("seq", F.lit(10**9).cast("bigint")))


def patch_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small values set the amount, large ones ``k``, the rest both."""
    patches = _later(spark, sf_dir, "update").select(
        "_id",
        "seq",
        F.when(F.col("amount") < 60, F.col("amount")).alias("amount"),
        F.when(F.col("amount") > 30, F.col("k")).alias("k"),
    )
    return changes.patch(_midway(spark, sf_dir), patches)[0]


def patch_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    patches = _later(spark, sf_dir, "update").select("_id", "seq", "amount")
    return changes.patch(_midway(spark, sf_dir), patches)[1].select("_id", "seq")


def delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.delete_keys(_midway(spark, sf_dir), _later(spark, sf_dir, "delete"), 10**9)


def _reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = domain.change_log(spark, sf_dir)
    now = apply.current_state(log.drop("commit_id")).drop("seq").withColumnRenamed("key", "_id")
    goal = apply.state_as_of(log, BASELINE).drop("seq").withColumnRenamed("key", "_id")
    return changes.reconcile(now, goal)


def reconcile_to_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reset(spark, sf_dir)


def reconcile_unequal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reset by digests of buckets: what changes, read from the unequal ones."""
    log = domain.change_log(spark, sf_dir)
    now = apply.current_state(log.drop("commit_id")).drop("seq").withColumnRenamed("key", "_id")
    goal = apply.state_as_of(log, BASELINE).drop("seq").withColumnRenamed("key", "_id")
    return changes.reconcile_unequal(now, goal)


def reset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reset's counts, held against the baseline; the feed's rejects are what it clears."""
    baseline = apply.state_as_of(domain.change_log(spark, sf_dir), BASELINE)
    return changes.reconcile_report(_reset(spark, sf_dir), ["8", "46"], baseline=baseline, dlq=_dead_letters(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "s1_feed_batch": feed_batch,
    "s2_initial_sync": initial_sync,
    "s3_operation_filter": operation_filter,
    "s4_payload_selection": payload_selection,
    "s5_post_image_requirement": post_image_requirement,
    "s6_sanitised_names": sanitised_names,
    "s6_sanitised_key_strings": sanitised_key_strings,
    "s7_schema_evolution": schema_evolution,
    "s8_type_check": type_check,
    "s8_many_forms": many_forms,
    "s9_dead_letter_count": dead_letter_count,
    "s9_dead_letter_samples": dead_letter_samples,
    "s9_dead_letter_newest": dead_letter_newest,
    "s10_keyed_apply": keyed_apply,
    "s11_commit_writer": commit_writer,
    "s12_stream_apply": stream_apply,
    "s2_synced_table": synced_table,
    "s13_guarded_rebuild": guarded_rebuild,
    "q1_orders_by_region": orders_by_region,
    "q2_point_lookup": point_lookup,
    "q3_projected_lookup": projected_lookup,
    "q3_parameterised_lookup": parameterised_lookup,
    "q4_evolved_lookup": evolved_lookup,
    "q5_business_question": business_question,
    "q6_business_question_counts": business_question_counts,
    "q7_top_products": top_products,
    "q8_key_counts": key_counts,
    "q9_status_distribution": status_distribution,
    "q9_status_top": status_top,
    "q10_tolerant_totals": tolerant_totals,
    "q11_snapshot_history": snapshot_history,
    "q11_snapshot_history_late": snapshot_history_late,
    "q11_table_snapshots": table_snapshots,
    "q12_version_as_of": version_as_of,
    "q13_timestamp_as_of": timestamp_as_of,
    "q14_key_history": key_history,
    "q14_key_versions": key_versions,
    "q14_table_key_history": table_key_history,
    "q15_table_columns": table_columns,
    "q16_result_page": result_page,
    "m1_convergence_states": convergence_states,
    "m1_content_convergence": content_states,
    "m1_table_differences": table_differences,
    "m2_duplicate_keys": duplicate_keys,
    "m3_lag_states": lag_states,
    "m3_feed_lag": feed_lag,
    "m4_preflight_report": preflight_report,
    "m4_preflight_verdict": preflight_verdict,
    "m4_preflight_failures": preflight_failures,
    "m5_write_propagation": write_propagation,
    "m6_cycle_rule": cycle_rule,
    "m7_latency_summary": latency_summary,
    "m8_commit_latency": commit_latency,
    "m9_event_ordering": event_ordering,
    "m10_exactly_once": exactly_once,
    "m10_exactly_once_sparse_seq": exactly_once_sparse,
    "m10_lost_and_swapped": lost_and_swapped,
    "m11_secret_redaction": secret_redaction,
    "m12_masking_by_name": masking_by_name,
    "m13_identifier_rules": identifier_rules,
    "w1_upsert_documents": upsert_documents,
    "w1_upsert_sparse_seq": upsert_sparse,
    "w1_upsert_again": upsert_again,
    "w2_patch_fields": patch_fields,
    "w2_patch_unmatched": patch_unmatched,
    "w3_delete_by_key": delete_by_key,
    "w4_reconcile_to_baseline": reconcile_to_baseline,
    "w4_reconcile_unequal": reconcile_unequal,
    "w4_reset_report": reset_report,
}
