"""Writes expressed as change events against the current state.

``current`` holds one row per key.  Each function returns events with ``seq``,
``operation_type``, the key and the document columns after the write; an event
that would change nothing is not produced.  :func:`as_feed` turns them into feed
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.documents import encode_document
from tidemark.functions.names import column
from tidemark.functions.spread import WIDTH, filled_before, previous_in_group
from tidemark.operators.digests import BUCKETS, digest_tree, in_buckets, unequal_buckets

_OLDEST = -(2**63)


class UnknownKey(ValueError):
    """An update named a key that does not exist."""


def _fields(frame: DataFrame, key: str, order: str) -> list[str]:
    return [c for c in frame.columns if c not in (key, order)]


def _touched(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The current rows of the incoming keys; a small batch is broadcast, not the state.

    Keys are made distinct first, before their shuffle, so a key that fills a
    third of the batch arrives once per task.
    """
    return current.join(incoming.select(key).distinct(), key, "left_semi")


def _on_top(current: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """The batch with each touched key's current row placed before it."""
    state = _touched(current, incoming, key).withColumn(order, F.lit(_OLDEST).cast("bigint"))
    return state.withColumn("_stored", F.lit(True)).unionByName(
        incoming.withColumn("_stored", F.lit(False)), allowMissingColumns=True
    )


def upsert(
    current: DataFrame, documents: DataFrame, key: str = "_id", order: str = "seq", width: int = WIDTH
) -> DataFrame:
    """Whole documents by key: ``insert`` where absent, ``replace`` where different.

    Several documents of one key in a batch apply in ``order``.
    """
    rows = _on_top(current, documents, key, order)
    fields = _fields(rows.drop("_stored"), key, order)
    document = F.struct(*fields)
    return (
        previous_in_group(rows, [key], order, document, "_previous", width)
        .where(~F.col("_stored"))
        .select(
            order,
            F.when(F.col("_previous").isNull(), "insert")
            .when(~F.col("_previous").eqNullSafe(document), "replace")
            .alias("operation_type"),
            key,
            *fields,
        )
        .where(F.col("operation_type").isNotNull())
    )


def patch(
    current: DataFrame, patches: DataFrame, key: str = "_id", order: str = "seq", width: int = WIDTH
) -> tuple[DataFrame, DataFrame]:
    """Sets the non-NULL fields of each patch row on the existing document.

    Returns the ``update`` events, which carry the whole merged document, and the
    patch rows whose key does not exist.
    """
    rows = _on_top(current, patches, key, order)
    fields = _fields(rows.drop("_stored"), key, order)
    found = _touched(current, patches, key).select(key)
    changed = F.lit(False)
    for c in _fields(patches, key, order):
        changed = changed | (F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_before_{c}")))
    events = (
        filled_before(rows.join(found, key, "left_semi"), [key], order, fields, "_before_", width)
        .where(~F.col("_stored") & changed)
        .select(
            order,
            F.lit("update").alias("operation_type"),
            key,
            *[F.coalesce(F.col(c), F.col(f"_before_{c}")).alias(c) for c in fields],
        )
    )
    return events, patches.join(found, key, "left_anti")


def patch_existing(current: DataFrame, patches: DataFrame, key: str = "_id", order: str = "seq") -> DataFrame:
    """As :func:`patch`, but a missing key is an error, as for a single update."""
    events, unmatched = patch(current, patches, key, order)
    missing = unmatched.select(key).take(1)
    if missing:
        raise UnknownKey(f"no document {missing[0][0]}")
    return events


def delete_keys(current: DataFrame, keys: DataFrame, seq: int | Column, key: str = "_id") -> DataFrame:
    """``delete`` events for the keys that exist; their count is the number removed."""
    order = seq if isinstance(seq, Column) else F.lit(seq).cast("bigint")
    return current.select(key).join(keys.select(key).distinct(), key, "left_semi").select(
        order.alias("seq"), F.lit("delete").alias("operation_type"), key
    )


def reconcile(current: DataFrame, baseline: DataFrame, key: str = "_id") -> DataFrame:
    """What brings ``current`` to ``baseline``: insert, replace, delete or noop per key."""
    fields = [c for c in baseline.columns if c != key]
    now = current.select(F.col(key), F.struct(*[column(c) for c in fields]).alias("_now"))
    goal = baseline.select(F.col(key), F.struct(*[column(c) for c in fields]).alias("_goal"))
    return now.join(goal, key, "full_outer").select(
        key,
        F.when(F.col("_goal").isNull(), "delete")
        .when(F.col("_now").isNull(), "insert")
        .when(F.col("_now").eqNullSafe(F.col("_goal")), "noop")
        .otherwise("replace")
        .alias("action"),
        *[F.col("_goal").getField(c).alias(c) for c in fields],
    )


def reconcile_unequal(current: DataFrame, baseline: DataFrame, key: str = "_id", buckets: int = BUCKETS) -> DataFrame:
    """The rows of :func:`reconcile` that are no ``noop``, from the buckets of keys whose digests differ.

    Both sides are digested by the baseline's fields; only unequal buckets are read again and joined.
    """
    now = current.select(*[column(c) for c in baseline.columns])
    chosen = unequal_buckets(digest_tree(now, key, buckets), digest_tree(baseline, key, buckets), buckets)
    sides = (in_buckets(side, chosen, key, buckets) for side in (now, baseline))
    return reconcile(*sides, key).where("action <> 'noop'")


def reconcile_events(current: DataFrame, baseline: DataFrame, seq: int, key: str = "_id") -> DataFrame:
    """The events of :func:`reconcile`; none when current equals baseline."""
    fields = [c for c in baseline.columns if c != key]
    return (
        reconcile(current, baseline, key)
        .where(F.col("action") != "noop")
        .select(F.lit(seq).cast("bigint").alias("seq"), F.col("action").alias("operation_type"), key, *fields)
    )


def reconcile_report(
    actions: DataFrame, live_keys: list[str], key: str = "_id", *, baseline: DataFrame, dlq: DataFrame
) -> DataFrame:
    """Counts of a reset: live rows and strays removed, rows written, total, rejects cleared.

    ``ok`` says that the table will hold as many rows as the baseline has.
    """
    goal = baseline.agg(F.count(F.lit(1))).scalar()
    cleared = dlq.agg(F.count(F.lit(1))).scalar()
    deleted = F.col("action") == "delete"
    live = F.col(key).cast("string").isin(*live_keys) if live_keys else F.lit(False)
    return actions.agg(
        F.count_if(deleted & live).alias("live_removed"),
        F.count_if(deleted & ~live).alias("strays_removed"),
        F.count_if(F.col("action").isin("insert", "replace")).alias("seed_upserted"),
        F.count_if(~deleted).alias("total"),
        F.count_if(F.col("action") == "noop").alias("unchanged"),
    ).withColumns({"dlq_cleared": cleared, "ok": F.col("total") == goal})


def as_feed(events: DataFrame, cluster_time: Column, key: str = "_id") -> DataFrame:
    """Events as feed rows: the document becomes JSON, a delete carries none."""
    document = encode_document(events.drop("seq", "operation_type"))
    return events.select(
        "seq",
        cluster_time.alias("cluster_time"),
        "operation_type",
        F.col(key).cast("string").alias("document_key"),
        F.when(F.col("operation_type") != "delete", document).alias("full_document"),
    )
