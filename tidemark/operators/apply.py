"""Applying changes by key, and reading the result at any commit.

A change frame has one row per event with ``key``, ``seq`` (order of the feed),
``alive`` (False for a delete) and the document columns; for reads by version it
also has ``commit_id``.  Nothing here touches files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.names import column

# How a snapshot describes itself.
APPEND, OVERWRITE, DELETE = "append", "overwrite", "delete"
ADDED, REMOVED = "added-records", "deleted-records"
LISTED_SNAPSHOTS = 20


class UnknownSnapshot(ValueError):
    """The snapshot asked for was never committed."""


def to_changes(feed: DataFrame, *columns: Column | str) -> DataFrame:
    """Feed events as change rows: key, seq, alive and the given columns."""
    return feed.select(
        F.col("document_key").alias("key"),
        "seq",
        (F.col("operation_type") != "delete").alias("alive"),
        *columns,
    )


def latest(changes: DataFrame, by: list[str], seq: str = "seq") -> DataFrame:
    """The row with the highest ``seq`` of each group; ties carry equal rows.

    Spark keeps one row per group and task before the shuffle (a partial window
    group limit), so a hot key costs no more than one row per task, and columns
    nobody reads are pruned through it.
    """
    newest_first = Window.partitionBy(*by).orderBy(F.desc(seq))
    return changes.withColumn("__rank", F.row_number().over(newest_first)).where("__rank = 1").drop("__rank")


def current_state(changes: DataFrame, key: str = "key", seq: str = "seq", alive: str = "alive") -> DataFrame:
    """One row per living key: last event wins, whole rows, deleted keys gone."""
    return latest(changes, [key], seq).where(F.col(alive)).drop(alive)


def state_as_of(changes: DataFrame, version: int, **names: str) -> DataFrame:
    """The state after commit ``version``."""
    return current_state(changes.where(F.col("commit_id") <= F.lit(version)).drop("commit_id"), **names)


def check_version(commits: DataFrame, version: int) -> int:
    """``version`` if it was committed; an error otherwise, never an empty result."""
    known = 1 <= version <= 2**63 - 1 and commits.where(F.col("commit_id") == F.lit(version)).take(1)
    if not known:
        raise UnknownSnapshot(f"no snapshot {version}")
    return version


def version_at(commits: DataFrame, instant: str) -> int:
    """The last commit at or before an instant; one row of commit metadata is read."""
    at_or_before = commits.where(F.col("committed_at") <= F.lit(instant).cast(commits.schema["committed_at"].dataType))
    row = at_or_before.agg(F.max(F.struct("committed_at", "commit_id")).alias("m")).first()
    if row.m is None:
        raise UnknownSnapshot(f"no snapshot at or before {instant}")
    return row.m.commit_id


def effective_changes(changes: DataFrame, collapsed: bool = False) -> DataFrame:
    """The rows that changed the visible state, one per key and commit.

    A row that arrives after a newer ``seq`` of its key was committed changes
    nothing and is left out.  ``collapsed`` says the frame already holds one row
    per key and commit, as the mirror's files do.
    """
    rows = changes if collapsed else latest(changes, ["commit_id", "key"])
    so_far = Window.partitionBy("key").orderBy("commit_id").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("__before", F.max("seq").over(so_far))
        .where(F.col("__before").isNull() | (F.col("seq") > F.col("__before")))
        .drop("__before")
    )


def snapshot_changes(changes: DataFrame, collapsed: bool = False) -> DataFrame:
    """Rows added and removed by each commit, and the kind of commit."""
    in_order = Window.partitionBy("key").orderBy("commit_id")
    steps = (
        effective_changes(changes.select("commit_id", "key", "seq", "alive"), collapsed)
        .withColumn("__was", F.coalesce(F.lag("alive").over(in_order), F.lit(False)))
        .where(F.col("alive") | F.col("__was"))
    )
    return (
        steps.groupBy("commit_id")
        .agg(
            F.count_if(F.col("alive")).alias("added"),
            F.count_if(F.col("__was")).alias("removed"),
        )
        .select("commit_id", snapshot_kind(), "added", "removed")
    )


def snapshot_kind() -> Column:
    """``operation``: what a commit that added and removed so many rows is called."""
    kind = F.when(F.col("removed") == 0, APPEND).when(F.col("added") == 0, DELETE).otherwise(OVERWRITE)
    return kind.alias("operation")


def snapshots(changes: DataFrame, commits: DataFrame, collapsed: bool = False) -> DataFrame:
    """Snapshot history: id, time, operation and the summary map."""
    return summarised(snapshot_changes(changes, collapsed).join(commits, "commit_id"))


def summarised(counted: DataFrame) -> DataFrame:
    """The history's columns from each commit's time and counts."""
    return counted.select(
        F.col("commit_id").alias("snapshot_id"),
        "committed_at",
        snapshot_kind(),
        F.create_map(
            F.lit(ADDED), F.col("added").cast("string"), F.lit(REMOVED), F.col("removed").cast("string")
        ).alias("summary"),
    )


def list_snapshots(history: DataFrame, rows: int = LISTED_SNAPSHOTS) -> DataFrame:
    """Newest snapshots first, with the counts taken out of the summary."""
    return (
        history.select(
            "snapshot_id",
            "committed_at",
            "operation",
            F.col("summary")[ADDED].alias("adicionados"),
            F.col("summary")[REMOVED].alias("removidos"),
        )
        .orderBy(F.desc("committed_at"), F.desc("snapshot_id"))
        .limit(rows)
    )


def key_versions(changes: DataFrame, collapsed: bool = False) -> DataFrame:
    """Every version of every key: the commits ``[valid_from, valid_to)`` it was visible in.

    ``existed`` is False for the span after a delete; ``valid_to`` is NULL for the
    version still visible.
    """
    in_order = Window.partitionBy("key").orderBy("valid_from")
    return (
        effective_changes(changes, collapsed)
        .withColumnsRenamed({"commit_id": "valid_from", "alive": "existed"})
        .withColumn("valid_to", F.lead("valid_from").over(in_order))
    )


def key_history(changes: DataFrame, commits: DataFrame, key: str, collapsed: bool = False) -> DataFrame:
    """How one key looked in each snapshot; ``existed`` is False where it was absent.

    Only the key's own change rows are read, and one row per commit is ordered.
    """
    rows = effective_changes(changes.where(F.col("key") == F.lit(key)), collapsed)
    fields = [c for c in rows.columns if c not in ("commit_id", "key", "seq", "alive")]
    version = rows.select("commit_id", F.struct("alive", *[column(c) for c in fields]).alias("__version"))
    in_order = Window.partitionBy("key").orderBy("commit_id")
    seen = (
        commits.select("commit_id", "committed_at", F.lit(key).alias("key"))
        .join(version, "commit_id", "left")
        .withColumn("__version", F.last("__version", ignorenulls=True).over(in_order))
    )
    existed = F.coalesce(F.col("__version.alive"), F.lit(False))
    return seen.select(
        F.col("commit_id").alias("snapshot_id"),
        "committed_at",
        "key",
        existed.alias("existed"),
        *[F.when(existed, F.col("__version").getField(c)).alias(c) for c in fields],
    ).orderBy("snapshot_id")
