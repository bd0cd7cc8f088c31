"""The mirror table: an append-only, versioned change log in parquet.

::

    <root>/epochs/epoch=<e>           marker: the epoch is complete; names its folder
    <folder>/changes/__commit=<n>     one row per key the commit touched
    <folder>/base/__commit=<n>/__bucket=<b>  whole state, deleted keys kept as tombstones
    <folder>/bases/__run=<r>/__commit=<n>    marker of a finished base
    <folder>/dlq/__commit=<n>         rejected documents
    <folder>/commits/__run=<r>/__commit=<n>  marker, written last: the commit exists
    <folder>/ledger/__level=<l>/__run=<r>    the markers of a run of commits in one file
    <folder>/rollups/__level=<l>/__run=<r>   its change rows, by key, if they are few enough
    <folder>/runs/__level=<l>/__run=<r>      marker of a sealed run: what it holds in all

A directory without its marker is invisible and is overwritten by the retry that
takes its number.

Commits are sealed in runs on levels: a run of level ``l`` is ``run_commits ** l`` commits,
so any stretch of commits is some runs, their number a logarithm of its length, whose
paths follow from their numbers alone; no folder that grows with the table's age is
listed. Sealing copies the markers into one file, adds to them the rows each commit
added and removed, worked out once, and writes the change rows together, sorted by key
and with a Bloom filter of the keys, as long as they are no more than ``roll_rows``;
beyond, the files are large enough to be read one by one. The newest marker carries what
a writer needs: the last batch of every stream, the newest base and the rows since.

A state read is the newest base at or below the version plus the change rows after it,
so only the tail is aggregated.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameWriter, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.documents import encode_document
from tidemark.functions.names import column
from tidemark.operators import apply
from tidemark.operators.apply import UnknownSnapshot
from tidemark.operators.changes import reconcile
from tidemark.operators.convergence import feed_lag
from tidemark.operators.conform import ALIVE, AT, BUCKET, COMMIT, KEY, SEQ, Conformed, Memory, conform, table_type
from tidemark.operators.digests import bucket_of, digest_tree, in_buckets, unequal_buckets
from tidemark.operators.reports import table_columns
from tidemark.session import shared_dir
from tidemark.sources.feed import keep_operations

# Fixed value: the reason of rows that share a key in an initial sync.
DUPLICATE_REASON = "duplicate document key"
BUCKETS = 64
LEVEL, RUN = "__level", "__run"
RUN_COMMITS = 32
ROLL_ROWS = 4_000_000
ROLL_FILE_ROWS = 1_000_000
BASE_SHARE = 0.2
BASE_MIN_ROWS = 1_000_000
# Keys that a base file's Bloom filter is made for.
BASE_FILE_KEYS = 1_000_000
OWN_FIELDS = [
    T.StructField(KEY, T.StringType()),
    T.StructField(SEQ, T.LongType()),
    T.StructField(AT, T.TimestampType()),
    T.StructField(ALIVE, T.BooleanType()),
]
COMMIT_SCHEMA = T.StructType(
    [
        T.StructField(COMMIT, T.LongType()),
        T.StructField("committed_at", T.TimestampType()),
        T.StructField("stream_id", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("schema_json", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("rejected", T.LongType()),
        T.StructField("min_seq", T.LongType()),
        T.StructField("max_seq", T.LongType()),
        T.StructField("cluster_time", T.TimestampType()),
        # What came before, so that the newest marker is enough to go on from.
        T.StructField("synced", T.BooleanType()),
        T.StructField("base_at", T.LongType()),
        T.StructField("base_rows", T.LongType()),
        T.StructField("base_max_seq", T.LongType()),
        T.StructField("tail_rows", T.LongType()),
        T.StructField(
            "streams",
            T.MapType(
                T.StringType(), T.StructType([T.StructField("batch_id", T.LongType()), T.StructField("commit", T.LongType())])
            ),
        ),
    ]
)
LEDGER_SCHEMA = T.StructType(
    [*COMMIT_SCHEMA.fields, T.StructField("added", T.LongType()), T.StructField("removed", T.LongType())]
)
RUN_SCHEMA = T.StructType(
    [
        T.StructField("level", T.LongType()),
        T.StructField("run", T.LongType()),
        T.StructField("rows", T.LongType()),
        T.StructField("min_seq", T.LongType()),
        T.StructField("max_seq", T.LongType()),
        T.StructField("rolled", T.BooleanType()),
    ]
)
BASE_SCHEMA = T.StructType([T.StructField("rows", T.LongType()), T.StructField("max_seq", T.LongType())])
DLQ_SCHEMA = T.StructType(
    [
        T.StructField(COMMIT, T.LongType()),
        T.StructField("dlq_time", T.TimestampType()),
        T.StructField("err_info", T.StructType([T.StructField("reason", T.StringType())])),
        T.StructField("doc", T.StringType()),
    ]
)
EPOCH_SCHEMA = T.StructType(
    [
        T.StructField("epoch", T.LongType()),
        T.StructField("buckets", T.IntegerType()),
        T.StructField("run_commits", T.IntegerType()),
        T.StructField("roll_rows", T.LongType()),
        T.StructField("folder", T.StringType()),
    ]
)
TABLES = {
    "dlq": DLQ_SCHEMA,
    "dlq_cleared": T.StructType([T.StructField(COMMIT, T.LongType()), T.StructField("rows", T.LongType())]),
}


class RebuildRefused(RuntimeError):
    """A destructive step was not confirmed."""


@dataclass
class Piece:
    """A commit (level 0) or a sealed run, and where its change rows are."""

    level: int
    run: int
    rows: int
    min_seq: int | None
    max_seq: int | None
    path: str


@dataclass
class Tail:
    """What a state read needs: a base or none, and the pieces after it."""

    version: int
    schema: T.StructType
    base: Row | None
    pieces: list[Piece]

    @property
    def late(self) -> bool:
        """Whether the tail may hold events older than the base."""
        if self.base is None or self.base.max_seq is None:
            return False
        return any(p.min_seq is not None and p.min_seq <= self.base.max_seq for p in self.pieces)


class Mirror:
    """A table kept equal to its source by applying the change feed."""

    def __init__(
        self, spark: SparkSession, root: str, buckets: int = BUCKETS, run_commits: int = RUN_COMMITS, roll_rows: int = ROLL_ROWS
    ):
        """Opens the table at ``root``; the sizes are used when there is none yet."""
        if run_commits < 2:
            raise ValueError("a run has two commits at least")
        self.spark = spark
        self.root = root.rstrip("/")
        last = self._epochs().orderBy(F.desc("epoch")).first()
        if last is None:
            last = self._prepare(1, buckets, run_commits, roll_rows)
            self._open(last)
        self._use(last)

    def _use(self, epoch: Row) -> None:
        self.epoch, self.buckets, self.run_commits, self.roll_rows = epoch.epoch, epoch.buckets, epoch.run_commits, epoch.roll_rows
        self._home = f"{self.root}/{epoch.folder}"
        self._newest: Row | None = None
        self._sealed_runs = 0
        self._memory = Memory()

    # --- files -----------------------------------------------------------------

    def _epochs(self) -> DataFrame:
        return self._read_or_none(EPOCH_SCHEMA, f"{self.root}/epochs") or self.spark.createDataFrame([], EPOCH_SCHEMA)

    def _read_or_none(self, schema: T.StructType, path: str) -> DataFrame | None:
        """A table that may not be there; finding out is no job."""
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _marked(self, schema: T.StructType, path: str) -> DataFrame | None:
        """A marker's row, or None where it was not written to its end."""
        return self._read_or_none(schema, f"{self._home}/{path}/*.parquet")

    def _prepare(self, epoch: int, buckets: int, run_commits: int, roll_rows: int) -> Row:
        """A new folder with its empty tables; nobody sees it until it is opened."""
        folder = f"epoch-{epoch}-{self.spark.sql('SELECT uuid()').first()[0]}"
        for name, schema in TABLES.items():
            self._empty(f"{folder}/{name}/{COMMIT}=0", schema)
        self._empty(f"{folder}/commits/{RUN}=0/{COMMIT}=0", COMMIT_SCHEMA)
        return Row(epoch=epoch, buckets=buckets, run_commits=run_commits, roll_rows=roll_rows, folder=folder)

    def _empty(self, path: str, schema: T.StructType) -> None:
        """A table's first, empty part, so that it can be read before anything is in it."""
        kept = [f for f in schema.fields if f"{f.name}=" not in path]
        self.spark.createDataFrame([], T.StructType(kept)).write.mode("overwrite").parquet(f"{self.root}/{path}")

    def _open(self, epoch: Row) -> None:
        schema = T.StructType(EPOCH_SCHEMA.fields[1:])
        values = [epoch.buckets, epoch.run_commits, epoch.roll_rows, epoch.folder]
        self._mark(f"{self.root}/epochs/epoch={epoch.epoch}", values, schema)

    def _table(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        return self.spark.read.schema(schema or TABLES[name]).parquet(f"{self._home}/{name}")

    def _mark(self, path: str, values: list, schema: T.StructType) -> None:
        """One small file whose appearance makes everything before it visible."""
        self.spark.createDataFrame([values], schema).coalesce(1).write.mode("overwrite").parquet(path)

    # --- runs of commits ---------------------------------------------------------

    def _sealed(self) -> int:
        """How many runs of the first level are sealed, found by asking for ever later ones and then halving."""
        there = lambda run: self._marked(RUN_SCHEMA, f"runs/{LEVEL}=1/{RUN}={run}") is not None
        low, step = self._sealed_runs, 1
        while there(low + step - 1):
            low, step = low + step, step * 2
        high = low + step - 1
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if there(middle) else (low, middle)
        self._sealed_runs = low
        return low

    def _cover(self, after: int, upto: int) -> list[tuple[int, int]]:
        """Level and run of the fewest runs, and single commits (level 0), that are the commits ``after + 1 .. upto``."""
        size, sealed, n, found = self.run_commits, self._sealed_runs * self.run_commits, after, []
        while n < upto:
            level = 0
            while n % size ** (level + 1) == 0 and n + size ** (level + 1) <= min(upto, sealed):
                level += 1
            found.append((level, n // size**level))
            n += size**level
        return found

    def _open_run(self, run: int) -> DataFrame:
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(f"{self._home}/commits/{RUN}={run}")

    def _markers(self, runs: list[tuple[int, int]]) -> DataFrame:
        """The commit markers of sealed runs of level 1 and more, one file each."""
        paths = [f"{self._home}/ledger/{LEVEL}={level}/{RUN}={run}" for level, run in runs]
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], LEDGER_SCHEMA)

    def _head(self) -> Row | None:
        """The newest commit's marker. A writer knows it; what others wrote since shows by the next marker being there."""
        known = self._newest
        if known is not None:
            number = known[COMMIT]
            if self._marked(COMMIT_SCHEMA, f"commits/{RUN}={number // self.run_commits}/{COMMIT}={number + 1}") is None:
                return self._with_base(known)
        sealed = self._sealed()
        newest = self._open_run(sealed).orderBy(F.desc(COMMIT)).first()
        if newest is None and sealed:
            # The writer ended between sealing a run and its next commit.
            newest = self._markers([(1, sealed - 1)]).orderBy(F.desc(COMMIT)).first()
        self._newest = newest
        return self._with_base(newest) if newest else None

    def _with_base(self, marker: Row) -> Row:
        """The marker with the base written after its commit, if there is one."""
        number = marker[COMMIT]
        if marker.base_at == number:
            return marker
        base = self._marked(BASE_SCHEMA, f"bases/{RUN}={(number - 1) // self.run_commits}/{COMMIT}={number}")
        row = base.first() if base is not None else None
        if row is None:
            return marker
        known = marker.asDict() | {"base_at": number, "base_rows": row.rows, "base_max_seq": row.max_seq, "tail_rows": 0}
        return Row(**known)

    def _marker(self, version: int | None) -> Row | None:
        """A commit's marker with its base, the newest without a version."""
        head = self._head()
        if head is None or version is None or version == head[COMMIT]:
            return head
        if version > head[COMMIT]:
            return None
        self._sealed()
        run = (version - 1) // self.run_commits
        rows = self._markers([(1, run)]) if run < self._sealed_runs else self._open_run(run)
        found = rows.where(F.col(COMMIT) == version).first()
        return self._with_base(found) if found else None

    def _pieces(self, after: int, upto: int) -> list[Piece]:
        """What the commits ``after + 1 .. upto`` hold, in as few pieces as their sizes allow; empty ones are left out.

        A run too large to be rolled up is looked at again in its parts.
        """
        self._sealed()
        wanted, found = self._cover(after, upto), []
        while wanted:
            runs = [f"{self._home}/runs/{LEVEL}={level}/{RUN}={run}" for level, run in wanted if level]
            singles = sorted({run // self.run_commits for level, run in wanted if not level})
            commits = [run + 1 for level, run in wanted if not level]
            shown = []
            if runs:
                shown.append(self.spark.read.schema(RUN_SCHEMA).parquet(*runs).withColumn("path", F.lit("")))
            if singles:
                markers = self._markers([(1, r) for r in singles if r < self._sealed_runs])
                for run in singles:
                    markers = markers.unionByName(self._open_run(run)) if run >= self._sealed_runs else markers
                shown.append(
                    markers.where(F.col(COMMIT).between(min(commits), max(commits)) & F.col(COMMIT).isin(*commits)).select(
                        F.lit(0).cast("bigint").alias("level"), (F.col(COMMIT) - 1).alias("run"), "rows", "min_seq", "max_seq",
                        F.lit(True).alias("rolled"), "path",
                    )
                )
            wanted = []
            for row in reduce(DataFrame.unionByName, shown).collect():
                if row.rolled and row.rows:
                    path = row.path or f"rollups/{LEVEL}={row.level}/{RUN}={row.run}"
                    found.append(Piece(row.level, row.run, row.rows, row.min_seq, row.max_seq, path))
                elif row.rows:
                    wanted += [(row.level - 1, row.run * self.run_commits + i) for i in range(self.run_commits)]
        return sorted(found, key=lambda p: p.run * self.run_commits**p.level)

    def _log(self, pieces: list[Piece], schema: T.StructType, key: str | None = None) -> DataFrame:
        """All change rows of some pieces with their commit. A key is looked for by range and Bloom filter of the sorted files."""
        whole = T.StructType([*OWN_FIELDS, *schema.fields, T.StructField(COMMIT, T.LongType())])
        rolled = [f"{self._home}/{p.path}" for p in pieces if p.level]
        singles = [f"{self._home}/{p.path}" for p in pieces if not p.level]
        logs = []
        if rolled:
            logs.append(self.spark.read.schema(whole).parquet(*rolled))
        if singles:
            logs.append(self.spark.read.schema(whole).option("basePath", f"{self._home}/changes").parquet(*singles))
        log = reduce(DataFrame.unionByName, logs) if logs else self.spark.createDataFrame([], whole)
        return log if key is None else log.where(F.col(KEY) == key)

    def _seal(self, run: int, schema: T.StructType) -> None:
        """Makes one file of a full run's markers, with their counts, one table of its change rows, and so for the runs that it completes."""
        first = run * self.run_commits
        markers = self._open_run(run)
        pieces = self._pieces(first, first + self.run_commits)
        counts = self._counts(pieces, first, schema).withColumnRenamed("commit_id", COMMIT)
        whole = markers.drop("added", "removed").join(F.broadcast(counts), COMMIT, "left")
        synced = F.col("path").startswith("base/")
        whole = whole.withColumns({"added": F.when(synced, F.col("rows")).otherwise(F.col("added")), "removed": F.when(synced, 0).otherwise(F.col("removed"))})
        self._one_file(whole.select(*LEDGER_SCHEMA.names).orderBy(COMMIT), f"ledger/{LEVEL}=1/{RUN}={run}")
        marks = [self._rolled(1, run, pieces, schema)]
        level, last = 1, run
        while (last + 1) % self.run_commits == 0:
            level, last = level + 1, last // self.run_commits
            parts = [(level - 1, last * self.run_commits + i) for i in range(self.run_commits)]
            # The stream positions are of use in the newest marker alone.
            together = self._markers(parts).withColumn("streams", F.lit(None).cast(COMMIT_SCHEMA["streams"].dataType))
            self._one_file(together.orderBy(COMMIT), f"ledger/{LEVEL}={level}/{RUN}={last}")
            below = [f"{self._home}/runs/{LEVEL}={lower}/{RUN}={i}" for lower, i in parts[:-1]]
            rows = [*self.spark.read.schema(RUN_SCHEMA).parquet(*below).collect(), marks[-1]]
            held = [Piece(r.level, r.run, r.rows, r.min_seq, r.max_seq, f"rollups/{LEVEL}={r.level}/{RUN}={r.run}") for r in rows if r.rows]
            marks.append(self._rolled(level, last, held, schema, all(r.rolled for r in rows)))
        self._empty(f"{self._home}/commits/{RUN}={run + 1}/{COMMIT}=0".removeprefix(f"{self.root}/"), COMMIT_SCHEMA)
        # The first level's marker comes last and makes all of them visible.
        for mark in reversed(marks):
            self._mark(f"{self._home}/runs/{LEVEL}={mark.level}/{RUN}={mark.run}", list(mark), RUN_SCHEMA)

    def _one_file(self, rows: DataFrame, path: str) -> None:
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self._home}/{path}")

    def _rolled(self, level: int, run: int, pieces: list[Piece], schema: T.StructType, parts_are: bool = True) -> Row:
        """Writes a run's change rows together, by key, if they are few; what the run holds either way."""
        held = [p for p in pieces if p.path.startswith(("changes/", "rollups/"))]
        rows = sum(p.rows for p in held)
        rolled = parts_are and rows <= self.roll_rows
        if rolled and rows:
            files = -(-rows // ROLL_FILE_ROWS)
            log = self._log(held, schema)
            log = log.repartitionByRange(files, KEY) if files > 1 else log.coalesce(1)
            _bloomed(log.sortWithinPartitions(KEY, COMMIT).write, rows).parquet(f"{self._home}/rollups/{LEVEL}={level}/{RUN}={run}")
        seqs = [s for p in held for s in (p.min_seq, p.max_seq) if s is not None]
        return Row(level=level, run=run, rows=rows, min_seq=min(seqs, default=None), max_seq=max(seqs, default=None), rolled=rolled)

    def _counts(self, pieces: list[Piece], before: int, schema: T.StructType) -> DataFrame:
        """commit_id, added, removed of single commits, from their rows and what their keys were before."""
        rows = self._log([p for p in pieces if p.path.startswith("changes/")], T.StructType([]))
        marker = self._marker(before) if before else None
        if marker is None and any(p.path.startswith("base/") for p in pieces):
            # The sync that these commits follow is among them.
            marker = self._marker(1)
        if marker is not None:
            keys = rows.select(KEY).distinct()
            known = self._rows(self._tail_of(marker), keys).withColumn(COMMIT, F.lit(0).cast("bigint"))
            rows = rows.unionByName(known.select(*rows.columns))
        log = rows.select(F.col(COMMIT).alias("commit_id"), F.col(KEY).alias("key"), F.col(SEQ).alias("seq"), F.col(ALIVE).alias("alive"))
        return apply.snapshot_changes(log, collapsed=True).where("commit_id > 0").select("commit_id", "added", "removed")

    # --- commits ---------------------------------------------------------------

    def commits(self) -> DataFrame:
        """Every commit marker, those that only set documents aside included."""
        sealed = self._sealed()
        runs = self._markers([piece for piece in self._cover(0, sealed * self.run_commits)])
        return runs.unionByName(self._open_run(sealed))

    def versions(self) -> DataFrame:
        """The commits that are snapshots: ``commit_id`` and ``committed_at``."""
        return self.commits().where("rows > 0").select(F.col(COMMIT).alias("commit_id"), "committed_at", "cluster_time")

    def lag(self, feed: DataFrame) -> DataFrame:
        """How far the last committed event is from the ends of the retained feed, read from the markers."""
        return feed_lag(feed, self.commits())

    def _replayed(self, head: Row | None, stream_id: str | None, batch_id: int | None) -> tuple[bool, int | None]:
        """Whether a batch was applied before, and as which commit.

        Batches of a stream come in order, so one at or below the stream's last was; the
        newest marker tells for every stream, however long ago.
        """
        last = (head.streams or {}).get(stream_id) if head is not None and stream_id is not None else None
        if last is None or batch_id is None or batch_id > last.batch_id:
            return False, None
        if batch_id == last.batch_id:
            return True, last.commit
        found = self.commits().where((F.col("stream_id") == stream_id) & (F.col("batch_id") == batch_id)).select(COMMIT).first()
        return True, found[0] if found else None

    def schema(self) -> T.StructType:
        """The document columns as of the last commit."""
        head = self._head()
        return _schema(head.schema_json if head else None)

    def apply(
        self,
        feed: DataFrame,
        stream_id: str | None = None,
        batch_id: int | None = None,
        committed_at: datetime | None = None,
        missing_post_image: str = "fail",
    ) -> int | None:
        """Commits one batch of feed events; returns its commit, or None if it held nothing.

        A batch already committed under the same stream and batch id is skipped.
        """
        head = self._head()
        done, number = self._replayed(head, stream_id, batch_id)
        if done:
            return number
        known = _schema(head.schema_json if head else None)
        batch = conform(keep_operations(feed), known, missing_post_image, memory=self._memory)
        return self._commit_checked(batch, head, stream_id, batch_id, committed_at)

    def _commit_checked(self, batch: Conformed, *rest) -> int | None:
        """Commits a batch, which is kept while both of its halves are written."""
        if batch.clean:
            return self._commit(batch, *rest)
        checked = batch.checked.persist()
        try:
            return self._commit(batch, *rest)
        finally:
            checked.unpersist()

    def _commit(
        self, batch: Conformed, head: Row | None, stream_id: str | None, batch_id: int | None, committed_at: datetime | None
    ) -> int | None:
        number = (head[COMMIT] if head else 0) + 1
        at = committed_at or datetime.now(timezone.utc)
        path, rejects = f"changes/{COMMIT}={number}", f"{self._home}/dlq/{COMMIT}={number}"
        good, bad = self._tally(batch)
        if not good and not bad:
            return None
        facts = {"rows": 0}
        if good:
            # The write itself reports what it wrote; nothing is read back.
            seen = Observation()
            collapsed = apply.latest(batch.accepted, [KEY], SEQ).observe(
                seen,
                F.count(F.lit(1)).alias("rows"),
                F.min(SEQ).alias("min_seq"),
                F.max(SEQ).alias("max_seq"),
                F.max(AT).alias("cluster_time"),
            )
            collapsed.write.mode("overwrite").parquet(f"{self._home}/{path}")
            facts = seen.get
        if bad:
            batch.rejected.select(
                F.lit(at).cast("timestamp").alias("dlq_time"), F.struct("reason").alias("err_info"), "doc"
            ).write.mode("overwrite").parquet(rejects)
        self._mark_commit(
            head,
            committed_at=at,
            stream_id=stream_id,
            batch_id=batch_id,
            schema_json=batch.schema.json(),
            path=path,
            rejected=bad,
            **facts,
        )
        return number

    def _tally(self, batch: Conformed) -> tuple[int, int]:
        """Whether there are accepted rows, and how many rejected ones."""
        if batch.clean:
            return int(not batch.empty), 0
        good, bad = F.count_if(F.col("__reason").isNull()), F.count_if(F.col("__reason").isNotNull())
        return tuple(batch.checked.agg(good, bad).first())

    def _mark_commit(self, head: Row | None, **values) -> None:
        """Writes the marker after ``head``, carrying on what it tells; seals the run that ``head`` filled before."""
        number = (head[COMMIT] if head else 0) + 1
        before = head.asDict() if head else {}
        if values["path"].startswith("base/"):
            carried = {"synced": True, "base_at": number, "base_rows": values["rows"], "base_max_seq": values["max_seq"], "tail_rows": 0}
        else:
            carried = {name: before.get(name) for name in ("synced", "base_at", "base_rows", "base_max_seq")}
            carried["tail_rows"] = (before.get("tail_rows") or 0) + values["rows"]
        streams = {k: (v.batch_id, v.commit) for k, v in (before.get("streams") or {}).items()}
        if values.get("stream_id") is not None and values.get("batch_id") is not None:
            streams[values["stream_id"]] = (values["batch_id"], number)
        whole = {COMMIT: number, **values, **carried, "streams": streams}
        run = (number - 1) // self.run_commits
        if run and (number - 1) % self.run_commits == 0 and self._sealed() < run:
            self._seal(run - 1, _schema(head.schema_json))
            self._sealed_runs = run
        row = [whole.get(name) for name in COMMIT_SCHEMA.names]
        self._mark(f"{self._home}/commits/{RUN}={run}/{COMMIT}={number}", row[1:], T.StructType(COMMIT_SCHEMA.fields[1:]))
        streams = {k: Row(batch_id=b, commit=c) for k, (b, c) in streams.items()}
        self._newest = Row(**dict(zip(COMMIT_SCHEMA.names, row)) | {"streams": streams})

    def initial_sync(
        self, source: DataFrame, seq: int = 0, committed_at: datetime | None = None, key: str = KEY
    ) -> int:
        """Commit 1: the whole source, written as the first base; only onto an empty table.

        Rows pass through the feed's own rules for names, types and keys, as inserts;
        those that do not fit, have no key or share one are in the dead-letter queue.
        ``seq`` lies below the feed that follows, so later events win.
        """
        if self._head() is not None:
            raise RebuildRefused("the table has commits; syncing again would need rebuild(confirm=True)")
        feed, twice, columns = _as_inserts(source, seq, key)
        batch = conform(feed, columns)
        at = committed_at or datetime.now(timezone.utc)
        path = f"base/{COMMIT}=1"
        count = self._write_base(batch.accepted, path)
        rejected = Observation()
        rejects = batch.rejected if twice is None else batch.rejected.unionByName(twice)
        rejects.select(
            F.lit(at).cast("timestamp").alias("dlq_time"), F.struct("reason").alias("err_info"), "doc"
        ).observe(rejected, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{self._home}/dlq/{COMMIT}=1")
        self._mark_commit(
            None,
            committed_at=at,
            schema_json=batch.schema.json(),
            path=path,
            rows=count,
            rejected=rejected.get["rows"],
            min_seq=seq,
            max_seq=seq,
        )
        return 1

    def sync_in_chunks(
        self, source: DataFrame, bounds: list, position: Callable[[], int], key: str = KEY, stream_id: str = "initial sync"
    ) -> list[int | None]:
        """The source as one commit per range of keys, while the feed goes on: ``bounds`` part the keys, rising.

        ``position`` tells where the feed stands; it is asked before each chunk is read, and
        the chunk's rows are inserts of that ``seq``. An event that came since is newer than
        its row, whether it is committed before the chunk or after, so it wins; a row
        deleted meanwhile is not in the chunk or is deleted by its event. A range that was
        committed before is skipped, so a sync that broke off goes on with the next one.
        Rows without a key are in the first chunk, and set aside there. Returns each chunk's commit.
        """
        done = []
        for i in range(len(bounds) + 1):
            head = self._head()
            found, number = self._replayed(head, stream_id, i)
            if found:
                done.append(number)
                continue
            own = F.lit(True)
            if i:
                own = own & (column(key) >= F.lit(bounds[i - 1]))
            if i < len(bounds):
                own = own & (column(key) < F.lit(bounds[i]))
            seq = position()
            feed, twice, columns = _as_inserts(source.where(own if i else own | column(key).isNull()), seq, key)
            known = _schema(head.schema_json) if head else T.StructType([])
            new = [f for f in columns.fields if f.name.lower() not in {k.name.lower() for k in known.fields}]
            batch = conform(feed, T.StructType(known.fields + new))
            batch = batch if twice is None else batch.setting_aside(twice)
            done.append(self._commit_checked(batch, head, stream_id, i, None))
        return done

    # --- bases -----------------------------------------------------------------

    def _write_base(self, rows: DataFrame, path: str) -> int:
        """Clustered by bucket and key: a key lookup opens one bucket and few row groups."""
        seen = Observation()
        clustered = rows.withColumn(BUCKET, self._bucket(F.col(KEY))).hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, KEY)
        counted = clustered.observe(seen, F.count(F.lit(1)).alias("rows"))
        _bloomed(counted.write, BASE_FILE_KEYS).partitionBy(BUCKET).parquet(f"{self._home}/{path}")
        return seen.get["rows"]

    def _bucket(self, key: Column) -> Column:
        return bucket_of(key, self.buckets)

    def base_due(self, share: float = BASE_SHARE, min_rows: int = BASE_MIN_ROWS) -> bool:
        """Whether the tail has grown to a share of the base, which makes a new base pay off."""
        head = self._head()
        return head is not None and (head.tail_rows or 0) > share * max(head.base_rows or 0, min_rows)

    def write_base(self) -> int:
        """Writes the state of the last commit as a base, which bounds every later read."""
        tail = self._tail(None)
        number = tail.version
        if tail.base is None or tail.base[COMMIT] != number:
            rows = self._write_base(self._rows(tail), f"base/{COMMIT}={number}")
            seqs = [row.max_seq for row in [*tail.pieces, tail.base] if row and row.max_seq is not None]
            self._mark(f"{self._home}/bases/{RUN}={(number - 1) // self.run_commits}/{COMMIT}={number}", [rows, max(seqs, default=None)], BASE_SCHEMA)
        return number

    # --- reads -----------------------------------------------------------------

    def _tail(self, version: int | None) -> Tail:
        """The base and the later pieces a read needs."""
        if version is not None and not 1 <= version <= 2**63 - 1:
            raise UnknownSnapshot(f"no snapshot {version}")
        marker = self._marker(version)
        if marker is None or (version is not None and not marker.rows):
            raise UnknownSnapshot(f"no snapshot {version}" if version else "the table has no commit yet")
        return self._tail_of(marker)

    def _tail_of(self, marker: Row) -> Tail:
        base = Row(**{COMMIT: marker.base_at, "rows": marker.base_rows, "max_seq": marker.base_max_seq}) if marker.base_at else None
        return Tail(marker[COMMIT], _schema(marker.schema_json), base, self._pieces(marker.base_at or 0, marker[COMMIT]))

    def _files(self, paths: list[str], schema: T.StructType) -> DataFrame:
        """Change rows of the given pieces; a column a file lacks reads as NULL."""
        return self.spark.read.schema(T.StructType(OWN_FIELDS + schema.fields)).parquet(
            *[f"{self._home}/{p}" for p in paths]
        )

    def _base_rows(self, tail: Tail, key: str | list[int] | None = None) -> DataFrame:
        """The base's rows: all, or of the bucket a key is in, or of some buckets; others are not opened."""
        schema = T.StructType([*OWN_FIELDS, *tail.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        rows = self.spark.read.schema(schema).parquet(f"{self._home}/base/{COMMIT}={tail.base[COMMIT]}")
        if isinstance(key, list):
            rows = rows.where(F.col(BUCKET).isin(key) if key else F.lit(False))
        elif key is not None:
            bucket = self.spark.range(1).select(self._bucket(F.lit(key))).first()[0]
            rows = rows.where(F.col(BUCKET) == bucket)
        return rows.drop(BUCKET)

    def _rows(self, tail: Tail, key: str | list[int] | DataFrame | None = None) -> DataFrame:
        """One row per key ever seen, tombstones included; of one key, some buckets or a table of keys only, if given.

        Base rows are filtered by an anti join against the tail's keys, which Spark
        broadcasts when they are small, so the base is not shuffled.
        """

        def only(rows: DataFrame) -> DataFrame:
            if isinstance(key, DataFrame):
                return rows.join(key, KEY, "left_semi")
            if isinstance(key, list):
                return in_buckets(rows, key, KEY, self.buckets)
            return rows if key is None else rows.where(F.col(KEY) == key)

        bucket = None if isinstance(key, DataFrame) else key
        if not tail.pieces:
            if tail.base is None:
                return self.spark.createDataFrame([], T.StructType(OWN_FIELDS + tail.schema.fields))
            return only(self._base_rows(tail, bucket))
        changed = only(self._files([p.path for p in tail.pieces], tail.schema))
        newest = apply.latest(changed, [KEY], SEQ)
        if tail.base is None:
            return newest
        base = only(self._base_rows(tail, bucket))
        if not tail.late:
            return base.join(changed.select(KEY).distinct(), KEY, "left_anti").unionByName(newest)
        # Some events came after a base that already held newer ones of their key.
        seqs = newest.select(KEY, F.col(SEQ).alias("_tail_seq"))
        overtaken = base.select(KEY, SEQ).join(seqs, KEY).where(F.col(SEQ) > F.col("_tail_seq")).select(KEY)
        winning = newest.join(overtaken, KEY, "left_anti")
        return base.join(winning.select(KEY), KEY, "left_anti").unionByName(winning)

    def _living(self, tail: Tail, key: str | list[int] | None = None) -> DataFrame:
        fields = [column(f.name) for f in tail.schema.fields]
        return self._rows(tail, key).where(F.col(ALIVE)).select(KEY, *fields)

    def state(self, version: int | None = None) -> DataFrame:
        """The table now, or as of a snapshot; its schema is the one of that commit."""
        return self._living(self._tail(version))

    def differences(self, source: DataFrame, version: int | None = None) -> DataFrame:
        """What brings the table to ``source`` (``_id`` and fields): insert, replace or delete per key.

        Both are digested per bucket once; of the base only the partitions of unequal buckets are read again.
        """
        source = source.withColumn(KEY, F.col(KEY).cast("string"))
        tail = self._tail(version)

        def own(state: DataFrame) -> DataFrame:
            nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in source.schema.fields if f.name not in state.columns]
            return state.select("*", *nothing).select(*[column(c) for c in source.columns])

        trees = [digest_tree(side, KEY, self.buckets) for side in (own(self._living(tail)), source)]
        chosen = unequal_buckets(*trees, self.buckets)
        now, goal = self._living(tail, chosen), in_buckets(source, chosen, KEY, self.buckets)
        return reconcile(own(now), goal, KEY).where("action <> 'noop'")

    def state_at(self, instant: str | datetime) -> DataFrame:
        """The table at the last snapshot committed at or before an instant."""
        return self.state(apply.version_at(self.versions(), instant))

    def lookup(self, key: str, version: int | None = None) -> DataFrame:
        """One row by key, or none: one bucket of the base and the key's tail rows."""
        return self._living(self._tail(version), key)

    def changes(self, key: str | None = None) -> DataFrame:
        """The change log of all snapshots: commit_id, key, seq, alive, document columns."""
        head = self._head()
        schema = _schema(head.schema_json if head else None)
        synced = bool(head and head.synced)
        pieces = self._pieces(1 if synced else 0, head[COMMIT]) if head else []
        log = self._log(pieces, schema, key)
        if synced:
            first = Row(**{COMMIT: 1})
            own = self._base_rows(Tail(1, schema, first, []), key).withColumn(COMMIT, F.lit(1).cast("bigint"))
            log = log.unionByName(own if key is None else own.where(F.col(KEY) == key))
        return log.select(
            F.col(COMMIT).alias("commit_id"),
            F.col(KEY).alias("key"),
            F.col(SEQ).alias("seq"),
            F.col(ALIVE).alias("alive"),
            *[column(f.name) for f in schema.fields],
        )

    def snapshots(self) -> DataFrame:
        """Snapshot history with the rows each commit added and removed.

        A sealed run's counts are in its markers; only the open run's change rows are read.
        """
        head = self._head()
        sealed = self._sealed()
        known = self._markers(self._cover(0, sealed * self.run_commits)).where("added IS NOT NULL")
        listed = known.select(F.col(COMMIT).alias("commit_id"), "committed_at", "added", "removed")
        first = sealed * self.run_commits
        if head is not None and head[COMMIT] > first:
            markers = self._open_run(sealed).where("rows > 0").select(F.col(COMMIT).alias("commit_id"), "committed_at", "rows", "path")
            synced = markers.where(F.col("path").startswith("base/"))
            listed = listed.unionByName(synced.select("commit_id", "committed_at", F.col("rows").alias("added"), F.lit(0).cast("bigint").alias("removed")))
            counts = self._counts(self._pieces(first, head[COMMIT]), first, _schema(head.schema_json))
            listed = listed.unionByName(markers.select("commit_id", "committed_at").join(counts, "commit_id"))
        return apply.summarised(listed)

    def history(self, key: str) -> DataFrame:
        """How one key looked in each snapshot."""
        return apply.key_history(self.changes(key), self.versions(), key, collapsed=True)

    def columns(self) -> DataFrame:
        return table_columns(self.state())

    def register(self, name: str, version: int | None = None) -> None:
        """Makes the state (and ``<name>_snapshots``) available to ``spark.sql``."""
        self.state(version).createOrReplaceTempView(name)
        self.snapshots().createOrReplaceTempView(f"{name}_snapshots")

    # --- dead letters ------------------------------------------------------------

    def dlq(self) -> DataFrame:
        """Rejected documents of committed batches since the queue was last cleared."""
        upto = self._table("dlq_cleared").agg(F.max(COMMIT)).first()[0] or 0
        live = self.commits().where((F.col("rejected") > 0) & (F.col(COMMIT) > upto))
        return self._table("dlq").join(live.select(COMMIT), COMMIT, "left_semi").withColumnRenamed(COMMIT, "commit_id")

    def clear_dlq(self) -> int:
        """Hides the queue's rows from now on and returns how many; files stay."""
        rows = self.dlq().count()
        if rows:
            schema = T.StructType(TABLES["dlq_cleared"].fields[1:])
            self._mark(f"{self._home}/dlq_cleared/{COMMIT}={self._head()[COMMIT]}", [rows], schema)
        return rows

    # --- rebuild -----------------------------------------------------------------

    def rebuild(
        self, source: DataFrame, confirm: bool = False, seq: int = 0, committed_at: datetime | None = None
    ) -> "Mirror":
        """Starts a new epoch from the source, for when the feed no longer reaches back.

        Refused unless confirmed.  The old epoch stays in use until the new one is
        complete; follow the feed with a new checkpoint afterwards.
        """
        if not confirm:
            raise RebuildRefused("rebuilding replaces the table: call rebuild(source, confirm=True)")
        fresh = Mirror.__new__(Mirror)
        fresh.spark, fresh.root = self.spark, self.root
        new = self._prepare(self.epoch + 1, self.buckets, self.run_commits, self.roll_rows)
        fresh._use(new)
        fresh.initial_sync(source, seq, committed_at)
        self._open(new)
        self._use(new)
        return self


def _as_inserts(source: DataFrame, seq: int, key: str) -> tuple[DataFrame, DataFrame | None, T.StructType]:
    """Rows as insert events of one ``seq``, those that share a key as rejects (None if none do), and the columns of the table.

    The shared keys are looked for once, in the key column alone, and kept as a table.
    """
    documents = source.select(*[column(c) for c in source.columns if c != key])
    feed = source.select(
        F.lit(seq).cast("bigint").alias("seq"),
        F.lit(None).cast("timestamp").alias("cluster_time"),
        F.lit("insert").alias("operation_type"),
        column(key).cast("string").alias("document_key"),
        encode_document(documents).alias("full_document"),
    )
    # Which of several rows of one key is right nobody can say: all are set aside.
    several = feed.groupBy("document_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND document_key IS NOT NULL")
    counted, path = Observation(), shared_dir(source.sparkSession, "shared-keys")
    several.select("document_key").observe(counted, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    if not counted.get["n"]:
        return feed, None, table_type(documents.schema)
    several = source.sparkSession.read.schema("document_key string").parquet(path)
    twice = feed.join(several, "document_key", "left_semi").select(
        "seq", "cluster_time", F.col("full_document").alias("doc"), F.lit(DUPLICATE_REASON).alias("reason")
    )
    return feed.join(several, "document_key", "left_anti"), twice, table_type(documents.schema)


def _bloomed(writer: DataFrameWriter, keys: int) -> DataFrameWriter:
    """Files that tell which keys they do not hold."""
    return writer.mode("overwrite").option(f"parquet.bloom.filter.enabled#{KEY}", "true").option(f"parquet.bloom.filter.expected.ndv#{KEY}", str(keys))


def _schema(text: str | None) -> T.StructType:
    return T.StructType.fromJson(json.loads(text)) if text else T.StructType([])
