"""Vector code compression: product codes whose codebooks are trained with norm-of-sum bounds.

A vector is cut into equal parts, and each part position has a codebook of entries,
trained by rounds of assigning and averaging over all vectors. Most parts need no
comparison with all entries: with every part go the distance to its own entry (upper
bound) and to the second nearest (lower bound), and for each of the two the round at
which it was exact, its stamp. The codebooks of all rounds are retained (``rounds + 1``
small arrays). In a later round a bound is moved by the *true net displacement* of the
entries since its stamp, the norm of the sum of their moves, which is never more than
the moves' norms added up: the upper by that of the part's entry, the lower by the
largest of the other entries. Only where the upper bound does not stay strictly below
the lower is the exact distance to the own entry worked out, and only if that does
not stay below either, all entries are scanned exactly. Since stamps may be old, a
round need not write anything: tasks send sums, and only in rounds 1, 2, 4, 8, ... is the
table of bounds written anew, each rescanned part with the present round as its stamp.
Entries move less and less, so later stamps last longer.

The driver sees ``parts * entries * width`` numbers a round and nothing of the rows.
Rows are dealt as their files are; no key gathers them. Errors per label are partial
sums before any shuffle, so a label of a third of all rows is a row per task.

Defined results: vectors that are NULL, or hold a NULL, an infinity, a NaN or a number of
which ``scale`` makes 2^24 or more (whose squared distances would leave a long), are
dropped, and so are those whose length is not the commonest that the parts divide (of
equally common ones the longest). Starting entries that share an id are in order of
their components; NULL ids come after all others. Fewer vectors than entries make
fewer entries. NULL labels are one label. Repeated rows count each. An empty table
gives no rows. Other columns never meet the operator's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.graph import kept
from tidemark.llm.native import renamed
from tidemark.llm.vectors import SLICE, lists, matrix, numbered, part_sums, widths

PARTS, ENTRIES, SCALE, ROUNDS = 8, 16, 4096, 6
#: Most labels whose sums are broadcast to the rows.
BROADCAST_LABELS = 10_000
_FAR = np.iinfo(np.int64).max
#: How far a computed bound may be from the true one.
_SLACK = 1e-9

_STATE = "near array<int>, upper array<bigint>, lower array<bigint>, upper_at array<tinyint>, lower_at array<tinyint>"
_KINDS = {"near": pa.int32(), "upper": pa.int64(), "lower": pa.int64(), "upper_at": pa.int8(), "lower_at": pa.int8()}


class Bounds:
    """What is known of the parts (n, parts): the own entry, squared bounds, and the rounds at which these were exact."""

    def __init__(self, **fields: np.ndarray):
        self.__dict__ |= fields

    @classmethod
    def read(cls, batch: pa.RecordBatch, parts: int) -> Bounds:
        return cls(**{name: matrix(batch.column(name), parts) for name in _KINDS})

    def columns(self) -> list[pa.Array]:
        return [lists(getattr(self, name), kind) for name, kind in _KINDS.items()]


def scanned(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (ties: the lower), its squared distance and that to the second nearest, by comparison with all entries."""
    far = ((x[:, None, :] - book[None, :, :]) ** 2).sum(2)
    near = far.argmin(1)
    rows = np.arange(len(x))
    best = far[rows, near]
    far[rows, near] = _FAR
    return near, best, far.min(1)


class Training:
    """The codebooks of all rounds so far: each (parts, entries, width of a part)."""

    def __init__(self, history: list[np.ndarray]):
        self.history = history
        self.now = len(history) - 1
        book = history[-1]
        # Net displacement since every stamp, of each entry and the largest of the others.
        self.moved = np.stack([np.sqrt(((book - old) ** 2).sum(2)) for old in history])
        others = np.repeat(self.moved[:, :, None, :], book.shape[1], axis=2)
        others[:, :, np.arange(book.shape[1]), np.arange(book.shape[1])] = 0
        self.others = others.max(3)

    def first(self, x: np.ndarray) -> Bounds:
        """Exact bounds of parts (n, parts, width) that have none yet."""
        book = self.history[-1]
        found = [[np.concatenate(c) for c in zip(*[scanned(x[i : i + SLICE, p], book[p]) for i in range(0, max(1, len(x)), SLICE)])] for p in range(len(book))]
        near, upper, lower = (np.stack([f[i] for f in found], axis=1) for i in range(3))
        stamp = np.full(near.shape, self.now)
        return Bounds(near=near, upper=upper, lower=lower, upper_at=stamp, lower_at=stamp.copy())

    def advance(self, x: np.ndarray, b: Bounds) -> None:
        """Brings ``near`` to the present codebook, and bounds only where they do not decide; a part scanned exactly has this round as its lower stamp."""
        book = self.history[-1]
        for p in range(len(book)):
            own = b.near[:, p]
            upper = np.sqrt(b.upper[:, p]) + self.moved[b.upper_at[:, p], p, own]
            lower = np.sqrt(b.lower[:, p].astype(float)) - self.others[b.lower_at[:, p], p, own]
            lower -= _SLACK * (1 + np.abs(lower) + upper)
            open_ = np.flatnonzero(upper >= lower)
            if not len(open_):
                continue
            away = x[open_, p] - book[p, own[open_]]
            exact = np.einsum("ij,ij->i", away, away)
            b.upper[open_, p], b.upper_at[open_, p] = exact, self.now
            scan = open_[np.sqrt(exact) >= lower[open_]]
            if len(scan):
                b.near[scan, p], b.upper[scan, p], b.lower[scan, p] = scanned(x[scan, p], book[p])
                b.upper_at[scan, p] = b.lower_at[scan, p] = self.now


class Codes(NamedTuple):
    coded: DataFrame
    """vec_id, label, codes (0-based entries in part order), error (squared)."""
    codebooks: list[list[list[int]]]
    """By part and entry."""
    scans: list[float]
    """Share of parts scanned exactly, by round."""


def compressed(
    vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
    scale: int = SCALE, rounds: int = ROUNDS,
) -> Codes:
    spark = vectors.sparkSession
    rows = renamed(vectors, vec_id=vec_id, label=label, vector=vector)
    kinds = dict(rows.dtypes)
    common = widths(rows, "vector").where(F.col("width") % parts == 0).orderBy(F.desc("n"), F.desc("width")).first()
    width = common.width if common else parts
    first = numbered(rows.select("vec_id", "vector"), scale, width).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return Codes(spark.createDataFrame([], f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error bigint"), [], [])
    history = [np.array([r.v for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)]
    begin = Training(history)
    table = kept(
        spark, numbered(rows, scale, width, lambda x: begin.first(x.reshape(len(x), parts, -1)).columns(), _STATE), "bounds"
    )
    scans: list[float] = []
    for t in range(rounds):
        training = Training(history)
        if t and t & (t - 1) == 0:
            table = kept(spark, _restamped(table, training), "bounds")
        book, share = _averaged(table, training)
        history, scans = [*history, book], [*scans, share]
    return Codes(_coded(table, Training(history)), history[-1].tolist(), scans)


def _advanced(batches: Iterator[pa.RecordBatch], training: Training) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Bounds]]:
    parts, _, width = training.history[0].shape
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            x, known = matrix(part.column("v"), parts * width).reshape(-1, parts, width), Bounds.read(part, parts)
            training.advance(x, known)
            yield part, x, known


def _restamped(table: DataFrame, training: Training) -> DataFrame:
    """The same rows with the bounds that this round had to work out in place of the old ones."""
    own = [c for c in table.columns if c not in _KINDS]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, known in _advanced(batches, training):
            yield pa.RecordBatch.from_arrays([part.column(c) for c in own] + known.columns(), names=[*own, *_KINDS])

    return table.select(*own, *_KINDS).mapInArrow(write, table.select(*own, *_KINDS).schema)


def _averaged(table: DataFrame, training: Training) -> tuple[np.ndarray, float]:
    """One round: the codebooks after it, and the share of parts that were scanned exactly."""
    parts, entries, width = training.history[0].shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, scans = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64), 0
        for _, x, known in _advanced(batches, training):
            scans += int((known.lower_at == training.now).sum())
            for p in range(parts):
                add, count = part_sums(known.near[:, p], x[:, p], entries)
                total[p] += add
                n[p] += count
        part, entry = (np.repeat(i.reshape(-1), width) for i in np.indices((parts, entries)))
        position = np.tile(np.arange(width), parts * entries)
        columns = [part, entry, position, total.reshape(-1), np.repeat(n.reshape(-1), width)]
        said = [[-1], [0], [0], [scans], [int(n.sum())]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(c, s), k) for c, s, k in zip(columns, said, [pa.int32()] * 3 + [pa.int64()] * 2)],
            names=["part", "entry", "position", "total", "n"],
        )

    found = table.select("v", *_KINDS).mapInArrow(sums, "part int, entry int, position int, total bigint, n bigint")
    book, share = training.history[-1].copy(), 0.0
    for r in found.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0").collect():
        if r.part < 0:
            share = r.total / r.n
        else:
            book[r.part, r.entry, r.position] = r.total // r.n
    return book, share


def _coded(table: DataFrame, training: Training) -> DataFrame:
    """Codes and exact errors by the final codebooks."""
    book = training.history[-1]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, known in _advanced(batches, training):
            away = x - book[np.arange(len(book))[None, :], known.near]
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), part.column("label"), lists(known.near, pa.int32()), pa.array((away**2).sum((1, 2)))],
                names=["vec_id", "label", "codes", "error"],
            )

    kinds = dict(table.dtypes)
    return table.mapInArrow(code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error bigint")


def decoded(coded: DataFrame, codebooks: list[list[list[int]]], *, codes: str = "codes", vector: str = "decoded", scale: int = SCALE) -> DataFrame:
    """The rows with the vectors that their codes stand for, in the input's own units. The codebooks' size is a parameter's."""
    books = F.array(*[F.array(*[F.array(*[F.lit(v / scale) for v in entry]) for entry in part]) for part in codebooks])
    return coded.withColumn(vector, F.flatten(F.zip_with(F.col(codes), books, lambda c, book: book[c])))


def with_label_error(spark: SparkSession, found: Codes) -> DataFrame:
    """Each vector with its codes as hex, the error of its label's vectors, and the sha256 of all codebooks."""
    rows = kept(spark, found.coded, "codes")
    own = kept(spark, rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "labels")
    if own.count() <= BROADCAST_LABELS:
        own = F.broadcast(own)
    sha = hashlib.sha256(",".join(str(v) for part in found.codebooks for entry in part for v in entry).encode()).hexdigest()
    hex_ = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return rows.join(own, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", hex_.alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_label_error(spark, compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def _oracle() -> str:
    apart = "list_sum([(v[i] - c[i]) * (v[i] - c[i]) for i in range(1, len(v) + 1)])"
    rounds = []
    for t in range(ROUNDS + 1):
        rounds.append(f"""
a{t} AS MATERIALIZED (
  SELECT rn, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT rn, part, entry, {apart} AS d FROM p JOIN c{t} USING (part)) GROUP BY rn, part
)""")
        if t < ROUNDS:
            rounds.append(f"""
c{t + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.c, c{t}.c) AS c FROM c{t} LEFT JOIN (
    SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c
    FROM (
      SELECT part, entry, i, sum(x) AS s, count(*) AS n
      FROM (SELECT part, entry, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM a{t} JOIN p USING (rn, part)) GROUP BY part, entry, i
    ) GROUP BY part, entry
  ) m USING (part, entry)
)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rn, vec_id, label, [floor({SCALE} * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
),
p AS MATERIALIZED (
  SELECT rn, vec_id, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS v FROM v, range({PARTS}) t(part)
),
c0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS c FROM p QUALIFY entry < {ENTRIES}
),{",".join(rounds)},
e AS (
  SELECT rn, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY rn
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM c{ROUNDS}) AS codebooks_sha256
FROM e JOIN v USING (rn)
"""


ORACLE = _oracle()
