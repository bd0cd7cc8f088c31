"""Centroid clustering by Orchard search, in whole numbers.

Vectors are kept once as whole numbers, which take a fraction of the floats' room. Each
round every vector finds its nearest centroid and tasks send one sum per centroid and
component; the driver sees ``k * width`` numbers a round and nothing of the rows.

The nearest centroid is found by Orchard's method. Every centroid has the list of all
others, nearest first. A vector walks the list of its present centroid; as soon as it
meets one that is closer (or as close, with a smaller number) it goes on with that one's
list. Centroids met before are marked and not compared again. The walk ends at a
neighbour strictly beyond twice the present distance: what lies there is farther away
than the present centroid, by the triangle inequality. Squares are compared with four
times the square, so no root is taken and ties come out exactly. A vector's walk starts
at the centroid that was nearest in the first round, kept beside it.

Rows are dealt as their files are; a vector that makes up a third of all rows costs what
other rows cost. A lost task is run anew from the kept table.

Defined results: vectors that are NULL, have another length, or hold a NULL, an infinity,
a NaN or a number of which ``scale`` makes 2^24 or more (whose squared distances would
leave a long) are no part of the result. Repeated rows count each. Starting centroids
that tie (equal ids) are in order of their components; NULL ids start only if nothing
else does. Fewer vectors than ``k`` make fewer centroids. An empty table gives no rows.
Other columns never meet the operator's own.
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
from tidemark.llm.vectors import SLICE, matrix, numbered, part_sums

K, WIDTH, SCALE, ROUNDS, SEED = 40, 64, 256, 5, 2


class Orchard:
    """The centroids with their neighbour lists."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        k = len(centroids)
        gaps = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
        gaps[np.arange(k), np.arange(k)] = -1
        order = np.argsort(gaps, axis=1, kind="stable")[:, 1:]
        self.near, self.gap = order, np.take_along_axis(gaps, order, 1)

    def _distance(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        away = x - self.centroids[which]
        return np.einsum("ij,ij->i", away, away)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the nearest centroid (ties: the smaller number) and its squared distance. All rows walk in step."""
        n, lists = len(x), self.near.shape[1]
        now = start.astype(np.int64)
        best = self._distance(x, now)
        seen = np.zeros((n, len(self.centroids)), bool)
        seen[np.arange(n), now] = True
        place = np.zeros(n, np.int64)
        walking = np.arange(n if lists else 0)
        while len(walking):
            at = now[walking], place[walking]
            walking = walking[self.gap[at] <= 4 * best[walking]]
            other = self.near[now[walking], place[walking]]
            place[walking] += 1
            fresh = ~seen[walking, other]
            rows, other = walking[fresh], other[fresh]
            seen[rows, other] = True
            distance = self._distance(x[rows], other)
            closer = (distance < best[rows]) | ((distance == best[rows]) & (other < now[rows]))
            rows = rows[closer]
            now[rows], best[rows], place[rows] = other[closer], distance[closer], 0
            walking = walking[place[walking] < lists]
        return now, best


class Clustering(NamedTuple):
    assigned: DataFrame
    """vec_id, cluster, distance (squared)."""
    centroids: list[list[int]]


def clustered(
    vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, width: int = WIDTH, scale: int = SCALE,
    rounds: int = ROUNDS, seed: int = SEED,
) -> Clustering:
    """Starts from the ``k`` vectors of the smallest sha256 of ``seed:id``; ``rounds`` times assigns and averages, then assigns once more."""
    spark = vectors.sparkSession
    rows = renamed(vectors, vec_id=vec_id, vector=vector)
    first = numbered(rows, scale, width).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k)
    centroids = np.array([r.v for r in first.collect()], np.int64).reshape(-1, width)
    if not len(centroids):
        return Clustering(spark.createDataFrame([], f"vec_id {rows.dtypes[0][1]}, cluster int, distance bigint"), [])

    begin = Orchard(centroids)

    def starts(x: np.ndarray) -> list[pa.Array]:
        found = [begin.nearest(x[i : i + SLICE], np.zeros(len(x[i : i + SLICE])))[0] for i in range(0, len(x), SLICE)]
        return [pa.array(np.concatenate([np.zeros(0, np.int64), *found]), pa.int32())]

    table = kept(spark, numbered(rows, scale, width, starts, "start int"), "vectors")
    for _ in range(rounds):
        centroids = _averaged(table, centroids)
    return Clustering(_assigned(table, centroids), centroids.tolist())


def _slices(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for at in range(0, batch.num_rows, SLICE):
        part = batch.slice(at, SLICE)
        yield part, matrix(part.column("v"), width), part.column("start").to_numpy()


def _averaged(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every vector to its nearest centroid, every centroid that has some to their exact mean, rounded down."""
    search, (k, width) = Orchard(centroids), centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, x, start in _slices(batch, width):
                more, count = part_sums(search.nearest(x, start)[0], x, k)
                total += more
                n += count
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(some, width), pa.int32()), pa.array(np.tile(np.arange(width), len(some)), pa.int32()),
             pa.array(total[some].reshape(-1)), pa.array(np.repeat(n[some], width))],
            names=["cluster", "position", "total", "n"],
        )

    found = table.select("v", "start").mapInArrow(sums, "cluster int, position int, total bigint, n bigint")
    out = centroids.copy()
    for r in found.groupBy("cluster", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r.cluster, r.position] = r.total // r.n
    return out


def _assigned(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    search, width = Orchard(centroids), centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x, start in _slices(batch, width):
                cluster, distance = search.nearest(x, start)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"]
                )

    return table.mapInArrow(assign, f"vec_id {table.schema['vec_id'].dataType.simpleString()}, cluster int, distance bigint")


def with_inertia(spark: SparkSession, found: Clustering) -> DataFrame:
    """Each vector with the sums of its cluster and of all, and its centroid's sha256. The joined table has a row per centroid."""
    assigned = kept(spark, found.assigned, "clusters")
    own = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    per = [(i, own.get(i, 0), sum(own.values()), s) for i, s in enumerate(sha)]
    per = spark.createDataFrame(per, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(spark, clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def _oracle() -> str:
    apart = f"list_sum([(v[i] - c[i]) * (v[i] - c[i]) for i in range(1, {WIDTH + 1})])"
    rounds = []
    for t in range(ROUNDS + 1):
        rounds.append(f"""
a{t} AS MATERIALIZED (
  SELECT rn, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
  FROM (SELECT rn, cluster, {apart} AS d FROM v, c{t}) GROUP BY rn
)""")
        if t < ROUNDS:
            rounds.append(f"""
c{t + 1} AS MATERIALIZED (
  SELECT c{t}.cluster, coalesce(m.c, c{t}.c) AS c FROM c{t} LEFT JOIN (
    SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c
    FROM (SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{t} JOIN v USING (rn), range(1, {WIDTH + 1}) t(i) GROUP BY cluster, i)
    GROUP BY cluster
  ) m USING (cluster)
)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rn, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = {WIDTH}
),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1)::INT AS cluster, v AS c FROM v QUALIFY cluster < {K}
),{",".join(rounds)}
SELECT vec_id, a.cluster, a.distance::BIGINT AS distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
  (sum(a.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{ROUNDS}.c, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (rn) JOIN c{ROUNDS} ON c{ROUNDS}.cluster = a.cluster
"""


ORACLE = _oracle()
