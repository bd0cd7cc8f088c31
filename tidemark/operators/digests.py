"""Do two tables hold the same rows: digests per bucket of keys, compared as a tree.

A row's digest is the MD5 of its key and fields, read as four whole numbers below 2^32. A
bucket's digest is their sums modulo 2^32 beside its row count: the same in whatever order
and parts the rows come, and repeated rows count. Every ``FAN`` buckets add up to a node of
the level above, up to one root, so equal tables are told from one row, and different ones
by looking only below nodes that differ. What differs is then read from the unequal
buckets alone (:func:`tidemark.operators.changes.reconcile_unequal`).

One aggregation over the rows makes the leaves, combined before its shuffle: a task sends at
most one row per bucket, whatever the skew. A tree holds about ``buckets`` rows. NULL keys
and fields count like any value; fields are taken by name, in the order of names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import column
from tidemark.session import shared_dir

BUCKETS, FAN = 4096, 16
# Buckets are told to the scan as a list of numbers, so there is a most.
MOST_BUCKETS = 2**16
_WORDS = ("d0", "d1", "d2", "d3")
_EXACT = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def bucket_of(key: Column, buckets: int) -> Column:
    """A key's bucket; by the same rule as the table's bases, whose bucket is a partition."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def _levels(buckets: int, fan: int) -> list[int]:
    """How many buckets a node of each level spans, root first."""
    spans = [1]
    while spans[-1] < buckets:
        spans.append(spans[-1] * fan)
    return spans[::-1]


def digest_tree(rows: DataFrame, key: str = "_id", buckets: int = BUCKETS, fan: int = FAN) -> DataFrame:
    """level (0 is the root), node, rows and digest of every node that has rows, as a table in the shared folder."""
    if not 1 <= buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be from 1 to {MOST_BUCKETS}")
    fields = sorted(c for c in rows.columns if c != key)
    text = F.to_json(F.struct(column(key).cast("string").alias("k"), *[column(c) for c in fields]), _EXACT)
    words = [F.conv(F.substring(F.col("_md5"), 1 + 8 * i, 8), 16, 10).cast("bigint").alias(w) for i, w in enumerate(_WORDS)]
    digested = rows.select(bucket_of(column(key), buckets).alias("bucket"), F.md5(text).alias("_md5")).select("bucket", *words)
    leaves = digested.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(w).alias(w) for w in _WORDS])
    spans = _levels(buckets, fan)
    steps = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(s).alias("span")) for i, s in enumerate(spans)])
    nodes = leaves.withColumns({w: F.pmod(w, F.lit(2**32)) for w in _WORDS}).withColumn("_step", F.explode(steps))
    tree = (
        nodes.groupBy(F.col("_step.level").alias("level"), F.floor(F.col("bucket") / F.col("_step.span")).cast("int").alias("node"))
        .agg(F.sum("rows").alias("rows"), *[F.pmod(F.sum(w), F.lit(2**32)).alias(w) for w in _WORDS])
    )
    where = shared_dir(rows.sparkSession, "digests")
    tree.repartition(1).sortWithinPartitions("level", "node").write.parquet(where)
    return rows.sparkSession.read.schema(tree.schema).parquet(where)


def unequal_buckets(one: DataFrame, other: DataFrame, buckets: int = BUCKETS, fan: int = FAN) -> list[int]:
    """The buckets in which two trees of the same shape differ, found from the root down.

    Each level reads the children of the nodes that differ above; at most ``buckets`` numbers reach the driver.
    """
    spans = _levels(buckets, fan)
    digest = F.struct("rows", *_WORDS)
    differing = [0]
    for level in range(len(spans)):
        below = F.lit(True) if level == 0 else F.floor(F.col("node") / F.lit(fan)).isin(differing)
        sides = [t.where((F.col("level") == level) & below).select("node", digest.alias(name)) for t, name in ((one, "_a"), (other, "_b"))]
        found = sides[0].join(sides[1], "node", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("node")
        differing = sorted(r.node for r in found.collect())
        if not differing:
            break
    return differing


def in_buckets(rows: DataFrame, chosen: list[int], key: str = "_id", buckets: int = BUCKETS) -> DataFrame:
    """The rows whose key is in one of the chosen buckets."""
    return rows.where(bucket_of(column(key), buckets).isin(chosen) if chosen else F.lit(False))
