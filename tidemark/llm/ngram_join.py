"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

The matrix is never built whole. (1) Buckets of documents ask, by column blocks, how
common their n-grams are (``buckets``). A column with one entry adds to no overlap and
is left out. (2) Of a set of ``n`` n-grams, the rarest ``n - ceil(t n) + 1`` must hold one
that any partner has, too; with the lone ones first in that order most documents drop
out here. Columns of what is left, cut by size class so that only sizes within the
bound meet, tie documents to the column's least one, m - 1 ties for m entries: the
ties' components hold every link. Documents of one set of n-grams count once. (3) In each
component, rows in blocks of at most ``TILE`` are multiplied, tile by tile of columns,
and pairs whose overlap stays below the bound for their sizes are discarded; the links
that remain leave as a forest. Components larger than a tile are joined by their groups'
first members, and then only documents outside the largest group meet the other blocks.

Defined results: NULL and empty texts, and texts of blanks, have empty sets and are
linked with nothing. Shorter texts than ``n`` words have one n-gram, all of their words.
Rows of one id are one node; a row of NULL id is linked with nothing. Repeated rows come
back as often. An empty table gives no rows. Other columns never meet the operator's own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import buckets as B
from tidemark.llm import tokens as T
from tidemark.llm.graph import components, kept
from tidemark.llm.native import field, without

WIDTH, PERCENT = 5, 80
TILE = 1024
_COLUMNS = 4096
_SETS = "doc_id bigint, n bigint, sig1 bigint, sig2 bigint, prefix array<bigint>, shared binary"


def ngram_sets(texts: pa.ChunkedArray | pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The sorted, distinct n-gram names of every text, end to end, and the bounds of each text's."""
    parts, sizes = [], []
    for _, data, bounds in T.chunks(texts):
        starts, ends, first = T.words(T.lower(data), bounds)
        names = T.word_names(T.lower(data), starts, ends)
        at, grams = T.windows(names, first, width)
        cut = np.searchsorted(at, first)
        few = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < width))
        alone = T.spans(T.prefix_sums(names), first[few], first[few + 1])
        short = dict(zip(few.tolist(), alone))
        for k in range(len(bounds) - 1):
            own = grams[cut[k] : cut[k + 1]]
            if k in short:
                own = np.array([short[k]], np.uint64)
            elif len(own):
                own.sort()
                own = own[np.append(True, own[1:] != own[:-1])]
            parts.append(own)
            sizes.append(len(own))
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int64)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[bounds[1:]] - total[bounds[:-1]]


def sets_table(docs: DataFrame, *, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """Per row: n, a 128-bit name of the set, and, where it can have partners, its prefix and its shared n-grams."""
    total = B.volume(docs, text)
    dealt = B.by_hash(docs, doc_id=doc_id, text=text, total=total)
    n_blocks = B.blocks_for(total)

    def ask(table: pa.Table) -> pa.Table:
        grams, _ = ngram_sets(table["text"], width)
        keys, counts = np.unique(B.key48(grams), return_counts=True)
        return B.asked(table["bucket"][0].as_py(), keys, B.told(counts), n_blocks)

    def judge(table: pa.Table, answers: pa.Table) -> pa.Table:
        grams, bounds = ngram_sets(table["text"], width)
        n = np.diff(bounds)
        doc = np.repeat(np.arange(len(n)), n)
        keys = B.key48(grams)
        distinct, at = np.unique(keys, return_inverse=True)
        code = B.answered(answers, len(distinct))[at]
        common = code > 0
        spare = n - -(-percent * n // 100) + 1 - (n - np.bincount(doc[common], minlength=len(n)))
        first, second = _sums(T.mix(grams), bounds), _sums(T.mix(grams ^ np.uint64(0x5851F42D4C957F2D)), bounds)
        kept_doc, kept_gram = doc[common], grams[common]
        order = np.lexsort((kept_gram, code[common], kept_doc))
        cut = np.searchsorted(kept_doc, np.arange(len(n) + 1))
        prefix, shared = [], []
        for k in range(len(n)):
            if spare[k] > 0 and n[k]:
                prefix.append(kept_gram[order[cut[k] : cut[k] + spare[k]]].view(np.int64))
                shared.append(kept_gram[cut[k] : cut[k + 1]].tobytes())
            else:
                prefix.append(None)
                shared.append(None)
        return pa.table({
            "doc_id": table["doc_id"], "n": pa.array(n, pa.int64()),
            "sig1": pa.array(first.view(np.int64)), "sig2": pa.array(second.view(np.int64)),
            "prefix": pa.array(prefix, pa.list_(pa.int64())), "shared": pa.array(shared, pa.binary()),
        })

    answers = B.commonness(dealt.groupBy("bucket").applyInArrow(ask, B.ASK), n_blocks)
    return dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(judge, _SETS)


def _links(ids: np.ndarray, n: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which rows link, as a boolean matrix."""
    m = len(ids)
    linked = ids[:, None] == ids[None, :]
    fits = 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
    if m <= 24:
        for i in range(m):
            for j in range(i):
                if fits[i, j]:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    linked[i, j] |= 100 * both >= percent * (n[i] + n[j] - both)
        return linked | linked.T
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    entries = np.bincount(column)
    number = np.cumsum(entries > 1) - 1
    useful = entries[column] > 1
    row, column = row[useful], number[column[useful]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    overlap = np.zeros((m, m), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [low, low + _COLUMNS])
        tile = np.zeros((m, _COLUMNS), np.float32)
        tile[row[a:b], column[a:b] - low] = 1
        overlap += tile @ tile.T
    union = n[:, None] + n[None, :] - overlap.astype(np.int64)
    return linked | (fits & (100 * overlap.astype(np.int64) >= percent * union))


def _labels(ids: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The smallest id that each row reaches."""
    out, left = np.array(ids), np.ones(len(ids), bool)
    for start in np.argsort(ids, kind="stable"):
        if not left[start]:
            continue
        reach, edge = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        edge[start] = True
        while edge.any():
            reach |= edge
            edge = linked[edge].any(axis=0) & ~reach
        out[reach] = ids[start]
        left &= ~reach
    return out


def _products(rows: DataFrame, percent: int, bins: int) -> DataFrame:
    """(a, b): each document and the first one of its group, within each ``tile`` of the rows."""

    def multiply(table: pa.Table) -> pa.Table:
        tiles, ids = table["tile"].to_numpy(), table["doc_id"].to_numpy()
        n, shared = table["n"].to_numpy(), table["shared"].combine_chunks()
        order = np.argsort(tiles, kind="stable")
        a, b = [], []
        for own in np.split(order, np.flatnonzero(np.diff(tiles[order])) + 1):
            if len(own) > 1:
                sets = [np.frombuffer(shared[int(i)].as_py(), np.uint64) for i in own]
                a.append(ids[own])
                b.append(_labels(ids[own], _links(ids[own], n[own], sets, percent)))
        flat = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
        out = pa.table({"a": flat(a), "b": flat(b)})
        return out.filter(pc.not_equal(out["a"], out["b"]))

    dealt = rows.withColumn("bin", F.pmod(F.xxhash64("tile"), F.lit(bins)))
    return dealt.select("bin", "tile", "doc_id", "n", "shared").groupBy("bin").applyInArrow(multiply, "a bigint, b bigint")


def similar_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable by links)."""
    spark = docs.sparkSession
    sets = kept(spark, sets_table(docs, doc_id=doc_id, text=text, width=width, percent=percent), "ngram-sets")
    able = sets.where("prefix IS NOT NULL AND doc_id IS NOT NULL")
    own = ["sig1", "sig2", "n"]
    first = able.groupBy(*own).agg(F.min("doc_id").alias("doc_id"))
    rows = able.join(first, [*own, "doc_id"], "left_semi").dropDuplicates(["doc_id", *own])
    # Sizes within the bound fall into one class or two neighbouring ones; either way they share one of a row's two.
    size = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    entries = rows.select("doc_id", F.array(size, size + 1).alias("classes"), F.explode("prefix").alias("gram"))
    entries = entries.select("doc_id", "gram", F.explode("classes").alias("class"))
    heads = entries.groupBy("gram", "class").agg(F.min("doc_id").alias("b"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    ties = entries.join(heads, ["gram", "class"]).select(F.col("doc_id").alias("a"), "b")
    loose = kept(spark, components(spark, ties), "loose")
    members = rows.join(loose, F.col("doc_id") == F.col("id")).drop("id")
    sizes = loose.groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    members = members.join(sizes.where("m > 1"), "label")
    count, largest = sizes.agg(F.sum("m"), F.max("m")).first()
    bins = max(1, -(-(count or 0) // tile))
    # A tile holds at most about ``tile`` rows of one component.
    parts = F.ceil(F.col("m") / tile)
    tiled = members.withColumn("salt", F.pmod(F.xxhash64("doc_id"), parts)).withColumn("tile", F.xxhash64("label", "salt"))
    links = kept(spark, _products(tiled, percent, bins), "links")
    if (largest or 0) > tile:
        links = _across(spark, tiled.where(parts > 1), links, percent, tile, bins)
        labels = components(spark, links)
    else:
        labels = links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label"))
    heads_of = able.groupBy(*own).agg(F.min("doc_id").alias("head")).join(labels, F.col("head") == F.col("id"), "left")
    heads_of = heads_of.select(*own, F.coalesce("label", "head").alias("component"))
    return sets.join(heads_of, own, "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("prefix").isNotNull() & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def _across(spark: SparkSession, members: DataFrame, links: DataFrame, percent: int, tile: int, bins: int) -> DataFrame:
    """Links between the tiles of components that have several.

    Groups are first joined through their first members, so that a component that is
    one group is known as such; after that only pairs of rows of different groups are
    open, and all of them have a row outside the component's largest group.
    """
    members = kept(spark, members, "members")

    def grouped(found: DataFrame) -> DataFrame:
        labels = components(spark, found)
        joined = members.join(labels.select("id", F.col("label").alias("group")), F.col("doc_id") == F.col("id"), "left")
        return kept(spark, joined.withColumn("group", F.coalesce("group", "doc_id")).drop("id"), "grouped")

    now = grouped(links)
    leaders = now.where("doc_id = group").withColumn("tile", F.xxhash64("label", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.ceil(F.col("m") / (8 * tile)))))
    links = links.unionByName(_products(leaders, percent, bins))
    now = grouped(links)
    sizes = now.groupBy("label", "group").agg(F.count(F.lit(1)).alias("g"))
    main = sizes.groupBy("label").agg(F.max_by("group", "g").alias("main"))
    now = now.join(main, "label")
    # Tiles of half the size, so that two of them make one product.
    half = tile // 2
    outside = now.where("group <> main")
    counted = outside.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / half).alias("strips"))
    strip = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.col("strips"))
    column = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.ceil(F.col("m") / half))
    columns = F.ceil(F.col("m") / half)
    left = outside.join(counted, "label").withColumn("x", strip).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), columns - 1)))
    right = now.join(counted, "label").withColumn("y", column).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("strips") - 1)))
    crossed = left.select("label", "x", "y", "doc_id", "n", "shared").unionByName(right.select("label", "x", "y", "doc_id", "n", "shared"))
    crossed = crossed.withColumn("tile", F.xxhash64("label", "x", "y"))
    return kept(spark, links.unionByName(_products(crossed, percent, 4 * bins)), "links")


def first_of_each_group(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents, all columns, without those that a smaller id of their group stands for."""
    groups = similar_groups(docs, doc_id=doc_id, text=text, **how)
    gone = kept(docs.sparkSession, groups.where("component_id <> doc_id").select(F.col("doc_id").alias("key")), "gone")
    return without(docs, field(doc_id), gone)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, CASE WHEN len(ws) > 0 THEN 2 ELSE 1 END))) AS i FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(id, r) AS (
  SELECT a, a FROM edges UNION SELECT reach.id, edges.b FROM reach JOIN edges ON reach.r = edges.a
), first AS (
  SELECT id, min(r) AS c FROM reach GROUP BY id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(first.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN first ON first.id = d.doc_id
"""
