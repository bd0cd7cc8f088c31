"""LM scoring with a log-frequency Bloom filter.

Counts of the words and word pairs of all training documents are gathered by Spark, in
blocks of their key space. Each block builds its part of one filter: a count ``c`` enters as
the members (n-gram, 1) ... (n-gram, q) with ``q = 1 + floor(log(c) / log(BASE))``, and
comes back as the largest q of which all members are found. A part has ``MEMBER_BITS`` bits
for each of its own members, so the filter grows with the corpus and no n-gram is left out.
No task holds more than one part: buckets of texts ask the parts for their distinct n-grams.
Only who gives ``filter_bits`` gets a filter of so many bits in all, whose parts leave out
n-grams below the least count at which their members fit (a model's usual count cutoff). A pair is scored by its quantised count over its first word's, with the second word's
own probability as a prior of weight ``PRIOR``:

    P(w) = (c(w) + 1) / (N + V + 1)        P(w | v) = (min(c(v w), c(v)) + PRIOR P(w)) / (c(v) + PRIOR)

The base score needs exact counts, which the filter does not give: the buckets also ask the
vocabulary, kept as a table in blocks, for their distinct words.

Defined results: NULL and empty texts are the end token alone. A NULL id is never held out.
Rows of one id are each scored (and learned from). Without training documents N and V are
0. An empty table gives no rows. Other columns never meet the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import buckets as B
from tidemark.llm import tokens as T
from tidemark.llm.graph import kept
from tidemark.llm.native import quoted

FOLDS, HELD = 7, 2
#: Bits that a member has at least, how many of them it sets, and the least bits of all parts together.
MEMBER_BITS, PROBES, LEAST_BITS = 10, 5, 1 << 28
BASE, PRIOR = 1.5, 4.0
MAX_BLOCKS = 1 << 14
_SLICE = 10 << 20
_SEED = np.uint64(0x1D8E4E27C47D124F)
_START, _END = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA24BAED4963EE407)
_RESULT = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
)

#: What comes with a word's key where words are counted: a slice holds fewer than 2^32 tokens.
_COUNTED = np.dtype([("check", "<u4"), ("count", "<u4")])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def _tokens(data: np.ndarray, bounds: np.ndarray, checks: bool = True):
    """Names of all tokens, each text's words and then its end; a second name of each; the bounds of each text's."""
    data = T.lower(data)
    starts, ends, first = T.words(data, bounds)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    at, stop = np.arange(len(starts)) + text, first[1:] + np.arange(len(bounds) - 1)
    names = np.empty(len(starts) + len(bounds) - 1, np.uint64)
    names[at], names[stop] = T.word_names(data, starts, ends), _END
    second = None
    if checks:
        second = np.empty(len(names), np.uint32)
        # Half of a second name: with the 48 bits of a key, words are told apart by 80.
        second[at], second[stop] = T.names_of(data, starts, ends, seed=1) >> np.uint64(32), _END & np.uint64(0xFFFFFFFF)
    return names, second, np.append(0, stop + 1)


def _pairs(names: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A name for every token with the one before it (or the text's start)."""
    before = np.append(_START, names[:-1])
    before[bounds[:-1]] = _START
    return T.mix(T.mix(before) * np.uint64(3) + names)


def _distinct(names: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (name, check) by name, and each token's as an index. Names alone tell words apart but for collisions, which are looked for."""

    def runs(order: np.ndarray, new: np.ndarray):
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(new) - 1
        return names[order][new], checks[order][new], back

    order = np.argsort(names)
    found = runs(order, np.append(True, names[order][1:] != names[order][:-1])[: len(order)])
    if (found[1][found[2]] != checks).any():
        order = np.lexsort((checks, names))
        a, c = names[order], checks[order]
        found = runs(order, np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1]))[: len(order)])
    return found


def _grouped(keys: np.ndarray, checks: np.ndarray, counts: np.ndarray):
    """Distinct (key, check), in order, with their summed counts."""
    order = np.lexsort((checks, keys))
    keys, checks = keys[order], checks[order]
    new = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1]))[: len(keys)])
    return keys[new], checks[new], np.add.reduceat(counts[order], new) if len(new) else counts[:0]


def _planes(table: pa.Table, column: str, width: int, back: bool = False) -> pa.Table:
    """A binary column of numbers of ``width`` bytes with all first bytes first, then all second ones, ...: the upper, mostly 0, take no room when packed."""
    blobs = [np.frombuffer(x.as_py(), np.uint8) for x in table[column]]
    turned = [(x.reshape(width, -1) if back else x.reshape(-1, width)).T.tobytes() for x in blobs]
    return table.set_column(table.schema.get_field_index(column), column, pa.array(turned, pa.binary()))


def vocabulary(training: DataFrame, text: str, n_blocks: int) -> DataFrame:
    """block, the block's words and exact counts, n_types, n_tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, bounds in T.chunks(batch.column(0), _SLICE):
                names, checks, back = _distinct(*_tokens(data, bounds)[:2])
                more = np.empty(len(names), _COUNTED)
                more["check"], more["count"] = checks, np.bincount(back, minlength=len(names))
                yield from _planes(B.asked(0, B.key48(names), more, n_blocks), "more", _COUNTED.itemsize).to_batches()

    def gather(table: pa.Table) -> pa.Table:
        table = _planes(table, "more", _COUNTED.itemsize, back=True)
        _, keys, _, more = B._of_block(table, n_blocks, _COUNTED)
        keys, checks, counts = _grouped(keys, more["check"], more["count"].astype(np.uint64))
        return pa.table({
            "block": table["block"][:1], "keys": pa.array([keys.tobytes()]), "checks": pa.array([checks.tobytes()]), "counts": pa.array([counts.tobytes()]),
            "n_types": pa.array([len(keys)], pa.int64()), "n_tokens": pa.array([int(counts.sum())], pa.int64()),
        })

    asks = training.select(text).mapInArrow(count, B.ASK)
    return asks.groupBy("block").applyInArrow(gather, "block int, keys binary, checks binary, counts binary, n_types bigint, n_tokens bigint")


def quantised(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def _places(keys: np.ndarray, level: np.ndarray | int, bits: int) -> Iterator[np.ndarray]:
    """The bits of the members (key, level), one probe of all after the other."""
    h = T.mix(keys ^ T.mix(np.asarray(level, np.uint64).reshape(-1) + _SEED))
    step = (h >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield (h + step * np.uint64(i)) % np.uint64(bits)


def filter_parts(training: DataFrame, text: str, n_blocks: int, bits: int | None = None) -> DataFrame:
    """block, bits: each block's part of the filter over words and pairs, as large as its members need, or of ``bits``; least: the smallest count it holds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, bounds in T.chunks(batch.column(0), _SLICE):
                names, _, cuts = _tokens(data, bounds, checks=False)
                keys, counts = np.unique(B.key48(np.append(names, _pairs(names, cuts))), return_counts=True)
                yield from B.asked(0, keys, counts.astype(np.uint32), n_blocks).to_batches()

    least_size = max(1024, LEAST_BITS // n_blocks // 8 * 8)

    def build(table: pa.Table) -> pa.Table:
        _, keys, _, counts = B._of_block(table, n_blocks, np.uint32)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order].astype(np.int64)
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, counts = keys[new], np.add.reduceat(counts, new)
        levels = quantised(counts)
        # Members of all n-grams of a count or more; the least count at which they fit.
        values, at = np.unique(counts, return_inverse=True)
        members = np.cumsum(np.bincount(at, levels)[::-1])[::-1]
        size = bits or max(least_size, -(-int(members[0]) * MEMBER_BITS // 8) * 8)
        fit = np.flatnonzero(members * MEMBER_BITS <= size)
        least = int(values[fit[0]]) if len(fit) else int(values[-1]) + 1
        keys, levels = keys[counts >= least], levels[counts >= least]
        part = np.zeros(size, bool)
        for level in range(1, int(levels.max()) + 1 if len(levels) else 1):
            for place in _places(keys[levels >= level], level, size):
                part[place.astype(np.int64)] = True
        return pa.table({"block": table["block"][:1], "bits": pa.array([np.packbits(part).tobytes()]), "least": pa.array([least], pa.int64())})

    asks = training.select(text).mapInArrow(count, B.ASK)
    return asks.groupBy("block").applyInArrow(build, "block int, bits binary, least bigint")


def levels_of(part: bytes, keys: np.ndarray) -> np.ndarray:
    """The n-grams' quantised counts as a part of the filter has them, 0 for what it does not hold."""
    data, open_ = np.frombuffer(part, np.uint8), np.arange(len(keys))
    levels = np.zeros(len(keys), np.uint8)
    level = 0
    while len(open_):
        level += 1
        h = T.mix(keys[open_] ^ T.mix(np.array([level], np.uint64) + _SEED))
        step = (h >> np.uint64(32)) | np.uint64(1)
        for i in range(PROBES):
            place = ((h + step * np.uint64(i)) % np.uint64(len(data) * 8)).astype(np.int64)
            hit = (data[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
            open_, h, step = open_[hit], h[hit], step[hit]
        levels[open_] = level
    return levels


def told(levels: np.ndarray) -> np.ndarray:
    return np.where(levels > 0, BASE ** (levels.astype(np.float64) - 0.5), 0.0)


def _counts_of(asks: DataFrame, words: DataFrame, parts: DataFrame, n_blocks: int) -> DataFrame:
    """The exact counts of the words asked about, and, of blocks from ``n_blocks`` on, the levels of the n-grams."""

    def look_up(table: pa.Table, known: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"bucket": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), "answer": pa.array([], pa.binary())})
        if table["block"][0].as_py() >= n_blocks:
            own = table.set_column(0, "block", pc.subtract(table["block"], pa.scalar(n_blocks, pa.int32())))
            buckets, keys, lengths, _ = B._of_block(own, n_blocks, np.uint8)
            said = levels_of(known["bits"][0].as_py(), keys) if len(known) else np.zeros(len(keys), np.uint8)
            return B._answers(table, buckets, lengths, said)
        buckets, keys, lengths, checks = B._of_block(table, n_blocks, np.uint32)
        said = np.zeros(len(keys), np.uint64)
        if len(known):
            have, also, counts = (np.frombuffer(known[c][0].as_py(), t) for c, t in (("keys", np.uint64), ("checks", np.uint32), ("counts", np.uint64)))
            at, end = np.searchsorted(have, keys), np.searchsorted(have, keys, "right")
            for step in range(int((end - at).max()) if len(keys) else 0):
                here = np.minimum(at + step, len(have) - 1)
                hit = (at + step < end) & (also[here] == checks)
                said[hit] = counts[here[hit]]
        return _planes(B._answers(table, buckets, lengths, said), "answer", 8)

    nothing = F.lit(None).cast("binary")
    stored = words.select("block", "keys", "checks", "counts", nothing.alias("bits")).unionByName(
        parts.select((F.col("block") + n_blocks).alias("block"), *[nothing.alias(c) for c in ("keys", "checks", "counts")], "bits")
    )
    return asks.groupBy("block").cogroup(stored.groupBy("block")).applyInArrow(look_up, B.ANSWER)


def scored(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", filter_bits: int | None = None) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of the text's probability)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text"))
    total = B.volume(docs, "text")
    n_blocks = min(B.blocks_for(total), MAX_BLOCKS)
    training = docs.where(~held_out(F.col("doc_id")))
    words = kept(spark, vocabulary(training, "text", n_blocks), "vocabulary")
    n_types, n_tokens = (x or 0 for x in words.agg(F.sum("n_types"), F.sum("n_tokens")).first())
    parts = filter_parts(training, "text", n_blocks, filter_bits and max(1024, filter_bits // n_blocks // 8 * 8))
    dealt = B.by_hash(docs, doc_id="doc_id", text="text", total=total, size=_SLICE)

    def ask(table: pa.Table) -> pa.Table:
        found = [_tokens(data, bounds) for _, data, bounds in T.chunks(table["text"])]
        names, checks, _ = _distinct(*(np.concatenate([x[i] for x in found]) for i in (0, 1)))
        grams = np.unique(B.key48(np.concatenate([names] + [_pairs(x[0], x[2]) for x in found])))
        bucket = table["bucket"][0].as_py()
        more = B.asked(bucket, grams, np.zeros(len(grams), np.uint8), n_blocks)
        more = more.set_column(0, "block", pc.add(more["block"], pa.scalar(n_blocks, pa.int32())))
        return pa.concat_tables([B.asked(bucket, B.key48(names), checks, n_blocks), more])

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        found = [_tokens(data, bounds) for _, data, bounds in T.chunks(table["text"])]
        words, _, back = _distinct(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
        pairs = [_pairs(names, cuts) for names, _, cuts in found]
        grams, place = np.unique(B.key48(np.concatenate([words] + pairs)), return_inverse=True)
        late = pc.greater_equal(answers["block"], n_blocks)
        exact = B.answered(_planes(answers.filter(pc.invert(late)), "answer", 8, back=True), len(words), np.uint64).astype(np.float64)
        quantity = told(B.answered(answers.filter(late), len(grams)))[place]
        of_word, of_pair = quantity[: len(words)], quantity[len(words) :]
        opening, low, out = of_word[back[found[0][2][1] - 1]], 0, [[], [], [], []]  # a text's last token is the end
        for names, _, cuts in found:
            own = back[low : low + len(names)]
            c, single = exact[own], of_word[own]
            first = np.append(0.0, single[:-1])
            first[cuts[:-1]] = opening
            both = np.minimum(of_pair[low : low + len(names)], first)
            low += len(names)
            own_p = (single + 1) / (n_tokens + n_types + 1)
            p = (both + PRIOR * own_p) / (first + PRIOR)
            out[0].append(np.diff(cuts))
            out[1].append(np.add.reduceat((c > 0).astype(np.int64), cuts[:-1]))
            out[2].append(np.add.reduceat(np.log10((c + 1) / (n_tokens + n_types + 1)), cuts[:-1]))
            out[3].append(np.add.reduceat(np.log10(np.minimum(p, 1.0)), cuts[:-1]))
        n, known, base, total_score = (np.concatenate(x) for x in out)
        return pa.table({
            "doc_id": table["doc_id"], "held_out": pa.array([False] * len(n)), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known, pa.int64()),
            "train_tokens": pa.array(np.full(len(n), n_tokens), pa.int64()), "base_score": pa.array(base), "score": pa.array(total_score),
        })

    answers = _counts_of(dealt.groupBy("bucket").applyInArrow(ask, B.ASK), words, parts, n_blocks)
    result = dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(score, _RESULT)
    return result.withColumn("held_out", held_out(F.col("doc_id")))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
