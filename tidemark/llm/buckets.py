"""Asking all documents about keys, with each text shuffled once.

Texts are dealt into buckets of a few megabytes. A bucket's task turns its texts into
sorted, distinct 48-bit keys and sends each key once, whatever the number of its
occurrences, to the block of the key space it belongs to; a key in a third of all
rows is thus one entry per bucket. A block's task counts its keys over all buckets
and answers with one byte per key, in the order asked, so an answer needs no key.
The bucket's texts then meet their answers in a cogroup. The texts' exchange is
planned alike each time, and Spark runs it once.

Keys travel as 32-bit differences in binary columns; a lost task is simply run anew,
since all keys are functions of the content.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.native import quoted

BUCKET_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20
KEY_BITS = 48
_FULL = np.uint64(0xFFFFFFFF)

ASK = "block int, bucket int, keys binary, more binary"
ANSWER = "bucket int, block int, answer binary"


def volume(docs: DataFrame, text: str) -> int:
    """Bytes of all texts: what the numbers of buckets and blocks follow."""
    return docs.agg(F.sum(F.octet_length(F.col(quoted(text))).cast("long"))).first()[0] or 0


def by_hash(docs: DataFrame, *, doc_id: str, text: str, total: int, size: int = BUCKET_BYTES) -> DataFrame:
    """bucket, doc_id, text: rows dealt at random, but alike in every run."""
    n = max(1, -(-total // size))
    key = F.xxhash64(F.col(quoted(doc_id)), F.col(quoted(text)))
    return docs.select(F.pmod(key, F.lit(n)).cast("int").alias("bucket"), F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text"))


def blocks_for(total: int, size: int = BLOCK_BYTES) -> int:
    return max(1, -(-total // size))


def key48(names: np.ndarray) -> np.ndarray:
    return names >> np.uint64(64 - KEY_BITS)


def _cuts(n_blocks: int) -> np.ndarray:
    return np.array([-(-(i << KEY_BITS) // n_blocks) for i in range(n_blocks)], np.uint64)


def _packed(keys: np.ndarray, base: int) -> bytes:
    gaps = np.diff(keys, prepend=np.uint64(base))
    long = gaps >= _FULL
    if long.any():
        skips = (gaps // _FULL).astype(np.int64)
        out = np.full(len(keys) + int(skips.sum()), _FULL, np.uint64)
        out[np.arange(len(keys)) + np.cumsum(skips)] = gaps % _FULL
        gaps = out
    return gaps.astype("<u4").tobytes()


def _unpacked(blob: bytes, base: int) -> np.ndarray:
    gaps = np.frombuffer(blob, "<u4").astype(np.uint64)
    keys = np.cumsum(gaps) + np.uint64(base)
    return keys[gaps != _FULL]


def told(counts: np.ndarray) -> np.ndarray:
    """Occurrences as two bytes each; 65 535 and more are alike."""
    return np.minimum(counts, 65_535).astype(np.uint16)


def asked(bucket: int, keys: np.ndarray, more: np.ndarray, n_blocks: int, aside: bytes | None = None) -> pa.Table:
    """A bucket's sorted keys as one row per block that has any, with one value of ``more`` for each key.

    ``aside`` comes back with the answers as it is, as that of a block past the last.
    """
    cuts = _cuts(n_blocks)
    at = np.append(np.searchsorted(keys, cuts), len(keys))
    some = np.flatnonzero(at[1:] > at[:-1]).tolist()
    rows = [(i, _packed(keys[at[i] : at[i + 1]], int(cuts[i])), more[at[i] : at[i + 1]].tobytes()) for i in some]
    if aside is not None:
        rows.append((n_blocks + bucket, aside, None))
    return pa.table({
        "block": pa.array([r[0] for r in rows], pa.int32()),
        "bucket": pa.array([bucket] * len(rows), pa.int32()),
        "keys": pa.array([r[1] for r in rows], pa.binary()),
        "more": pa.array([r[2] for r in rows], pa.binary()),
    })


def _of_block(table: pa.Table, n_blocks: int, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets in rising order; all their keys, end to end; how many each has; what came with the keys."""
    table = table.sort_by("bucket")
    base = -(-(table["block"][0].as_py() << KEY_BITS) // n_blocks)
    parts = [_unpacked(blob.as_py(), base) for blob in table["keys"]]
    more = [np.frombuffer(blob.as_py(), kind) for blob in table["more"]]
    return table["bucket"].to_numpy(), np.concatenate(parts), np.array([len(p) for p in parts]), np.concatenate(more)


def _answers(table: pa.Table, buckets: np.ndarray, lengths: np.ndarray, said: np.ndarray) -> pa.Table:
    ends = np.cumsum(lengths)
    return pa.table({
        "bucket": pa.array(buckets, pa.int32()),
        "block": pa.array(np.full(len(buckets), table["block"][0].as_py()), pa.int32()),
        "answer": pa.array([said[e - n : e].tobytes() for e, n in zip(ends, lengths)], pa.binary()),
    })


def commonness(asks: DataFrame, n_blocks: int) -> DataFrame:
    """Answers 0 for a key that occurs once in all, else 1 + floor(log2(occurrences))."""

    def count(table: pa.Table) -> pa.Table:
        buckets, keys, lengths, counts = _of_block(table, n_blocks, np.uint16)
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        fresh = np.append(True, ordered[1:] != ordered[:-1])
        starts = np.flatnonzero(fresh)
        total = np.add.reduceat(counts[order].astype(np.int64), starts)
        code = np.where(total > 1, 1 + np.floor(np.log2(total)), 0).astype(np.uint8)
        said = np.empty(len(keys), np.uint8)
        said[order] = code[np.cumsum(fresh) - 1]
        return _answers(table, buckets, lengths, said)

    return asks.groupBy("block").applyInArrow(count, ANSWER)


def earlier(asks: DataFrame, n_blocks: int) -> DataFrame:
    """Answers 1 for a key that a bucket of a lower number asks for too. A key is 48 bits and the 64 that came with it."""

    def first(table: pa.Table) -> pa.Table:
        if table["block"][0].as_py() >= n_blocks:
            return table.select(["bucket", "block", "keys"]).rename_columns(["bucket", "block", "answer"])
        buckets, keys, lengths, checks = _of_block(table, n_blocks, np.uint64)
        order = np.lexsort((checks, keys))
        same = (keys[order][1:] == keys[order][:-1]) & (checks[order][1:] == checks[order][:-1])
        said = np.empty(len(keys), np.uint8)
        said[order] = np.append(False, same)
        return _answers(table, buckets, lengths, said)

    return asks.groupBy("block").applyInArrow(first, ANSWER)


def answered(answers: pa.Table, n: int, kind: type = np.uint8) -> np.ndarray:
    """One value for each of the ``n`` keys a bucket asked about, in their order."""
    said = np.frombuffer(b"".join(x.as_py() for x in answers.sort_by("block")["answer"]), kind)
    if len(said) != n:
        raise ValueError(f"{n} keys asked about, {len(said)} answers")
    return said


def set_aside(answers: pa.Table, n_blocks: int) -> tuple[pa.Table, bytes]:
    """The answers proper, and what the bucket had set aside."""
    late = pc.greater_equal(answers["block"], n_blocks)
    return answers.filter(pc.invert(late)), b"".join(x.as_py() for x in answers.filter(late)["answer"])


def range_marks(docs: DataFrame, doc_id: str, n: int) -> list[int]:
    """Bounds that part the rows about evenly by id."""
    if n <= 1:
        return []
    share = [i / n for i in range(1, n)]
    return sorted(set(docs.agg(F.percentile_approx(F.col(quoted(doc_id)), share, max(10_000, 4 * n))).first()[0] or []))


def by_range(docs: DataFrame, *, doc_id: str, text: str, total: int, size: int = BUCKET_BYTES) -> DataFrame:
    """bucket, doc_id, text: a lower bucket holds lower ids; rows of one id share a bucket. NULL ids come first."""
    marks = range_marks(docs, doc_id, max(1, -(-total // size)))
    key = F.col(quoted(doc_id))
    # A search among the bounds, as an array function over one literal: no join, no shuffle.
    bucket = F.when(key.isNull(), 0).otherwise(_search(key, marks)) if marks else F.lit(0)
    return docs.select(bucket.cast("int").alias("bucket"), key.alias("doc_id"), F.col(quoted(text)).alias("text"))


def _search(key, marks: list[int]):
    """How many bounds are at or below the key: first among every k-th bound, then within that stretch."""
    step = max(1, int(len(marks) ** 0.5))
    coarse = marks[step - 1 :: step]
    all_marks = F.array(*[F.lit(m) for m in marks])
    jump = F.size(F.filter(F.array(*[F.lit(m) for m in coarse]), lambda m: m <= key)) * step
    return jump + F.size(F.filter(F.slice(all_marks, jump + 1, step), lambda m: m <= key))

