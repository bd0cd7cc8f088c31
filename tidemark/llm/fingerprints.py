"""Document fingerprints: one-permutation MinHash with optimal densification, packed low-order bits.

A text's shingles (five words, A-Z lower-cased; a shorter text is one shingle) are hashed
once; the hash's upper bits name one of ``BINS`` bins, and each bin keeps its smallest
hash. An empty bin asks other bins, in a random order of its own, and takes the value of
the first that was filled, so that two texts' empty bins take from the same place
whenever they can (optimal densification). Of each bin's value, mixed with the bin, the
lowest ``BITS`` bits are stored: a fingerprint is 256 hexadecimal digits, one per bin.

Two fingerprints agree in a share ``p`` of their digits. Different values agree by chance
in ``c = 2^-BITS`` of the cases, so the likeness is ``(p - c) / (1 - c)``, no less than 0:
an unbiased estimate of the shingle sets' Jaccard similarity, with a deviation of
about 0.03 at a half. Values are mixed with their bin before they are cut, or two
texts of one shingle each would agree in all bins or in none.

Fingerprinting is a map and moves nothing. ``with_edits`` needs each document's next by
id: texts move once, into ranges of ids of about ``PART_BYTES``, within which neighbours
are neighbours; only a range's last and first document are matched through a small table.

Defined results: NULL and empty texts, and texts of blanks, have no shingles; their
fingerprint is the empty string, which is like itself (1) and like nothing else (0).
Rows follow each other by id, NULL ids first; rows of one id by bytes of text, then its
crc32, then the text itself. Repeated rows count each and follow themselves; a single
row follows itself. Whole texts of any length count; one text must fit a task's memory.
An empty table gives no rows. Other columns never meet the operator's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from tidemark.llm import tokens as T
from tidemark.llm.buckets import volume
from tidemark.llm.graph import kept
from tidemark.llm.native import field, packed, quoted, renamed

WORDS, BINS, BITS = 5, 256, 4
PART_BYTES = 16 << 20
#: Texts whose bins are in memory at a time.
SLICE = 1024
_SEED = np.uint64(0x94D5A3C7E1F06B29)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_CHANCE = 2.0**-BITS
#: In which order an empty bin asks the others.
_ASKED = np.argsort(T.mix(np.arange(BINS * BINS, dtype=np.uint64) + _SEED).reshape(BINS, BINS), axis=1)
_OF_BIN = T.mix(np.arange(1, BINS + 1, dtype=np.uint64) * _SEED)

INSIDE, FIRST, LAST = 0, 1, 2


def shingles(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 64-bit hash of every shingle of a chunk."""
    starts, ends, first = T.words(data, bounds)
    names = T.word_names(T.lower(data), starts, ends)
    at, grams = T.windows(names, first, WORDS)
    count = np.diff(first)
    few = np.flatnonzero((count > 0) & (count < WORDS))
    alone = T.spans(T.prefix_sums(names), first[few], first[few + 1])
    owner = np.append(np.searchsorted(first, at, "right") - 1, few)
    return owner, T.mix(np.append(grams, alone) ^ _SEED)


def densified(smallest: np.ndarray) -> np.ndarray:
    """Rows of bins with every empty one (``_NONE``) filled from a filled one; rows without any stay empty."""
    filled = smallest != _NONE
    out = smallest.copy()
    row, bin_ = np.nonzero(~filled & filled.any(axis=1)[:, None])
    for turn in range(BINS):
        if not len(row):
            break
        from_ = _ASKED[bin_, turn]
        found = filled[row, from_]
        out[row[found], bin_[found]] = smallest[row[found], from_[found]]
        row, bin_ = row[~found], bin_[~found]
    return out


def digits(texts: pa.Array) -> np.ndarray:
    """A row of ``BINS`` values below 2^BITS for each text; 255 throughout for a text without shingles."""
    out = np.full((len(texts), BINS), 255, np.uint8)
    for row, data, bounds in T.chunks(texts):
        for at in range(0, len(bounds) - 1, SLICE):
            own = bounds[at : at + SLICE + 1]
            owner, hashes = shingles(data[own[0] : own[-1]], own - own[0])
            n = len(own) - 1
            smallest = np.full(n * BINS, _NONE, np.uint64)
            np.minimum.at(smallest, owner * BINS + (hashes >> np.uint64(56)).astype(np.int64), hashes)
            smallest = smallest.reshape(n, BINS)
            some = (smallest != _NONE).any(axis=1)
            low = T.mix(densified(smallest) ^ _OF_BIN) & np.uint64((1 << BITS) - 1)
            out[row + at : row + at + n][some] = low[some].astype(np.uint8)
    return out


def packed_bits(values: np.ndarray) -> pa.Array:
    """Two values a byte; no bytes for a text without shingles."""
    some = values[:, 0] != 255
    data = (values[some, 0::2] << 4) | values[some, 1::2]
    ends = np.append(0, np.cumsum(some * (BINS // 2))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.astype(np.uint8).tobytes())])


def unpacked_bits(packed: pa.Array) -> np.ndarray:
    out = np.full((len(packed), BINS), 255, np.uint8)
    data, bounds = T.text_bytes(packed)
    some = np.diff(bounds) > 0
    pairs = data.reshape(-1, BINS // 2)
    out[some] = np.stack([pairs >> 4, pairs & 15], axis=2).reshape(-1, BINS)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of values: the share of equal ones, less what agrees by chance."""
    share = (a == b).mean(axis=1)
    return np.maximum(0.0, (share - _CHANCE) / (1 - _CHANCE))


def _added(frame: DataFrame, inputs: list[str], name: str, kind: str, work: Callable[..., pa.Array]) -> DataFrame:
    """The rows with a column worked out from others. The rest passes through as one struct, so its names do not matter."""
    rest = [c for c in frame.columns if c != name]
    rows = packed(frame.select(*[F.col(quoted(c)) for c in rest]))
    given = rows.select("row", *[field(c).alias(f"in{i}") for i, c in enumerate(inputs)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), work(*batch.columns[1:])], names=["row", "added"])

    schema = StructType([given.schema["row"], StructField("added", DataType.fromDDL(kind))])
    return given.mapInArrow(add, schema).select(*[field(c).alias(c) for c in rest], F.col("added").alias(name))


def fingerprinted(docs: DataFrame, *, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """The rows with the packed fingerprint (binary) of ``text``."""
    return _added(docs, [text], name, "binary", lambda texts: packed_bits(digits(texts)))


def compared(pairs: DataFrame, a: str, b: str, *, name: str = "likeness") -> DataFrame:
    """The rows with the likeness of two columns of packed fingerprints."""
    return _added(pairs, [a, b], name, "double", lambda x, y: pa.array(likeness(unpacked_bits(x), unpacked_bits(y))))


_FOUND = "n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _columns(texts: list[str], nexts: list[str], prints: np.ndarray, next_prints: np.ndarray) -> list[pa.Array]:
    """The columns of ``_FOUND`` for texts, each with the one that comes next."""
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, nexts)]
    edits = digits(pa.array(edited, pa.large_string()))
    return [
        pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        packed_bits(prints), packed_bits(edits), pa.array(likeness(prints, edits)), pa.array(likeness(prints, next_prints)),
    ]


def with_edits(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id and the columns of ``_FOUND``, where the edited text ends with the start of the next document."""
    spark = docs.sparkSession
    rows = renamed(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.dtypes[0][1]
    n = max(1, -(-volume(rows, "text") // PART_BYTES))
    keys = [F.col("doc_id"), F.octet_length("text"), F.crc32(F.encode("text", "utf-8"))]
    # Ranges are cut by id, size and crc, so rows that repeat an id with different texts part, too.
    ordered = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys, "text")
    names = ["place", "part", "text", "doc_id", *[c.split()[0] for c in _FOUND.split(", ")]]

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows but the last of a range, which is given with its text, and so is the first's."""
        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts = batch.column(0), batch.column(1)
            if held is None:
                yield edge(FIRST, part, ids.slice(0, 1), texts.slice(0, 1))
            else:
                ids, texts = pa.concat_arrays([held[0], ids]), pa.concat_arrays([held[1], texts])
            held = ids.slice(len(ids) - 1), texts.slice(len(texts) - 1)
            found, plain = digits(texts), texts.to_pylist()
            m = len(plain) - 1
            columns = [pa.array([INSIDE] * m, pa.int32()), pa.array([part] * m, pa.int32()), pa.nulls(m, pa.string()), ids.slice(0, m)]
            yield pa.RecordBatch.from_arrays(columns + _columns(plain[:-1], plain[1:], found[:-1], found[1:]), names=names)
        if held is not None:
            yield edge(LAST, part, *held)

    def edge(place: int, part: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        rest = [pa.nulls(1, k) for k in (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
        columns = [pa.array([place], pa.int32()), pa.array([part], pa.int32()), texts.cast(pa.string()), ids, *rest]
        return pa.RecordBatch.from_arrays(columns, names=names)

    table = kept(spark, ordered.mapInArrow(follow, f"place int, part int, text string, doc_id {kind}, {_FOUND}"), "prints")
    inside = table.where(F.col("place") == INSIDE)

    # One row per range: its last document, and the first of the next range that has any (after the last, the first).
    heads = table.where(F.col("place") == FIRST).select(F.col("part").alias("after"), F.col("text").alias("next_text"))
    everything = Window.orderBy("after")
    turns = heads.select("after").select(
        F.col("after").alias("part"), F.coalesce(F.lead("after").over(everything), F.min("after").over(Window.partitionBy(F.lit(1)))).alias("after")
    )
    lasts = table.where(F.col("place") == LAST).select("part", "doc_id", "text").join(turns, "part").join(heads, "after")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, texts, nexts = (batch.column(c).slice(i, 1) for c in ("doc_id", "text", "next_text"))
                yield pa.RecordBatch.from_arrays([ids, *_columns(texts.to_pylist(), nexts.to_pylist(), digits(texts), digits(nexts))], names=names[3:])

    ends = lasts.select("doc_id", "text", "next_text").mapInArrow(finish, f"doc_id {kind}, {_FOUND}")
    return inside.select(*names[3:]).unionByName(ends)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return found.select("doc_id", "n_chars", "edited_sha256", text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next")
