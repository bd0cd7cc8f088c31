"""Suffix-array dedup: bytes of strings of 200 that start anywhere else, too, go.

(1) Buckets of texts ask how often their anchors occur: the anchor of a 200-byte window is
its 80-byte string of smallest fingerprint, so equal windows have equal anchors at equal
places. Windows that hold a unique anchor are unique. (2) What is left of the texts, cut
into segments by anchor, meets by anchor name; equal segments have met all they can and
become one string of their block's collection. Names with several strings left are
ordered by ``collection``: the Burrows-Wheeler transform of the whole collection and the
common prefixes of its suffixes, built column by column from the strings' ends, one
symbol of every string a round, each round one sequential pass that merges the new rows
into the old. A window is repeated if its suffix shares 200 bytes with a neighbour in
that order. (3) Each text meets its bucket's answers and loses the bytes covered.

The passes run over one block's collection, which Spark's shuffle files deliver and
which is small since texts are cut by anchors; whole documents, a hundred thousand
columns deep, would take as many passes over everything. The segments of a name that
occurs very often and always in other surroundings are cut down to single windows with
names of their own, so that no block holds a hot group.

Defined results: NULL and empty texts have no bytes. Repeated rows repeat all of their
windows. A text that loses everything keeps the empty string's hash. An empty table
gives no rows. Other columns never meet the operator's own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import buckets as B
from tidemark.llm import tokens as T

WIDTH, ANCHOR = 200, 80
#: 1 + log2 of the occurrences from which a name's segments are cut into windows.
HOT = 13
#: Bytes of the strings of one collection; the strings of one name stay together.
COLLECTION_BYTES = 1 << 20
_PIECE, _PLACE = 1 << 20, np.uint64(22)
_MARK = np.uint64((1 << 64) // 16)
_SEGMENT = np.dtype([("name", "<u8"), ("length", "<i4")])
_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
_SEED = np.uint64(0xE7037ED1A0B428DB)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    n = len(values) - width + 1
    rows = np.full((-(-len(values) // width), width), np.iinfo(np.uint64).max, np.uint64)
    rows.reshape(-1)[: len(values)] = values
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Anchors:
    """Runs of windows with one anchor (first and last start, the anchor's place), and all strings to ask about.

    Those are the anchors and every string whose name is below a fixed mark, which an
    equal string elsewhere is, too: where one of these is unique, so is all that holds it.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, width: int, size: int):
        room, low = np.flatnonzero(np.diff(bounds) >= width), 0
        found = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)]
        while low < len(room):
            # Texts of about a piece together; a longer text in overlapping stretches.
            start, stop = bounds[room[low]], bounds[room[low] + 1]
            if stop - start > _PIECE:
                for a in range(start, stop - width + 1, _PIECE):
                    b = min(a + _PIECE, stop - width + 1)
                    found.append(_runs(data, a, b + width - 1, np.array([[a, b]]), width, size))
                low += 1
                continue
            high = low + int(np.searchsorted(bounds[room[low:] + 1], start + _PIECE, "right"))
            spans = np.stack([bounds[room[low:high]], bounds[room[low:high] + 1] - width + 1], 1)
            found.append(_runs(data, start, bounds[room[high - 1] + 1], spans, width, size))
            low = high
        self.first, self.last, self.place, asked, names = (np.concatenate(x) for x in zip(*found))
        #: Places of the strings to ask about, their names, the distinct keys, how many strings have each, each string's key.
        self.asked, one = np.unique(asked, return_index=True)
        self.names = names[one]
        # Anchors have small names; mixed once more they spread evenly over the blocks.
        self.keys, self.at, self.counts = np.unique(B.key48(T.mix(self.names)), return_inverse=True, return_counts=True)


def _runs(data, start, stop, spans, width, size):
    sums = T.prefix_sums(T._BYTE[data[start:stop]])
    at = np.arange(stop - start - size + 1)
    names = T.spans(sums, at, at + size)
    least = _sliding_least((names >> _PLACE << _PLACE) | at.astype(np.uint64), width - size + 1)
    lengths = spans[:, 1] - spans[:, 0]
    windows = T.ragged(spans[:, 0] - start, lengths)
    place = (least[windows] & np.uint64((1 << 22) - 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)))
    last = np.append(first[1:], len(windows)) - 1
    strings = T.ragged(spans[:, 0] - start, lengths + width - size)
    asked = np.append(strings[names[strings] < _MARK], place[first])
    return windows[first] + start, windows[last] + start, place[first] + start, asked + start, names[asked]


class Segments:
    """What of a bucket's texts may be repeated, in pieces, equal pieces together."""

    def __init__(self, data: np.ndarray, found: Anchors, said: np.ndarray, width: int, size: int):
        code = said[found.at]
        lone = found.asked[(code == 0) & (found.names < _MARK)]
        own = np.searchsorted(found.asked, found.place)
        first, last, place, names, code = found.first, found.last, found.place, found.names[own], code[own]
        common = code > 0
        first, last, place, names, code = first[common], last[common], place[common], names[common], code[common]
        left = np.append(np.int64(-1), lone)[np.searchsorted(lone, place)]
        right = np.append(lone, np.int64(len(data) + width))[np.searchsorted(lone, place)]
        first, last = np.maximum(first, left + 1), np.minimum(last, right - (width - size) - 1)
        open_ = first <= last
        first, last, names, hot = first[open_], last[open_], names[open_], code[open_] >= HOT
        windows = T.ragged(first[hot], last[hot] - first[hot] + 1)
        self.first = np.concatenate([first[~hot], windows])
        self.count = np.concatenate([last[~hot] - first[~hot] + 1, np.ones(len(windows), np.int64)])
        stop = self.first + self.count + width - 1
        a, b = _prints(data, self.first, stop)
        name = T.mix(np.concatenate([names[~hot], a[len(a) - len(windows) :]]))
        order = np.lexsort((b, a, name))
        new = np.append(True, (name[order][1:] != name[order][:-1]) | (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
        new = new[: len(order)]
        #: Of each kind of segment one, in name order; and each segment's kind.
        self.one = order[new]
        self.kind = np.empty(len(order), np.int64)
        self.kind[order] = np.cumsum(new) - 1
        self.times = np.bincount(self.kind, minlength=len(self.one))
        self.name, self.data, self.width = name[self.one], data, width

    def asked(self, bucket: int, n_blocks: int, aside: bytes) -> pa.Table:
        cuts = np.append(np.searchsorted(B.key48(self.name), B._cuts(n_blocks)), len(self.one))
        rows = []
        for i in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            own = self.one[cuts[i] : cuts[i + 1]]
            head = np.zeros(len(own), _SEGMENT)
            head["name"], head["length"] = self.name[cuts[i] : cuts[i + 1]], self.count[own] + self.width - 1
            rows.append((i, self.data[T.ragged(self.first[own], head["length"].astype(np.int64))].tobytes(), head.tobytes()))
        rows.append((n_blocks + bucket, aside, None))
        return pa.table({
            "block": pa.array([r[0] for r in rows], pa.int32()), "bucket": pa.array([bucket] * len(rows), pa.int32()),
            "keys": pa.array([r[1] for r in rows], pa.binary()), "more": pa.array([r[2] for r in rows], pa.binary()),
        })

    def repeated(self, said: np.ndarray) -> np.ndarray:
        """The starts of all repeated windows, from one answer per window of each kind."""
        size = self.count[self.one]
        begin = np.cumsum(size) - size
        said = said.astype(bool) | np.repeat(self.times > 1, size)
        windows = T.ragged(self.first, self.count)
        return windows[said[T.ragged(begin[self.kind], self.count)]]


def _prints(data, starts, stops):
    """Two fingerprints of every stretch, from sums over pieces of the bytes' places."""
    a, b = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
    order = np.argsort(starts, kind="stable")
    low = 0
    while low < len(order):
        base = starts[order[low]]
        high = low + int(np.searchsorted(starts[order[low:]], base + _PIECE, "right"))
        own = order[low:high]
        piece = data[base : stops[own].max()]
        x, y = starts[own] - base, stops[own] - base
        a[own] = T.spans(T.prefix_sums(T._BYTE[piece]), x, y)
        b[own] = T.spans(T.prefix_sums(T.mix(T._BYTE ^ _SEED)[piece]), x, y)
        low = high
    return a, b


def collection(strings: list[bytes], depth: int) -> list[np.ndarray]:
    """For every place of every string: does its suffix share ``depth`` bytes with another of the collection?

    Rows are the suffixes in order, empty ones first: ``common`` is the prefix shared with the
    row above, at most ``depth``, and ``at`` where the suffix starts. The Burrows-Wheeler
    transform is held by symbol: ``order`` has the rows, those with equal symbols before them
    together, and ``count`` how many each symbol has (0 stands before a whole string). A round
    puts the symbol before every suffix of the last round in front of it; the place in
    ``order`` is the longer suffix's rank. The bytes are UTF-8, which has no byte 255, so
    symbols and the end fit in 8 bits.
    """
    m = len(strings)
    length = np.array([len(s) for s in strings])
    stop = np.cumsum(length)
    begin = stop - length
    text = np.frombuffer(b"".join(strings), np.uint8) + np.uint8(1)
    whole = np.zeros(len(text) + 1, bool)
    whole[begin] = True
    at, common = stop.astype(np.int32), np.zeros(m, np.uint8)
    symbol = text[at - 1]
    order = np.argsort(symbol, kind="stable").astype(np.int32)
    count = np.bincount(symbol, minlength=257)
    fresh = np.arange(m)
    for _ in range(int(length.max())):
        first = np.cumsum(count) - count
        done = int(count[0])
        rank = fresh[fresh >= done]
        if not len(rank):
            break
        below = rank + 1
        touched = np.union1d(rank, below[below < len(order)])
        paired = touched[touched != first[np.searchsorted(first + count, touched, "right")]]
        low, high = order[paired - 1].astype(np.int64) + 1, order[paired].astype(np.int64) + 1
        shared = np.zeros(len(touched), np.uint8)
        if len(paired):
            # From the last range to the first, so that what lies between two is never looked at.
            down = np.argsort(-low, kind="stable")
            both = np.stack([low[down], high[down]], 1).reshape(-1)
            least = np.minimum.reduceat(np.append(common, np.uint8(0)), both)[::2]
            shared[np.searchsorted(touched, paired[down])] = np.minimum(least, depth - 1) + 1
        # Rows of this round: the empty suffixes, then one for every symbol that was there.
        place, total = m + rank - done, m + len(order) - done
        came = at[order[rank]] - 1
        symbol = np.where(whole[came], 0, text[came - 1])
        old = np.ones(total, bool)
        old[place] = False
        at, common = _merged(at, came, old, place), _merged(common, 0, old, place)
        common[m + touched - done] = shared
        # The transform takes the new rows' symbols in, each among its own kind.
        order = np.flatnonzero(old).astype(np.int32)[order]
        by_symbol = np.argsort(symbol, kind="stable")
        kinds, starts = np.unique(symbol[by_symbol], return_index=True)
        into = np.empty(len(place), np.int64)
        for kind, x, y in zip(kinds.tolist(), starts, np.append(starts[1:], len(place))):
            own = order[first[kind] : first[kind] + count[kind]]
            into[x:y] = first[kind] + np.searchsorted(own, place[by_symbol[x:y]])
        fresh = into + np.arange(len(into))
        keep = np.ones(total, bool)
        keep[fresh] = False
        order = _merged(order, place[by_symbol], keep, fresh)
        count = count + np.bincount(symbol, minlength=257)
    deep = common >= depth
    deep[:-1] |= common[1:] >= depth
    # An empty suffix shares nothing; its place is the next string's start.
    out = np.zeros(len(text) + 1, bool)
    out[at[m:][deep[m:]]] = True
    return [out[a:b] for a, b in zip(begin, stop)]


def _merged(rows: np.ndarray, new, old: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The rows with new ones at their places."""
    out = np.empty(len(old), rows.dtype)
    out[old], out[place] = rows, new
    return out


def _ordered(asks: DataFrame, n_blocks: int, width: int) -> DataFrame:
    """One byte per window of every segment asked about: is it anywhere else?"""

    def order(table: pa.Table) -> pa.Table:
        if table["block"][0].as_py() >= n_blocks:
            return table.select(["bucket", "block", "keys"]).rename_columns(["bucket", "block", "answer"])
        table = table.sort_by("bucket")
        kinds: dict[tuple[int, bytes], int] = {}
        asked, times, names = [], [], {}
        for blob, head in zip(table["keys"], table["more"]):
            blob, head, at, own = blob.as_py(), np.frombuffer(head.as_py(), _SEGMENT), 0, []
            for name, size in head.tolist():
                key = (name, blob[at : at + size])
                kind = kinds.setdefault(key, len(kinds))
                if kind == len(times):
                    times.append(0)
                    names[name] = names.get(name, 0) + 1
                times[kind] += 1
                own.append(kind)
                at += size
            asked.append(own)
        found = [np.full(len(string) - width + 1, times[kind] > 1) for (_, string), kind in kinds.items()]
        several = sorted((name, kind, string) for (name, string), kind in kinds.items() if names[name] > 1)
        low = size = 0
        for k, (name, _, string) in enumerate(several):
            size += len(string)
            if k + 1 == len(several) or size >= COLLECTION_BYTES and several[k + 1][0] != name:
                for (_, kind, own), deep in zip(several[low : k + 1], collection([x[2] for x in several[low : k + 1]], width)):
                    found[kind] |= deep[: len(own) - width + 1]
                low, size = k + 1, 0
        return pa.table({
            "bucket": table["bucket"], "block": table["block"],
            "answer": pa.array([np.concatenate([found[k] for k in own]).astype(np.uint8).tobytes() for own in asked], pa.binary()),
        })

    return asks.groupBy("block").applyInArrow(order, B.ANSWER)


def without_repeated_bytes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, anchor: int = ANCHOR, texts: bool = True) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, ``kept``: the bytes left."""
    if not 0 < anchor <= width <= 255:
        raise ValueError("anchor must be no longer than width, and width at most 255")
    total = B.volume(docs, text)
    dealt = B.by_hash(docs, doc_id=doc_id, text=text, total=total)
    n_blocks = B.blocks_for(total)

    def ask(table: pa.Table) -> pa.Table:
        found = Anchors(*T.text_bytes(table["text"]), width, anchor)
        return B.asked(table["bucket"][0].as_py(), found.keys, B.told(found.counts), n_blocks)

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        data, bounds = T.text_bytes(table["text"])
        found = Anchors(data, bounds, width, anchor)
        said = B.answered(answers, len(found.keys))
        return Segments(data, found, said, width, anchor).asked(table["bucket"][0].as_py(), n_blocks, said.tobytes())

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        data, bounds = T.text_bytes(table["text"])
        answers, aside = B.set_aside(answers, n_blocks)
        own = Segments(data, Anchors(data, bounds, width, anchor), np.frombuffer(aside, np.uint8), width, anchor)
        starts = own.repeated(B.answered(answers, int(own.count[own.one].sum())))
        edge = np.zeros(len(data) + 1, np.int32)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + width, -1)
        gone = np.cumsum(edge)[:-1] > 0
        opens = gone & ~np.append(False, gone[:-1])
        inner = bounds[:-1][np.diff(bounds) > 0]
        opens[inner] = gone[inner]
        lost, spans = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(opens))
        left = data[~gone]
        stop = bounds - lost[bounds]
        kept = [left[a:b].tobytes() for a, b in zip(stop[:-1], stop[1:])]
        return pa.table({
            "doc_id": table["doc_id"], "n_bytes": pa.array(np.diff(bounds), pa.int64()),
            "n_removed": pa.array(np.diff(lost[bounds]), pa.int64()), "n_spans": pa.array(np.diff(spans[bounds]), pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
            "kept": pa.array(kept if texts else [None] * len(kept), pa.binary()),
        })

    answers = B.commonness(dealt.groupBy("bucket").applyInArrow(ask, B.ASK), n_blocks)
    sent = dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(send, B.ASK)
    found = _ordered(sent, n_blocks, width)
    return dealt.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(finish, _RESULT)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False).drop("kept")


ORACLE = """
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), b AS (
  SELECT doc_id, unnest(range(1, n + 1)) AS p, h, n FROM t
), win AS (
  SELECT doc_id, p, substr(h, 2 * p - 1, 2) AS byte, CASE WHEN p + 199 <= n THEN md5(substr(h, 2 * p - 1, 400)) END AS k FROM b
), starts AS (
  SELECT doc_id, p, byte, k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 AS again FROM win
), marked AS (
  SELECT doc_id, p, byte, coalesce(max(CASE WHEN again THEN p END) OVER (PARTITION BY doc_id ORDER BY p) > p - 200, false) AS gone FROM starts
), runs AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM marked
), per_doc AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
    string_agg(byte, '' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM runs GROUP BY doc_id
)
SELECT t.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM t LEFT JOIN per_doc USING (doc_id)
"""
