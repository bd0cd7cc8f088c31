"""Substring dedup by recompression: runs of words that also start earlier go.

Each round of recompression names maximal runs of one symbol and then pairs of
neighbours (a symbol's own hash puts it on the left or the right side, so pairs never
overlap). Names are functions of what they stand for, so they agree over all
documents with no dictionary; and a symbol carries the stretch of words that its name
and its place depend on. A window of words *holds* a symbol if it holds that stretch,
and then every equal window, wherever it is, holds the same symbol at the same place.
Of the symbols that a window holds on the highest level it takes the one of the
smallest name as its anchor (a window too uniform for that goes down a level, in the
end to its words).

(1) Buckets of documents, in id order, ask how often the names of their anchors occur
over all documents. A window whose anchor's name is unique is unique. (2) The other
windows are verified: 112-bit fingerprints of all their words, one per bucket, are
looked up in the buckets before it, and within the bucket by place. (3) Each text meets
its bucket's answers and loses the words covered.

Defined results: NULL and empty texts have no words. Windows never cross documents.
Rows of one id count as one after the other, shorter (then smaller) text first; NULL
ids come first of all. Repeated rows come back as often. A text that loses all words
keeps the empty string's hash. An empty table gives no rows. Other columns never meet
the operator's own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import buckets as B
from tidemark.llm import tokens as T

WIDTH, ROUNDS = 20, 2
_RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"
_SEED = np.uint64(0xA0761D6478BD642F)


class Level:
    """The symbols of one level: names, documents, and the stretch [low, high) of words each depends on."""

    def __init__(self, name, doc, low, high):
        self.name, self.doc, self.low, self.high = name, doc, low, high

    def __len__(self):
        return len(self.name)


def _neighbours(level: Level) -> tuple[np.ndarray, np.ndarray]:
    """Lowest word that the symbol before depends on, and highest of the one after; past the document's own at its ends."""
    same = level.doc[1:] == level.doc[:-1]
    before, after = level.low - 1, level.high + 1
    before[1:] = np.where(same, level.low[:-1], before[1:])
    after[:-1] = np.where(same, level.high[1:], after[:-1])
    return before, after


def name_runs(level: Level) -> Level:
    """Every maximal run of one symbol becomes a symbol. Where it ends depends on the neighbours."""
    new = np.append(True, (level.name[1:] != level.name[:-1]) | (level.doc[1:] != level.doc[:-1]))
    starts = np.flatnonzero(new)
    length = np.diff(np.append(starts, len(level)))
    last = starts + length - 1
    before, after = _neighbours(level)
    name = level.name[starts]
    long = length > 1
    name[long] = T.mix(name[long] ^ T.mix(length[long].astype(np.uint64) + _SEED))
    low = np.minimum(np.minimum.reduceat(level.low, starts), before[starts])
    high = np.maximum(np.maximum.reduceat(level.high, starts), after[last])
    return Level(name, level.doc[starts], low, high)


def name_pairs(level: Level, number: int) -> Level:
    """A left symbol with a right one after it becomes one symbol. A symbol left single depends on the neighbour that it might have met."""
    right = (T.mix(level.name ^ np.uint64(number * 0x2545F491 + 1)) & np.uint64(1)).astype(bool)
    opens = np.zeros(len(level), bool)
    opens[:-1] = ~right[:-1] & right[1:] & (level.doc[1:] == level.doc[:-1])
    closes = np.append(False, opens[:-1])
    before, after = _neighbours(level)
    single = ~opens & ~closes
    low, high, name = level.low.copy(), level.high.copy(), level.name.copy()
    low[single & right] = np.minimum(low, before)[single & right]
    high[single & ~right] = np.maximum(high, after)[single & ~right]
    at = np.flatnonzero(opens)
    low[at] = np.minimum(level.low[at], level.low[at + 1])
    high[at] = np.maximum(level.high[at], level.high[at + 1])
    name[at] = T.mix(T.mix(level.name[at]) * np.uint64(3) + level.name[at + 1])
    stay = ~closes
    return Level(name[stay], level.doc[stay], low[stay], high[stay])


def levels(names: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> list[Level]:
    """The words and what each round makes of them."""
    at = np.arange(len(names))
    out = [Level(names, np.searchsorted(first, at, "right") - 1, at, at + 1)]
    for number in range(rounds if len(names) else 0):
        out.append(name_pairs(name_runs(out[-1]), number))
    return out


def _smallest(value: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the first smallest of ``value[a:b]`` is, for ranges that are not empty."""
    best, out, width = np.arange(len(value)), np.empty(len(a), np.int64), 1
    while len(a):
        size = b - a
        now = (size >= width) & (size < 2 * width)
        x, y = best[a[now]], best[b[now] - width]
        out[now] = np.where(value[y] < value[x], y, x)
        if width * 2 > (size.max() if len(size) else 0):
            break
        far = best[np.minimum(np.arange(len(value)) + width, len(value) - 1)]
        best = np.where(value[far] < value[best], far, best)
        width *= 2
    return out


def anchors(parsed: list[Level], starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window the number of its anchor among all levels' symbols, and the names of those."""
    chosen = np.full(len(starts), -1, np.int64)
    offset = sum(len(level) for level in parsed)
    for level in reversed(parsed):
        offset -= len(level)
        open_ = np.flatnonzero(chosen < 0)
        a = np.searchsorted(level.low, starts[open_])
        b = np.searchsorted(level.high, starts[open_] + width, "right")
        some = b > a
        chosen[open_[some]] = offset + _smallest(T.mix(level.name), a[some], b[some])
    return chosen, np.concatenate([T.mix(level.name + np.uint64(i)) for i, level in enumerate(parsed)])


class Words:
    """The words of a bucket's texts, in id order."""

    def __init__(self, table: pa.Table):
        order = [("doc_id", "ascending"), ("size", "ascending"), ("text", "ascending")]
        table = table.append_column("size", pc.binary_length(table["text"].fill_null(""))).sort_by(order)
        nulls = table.filter(pc.is_null(table["doc_id"]))
        self.table = pa.concat_tables([nulls, table.filter(pc.is_valid(table["doc_id"]))])
        names, first, seen = [], [np.zeros(1, np.int64)], 0
        for _, data, bounds in T.chunks(self.table["text"]):
            starts, ends, own = T.words(data, bounds)
            names.append(T.word_names(data, starts, ends))
            first.append(own[1:] + seen)
            seen += len(starts)
        self.names = np.concatenate(names) if names else np.zeros(0, np.uint64)
        self.first = np.concatenate(first)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        return T.windows(self.names, self.first, width)


def _anchored(words: Words, width: int, rounds: int):
    starts, prints = words.windows(width)
    anchor, names = anchors(levels(words.names, words.first, rounds), starts, width)
    return starts, prints, anchor, names


def _keys(anchor: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of the anchors, how many anchors have each, and each window's key as an index."""
    used, window = np.unique(anchor, return_inverse=True)
    keys, at, counts = np.unique(B.key48(names[used]), return_inverse=True, return_counts=True)
    return keys, counts, at[window]


def _firsts(names: np.ndarray, prints: np.ndarray, starts: np.ndarray, width: int):
    """Of the windows given: distinct fingerprints (48 and 64 bits), the window that is first for each, and each window's print as an index."""
    checks = T.spans(T.prefix_sums(T.mix(names ^ _SEED)), starts, starts + width)
    short = B.key48(prints)
    order = np.lexsort((starts, checks, short))
    a, c = short[order], checks[order]
    new = np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])) if len(a) else np.zeros(0, bool)
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    return a[new], c[new], order[new], at


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` places some stretch covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge)[:n] > 0


def without_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, rounds: int = ROUNDS, texts: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and, if asked for, ``kept``: the words left, one space between."""
    total = B.volume(docs, text)
    dealt = B.by_range(docs, doc_id=doc_id, text=text, total=total)
    n_blocks = B.blocks_for(total)

    def ask(table: pa.Table) -> pa.Table:
        _, _, anchor, names = _anchored(Words(table), width, rounds)
        keys, counts, _ = _keys(anchor, names)
        return B.asked(table["bucket"][0].as_py(), keys, B.told(counts), n_blocks)

    def verify(table: pa.Table, answers: pa.Table) -> pa.Table:
        words = Words(table)
        starts, prints, anchor, names = _anchored(words, width, rounds)
        keys, _, at = _keys(anchor, names)
        shared = B.answered(answers, len(keys)) > 0
        open_ = shared[at] if len(at) else np.zeros(0, bool)
        short, checks, _, _ = _firsts(words.names, prints[open_], starts[open_], width)
        return B.asked(table["bucket"][0].as_py(), short, checks, n_blocks, np.packbits(shared).tobytes())

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        words = Words(table)
        starts, prints, anchor, names = _anchored(words, width, rounds)
        keys, _, at = _keys(anchor, names)
        answers, aside = B.set_aside(answers, n_blocks)
        shared = np.unpackbits(np.frombuffer(aside, np.uint8), count=len(keys)).astype(bool)
        open_ = shared[at] if len(at) else np.zeros(0, bool)
        starts = starts[open_]
        short, _, first, at = _firsts(words.names, prints[open_], starts, width)
        before = B.answered(answers, len(short)) > 0
        repeat = np.ones(len(starts), bool)
        repeat[first] = before
        gone = covered(starts[repeat], width, len(words.names))
        return _rest(words, gone, texts)

    answers = B.commonness(dealt.groupBy("bucket").applyInArrow(ask, B.ASK), n_blocks)
    open_ = dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(verify, B.ASK)
    before = B.earlier(open_, n_blocks)
    return dealt.groupBy("bucket").cogroup(before.groupBy("bucket")).applyInArrow(finish, _RESULT)


def _rest(words: Words, gone: np.ndarray, texts: bool) -> pa.Table:
    """The result rows: what is left of each text."""
    n, removed, shas, kept = np.diff(words.first), [], [], []
    for row, data, bounds in T.chunks(words.table["text"]):
        starts, ends, own = T.words(data, bounds)
        lost = gone[words.first[row] : words.first[row + len(bounds) - 1]]
        stay = np.flatnonzero(~lost)
        length = ends[stay] - starts[stay] + 1
        out = np.append(data, np.uint8(32))[T.ragged(starts[stay], length)]
        last = np.cumsum(length)
        out[last - 1] = 32
        cut = np.append(0, last)[np.searchsorted(stay, own)]
        removed.append(np.diff(own) - np.diff(np.searchsorted(stay, own)))
        for k in range(len(bounds) - 1):
            left = out[cut[k] : max(cut[k], cut[k + 1] - 1)].tobytes()
            shas.append(hashlib.sha256(left).hexdigest())
            kept.append(left if texts else None)
    return pa.table({
        "doc_id": words.table["doc_id"], "n_words": pa.array(n, pa.int64()),
        "n_removed": pa.array(np.concatenate(removed) if removed else [], pa.int64()),
        "kept_sha256": pa.array(shas, pa.string()), "kept": pa.array(kept, pa.binary()).cast(pa.string()),
    })


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False).drop("kept")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w)
), later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM later
), word AS (
  SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w
), left_over AS (
  SELECT word.doc_id, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY word.doc_id
)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_over USING (doc_id)
"""
