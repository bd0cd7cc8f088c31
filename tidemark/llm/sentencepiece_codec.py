"""SentencePiece encoding and decoding by suffix-array matching.

A task takes its texts a few megabytes at a time, splits them where no piece can reach
across (before a run of blanks) and joins the distinct units that it has not met before
into one batch text. Its suffix array, as deep as the longest piece, is searched for the
occurrence range of every piece at once; the occurrences are edges between places of the
batch text. Sorted by the place they end at, they are relaxed: an edge gives its end the
piece if piece and the one before its start *go together*, that is, if byte-pair merging
of the two alone would leave them as they are. Exactly one edge into each place does, and
the pieces so found from a unit's start to its end are what merging by score yields.

A vocabulary is a bounded list, read once by the driver from ``model`` (a parameter) and
sent with the function. Texts stay in their partitions: nothing is shuffled.

Defined results: NULL and empty texts have no ids and decode to the empty text. A
character without a piece becomes its bytes' pieces (or the unknown id). The blank mark
U+2581 in a text decodes as a blank, as in every SentencePiece model. Repeated rows are
each encoded. An empty table gives no rows. Columns that pass through keep their names;
the operator's own (``ids``) replaces one of that name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import tokens as T
from tidemark.llm.native import quoted

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_SLICE = 2 << 20
_MARK = "▁"
_NEVER = np.int64(1 << 40)
_CACHE = 1 << 20
#: Characters of one batch text, and of the units that a task remembers before it begins anew (each counted with
#: what it takes besides): bounds of memory.
_BATCH, _REMEMBERED, _UNIT = 100_000, 20_000_000, 100


class Vocabulary:
    """A byte-pair SentencePiece model's pieces, their merge order, and which may stand side by side."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=model)
        size = own.get_piece_size()
        self.pieces = [own.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i) or own.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.unknown = own.unk_id()
        self.bytes = np.array([own.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.has_bytes = all(own.is_byte(int(i)) for i in self.bytes)
        if any(re.search(f"[^{_MARK}]{_MARK}", p) for p in self.ids):
            raise ValueError("a piece reaches over the start of a word")
        missing = {c for p in self.ids for c in p} - set(self.ids)
        if missing:
            raise ValueError(f"characters of pieces without a piece of their own: {sorted(missing)[:5]}")
        self.rank = np.full(size, -1, np.int64)
        scores = {i: own.get_score(i) for p, i in self.ids.items() if len(p) > 1}
        order = {s: n for n, s in enumerate(sorted(set(scores.values()), reverse=True))}
        for i, s in scores.items():
            self.rank[i] = order[s]
        pairs = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * size + b] = i
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([self.rank[pairs[k]] for k in self.pair_keys.tolist()], np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.whole, self.odd = np.zeros(size, bool), np.zeros(size, bool)
        shared: dict[float, int] = {}
        for s in scores.values():
            shared[s] = shared.get(s, 0) + 1
        for p, i in self.ids.items():
            if len(p) == 1:
                self.whole[i] = True
                continue
            parts, last = self.merged(p)
            self.whole[i] = parts == [i]
            if self.whole[i]:
                self.left[i], self.right[i] = last
                # Where pieces are not older than what they are made of, or tie, order in time is not order by rank.
                self.odd[i] = max(self.rank[last[0]], self.rank[last[1]]) >= self.rank[i] or shared[scores[i]] > 1
        # A piece made of an odd one is odd, too.
        for i in sorted(self.ids.values(), key=lambda i: len(self.pieces[i])):
            if self.left[i] >= 0:
                self.odd[i] |= self.odd[self.left[i]] or self.odd[self.right[i]]
        self.size = size
        surface = [p.replace(_MARK, " ").encode() for p in self.pieces]
        for i in range(size):
            if own.is_control(i):
                surface[i] = b""
            elif own.is_unknown(i):
                surface[i] = " ⁇ ".encode()
            elif own.is_byte(i):
                surface[i] = bytes([int(self.pieces[i][3:5], 16)])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_length = np.array([len(s) for s in surface])
        self.surface_start = np.cumsum(self.surface_length) - self.surface_length
        listed = sorted((i for i in self.ids.values() if self.whole[i]), key=lambda i: self.pieces[i])
        self.listed = np.array(listed)
        self.listed_length = np.array([len(self.pieces[i]) for i in listed])
        self.depth = int(self.listed_length.max())
        self.points = np.zeros((len(listed), self.depth), np.uint32)
        for row, i in enumerate(listed):
            self.points[row, : len(self.pieces[i])] = [ord(c) for c in self.pieces[i]]

    def merged(self, text: str) -> tuple[list[int], tuple[int, int]]:
        """What merging by score, leftmost first, makes of a text of known characters; and the last merge."""
        parts, last = [self.ids[c] for c in text], (-1, -1)
        while len(parts) > 1:
            best, at = _NEVER, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(self.pieces[parts[k]] + self.pieces[parts[k + 1]])
                if i is not None and self.rank[i] < best:
                    best, at = self.rank[i], k
            if at < 0:
                break
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [self.ids[self.pieces[last[0]] + self.pieces[last[1]]]]
        return parts, last

    def together(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Would merging leave each pair as it is?

        Undone step by step from the end, the latest made first, the two parts at the seam
        must never have been a pair that merges before either is taken up by its own piece.
        """
        out = np.ones(len(x), bool)
        strange = np.flatnonzero(self.odd[x] | self.odd[y])
        for k in strange.tolist():
            out[k] = self.merged(self.pieces[x[k]] + self.pieces[y[k]])[0] == [x[k], y[k]]
        open_ = np.flatnonzero(~(self.odd[x] | self.odd[y]))
        x, y = x[open_].copy(), y[open_].copy()
        above_x, above_y = np.full(len(x), _NEVER), np.full(len(x), _NEVER)
        while len(open_):
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_rank[at], _NEVER)
            cross = (rank < above_x) & (rank <= above_y)
            cross &= rank < _NEVER
            out[open_[cross]] = False
            more = ~cross & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            open_, x, y, above_x, above_y = open_[more], x[more], y[more], above_x[more], above_y[more]
            undo = self.rank[x] > self.rank[y]
            above_x, above_y = np.where(undo, self.rank[x], above_x), np.where(undo, above_y, self.rank[y])
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return out


class Encoder:
    """Encodes units, remembering units and pairs of pieces that it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pair_key, self.pair_ok = np.full(_CACHE, -1, np.int64), np.zeros(_CACHE, bool)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.held = 0
        self.flat, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _together(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x * self.v.size + y
        slot = (T.mix(key.astype(np.uint64)) & np.uint64(_CACHE - 1)).astype(np.int64)
        ok = self.pair_ok[slot]
        miss = np.flatnonzero(self.pair_key[slot] != key)
        if len(miss):
            fresh, back = np.unique(key[miss], return_inverse=True)
            said = self.v.together(fresh // self.v.size, fresh % self.v.size)
            ok[miss] = said[back]
            self.pair_key[slot[miss]], self.pair_ok[slot[miss]] = key[miss], ok[miss]
        return ok

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece occurs in the text: places and rows of ``listed``, from the text's suffix array."""
        v = self.v
        letters, code = np.unique(text, return_inverse=True)
        code = code + 1
        bits = int(len(letters)).bit_length()
        m = min(v.depth, 62 // bits)
        # The suffixes' first m letters as one number; then, with the rank of the suffix m further on, twice as many.
        key = np.zeros(len(text), np.int64)
        padded = np.append(code, np.zeros(m, np.int64))
        for k in range(m):
            key = key << bits | padded[k : k + len(text)]
        distinct, rank = np.unique(key, return_inverse=True)
        parts, reach = [(distinct, None)], m
        while reach < v.depth:
            further = np.append(rank[reach:] + 1, np.zeros(min(reach, len(text)), np.int64))
            wide = len(distinct) + 2
            key = rank * wide + further
            before = distinct
            distinct, rank = np.unique(key, return_inverse=True)
            parts.append((distinct, (before, wide)))
            reach *= 2
        array = np.argsort(rank, kind="stable")
        ordered = rank[array]
        known = np.searchsorted(letters, v.points)
        known = np.where((known < len(letters)) & (letters[np.minimum(known, len(letters) - 1)] == v.points), known + 1, 0)
        inside = np.arange(v.depth)[None, :] < v.listed_length[:, None]
        rows = np.flatnonzero(((known > 0) | ~inside).all(axis=1))
        known, length = known[rows], v.listed_length[rows]

        def numbers(first: int, level: int) -> tuple[np.ndarray, np.ndarray]:
            """Ranks at a level that agree with the piece from its letter ``first`` on, as far as both go."""
            if level == 0:
                low, high = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
                top = (1 << bits) - 1
                for k in range(first, first + m):
                    letter = known[:, k] if k < v.depth else np.zeros(len(rows), np.int64)
                    has = k < length
                    low = low << bits | np.where(has, letter, 0)
                    high = high << bits | np.where(has, letter, top)
                return np.searchsorted(parts[0][0], low), np.searchsorted(parts[0][0], high, "right")
            span = m << (level - 1)
            a, b = numbers(first, level - 1)
            c, d = numbers(first + span, level - 1)
            wide = parts[level][1][1]
            longer = length > first + span
            # A longer piece has one rank for its first half, a range for the second; a shorter one a range of first halves.
            low = np.where(longer, a * wide + c + 1, a * wide)
            high = np.where(longer, np.where(b > a, a * wide + d + 1, low), b * wide)
            return np.searchsorted(parts[level][0], low), np.searchsorted(parts[level][0], np.maximum(high, low))

        low, high = numbers(0, len(parts) - 1)
        # It refers to itself; left so, it and all arrays it sees would stay until the next garbage collection.
        numbers = None
        low, high = np.searchsorted(ordered, low), np.searchsorted(ordered, high)
        count = np.maximum(high - low, 0)
        return array[T.ragged(low, count)], np.repeat(rows, count)

    def learn(self, units: list[str]) -> None:
        """Encodes units not met before and appends their ids."""
        v = self.v
        size = np.array([len(u) for u in units], np.int64)
        stop = np.cumsum(size)
        begin = stop - size
        text = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        unit = np.repeat(np.arange(len(units)), size)
        place, row = self.edges(text)
        piece, length = v.listed[row], v.listed_length[row]
        end = place + length
        fits = end <= stop[unit[place]]
        place, piece, end = place[fits], piece[fits], end[fits]
        # Characters without a piece go over on an edge of their own, which goes together with everything.
        alone = np.ones(len(text), bool)
        alone[place[end == place + 1]] = False
        strange = np.flatnonzero(alone)
        place, piece, end = (np.concatenate(x) for x in ((place, strange), (piece, np.full(len(strange), -2)), (end, strange + 1)))
        far = end - begin[unit[place]]
        order = np.argsort(far, kind="stable")
        place, piece, far = place[order], piece[order], far[order]
        owner = unit[place]
        source, target = place + owner, begin[owner] + far + owner
        last = np.full(len(text) + len(units), -1, np.int64)
        last[begin + np.arange(len(units))] = -3
        cuts = np.flatnonzero(np.append(True, far[1:] != far[:-1])) if len(far) else np.zeros(0, np.int64)
        for a, b in zip(cuts, np.append(cuts[1:], len(far))):
            before, now = last[source[a:b]], piece[a:b]
            good = (before < -1) | (now < 0)
            ask = np.flatnonzero(~good & (before >= 0))
            good[ask] = self._together(before[ask], now[ask])
            last[target[a:b][good]] = now[good]
        self._append(units, text, begin, stop, last)

    def _append(self, units, text, begin, stop, last) -> None:
        v = self.v
        at = stop + np.arange(len(units))
        first = begin + np.arange(len(units))
        lengths = np.append(np.array([len(p) for p in v.pieces]), [0, 1, 0])  # -1: unreachable, -2: one character
        taken_unit, taken_piece, taken_at = [], [], []
        open_ = np.flatnonzero(at > first)
        while len(open_):
            piece = last[at[open_]]
            if (piece == -1).any():
                raise ValueError("a unit has no encoding")
            taken_unit.append(open_)
            taken_piece.append(piece)
            at[open_] -= np.where(piece == -2, 1, lengths[piece])
            taken_at.append(at[open_] - open_)
            open_ = open_[at[open_] > first[open_]]
        none = np.zeros(0, np.int64)
        owner, piece, place = (np.concatenate(x) if x else none for x in (taken_unit, taken_piece, taken_at))
        order = np.lexsort((place, owner))
        owner, piece, place = owner[order], piece[order], place[order]
        strange = np.flatnonzero(piece == -2)
        if len(strange):
            raw = [chr(c).encode("utf-8", "surrogatepass") if v.has_bytes else b"" for c in text[place[strange]].tolist()]
            repeat = np.ones(len(piece), np.int64)
            repeat[strange] = [max(1, len(r)) for r in raw]
            into = np.cumsum(repeat) - repeat
            owner, piece = np.repeat(owner, repeat), np.repeat(piece, repeat)
            for k, r in zip(into[strange].tolist(), raw):
                piece[k : k + max(1, len(r))] = v.bytes[list(r)] if r else v.unknown
        count = np.bincount(owner, minlength=len(units))
        self.start = np.append(self.start, len(self.flat) + np.cumsum(count) - count)
        self.length = np.append(self.length, count)
        self.flat = np.append(self.flat, piece.astype(np.int32))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and the bounds of each text's."""
        if self.held > _REMEMBERED:
            self.forget()
        seen, count, fresh, numbers = self.number, [], [], []
        for text in texts:
            if not text:
                count.append(0)
                continue
            if _MARK in text:
                text = text.replace(_MARK, " ")
            # Each unit without its first blank: that of the text's start is the model's own.
            own = text.split(" ") if "  " not in text and text[-1] != " " and text[0] != " " else [u[1:] for u in re.findall(r" +[^ ]*", " " + text)]
            for u in own:
                if u not in seen:
                    seen[u] = len(seen)
                    fresh.append(_MARK + u.replace(" ", _MARK))
            numbers.append(np.fromiter(map(seen.__getitem__, own), np.int64, len(own)))
            count.append(len(own))
        # A few at a time: the edges of one batch text take some hundred times its size.
        letters = np.cumsum([len(u) for u in fresh]) if fresh else np.zeros(0, np.int64)
        self.held += int(letters[-1]) + _UNIT * len(fresh) if fresh else 0
        size = letters // _BATCH
        cuts = np.flatnonzero(np.diff(size)) + 1
        for a, b in zip(np.append(0, cuts), np.append(cuts, len(fresh))):
            if b > a:
                self.learn(fresh[a:b])
        unit = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        length = self.length[unit]
        total = np.append(0, np.cumsum(length))
        return self.flat[T.ragged(self.start[unit], length)], total[np.append(0, np.cumsum(count))]


def decode(v: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts that the ids stand for, end to end, and their bounds."""
    length = v.surface_length[ids]
    data = v.surface[T.ragged(v.surface_start[ids], length)]
    stop = np.append(0, np.cumsum(length))[bounds]
    # The blank that the model puts before every text goes.
    some = np.flatnonzero(np.diff(stop) > 0)
    lead = some[data[stop[some]] == 32]
    stay = np.ones(len(data), bool)
    stay[stop[lead]] = False
    return data[stay], stop - np.append(0, np.cumsum(~stay))[stop]


def _numbered(rows: DataFrame, names: list[str]) -> DataFrame:
    """The columns under plain names: a function's input takes none with dots."""
    return rows.select(*[rows[quoted(c)].alias(f"c{i}") for i, c in enumerate(names)])


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    for row, _, bounds in T.chunks(texts, _SLICE):
        yield row, texts.slice(row, len(bounds) - 1).to_pylist()


def encoded(docs: DataFrame, *, text: str = "text", ids: str = "ids", model: str = MODEL, keep_text: bool = True) -> DataFrame:
    """All columns (without ``keep_text`` all but the text), with ``ids`` (array of int) instead of or beside one of that name."""
    v = Vocabulary(model)
    names = [c for c in docs.columns if c not in (ids, text)] + [text]
    rest = names if keep_text else names[:-1]
    position = len(names) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(v)
        for batch in batches:
            for row, texts in _slices(batch.column(position)):
                flat, bounds = encoder.encode(texts)
                own = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(row, len(texts)) for i in range(len(rest))] + [own], names=[*rest, ids])

    types = dict(docs.dtypes)
    kinds = ", ".join(f"{quoted(c)} {types[c]}" for c in rest)
    return _numbered(docs, names).mapInArrow(run, f"{kinds}, {quoted(ids)} array<int>")


def decoded(rows: DataFrame, *, ids: str = "ids", text: str = "decoded", model: str = MODEL) -> DataFrame:
    """All columns, with ``text``: what the ids stand for. Bytes that are no UTF-8 become U+FFFD."""
    v = Vocabulary(model)
    names = [c for c in rows.columns if c != text]
    position = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(position).fill_null([])
            data, stop = decode(v, own.flatten().to_numpy().astype(np.int64), np.append(0, np.cumsum(np.diff(own.offsets.to_numpy()))))
            back = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(stop[:-1], stop[1:])]
            yield pa.RecordBatch.from_arrays(list(batch.columns) + [pa.array(back, pa.string())], names=names + [text])

    kinds = ", ".join(f"{quoted(c)} {t}" for c, t in rows.dtypes if c != text)
    return _numbered(rows, names).mapInArrow(run, f"{kinds}, {quoted(text)} string")


def round_trip(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """Per row: doc_id, n_tokens, ids, decoded_sha256 and same (the decoded text is the text, blank marks as blanks)."""
    v = Vocabulary(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(v)
        for batch in batches:
            for row, texts in _slices(batch.column(1)):
                flat, bounds = encoder.encode(texts)
                data, stop = decode(v, flat, bounds)
                back = [data[a:b].tobytes() for a, b in zip(stop[:-1], stop[1:])]
                same = [b == (t or "").replace(_MARK, " ").encode() for b, t in zip(back, texts)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, len(texts)), pa.array(np.diff(bounds), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32())),
                    pa.array([hashlib.sha256(b).hexdigest() for b in back]), pa.array(same),
                ], names=["doc_id", "n_tokens", "ids", "decoded_sha256", "same"])

    rows = docs.select(docs[quoted(doc_id)].alias("doc_id"), docs[quoted(text)].alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids array<int>, decoded_sha256 string, same boolean")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
