"""Words and rolling fingerprints of many texts at once, on NumPy arrays.

A chunk is the UTF-8 bytes of several texts, end to end, with ``bounds`` giving
where each text starts (one more entry than texts). Only the six ASCII blanks
``\\x20 \\x09-\\x0D`` part words, as the contracts of the operators ask.
Fingerprints are functions of the content alone, so every task, in every run,
gives equal strings equal names. NULL texts count as empty everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... (n of them), modulo 2^64; the longest asked for so far is kept."""
    if len(_POWERS.get(base, ())) < max(1, n):
        out = np.full(1 << max(10, (n - 1).bit_length()), base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary column and the bounds of its rows."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(texts: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Whole texts, about ``size`` bytes at a time: first row, bytes, bounds. A longer text is a chunk of its own."""
    data, bounds = text_bytes(texts)
    first, n = 0, len(bounds) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1)
        last = min(last, n)
        yield first, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; every other byte as it is."""
    return _LOWER[data]


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the index of its first word (one more entry than texts)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_BLANK[data]
    here, before = inside[1:-1], inside[:-2]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[bounds] = True
    starts = np.flatnonzero(here & (~before | fresh[:-1]))
    ends = np.flatnonzero(here & (~inside[2:] | fresh[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of ``values[i] * base^i`` before each position: the source of rolling fingerprints of windows.

    Only for spans of a fixed length well below 1024, or whose equality is compared afterwards: longer regular
    ones (Thue-Morse words) have equal sums with every base.
    """
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_BASE, len(values)), out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The fingerprint of each span, whatever its place."""
    shift = powers(_INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * shift[starts] + (ends - starts).astype(np.uint64) * _ODD)


def names_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit name of the bytes of every span; another seed gives names that are independent of these.

    Eight bytes at a time are mixed with their place in the span, and a span's parts summed. Unlike sums of
    ``value * base^i`` modulo 2^64, which agree for long regular strings whatever the base, no two
    strings have one name but by chance.
    """
    parts = (ends - starts + 7) >> 3
    at = np.append(0, np.cumsum(parts))
    place = np.arange(at[-1]) - np.repeat(at[:-1], parts)
    offset = np.repeat(starts, parts) + 8 * place
    eight = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, np.uint8)), 8)[offset].view("<u8")[:, 0]
    left = np.repeat(ends, parts) - offset
    short = left < 8
    eight[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
    value = np.append(np.uint64(0), np.cumsum(mix(eight ^ mix((place + (1 + (seed << 32))).astype(np.uint64) * _ODD))))
    return mix(value[at[1:]] - value[at[:-1]] + (ends - starts).astype(np.uint64) * _ODD)


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name of every word."""
    return names_of(data, starts, ends)


def windows(names: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and fingerprint of every run of ``width`` names within one text."""
    n = len(names)
    ok = np.zeros(max(0, n - width + 1), bool)
    if len(ok):
        ok[:] = True
        inner = first[(first > 0) & (first < n)]
        for back in range(1, width):
            cut = inner - back
            ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    starts = np.flatnonzero(ok)
    return starts, spans(prefix_sums(names), starts, starts + width)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices ``start .. start + length`` of every row, end to end."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    some = lengths > 0
    starts, lengths = starts[some], lengths[some]
    if not total:
        return out[:0]
    at = np.cumsum(lengths)[:-1]
    out[0] = starts[0]
    out[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)
