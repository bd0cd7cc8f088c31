"""Fingerprints beside a plain restatement, and their likeness beside true similarities."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import word
from tidemark.llm import fingerprints


def grams(text):
    w = brute.words((text or "").translate(brute.LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def plain_digits(text):
    """One text's values, bin by bin."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    hashes = fingerprints.shingles(data, np.array([0, len(data)]))[1].tolist()
    least = {}
    for h in hashes:
        least[h >> 56] = min(h, least.get(h >> 56, h))
    if not least:
        return None
    taken = [least.get(b) if b in least else next(least[int(o)] for o in fingerprints._ASKED[b] if int(o) in least) for b in range(256)]
    mixed = fingerprints.T.mix(np.array(taken, np.uint64) ^ fingerprints._OF_BIN).tolist()
    return "".join(f"{m & 15:x}" for m in mixed)


def in_order(rows):
    """Rows as they follow each other."""
    key = lambda r: (r[0] is not None, r[0] or 0, len((r[1] or "").encode()), zlib.crc32((r[1] or "").encode()), r[1] or "")
    return sorted([(r[0], r[1] or "") for r in rows], key=key)


def likeness(a, b):
    if a is None or b is None:
        return 1.0 if a == b else 0.0
    return max(0.0, (sum(x == y for x, y in zip(a, b)) / 256 - 1 / 16) / (15 / 16))


@pytest.mark.parametrize("size", [16 << 20, 3_000, 200])
def test_fingerprints(docs, rows, monkeypatch, size):
    """Over one range of ids and over many, some of which stay empty."""
    monkeypatch.setattr(fingerprints, "PART_BYTES", size)
    monkeypatch.setattr(fingerprints, "SLICE", 7)
    own = in_order(rows)
    want = Counter()
    for (i, t), (_, n) in zip(own, own[1:] + own[:1]):
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        a, b, c = plain_digits(t), plain_digits(edited), plain_digits(n)
        want[(i, len(t), brute.sha(edited), a or "", b or "", round(likeness(a, b), 9), round(likeness(a, c), 9))] += 1
    found = fingerprints.with_edits(docs).withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
    columns = "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"
    assert Counter((*(r[c] for c in columns), round(r.near_edited, 9), round(r.near_next, 9)) for r in found.collect()) == want


def test_likeness_estimates_jaccard(spark):
    rng = random.Random(4)
    pairs = []
    for i in range(400):
        a = [word(rng) + str(rng.randint(0, 99)) for _ in range(rng.choice([5, 6, 9, 30, 200, 1500]))]
        b = a[: rng.randint(0, len(a))] + [word(rng) for _ in range(rng.choice([0, 5, 30, 200]))]
        pairs.append((i, " ".join(a), " ".join(b)))
    frame = spark.createDataFrame(pairs, "i int, a string, b string")
    found = fingerprints.fingerprinted(fingerprints.fingerprinted(frame, text="a", name="fa"), text="b", name="fb")
    wrong = np.array([r.likeness - jaccard(r.a, r.b) for r in fingerprints.compared(found, "fa", "fb").collect()])
    assert abs(wrong.mean()) < 0.01 and np.sqrt((wrong**2).mean()) < 0.05 and np.abs(wrong).max() < 0.17


def test_few_shingles_do_not_match_by_chance():
    """Texts of one shingle each share no bin but by the chance that is corrected."""
    values = fingerprints.digits(pa.array([f"one{i} two three" for i in range(500)]))
    assert fingerprints.likeness(values[:-1], values[1:]).max() < 0.1


def test_densification_takes_from_filled_bins_only():
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 1 << 60, (50, 256)).astype(np.uint64)
    bins[rng.random((50, 256)) < rng.random((50, 1))] = fingerprints._NONE
    bins[0] = fingerprints._NONE
    out = fingerprints.densified(bins)
    assert (out[0] == fingerprints._NONE).all()
    for before, after in zip(bins[1:], out[1:]):
        filled = before != fingerprints._NONE
        assert (after[filled] == before[filled]).all()
        if filled.any():
            assert set(after.tolist()) <= set(before[filled].tolist())


def test_fingerprints_of_hardly_any_rows(spark, none):
    assert fingerprints.with_edits(none).count() == 0
    assert fingerprints.fingerprinted(none).count() == 0
    (one,) = fingerprints.with_edits(spark.createDataFrame([(None, "a b c d e f")], "doc_id bigint, text string")).collect()
    assert one.near_next == 1.0 and one.n_chars == 11
    (one,) = fingerprints.with_edits(spark.createDataFrame([(3, None)], "doc_id bigint, text string")).collect()
    assert one.near_next == 1.0 and one.fingerprint == b"" and one.edited_sha256 == brute.sha("")


def test_a_very_long_text(spark):
    long = " ".join(f"w{i % 90_000}" for i in range(400_000))
    rows = spark.createDataFrame([(1, long), (2, "x" * 3_000_000), (3, "é" * 1_000_000)], "doc_id bigint, text string")
    found = {r.doc_id: r for r in fingerprints.with_edits(rows).collect()}
    assert found[1].edited_sha256 == brute.sha(long[: len(long) - len(long) // 2] + "x" * (len(long) // 2))
    assert found[2].edited_sha256 == brute.sha("x" * 1_500_000 + "é" * 1_000_000)
