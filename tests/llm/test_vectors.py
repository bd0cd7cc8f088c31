"""The vector operators beside plain restatements of their contracts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import centroid_clusters, vector_codes, vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster string, v int, start string, `part` int, near string, `a.b` string, of int"


def made(rng, n, width, groups=6):
    centres = [[rng.gauss(0, 0.3) for _ in range(width)] for _ in range(groups)]
    return [[float(np.float32(c + rng.gauss(0, 0.1))) for c in rng.choice(centres)] for _ in range(n)]


def awkward(width, seed=1):
    """Clusters, equal vectors, vectors on a coarse grid (many ties), and every vector that does not count."""
    rng = random.Random(seed)
    some = made(rng, 120, width) + [[float(rng.randint(-1, 1)) for _ in range(width)] for _ in range(60)]
    some += [some[0]] * 90
    rows = [(i + 3, x, rng.choice([1, 1, 1, 2, None])) for i, x in enumerate(some)]
    one = some[1]
    rows += [rows[5], rows[5], (rows[7][0], one, 2), (None, one, 1), (None, some[2], None), (-4, one, 1)]
    bad = [None, [], one[:-1], one + [0.5], [None] + one[1:], [float("nan")] + one[1:], [float("inf")] + one[1:], [-float("inf")] + one[1:], [1e30] + one[1:]]
    rows += [(k, x, 1) for k, x in enumerate(bad)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([r + ("c", 1, "s", 2, "n", "ab", 3) for r in rows], SCHEMA).repartition(4)


def kept(rows, width, scale):
    out = []
    for i, x, label in rows:
        if x is not None and len(x) == width and all(c is not None and np.isfinite(c) and abs(np.floor(scale * c)) < 1 << 24 for c in x):
            out.append((i, [int(np.floor(scale * c)) for c in x], label))
    return out


def distance(a, b):
    return sum((p - q) ** 2 for p, q in zip(a, b))


def averaged(points, owner, centres):
    out = []
    for j, c in enumerate(centres):
        own = [x for x, o in zip(points, owner) if o == j]
        out.append([sum(col) // len(own) for col in zip(*own)] if own else c)
    return out


def brute_clusters(rows, k, width, scale, rounds, seed):
    rows = kept(rows, width, scale)
    sha = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    centres = [r[1] for r in sorted(rows, key=lambda r: (r[0] is None, sha(r[0]), r[1]))[:k]]
    assign = lambda: [min((distance(r[1], c), j) for j, c in enumerate(centres)) for r in rows]
    for _ in range(rounds):
        centres = averaged([r[1] for r in rows], [j for _, j in assign()], centres)
    found = assign()
    own = Counter()
    for d, j in found:
        own[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((r[0], j, d, own[j], sum(own.values()), digest[j]) for r, (d, j) in zip(rows, found))


def brute_codes(rows, parts, entries, width, scale, rounds):
    rows = kept(rows, width, scale)
    cut = [[r[1][p * width // parts : (p + 1) * width // parts] for p in range(parts)] for r in rows]
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, rows[n][0] or 0, rows[n][1]))[:entries]
    books = [[cut[n][p] for n in order] for p in range(parts)]
    assign = lambda p: [min((distance(x[p], e), j) for j, e in enumerate(books[p])) for x in cut]
    for _ in range(rounds):
        books = [averaged([x[p] for x in cut], [j for _, j in assign(p)], books[p]) for p in range(parts)]
    found = [assign(p) for p in range(parts)]
    error = [sum(found[p][n][0] for p in range(parts)) for n in range(len(rows))]
    own = Counter()
    for r, e in zip(rows, error):
        own[r[2]] += e
    sha = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    return Counter((r[0], "".join(f"{found[p][n][1]:02x}" for p in range(parts)), error[n], own[r[2]], sha) for n, r in enumerate(rows))


@pytest.mark.parametrize("k,rounds,scale", [(40, 5, 256), (12, 3, 1), (400, 2, 2), (1, 2, 256)])
def test_centroid_clusters(spark, k, rounds, scale):
    """Coarse scales make ties and equal centroids; 400 is more than there are vectors."""
    rows = awkward(64)
    found = centroid_clusters.clustered(frame(spark, rows), k=k, rounds=rounds, scale=scale)
    got = Counter(tuple(r) for r in centroid_clusters.with_inertia(spark, found).collect())
    assert got == brute_clusters(rows, k, 64, scale, rounds, 2)


@pytest.mark.parametrize("seed", range(20))
def test_orchard_search(seed):
    rng = np.random.default_rng(seed)
    spread = (2, 6, 400)[seed % 3]
    centroids = rng.integers(-spread, spread, (rng.integers(1, 30), 3))
    x = rng.integers(-spread, spread, (200, 3))
    found, best = centroid_clusters.Orchard(centroids).nearest(x, rng.integers(0, len(centroids), 200))
    far = ((x[:, None] - centroids[None]) ** 2).sum(2)
    assert (found == far.argmin(1)).all() and (best == far.min(1)).all()


def test_orchard_search_compares_few_of_well_parted_centroids():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-10_000, 10_000, (200, 4))
    near = np.repeat(np.arange(200), 5)
    x = centroids[near] + rng.integers(-5, 6, (1000, 4))
    search, compared = centroid_clusters.Orchard(centroids), []
    plain = search._distance
    search._distance = lambda rows, which: compared.append(len(rows)) or plain(rows, which)
    found, _ = search.nearest(x, near)
    assert (found == near).all() and sum(compared) < 2 * len(x)


@pytest.mark.parametrize("parts,entries,rounds,scale", [(8, 16, 6, 4096), (4, 5, 9, 1), (2, 300, 3, 2), (8, 1, 2, 4096)])
def test_vector_codes(spark, parts, entries, rounds, scale):
    rows = awkward(16)
    found = vector_codes.compressed(frame(spark, rows), parts=parts, entries=entries, rounds=rounds, scale=scale)
    columns = "vec_id", "code", "error", "label_error", "codebooks_sha256"
    got = Counter(tuple(r) for r in vector_codes.with_label_error(spark, found).select(*columns).collect()) if entries <= 256 else None
    want = brute_codes(rows, parts, entries, 16, scale, rounds)
    if got is None:  # two digits do not name so many entries; the codes themselves do
        got = Counter((r.vec_id, r.error) for r in found.coded.collect())
        want = Counter((r[0], r[2]) for r in want.elements())
    assert got == want


def test_vector_codes_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    rows = awkward(16)
    found = vector_codes.compressed(frame(spark, rows))
    columns = "vec_id", "code", "error", "label_error", "codebooks_sha256"
    assert Counter(tuple(r) for r in vector_codes.with_label_error(spark, found).select(*columns).collect()) == brute_codes(rows, 8, 16, 16, 4096, 6)


def test_vector_codes_decode_to_within_their_error(spark):
    rows = [r for r in awkward(16) if r[1] and len(r[1]) == 16]
    found = vector_codes.compressed(frame(spark, rows))
    for r in vector_codes.decoded(found.coded, found.codebooks).collect():
        numbers = [int(v * 4096) for v in r.decoded]
        assert r.error in {distance(numbers, x) for _, x, _ in kept(rows, 16, 4096)}


@pytest.mark.parametrize("seed", range(10))
def test_bounds_decide_only_what_is_certain(seed):
    """Codebooks that drift and settle: few parts are scanned once they rest, stamps stay where bounds hold, and no part is wrong."""
    rng = np.random.default_rng(seed)
    spread = (4, 2000)[seed % 2]
    x = rng.integers(-spread, spread, (300, 2, 4))
    history = [rng.integers(-spread, spread, (2, 6, 4))]
    known = vector_codes.Training(history).first(x)
    for t in range(1, 9):
        step = max(1, spread >> (2 * t))
        history = [*history, history[-1] + rng.integers(-step, step + 1, (2, 6, 4)) * (t < 7)]
        training = vector_codes.Training(history)
        before = known.lower_at.copy()
        training.advance(x, known)
        assert ((known.lower_at == before) | (known.lower_at == t)).all()
        for p in range(2):
            far = ((x[:, p, None] - history[-1][None, p]) ** 2).sum(2)
            assert (known.near[:, p] == far.argmin(1)).all()
    if spread > 100:
        assert (known.lower_at == 8).mean() < 0.1


def test_net_displacement_is_tighter_than_added_moves():
    """An entry that moves away and comes back has no displacement, and nothing is scanned."""
    x = np.array([[[0, 0]], [[10, 0]]])
    there, away = np.array([[[0, 0], [10, 0]]]), np.array([[[4, 3], [10, 0]]])
    known = vector_codes.Training([there]).first(x)
    vector_codes.Training([there, away, there]).advance(x, known)
    assert (known.lower_at == 0).all() and (known.upper_at == 0).all()


def test_widths_and_whole(spark):
    rows = frame(spark, awkward(16))
    assert {r.width: r.n for r in vectors.widths(rows, "embedding").collect()}[16] == len([r for r in awkward(16) if r[1] and len(r[1]) == 16])
    doubles = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    assert Counter((r.vec_id, tuple(r.v)) for r in vectors.numbered(doubles, 256, 16).collect()) == Counter((r[0], tuple(r[1])) for r in kept(awkward(16), 16, 256))


def test_no_vectors(spark):
    for rows in ([], [(1, None, 1), (2, [], None), (3, [None] * 64, 1)]):
        none = frame(spark, rows)
        assert centroid_clusters.with_inertia(spark, centroid_clusters.clustered(none)).count() == 0
        assert vector_codes.with_label_error(spark, vector_codes.compressed(none)).count() == 0
