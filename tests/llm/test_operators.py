"""Every operator beside a plain restatement of its contract, over awkward rows, and over none."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import (
    exact_dedup, line_dedup, lm_score, mixing, ngram_join, quality_rules, sentencepiece_codec, substring_dedup, suffix_dedup, tokens, url_filter,
)


def got(frame, *columns):
    return Counter(tuple(r) for r in frame.select(*columns).collect())


def texts(rows):
    return [(r[0], r[1]) for r in rows]


def in_order(rows):
    return sorted(texts(rows), key=lambda r: (r[0] is not None, r[0] or 0, len((r[1] or "").encode()), r[1] or ""))


def test_exact_dedup(docs, rows):
    out = exact_dedup.exact_groups(docs)
    assert got(out, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == Counter(brute.exact(texts(rows)))


def test_exact_dedup_parts_colliding_hashes(docs, rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "hash128", lambda text: F.unhex(F.lit("00")))
    out = exact_dedup.exact_groups(docs)
    assert got(out, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == Counter(brute.exact(texts(rows)))


def test_suffix_dedup(docs, rows, small_buckets):
    out = suffix_dedup.without_repeated_bytes(docs)
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(brute.suffix(texts(rows)))


def test_suffix_dedup_cuts_hot_names(docs, rows, small_buckets, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    out = suffix_dedup.without_repeated_bytes(docs)
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(brute.suffix(texts(rows)))


@pytest.mark.parametrize("seed", range(30))
def test_collection_order(seed):
    rng = random.Random(seed)
    strings = list({"".join(rng.choice("abc"[: 2 + seed % 2]) for _ in range(rng.randint(8, 40))).encode() for _ in range(rng.randint(1, 15))})
    depth = rng.randint(1, 8)
    seen = Counter(s[k : k + depth] for s in strings for k in range(len(s) - depth + 1))
    want = [[seen[s[k : k + depth]] > 1 for k in range(len(s) - depth + 1)] + [False] * (depth - 1) for s in strings]
    assert [list(x) for x in suffix_dedup.collection(strings, depth)] == want


def test_substring_dedup(docs, rows, small_buckets):
    out = substring_dedup.without_repeats(docs)
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == Counter(brute.substring(in_order(rows)))
    assert {r.kept_sha256 == brute.sha(r.kept) for r in out.collect()} == {True}


def test_line_dedup(docs, rows):
    docs.createOrReplaceTempView("line_docs")
    out = line_dedup.split_lines(docs)
    found = out.select(
        F.col("row.doc_id"), F.size("lines").cast("long"), (F.size("lines") - F.size("kept")).cast("long"), F.sha2(F.array_join("kept", "\n"), 256)
    )
    assert Counter(tuple(r) for r in found.collect()) == Counter(brute.lines(texts(rows)))
    cleaned = line_dedup.without_frequent_lines(docs)
    assert cleaned.schema == docs.schema and cleaned.count() == len(rows)


@pytest.mark.parametrize("tile", [1024, 2])
def test_ngram_join(docs, rows, small_buckets, tile):
    out = ngram_join.similar_groups(docs, tile=tile)
    assert got(out, "doc_id", "n_shingles", "component_id") == Counter(brute.groups(texts(rows)))
    left = ngram_join.first_of_each_group(docs)
    assert left.schema == docs.schema
    firsts = [r for r in brute.groups(texts(rows)) if r[0] == r[2]]
    assert Counter(r.doc_id for r in left.collect()) == Counter(r[0] for r in firsts)


def test_ngram_join_large_group(spark, small_buckets):
    """A chain of near copies, in tiles smaller than the group, beside rows that share its words but stay below the bound."""
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(80)]
    rows = []
    for i in range(90):
        own = list(base)
        for k in rng.sample(range(80), rng.choice([0, 1, 2, 3])):
            own[k] = f"z{i}_{k}"
        rows.append((i, " ".join(own)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = Counter(brute.groups(rows))
    for tile in (8, 1024):
        assert got(ngram_join.similar_groups(frame, tile=tile), "doc_id", "n_shingles", "component_id") == want


def test_quality_rules(docs, rows):
    out = quality_rules.judged(docs)
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert got(out, "doc_id", *columns) == Counter((r[0], *brute.counts(r[1])) for r in rows)
    assert out.where("base_failed AND kept").count() == 0
    left = quality_rules.without_rejected(docs)
    assert left.schema == docs.schema
    assert Counter(r.doc_id for r in left.collect()) == Counter(r.doc_id for r in out.where("kept").collect())


def test_quality_rules_find_the_covariance_of_the_clean(spark):
    """A quarter of wild rows does not move the estimate; clean rows stay and wild ones go."""
    rng = random.Random(5)
    from tests.llm.conftest import word

    rows = []
    for i in range(600):
        w = [word(rng) for _ in range(rng.randint(30, 200))]
        wild = i % 5 == 0
        rows.append((i, " ".join(x + "###" for x in w) if wild else " ".join(w), "en", f"s{i % 2}"))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    kept = {r.doc_id for r in quality_rules.judged(frame).where("kept").collect()}
    assert kept == {r[0] for r in rows if r[0] % 5}


def test_quality_rules_judge_rare_sources_by_their_language(spark):
    """Sources of 1, 2 and 3 rows beside a large one, and a language of few rows beside a large one: garbage goes, clean rows stay."""
    rng = random.Random(6)
    from tests.llm.conftest import word

    places = [("en", "hot")] * 300 + [("en", f"of{n}") for n in (1, 2, 3) for _ in range(n)] + [("fr", "rare")] * 3
    rows = []
    for lang, source in places:
        for wild in (False, True)[: 1 if source == "hot" else 2]:
            w = [word(rng) for _ in range(rng.randint(60, 200))]
            own = source + ("-wild" if wild else "")
            rows.append((len(rows), " ".join(x + "###" for x in w) if wild else " ".join(w), lang, own))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    kept = {r.doc_id for r in quality_rules.judged(frame).where("kept").collect()}
    assert kept == {r[0] for r in rows if not r[3].endswith("wild")}


def test_quality_rules_reject_an_outlier_of_each_statistic(spark):
    rng = random.Random(8)
    from tests.llm.conftest import word

    clean = [" ".join(word(rng) for _ in range(rng.randint(60, 200))) for _ in range(300)]
    some = ["".join(rng.choice("aeioustrnl") for _ in range(4)) for _ in range(110)]
    wild = [
        " ".join(x * 8 for x in some), " ".join(x + "##" for x in some), "\n".join(rng.choice(some[:10]) for _ in range(100)),
        " ".join(some[:85] + 3 * some[85:90]), " ".join(some).upper(),
    ]
    frame = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(clean + wild)], "doc_id bigint, text string, lang string, source string")
    found = {r.doc_id: r for r in quality_rules.judged(frame).collect()}
    assert not any(found[i].base_failed for i in range(300, 305))
    assert {i for i in found if not found[i].kept} == set(range(300, 305))


def test_quality_rules_reject_an_outlier_of_a_correlation(spark):
    """Longer words come with fewer short ones; a text within the range of both, but of long words and as many short ones, is outside."""
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("aeioustrnl") for _ in range(n))

    def text(short, length):
        return " ".join(letters(rng.randint(2, 3)) if rng.random() < short else letters(length + rng.randint(-1, 1)) for _ in range(200))

    clean = [text(0.2 + 0.01 * (i % 30), 6) for i in range(400)]
    rows = [(i, t, "en", "s") for i, t in enumerate(clean + [text(0.45, 7), text(0.22, 5)])]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    found = quality_rules.judged(frame).select("doc_id", "kept", F.get("x", F.lit(0)).alias("length"), F.get("x", F.lit(1)).alias("short")).collect()
    lengths, shorts = [[r[c] for r in found if r.doc_id < 400] for c in ("length", "short")]
    odd = [r for r in found if r.doc_id >= 400]
    assert all(min(lengths) < r.length < max(lengths) and min(shorts) < r.short < max(shorts) for r in odd)
    assert {r.doc_id for r in found if not r.kept} == {400, 401}


def test_quality_rules_beside_sorted_concentration(spark):
    """Verdicts of a group are those of an estimate by whole sorted distances, from many random starts."""
    rng = random.Random(10)
    from tests.llm.conftest import word

    rows = []
    for i in range(700):
        w = [word(rng).capitalize() if rng.random() < 0.05 else word(rng) for _ in range(rng.randint(20, 300))]
        w = [x + rng.choice(".,") if rng.random() < 0.1 else x for x in w]
        w = [x * 3 for x in w] if i % 11 == 0 else [x.upper() for x in w] if i % 13 == 0 else w
        rows.append((i, " ".join(w), "en", "s"))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    found = {r.doc_id: r for r in quality_rules.judged(frame).collect()}
    x = np.array([found[i].x for i in range(700)]) / quality_rules.SCALE
    best, held = None, 525
    for seed in range(20):
        own = np.random.default_rng(seed).choice(700, 30, replace=False)
        for _ in range(40):
            mean, cov = x[own].mean(0), np.cov(x[own].T, bias=True)
            far = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            own = np.argsort(far, kind="stable")[:held]
        best = min(best or (np.inf,), (np.linalg.det(cov), seed, mean, cov), key=lambda e: e[0])
    draws = np.random.default_rng(1).standard_normal((400_000, 5))
    squared = (draws**2).sum(1)
    near = np.sort(squared)[: int(0.75 * len(squared))]
    far = np.einsum("ij,jk,ik->i", x - best[2], np.linalg.inv(best[3] * 5 / near.mean()), x - best[2])
    want, limit = np.array([found[i].distance for i in range(700)]), 30.856
    assert np.allclose(want, far, rtol=0.2, atol=0.5)
    clear = abs(far - limit) > 0.2 * limit
    assert [found[i].kept for i in range(700) if clear[i]] == [bool(d <= limit) and not found[i].base_failed for i, d in enumerate(far) if clear[i]]
    assert sum(not r.kept for r in found.values()) > 100


def test_quality_rules_invert_any_few_rows():
    for n in (1, 2, 3):
        x = np.random.default_rng(n).random((n, 5)) * 5
        found = quality_rules._estimate(x.mean(0), np.cov(x.T, bias=True) if n > 1 else np.zeros((5, 5)), 1.0)
        scaled = np.array(found["precision"]).reshape(5, 5) * np.outer(quality_rules._FLOOR, quality_rules._FLOOR)
        values = np.linalg.eigvalsh(scaled)
        assert values.min() > 0 and values.max() < 1 + 1e-9


def test_lm_score(docs, rows, small_buckets):
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    out = sorted((tuple(r) for r in lm_score.scored(docs).select(*columns).collect()), key=repr)
    want = sorted(brute.scores(texts(rows)), key=repr)
    assert [r[:5] for r in out] == [r[:5] for r in want]
    for a, b in zip(out, want):
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-6)


def test_lm_score_keeps_its_filter_bounded(docs, rows, small_buckets):
    """With far fewer bits than members the model blurs; the exact columns do not."""
    out = Counter(tuple(r)[:5] for r in lm_score.scored(docs, filter_bits=8192).collect())
    assert out == Counter(r[:5] for r in brute.scores(texts(rows)))


def test_lm_score_filter_grows_with_its_ngrams(spark, monkeypatch):
    """A part holds every n-gram of its block, also those seen once, and few others, whatever their number."""
    monkeypatch.setattr(lm_score, "LEAST_BITS", 1024)
    for n in (50, 20_000):
        frame = spark.createDataFrame([(" ".join(f"w{i}" for i in range(k, k + 10)),) for k in range(0, n, 10)], "text string")
        (part,) = lm_score.filter_parts(frame, "text", 1).collect()
        names = tokens.word_names(*(lambda d: (d, *tokens.words(d, np.array([0, len(d)]))[:2]))(np.frombuffer(" ".join(f"w{i}" for i in range(n)).encode(), np.uint8)))
        assert part.least == 1 and (lm_score.levels_of(part.bits, names >> np.uint64(16)) > 0).all()
        assert len(part.bits) * 8 >= 2 * n * lm_score.MEMBER_BITS
        others = lm_score.T.mix(np.arange(10_000, dtype=np.uint64)) >> np.uint64(16)
        assert (lm_score.levels_of(part.bits, others) > 0).mean() < 0.05


def test_sentencepiece(docs, rows):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    want = Counter((r[0], tuple(own.encode(r[1] or ""))) for r in rows)
    out = sentencepiece_codec.encoded(docs)
    assert Counter((r.doc_id, tuple(r.ids)) for r in out.collect()) == want
    assert set(out.columns) == set(docs.columns)
    back = sentencepiece_codec.decoded(out, text="back")
    assert Counter((r.doc_id, r.back) for r in back.collect()) == Counter((r[0], (r[1] or "").replace("▁", " ")) for r in rows)
    assert sentencepiece_codec.round_trip(docs).where("NOT same").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_sentencepiece_on_random_letters(seed):
    import sentencepiece

    rng = random.Random(seed)
    own = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    encoder = sentencepiece_codec.Encoder(sentencepiece_codec.Vocabulary())
    letters = ["aaabt he in\n  ▁éß日", "etaoinshrdlu", "   a", "ABCab.,;:01 \t"][seed]
    some = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    flat, bounds = encoder.encode(some)
    assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == own.encode(some)


def test_mixing_keeps_to_its_weights(spark):
    rows = [(i, "x" * (50 + i % 7), f"s{i % 3 if i % 2 else 0}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mixed(frame, weights={"s0": 0.5, "s1": 0.3, "s2": 0.2}, block_chars=500, period=50)
    blocks = sorted({(r.slot, r.source, r.block, r.units, r.period) for r in out.collect()})
    assert out.count() == len(rows) and [b[0] for b in blocks] == list(range(len(blocks)))
    last = {s: max(b[0] for b in blocks if b[1] == s) for s in ("s0", "s1", "s2")}
    done = Counter()
    for slot, source, block, _, _ in blocks:
        if slot > min(last.values()):
            break
        assert block == done[source]
        done[source] += 1
        for name, units in (("s0", 25), ("s1", 15), ("s2", 10)):
            assert abs(done[name] - units / 50 * (slot + 1)) < 1


def test_mixing_takes_awkward_rows(docs, rows):
    out = mixing.mixed(docs, block_chars=2_000)
    assert Counter(r.doc_id for r in out.collect()) == Counter(r[0] for r in rows)
    assert out.where("released > due").count() == 0
    ordered = mixing.in_mixed_order(docs, block_chars=2_000)
    assert ordered.schema == docs.schema and ordered.count() == len(rows)


URLS = [
    "http://a.com/x", "https://Example.COM/en/1", "https://www.example.com/en/1?q", "http://x.www.example.com/en/", "http://notexample.com/en/",
    "http://b.net/es/1", "http://b.net/es", "http://net/fr/", "ftp://c.org", "c.org/en/", None, "", "x://y://z/p", "http://d.org/a/?utm_source=1#f",
    "http://www.d.org/a", "http://d.org/b?k=1&utm_x=2", "http://com", "http://e.org/list/#x",
]


def test_url_filter(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    listed = ["http://d.org/a", "https://e.org/list", "http://a.com/x", None]

    def parts(url):
        rest = url.partition("://")[2] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].translate(brute.LOWER), rest[cut:]
        return host, path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]

    want = []
    for i, url in enumerate(URLS):
        host, path = parts(url)
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "block" if url in (URLS[13], URLS[14], URLS[17]) else "allow")
        want.append((i, host, path, rule, verdict))
    pages = spark.createDataFrame([(i, u, "h", "clash", 1) for i, u in enumerate(URLS)], "page_id bigint, url string, host string, verdict string, __block int")
    frame = spark.createDataFrame([(u,) for u in listed], "url string")
    for blocks in (1, 1 << 10):  # one block is full of bits and lets everything through: results stay exact
        assert got(url_filter.filter_urls(pages, frame, blocks=blocks), "page_id", "host", "path", "rule", "verdict") == Counter(want)


def test_empty_tables(spark, none):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    frames = [
        sentencepiece_codec.round_trip(none), url_filter.filter_urls(pages, url_filter.unwanted_urls(pages)), exact_dedup.exact_groups(none),
        suffix_dedup.without_repeated_bytes(none), lm_score.scored(none), quality_rules.judged(none), substring_dedup.without_repeats(none),
        mixing.mixed(none), mixing.in_mixed_order(none), line_dedup.without_frequent_lines(none), ngram_join.similar_groups(none), ngram_join.first_of_each_group(none),
        quality_rules.without_rejected(none),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)
