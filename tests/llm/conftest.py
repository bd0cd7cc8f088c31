import random

import pytest

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, hash string, bucket int, block long, "
    "`row` string, kept string, `key` int, ids string, slot string, label string, x int, `group` string, `a.b` string, __block int"
)
EXTRA = ("h", 1, 2, "r", "k", 3, "i", "s", "l", 4, "g", "ab", 5)


def word(rng):
    return "".join(rng.choice("aeioustrnlé") for _ in range(rng.randint(1, 7)))


def regular(n):
    """A Thue-Morse word of a and b: it and its complement have one sum of value * base^i modulo 2^64, for every odd base, from 1024 letters on."""
    letters = "a"
    while len(letters) < n:
        letters += letters.translate(str.maketrans("ab", "ba"))
    return letters


def awkward() -> list[tuple]:
    """Copies, near copies, shared passages and lines, and every odd text the contracts name."""
    rng = random.Random(7)
    prose = [" ".join(word(rng) for _ in range(60)) for _ in range(12)]
    passage = " ".join(word(rng) for _ in range(55))
    texts: list[str | None] = []
    for k, p in enumerate(prose):
        texts.append(p.capitalize() + ".\nA shared Line \n" + (passage if k % 3 == 0 else word(rng)) + "\n" + prose[k - 1][:40])
    texts += [prose[0], prose[0].upper(), prose[0].replace("a", "A")]
    near = prose[1].split(" ")
    for k in range(6):
        own = list(near)
        own[5 + k] = "changed"
        texts.append(" ".join(own))
    texts += [None, None, "", "   \t\n ", "one two three", "one  two\tthree", "\n\n", "é" * 300, "▁ marks ▁▁", "日本語 \x00 x", "ab" * 900]
    texts += [("same words " * 150).strip(), "\n".join(["A SHARED LINE"] * 3), " ".join(word(rng) for _ in range(9000)), "x" * 250 + "y" + "x" * 250]
    for n in (256, 1024, 4096):
        one, other = regular(n), regular(n).translate(str.maketrans("ab", "ba"))
        around = [word(rng) for _ in range(8)]
        texts += [" ".join(around[:4] + [x] + around[4:]) for x in (one, other)]
        texts += [f"{one}\n{other}\n{one}", " ".join(prose[4].split(" ")[:19] + [one]), " ".join(prose[4].split(" ")[:19] + [other])]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["hot", "hot", "b", None]), len(t or "")) + EXTRA for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, prose[0], "en", "hot", 1) + EXTRA, (None, None, None, None, None) + EXTRA, (2**53 + 1, prose[2], "en", None, 5) + EXTRA]
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def small_buckets(monkeypatch):
    """Many buckets and blocks for little text."""
    from tidemark.llm import buckets, lm_score

    for function in (buckets.by_hash, buckets.by_range):
        monkeypatch.setitem(function.__kwdefaults__, "size", 6_000)
    monkeypatch.setattr(buckets.blocks_for, "__defaults__", (20_000,))
    monkeypatch.setattr(lm_score, "_SLICE", 6_000)
