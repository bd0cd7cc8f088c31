"""Plain restatements of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import string
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
BLANK = "\x20\t\n\x0b\x0c\r"


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for i, t in rows:
        norm = (t or "").translate(LOWER)
        ids = [x for x in groups[norm] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[norm]), i == keep, sha(norm)))
    return out


def suffix(rows, width=200):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(x[k : k + width] for x in texts for k in range(len(x) - width + 1))
    out = []
    for (i, _), x in zip(rows, texts):
        gone = [False] * len(x)
        for k in range(len(x) - width + 1):
            if seen[x[k : k + width]] > 1:
                gone[k : k + width] = [True] * width
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(x), sum(gone), spans, sha(bytes(b for b, g in zip(x, gone) if not g))))
    return out


def substring(rows, width=20):
    """``rows`` in the order in which they count as earlier."""
    seen, out = set(), []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            run = tuple(w[k : k + width])
            if run in seen:
                gone[k : k + width] = [True] * width
            seen.add(run)
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def lines(rows, least=10):
    keys = [[x.strip(BLANK).translate(LOWER) for x in (t or "").split("\n")] for _, t in rows]
    found = Counter(k for own in keys for k in set(own) if k)
    out = []
    for (i, t), own in zip(rows, keys):
        kept = [x for x, k in zip((t or "").split("\n"), own) if not (k and found[k] >= least)]
        out.append((i, len(own), len(own) - len(kept), sha("\n".join(kept))))
    return out


def shingles(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def groups(rows):
    sets = [shingles(t) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both, i, j = len(sets[a] & sets[b]), rows[a][0], rows[b][0]
            if both and None not in (i, j) and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets)]


def counts(text):
    t = text or ""
    w, seen, again = words(t), set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            again += x in seen
            seen.add(x)
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    times, covered = Counter(grams), set()
    for k, g in enumerate(grams):
        if times[g] > 1:
            covered.update(range(k, k + 5))
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(covered), failed


def scores(rows, base=1.5, prior=4.0):
    """The base score, and the model's with every n-gram in the filter and no false positives."""
    tokens = [words((t or "").translate(LOWER)) + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    single, pair = Counter(), Counter()
    for w, h in zip(tokens, held):
        if not h:
            single.update(w)
            pair.update(zip([""] + w, w))
    n, v, out = sum(single.values()), len(single), []

    def told(c):
        return base ** (1 + math.floor(math.log(c) / math.log(base) + 1e-9) - 0.5) if c else 0.0

    for (i, _), w, h in zip(rows, tokens, held):
        exact_score = sum(math.log10((single[x] + 1) / (n + v + 1)) for x in w)
        model = 0.0
        for a, x in zip([""] + w, w):
            context = told(single[None] if a == "" else single[a])
            own = (told(single[x]) + 1) / (n + v + 1)
            model += math.log10(min(1.0, (min(told(pair[(a, x)]), context) + prior * own) / (context + prior)))
        out.append((i, h, len(w), sum(single[x] > 0 for x in w), n, exact_score, model))
    return out
