"""Every stage of the pipeline, on what its predecessor kept, beside a plain restatement."""

import os
from collections import Counter

import pytest

from tests.llm import brute
from tidemark.llm import mixing, quality_rules, sentencepiece_codec

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")


def table(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_stages(spark, tmp_path):
    import sentencepiece

    import corpus_pipeline as P

    names = ["quality_rules", "line_dedup", "ngram_join", "source_mixing", "sentencepiece"]
    assert [name for name, _ in P.STAGES] == names
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, [docs]
    for name, stage in P.STAGES:
        stage(spark, steps[-1], SF).write.parquet(str(tmp_path / name))
        steps.append(spark.read.parquet(str(tmp_path / name)))
    raw, good, clean, single, mixed, done = (table(x) for x in steps)
    assert [x.columns for x in steps[1:5]] == [columns] * 4

    assert set(good) == {r.doc_id for r in quality_rules.judged(docs).where("kept").collect()}
    assert all(good[i] == raw[i] for i in good) and not any(brute.counts(r.text)[-1] for r in good.values())

    rows = [(i, r.text) for i, r in sorted(good.items())]
    want = {i: digest for i, _, _, digest in brute.lines(rows)}
    assert {i: brute.sha(r.text) for i, r in clean.items()} == want
    assert all(r.n_chars == len(r.text) for r in clean.values())

    groups = brute.groups([(i, r.text) for i, r in sorted(clean.items())])
    assert set(single) == {i for i, _, c in groups if i == c} and all(single[i] == clean[i] for i in single)
    assert set(mixed) == set(single) and all(mixed[i] == single[i] for i in mixed)

    own = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    assert {i: list(r.ids) for i, r in done.items()} == {i: own.encode(r.text) for i, r in mixed.items()}
    assert Counter(r.doc_id for r in P.run(spark, SF).collect()) == Counter(list(done))


def test_result_keeps_the_mix(spark):
    """Prefixes of the result by slot are less than one block away from the weights; rows without an id of their own have their own slots."""
    import corpus_pipeline as P

    rows = [(i if i % 9 else None, "en", f"s{i % 3 if i % 2 else 0}", "word " * (900 + i % 50)) for i in range(900)]
    docs = spark.createDataFrame(rows + rows[:7], "doc_id bigint, lang string, source string, text string").repartition(5)
    blocks = mixing.mixed(docs).collect()
    out = P.tokens(spark, docs, SF).select("doc_id", "source", "slot").collect()
    assert Counter(map(tuple, out)) == Counter((r.doc_id, r.source, r.slot) for r in blocks)
    share = {r.source: r.units / r.period for r in blocks}
    owner, last = {r.slot: r.source for r in out}, {}
    for slot, source in owner.items():
        last[source] = max(slot, last.get(source, 0))
    done = Counter()
    for slot in range(min(last.values()) + 1):
        done[owner[slot]] += 1
        assert all(abs(done[s] - w * (slot + 1)) < 1 for s, w in share.items())
