"""Every stage of the pipeline against its operator's brute force, on what the stage before it kept."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from vettrail.llm import quality
from vettrail.llm.common import materialize

from . import fixtures
from .test_documents import brute_lines
from .test_minhash import brute as brute_groups
from .test_packing import best_fit
from .test_passages import _HASHES, cut, shared_words


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, sf):
    rows = [r for r in fixtures.documents(sf) if len(r[1] or "") < 60_000]
    docs = fixtures.frame(spark, rows).repartition(3)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "passage_dedup", "best_fit_packing"]
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name, d: materialize(stages[name](spark, d, sf), name)

    good = step("quality_rules", docs)
    verdicts = quality.rate_documents(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert Counter(r.doc_id for r in good.collect()) == Counter(r.doc_id for r in verdicts.collect() if r.kept)
    assert set(pairs(good)) <= set(rows)

    lines = step("line_dedup", good)
    whole = Counter((i, t) for i, _, dropped, t in brute_lines(pairs(good)) if not dropped or (t or "").strip(" \t\n\v\f\r"))
    assert Counter(pairs(lines)) == whole and all(t.split() for _, t in pairs(lines))
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    near = step("near_dedup", lines)
    own = pairs(lines)
    want = {(i, t) for (i, t), r in zip(own, brute_groups(own, 5)) if r[3]}
    assert Counter(pairs(near)) == Counter(want)

    _HASHES.update({r.text: r.h for r in near.selectExpr("coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS h").collect()})
    rest = step("passage_dedup", near)
    assert Counter(pairs(rest)) == Counter(cut(pairs(near), drop_emptied=True))
    assert not any(any(s) for _, s, _ in shared_words(pairs(rest)))
    for out in (good, lines, near, rest):
        assert out.columns == docs.columns

    packed = step("best_fit_packing", rest).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in pairs(rest)}
    assert len({r.sequence_id for r in packed}) == best_fit([r.length for r in packed], 2048)


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and out.columns[:3] == ["doc_id", "piece", "start"]


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, "short")]])
def test_nothing_left(spark, sf, tmp_path, rows):
    """Empty tables, and tables of which nothing is kept, pass through every stage."""
    fixtures.frame(spark, rows or [(1, "x")]).filter("true" if rows else "false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_passages_in_long_and_short_bytes(spark, sf):
    """A passage of 51 words below 400 bytes that two documents hold stays in the first alone; a document of nothing else goes."""
    rnd = random.Random(3)
    text = lambda n: " ".join(f"w{rnd.randrange(10 ** 6)}" for _ in range(n))
    passage = " ".join("abcdefghijklmnopqrstuvwxyz"[i % 26] + str(i) for i in range(51))
    assert len(passage) < 400
    rows = [(1, f"{text(80)} {passage} {text(90)}"), (2, f"{text(70)} {passage} {text(95)}"), (3, passage), (4, text(60))]
    docs = fixtures.frame(spark, rows)
    got = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["passage_dedup"](spark, docs, sf).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1].replace(passage, ""), 4: rows[3][1]}
