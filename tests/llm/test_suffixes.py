"""Repeated passages against every 400-byte window of every text."""

import hashlib
import random
from collections import Counter

import pytest

from vettrail.llm import suffixes

from . import fixtures
from .test_passages import shared_words


def brute(rows):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(hash(t[i : i + 400]) for t in texts for i in range(len(t) - 399))
    for (key, _), t in zip(rows, texts):
        gone, last = bytearray(len(t)), 0
        for i in range(len(t) - 399):
            if seen[hash(t[i : i + 400])] > 1:
                a, last = max(i, last), i + 400
                gone[a:last] = b"\x01" * (last - a)
        kept = bytes(b for b, g in zip(t, gone) if not g)
        n = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        yield key, len(t), sum(gone), n, hashlib.sha256(kept).hexdigest()


def key(r):
    return tuple((x is not None, x) for x in r)


def check(spark, rows, parts=4):
    got = suffixes.passage_digest(fixtures.frame(spark, rows).repartition(parts)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(brute(rows), key=key)
    assert Counter((r.doc_id, r.n_shared_words) for r in got) == Counter((i, sum(a)) for (i, _), a, _ in shared_words(rows))


def test_fixture(spark, sf):
    check(spark, [r for r in fixtures.documents(sf) if len(r[1] or "") < 60_000])


def test_passages(spark):
    """Passages of 395 to 900 bytes in new surroundings, at text ends, twice in a text, and periodic text."""
    rnd = random.Random(4)
    noise = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    passages = [noise(n) for n in (330, 360, 380, 395, 420, 600, 900)]
    rows = []
    for i in range(160):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            parts += [noise(rnd.randint(0, 300)), rnd.choice(passages)]
        rows.append((i, "".join(parts) + noise(rnd.choice([0, 50]))))
    rows += [(1000, "ab" * 1000), (1001, "x" * 399), (1002, "x" * 400), (1003, "y" * 401), (1004, "abc" * 500 + noise(100)), (1005, "é" * 300)]
    check(spark, rows)


@pytest.mark.parametrize("kinds", [20_000, 10])
def test_frequent_passage_over_many_partitions(spark, monkeypatch, kinds):
    """One anchor in one partition or over their boundaries: each text has the passage in its own surroundings."""
    monkeypatch.setattr(suffixes, "HOT_KINDS", kinds)
    rnd = random.Random(6)
    noise = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    passage = noise(430)
    check(spark, [(i, noise(420) + passage + noise(420)) for i in range(120)] + [(500, passage)], 7)


def test_cut_keeps_characters(spark):
    rnd = random.Random(9)
    passage = "".join(rnd.choice("éüöñßàâ") for _ in range(300))
    rows = [(1, "aéx" + passage + "wñz"), (2, "büy" + passage + "öy"), (3, None)]
    got = {r.doc_id: r.text for r in suffixes.cut_texts(fixtures.frame(spark, rows)).collect()}
    assert got == {1: "aéxwñz", 2: "büyöy", 3: None}


def test_empty(spark):
    assert suffixes.passage_digest(fixtures.frame(spark, []).filter("doc_id = 1")).collect() == []


@pytest.mark.parametrize("spans,want", [([], "aéb"), ([1, 3], "ab"), ([2, 3], "aéb"), ([0, 2], "éb"), ([0, 4], "")])
def test_cut(spans, want):
    assert suffixes.cut("aéb", spans) == want
