"""Near duplicates against all pairs of full sets; components against a union-find."""

import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from vettrail.llm import minhash
from vettrail.llm.components import components

from . import fixtures

FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingles(text, size=2):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def group(n, links):
    at = [*range(n)]

    def root(i):
        while at[i] != i:
            at[i] = at[at[i]]
            i = at[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        at[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def brute(rows, size=2):
    """Rows of one id are one document; a null id is larger than any other."""
    sets, owners = [shingles(t, size) for _, t in rows], defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            owners[x].append(i)
    met = defaultdict(int)
    for own in owners.values():
        if len(own) < 400:
            for a, b in combinations(own, 2):
                met[a, b] += 1
    common = {p for p in met if 100 * len(sets[p[0]] & sets[p[1]]) >= 80 * len(sets[p[0]] | sets[p[1]])}
    roots, members = group(len(rows), common), defaultdict(list)
    for i, r in enumerate(roots):
        members[r].append(rows[i][0])
    for i, (r, (doc_id, _)) in enumerate(zip(roots, rows)):
        first = min((x for x in members[r] if x is not None), default=None)
        yield doc_id, len(sets[i]), first, doc_id == first


def key(r):
    return tuple((x is not None, x) for x in r)


def check(spark, rows, size=2):
    got = minhash.near_duplicates(fixtures.frame(spark, rows).repartition(4), size).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, size), key=key)


@pytest.mark.parametrize("size", [2, 5])
def test_fixture(spark, sf, size):
    check(spark, fixtures.documents(sf), size)


def test_keep_first(spark, sf):
    rows = fixtures.documents(sf)
    got = minhash.keep_first(fixtures.frame(spark, rows).repartition(4))
    assert got.columns == fixtures.frame(spark, rows[:1]).columns
    want = {(i, t) for (i, t), r in zip(rows, brute(rows, 5)) if r[3]}
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted(want, key=key)


def test_groups_of_near_copies(spark):
    """Chains and balls around the threshold, whose members often miss the pivot."""
    rnd, rows = random.Random(3), []
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    for g in range(6):
        base = [word() for _ in range(rnd.choice([25, 60, 150]))]
        for i in range(40):
            copy = list(base)
            for _ in range(max(1, int(len(base) * rnd.choice([0.01, 0.03, 0.05])))):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((g * 1000 + i, " ".join(copy)))
            if g % 2:
                base = copy
    check(spark, rows)


def test_empty(spark):
    assert minhash.near_duplicates(fixtures.frame(spark, []).filter("doc_id = 1")).collect() == []


@pytest.mark.parametrize("percent", [30, 80, 95])
def test_estimate(spark, percent):
    """The corrected estimate from packed low bits is near the true similarity."""
    a = [f"w{i}" for i in range(1500)]
    b = a[: 15 * percent] + [f"v{i}" for i in range(1500 - 15 * percent)]
    batch = pa.RecordBatch.from_pydict({"nid": [False, False], "id": [1, 2], "th": [0, 0], "text": [" ".join(a), " ".join(b)]})
    signed = next(iter(minhash._sign(iter([batch]), 2))).to_pylist()
    df = spark.createDataFrame([tuple(r[f"s{i}"] for r in signed for i in range(4))], ", ".join(f"c{i} long" for i in range(8)))
    from pyspark.sql import functions as F

    got = df.select(minhash.estimate([F.col(f"c{i}") for i in range(4)], [F.col(f"c{i}") for i in range(4, 8)])).first()[0]
    x, y = shingles(" ".join(a)), shingles(" ".join(b))
    assert abs(got - len(x & y) / len(x | y)) < 0.16
    assert np.isfinite(got)


def test_components(spark):
    rnd = random.Random(8)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5000 + i) for i in range(200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    roots = group(6000, edges)
    assert got == {i: roots[i] for e in edges if e[0] != e[1] for i in e}
