"""Near vectors against every pair of a label."""

import numpy as np
import pytest

from vettrail.llm import vectors

from .test_minhash import group

SCHEMA = "vec_id long, embedding array<float>, label int, id long, e string"


def brute(rows):
    ok, units = [], []
    for i, (_, e, label) in enumerate(rows):
        if label is None or not e or any(x is None or not np.isfinite(x) for x in e) or not any(e):
            continue
        x = np.array(e, np.float32).astype(float)
        ok.append(i), units.append(x / np.sqrt(x @ x))
    links = []
    for a, i in enumerate(ok):
        for b in range(a):
            j = ok[b]
            if rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and units[a] @ units[b] >= 0.98:
                links.append((j, i))
    roots, counts, members = group(len(rows), links), [0] * len(rows), {}
    for a, b in links:
        counts[a] += 1
        counts[b] += 1
    for i, r in enumerate(roots):
        members.setdefault(r, []).append(rows[i][0])
    for i, (key, _, _) in enumerate(rows):
        first = min((x for x in members[roots[i]] if x is not None), default=None)
        yield key, counts[i], first, key == first


def key(r):
    return tuple((x is not None, x) for x in r)


def frame(spark, rows):
    return spark.createDataFrame([(i, e, label, 1, "x") for i, e, label in rows], SCHEMA).repartition(3)


def planted(seed, n, dim=24):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        rows.append((i, rng.normal(size=dim).astype(np.float32).tolist(), int(rng.integers(3))))
    for g in range(25):
        base = rng.normal(size=dim)
        for j in range(int(rng.integers(2, 9))):
            rows.append((10_000 + 100 * g + j, (base + rng.normal(size=dim) * rng.choice([0.02, 0.1])).astype(np.float32).tolist(), g % 3))
    return rows


def test_planted_groups_and_odd_rows(spark):
    rows = planted(1, 500)
    one = rows[3][1]
    rows += [
        (None, one, rows[3][2]), (None, one, rows[3][2]), (20_000, one, None), (20_001, None, 1), (20_002, [0.0] * 24, 1), (20_003, [float("nan")] + [1.0] * 23, 1),
        (20_004, [float("inf")] + [1.0] * 23, 1), (20_005, [None] + [1.0] * 23, 1), (20_006, [], 1), (20_007, [1.0, 2.0], 1), (20_008, [2.0, 4.0], 1),
        (20_009, [2 * x for x in one], rows[3][2]), (3, one, rows[3][2]), (20_010, one, (rows[3][2] + 1) % 3),
    ]
    got = vectors.near_vectors(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_dense_ball(spark):
    """One group far beyond the longest list, whose members miss some of each other."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=24)
    rows = planted(2, 150) + [(30_000 + i, (base + rng.normal(size=24) * 0.14).astype(np.float32).tolist(), 1) for i in range(150)]
    got = vectors.near_vectors(frame(spark, rows)).collect()
    want = {r[0]: r for r in brute(rows)}
    assert max(r[1] for r in want.values()) > vectors.MOST_NEIGHBOURS
    linked, found = sum(r[1] for r in want.values()), sum(min(r.n_links, want[r.vec_id][1]) for r in got)
    assert found >= 0.97 * linked and all(r.n_links <= want[r.vec_id][1] for r in got)
    assert sum(r.component_id == want[r.vec_id][2] for r in got) >= 0.99 * len(rows)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 0.0], 1)], [(2, None, None)]])
def test_few_rows(spark, rows):
    got = vectors.near_vectors(frame(spark, rows)).collect()
    assert [tuple(r) for r in got] == [(i, 0, i, True) for i, _, _ in rows]


def pairs(seed, n, linked, dim=24):
    """`n` vectors of one label, `linked` of which have one near copy each."""
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dim).astype(np.float32).tolist(), 1) for i in range(n)]
    return rows + [(10_000 + i, (np.array(rows[i][1]) + rng.normal(size=dim) * 0.05).astype(np.float32).tolist(), 1) for i in range(linked)]


@pytest.mark.parametrize("rows", [pairs(6, 400, 300), pairs(7, 690, 8) + [(20_000 + i, [1.0] * 24, 1) for i in range(300)]], ids=["recall", "rare"])
def test_missed_links_are_not_let_through(spark, monkeypatch, rows):
    """First lists that find nothing: the links come from the audit's way out, or not at all."""
    first = vectors._first_lists
    monkeypatch.setattr(vectors, "_first_lists", lambda *a: first(*a).filter("s > 2"))
    got = vectors.near_vectors(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)
