"""Shared passages of words against every 50-word window of every text."""

import random
import re
from collections import defaultdict

import pytest

from vettrail.llm import passages

from . import fixtures

WORD = re.compile("[^\x20\x09-\x0D]+")


def shared_words(rows, size=50):
    """Each row with flags of its words: in a window that another document holds; in one that an earlier document holds. Equal rows are one document."""
    document = lambda key, text: (key is None, key or 0, text or "")
    order = {d: i for i, d in enumerate(sorted({document(*r) for r in rows}, key=lambda d: (d[0], d[1], _hash(d[2]))))}
    holders = defaultdict(set)
    windows = []
    for key, text in rows:
        own = WORD.findall(text or "")
        windows.append([tuple(own[i : i + size]) for i in range(len(own) - size + 1)])
        for w in windows[-1]:
            holders[w].add(order[document(key, text)])
    for (key, text), ws in zip(rows, windows):
        n = len(ws) + size - 1 if ws else 0
        shared, later = [False] * n, [False] * n
        for i, w in enumerate(ws):
            if len(holders[w]) > 1:
                shared[i : i + size] = [True] * size
                if min(holders[w]) < order[document(key, text)]:
                    later[i : i + size] = [True] * size
        yield (key, text), shared, later


_HASHES = {}


def _hash(text):
    """Rows that share an id are ordered by the hash of their text, which only Spark has."""
    return _HASHES.get(text, 0)


def cut(rows, size=50, drop_emptied=False):
    """What stays of each row: without its later words and the white space between two of one run."""
    for (key, text), _, later in shared_words(rows, size):
        if text is None or not any(later):
            yield key, text
            continue
        out, at, spans = "", 0, [m.span() for m in WORD.finditer(text)]
        for i, (a, b) in enumerate(spans):
            gone = i < len(later) and later[i]
            after = i > 0 and gone and later[i - 1]
            out += "" if after else text[at:a]
            out += "" if gone else text[a:b]
            at = b
        out += text[at:]
        if not drop_emptied or out.strip(" \t\n\v\f\r"):
            yield key, out


def key(r):
    return tuple((x is not None, x) for x in r)


def check(spark, rows, parts=4):
    docs = fixtures.frame(spark, rows).repartition(parts)
    _HASHES.update({r.text: r.h for r in docs.selectExpr("coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS h").collect()})
    for drop in (False, True):
        out = passages.cut_passages(docs, drop)
        assert out.columns == docs.columns
        got = sorted(((r.doc_id, r.text) for r in out.collect()), key=key)
        assert got == sorted(cut(rows, drop_emptied=drop), key=key)
    left = [r for r in got if r[0] is not None]
    assert not any(any(s) for _, s, _ in shared_words(left)) or any(a[0] == b[0] for a, b in zip(left, left[1:]))


def test_fixture(spark, sf):
    check(spark, [r for r in fixtures.documents(sf) if len(r[1] or "") < 60_000])


@pytest.mark.parametrize("kinds", [5_000, 3])
def test_passages(spark, monkeypatch, kinds):
    """Passages of 45 to 300 words in new surroundings, at text ends, twice in a text, nested in one another, and periodic text."""
    monkeypatch.setattr(passages, "HOT_KINDS", kinds)
    monkeypatch.setattr(passages, "COMPARED_ROWS", 50)
    rnd = random.Random(4)
    noise = lambda n: "".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) + rnd.choice(" \n\t") + rnd.choice("éxyz ") for _ in range(n))
    texts = [noise(n) for n in (45, 49, 50, 51, 52, 70, 130, 300)]
    texts += [texts[-1][200:500], texts[-1][:300] + texts[-2]]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            parts += [noise(rnd.randint(0, 80)), rnd.choice(texts)]
        rows.append((i, "".join(parts) + noise(rnd.choice([0, 50]))))
    rows += [(1000, "a b " * 400), (1001, "a " * 49), (1002, "a " * 50), (1003, "b a " * 30), (1004, "a b " * 70 + noise(30)), rows[3], rows[3], (3, texts[-1]), (None, texts[-1]), (None, texts[-2])]
    check(spark, rows, 5)


def test_whole_copies_go(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text), (3, " \n" + text + "\n"), (4, text + " end")]
    got = {r.doc_id: r.text for r in passages.cut_passages(fixtures.frame(spark, rows), drop_emptied=True).collect()}
    assert got == {1: text, 4: " end"}


def test_empty(spark):
    docs = fixtures.frame(spark, []).filter("doc_id = 1")
    assert passages.cut_passages(docs).collect() == [] and passages.shared_spans(docs).collect() == []
