"""Quality rules, shards, line dedup and token files against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from vettrail.llm import linededup, quality, sharding, token_files
from vettrail.llm.bytebpe import default_vocabulary, encoder

from . import fixtures


@pytest.fixture(scope="module")
def rows(sf):
    return fixtures.documents(sf)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return fixtures.frame(spark, rows).repartition(5).cache()


def key(r):
    return tuple((x is not None, x) for x in r)


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            inside |= {*range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n


def test_quality_base_counts(spark, docs, rows, sf):
    out = quality.rate_documents(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect()), key=key)
    assert got == sorted(((i, *brute_quality(t)) for i, t in rows), key=key)


def test_quality_ratio_and_verdict(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = {r.doc_id: r for r in quality.rate_documents(docs, labels).collect()}
    marked = {r.doc_id: r for r in labels.collect()}
    clean = [i for i, r in marked.items() if r.quality == 1 and r.toxic == 0 and not out[i].base_failed]
    junk = [i for i, r in marked.items() if r.quality == 0 and not out[i].base_failed]
    assert clean and all(out[i].kept for i in clean)
    assert not junk or np.median([out[i].llr for i in junk]) < min(np.median([out[i].llr for i in clean]), quality.THRESHOLD)
    assert all(not r.kept for r in out.values() if r.base_failed)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in quality.rate_documents(docs, labels).collect() if r.kept)


def test_quality_ratio_by_hand(spark):
    """Two kinds of words, one trusted kind: the score is the mean log ratio of the shrunk counts."""
    good, bad = " ".join(["sun"] * 5), " ".join(["rain"] * 5)
    docs = spark.createDataFrame([(1, good), (2, bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.llr for r in quality.rate_documents(docs, labels).collect()}
    s = quality.SMOOTHING
    # five unigrams and four bigrams each, half of the corpus is trusted
    seen = lambda n, t: math.log((t + s) / (n * 0.5 + s))
    assert out[1] == pytest.approx((5 * seen(5, 5) + 4 * seen(4, 4)) / 9, abs=1e-6)
    assert out[2] == pytest.approx((5 * seen(5, 0) + 4 * seen(4, 0)) / 9, abs=1e-6)


def test_quality_without_trusted_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept == (not r.base_failed) for r in quality.rate_documents(docs, none).collect())


def jump(k, shards):
    k &= (1 << 64) - 1
    b, j = -1, 0
    while j < shards:
        b = j
        k = (k * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((k >> 33) + 1)))
    return b


def test_shards(docs, rows):
    out = sharding.shard_documents(docs, 40).collect()
    assert len(out) == len(rows)
    slots = defaultdict(list)
    for r in out:
        assert (r.shard, r.grown_shard) == (jump(r.doc_id or 0, 40), jump(r.doc_id or 0, 41)) and r.law == "key"
        assert r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == [*range(len(x))] for x in slots.values())
    want = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows), key=key)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in out), key=key) == want


@pytest.mark.parametrize("shards", [1, 2, 7, 1000])
def test_jump_counts(spark, shards):
    from pyspark.sql import functions as F

    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(10, 60), *(i * 0x1234567890ABC for i in range(50))]
    df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_shards(F.col("k"), shards).alias("j"))
    for r in df.collect():
        assert (r.j.shard, r.j.grown) == (jump(r.k, shards), jump(r.k, shards + 1))


def brute_lines(rows):
    strip = " \t\n\x0b\x0c\r"
    fold = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(strip).translate(fold)
            if len(k) >= 10:
                first[k] = min(first.get(k, order(i)), order(i))
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if first.get(x.strip(strip).translate(fold), order(i)) == order(i)]
        yield i, len(lines), len(lines) - len(kept), "\n".join(kept)


def test_line_dedup(docs, rows):
    got = sorted((tuple(r) for r in linededup.line_digest(docs).collect()), key=key)
    want = sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute_lines(rows)), key=key)
    assert got == want
    texts = Counter((r.doc_id, r.text or "") for r in linededup.apply_bitmaps(docs).collect())
    assert texts == Counter((i, t) for i, _, _, t in brute_lines(rows))


def test_line_dedup_of_one_hot_line(spark):
    """One key over every partition boundary."""
    rows = [(i % 977, "a very common line of text\nown line number %d" % i) for i in range(3000)]
    out = linededup.line_digest(fixtures.frame(spark, rows).repartition(7)).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in out) == sorted((i, n, d) for i, n, d, _ in brute_lines(rows))


def test_token_files(spark, docs, rows):
    out = sorted((tuple(r) for r in token_files.token_table(docs).collect()), key=lambda r: r[1])
    tokenizer = encoder(default_vocabulary()).tokenizer
    ids = [e.ids + [0] for e in tokenizer.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(rows, ids))
    assert Counter((i, n, c) for i, _, n, c in out) == want
    at = 0
    for _, start, n, _ in out:
        assert start == at
        at += n
    order = [(r[0] is not None, r[0] or 0) for r in out]
    assert order == sorted(order)


def test_empty_tables(spark):
    empty = fixtures.frame(spark, []).filter("doc_id = 1")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (quality.rate_documents(empty, labels), quality.keep_good(empty, labels), sharding.shard_documents(empty), linededup.line_digest(empty),
                linededup.apply_bitmaps(empty), token_files.token_table(empty)):
        assert out.collect() == []
