"""What SQL can say of queries that it can't express as a whole, and a plain Python count of op1's ratio, over whole tables."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from vettrail.llm import common, quality, queries

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[^\x20\x09-\x0D]"

RULES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{SPACE}+') AS a, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{SPACE}')) AS l FROM d),
n AS (SELECT doc_id, a, unnest(range(1, len(a) - 6)) AS i FROM w WHERE len(a) >= 8),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a[i:i + 7]) AS c FROM n) x WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) AS k FROM r, range(8) t(j) GROUP BY doc_id)
SELECT w.doc_id, len(a) AS n_words, length(array_to_string(a, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.k, 0) AS n_repeat_words, len(a) < 20 OR 100 * coalesce(c.k, 0) > 30 * len(a) AS base_failed
FROM w LEFT JOIN c ON c.doc_id = w.doc_id
"""

LICENCES = f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS a FROM documents),
p AS (SELECT doc_id, unnest(list_concat(
  list_transform(list_filter(range(1, len(a) + 1), lambda i: a[i] = 'mit' AND a[i + 1] = 'license'), lambda i: {{'at': i - 1, 'label': 'mit'}}),
  list_transform(list_filter(range(1, len(a) + 1), lambda i: a[i] = 'apache' AND a[i + 1] = 'license'), lambda i: {{'at': i - 1, 'label': 'apache'}}),
  list_transform(list_filter(range(1, len(a) + 1), lambda i: a[i] = 'general' AND a[i + 1] = 'public' AND a[i + 2] = 'license'), lambda i: {{'at': i - 1, 'label': 'gpl'}}))) AS x FROM w)
SELECT w.doc_id, len(any_value(a)) AS n_words, count(x) AS n_base, min(x.at) AS first_word, max(x.at) AS last_word, coalesce(string_agg(DISTINCT x.label, ',' ORDER BY x.label), '') AS base_labels
FROM w LEFT JOIN p ON p.doc_id = w.doc_id GROUP BY w.doc_id
"""

SIZES = "SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size FROM documents"


@pytest.mark.parametrize("query,sql", [(queries.op1_quality_rules, RULES), (queries.op3_licence_scan, LICENCES), (queries.op2_sharding, SIZES)], ids=["rules", "licences", "sizes"])
def test_columns(spark, sf, query, sql):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    twin = c.sql(sql)
    got = sorted(tuple(r) for r in query(spark, sf).select(*twin.columns).collect())
    assert got == sorted(twin.fetchall()) and got


def mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = ((x ^ x >> shift) * factor) % (1 << 64)
    return x


def hashed(word):
    total = sum(int(common.BYTE_VALUES[b]) * pow(common._BASE, i, 1 << 64) for i, b in enumerate(word.encode()))
    return mixed((total + len(word.encode()) * 0xD6E8FEB86659FD93) % (1 << 64))


def grams(text):
    words = [hashed(w) for w in re.findall(SPACE + "+", text or "")]
    return [mixed(h) >> 48 for h in words] + [mixed((a * 0x9E3779B97F4A7C15 + b) % (1 << 64)) >> 48 for a, b in zip(words, words[1:])]


def test_ratio_over_the_whole_table(spark, sf):
    c = duckdb.connect()
    docs = c.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    trusted = {i for (i,) in c.sql(f"SELECT doc_id FROM '{sf}/labels.parquet' WHERE quality = 1 AND coalesce(toxic, 0) = 0").fetchall()}
    assert trusted and len(trusted) < quality.TRUSTED_ROWS
    own = {i: [g % quality.BUCKETS for g in grams(t)] for i, t in docs}
    corpus, good = Counter(g for x in own.values() for g in x), Counter(g for i, x in own.items() if i in trusted for g in x)
    share = sum(good.values()) / sum(corpus.values())
    ratio = {g: math.log((good[g] + quality.SMOOTHING) / (n * share + quality.SMOOTHING)) for g, n in corpus.items()}
    rows = queries.op1_quality_rules(spark, sf).collect()
    assert len(rows) == len(docs) and {r.kept for r in rows} == {True, False}
    for r in rows:
        want = float(np.mean([ratio[g] for g in own[r.doc_id]])) if own[r.doc_id] else 0.0
        assert abs(r.llr - want) < 2e-6
        assert r.kept == (not r.base_failed and round(want, 6) >= quality.THRESHOLD) or abs(want - quality.THRESHOLD) < 2e-6
