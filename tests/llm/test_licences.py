"""Licence scans against plain Python."""

import re

from vettrail.llm import licences

from . import fixtures


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(licences.UPPER, licences.LOWER)))


def brute(rows):
    """Base phrases at every place; a template's label wherever its key phrase stands, and with it two of the file's rarest words of the template's indexed ones."""
    from collections import Counter

    docs = [words(t) for _, t in rows]
    df = Counter(w for d in docs for w in {*d})
    for (key, _), w in zip(rows, docs):
        base, labels, score = [], set(), 0.0
        for phrase, label in licences.BASE:
            p = phrase.split()
            base += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        for t in licences.TEMPLATES:
            rare, seen = [], set()
            for i in sorted(range(len(t.words)), key=lambda i: (df[t.words[i]], i)):
                if t.words[i] not in seen:
                    seen.add(t.words[i])
                    rare.append(i)
            rare = [i for i in rare[: licences.INDEXED] if t.words[i] in w][: licences.RARE]
            for i in range(len(w) - len(t.phrase) + 1):
                if tuple(w[i : i + len(t.phrase)]) != t.phrase:
                    continue
                off = i - t.phrase_at
                own = [0 <= off + j < len(w) and w[off + j] == x for j, x in enumerate(t.words)]
                if rare and sum(own[j] for j in rare) >= min(2, len(rare)):
                    labels.add(t.label)
                    score = max(score, sum(own) / len(own))
        at = [i for i, _ in base]
        names = {x for _, x in base}
        yield (key, len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(names)), ",".join(sorted(names | labels)),
               1.0 if base else score)


def key(r):
    return tuple((x is not None, x) for x in r)


def test_scan(spark, sf):
    rows = fixtures.documents(sf)
    rows += [
        (1, "MIT License MIT license, the GNU General\nPublic License"), (2, "licensed under CC BY-NC 4.0."), (3, "All rights reserved"), (4, "license mit"),
        (5, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"), (6, "general license"),
        (7, "Permission is hereby granted, free of charge, to any person obtaining a copy"), (8, "mit licénse Kapache license " * 50), (9, "rights reserved"),
        (910013, "# Permission is hereby granted, free of\n#  charge, to any person   obtaining\n# a copy of this software"), (910014, "Redistributions of source code must retain the above copyright notice, this list of conditions"),
        (910015, "must retain the above copyright"), (910016, "under the terms of the GNU General Public License. You should have received a copy of the GNU General Public License"),
        (910017, " * Unless required by applicable law or agreed to in writing, software\n * distributed under the License is distributed on an \"AS IS\" BASIS,\n * Licensed under the Apache License, Version 2.0"),
        (910018, "accompanying documentation covered by this license"), (910019, "obtaining a copy of this software, permission is hereby granted free of charge"),
        (10, "under the GNU Lesser General Public License"), (11, "Apache License, Version 2.0"), (12, "cc by nc"),
    ]
    got = licences.scan_licences(fixtures.frame(spark, rows).repartition(3)).collect()
    rounded = lambda r: (*r[:-1], round(r[-1], 9))
    assert sorted(map(rounded, got), key=key) == sorted(map(rounded, brute(rows)), key=key)
    labels = {r.doc_id: r.labels for r in got}
    assert {*labels.values()} >= {"mit", "bsd", "cc-by-nc", "proprietary"}
    # partial and reflowed texts
    assert [labels[910_000 + i] for i in (13, 14, 15, 16, 17, 18, 19)] == ["mit", "bsd", "", "gpl", "apache,apache-2.0", "boost", "mit"]


def test_native(spark, sf):
    plan = licences.scan_licences(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty(spark):
    assert licences.scan_licences(fixtures.frame(spark, []).filter("doc_id = 1")).collect() == []
