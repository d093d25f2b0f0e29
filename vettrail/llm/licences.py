"""Licence scans by a positional rare-token index, DataFrame functions only.

The templates are notices, openings and clauses of well-known licences. Their words are the licence
vocabulary, a few hundred at most. One pass counts, over all documents, in how many each of them occurs,
which ranks them by inverse document frequency. The index holds, for the INDEXED rarest words of each
template, their postings (template, position). A scan looks up the licence words that a file has: of each
template's indexed words the file's own RARE of highest inverse document frequency are taken, so a partial
text is found by the rare words that it has and not by those that it should have. Each of their occurrences
places the template at an offset (file position less template position). Postings are intersected by
relative position: an offset stays when IN_PLACE of those words stand at it together, and counts where the
template's mandatory key phrase stands word for word. Words alone are compared, so line breaks, comment
signs and punctuation don't matter. Everything happens inside the row: no shuffle, and nothing that
grows with the corpus leaves the executors.

Defined results: a null text is empty and has no words, no label and a score of 0. Several matches
of one licence are one label; the score is the best match's share of template words found in place, or 1 with a
base phrase. An empty table gives no rows; repeated rows are scanned alike; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of digits, letters a-z and everything beyond ASCII, after A-Z is lower-cased.
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrases and labels (fixed values).
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    #: The mandatory key phrase, words of the template that must stand unchanged.
    phrase: tuple[str, ...]

    @property
    def phrase_at(self) -> int:
        n = len(self.phrase)
        return next(i for i in range(len(self.words) - n + 1) if self.words[i : i + n] == self.phrase)


def _template(label: str, text: str, phrase: str) -> Template:
    return Template(label, tuple(text.split()), tuple(phrase.split()))


#: Notices and marking sentences of well-known licences, as words (fixed values).
TEMPLATES = (
    _template("mit", "released under the mit license", "mit license"),
    _template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    _template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    _template("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    _template("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    _template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    _template("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    _template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    _template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    _template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee is hereby granted"),
    _template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    _template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    _template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    _template("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    _template("proprietary", "all rights reserved", "all rights reserved"),
    _template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included in all copies or substantial portions"),
    _template("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "distributed under the license is distributed on an as is basis"),
    _template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "under the terms of the gnu general public license"),
    _template("gpl", "you should have received a copy of the gnu general public license along with this program", "received a copy of the gnu general public license"),
    _template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", "this source code form is subject to the terms"),
    _template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "must retain the above copyright notice this list of conditions"),
    _template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "may be used to endorse or promote products derived"),
    _template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "in no event will the authors be held liable"),
    _template("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "accompanying documentation covered by this license"),
    _template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
)

#: Words of a template that are indexed, rarest first; how many of those that a file has are looked up; how many of these must stand in place (all, where a file has fewer).
INDEXED, RARE, IN_PLACE = 10, 4, 2


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPLIT), lambda w: w != "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def rare_tokens(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[Template, list[int]]:
    """Positions of each template's indexed words, rarest first, by document frequencies over all rows; of a word that stands twice, the first."""
    vocabulary = sorted({w for t in templates for w in t.words})
    found = docs.select(F.explode(F.array_distinct(F.filter(words_of(F.col("text")), lambda w: w.isin(vocabulary)))).alias("word"))
    df = {r["word"]: r["count"] for r in found.groupBy("word").count().collect()}  # as many rows as the vocabulary has words
    n = docs.count()
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in vocabulary}
    return {t: sorted({w: i for i, w in reversed([*enumerate(t.words)])}.values(), key=lambda i: (-idf[t.words[i]], i))[:INDEXED] for t in templates}


def _scan(words: Column, index: dict[Template, list[int]]) -> Column:
    """Struct of the outcome for one file's words."""
    tokens = sorted({t.words[i] for t, at in index.items() for i in at} | {"license"})
    spot = lambda at, word: F.get(words, at) == word
    hits = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("p"), w.alias("w"))), lambda x: x["w"].isin(tokens))

    def base(found: Column) -> Column:
        def label(x: Column) -> Column:
            out = F.lit(None).cast("struct<label:string,at:int>")
            for phrase, name in BASE:
                *rest, last = phrase.split()
                n = len(rest)
                ok = x["w"] == last
                for i, w in enumerate(rest):
                    ok = ok & F.coalesce(spot(x["p"] - (n - i), w), F.lit(False))
                out = F.when(ok, F.struct(F.lit(name).alias("label"), (x["p"] - n).alias("at"))).otherwise(out)
            return out

        return F.filter(F.transform(found, label), lambda x: x.isNotNull())

    def placed(found: Column, own: Column, t: Template, at: list[int]) -> Column:
        """(label, score) of each offset at which enough of the file's rare words and the key phrase stand. own: the indexed words that the file has."""
        inside = lambda off, i: F.coalesce(spot(off + i, t.words[i]), F.lit(False))

        def phrase(off: Column) -> Column:
            ok = F.lit(True)
            for j in range(len(t.phrase)):
                ok = ok & inside(off, t.phrase_at + j)
            return ok

        share = lambda off: sum((inside(off, i).cast("int") for i in range(len(t.words))), F.lit(0)) / F.lit(float(len(t.words)))
        # postings of the template, rarest first
        postings = F.array(*[F.struct(F.lit(t.words[i]).alias("w"), F.lit(i).alias("i")) for i in at])

        def intersected(rare: Column) -> Column:
            offsets = F.flatten(F.transform(rare, lambda x: F.transform(F.filter(found, lambda h: h["w"] == x["w"]), lambda h: h["p"] - x["i"])))
            stand = lambda off: F.size(F.filter(rare, lambda x: F.coalesce(F.get(words, off + x["i"]) == x["w"], F.lit(False)))) >= F.least(F.lit(IN_PLACE), F.size(rare))
            return F.transform(F.filter(F.array_distinct(offsets), lambda off: stand(off) & phrase(off)), lambda off: F.struct(F.lit(t.label).alias("label"), share(off).alias("score")))

        # without the phrase's words there is nothing to place
        needed = [w for w in dict.fromkeys(t.phrase) if w in tokens]
        hopeful = F.size(F.array_intersect(own, F.array(*map(F.lit, needed)))) == len(needed) if needed else F.lit(True)
        rare = F.slice(F.filter(postings, lambda x: F.array_contains(own, x["w"])), 1, RARE)
        return F.when(hopeful, _let(rare, intersected)).otherwise(F.array().cast("array<struct<label:string,score:double>>"))

    def outcome(found: Column) -> Column:
        matches = _let(F.array_distinct(F.transform(found, lambda h: h["w"])), lambda own: F.flatten(F.array(*[placed(found, own, t, at) for t, at in index.items()])))
        return _let(base(found), lambda b: _let(matches, lambda m: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.size(b).cast("long").alias("n_base"),
            F.array_min(F.transform(b, lambda x: x["at"])).cast("long").alias("first_word"),
            F.array_max(F.transform(b, lambda x: x["at"])).cast("long").alias("last_word"),
            F.array_join(F.array_sort(F.array_distinct(F.transform(b, lambda x: x["label"]))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_distinct(F.concat(F.transform(b, lambda x: x["label"]), F.transform(m, lambda x: x["label"])))), ",").alias("labels"),
            F.when(F.size(b) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(m, lambda x: x["score"])), F.lit(0.0))).alias("score"),
        )))

    return F.when(F.exists(words, lambda w: w.isin(tokens)), _let(hits, outcome)).otherwise(F.struct(
        F.size(words).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"),
        F.lit(None).cast("long").alias("last_word"), F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"),
    ))


def scan_licences(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, word counts, base phrases, labels and score of every row."""
    index = rare_tokens(docs, templates)
    scanned = docs.select("doc_id", _let(words_of(F.col("text")), lambda w: _scan(w, index)).alias("r"))
    return scanned.select("doc_id", "r.*")
