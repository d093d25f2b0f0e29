"""Characters that hide, reorder or imitate text."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import finding, present
from .domain import LOOKALIKES
from .text import around, let, line_of, offset

# Invisible characters and their names, direction controls, the tag block.
ZERO_WIDTH = {
    "​": "ZERO WIDTH SPACE", "‌": "ZERO WIDTH NON-JOINER", "‍": "ZERO WIDTH JOINER", "⁠": "WORD JOINER",
    "﻿": "ZERO WIDTH NO-BREAK SPACE (BOM)", "­": "SOFT HYPHEN", "᠎": "MONGOLIAN VOWEL SEPARATOR",
}
ORDINARY_RESIDUE = "﻿­"
BIDI = "‪‫‬‭‮⁦⁧⁨⁩"
OVERRIDES = "‭‮"
TAGS = r"[\x{E0000}-\x{E007F}]"
#: White space as str.split() sees it.
SPACE = r"[\s\x1c-\x1f]"

_TAG_FROM = "".join(chr(0xE0000 + i) for i in range(128))
_TAG_TO = "".join(chr(i) for i in range(128))


@functools.cache
def _right_to_left() -> str:
    """Character class of all code points of direction R or AL, as ranges."""
    ranges: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.bidirectional(chr(c)) in ("R", "AL"):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def decode_tags(text: Column) -> Column:
    """The ASCII text that tag characters carry."""
    only = F.regexp_replace(text, r"[^\x{E0000}-\x{E007F}]", "")
    return F.translate(only, _TAG_FROM[1:], _TAG_TO[1:])


def tag_block(text: Column) -> Column:
    def made(m: Column) -> Column:
        n, payload, at = m["n"], m["payload"], m["at"]
        shown = F.trim(F.regexp_replace(payload, r"[^\x20-\x7E]", ""))
        return finding(
            "UNICODE_TAG_SMUGGLING", "Invisible text in tag characters", "critical", F.concat(n.cast("string"), F.lit(" tag characters, which no program displays.")), layer="hidden",
            evidence=F.when(shown != "", F.concat(F.lit("carries: "), shown)).otherwise(F.concat(n.cast("string"), F.lit(" tag characters, nothing printable"))),
            location=F.concat(F.lit("line "), line_of(text, at).cast("string"), F.lit(", char offset "), at.cast("string")),
            remediation="Keep the file as evidence; such characters have no honest use here.", meta={"count": n, "decoded_payload": payload},
        )

    measured = F.struct(_count(text, TAGS).alias("n"), decode_tags(text).alias("payload"), offset(text, TAGS, "(?s)").alias("at"))
    return F.when(text.rlike(TAGS), let(measured, made))


def zero_width(text: Column) -> Column:
    signs = list(ZERO_WIDTH)
    one = {c: f"\\x{{{ord(c):X}}}" for c in signs}

    def made(counts: Column) -> Column:
        n = {c: counts[i] for i, c in enumerate(signs)}
        # the most frequent one; of equals the one seen first
        worst = F.array_max(F.array(*[F.when(n[c] > 0, F.struct(n[c].alias("n"), (-F.instr(text, c)).alias("p"))) for c in signs]))
        names = F.array_join(F.filter(F.array(*[F.when(n[c] > 0, F.concat(F.lit(f"{ZERO_WIDTH[c]}×"), n[c].cast("string"))) for c in sorted(signs)]), lambda x: x.isNotNull()), ", ")
        ordinary = sum((n[c] for c in signs if c in ORDINARY_RESIDUE), F.lit(0))
        total = sum(n.values(), F.lit(0))
        return let(F.struct((-worst["p"] - 1).alias("at"), names.alias("names"), total.alias("total"), ordinary.alias("ordinary")), found)

    def found(m: Column) -> Column:
        total, at = m["total"], m["at"]
        rank = F.when((total <= 3) & (m["ordinary"] == total), 0).when(total >= 20, 3).otherwise(1)
        return finding(
            "ZERO_WIDTH_CHARS", "Zero-width characters", rank, F.concat(total.cast("string"), F.lit(" invisible formatting characters: "), m["names"]), layer="hidden",
            evidence=around(text, at, F.lit(0), 60), location=F.concat(F.lit("first at line "), line_of(text, at).cast("string")),
            remediation=F.when(rank <= 1, "Usually left over from copying.").otherwise("Extract and read the sequence first."), meta={"total": total, "breakdown": m["names"]},
        )

    return F.when(text.rlike("[" + "".join(one.values()) + "]"), let(F.array(*[_count(text, one[c]) for c in signs]), made))


def bidi(text: Column) -> Column:
    def made(m: Column) -> Column:
        n, over, at = m["n"], m["over"], m["at"]
        rank = F.when(over > 0, 3).when(text.rlike(_right_to_left()), 0).otherwise(2)
        return let(rank, lambda r: finding(
            "BIDI_CONTROL_CHARS", "Characters that change the direction of text", r, F.concat(n.cast("string"), F.lit(" direction controls: what is read may differ from what is stored.")), layer="hidden",
            evidence=around(text, at, F.lit(0), 60), location=F.concat(F.lit("first at line "), line_of(text, at).cast("string")), confidence=0.95,
            remediation="Compare the stored order with the displayed one.", meta={"count": n, "overrides": over},
        ))

    measured = F.struct(_count(text, f"[{BIDI}]").alias("n"), _count(text, f"[{OVERRIDES}]").alias("over"), offset(text, f"[{BIDI}]", "(?s)").alias("at"))
    return F.when(text.rlike(f"[{BIDI}]"), let(measured, made))


def homoglyphs(text: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0))
    look = f"[{''.join(LOOKALIKES)}]"

    def made(odd: Column) -> Column:
        n = F.size(odd)
        return F.when(n > 0, finding(
            "HOMOGLYPH_SUBSTITUTION", "Look-alike characters inside Latin words", F.when(n > 2, 3).otherwise(2), F.concat(n.cast("string"), F.lit(" word(s) mix Latin letters with look-alikes.")),
            evidence=F.array_join(F.slice(odd, 1, 4), ", "), confidence=0.9, remediation="Type the words anew before comparing them.", meta={"count": n, "words": F.array_join(F.slice(odd, 1, 20), " ")},
        ))

    return F.when(text.rlike(look), let(F.filter(words, lambda w: w.rlike("[A-Za-z]") & w.rlike(look)), made))


def run_all(text: Column) -> Column:
    """Findings of all four checks, in that order."""
    return present(tag_block(text), zero_width(text), bidi(text), homoglyphs(text))
