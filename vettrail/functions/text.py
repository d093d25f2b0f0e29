"""Text expressions: regular expressions with Unicode classes, code-point offsets, contexts."""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Case-insensitive, dot-all, Unicode classes and case.
FLAGS = "(?isuU)"


def let(value: Column, body) -> Column:
    """body(value), value computed once."""
    return F.transform(F.array(value), body)[0]


#: Unicode's space separators (Zs). F.trim alone takes U+0020 only.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    """The text without space separators at its ends."""
    return F.trim(text, F.lit(SPACES))


#: Stand for the two characters beyond ASCII that fold to ASCII letters, in texts and in patterns.
FOLDED = {"s": ("\u017f", "§"), "k": ("\u212a", "¶")}


def re2_text(text: Column) -> Column:
    """The text for patterns of as_re2: Java's \\b takes letters with accents for parts of a word, RE2's doesn't, so they
    become signs. A class of several ranges, or look-arounds at every \\b, would take four times as long."""
    signs = F.regexp_replace(text, "[^\\x00-\\x7f](?<![€£\u017f\u212a])", "¤")
    for letter, sign in FOLDED.values():
        signs = F.replace(signs, F.lit(letter), F.lit(sign))
    return signs


def as_re2(pattern: str) -> str:
    """The pattern for texts of re2_text, without the vertical tab in \\s; it may name € and £, and nothing else beyond ASCII."""
    if pattern.startswith("(?i)"):
        pattern = re.sub(r"(?<!\\)[ks]", lambda m: f"[{m[0]}{FOLDED[m[0]][1]}]", pattern).replace("a-z", "a-z§¶")
    return pattern.replace(r"\s", r"[\t\n\f\r ]")


def found(text: Column, pattern: str) -> Column:
    """The first match, null without one. Every pattern in use matches some character."""
    return F.nullif(F.regexp_extract(text, FLAGS + pattern, 0), F.lit(""))


def matches(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(FLAGS + pattern), F.lit(False))


def offset(text: Column, pattern: str, flags: str = FLAGS) -> Column:
    """Code points before the first match. Positions of regular expressions are UTF-16 units; only where the
    text has characters beyond 16 bits, the text before is measured instead."""
    wide = text.rlike(r"[\x{10000}-\x{10FFFF}]")
    return F.when(wide, F.length(F.regexp_extract(text, f"{flags}^(.*?)(?:{pattern})", 1))).otherwise(F.regexp_instr(text, F.lit(flags + pattern)) - 1)


def line_of(text: Column, at: Column) -> Column:
    """Line of a code-point offset, from 1."""
    before = F.substring(text, F.lit(1), at)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def around(text: Column, at: Column, size: Column, width: int) -> Column:
    """The code points from `width` before to `width` after a match."""
    low = F.greatest(at - width, F.lit(0))
    return F.substring(text, low + 1, at + size + width - low)


@functools.lru_cache(maxsize=4096)
def _shown(c: str) -> str:
    if c == "\n":
        return "⏎"
    if c != "\t" and unicodedata.category(c) in ("Cf", "Cc", "Co"):
        return f"⟦{unicodedata.name(c, f'U+{ord(c):04X}')}⟧"
    return c


def _visible(text: pd.Series) -> pd.Series:
    limit = 240
    return text.map(lambda t: None if t is None else "".join(map(_shown, t[:limit])) + (f" …(+{len(t) - limit} more chars)" if len(t) > limit else ""))


def visible(text: Column) -> Column:
    """Invisible characters by their Unicode names, 240 characters at most. An Arrow function: only for rows with a finding."""
    return F.pandas_udf(_visible, "string")(text)


#: Stands after every letter that carried marks: which ones doesn't matter, only that the letter isn't bare.
MARKED = "\u0301"


@functools.lru_cache(maxsize=8)
def _decompositions(letters: str) -> tuple[str, str, str, dict[str, str]]:
    """What NFKD makes of lower-case code points, by the rule itself, as far as it leads to one of `letters`.

    Returns a character class of single letters with marks, the characters that become one letter and
    those letters, and what else becomes several characters.
    """
    single, marked, many = {}, [], {}
    for code in range(0x80, 0x20000):
        c = chr(code)
        if not unicodedata.decomposition(c) or c.lower() != c:
            continue
        whole = unicodedata.normalize("NFKD", c)
        base = [x for x in whole if not unicodedata.combining(x)]
        if not any(x in letters for x in base):
            continue
        if len(base) == 1:
            single[c] = base[0]
            if len(whole) > 1:
                marked.append(code)
        else:
            many[c] = "".join(MARKED if unicodedata.combining(x) else x for x in whole)
    ranges: list[list[int]] = []
    for code in marked:  # what lies between two of one range is upper case, or has no meaning
        if ranges and all(chr(x).lower() != chr(x) or not unicodedata.name(chr(x), "") for x in range(ranges[-1][1] + 1, code)):
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges), "".join(single), "".join(single.values()), many


def decomposed(text: Column, letters: str) -> Column:
    """NFKD of the lower-cased text as far as `letters` go, every sequence of marks as MARKED. Plain ASCII, the usual case, costs one test."""
    marked, single, bases, many = _decompositions(letters)
    names = F.from_json(F.lit(json.dumps(many)), "map<string,string>")
    spelt = F.when(F.lower(text).rlike("[" + "".join(many) + "]"), F.array_join(F.transform(F.split(F.lower(text), ""), lambda c: F.coalesce(F.try_element_at(names, c), c)), "")).otherwise(F.lower(text))
    return F.when(text.rlike("[^\\x00-\\x7f]"), F.translate(F.regexp_replace(spelt, f"([{marked}])", "$1" + MARKED), single, bases)).otherwise(F.lower(text))


# Fixed values of RFC 3492.
_BASE, _LEAST, _MOST, _SKEW, _DAMP, _BIAS, _FIRST = 36, 1, 26, 38, 700, 72, 128


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    """The bias after a delta."""
    long = lambda x: F.floor(x).cast("long")
    limit = ((_BASE - _LEAST) * _MOST) // 2

    def scaled(d: Column) -> Column:
        state = F.struct(d.alias("d"), F.lit(0).cast("long").alias("k"))
        step = lambda s, _: F.when(s["d"] > limit, F.struct(long(s["d"] / (_BASE - _LEAST)).alias("d"), (s["k"] + _BASE).alias("k"))).otherwise(s)
        return F.aggregate(F.sequence(F.lit(1), F.lit(12)), state, step, lambda s: s["k"] + long((_BASE - _LEAST + 1) * s["d"] / (s["d"] + _SKEW)))

    halved = F.when(first, long(delta / _DAMP)).otherwise(long(delta / 2))
    return let(let(halved, lambda d: d + long(d / points)), scaled)


def _printable(point: Column) -> Column:
    """No control character, surrogate or private code point."""
    return (point >= 0x20) & ((point < 0x7F) | (point > 0x9F)) & ((point < 0xD800) | (point > 0xF8FF)) & (point < 0xF0000)


def from_punycode(label: Column) -> Column:
    """A label xn--... as it is shown; the label itself where it isn't Punycode."""
    body, long = F.substring(label, 5, 1 << 20), lambda x: F.lit(x).cast("long")
    cut = F.length(body) - F.length(F.substring_index(body, "-", -1))  # after the last hyphen, 0 without one
    plain = F.transform(F.filter(F.split(F.substring(body, F.lit(1), F.greatest(cut - 1, F.lit(0))), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    digits = F.transform(F.filter(F.split(F.substring(body, cut + 1, F.length(body)), ""), lambda c: c != ""), lambda c: F.position(c, F.lit("abcdefghijklmnopqrstuvwxyz0123456789")) - 1)
    state = F.struct(*(v.alias(k) for k, v in {"out": plain, "n": long(_FIRST), "i": long(0), "old": long(0), "w": long(1), "k": long(_BASE), "bias": long(_BIAS)}.items()))

    def step(s: Column, digit: Column) -> Column:
        i, t = s["i"] + digit * s["w"], F.least(F.greatest(s["k"] - s["bias"], F.lit(_LEAST)), F.lit(_MOST))
        points = (F.size(s["out"]) + 1).cast("long")
        at = i % points
        last = {
            "out": F.concat(F.slice(s["out"], F.lit(1), at.cast("int")), F.array(s["n"] + F.floor(i / points)), F.slice(s["out"], (at + 1).cast("int"), F.size(s["out"]))),
            "n": s["n"] + F.floor(i / points), "i": at + 1, "old": at + 1, "w": long(1), "k": long(_BASE), "bias": _adapted(i - s["old"], points, s["old"] == 0),
        }
        more = {"out": s["out"], "n": s["n"], "i": i, "old": s["old"], "w": s["w"] * (_BASE - t), "k": s["k"] + _BASE, "bias": s["bias"]}
        whole = lambda d: F.struct(*(v.alias(k) for k, v in d.items()))
        return F.when(digit < t, whole(last)).otherwise(whole(more))

    shown = lambda points: F.array_join(F.transform(points, lambda p: F.decode(F.unhex(F.lpad(F.hex(p), 8, "0")), "UTF-32")), "")
    valid = label.rlike("^xn--([\\x21-\\x7e]*-)?[a-z0-9]{1,59}$")
    return F.when(valid, F.aggregate(digits, state, step, lambda s: F.when((s["w"] == 1) & F.forall(s["out"], _printable), shown(s["out"])))).otherwise(F.lit(None))
