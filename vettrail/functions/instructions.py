"""Instructions to a machine reader; what one means depends on the layer it stands in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import finding, none, present
from .text import around, found, let, matches, offset

# Name, whether it is critical wherever it isn't visible, pattern.
PATTERNS = (
    ("instruction_override", False,
     r"\b(ignore|disregard|forget|override|bypass)\b[^.\n]{0,40}?\b(previous|prior|above|earlier|all|any|system|initial)\b[^.\n]{0,30}?"
     r"\b(instruction|prompt|rule|direction|context|guideline|command)s?\b"),
    ("scoring_directive", False,
     r"\b(rate|score|rank|grade|classify|mark|evaluate)\b[^.\n]{0,50}?\b(10\s*/\s*10|100\s*%|highest|top|maximum|perfect|strong\s+hire|"
     r"excellent|best|first|number\s+one)\b"),
    ("advancement_directive", False,
     r"\b(must|should|always|immediately|be\s+sure\s+to)\b[^.\n]{0,40}?\b(advance|shortlist|forward|recommend|interview|hire|select|move\s+(this|the)\s+candidate)\b"),
    ("ai_addressed", False,
     r"\b(as\s+an?\s+(ai|language\s+model|assistant)|if\s+you\s+are\s+an?\s+(ai|llm)|dear\s+(ai|llm|chatgpt|claude|gpt|model|assistant|bot)|"
     r"attention\s*:?\s*(ai|llm|automated\s+system)|note\s+to\s+(the\s+)?(ai|llm|reviewer\s+bot|screening\s+system))\b"),
    ("role_hijack", False,
     r"\b(you\s+are\s+now|new\s+(instruction|task|role|persona)|system\s*:\s|assistant\s*:\s|<\s*\|?\s*(im_start|system|endoftext)\s*\|?\s*>|"
     r"\[\s*system\s*\]|###\s*instruction)"),
    ("qualification_assertion", False,
     r"\b(this\s+candidate\s+(is|meets|exceeds)|the\s+applicant\s+(is|meets))\b[^.\n]{0,60}?\b(qualified|ideal|perfect|all\s+(the\s+)?requirements|best\s+fit|top\s+\d+)\b"),
    ("keyword_stuffing_marker", False, r"(keywords?\s*(for\s*)?(ats|bot|scanner|parser)\s*:|ats\s*keywords?\s*:|hidden\s+keywords?\s*:)"),
    ("exfiltration_attempt", True, r"\b(print|output|reveal|repeat|show|disclose)\b[^.\n]{0,40}?\b(system\s+prompt|your\s+instructions|the\s+prompt|configuration)\b"),
)
DISCUSSION = (
    r"\b(defend|defence|defense|mitigat|protect|prevent|detect|guard|harden|red[\s-]?team|pen[\s-]?test|research|audit|vulnerabilit|attack\s+surface|"
    r"built|designed|implemented|published|paper|thesis|talk|workshop|owasp|llm0?1|jailbreak\s+detection)\w*"
)


def verdict(layer: Column, discussed: Column, critical: bool) -> tuple[Column, Column]:
    """Rank and confidence of an instruction in a layer."""
    rank = F.when(layer == "hidden", 4).when(layer == "metadata", 3).when((layer == "visible") & discussed, 0).when(layer == "visible", 1).otherwise(2)
    if critical:
        rank = F.when(layer != "visible", 4).otherwise(rank)
    confidence = F.when(layer == "hidden", 1.0).when(layer == "metadata", 0.95).when((layer == "visible") & discussed, 0.3).when(layer == "visible", 0.5).otherwise(0.6)
    return rank, confidence


def _finding(text: Column, layer: Column, name: str, rank: Column, confidence: Column) -> Callable[[Column], Column]:
    """The finding for a match (hit, at)."""

    def made(m: Column) -> Column:
        hit, at, size = m["hit"], m["at"], F.length(m["hit"])
        evidence = F.concat(
            F.when(at > 70, "…").otherwise(""), F.replace(around(text, at, size, 70), F.lit("\n"), F.lit("⏎")), F.when(at + size + 70 < F.length(text), "…").otherwise("")
        )
        return finding(
            f"INJECTION_{name.upper()}", f"Instruction to a machine reader: {name.replace('_', ' ')}", rank, "Text that addresses whatever reads the file, not a person.", layer=layer,
            evidence=evidence, location=F.concat(F.lit("char offset "), at.cast("string")), confidence=confidence,
            remediation=F.when(rank >= 3, "Show it to a person and keep the file.").otherwise("Nothing to do; noted for completeness."),
            meta={"pattern": F.lit(name), "matched": F.substring(hit, 1, 200), "offset": at},
        )

    return made


def scan(text: Column, layer: Column) -> Column:
    """One finding per pattern, at its first match."""

    def each(discussed: Column) -> Column:
        out = []
        for name, critical, pattern in PATTERNS:
            rank, confidence = verdict(layer, discussed, critical)
            match = F.struct(found(text, pattern).alias("hit"), offset(text, pattern).alias("at"))
            out.append(F.when(matches(text, pattern), let(match, _finding(text, layer, name, rank, confidence))))
        return present(*out)

    return F.when(F.trim(text) != "", let(matches(text, DISCUSSION), each)).otherwise(none())
