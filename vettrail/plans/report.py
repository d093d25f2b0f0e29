"""Verifications for people: plain text by tier, steps to take, evidence with invisible characters named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.requests import TIERS
from ..functions.text import visible

_STEPS = {
    "illegal": ("Don't pay or sign anything.", "Keep the message.", "Report the request to the labour authority."),
    "doubt": ("Don't send documents or personal details.", "Find the company's site yourself and ask there.", "Compare the sender's domain with it."),
    "open": ("Confirm the role on the company's own careers page.", "Ask for anything that is still open in writing."),
}


def steps(state: Column) -> Column:
    """What to do next, in order."""
    as_array = lambda k: F.array(*map(F.lit, _STEPS[k]))
    return F.when(state == "illegal", as_array("illegal")).when(state.isin("mismatch", "critical", "high"), as_array("doubt")).otherwise(as_array("open"))


def _section(title: str, findings: Column) -> Column:
    lines = F.transform(findings, lambda f: F.concat(F.lit("  ["), f["severity"], F.lit("] "), f["title"], F.when(f["evidence"] != "", F.concat(F.lit("\n      "), f["evidence"])).otherwise("")))
    return F.when(F.size(findings) > 0, F.concat(F.lit(f"{title}\n"), F.array_join(lines, "\n")))


def report(findings: Column, headline: Column, advice: Column, state: Column) -> Column:
    """One text: headline, a section per tier, the other findings, advice and steps."""
    tier = lambda f: F.coalesce(f["meta"]["tier"], F.lit(""))

    def of(name: str) -> Column:
        return F.filter(findings, lambda f: tier(f) == name)

    parts = [headline, *[_section(t.capitalize(), of(t)) for t in TIERS], _section("Also found", of("")), advice, F.concat(F.lit("Next:\n  "), F.array_join(steps(state), "\n  "))]
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), "\n\n")


def reports(verifications: DataFrame) -> DataFrame:
    """(msg_id, report, urgent): urgent where the worst finding is high or critical."""
    return verifications.select("msg_id", report(F.col("findings"), F.col("headline"), F.col("advice"), F.col("state")).alias("report"), (F.col("max_rank") >= 3).alias("urgent"))


def shown(findings: DataFrame) -> DataFrame:
    """Long-form findings whose evidence names its invisible characters."""
    return findings.withColumn("evidence", visible(F.col("evidence")))
