"""Flat texts: Unicode and instruction findings with a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import instructions, unicode
from ..model import by_severity_and_code, max_rank

HEADLINES = {
    4: "Concealed instructions to automated screening were found.", 3: "Content that people can't see, or edits, were found.",
    2: "Small anomalies were found; most have ordinary reasons.", 0: "No sign of manipulation was found.",
}


def verdict(findings: Column) -> Column:
    rank = max_rank(findings)
    return F.when(rank >= 3, "manipulated").when(rank == 2, "review").otherwise("clean")


def headline(findings: Column) -> Column:
    rank = max_rank(findings)
    return F.when(rank == 4, HEADLINES[4]).when(rank == 3, HEADLINES[3]).when(rank == 2, HEADLINES[2]).otherwise(HEADLINES[0])


def scan_texts(df: DataFrame, text: str = "text", layer: str | Column = "unknown") -> DataFrame:
    """Adds findings, verdict, headline, n_chars and n_words of each text; null counts as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    layer = layer if isinstance(layer, Column) else F.lit(layer)
    df = df.withColumn("findings", by_severity_and_code(F.concat(unicode.run_all(body), instructions.scan(body, layer))))
    words = F.size(F.regexp_extract_all(body, F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0)))
    return df.withColumns({"verdict": verdict(F.col("findings")), "headline": headline(F.col("findings")), "chars": F.length(body), "words": words})
