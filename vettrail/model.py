"""Severities, findings and the schemas of the tables that queries read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordered severities (fixed values); always aggregate on the rank, the labels sort otherwise.
SEVERITIES = ("info", "low", "medium", "high", "critical")
RANK = {s: i for i, s in enumerate(SEVERITIES)}
LAYERS = ("visible", "hidden", "metadata", "unknown")

FINDING = (
    "struct<code:string,title:string,severity:string,rank:int,layer:string,detail:string,evidence:string,"
    "location:string,confidence:double,remediation:string,meta:map<string,string>>"
)
FINDINGS = f"array<{FINDING}>"

OUTREACH = (
    "msg_id string, sender string, claimed_company string, message string, role string, attestation string, "
    "recipient_email string, offer_received boolean, check_posting boolean, document_id string"
)
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
SPANS = (
    "document_id string, span_idx int, page int, text string, font string, size double, color_rgb int, alpha int, "
    f"render_mode int, bbox {BOX}, page_rect {BOX}"
)
METADATA = "document_id string, metadata map<string,string>"
SEARCHED = "query string, checked boolean"
RESULTS = "query string, rank int, title string, url string, content string, score double"
PAGES = "origin string, url string, final_url string, status int, title string, text string, links array<struct<label:string,href:string>>, engine string"
KEYS = "domain string, kid string, alg string, public_key string, created string"


def severity(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank + 1)


def finding(
    code: str | Column, title: str | Column, rank: str | Column, detail: str | Column, *, layer: str | Column = "visible", evidence: Column | None = None,
    location: Column | None = None, confidence: float | Column = 1.0, remediation: str | Column = "", meta: dict[str, Column] | None = None,
) -> Column:
    """One finding as a struct; rank is a severity's name or a column of ranks."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    rank = F.lit(RANK[rank]) if isinstance(rank, str) else rank
    pairs = [x for k, v in (meta or {}).items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(
        as_column(code).alias("code"), as_column(title).alias("title"), severity(rank).alias("severity"), rank.cast("int").alias("rank"), as_column(layer).alias("layer"),
        as_column(detail).alias("detail"), (F.lit("") if evidence is None else evidence).alias("evidence"), (F.lit("") if location is None else location).alias("location"),
        as_column(confidence).cast("double").alias("confidence"), as_column(remediation).alias("remediation"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("meta"),
    )


def present(*candidates: Column) -> Column:
    """Array of the candidates that aren't null, in order."""
    return F.filter(F.array(*candidates), lambda x: x.isNotNull())


def none() -> Column:
    return F.array().cast(FINDINGS)


def by_severity(findings: Column) -> Column:
    """Stable order by falling severity."""

    def of(rank: int) -> Column:
        return F.filter(findings, lambda x: x["rank"] == rank)

    return F.concat(*[of(r) for r in reversed(range(len(SEVERITIES)))])


def by_severity_and_code(findings: Column) -> Column:
    """Order by falling severity, then code; the position breaks ties."""

    def ordered(f: Column) -> Column:
        keys = F.transform(f, lambda x, i: F.struct((-x["rank"]).alias("k"), x["code"].alias("c"), i.alias("i")))
        return F.transform(F.array_sort(keys), lambda k: f[k["i"]])

    return F.transform(F.array(findings), ordered)[0]


def max_rank(findings: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(findings, lambda x: x["rank"])), F.lit(0))
