"""Employers from recorded searches: does one exist, and which domain is its own?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import domain as D
from ..model import finding, none

# Sites that describe companies, the query's wording, weights.
AGGREGATORS = (
    "linkedin.com", "glassdoor.com", "indeed.com", "crunchbase.com", "zoominfo.com", "bloomberg.com", "wikipedia.org", "facebook.com",
    "twitter.com", "x.com", "instagram.com", "youtube.com", "reddit.com", "medium.com", "github.com", "trustpilot.com", "yelp.com", "bbb.org",
    "dnb.com", "pitchbook.com", "levels.fyi", "builtin.com", "wellfound.com", "angel.co", "ziprecruiter.com", "monster.com", "dice.com",
    "simplyhired.com", "jobs.lever.co", "greenhouse.io",
)
QUERY = "{} official website careers"
NAME_BONUS, DEFAULT_WEIGHT, MOST_CONFIDENT, RESULTS = 1.5, 0.5, 0.95, 6


def query_of(company):
    return F.lower(F.trim(F.concat(company, F.lit(QUERY.removeprefix("{}")))))


def candidate_domains(companies: DataFrame, results: DataFrame) -> DataFrame:
    """(company, base, score, rank): how likely each domain is the company's own. Scores add up in thousandths, so their order never matters."""
    asked = companies.select("company", query_of(F.col("company")).alias("query"))
    r = asked.join(results.withColumn("query", F.lower(F.trim("query"))).filter(F.col("rank") <= RESULTS), "query")
    r = r.withColumn("d", D.domain_of(F.coalesce("url", F.lit("")))).filter("d <> ''")
    r = r.withColumns({"name": D.name_of(F.col("d")), "tld": D.suffix_of(F.col("d")), "token": D.company_token(F.col("company"))})
    r = r.withColumn("base", D.base_domain(F.col("name"), F.col("tld")))
    r = r.filter(~F.col("base").isin(*AGGREGATORS) & ~F.col("d").isin(*AGGREGATORS) & ~F.col("base").isin(*D.FREE_MAIL))
    weight = F.when(F.coalesce("score", F.lit(0.0)) == 0, F.lit(DEFAULT_WEIGHT)).otherwise(F.col("score"))
    bonus = F.when((F.col("token") != "") & F.contains(D.company_token(F.col("name")), F.col("token")), NAME_BONUS).otherwise(0.0)
    scored = r.withColumn("w", F.round((weight + bonus) * 1000).cast("long"))
    return scored.groupBy("company", "base").agg((F.sum("w") / 1000.0).alias("score"), F.min("rank").alias("rank"))


def verify_employers(companies: DataFrame, searched: DataFrame, results: DataFrame) -> DataFrame:
    """(company, likely_domain, confidence, checked, sources, note, employer_findings), one row per distinct company.

    `searched` says which queries ran: an unsearched company is not checked, a searched one without
    results has no footprint. The two are never the same.
    """
    companies = companies.select("company").distinct()
    named = companies.filter(F.trim(F.coalesce("company", F.lit(""))) != "")
    top = W.partitionBy("company").orderBy(F.desc("score"), "rank", "base")
    scores = candidate_domains(named, results)
    best = scores.withColumns({"n": F.row_number().over(top), "total": F.sum("score").over(W.partitionBy("company"))}).filter("n = 1").select("company", "base", "score", "total")
    hits = results.withColumn("query", F.lower(F.trim("query"))).filter(F.col("rank") <= RESULTS)
    sources = hits.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda x: x["url"]).alias("sources"))
    ran = searched.select(F.lower(F.trim("query")).alias("query"), "checked").groupBy("query").agg(F.max("checked").alias("checked"))
    out = companies.withColumn("query", query_of(F.coalesce("company", F.lit("")))).join(ran, "query", "left").join(sources, "query", "left").join(best, "company", "left")
    blank, checked, c = F.trim(F.coalesce("company", F.lit(""))) == "", F.coalesce("checked", F.lit(False)), F.col
    sources, company = F.coalesce("sources", F.array().cast("array<string>")), F.coalesce("company", F.lit(""))
    confidence = F.least(F.lit(MOST_CONFIDENT), c("score") / c("total"))
    not_checked = finding("EMPLOYER_NOT_CHECKED", "The company wasn't looked up", "info", "No search was made; this is not a clean result.", evidence=F.concat(F.lit("query: "), c("query")), remediation="Search for the company yourself.")
    missing = finding("EMPLOYER_NO_FOOTPRINT", F.concat(F.lit("No public trace of "), company), "high", "A search for the company found nothing.", evidence=F.concat(F.lit("query: "), c("query")), confidence=0.8, remediation="Ask for the registered legal name.")
    profiles = finding("EMPLOYER_NO_OWN_SITE", F.concat(company, F.lit(" appears on profile sites only")), "medium", "No site of the company's own was found.", evidence=F.array_join(F.slice(sources, 1, 3), "; "), confidence=0.7, remediation="Ask for the website.")
    own = finding("EMPLOYER_DOMAIN_IDENTIFIED", F.concat(company, F.lit(" seems to run "), c("base")), "info", "Compare this domain with the sender's.", evidence=c("base"), confidence=confidence, remediation="Type it in yourself.", meta={"domain": c("base")})
    state = F.when(blank, "blank").when(~checked, "not_checked").when(F.size(sources) == 0, "no_footprint").when(c("base").isNull(), "no_own_site").otherwise("found")
    out = out.withColumn("state", state)
    return out.select(
        "company", F.when(c("state") == "found", c("base")).alias("likely_domain"),
        F.when(c("state") == "found", confidence).when(c("state") == "no_own_site", 0.3).otherwise(0.0).alias("confidence"),
        (~blank & checked).alias("checked"), sources.alias("sources"), c("state").alias("note"),
        F.when(c("state") == "not_checked", F.array(not_checked)).when(c("state") == "no_footprint", F.array(missing)).when(c("state") == "no_own_site", F.array(profiles))
        .when(c("state") == "found", F.array(own)).otherwise(none()).alias("employer_findings"),
    )
