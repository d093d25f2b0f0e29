"""Whether a role is listed where its employer lists roles. The answer has three values: listed, not listed, not checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import domain as D
from ..model import finding, none

# Where careers pages are, who hosts them, what links to them, words of a title that say little.
CAREERS_PATHS = ("/careers", "/jobs", "/careers/jobs", "/about/careers", "/company/careers", "/work-with-us", "/join-us", "/opportunities")
ATS_HOSTS = (
    r"(boards\.greenhouse\.io|job-boards\.greenhouse\.io|jobs\.lever\.co|jobs\.ashbyhq\.com|\.myworkdayjobs\.com|\.icims\.com|apply\.workable\.com|"
    r"careers\.smartrecruiters\.com|jobs\.jobvite\.com|\.bamboohr\.com|\.recruitee\.com|\.teamtailor\.com|\.personio\.de|\.rippling\.com)"
)
CAREERS_LINK = r"\b(careers?|jobs?|join\s+us|work\s+(with|at)\s+us|open\s+(roles?|positions?)|we'?re\s+hiring|opportunities)\b"
STOPWORDS = ("senior", "junior", "staff", "principal", "lead", "head", "of", "the", "and", "a", "an", "i", "ii", "iii", "iv", "sr", "jr", "mid", "level")
SHARE = 0.7


def role_tokens(role: Column) -> Column:
    """Distinct telling words of a title."""
    words = F.regexp_extract_all(F.lower(role), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*STOPWORDS) & (F.length(w) > 2)))


def needed(tokens: Column) -> Column:
    """How many tokens a line must hold; halves round to even."""
    return F.greatest(F.lit(1), F.bround(F.size(tokens) * SHARE).cast("int"))


def role_present(text: Column, links: Column, role: Column) -> Column:
    """Where the role stands: the whole title in a line, then in a link's label, then most of its tokens in one short line or label. Null: nowhere."""
    tokens, title = role_tokens(role), F.lower(role)
    strip = lambda s: F.regexp_replace(s, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    lines = F.split(F.coalesce(text, F.lit("")), "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    whole = F.filter(F.transform(lines, strip), lambda s: (s != "") & F.contains(F.lower(s), title))
    label = F.filter(links, lambda x: F.contains(F.lower(F.coalesce(x["label"], F.lit(""))), title))
    every = F.concat(lines, F.flatten(F.transform(links, lambda x: F.split(F.coalesce(x["label"], F.lit("")), "\n"))))
    held = lambda s: F.aggregate(tokens, F.lit(0), lambda n, t: n + F.contains(F.lower(s), t).cast("int"))
    loose = F.filter(every, lambda s: (held(s) >= needed(tokens)) & (F.length(strip(s)) < 200))
    hit = (
        F.when(F.size(whole) > 0, F.substring(whole[0], 1, 140)).when(F.size(label) > 0, F.concat(F.substring(label[0]["label"], 1, 100), F.lit(" → "), label[0]["href"]))
        .when(F.size(loose) > 0, F.substring(strip(loose[0]), 1, 140))
    )
    return F.when(F.size(tokens) > 0, hit)


def careers_pages(domains: DataFrame, pages: DataFrame) -> DataFrame:
    """(domain, final_url, status, text, links): the careers page of each domain that has one among the rendered pages.

    Home pages are read with and without www; the first link to a host of careers pages, or to a
    careers-like address of the same site, is followed if its target was rendered, whatever its status.
    Otherwise the usual paths count, with a status below 400. A page that wasn't rendered is unreachable.
    """
    rendered = pages.withColumn("key", F.rtrim(F.col("url"), F.lit("/"))).withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("final_url"))).filter("n = 1").drop("n")
    origin = lambda prefix: F.concat(F.lit(prefix), F.col("domain"))
    origins = domains.select("domain").distinct().select("domain", F.posexplode(F.array(origin("https://"), origin("https://www."))).alias("o", "origin"))
    homes = origins.join(rendered.select(F.col("key").alias("origin"), F.col("links").alias("home_links")), "origin")
    homes = homes.withColumn("n", F.row_number().over(W.partitionBy("domain").orderBy("o"))).filter("n = 1")
    link = homes.select("domain", F.posexplode("home_links").alias("i", "link")).select("domain", "i", "link.label", "link.href")
    site = F.endswith(D.domain_of(F.col("href")), F.col("domain"))
    link = link.filter(F.startswith("href", F.lit("http")) & (F.col("href").rlike("(?i)" + ATS_HOSTS) | (F.coalesce("label", F.lit("")).rlike("(?iuU)" + CAREERS_LINK) & site)))
    followed = link.select("domain", (F.col("i") - 1_000_000).alias("order"), F.rtrim(F.col("href"), F.lit("/")).alias("key"), F.lit(999).alias("below"))
    paths = F.posexplode(F.array(*map(F.lit, CAREERS_PATHS)))
    guessed = origins.select("domain", "o", "origin", paths.alias("p", "path")).select(
        "domain", (F.col("o") * len(CAREERS_PATHS) + F.col("p")).alias("order"), F.concat("origin", "path").alias("key"), F.lit(400).alias("below")
    )
    tried = followed.union(guessed).join(rendered, "key").filter(F.col("status") < F.col("below"))
    first = tried.withColumn("n", F.row_number().over(W.partitionBy("domain").orderBy("order"))).filter("n = 1")
    return first.select("domain", "final_url", "status", "text", "links")


def judge_postings(df: DataFrame, domain: str, role: str) -> DataFrame:
    """Adds posting_checked, posting_found, careers_url, matched and posting_findings to rows that carry a careers page
    (final_url, text, links; null where none was found), which go. found is null where it isn't established."""
    c = F.col
    complete = (F.coalesce(c(domain), F.lit("")) != "") & (F.trim(F.coalesce(c(role), F.lit(""))) != "")
    df = df.withColumn("posting_checked", complete & c("final_url").isNotNull())
    df = df.withColumn("matched", F.when(c("posting_checked"), role_present(c("text"), c("links"), c(role))))
    listed = finding("POSTING_FOUND", "The role is listed by the employer", "info", "The employer's own careers page names the role.", evidence=F.concat(c("matched"), F.lit("  ("), c("final_url"), F.lit(")")), remediation="Apply through that page.", meta={"url": c("final_url")})
    missing = finding("POSTING_NOT_LISTED", "The role isn't on the careers page", "medium", "Roles are filled unlisted at times; most are listed.", evidence=F.concat(F.lit("searched "), c("final_url")), confidence=0.6, remediation="Ask for the posting's address.", meta={"url": c("final_url")})
    unseen = finding("POSTING_NOT_CHECKED", "The careers page couldn't be read", "info", "Nothing follows from this about the role.", evidence=F.concat(F.lit("no careers page found at "), c(domain)), remediation="Open the company's site yourself.")
    findings = F.when(~complete, none()).when(~c("posting_checked"), F.array(unseen)).when(c("matched").isNotNull(), F.array(listed)).otherwise(F.array(missing))
    return df.withColumns({
        "posting_found": F.when(c("posting_checked"), c("matched").isNotNull()), "posting_findings": findings, "careers_url": F.when(c("posting_checked"), c("final_url")),
    }).drop("final_url", "status", "text", "links")


def check_postings(asked: DataFrame, pages: DataFrame) -> DataFrame:
    """(domain, role, checked, found, careers_url, matched, posting_findings) of each distinct (domain, role)."""
    asked = asked.select("domain", "role").distinct()
    named = asked.filter(F.coalesce("domain", F.lit("")) != "")
    out = judge_postings(asked.join(careers_pages(named, pages), "domain", "left"), "domain", "role")
    return out.select("domain", "role", F.col("posting_checked").alias("checked"), F.col("posting_found").alias("found"), "careers_url", "matched", "posting_findings")
