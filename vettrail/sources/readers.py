"""Recorded searches, key documents, span tables, uploads and raw pages as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_HIT = "struct<title:string,url:string,content:string,raw_content:string,score:double>"
_RECORDED = f"query string, kw struct<max_results:int>, response struct<query:string,results:array<{_HIT}>>"
_KEYS = "domain string, version string, note string, keys array<struct<kid:string,alg:string,public_key:string,created:string>>"
#: Fixed values of uploads and pages.
UPLOAD_BYTES, LINKS, LABEL = 15 * 1024 * 1024, 400, 160


def read_searches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(searched, results) of recorded searches, one JSON file each. Unreadable files are left out; of equal queries the first file counts."""
    from pyspark.sql import Window as W

    files = spark.read.schema(_RECORDED + ", _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    files = files.withColumn("file", F.input_file_name()).filter("_corrupt is null and response is not null")
    query = F.lower(F.trim(F.coalesce("query", F.col("response.query"))))
    one = files.withColumn("key", query).withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("file"))).filter("n = 1")
    hits = one.select(F.col("key").alias("query"), F.posexplode(F.coalesce("response.results", F.array().cast(f"array<{_HIT}>"))).alias("rank", "hit"))
    content = F.coalesce(F.nullif("hit.content", F.lit("")), F.col("hit.raw_content"), F.lit(""))
    results = hits.select("query", (F.col("rank") + 1).alias("rank"), "hit.title", "hit.url", content.alias("content"), F.coalesce("hit.score", F.lit(0.0)).alias("score"))
    return one.select(F.col("key").alias("query"), F.lit(True).alias("checked")), results


def nothing_searched(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The lookups of a system without search: nothing was checked."""
    from ..model import RESULTS, SEARCHED

    return spark.createDataFrame([], SEARCHED), spark.createDataFrame([], RESULTS)


def search_key(query: Column, max_results: int = 6) -> Column:
    """Name of a recorded search: 16 hex digits of the SHA-256 of the sorted JSON of its arguments and plain ASCII query."""
    plain = F.replace(F.replace(F.lower(F.trim(query)), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.substring(F.sha2(F.concat(F.lit(f'{{"max_results": {max_results}, "q": "'), plain, F.lit('"}')), 256), 1, 16)


def read_keys(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(keys, published) of well-known key documents, one JSON file per domain; of a document's entries that share kid and algorithm the first counts."""
    docs = spark.read.schema(_KEYS).option("multiLine", True).json(path).filter("domain is not null")
    first = lambda k, i: ~F.exists(F.slice("keys", F.lit(1), i), lambda x: x["kid"].eqNullSafe(k["kid"]) & x["alg"].eqNullSafe(k["alg"]))
    keys = docs.select(F.lower("domain").alias("domain"), F.explode(F.filter("keys", first)).alias("k")).select("domain", "k.kid", "k.alg", "k.public_key", "k.created")
    return keys, docs.select(F.lower("domain").alias("domain")).distinct()


def read_uploads(spark: SparkSession, path: str, most: int = UPLOAD_BYTES) -> DataFrame:
    """(path, length, content, accepted); files beyond the bound are listed without being read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.when(F.col("length") <= most, F.col("content")).alias("content"), (F.col("length") <= most).alias("accepted"))


def anchors(html: Column) -> Column:
    """Array (label, href) of a page's anchors that lead somewhere, LINKS at most, labels without tags."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*\bhref\s*=\s*[\"'][^\"']+[\"'][^>]*>.*?</a>"), F.lit(0))
    label = lambda a: F.substring(F.trim(F.regexp_replace(F.regexp_replace(a, "(?s)<[^>]*>", " "), r"\s+", " ")), 1, LABEL)
    href = lambda a: F.regexp_extract(a, r"(?is)\bhref\s*=\s*[\"']([^\"']+)[\"']", 1)
    return F.slice(F.transform(tags, lambda a: F.struct(label(a).alias("label"), href(a).alias("href"))), 1, LINKS)


def page_text(html: Column) -> Column:
    """What a page says, without scripts, styles and tags."""
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?i)<(br|/p|/div|/li|/h[1-6])\b[^>]*>", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "(?s)<[^>]*>", " "), r"[ \t]+", " "))


def harvest(pages: DataFrame) -> DataFrame:
    """Raw pages (page_id, url, html) as rendered pages, where no browser has run."""
    origin = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    return pages.select(origin.alias("origin"), "url", F.col("url").alias("final_url"), F.lit(200).alias("status"), F.lit("").alias("title"), page_text(F.col("html")).alias("text"), anchors(F.col("html")).alias("links"), F.lit("static").alias("engine"))
