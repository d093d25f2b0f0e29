"""The registered queries: each operator over a whole derived input, as flat rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domain as D
from ..functions import instructions, requests, unicode
from ..model import KEYS
from ..operators import attestations, documents, employers, limits, postings
from ..operators.senders import analyse_senders
from ..operators.texts import scan_texts
from ..sources import readers
from ..sources.tables import table
from . import derive, report, verify

c = F.col
#: Queries with a clock run at this moment.
NOW = "2026-06-01 00:00:00"


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1, D2 on every page's address."""
    pages = table(spark, sf_dir, "pages").select("page_id", D.domain_of(c("url")).alias("domain"))
    return pages.select("page_id", "domain", D.name_of(c("domain")).alias("name"), D.suffix_of(c("domain")).alias("tld"))


def sender_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company tokens, folded names and their distance."""
    out = derive.frame(spark, sf_dir, derive.OUTREACH).select("msg_id", D.company_token(c("claimed_company")).alias("token"), D.name_of(D.domain_of(c("sender"))).alias("name"))
    out = out.withColumn("plain", D.bare(D.skeleton(c("name"))))
    return out.select("msg_id", "token", "plain", F.levenshtein("plain", "token").alias("distance"), D.first_hiring_word(c("plain"), c("token")).alias("hiring_word"))


def sender_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict, worst severity and codes in order for every sender, with and without a verified domain."""
    out = analyse_senders(derive.frame(spark, sf_dir, derive.OUTREACH))
    codes = F.array_join(F.transform("domain_findings", lambda f: f["code"]), ",")
    return out.select("msg_id", "domain", c("domain_verdict").alias("verdict"), F.size("domain_findings").alias("n_findings"), codes.alias("codes"))


def sender_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many senders got each verdict and worst severity."""
    out = analyse_senders(derive.frame(spark, sf_dir, derive.OUTREACH))
    return out.groupBy(c("domain_verdict").alias("verdict"), F.coalesce(F.array_max(F.transform("domain_findings", lambda f: f["rank"])), F.lit(0)).alias("max_rank")).agg(F.count("*").alias("n"))


def practices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding with its tier, severity, match and code-point offset."""
    out = derive.frame(spark, sf_dir, derive.MESSAGES).select("msg_id", F.explode(requests.scan(c("message"), F.lit(None).cast("boolean"))).alias("f"))
    return out.select("msg_id", "f.code", c("f.meta")["tier"].alias("tier"), "f.severity", c("f.meta")["matched"].alias("matched"), c("f.meta")["offset"].cast("long").alias("at"))


def practice_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier counts of every message."""
    out = derive.frame(spark, sf_dir, derive.MESSAGES).select("msg_id", requests.tier_counts(requests.scan(c("message"), F.lit(None).cast("boolean"))).alias("t"))
    n = lambda tier: F.coalesce(F.try_element_at("t", F.lit(tier)), F.lit(0)).alias(tier)
    return out.select("msg_id", *map(n, requests.TIERS))


def instruction_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions by layer."""
    out = derive.frame(spark, sf_dir, derive.TEXTS).select("doc_id", F.explode(instructions.scan(c("body"), c("layer"))).alias("f"))
    return out.select("doc_id", "f.code", "f.severity", "f.confidence", c("f.meta")["matched"].alias("matched"), c("f.meta")["offset"].cast("long").alias("at"))


def unicode_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden, reordering and imitating characters."""
    out = derive.frame(spark, sf_dir, derive.TEXTS).select("doc_id", F.explode(unicode.run_all(c("body"))).alias("f"))
    return out.select("doc_id", "f.code", "f.severity", F.coalesce(c("f.meta")["count"], c("f.meta")["total"]).cast("long").alias("n"), F.coalesce(c("f.meta")["decoded_payload"], F.lit("")).alias("payload"))


def text_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every text, its layer unknown."""
    out = scan_texts(derive.frame(spark, sf_dir, derive.TEXTS), "body")
    return out.select("doc_id", "verdict", F.size("findings").alias("n_findings"), c("chars").cast("long").alias("chars"), F.array_join(F.transform("findings", lambda f: f["code"]), ",").alias("codes"))


def _lookups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    names = derive.frame(spark, sf_dir, derive.COMPANIES)
    results = derive.frame(spark, sf_dir, derive.RESULTS).selectExpr("query", "rank", "'' AS title", "url", "'' AS content", "cast(score AS double) AS score")
    return names, derive.frame(spark, sf_dir, derive.SEARCHED), results


def candidate_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the domains that may be each company's own."""
    names, _, results = _lookups(spark, sf_dir)
    return employers.candidate_domains(names, results).select("company", "base", F.round("score", 3).alias("score"))


def employer_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found, without a site, without a trace, or not checked."""
    names, searched, results = _lookups(spark, sf_dir)
    out = employers.verify_employers(names, searched, results)
    return out.select("company", "likely_domain", F.round("confidence", 6).alias("confidence"), "checked", "note", F.size("sources").alias("n_sources"))


def posting_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The careers page of every company and whether it lists the role."""
    out = postings.check_postings(derive.frame(spark, sf_dir, derive.ASKED), derive.rendered(spark, sf_dir))
    return out.select("domain", "role", "checked", "found", "careers_url", "matched")


def span_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1, L2: why each span can't be seen."""
    return documents.classify(derive.spans(spark, sf_dir)).select("document_id", "span_idx", F.array_join("reasons", ",").alias("reasons"), "hidden")


def span_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: visible and hidden text of every document."""
    out = documents.layers(derive.spans(spark, sf_dir))
    return out.select("document_id", F.md5("visible_text").alias("visible_md5"), F.md5("hidden_text").alias("hidden_md5"), "n_spans", "hidden_spans")


def body_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The style of most visible characters."""
    return documents.body_style(derive.spans(spark, sf_dir))


def font_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans off the body style."""
    out = documents.font_findings(derive.spans(spark, sf_dir))
    return out.select("document_id", c("i").alias("span_idx"), "f.severity", "f.confidence", c("f.meta")["field"].alias("field"))


def overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts over one another."""
    out = documents.overlays(derive.spans(spark, sf_dir))
    return out.select("document_id", "i", c("f.meta")["a"].alias("a"), c("f.meta")["b"].alias("b"))


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the producing software says."""
    out = derive.metadata(spark, sf_dir).select("document_id", documents.provenance(c("metadata")).alias("f"))
    return out.select("document_id", "f.code", "f.severity")


def document_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    out = documents.scan_documents(derive.spans(spark, sf_dir), derive.metadata(spark, sf_dir))
    return out.select("document_id", c("document_verdict").alias("verdict"), F.size("document_findings").alias("n_findings"))


def _tokens(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Eight tokens, the published keys, the domains whose key document was read."""
    issue, day = attestations.issue, ("2026-01-01T00:00:00+00:00", "2030-01-01T00:00:00+00:00")
    one, two = b"1" * 32, b"2" * 32
    good = issue(one, "alpha-works.com", "Data Engineer", "Ann", *day, recipient="me@mail.org")
    head, body, tail = good.split(".")
    tokens = [
        good, issue(one, "alpha-works.com", "Designer", "Ann", day[0], "2026-02-01T00:00:00+00:00"), issue(two, "alpha-works.com", "Designer", "Bob", *day),
        f"{head}.{body[:-6]}{'A' if body[-6] != 'A' else 'B'}{body[-5:]}.{tail}", issue(one, "nowhere.net", "Designer", "Ann", *day), "no token at all", None, issue(one, "alpha-works.com", "Cook", "Ann", day[0], "soon"),
    ]
    key = attestations.issuer_key(one, "alpha-works.com")
    keys = spark.createDataFrame([tuple(key[k] for k in ("domain", "kid", "alg", "public_key", "created"))], KEYS)
    return spark.createDataFrame([*enumerate(tokens)], "n int, attestation string"), keys, spark.createDataFrame([("alpha-works.com",)], "domain string")


def attestation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token state, by sender and recipient."""
    tokens, keys, published = _tokens(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", (c("page_id") % 8).cast("int").alias("n"))
    sender = F.when(c("page_id") % 3 == 0, "hr@alpha-works.com").when(c("page_id") % 3 == 1, "hr@mail.alpha-works.com").otherwise("hr@elsewhere.org")
    recipient = F.when(c("page_id") % 5 == 0, "other@mail.org").otherwise(" Me@Mail.org")
    rows = pages.join(F.broadcast(tokens), "n").select("page_id", "attestation", sender.alias("sender"), recipient.alias("recipient_email"))
    out = attestations.check_attestations(rows, keys, published, F.lit(NOW).cast("timestamp"))
    return out.select("page_id", c("attestation_state").alias("state"), F.array_join(F.transform("attestation_findings", lambda f: F.concat(f["code"], F.lit(":"), f["severity"])), ",").alias("findings"))


def _verifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, searched, results = _lookups(spark, sf_dir)
    tokens, keys, published = _tokens(spark)
    base = derive.frame(spark, sf_dir, derive.OUTREACH).drop("known_domain")
    text = F.element_at(F.array(*map(F.lit, derive.SNIPPETS)), (c("msg_id") % len(derive.SNIPPETS) + 1).cast("int"))
    role = F.element_at(F.array(*map(F.lit, derive.ROLES)), (F.floor(c("msg_id") / 2) % len(derive.ROLES) + 1).cast("int"))
    m = base.withColumn("n", (c("msg_id") % 64).cast("int")).join(F.broadcast(tokens), "n", "left")
    m = m.select(
        c("msg_id").cast("string").alias("msg_id"), F.when(c("msg_id") % 101 != 0, c("sender")).alias("sender"), "claimed_company",
        F.when(c("msg_id") % 97 == 0, F.repeat(F.lit("x"), 20_001)).when(c("msg_id") % 9 != 0, text).alias("message"), role.alias("role"), "attestation",
        F.lit("me@mail.org").alias("recipient_email"), F.lit(None).cast("boolean").alias("offer_received"), (c("msg_id") % 2 == 0).alias("check_posting"),
        F.when(c("msg_id") % 4 == 0, F.floor(c("msg_id") / 2).cast("string")).alias("document_id"),
    )
    lookups = verify.Lookups(searched, results, derive.rendered(spark, sf_dir), keys, published, derive.spans(spark, sf_dir), derive.metadata(spark, sf_dir))
    return verify.verify_outreach(m, lookups, F.lit(NOW).cast("timestamp"))


def verifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One verdict row per message."""
    return _verifications(spark, sf_dir).select("msg_id", "domain_verdict", "known_domain", "attestation_state", "posting_found", "document_verdict", "max_severity", "state", F.size("findings").alias("n_findings"))


def verification_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every message in long form."""
    return verify.long_findings(_verifications(spark, sf_dir)).select("msg_id", "position", "code", "severity", "layer", "confidence")


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six progress rows per message."""
    return verify.long_progress(_verifications(spark, sf_dir))


def client_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, progress, result and error events of every message."""
    out = verify.events(_verifications(spark, sf_dir))
    status = F.get_json_object("json", "$.status")
    return out.select("msg_id", "position", "event", F.coalesce(F.get_json_object("json", "$.stage"), F.lit("")).alias("stage"), F.coalesce(status, F.get_json_object("json", "$.detail"), F.get_json_object("json", "$.result.state"), F.lit("")).alias("says"))


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps that ran."""
    return verify.trace_steps(_verifications(spark, sf_dir))


def written_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for every message."""
    return report.reports(_verifications(spark, sf_dir))


def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two calls per user in a day that begins with the first of them."""
    calls = table(spark, sf_dir, "events").select(c("user_id").cast("string").alias("client"), "ts", c("event_id").alias("seq"))
    out = limits.fixed_windows(calls, 2, 86_400.0)
    return out.select(c("seq").alias("event_id"), "client", "count", "allowed", F.round("retry_after", 3).alias("retry_after"))


def client_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z3: the first forwarded address, else the peer's."""
    events = table(spark, sf_dir, "events")
    forwarded = F.when(c("event_id") % 3 == 0, F.concat(F.lit(" 10.0.0."), (c("user_id") % 250).cast("string"), F.lit(" , 172.16.0.1"))).when(c("event_id") % 3 == 1, "")
    return events.select("event_id", limits.client_key(forwarded, F.concat(F.lit("peer-"), c("user_id").cast("string"))).alias("client"))


def page_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of every raw page."""
    out = readers.harvest(table(spark, sf_dir, "pages")).select("url", F.explode("links").alias("link"))
    return out.groupBy("url").agg(F.count("*").alias("n_links"), F.min("link.href").alias("first_href"), F.max("link.href").alias("last_href"))


def recipient_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of recipients and of search queries."""
    names = derive.frame(spark, sf_dir, derive.COMPANIES)
    email = F.concat(F.lit(" Me@"), c("company"), F.lit(".com "))
    return names.select("company", attestations.hash_recipient(email).alias("recipient"), readers.search_key(F.concat("company", F.lit(" official website careers"))).alias("search_key"))


def field_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that hold money, a date or a name."""
    lines = derive.frame(spark, sf_dir, derive.LINES_SPARK)
    lines = lines.select("doc_id", F.concat("t", F.element_at(F.array(*map(F.lit, ("", " $1,200.50", " 12/01/2026", " Mar 4", " John Smith"))), (c("i") % 5 + 1).cast("int"))).alias("t"))
    return lines.groupBy("doc_id", F.coalesce(documents.what_field(c("t")), F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "d_sender_verdicts": sender_verdicts, "d_hosts": hosts, "d_sender_tokens": sender_tokens, "d_sender_summary": sender_summary, "r_practices": practices,
        "r_practice_tiers": practice_tiers, "i_instructions": instruction_findings, "u_unicode": unicode_findings, "l_text_verdicts": text_verdicts,
        "e_candidate_domains": candidate_domains, "e_employers": employer_evidence, "p_postings": posting_evidence, "l_span_reasons": span_reasons, "l_layers": span_layers,
        "l_body_styles": body_styles, "l_fonts": font_findings, "l_overlays": overlays, "l_provenance": provenance, "l_field_kinds": field_kinds, "l_documents": document_verdicts,
        "t_attestations": attestation_states, "t_digests": recipient_hashes, "o_verifications": verifications, "o_findings": verification_findings, "o_progress": progress_events,
        "o_events": client_events, "o_trace": trace, "o_reports": written_reports, "z_rate_limits": rate_limits, "z_client_keys": client_keys, "s_anchors": page_anchors,
    }
