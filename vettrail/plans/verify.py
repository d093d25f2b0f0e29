"""Whole verifications: every check on every message, one verdict row each, and the findings and progress in long form."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import requests
from ..model import FINDINGS, by_severity, max_rank, none, severity
from ..operators.attestations import check_attestations
from ..operators.documents import scan_documents
from ..operators.employers import verify_employers
from ..operators.postings import careers_pages, judge_postings
from ..operators.senders import analyse_senders, has

#: The checks in the order in which they report: label, the tool's name in traces, what it does.
STAGES = {
    "practices": ("What the message asks for", "practices.scan", "Scan the message"),
    "employer": ("Whether the company can be found", "employer.search", "Look the company up"),
    "domain": ("Who sent the message", "domain.compare", "Compare the sender's domain"),
    "attestation": ("Signed attestation", "attestation.verify", "Verify the attestation"),
    "posting": ("Whether the role is listed", "posting.match", "Look for the role"),
    "document": ("The attached document", "document.scan", "Scan the document"),
}
#: Bounds of what a message may hold, in characters (fixed values); longer input, or one without a sender, is refused.
BOUNDS = {"sender": 320, "claimed_company": 200, "message": 20000, "role": 200, "attestation": 4000, "recipient_email": 320}


@dataclass
class Lookups:
    """The tables that messages are held against; each says itself what was looked up."""

    searched: DataFrame
    results: DataFrame
    pages: DataFrame
    keys: DataFrame
    published: DataFrame
    spans: DataFrame
    metadata: DataFrame


def refusal(df: DataFrame) -> Column:
    """Why a message is refused; null for one that is verified."""
    given = [name for name in BOUNDS if name in df.columns]
    too_long = [F.when(F.length(F.col(n)) > BOUNDS[n], F.lit(f"{n} is longer than {BOUNDS[n]} characters")) for n in given]
    return F.coalesce(F.when(F.col("sender").isNull(), F.lit("sender is missing")), *too_long)


def _count(findings: Column, keep) -> Column:
    return F.size(F.filter(findings, keep))


def summary(findings: Column) -> Column:
    """Struct (state, headline, advice); the first that holds. A listed role or a valid signature comes before medium findings."""
    any_ = lambda code: F.exists(findings, lambda f: f["code"] == code)
    illegal = _count(findings, lambda f: F.coalesce(f["meta"]["tier"], F.lit("")) == "illegal")
    at = lambda rank: _count(findings, lambda f: f["rank"] == rank)
    number = lambda n, text: F.concat(n.cast("string"), F.lit(text))
    make = lambda state, headline, advice: F.struct(F.lit(state).alias("state"), headline.alias("headline"), F.lit(advice).alias("advice"))
    return (
        F.when(illegal > 0, make("illegal", number(illegal, " request(s) here that the law forbids."), "Don't act on the message; keep it."))
        .when(any_("ATTEST_ISSUER_MISMATCH"), make("mismatch", F.lit("A genuine attestation is used by another sender."), "Treat it as impersonation."))
        .when(at(4) > 0, make("critical", number(at(4), " serious problem(s) with who sent this or what it asks."), "Stop, and check through another channel."))
        .when(at(3) > 0, make("high", number(at(3), " thing(s) couldn't be verified or don't match."), "Check them before you answer."))
        .when(any_("POSTING_FOUND") & any_("ATTEST_VALID"), make("listed_signed", F.lit("The role is listed and the message is signed."), "Apply through the careers page."))
        .when(any_("POSTING_FOUND"), make("listed", F.lit("The role is listed by the employer."), "Apply through the careers page."))
        .when(any_("ATTEST_VALID"), make("signed", F.lit("The message is signed by the employer."), "The origin is confirmed, the terms aren't."))
        .when(at(2) > 0, make("medium", number(at(2), " thing(s) deserve a second look."), "Ask about them."))
        .when(any_("EMPLOYER_NOT_CHECKED"), make("unchecked", F.lit("Nothing was found, and not everything was checked."), "Look the company up yourself."))
        .otherwise(make("clear", F.lit("No problem was found."), "Go on with ordinary care."))
    )


def verify_outreach(outreach: DataFrame, lookups: Lookups, now: Column) -> DataFrame:
    """One row per message: verdicts, findings in order of severity, headline, and what each stage did.

    Messages meet their lookups by equi joins on company, issuer, domain and role, and document; the
    domain check uses the domain that the employer check found, the posting check that and the role of a
    valid attestation where the message names none. A refused message is a row of state `refused` whose
    headline says why; nothing in it is read, and all its stages are skipped.
    """
    c = F.col
    m = outreach.withColumn("refused", refusal(outreach))
    m = m.withColumns({n: F.when(c("refused").isNull(), c(n)) for n in (*BOUNDS, "document_id") if n in outreach.columns})
    m = m.withColumn("practice_findings", F.when(F.trim(F.coalesce("message", F.lit(""))) != "", requests.scan(c("message"), c("offer_received"))).otherwise(none()))
    employers = verify_employers(m.filter(has(c("claimed_company"))).select(c("claimed_company").alias("company")), lookups.searched, lookups.results)
    employers = employers.select(c("company").alias("claimed_company"), c("likely_domain").alias("known_domain"), c("confidence").alias("employer_confidence"), c("checked").alias("employer_checked"), "employer_findings")
    m = m.join(employers, "claimed_company", "left")
    m = analyse_senders(m)
    m = check_attestations(m, lookups.keys, lookups.published, now)
    m = m.withColumn("asked_role", F.coalesce("role", "attested_role"))
    wanted = F.coalesce("check_posting", F.lit(False)) & has(c("known_domain")) & has(c("asked_role"))
    m = m.withColumn("posting_wanted", wanted)
    careers = careers_pages(employers.filter(has(c("known_domain"))).select(c("known_domain").alias("domain")), lookups.pages)
    # rows that don't ask for a posting meet no page and get no finding
    m = m.withColumn("_site", F.when(c("posting_wanted"), c("known_domain")))
    m = judge_postings(m.join(careers.withColumnRenamed("domain", "_site"), "_site", "left"), "_site", "asked_role")
    m = m.join(scan_documents(lookups.spans, lookups.metadata), "document_id", "left")
    empty = lambda name: F.coalesce(c(name), none()).cast(FINDINGS)
    parts = ("attestation_findings", "domain_findings", "practice_findings", "employer_findings", "document_findings", "posting_findings")
    m = m.withColumn("findings", by_severity(F.concat(*map(empty, parts))))
    outcome = F.when(c("refused").isNull(), summary(c("findings"))).otherwise(F.struct(F.lit("refused").alias("state"), c("refused").alias("headline"), F.lit("Send it again within the bounds.").alias("advice")))
    m = m.withColumns({"max_rank": max_rank(c("findings")), "summary": outcome, "tiers": requests.tier_counts(F.coalesce(c("practice_findings"), none()))})
    m = m.withColumns({n: F.when(c("refused").isNull(), c(n)) for n in ("domain", "domain_verdict", "attestation_state")})
    return m.withColumn("max_severity", severity(c("max_rank"))).select(
        "msg_id", "sender", "claimed_company", "domain", "domain_verdict", "known_domain", "employer_confidence", "attestation_state", "posting_found", "document_verdict", "tiers",
        "max_severity", "max_rank", "summary.state", "summary.headline", "summary.advice", "findings", progress(m).alias("progress"),
    )


def progress(m: DataFrame) -> Column:
    """Array of the six stages: done, skipped, or error where a lookup didn't run or a signature doesn't hold; positive only where something was confirmed."""
    c = F.col
    rank = lambda name: severity(max_rank(F.coalesce(c(name), none()).cast(FINDINGS)))
    yes = lambda x: F.coalesce(x, F.lit(False))
    always = F.lit(True)

    def stage(name: str, findings: str, wanted: Column, ok: Column, positive: Column, says: Column, unasked: str) -> Column:
        status = F.when(~yes(wanted) | c("refused").isNotNull(), "skipped").when(yes(ok), "done").otherwise("error")
        said = F.when(status == "skipped", F.lit(unasked)).otherwise(F.coalesce(says, F.lit("")))
        return F.struct(F.lit(name).alias("stage"), status.alias("status"), rank(findings).alias("severity"), yes(positive).alias("positive"), said.alias("summary"))

    number = F.size(F.coalesce(c("practice_findings"), none()))
    return F.array(
        stage("practices", "practice_findings", F.trim(F.coalesce("message", F.lit(""))) != "", always, F.lit(False), F.concat(number.cast("string"), F.lit(" finding(s)")), "no message"),
        stage("employer", "employer_findings", has(c("claimed_company")), c("employer_checked"), c("known_domain").isNotNull(), F.coalesce(F.concat(F.lit("own domain: "), c("known_domain")), F.lit("no own site found")), "no company named"),
        stage("domain", "domain_findings", always, always, c("domain_verdict") == "matches_claim", F.replace("domain_verdict", F.lit("_"), F.lit(" ")), "refused"),
        stage("attestation", "attestation_findings", has(c("attestation")), c("attestation_state") == "valid", (c("attestation_state") == "valid") & (max_rank(c("attestation_findings")) == 0), F.replace("attestation_state", F.lit("_"), F.lit(" ")), "no attestation"),
        stage("posting", "posting_findings", c("posting_wanted"), c("posting_checked"), c("posting_found"), F.when(yes(c("posting_found")), "listed").otherwise("not listed"), "not asked for"),
        stage("document", "document_findings", has(c("document_id")), always, c("document_verdict") == "clean", c("document_verdict"), "no document"),
    )


def long_findings(verifications: DataFrame) -> DataFrame:
    """One row per finding, with its place in the message's order."""
    out = verifications.select("msg_id", F.posexplode("findings").alias("position", "f"))
    return out.select("msg_id", "position", "f.*")


def long_progress(verifications: DataFrame) -> DataFrame:
    """Six rows per message, in the order of the stages."""
    return verifications.select("msg_id", F.posexplode("progress").alias("position", "p")).select("msg_id", "position", "p.*")


def _by_stage(which: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in STAGES.items() for x in (k, v[which])]), F.col("p.stage"))


def trace_steps(verifications: DataFrame) -> DataFrame:
    """The steps of every verification that ran, under a run id that follows from the message: what came in, a tool call for
    each stage that wasn't skipped, the conclusion. A batch has no time of its own for a step, so none is claimed."""
    ran = verifications.filter("state <> 'refused'")
    run = F.substring(F.sha2("msg_id", 256), 1, 16).alias("run_id")
    row = lambda position, kind, label, tool, said, status: (run, "msg_id", F.lit(position).alias("position") if isinstance(position, int) else position.alias("position"), F.lit(kind).alias("step_type"), label.alias("label"), tool.alias("tool_name"), F.substring(said, 1, 1000).alias("summary"), status.alias("status"))
    nothing, fine = F.lit(None).cast("string"), F.lit("success")
    came = F.concat(F.lit("sender "), "sender", F.lit(", company "), F.coalesce("claimed_company", F.lit("not named")))
    first = ran.select(*row(0, "reasoning", F.lit("Read the message"), nothing, came, fine))
    calls = ran.select("msg_id", F.posexplode("progress").alias("n", "p")).filter("p.status <> 'skipped'")
    calls = calls.select(*row(F.col("n") + 1, "tool_call", _by_stage(2), _by_stage(1), F.col("p.summary"), F.when(F.col("p.status") == "done", "success").otherwise("error")))
    last = ran.select(*row(len(STAGES) + 1, "final_answer", F.lit("Conclude"), nothing, F.concat("max_severity", F.lit(": "), "headline"), fine))
    return first.union(calls).union(last)


def events(verifications: DataFrame) -> DataFrame:
    """(msg_id, position, event, json): what a client is sent, in order: start with the stages, one event for each stage, the result; a refused message gets one error."""
    start = json.dumps({"event": "start", "stages": [{"stage": k, "label": v[0]} for k, v in STAGES.items()]})
    made = lambda event, body: F.struct(F.lit(event).alias("event"), body.alias("json"))
    say = lambda **fields: F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    labels = F.create_map(*[F.lit(x) for k, v in STAGES.items() for x in (k, v[0])])
    told = F.transform("progress", lambda p: made("progress", say(event=F.lit("progress"), stage=p["stage"], label=F.element_at(labels, p["stage"]), status=p["status"], summary=p["summary"], severity=p["severity"], positive=p["positive"])))
    rest = [x for x in verifications.columns if x != "progress"]
    result = made("result", say(event=F.lit("result"), result=F.struct(*rest)))
    error = made("error", say(event=F.lit("error"), detail=F.col("headline")))
    all_ = F.when(F.col("state") == "refused", F.array(error)).otherwise(F.concat(F.array(made("start", F.lit(start))), told, F.array(result)))
    return verifications.select("msg_id", F.posexplode(all_).alias("position", "e")).select("msg_id", "position", "e.event", "e.json")


def as_json(verifications: DataFrame) -> DataFrame:
    """One JSON document per message, for a text or NDJSON sink."""
    return verifications.select("msg_id", F.to_json(F.struct(*[x for x in verifications.columns])).alias("json"))
