"""Sender verdicts: every check of functions.domain, composed by precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import domain as D
from ..model import by_severity, finding, max_rank, none, present

_STEPS = ("_verified", "_name", "_tld", "_token", "_fold", "_plain", "_vname", "_vtoken", "_first", "_own", "_against")


def has(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def analyse_senders(df: DataFrame, sender: str = "sender", company: str = "claimed_company", known: str = "known_domain") -> DataFrame:
    """Adds domain, domain_verdict and domain_findings. `known` is the company's verified domain or null.

    The intermediate columns are built step by step, so that each is computed once and everything
    stays in generated code. A sender on the verified domain gets that one finding only.
    """
    company_, known_, c = F.col(company), F.col(known), F.col
    df = df.withColumns({"domain": D.domain_of(F.coalesce(F.col(sender), F.lit(""))), "_verified": D.domain_of(F.coalesce(known_, F.lit("")))})
    df = df.withColumns({"_name": D.name_of(c("domain")), "_tld": D.suffix_of(c("domain")), "_vname": D.name_of(c("_verified")), "_token": D.company_token(F.coalesce(company_, F.lit("")))})
    df = df.withColumns({"_fold": D.skeleton(c("_name")), "_vtoken": D.company_token(c("_vname"))}).withColumn("_plain", D.bare(c("_fold")))
    mail, bulk = D.sender_type(c("domain"), c("_tld"), company_)
    df = df.withColumns({
        "_against": F.when(has(known_), D.confusable(c("_vname"), c("_vtoken"), c("_name"), c("_tld"), c("_fold"), c("_plain"))),
        "_own": F.when(has(company_), present(
            D.brand_position(c("domain"), company_, c("_token"), c("_name"), c("_tld"), c("_plain")),
            D.confusable(company_, c("_token"), c("_name"), c("_tld"), c("_fold"), c("_plain")),
        )).otherwise(none()),
    })
    upgraded = F.when(c("_against").isNotNull(), finding(
        F.concat(c("_against.code"), F.lit("_VS_VERIFIED")), F.concat(F.lit("The sender imitates the verified domain "), c("_verified")), "critical",
        F.concat(c("_against.detail"), F.lit(" The comparison is with the verified domain itself.")), evidence=c("_against.evidence"),
        remediation=F.concat(F.lit("The real domain is "), c("_verified")), meta={"verified_domain": c("_verified")},
    ))
    df = df.withColumn("_first", present(D.punycode(c("domain")), mail, bulk, upgraded))
    matches = has(known_) & ((c("domain") == c("_verified")) | F.endswith(c("domain"), F.concat(F.lit("."), c("_verified"))))
    match = finding(
        "DOMAIN_MATCHES_VERIFIED", "The sender is on the company's verified domain", "info", F.concat(c("domain"), F.lit(" is "), c("_verified"), F.lit(" or below it.")),
        evidence=F.concat(c("domain"), F.lit(" is within "), c("_verified")), remediation="The domain checks out; terms and authority are separate questions.",
    )
    unrelated = finding(
        "DOMAIN_UNRELATED_TO_CLAIM", F.concat(F.lit("The domain has nothing to do with "), company_), "medium",
        F.concat(c("domain"), F.lit(" neither holds nor resembles the name. Agencies write like this; it means that an unverified go-between is trusted.")),
        evidence=F.concat(F.lit("sender "), c("domain"), F.lit(", claim "), company_), confidence=0.8, remediation="Ask the company whether it authorised this agency.",
    )
    lookalike = (has(known_) & (F.size("_first") > 0)) | (F.size("_own") > 0)
    loose = has(company_) & ~lookalike & ~F.contains(c("_plain"), c("_token"))
    df = df.withColumn("domain_findings", F.when(matches, F.array(match)).otherwise(by_severity(F.concat("_first", "_own", F.when(loose, F.array(unrelated)).otherwise(none())))))
    verdict = (
        F.when(matches, "matches_claim").when(lookalike, "lookalike").when(loose, "unrelated")
        .when(max_rank(c("domain_findings")) >= 3, "lookalike").otherwise("unverifiable")
    )
    return df.withColumn("domain_verdict", verdict).drop(*_STEPS)
