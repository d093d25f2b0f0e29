"""Sender domains: parsing, the family of imitations, throwaway mail, precedence."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from vettrail.functions import domain as D
from vettrail.operators.senders import analyse_senders


@pytest.fixture(scope="module")
def judged(spark):
    def run(*rows):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, sender string, claimed_company string, known_domain string")
        out = {r.i: r for r in analyse_senders(df).collect()}
        return [out[i] for i in range(len(rows))]

    return run


def test_parsing(spark):
    cases = {
        "Jo Doe <jo@Mail.Example.COM": ("mail.example.com", "example", "com"), "https://www.shop.example.co.uk/path?x=1": ("www.shop.example.co.uk", "example", "co.uk"),
        " hr@EXAMPLE.org. ": ("example.org", "example", "org"), "http://127.0.0.1:8080/x": ("127.0.0.1", "127.0.0.1", ""), "localhost": ("localhost", "localhost", ""),
        "a@b@c.net": ("c.net", "c", "net"), "co.uk": ("co.uk", "co", "uk"), "x.com#part": ("x.com#part", "x", "com#part"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", D.domain_of(F.col("s")).alias("d"))
    got = {r.s: (r.d, r.n, r.t) for r in df.select("s", "d", D.name_of(F.col("d")).alias("n"), D.suffix_of(F.col("d")).alias("t")).collect()}
    assert got == cases


@pytest.mark.parametrize("sender,company,known,verdict,code,severity", [
    ("hr@brightlake.com", "Brightlake", "brightlake.com", "matches_claim", "DOMAIN_MATCHES_VERIFIED", "info"),
    ("hr@mail.brightlake.com", "Brightlake", "brightlake.com", "matches_claim", "DOMAIN_MATCHES_VERIFIED", "info"),
    ("hr@brightlаke.com", "Brightlake", None, "lookalike", "DOMAIN_CONFUSABLE_IMITATION", "critical"),
    ("hr@brightlake.com.portal-x.xyz", "Brightlake", None, "lookalike", "DOMAIN_BRAND_IN_SUBDOMAIN", "critical"),
    ("hr@brightlakecareers.com", "Brightlake", None, "lookalike", "DOMAIN_COMBOSQUAT", "high"),
    ("hr@brigtlake.com", "Brightlake", None, "lookalike", "DOMAIN_TYPOSQUAT", "high"),
    ("hr@brigghtlake.com", "Lake", "brightlake.com", "lookalike", "DOMAIN_TYPOSQUAT_VS_VERIFIED", "critical"),
    ("hr@mailinator.com", "Brightlake", None, "unrelated", "DOMAIN_DISPOSABLE_MAIL", "critical"),
    ("hr@mailinator.com", None, None, "lookalike", "DOMAIN_DISPOSABLE_MAIL", "critical"),
    ("jo@gmail.com", "Brightlake", None, "unrelated", "DOMAIN_FREE_MAIL", "high"),
    ("jo@gmail.com", None, None, "unverifiable", "DOMAIN_FREE_MAIL", "medium"),
    ("hr@northern-agency.com", "Brightlake", None, "unrelated", "DOMAIN_UNRELATED_TO_CLAIM", "medium"),
    ("hr@xn--brghtlake-x2a.com", "Otherwise", None, "unrelated", "DOMAIN_PUNYCODE_IDN", "critical"),
    ("hr@agency.top", "Brightlake", "brightlake.com", "lookalike", "DOMAIN_HIGH_ABUSE_TLD", "low"),
])
def test_verdicts(judged, sender, company, known, verdict, code, severity):
    (r,) = judged((sender, company, known))
    assert r.domain_verdict == verdict
    assert (code, severity) in {(f.code, f.severity) for f in r.domain_findings}
    ranks = [f.rank for f in r.domain_findings]
    assert ranks == sorted(ranks, reverse=True)


def test_own_hyphenated_domain_is_clean(judged):
    rows = judged(("hr@acme-robotics.com", "Acme Robotics", None), ("hr@acme-robotics.com", "Acme-Robotics Inc", None), ("hr@big-blue-sky.co.uk", "Big Blue Sky Ltd", None))
    assert all(f.rank < 3 for r in rows for f in r.domain_findings)
    (still,) = judged(("hr@acme-robotic.com", "Acme Robotics", None))
    assert any(f.rank >= 3 for f in still.domain_findings)


def test_empty_token_is_contained_in_everything(judged):
    (r,) = judged(("hr@somewhere.org", "***", None))
    assert r.domain_verdict == "unverifiable" and not r.domain_findings


def test_nulls(judged):
    rows = judged((None, None, None), ("", "", ""))
    assert all(r.domain == "" and r.domain_verdict == "unverifiable" and not r.domain_findings for r in rows)


def plain_token(name):
    """What a company's name comes down to, by Python's own decomposition."""
    s = unicodedata.normalize("NFKD", name.lower())
    return re.sub(r"[^a-z0-9]", "", re.sub(rf"\b({D.COMPANY_SUFFIXES})\b", "", s))


def plain_skeleton(name):
    s = "".join(D.LOOKALIKES.get(c, c).lower() for c in unicodedata.normalize("NFKD", name.lower()))
    for old, new in D.FOLDS:
        s = s.replace(old, new)
    return re.sub(r"[^a-z0-9]", "", s)


NAMES = [
    "Nestlé", "Café Société SA", "Có", "Cóabc", "ﬁnance Co", "Ｆｕｌｌ Inc", "Müller GmbH", "Ⅷ corp", "brightlаke", "ёлка", "İstanbul Ltd", "ø co ø", "coø", "øco", "½ co", "ǆabc", "Zoë's Co.",
    "plain Ltd", "№5 Ltd", "㎏ co", "Ångström", "Straße", "e\u0301clair", "𝐀cme", "①st", "co_ltd", "co-ltd", "", "Ünïted Có SA",
]


def test_names_are_decomposed(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    for r in df.select("n", D.company_token(F.col("n")).alias("t"), D.bare(D.skeleton(F.col("n"))).alias("s")).collect():
        assert (r.n, r.t, r.s) == (r.n, plain_token(r.n), plain_skeleton(r.n))


@pytest.mark.parametrize("sender,company,verdict,codes", [
    ("hr@nestle.com", "Nestlé", "unverifiable", []),
    ("hr@nestle-jobs.com", "Nestlé", "lookalike", ["DOMAIN_COMBOSQUAT"]),
    ("hr@nestel.com", "Nestlé", "unrelated", ["DOMAIN_UNRELATED_TO_CLAIM"]),
    ("hr@cafesociete.fr", "Café Société SA", "unverifiable", []),
    ("hr@nestlé.com", "Nestle", "unverifiable", []),
    ("hr@nestl\u0435.com", "Nestlé", "lookalike", ["DOMAIN_CONFUSABLE_IMITATION"]),
])
def test_accents(judged, sender, company, verdict, codes):
    (r,) = judged((sender, company, None))
    assert (r.domain_verdict, [f.code for f in r.domain_findings]) == (verdict, codes)


@pytest.mark.parametrize("label", ["xn--mnchen-3ya", "xn--80ak6aa92e", "xn--fsqu00a", "xn--bcher-kva", "xn--pypal-4ve", "xn--n8jok5ay5dzabd5bym9f0cm5685rrjetr6pdxa", "xn--99zzzzzzz", "xn--9999999999999", "xn--", "xn--a-"])
def test_punycode_is_shown(judged, label):
    (r,) = judged((f"hr@{label}.com", None, None))
    try:
        want = label.encode("ascii").decode("idna")
    except UnicodeError:
        want = label
    (f,) = [f for f in r.domain_findings if f.code == "DOMAIN_PUNYCODE_IDN"]
    assert f.meta["decoded"] == want and f.evidence == f"{label} is shown as {want}"
