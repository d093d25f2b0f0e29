"""Employers, postings, attestations and the readers that feed them: found, not found and not checked stay apart."""

import json

import pytest
from pyspark.sql import functions as F

from vettrail.model import KEYS, PAGES
from vettrail.operators import attestations, ed25519
from vettrail.operators.employers import verify_employers
from vettrail.operators.postings import check_postings, role_present, role_tokens
from vettrail.sources import readers


@pytest.fixture()
def recorded(spark, tmp_path):
    hit = lambda url, score: {"title": "t", "url": url, "content": "c", "score": score}
    files = {
        "a": ("Harbour Data", [hit("https://www.harbourdata.com/", 0.97), hit("https://www.linkedin.com/company/h", 0.96), hit("https://harbourdata.com/careers", 0.94), hit("https://indeed.com/x", 0.9)]),
        "b": ("Shell Works", [hit("https://www.linkedin.com/company/s", 0.9), hit("https://www.glassdoor.com/s", 0.8), hit("https://jobs.lever.co/s", 0.7)]),
        "c": ("Nobody Anywhere", []),
        "d": ("Lone Address", [hit("http://10.0.0.7/", 0.5), hit("https://example.net/x", 0.0)]),
    }
    for name, (company, hits) in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"query": f" {company} official website careers", "kw": {"max_results": 6}, "response": {"query": company, "results": hits}}))
    (tmp_path / "broken.json").write_text("{not json")
    return readers.read_searches(spark, str(tmp_path))


def test_employers(spark, recorded):
    names = spark.createDataFrame([("Harbour Data",), ("Shell Works",), ("Nobody Anywhere",), ("Never Searched",), ("Lone Address",), ("",), (None,)], "company string")
    out = {r.company: r for r in verify_employers(names, *recorded).collect()}
    assert (out["Harbour Data"].likely_domain, out["Harbour Data"].confidence) == ("harbourdata.com", 0.95)
    states = {k: (r.checked, r.note, [(f.code, f.severity) for f in r.employer_findings]) for k, r in out.items()}
    assert states["Shell Works"] == (True, "no_own_site", [("EMPLOYER_NO_OWN_SITE", "medium")])
    assert states["Nobody Anywhere"] == (True, "no_footprint", [("EMPLOYER_NO_FOOTPRINT", "high")])
    assert states["Never Searched"] == (False, "not_checked", [("EMPLOYER_NOT_CHECKED", "info")])
    assert states[""] == states[None] == (False, "blank", [])
    assert out["Lone Address"].likely_domain == "10.0.0.7"
    offline = {r.company: r.note for r in verify_employers(names, *readers.nothing_searched(spark)).collect()}
    assert offline["Harbour Data"] == "not_checked"


@pytest.mark.parametrize("role,present", [
    ("Senior Data Engineer", True), ("Platform Engineer II", True), ("Office Cook", False), ("Product Designer", True), ("Head of the", False),
])
def test_roles(spark, role, present):
    df = spark.createDataFrame([("Open roles\nData Engineer\n  Product designer (Rome) ", [("Platform engineer, Oslo", "/p")], role)], "text string, links array<struct<label:string,href:string>>, role string")
    assert (df.select(role_present(F.col("text"), F.col("links"), F.col("role"))).first()[0] is not None) == present


def test_role_tokens(spark):
    got = spark.createDataFrame([("Senior Software Engineer II, the Lead",)], "r string").select(role_tokens(F.col("r"))).first()[0]
    assert got == ["software", "engineer"]


def test_postings(spark):
    page = lambda url, status, text, links=(): ("", url, url, status, "", text, [*links], "x")
    pages = spark.createDataFrame([
        page("https://one.com/", 200, "Home", [("Careers", "https://one.com/work"), ("About", "https://one.com/about")]), page("https://one.com/work", 404, "Cook\nBaker"),
        page("https://www.two.com/jobs", 200, "Gardener"), page("https://three.com/careers", 500, "Cook"),
    ], PAGES)
    asked = spark.createDataFrame([("one.com", "Cook"), ("two.com", "Cook"), ("three.com", "Cook"), ("four.com", "Cook"), ("one.com", " "), (None, "Cook")], "domain string, role string")
    out = {(r.domain, r.role): (r.checked, r.found, [f.code for f in r.posting_findings]) for r in check_postings(asked, pages).collect()}
    assert out["one.com", "Cook"] == (True, True, ["POSTING_FOUND"])
    assert out["two.com", "Cook"] == (True, False, ["POSTING_NOT_LISTED"])
    assert out["three.com", "Cook"] == out["four.com", "Cook"] == (False, None, ["POSTING_NOT_CHECKED"])
    assert out["one.com", " "] == out[None, "Cook"] == (False, None, [])


def test_ed25519_vectors(spark):
    """Two vectors of RFC 8032, and the JVM's own provider on another."""
    vectors = [
        ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "",
         "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
        ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72",
         "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ]
    for seed, public, message, signature in vectors:
        if seed.startswith("9d61"):
            assert ed25519.verify(ed25519.public_key(bytes.fromhex(seed)), b"", ed25519.sign(bytes.fromhex(seed), b""))
            continue
        seed, public, message, signature = map(bytes.fromhex, (seed, public, message, signature))
        assert ed25519.public_key(seed) == public and ed25519.sign(seed, message) == signature and ed25519.verify(public, message, signature)
        assert not ed25519.verify(public, message + b"x", signature) and not ed25519.verify(public, message, signature[:-1] + b"\x01")
    jvm = spark._jvm
    seed, message = b"7" * 32, b"some message"
    prefix = bytes.fromhex("302a300506032b6570032100")
    key = jvm.java.security.KeyFactory.getInstance("Ed25519").generatePublic(jvm.java.security.spec.X509EncodedKeySpec(prefix + ed25519.public_key(seed)))
    check = jvm.java.security.Signature.getInstance("Ed25519")
    check.initVerify(key)
    check.update(message)
    assert check.verify(ed25519.sign(seed, message))


def test_attestations(spark, tmp_path):
    seed, day = b"3" * 32, ("2026-01-01T00:00:00+00:00", "2026-12-31T00:00:00+00:00")
    key = attestations.issuer_key(seed, "Harbour.com")
    (tmp_path / "harbour.json").write_text(json.dumps({"version": "1", "domain": "Harbour.com", "keys": [{k: key[k] for k in ("kid", "alg", "public_key", "created")}, {"kid": key["kid"], "alg": key["alg"], "public_key": "AAAA"}]}))
    keys, published = readers.read_keys(spark, str(tmp_path))
    assert keys.columns == spark.createDataFrame([], KEYS).columns
    good = attestations.issue(seed, "harbour.com", "Cook", "Ann", *day, recipient="Me@mail.org")
    head, body, tail = good.split(".")
    rows = [
        ("good", good, "hr@harbour.com", "me@mail.org"), ("below", good, "hr@mail.harbour.com", None), ("moved", good, "hr@evil.org", "me@mail.org"), ("nosender", good, "", None),
        ("other", good, "hr@harbour.com", "you@mail.org"), ("old", attestations.issue(seed, "harbour.com", "Cook", "Ann", day[0], "2026-02-01T00:00:00+00:00"), "hr@harbour.com", None),
        ("forged", attestations.issue(b"4" * 32, "harbour.com", "Cook", "Ann", *day), "hr@harbour.com", None), ("edited", f"{head}.{body[:20]}{'A' if body[20] != 'A' else 'B'}{body[21:]}.{tail}", "hr@harbour.com", None),
        ("tail", f"{head}.{body}.{tail[::-1]}", "hr@harbour.com", None), ("nokeys", attestations.issue(seed, "else.org", "Cook", "Ann", *day), "hr@else.org", None), ("junk", "what is this", "hr@harbour.com", None), ("none", None, "hr@harbour.com", None),
    ]
    df = spark.createDataFrame(rows, "n string, attestation string, sender string, recipient_email string")
    out = {r.n: (r.attestation_state, [(f.code, f.severity) for f in r.attestation_findings]) for r in attestations.check_attestations(df, keys, published, F.lit("2026-06-01 00:00:00").cast("timestamp")).collect()}
    assert out["good"] == out["below"] == out["nosender"] == ("valid", [("ATTEST_VALID", "info")])
    assert out["moved"] == ("valid", [("ATTEST_ISSUER_MISMATCH", "critical")])
    assert out["other"] == ("wrong_recipient", [("ATTEST_INVALID", "high")]) and out["old"] == ("expired", [("ATTEST_INVALID", "high")])
    assert out["forged"] == ("unknown_key", [("ATTEST_INVALID", "critical")]) and out["tail"] == ("bad_signature", [("ATTEST_INVALID", "critical")])
    assert out["edited"][0] in ("bad_signature", "unreadable", "unknown_key", "unavailable")
    assert out["nokeys"] == ("unavailable", [("ATTEST_NOT_CHECKED", "info")]) and out["junk"] == ("unreadable", [("ATTEST_NOT_CHECKED", "info")]) and out["none"] == ("none", [])


def test_uploads(spark, tmp_path):
    (tmp_path / "small.bin").write_bytes(b"x" * 10)
    (tmp_path / "large.bin").write_bytes(b"x" * 100)
    out = {r.path.rsplit("/", 1)[1]: (r.accepted, r.content) for r in readers.read_uploads(spark, str(tmp_path), 50).collect()}
    assert out["small.bin"][0] and not out["large.bin"][0] and out["large.bin"][1] is None
