"""Signed attestations: read, look up the issuer's published key, check the signature, then expiry and recipient."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.domain import domain_of
from ..model import finding, none
from . import ed25519

# Fixed values of the format. The recipient's digest has a constant prefix and no issuer in it; the
# prefix is the token family's own and a parameter wherever a digest is made or compared.
PREFIX, ALGORITHM = "gt1", "ed25519"
RECIPIENT_PREFIX = "recipient:"
PAYLOAD = "v int, iss string, kid string, role string, rec string, aud string, iat string, exp string, jti string"


def _b64(raw: bytes) -> str:
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def issue(seed: bytes, issuer: str, role: str, recruiter: str, issued: str, expires: str, recipient: str | None = None, jti: str = "1", prefix: str = RECIPIENT_PREFIX) -> str:
    """A signed token, on the driver: the payload is canonical JSON (sorted keys, no spaces)."""
    payload = {"v": 1, "iss": issuer, "kid": issuer_key(seed, issuer)["kid"], "role": role, "rec": recruiter, "iat": issued, "exp": expires, "jti": jti}
    if recipient:
        payload["aud"] = hashlib.sha256((prefix + recipient.strip().lower()).encode()).hexdigest()[:32]
    body = json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()
    return f"{PREFIX}.{_b64(body)}.{_b64(ed25519.sign(seed, body))}"


def issuer_key(seed: bytes, domain: str) -> dict[str, str]:
    """The published entry of a key, on the driver."""
    public = ed25519.public_key(seed)
    return {"domain": domain, "kid": hashlib.sha256(public).hexdigest()[:16], "alg": ALGORITHM, "public_key": _b64(public), "created": "2026-01-01"}


#: What stands before the 32 bytes of such a private key in its standard binary form (fixed value, RFC 8410).
_KEY_HEAD = bytes.fromhex("302e020100300506032b657004220420")


def private_pem(seed: bytes) -> str:
    """A private key as PEM text, on the driver."""
    return f"-----BEGIN PRIVATE KEY-----\n{base64.b64encode(_KEY_HEAD + seed).decode()}\n-----END PRIVATE KEY-----\n"


def seed_of(pem: str) -> bytes:
    """The private key in a PEM text; ValueError for anything but an Ed25519 key without a password."""
    lines = [x.strip() for x in pem.strip().splitlines()]
    if len(lines) < 3 or lines[0] != "-----BEGIN PRIVATE KEY-----" or lines[-1] != "-----END PRIVATE KEY-----":
        raise ValueError("not a private key in PEM")
    raw = base64.b64decode("".join(lines[1:-1]), validate=True)
    if len(raw) != len(_KEY_HEAD) + 32 or not raw.startswith(_KEY_HEAD):
        raise ValueError("not an Ed25519 private key")
    return raw[len(_KEY_HEAD) :]


def key_document(seed: bytes, domain: str, contact: str | None = None) -> dict:
    """What a domain publishes about its key, on the driver."""
    domain = domain.strip().lower()
    key = issuer_key(seed, domain)
    out = {"version": 1, "domain": domain, "keys": [{k: key[k] for k in ("kid", "alg", "public_key", "created")}], "note": f"Public keys that sign messages of {domain}."}
    return out | ({"report_abuse": contact} if contact else {})


def hash_recipient(email: Column, prefix: str = RECIPIENT_PREFIX) -> Column:
    """32 hex digits of the SHA-256 of prefix and normalised address."""
    return F.substring(F.sha2(F.concat(F.lit(prefix), F.lower(F.trim(email))), 256), 1, 32)


def key_id(public: Column) -> Column:
    """First 16 hex digits of the raw key's SHA-256."""
    return F.substring(F.sha2(public, 256), 1, 16)


def decode(part: Column) -> Column:
    """URL-safe unpadded base 64, null where it isn't."""
    plain = F.translate(part, "-_", "+/")
    return F.when(plain.rlike("^[A-Za-z0-9+/]*$"), F.unbase64(plain))


def read_tokens(df: DataFrame, token: str = "attestation") -> DataFrame:
    """Adds readable, body and the payload's fields; nothing is verified."""
    parts = F.split(F.trim(F.col(token)), "[.]")
    shaped = (F.size(parts) == 3) & (parts[0] == PREFIX) & parts[1].rlike("^[A-Za-z0-9_-]+$") & parts[2].rlike("^[A-Za-z0-9_-]+$")
    df = df.withColumn("_body", F.when(shaped, decode(parts[1]))).withColumn("_signature", F.when(shaped, F.try_element_at(parts, F.lit(3))))
    df = df.withColumn("_claim", F.from_json(F.decode("_body", "UTF-8"), PAYLOAD, {"mode": "PERMISSIVE"}))
    return df.withColumn("readable", F.coalesce(F.col("_claim.iss").isNotNull() & F.col("_claim.kid").isNotNull() & F.col("_claim.exp").isNotNull(), F.lit(False)))


def _signed(body: pd.Series, signature: pd.Series, public: pd.Series) -> pd.Series:
    def one(b, s, p):
        if b is None or s is None or p is None:
            return None
        try:
            raw = lambda x: base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))
            return ed25519.verify(raw(p), bytes(b), raw(s))
        except (binascii.Error, ValueError):
            return False

    return pd.Series([one(*x) for x in zip(body, signature, public)], dtype=object)


def signed(body: str, signature: str, public: str) -> Column:
    """Whether each body's signature is the key's; null where no key is published. The raw bytes are checked, never JSON written anew."""
    return F.pandas_udf(_signed, "boolean")(body, signature, public)


def check_attestations(df: DataFrame, keys: DataFrame, published: DataFrame, now: Column, sender: str = "sender", prefix: str = RECIPIENT_PREFIX) -> DataFrame:
    """Adds attestation_state, attested_role, issuer and attestation_findings.

    keys: (domain, kid, alg, public_key), one for each domain, kid and algorithm; published: domains whose key document was read. A domain that
    isn't there is unavailable, which is not the same as publishing no such key. The state is the first
    of: none, unreadable, unavailable, unknown_key, bad_signature, unreadable_expiry, expired,
    wrong_recipient, valid. The signature function runs on rows with a published key only.
    """
    c = F.col
    df = read_tokens(df)
    known = published.select(F.lower("domain").alias("_issuer"), F.lit(True).alias("_available")).distinct()
    first = keys.filter(c("alg") == ALGORITHM).groupBy(F.lower("domain").alias("_issuer"), c("kid").alias("_kid")).agg(F.min("public_key").alias("_public"))
    df = df.withColumns({"_issuer": F.lower("_claim.iss"), "_kid": c("_claim.kid")}).join(known, "_issuer", "left").join(first, ["_issuer", "_kid"], "left")
    df = df.withColumn("_genuine", F.when(c("_public").isNotNull(), signed("_body", "_signature", "_public")))
    expiry = F.try_to_timestamp(c("_claim.exp"))
    mismatch = (F.coalesce("recipient_email", F.lit("")) != "") & (F.coalesce("_claim.aud", F.lit("")) != "") & (hash_recipient(c("recipient_email"), prefix) != c("_claim.aud"))
    state = (
        F.when(F.coalesce("attestation", F.lit("")) == "", "none").when(~c("readable"), "unreadable").when(c("_available").isNull(), "unavailable").when(c("_public").isNull(), "unknown_key")
        .when(~c("_genuine"), "bad_signature").when(expiry.isNull(), "unreadable_expiry").when(expiry < now, "expired").when(mismatch, "wrong_recipient").otherwise("valid")
    )
    df = df.withColumns({"attestation_state": state, "issuer": c("_claim.iss")})
    df = df.withColumn("attested_role", F.when(c("attestation_state") == "valid", c("_claim.role")))
    domain = domain_of(F.coalesce(c(sender), F.lit("")))
    elsewhere = (domain != "") & (domain != c("_issuer")) & ~F.endswith(domain, F.concat(F.lit("."), c("_issuer")))
    unchecked = finding("ATTEST_NOT_CHECKED", "The attestation wasn't checked", "info", "It couldn't be read or its issuer's keys weren't to be had.", evidence=F.coalesce("issuer", F.lit("unreadable")), remediation="Try again with a connection.")
    moved = finding("ATTEST_ISSUER_MISMATCH", "A genuine attestation from another sender", "critical", "It proves who issued it, not who sent this message.", evidence=F.concat(F.lit("issued by "), c("_issuer"), F.lit(", sent from "), domain), remediation="Treat the message as impersonation.")
    valid = finding("ATTEST_VALID", F.concat(F.lit("Signed by "), c("issuer")), "info", "The origin is confirmed; the terms aren't.", evidence=F.concat(F.lit("role="), F.coalesce("_claim.role", F.lit(""))), remediation="Origin confirmed.", meta={"role": c("_claim.role")})
    wrong = finding("ATTEST_INVALID", "The attestation doesn't hold", F.when(c("attestation_state").isin("expired", "wrong_recipient"), 3).otherwise(4), c("attestation_state"), evidence=F.concat(F.lit("claimed issuer: "), F.coalesce("issuer", F.lit("unknown"))), remediation="Don't rely on the claimed origin.", meta={"state": c("attestation_state")})
    findings = (
        F.when(c("attestation_state") == "none", none()).when(c("attestation_state").isin("unreadable", "unavailable"), F.array(unchecked))
        .when((c("attestation_state") == "valid") & elsewhere, F.array(moved)).when(c("attestation_state") == "valid", F.array(valid)).otherwise(F.array(wrong))
    )
    return df.withColumn("attestation_findings", findings).drop("_body", "_signature", "_claim", "readable", "_issuer", "_kid", "_available", "_public", "_genuine")
