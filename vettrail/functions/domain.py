"""Sender domains against the company that they claim: imitation, borrowed names, throwaway mail.

Every function maps Columns to Columns, without Python workers. Names are decomposed to NFKD (text.decomposed)
as far as letters, digits and the listed look-alikes are concerned, before words and signs are taken out.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import FINDING, finding
from .text import decomposed, from_punycode

# Mail providers, suffixes, corporate and hiring words, look-alikes, folds.
FREE_MAIL = (
    "gmail.com", "googlemail.com", "yahoo.com", "ymail.com", "hotmail.com", "outlook.com", "live.com", "msn.com", "aol.com", "icloud.com",
    "me.com", "proton.me", "protonmail.com", "gmx.com", "mail.com", "zoho.com", "yandex.com", "rediffmail.com",
)
DISPOSABLE_MAIL = (
    "mailinator.com", "guerrillamail.com", "10minutemail.com", "tempmail.com", "throwawaymail.com", "yopmail.com", "trashmail.com",
    "sharklasers.com", "temp-mail.org", "getnada.com", "dispostable.com",
)
BULK_SUFFIXES = (
    "top", "xyz", "icu", "cyou", "sbs", "cfd", "bond", "rest", "click", "link", "live", "shop", "buzz", "monster", "work", "support", "gq",
    "tk", "ml", "cf", "ga",
)
HIRING_WORDS = (
    "careers", "career", "jobs", "job", "hiring", "hire", "recruit", "recruiting", "recruitment", "hr", "talent", "apply", "application",
    "onboarding", "onboard", "offer", "payroll", "staffing", "consultancy", "consulting", "portal", "official", "team", "global", "inc",
    "llc", "group",
)
COMPANY_SUFFIXES = "inc|llc|ltd|limited|corp|corporation|co|gmbh|plc|sa|bv|pvt"
SECOND_LEVEL = ("co", "com", "org", "net", "ac", "gov")
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "ј": "j", "ο": "o", "α": "a", "ε": "e", "ρ": "p", "υ": "u", "Ο": "O",
    "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Κ": "K", "Μ": "M", "Ν": "N", "Ρ": "P", "Τ": "T", "Χ": "X", "ԁ": "d", "ԛ": "q", "ɡ": "g",
}
FOLDS = (("0", "o"), ("1", "l"), ("rn", "m"), ("vv", "w"), ("5", "s"), ("3", "e"))

#: What names are compared by. A combining mark is no part of a word.
_LETTERS = string.ascii_letters + string.digits + "".join(LOOKALIKES)
_WORD = r"[\p{L}\p{N}_]"


def domain_of(address: Column) -> Column:
    """The bare lower-case host of a mail address or URL."""
    s = F.regexp_replace(F.lower(F.btrim(address, F.lit(" \t\n\r\x0b\x0c"))), "^[a-z]+://", "")
    s = F.substring_index(s, "@", -1)
    s = F.substring_index(F.substring_index(F.substring_index(s, "/", 1), "?", 1), ":", 1)
    return F.btrim(s, F.lit(". "))


def name_of(domain: Column) -> Column:
    """The registrable name; an address literal or a single label is its own name."""
    bits = F.split(domain, "[.]")
    return F.when(_whole(domain), domain).when(_two_part(domain), F.try_element_at(bits, F.lit(-3))).otherwise(F.try_element_at(bits, F.lit(-2)))


def suffix_of(domain: Column) -> Column:
    """The public suffix, empty for an address literal or a single label."""
    return F.when(_whole(domain), F.lit("")).when(_two_part(domain), F.substring_index(domain, ".", -2)).otherwise(F.substring_index(domain, ".", -1))


def _whole(domain: Column) -> Column:
    return ~F.contains(domain, F.lit(".")) | domain.rlike("^[0-9]+([.][0-9]+)*$")


def _two_part(domain: Column) -> Column:
    return domain.rlike(f"[.]?[^.]*[.]({'|'.join(SECOND_LEVEL)})[.][^.]{{2}}$")


def base_domain(name: Column, tld: Column) -> Column:
    return F.when(tld == "", name).otherwise(F.concat_ws(".", name, tld))


def bare(s: Column) -> Column:
    return F.regexp_replace(s, "[^a-z0-9]", "")


def company_token(name: Column) -> Column:
    """A company's name without corporate words, letters and digits only; accents come off their letters."""
    return bare(F.regexp_replace(decomposed(name, _LETTERS), f"(?<!{_WORD})({COMPANY_SUFFIXES})(?!{_WORD})", ""))


def skeleton(name: Column) -> Column:
    """Look-alikes folded to what they imitate."""
    out = F.lower(F.translate(decomposed(name, _LETTERS), "".join(LOOKALIKES), "".join(LOOKALIKES.values())))
    for old, new in FOLDS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def punycode(domain: Column) -> Column:
    """Labels that are shown in other scripts than they are written."""
    labels = F.filter(F.split(domain, "[.]"), lambda x: x.startswith("xn--"))
    shown = F.transform(labels, lambda x: F.coalesce(from_punycode(x), x))
    return F.when(F.contains(domain, F.lit("xn--")) & (F.size(labels) > 0), finding(
        "DOMAIN_PUNYCODE_IDN", "The address is shown in characters other than it is written", "critical",
        "Part of this domain is Punycode, so mail clients display non-Latin characters where a reader expects plain letters.",
        evidence=F.array_join(F.zip_with(labels, shown, lambda a, b: F.concat(a, F.lit(" is shown as "), b)), ", "),
        remediation="Type the company's address yourself instead of following links.", meta={"labels": F.array_join(labels, ","), "decoded": F.array_join(shown, ",")},
    ))


def left_of_owner(domain: Column, name: Column, tld: Column) -> Column:
    """What stands left of the registrable part."""
    return F.rtrim(F.substring(domain, F.lit(1), F.greatest(F.length(domain) - F.length(name) - F.length(tld) - 1, F.lit(0))), F.lit("."))


def brand_position(domain: Column, company: Column, token: Column, name: Column, tld: Column, plain: Column) -> Column:
    """The brand stands left of the part that decides who owns the domain."""
    owner, left = F.concat_ws(".", name, tld), left_of_owner(domain, name, tld)
    return F.when((F.length(token) >= 3) & ~F.contains(plain, token) & (left != "") & F.contains(bare(skeleton(left)), token), finding(
        "DOMAIN_BRAND_IN_SUBDOMAIN", F.concat(F.lit("The address names "), company, F.lit(" but belongs to someone else")), "critical",
        F.concat(F.lit("Mail to this address is received by "), owner, F.lit("; whatever stands left of that is the owner's free choice.")),
        evidence=F.concat(domain, F.lit(" is controlled by "), owner), remediation=F.concat(F.lit("Read the domain from the right: its owner is "), owner), meta={"registrable": owner},
    ))


def first_hiring_word(name: Column, token: Column) -> Column:
    """The smallest hiring word whose first occurrence, taken out of the name, leaves the token; null if none does."""

    def hit(word: str) -> Column:
        at = F.locate(word, name)
        rest = F.concat(F.substring(name, F.lit(1), at - 1), F.substring(name, at + len(word), F.length(name)))
        return F.when((at > 0) & (rest == token), F.lit(word))

    return F.coalesce(*[hit(w) for w in sorted(HIRING_WORDS)])


def confusable(company: Column, token: Column, name: Column, tld: Column, fold: Column, plain: Column) -> Column:
    """The name is built to look like the company's: imitation, a small edit, or a hiring word added. fold is the name's skeleton, plain its letters."""
    distance, word, whole = F.levenshtein(plain, token), first_hiring_word(plain, token), base_domain(name, tld)
    imitation = finding(
        "DOMAIN_CONFUSABLE_IMITATION", F.concat(F.lit("The domain looks like "), company, F.lit(" but isn't")), "critical",
        F.concat(name, F.lit(" differs from "), token, F.lit(" in characters that look alike.")),
        evidence=F.concat(whole, F.lit(" folds to "), fold), remediation="Treat it as impersonation until shown otherwise.", meta={"skeleton": fold},
    )
    typo = finding(
        "DOMAIN_TYPOSQUAT", F.concat(F.lit("The domain is a small edit away from "), company), "high",
        F.concat(name, F.lit(" and "), token, F.lit(" differ by "), distance.cast("string"), F.lit(" character(s).")),
        evidence=F.concat(whole, F.lit(" against "), token), remediation="Compare with the address on the company's own site.", meta={"distance": distance},
    )
    combo = finding(
        "DOMAIN_COMBOSQUAT", F.concat(F.lit("The domain adds a hiring word to "), company), "high",
        F.concat(name, F.lit(" is the company's name with '"), word, F.lit("'; a separate registration is open to anyone.")),
        evidence=F.concat(whole, F.lit(" = "), token, F.lit(" + "), word), remediation="See whether the company's own site links to it.", meta={"token": word},
    )
    close = (distance > 0) & (distance <= F.greatest(F.lit(1), F.floor(F.length(token) / 6))) & (F.abs(F.length(plain) - F.length(token)) <= 2)
    return (
        F.when((F.length(token) < 4) | (bare(F.lower(name)) == token), F.lit(None).cast(FINDING))
        .when((fold == token) & (name != token), imitation).when(close, typo).when(word.isNotNull(), combo)
    )


def sender_type(domain: Column, tld: Column, company: Column) -> tuple[Column, Column]:
    """Throwaway or personal mail, and a suffix registered in bulk; null where there is nothing to say."""
    named = F.coalesce(company, F.lit("")) != ""
    throwaway = finding(
        "DOMAIN_DISPOSABLE_MAIL", "The sender uses a throwaway mail service", "critical", "The provider's addresses are made to expire; no employer recruits from one.",
        evidence=domain, remediation="Send no documents or personal details.",
    )
    personal = finding(
        "DOMAIN_FREE_MAIL", "The sender writes from a personal mail account", F.when(named, F.lit(3)).otherwise(F.lit(2)),
        F.concat(domain, F.lit(" gives accounts to anyone. Small firms do use such accounts, so this proves no fraud; it leaves the sender unverified.")),
        evidence=domain, confidence=0.9, remediation="Ask to continue from a company address and verify that address.",
    )
    bulk = finding(
        "DOMAIN_HIGH_ABUSE_TLD", F.concat(F.lit("Suffix that is registered in bulk: ."), tld), "low", "Cheap suffixes are common among short-lived sites, and among many honest ones.",
        evidence=domain, confidence=0.5, remediation="Weigh it together with the rest.",
    )
    mail = F.when(domain.isin(*DISPOSABLE_MAIL), throwaway).when(domain.isin(*FREE_MAIL), personal)
    return mail, F.when(F.substring_index(tld, ".", -1).isin(*BULK_SUFFIXES), bulk)
