"""The registered queries as SQL for another engine, written from the semantics and not from the Column code."""

from __future__ import annotations

from ..functions import domain as D
from ..functions import instructions as I
from ..functions import requests as R
from ..operators import documents as L
from ..operators import employers as E
from ..operators import postings as P
from . import derive
from .derive import for_oracle
from .verify import STAGES


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(x: str, values) -> str:
    return f"{x} IN ({', '.join(map(_quote, values))})"


def _domain(x: str) -> str:
    s = f"regexp_replace(lower(trim({x})), '^[a-z]+://', '')"
    s = f"regexp_extract({s}, '([^@]*)$', 1)"
    return f"trim(regexp_extract({s}, '^([^/?:]*)', 1), '. ')"


def _whole(x: str) -> str:
    return f"(strpos({x}, '.') = 0 OR regexp_full_match({x}, '[0-9]+([.][0-9]+)*'))"


def _two(x: str) -> str:
    b = f"string_split({x}, '.')"
    return f"(len({b}) >= 3 AND {_in(f'{b}[-2]', D.SECOND_LEVEL)} AND length({b}[-1]) = 2)"


def _name(x: str) -> str:
    b = f"string_split({x}, '.')"
    return f"(CASE WHEN {_whole(x)} THEN {x} WHEN {_two(x)} THEN {b}[-3] ELSE {b}[-2] END)"


def _tld(x: str) -> str:
    b = f"string_split({x}, '.')"
    return f"(CASE WHEN {_whole(x)} THEN '' WHEN {_two(x)} THEN {b}[-2] || '.' || {b}[-1] ELSE {b}[-1] END)"


def _bare(x: str) -> str:
    return f"regexp_replace({x}, '[^a-z0-9]', '', 'g')"


def _apart(x: str) -> str:
    """Accents as marks of their own, for the letters that the derived inputs hold."""
    out = f"lower({x})"
    for whole, letter in (("é", "e"), ("ü", "u"), ("ï", "i"), ("ó", "o")):
        out = f"replace({out}, '{whole}', '{letter}' || chr(769))"
    return out


def _token(x: str) -> str:
    return _bare(f"regexp_replace({_apart(x)}, '\\b({D.COMPANY_SUFFIXES})\\b', '', 'g')")


def _skeleton(x: str) -> str:
    out = f"lower(translate({_apart(x)}, '{''.join(D.LOOKALIKES)}', '{''.join(D.LOOKALIKES.values())}'))"
    for a, b in D.FOLDS:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def _hiring(plain: str, token: str) -> str:
    cases = [f"CASE WHEN strpos({plain}, '{w}') > 0 AND substr({plain}, 1, strpos({plain}, '{w}') - 1) || substr({plain}, strpos({plain}, '{w}') + {len(w)}) = {token} THEN '{w}' END" for w in sorted(D.HIRING_WORDS)]
    return f"coalesce({', '.join(cases)})"


def _confusable(token: str) -> str:
    return (
        f"CASE WHEN length({token}) < 4 OR {_bare('lower(name)')} = {token} THEN NULL WHEN fold = {token} AND name <> {token} THEN 'DOMAIN_CONFUSABLE_IMITATION' "
        f"WHEN levenshtein(plain, {token}) > 0 AND levenshtein(plain, {token}) <= greatest(1, length({token}) // 6) AND abs(length(plain) - length({token})) <= 2 THEN 'DOMAIN_TYPOSQUAT' "
        f"WHEN {_hiring('plain', token)} IS NOT NULL THEN 'DOMAIN_COMBOSQUAT' END"
    )


_SENDER_STEPS = f"""
a AS (SELECT *, {_domain('sender')} AS domain, coalesce(known_domain, '') AS verified FROM o),
b AS (SELECT *, {_name('domain')} AS name, {_tld('domain')} AS tld, {_token('claimed_company')} AS token, {_token(_name('verified'))} AS vtoken FROM a),
d AS (SELECT *, {_skeleton('name')} AS fold, {_bare(_skeleton('name'))} AS plain, rtrim(substr(domain, 1, greatest(length(domain) - length(name) - length(tld) - 1, 0)), '.') AS left_ FROM b),
e AS (SELECT *, {_confusable('token')} AS own, CASE WHEN known_domain IS NOT NULL THEN {_confusable('vtoken')} END AS against,
  CASE WHEN length(token) >= 3 AND strpos(plain, token) = 0 AND left_ <> '' AND strpos({_bare(_skeleton('left_'))}, token) > 0 THEN 'DOMAIN_BRAND_IN_SUBDOMAIN' END AS brand,
  CASE WHEN {_in('domain', D.DISPOSABLE_MAIL)} THEN 'DOMAIN_DISPOSABLE_MAIL' WHEN {_in('domain', D.FREE_MAIL)} THEN 'DOMAIN_FREE_MAIL' END AS mail,
  CASE WHEN {_in("string_split(tld, '.')[-1]", D.BULK_SUFFIXES)} THEN 'DOMAIN_HIGH_ABUSE_TLD' END AS bulk,
  CASE WHEN len(list_filter(string_split(domain, '.'), lambda x: starts_with(x, 'xn--'))) > 0 THEN 'DOMAIN_PUNYCODE_IDN' END AS puny FROM d),
f AS (SELECT *, known_domain IS NOT NULL AND (domain = verified OR ends_with(domain, '.' || verified)) AS matched,
  (known_domain IS NOT NULL AND (puny IS NOT NULL OR mail IS NOT NULL OR bulk IS NOT NULL OR against IS NOT NULL)) OR brand IS NOT NULL OR own IS NOT NULL AS looks FROM e),
g AS (SELECT *, NOT looks AND strpos(plain, token) = 0 AS loose FROM f),
h AS (SELECT *, CASE WHEN matched THEN [{{'k': 0, 'i': 0, 'c': 'DOMAIN_MATCHES_VERIFIED'}}] ELSE list_sort(list_filter([
  CASE WHEN puny IS NOT NULL THEN {{'k': -4, 'i': 1, 'c': puny}} END,
  CASE WHEN mail IS NOT NULL THEN {{'k': CASE WHEN mail = 'DOMAIN_FREE_MAIL' THEN -3 ELSE -4 END, 'i': 2, 'c': mail}} END,
  CASE WHEN bulk IS NOT NULL THEN {{'k': -1, 'i': 3, 'c': bulk}} END,
  CASE WHEN against IS NOT NULL THEN {{'k': -4, 'i': 4, 'c': against || '_VS_VERIFIED'}} END,
  CASE WHEN brand IS NOT NULL THEN {{'k': -4, 'i': 5, 'c': brand}} END,
  CASE WHEN own IS NOT NULL THEN {{'k': CASE WHEN own = 'DOMAIN_CONFUSABLE_IMITATION' THEN -4 ELSE -3 END, 'i': 6, 'c': own}} END,
  CASE WHEN loose THEN {{'k': -2, 'i': 7, 'c': 'DOMAIN_UNRELATED_TO_CLAIM'}} END], lambda x: x IS NOT NULL)) END AS found FROM g),
v AS (SELECT *, CASE WHEN matched THEN 'matches_claim' WHEN looks THEN 'lookalike' WHEN loose THEN 'unrelated' WHEN len(found) > 0 AND found[1].k <= -3 THEN 'lookalike' ELSE 'unverifiable' END AS verdict FROM h)
"""
_SENDERS = f"WITH o AS ({for_oracle(derive.OUTREACH)}),{_SENDER_STEPS}"


def _practice_rows(messages: str = for_oracle(derive.MESSAGES)) -> str:
    """Findings of messages; the one look-ahead pattern goes without that branch, which no derived message has."""
    parts = []
    for tier_no, tier in enumerate(R.TIERS):
        for n, (code, of, severity, pattern) in enumerate(R.PRACTICES):
            if of != tier:
                continue
            pattern = pattern.replace(r"|\bour\s+client\b(?![^.\n]{0,20}\b(is|,)\b)", "")
            level = f"CASE WHEN offer THEN 'low' ELSE '{severity}' END" if code == R.ONLY_BEFORE_OFFER else f"'{severity}'"
            parts.append(f"SELECT msg_id, message, 'PRACTICE_{code}' AS code, '{tier}' AS tier, {level} AS severity, {100 * tier_no + n} AS place, regexp_extract(message, {_quote('(?is)' + pattern)}, 0) AS matched FROM m")
    source = f"(SELECT *, regexp_matches(message, {_quote('(?is)' + R.OFFER_PRESENT)}) AS offer FROM ({messages}) q)"
    return f"m AS (SELECT * FROM {source} s), r AS ({' UNION ALL '.join(parts)}) "


def _instruction_rows(layer: str, source: str = for_oracle(derive.TEXTS)) -> str:
    parts = []
    for name, critical, pattern in I.PATTERNS:
        rank = f"CASE WHEN {layer} = 'hidden' THEN 'critical' " + (f"WHEN {layer} <> 'visible' THEN 'critical' " if critical else "") + (
            f"WHEN {layer} = 'metadata' THEN 'high' WHEN {layer} = 'visible' AND discussed THEN 'info' WHEN {layer} = 'visible' THEN 'low' ELSE 'medium' END"
        )
        parts.append(f"SELECT doc_id, body, {layer} AS layer, discussed, 'INJECTION_{name.upper()}' AS code, {rank} AS severity, regexp_extract(body, {_quote('(?is)' + pattern)}, 0) AS matched FROM t")
    return f"t AS (SELECT *, regexp_matches(body, {_quote('(?is)' + I.DISCUSSION)}) AS discussed FROM ({source}) q), i AS ({' UNION ALL '.join(parts)})"


_TAG, _BIDI = r"[\x{E0000}-\x{E007F}]", r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]"
_ZERO = r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{00AD}\x{180E}]"
_LOOK = "[" + "".join(D.LOOKALIKES) + "]"


def _n(pattern: str, x: str = "body") -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


_UNICODE = f"""u AS (
SELECT doc_id, 'UNICODE_TAG_SMUGGLING' AS code, 'critical' AS severity, {_n(_TAG)} AS n, list_aggregate(list_transform(regexp_extract_all(body, '{_TAG}'), lambda x: chr(unicode(x) - 917504)), 'string_agg', '') AS payload FROM s WHERE {_n(_TAG)} > 0
UNION ALL SELECT doc_id, 'ZERO_WIDTH_CHARS', CASE WHEN {_n(_ZERO)} <= 3 AND {_n('[' + chr(0xFEFF) + chr(0xAD) + ']')} = {_n(_ZERO)} THEN 'info' WHEN {_n(_ZERO)} >= 20 THEN 'high' ELSE 'low' END, {_n(_ZERO)}, '' FROM s WHERE {_n(_ZERO)} > 0
UNION ALL SELECT doc_id, 'BIDI_CONTROL_CHARS', CASE WHEN regexp_matches(body, '[\\x{{202D}}\\x{{202E}}]') THEN 'high' WHEN regexp_matches(body, '[\\x{{0590}}-\\x{{08FF}}]') THEN 'info' ELSE 'medium' END, {_n(_BIDI)}, '' FROM s WHERE {_n(_BIDI)} > 0
UNION ALL SELECT doc_id, 'HOMOGLYPH_SUBSTITUTION', CASE WHEN k > 2 THEN 'high' ELSE 'medium' END, k, '' FROM (SELECT doc_id, len(list_filter(string_split_regex(body, '\\s+'), lambda w: regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '{_LOOK}'))) AS k FROM s) z WHERE k > 0)"""

_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"

_COMPANIES = f"c0 AS (SELECT company, lower(company || ' official website careers') AS q FROM ({for_oracle(derive.COMPANIES)}) n), "
_RESULT_STEPS = f"""r0 AS ({for_oracle(derive.RESULTS)}),
r1 AS (SELECT c0.company, r0.rank, r0.url, r0.score, {_domain('r0.url')} AS d FROM c0 JOIN r0 ON lower(trim(r0.query)) = c0.q),
r2 AS (SELECT *, {_name('d')} AS name, {_tld('d')} AS tld, {_token('company')} AS token FROM r1),
r3 AS (SELECT *, CASE WHEN tld = '' THEN name ELSE name || '.' || tld END AS base FROM r2),
r4 AS (SELECT company, base, sum(cast(round((CASE WHEN score = 0 THEN 0.5 ELSE score END + CASE WHEN token <> '' AND strpos({_token('name')}, token) > 0 THEN 1.5 ELSE 0 END) * 1000) AS bigint)) AS w, min(rank) AS first
  FROM r3 WHERE NOT ({_in('base', E.AGGREGATORS)} OR {_in('d', E.AGGREGATORS)} OR {_in('base', D.FREE_MAIL)}) GROUP BY company, base)"""
_RESULTS = _COMPANIES + _RESULT_STEPS
#: Evidence on every company of c0.
_EMPLOYERS = f"""best AS (SELECT company, base, w, sum(w) OVER (PARTITION BY company) AS total, row_number() OVER (PARTITION BY company ORDER BY w DESC, first, base) AS n FROM r4),
hits AS (SELECT company, count(*) AS n FROM r1 GROUP BY company), ran AS (SELECT DISTINCT lower(trim(query)) AS q FROM ({for_oracle(derive.SEARCHED)}) x),
seen AS (SELECT c0.company, best.base, best.w, best.total, coalesce(hits.n, 0) AS hits, ran.q IS NOT NULL AS checked FROM c0 LEFT JOIN ran ON ran.q = c0.q LEFT JOIN hits ON hits.company = c0.company LEFT JOIN best ON best.company = c0.company AND best.n = 1),
noted AS (SELECT *, CASE WHEN NOT checked THEN 'not_checked' WHEN hits = 0 THEN 'no_footprint' WHEN base IS NULL THEN 'no_own_site' ELSE 'found' END AS note FROM seen),
emp AS (SELECT company, CASE WHEN note = 'found' THEN base END AS likely_domain, round(CASE note WHEN 'found' THEN least(0.95, w / total) WHEN 'no_own_site' THEN 0.3 ELSE 0 END, 6)::double AS confidence, checked, note, hits AS n_sources FROM noted)"""


_SPANS = f"""sp0 AS ({for_oracle(derive.SPANS).replace('{lines}', derive.LINES_ORACLE)}),
sp AS (SELECT *, y0 + 12 AS y1, list_filter([CASE WHEN alpha = 0 THEN 'transparent' END, CASE WHEN render_mode = 3 THEN 'invisible mode' END, CASE WHEN size > 0 AND size <= {L.TINY} THEN 'tiny font' END,
  CASE WHEN sqrt(pow((color_rgb // 65536) % 256 / 255.0 - 1, 2) + pow((color_rgb // 256) % 256 / 255.0 - 1, 2) + pow(color_rgb % 256 / 255.0 - 1, 2)) <= {L.BACKGROUND} * sqrt(3) THEN 'background colour' END,
  CASE WHEN x1 - x0 <= 0.01 THEN 'no area' WHEN x1 < -1 OR x0 > 613 OR y0 + 12 < -1 OR y0 > 793 THEN 'off the page' END], lambda x: x IS NOT NULL) AS why FROM sp0 WHERE trim(text) <> '')"""

_AREA = "greatest(1e-6, ({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0))"
_OX, _OY = "(least(a.x1, b.x1) - greatest(a.x0, b.x0))", "(least(a.y1, b.y1) - greatest(a.y0, b.y0))"

_STOP = ", ".join(map(_quote, P.STOPWORDS))
_POSTING_STEPS = f"""pg AS ({for_oracle(derive.RENDERED)}),
o AS (SELECT domain, 0 AS o, 'https://' || domain AS origin FROM k UNION ALL SELECT domain, 1, 'https://www.' || domain FROM k),
home AS (SELECT o.domain, pg.label, pg.href, row_number() OVER (PARTITION BY o.domain ORDER BY o.o) AS n FROM o JOIN pg ON rtrim(pg.url, '/') = o.origin),
link AS (SELECT domain, -1 AS ord, rtrim(href, '/') AS key, 999 AS below FROM home WHERE n = 1 AND starts_with(href, 'http') AND (regexp_matches(href, {_quote('(?i)' + P.ATS_HOSTS)}) OR (regexp_matches(label, {_quote('(?is)' + P.CAREERS_LINK)}) AND ends_with({_domain('href')}, domain)))),
paths AS (SELECT unnest({list(P.CAREERS_PATHS)!r}) AS path, unnest(range({len(P.CAREERS_PATHS)})) AS p),
tried AS (SELECT * FROM link UNION ALL SELECT domain, o * 8 + p, origin || path, 400 FROM o, paths),
hit AS (SELECT t.domain, pg.*, row_number() OVER (PARTITION BY t.domain ORDER BY t.ord) AS n FROM tried t JOIN pg ON rtrim(pg.url, '/') = t.key WHERE pg.status < t.below),
j AS (SELECT k.domain, k.role, hit.final_url, hit.text, hit.label, hit.href, list_distinct(list_filter(regexp_extract_all(lower(k.role), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP}))) AS tok
  FROM k LEFT JOIN (SELECT * FROM hit WHERE n = 1) hit ON hit.domain = k.domain),
l AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: strpos(lower(x), lower(role)) > 0) AS whole, strpos(lower(label), lower(role)) > 0 AS labelled,
  list_filter(list_concat(string_split(text, chr(10)), CASE WHEN label = '' THEN [] ELSE [label] END), lambda x: len(list_filter(tok, lambda w: strpos(lower(x), w) > 0)) >= greatest(1, round_even(len(tok) * 0.7, 0)) AND length(trim(x)) < 200) AS loose FROM j),
post AS (SELECT domain, role, final_url IS NOT NULL AS checked, CASE WHEN final_url IS NOT NULL THEN len(whole) > 0 OR labelled OR len(loose) > 0 END AS found, final_url AS careers_url,
  CASE WHEN final_url IS NULL THEN NULL WHEN len(whole) > 0 THEN whole[1] WHEN labelled THEN label || ' → ' || href WHEN len(loose) > 0 THEN trim(loose[1]) END AS matched FROM l)"""
_POSTINGS = f"WITH k AS ({for_oracle(derive.ASKED)}), {_POSTING_STEPS} SELECT * FROM post"



#: Spans off the body style. Visible spans of the derived documents stand on rows 16 apart, so a greedy line is a row of its page.
_FONTS = f"""st AS (SELECT document_id, font, round(size, 1) AS size1, sum(length(trim(text))) AS n, min(span_idx) AS i FROM sp WHERE len(why) = 0 GROUP BY ALL),
bs AS (SELECT document_id, font AS body_font, size1 AS body_size FROM st QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC, i) = 1),
vs AS (SELECT sp.*, round(size, 1) AS size1, bs.*exclude(document_id), font = body_font AND round(size, 1) = body_size AS fits, trim(text) AS t FROM sp JOIN bs ON bs.document_id = sp.document_id WHERE len(why) = 0),
ln AS (SELECT *, count(*) OVER row_ AS members, count(*) FILTER (fits) OVER row_ AS fitting, split_part(lower(font), '-', 1) = split_part(lower(body_font), '-', 1) AS same, abs(size1 - body_size) AS delta,
  CASE WHEN regexp_matches(t, {_quote(L.MONEY)}) THEN 'money' WHEN regexp_matches(t, {_quote(L.DATE)}) THEN 'date' WHEN regexp_matches(t, {_quote(L.NAME)}) THEN 'name' END AS field
  FROM vs WINDOW row_ AS (PARTITION BY document_id, page, y0)),
ft AS (SELECT document_id, span_idx, CASE WHEN field IS NOT NULL AND NOT same THEN 'high' WHEN field IS NOT NULL OR NOT same AND delta >= 1 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN field IS NOT NULL AND NOT same THEN 0.8 WHEN field IS NOT NULL THEN 0.65 WHEN NOT same AND delta >= 1 THEN 0.55 ELSE 0.4 END::double AS confidence, field
  FROM ln WHERE members >= 2 AND fitting >= 1 AND NOT fits AND length(t) >= 2 AND NOT (same AND delta < 0.6))"""

_OVERLAYS = f"""pr AS (SELECT a.document_id, a.page, a.span_idx AS ia, b.span_idx AS ib, trim(a.text) AS ta, trim(b.text) AS tb FROM sp a JOIN sp b ON a.document_id = b.document_id AND a.page = b.page AND a.span_idx < b.span_idx
  WHERE {_OX} > 1 AND {_OY} > 1 AND {_OX} * {_OY} / least({_AREA.format('a')}, {_AREA.format('b')}) >= {L.OVERLAP} AND trim(a.text) <> trim(b.text)),
nu AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page, ia, ib) AS i FROM pr)"""


def _rank(severity: str) -> str:
    return f"CASE {severity} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


def _documents() -> str:
    """dx: (document_id, severity, code, layer, confidence, ord, i), every finding of every document, in the order in which the checks run."""
    flat = {
        "combined": "SELECT cast(document_id AS bigint) AS doc_id, array_to_string(list_filter([visible, hidden, meta], lambda x: x <> ''), chr(10)) AS body FROM dl",
        **{k: f"SELECT cast(document_id AS bigint) AS doc_id, {c} AS body, '{k}' AS layer FROM dl WHERE trim({c}) <> ''" for k, c in (("hidden", "hidden"), ("metadata", "meta"), ("visible", "visible"))},
    }
    layer_confidence = "CASE layer WHEN 'hidden' THEN 1.0 WHEN 'metadata' THEN 0.95 WHEN discussed THEN 0.3 ELSE 0.5 END"
    all_texts = " UNION ALL ".join(flat[k] for k in ("hidden", "metadata", "visible"))
    return f"""{_SPANS},
md AS ({for_oracle(derive.METADATA)}),
lx AS (SELECT document_id, coalesce(string_agg(text, ' ' ORDER BY span_idx) FILTER (len(why) = 0), '') AS visible, coalesce(string_agg(text, ' ' ORDER BY span_idx) FILTER (len(why) > 0), '') AS hidden FROM sp GROUP BY document_id),
dl AS (SELECT md.document_id, coalesce(visible, '') AS visible, coalesce(hidden, '') AS hidden, CASE WHEN producer = '' THEN '' ELSE 'producer: ' || producer || chr(10) END || 'title: a file' AS meta, producer FROM md LEFT JOIN lx ON lx.document_id = md.document_id),
s AS ({flat['combined']}), {_UNICODE},
{_instruction_rows('layer', all_texts)},
{_FONTS},
{_OVERLAYS},
dx AS (SELECT cast(doc_id AS varchar) AS document_id, severity, code, CASE code WHEN 'HOMOGLYPH_SUBSTITUTION' THEN 'visible' ELSE 'hidden' END AS layer,
  CASE code WHEN 'BIDI_CONTROL_CHARS' THEN 0.95 WHEN 'HOMOGLYPH_SUBSTITUTION' THEN 0.9 ELSE 1.0 END AS confidence, 0 AS ord, 0 AS i FROM u
UNION ALL SELECT cast(doc_id AS varchar), severity, code, layer, {layer_confidence}, CASE layer WHEN 'hidden' THEN 1 WHEN 'metadata' THEN 2 ELSE 3 END, 0 FROM i WHERE matched <> ''
UNION ALL SELECT document_id, CASE WHEN producer IN ('DocuSign', 'Workday and Word') THEN 'info' ELSE 'low' END, CASE WHEN producer = '' THEN 'DOC_NO_PROVENANCE' WHEN producer = 'LibreOffice 7' THEN 'DOC_GENERIC_PROVENANCE' ELSE 'DOC_HR_PROVENANCE' END,
  'metadata', CASE WHEN producer IN ('DocuSign', 'Workday and Word') THEN 0.6 ELSE 0.5 END, 4, 0 FROM dl WHERE producer <> 'Handmade'
UNION ALL SELECT document_id, CASE WHEN len(regexp_extract_all(hidden, '\\S+')) >= 8 THEN 'high' ELSE 'medium' END, 'HIDDEN_TEXT_LAYER', 'hidden', 0.98, 5, 0 FROM dl WHERE len(regexp_extract_all(hidden, '\\S+')) > 0
UNION ALL SELECT document_id, severity, 'DOC_FONT_INCONSISTENCY', 'visible', confidence, 6, span_idx FROM ft
UNION ALL SELECT document_id, 'high', 'DOC_TEXT_OVERLAY', 'visible', 0.85, 7, i FROM nu WHERE i <= {L.MOST_OVERLAYS})"""


_VERDICT = "CASE WHEN max({0}) >= 3 THEN 'manipulated' WHEN max({0}) = 2 THEN 'review' ELSE 'clean' END"
_SNIPPET = "CASE msg_id % 20 " + " ".join(f"WHEN {i} THEN {_quote(x)}" for i, x in enumerate(derive.SNIPPETS)) + " END"
_ROLE = "CASE (msg_id // 2) % 5 " + " ".join(f"WHEN {i} THEN {_quote(x)}" for i, x in enumerate(derive.ROLES)) + " END"
_TOKEN_STATE = "CASE msg_id % 64 WHEN 0 THEN 'valid' WHEN 1 THEN 'expired' WHEN 2 THEN 'unknown_key' WHEN 3 THEN 'bad_signature' WHEN 4 THEN 'unavailable' WHEN 5 THEN 'unreadable' WHEN 7 THEN 'unreadable_expiry' ELSE 'none' END"


def _orchestration() -> str:
    """The whole verification of the derived messages: vf, a row each, fx, their findings in order, and pg6, their six stages."""
    domain_confidence = "CASE WHEN x.c = 'DOMAIN_FREE_MAIL' THEN 0.9 WHEN x.c = 'DOMAIN_HIGH_ABUSE_TLD' THEN 0.5 WHEN x.c = 'DOMAIN_UNRELATED_TO_CLAIM' THEN 0.8 ELSE 1.0 END"
    return f"""WITH msg AS (SELECT msg_id, label, claimed_company, CASE WHEN msg_id % 101 <> 0 THEN sender END AS sender, CASE WHEN msg_id % 97 = 0 THEN repeat('x', 20001) WHEN msg_id % 9 <> 0 THEN {_SNIPPET} END AS message,
  {_ROLE} AS role, {_TOKEN_STATE} AS token, msg_id % 2 = 0 AS asks, CASE WHEN msg_id % 4 = 0 THEN cast(msg_id // 2 AS varchar) END AS document_id FROM ({for_oracle(derive.OUTREACH)}) z),
ok AS (SELECT * FROM msg WHERE sender IS NOT NULL AND length(coalesce(message, '')) <= 20000),
c0 AS (SELECT DISTINCT claimed_company AS company, lower(trim(claimed_company || ' official website careers')) AS q FROM ok),
emp AS (WITH {_RESULT_STEPS}, {_EMPLOYERS} SELECT * FROM emp),
o AS (SELECT ok.msg_id, ok.sender, ok.claimed_company, emp.likely_domain AS known_domain FROM ok JOIN emp ON emp.company = ok.claimed_company),
v AS (WITH {_SENDER_STEPS} SELECT * FROM v),
r AS (WITH {_practice_rows("SELECT msg_id, message FROM ok WHERE trim(coalesce(message, '')) <> ''").strip()} SELECT * FROM r),
k AS (SELECT DISTINCT o.known_domain AS domain, ok.role FROM ok JOIN o ON o.msg_id = ok.msg_id WHERE ok.asks AND o.known_domain IS NOT NULL),
post AS (WITH {_POSTING_STEPS} SELECT * FROM post),
dr AS (WITH {_documents()} SELECT *, {_rank('severity')} AS rank FROM dx),
dv AS (SELECT cast(documents.doc_id AS varchar) AS document_id, {_VERDICT.format('coalesce(rank, 0)')} AS verdict FROM documents LEFT JOIN dr ON dr.document_id = cast(documents.doc_id AS varchar) GROUP BY ALL),
fu AS (SELECT msg_id, CASE token WHEN 'valid' THEN 'critical' WHEN 'expired' THEN 'high' WHEN 'unreadable' THEN 'info' WHEN 'unavailable' THEN 'info' ELSE 'critical' END AS severity,
  CASE token WHEN 'valid' THEN 'ATTEST_ISSUER_MISMATCH' WHEN 'unreadable' THEN 'ATTEST_NOT_CHECKED' WHEN 'unavailable' THEN 'ATTEST_NOT_CHECKED' ELSE 'ATTEST_INVALID' END AS code, 'visible' AS layer, 1.0 AS confidence, '' AS tier, 0 AS part, 0 AS a, '' AS b, 0 AS c, 0 AS d FROM ok WHERE token <> 'none'
UNION ALL SELECT msg_id, ['info', 'low', 'medium', 'high', 'critical'][1 - x.k], x.c, 'visible', {domain_confidence}, '', 1, x.i, '', 0, 0 FROM (SELECT msg_id, unnest(found) AS x FROM v) y
UNION ALL SELECT msg_id, severity, code, 'visible', 0.85, tier, 2, place, '', 0, 0 FROM r WHERE matched <> ''
UNION ALL SELECT ok.msg_id, CASE note WHEN 'no_footprint' THEN 'high' WHEN 'no_own_site' THEN 'medium' ELSE 'info' END, CASE note WHEN 'not_checked' THEN 'EMPLOYER_NOT_CHECKED' WHEN 'no_footprint' THEN 'EMPLOYER_NO_FOOTPRINT' WHEN 'no_own_site' THEN 'EMPLOYER_NO_OWN_SITE' ELSE 'EMPLOYER_DOMAIN_IDENTIFIED' END,
  'visible', CASE note WHEN 'no_footprint' THEN 0.8 WHEN 'no_own_site' THEN 0.7 WHEN 'found' THEN emp.confidence ELSE 1.0 END, '', 3, 0, '', 0, 0 FROM ok JOIN emp ON emp.company = ok.claimed_company
UNION ALL SELECT ok.msg_id, dr.severity, dr.code, dr.layer, dr.confidence, '', 4, 0, dr.code, dr.ord, dr.i FROM ok JOIN dr ON dr.document_id = ok.document_id
UNION ALL SELECT ok.msg_id, CASE WHEN post.checked AND NOT post.found THEN 'medium' ELSE 'info' END, CASE WHEN NOT post.checked THEN 'POSTING_NOT_CHECKED' WHEN post.found THEN 'POSTING_FOUND' ELSE 'POSTING_NOT_LISTED' END, 'visible', CASE WHEN post.checked AND NOT post.found THEN 0.6 ELSE 1.0 END, '', 5, 0, '', 0, 0
  FROM ok JOIN o ON o.msg_id = ok.msg_id JOIN post ON post.domain = o.known_domain AND post.role = ok.role WHERE ok.asks),
fx AS (SELECT *, {_rank('severity')} AS rank, row_number() OVER (PARTITION BY msg_id ORDER BY {_rank('severity')} DESC, part, a, b, c, d) - 1 AS position FROM fu),
fs AS (SELECT msg_id, count(*) AS n, max(rank) AS worst, count(*) FILTER (tier = 'illegal') AS illegal, count(*) FILTER (rank = 4) AS n4, count(*) FILTER (rank = 3) AS n3, count(*) FILTER (rank = 2) AS n2, count(*) FILTER (part = 2) AS practices,
  bool_or(code = 'ATTEST_ISSUER_MISMATCH') AS moved, bool_or(code = 'POSTING_FOUND') AS listed, bool_or(code = 'EMPLOYER_NOT_CHECKED') AS unchecked, {', '.join(f"coalesce(max(rank) FILTER (part = {i}), 0) AS w{i}" for i in range(6))} FROM fx GROUP BY msg_id),
vf AS (SELECT msg.msg_id, msg.claimed_company, ok.msg_id IS NULL AS refused, ok.sender, v.verdict AS domain_verdict, o.known_domain, ok.token AS attestation_state, post.found AS posting_found, post.checked AS posting_checked, dv.verdict AS document_verdict,
  ok.message, ok.document_id, ok.asks AND o.known_domain IS NOT NULL AS posting_wanted, emp.checked AS employer_checked, fs.*exclude(msg_id, n), coalesce(fs.n, 0) AS n_findings,
  ['info', 'low', 'medium', 'high', 'critical'][1 + coalesce(worst, 0)] AS max_severity,
  CASE WHEN ok.msg_id IS NULL THEN 'refused' WHEN illegal > 0 THEN 'illegal' WHEN moved THEN 'mismatch' WHEN n4 > 0 THEN 'critical' WHEN n3 > 0 THEN 'high' WHEN listed THEN 'listed' WHEN n2 > 0 THEN 'medium' WHEN unchecked THEN 'unchecked' ELSE 'clear' END AS state,
  CASE WHEN msg.sender IS NULL THEN 'sender is missing' WHEN ok.msg_id IS NULL THEN 'message is longer than 20000 characters' WHEN illegal > 0 THEN illegal || ' request(s) here that the law forbids.' WHEN moved THEN 'A genuine attestation is used by another sender.'
  WHEN n4 > 0 THEN n4 || ' serious problem(s) with who sent this or what it asks.' WHEN n3 > 0 THEN n3 || ' thing(s) couldn''t be verified or don''t match.' WHEN listed THEN 'The role is listed by the employer.'
  WHEN n2 > 0 THEN n2 || ' thing(s) deserve a second look.' WHEN unchecked THEN 'Nothing was found, and not everything was checked.' ELSE 'No problem was found.' END AS headline
  FROM msg LEFT JOIN ok ON ok.msg_id = msg.msg_id LEFT JOIN o ON o.msg_id = msg.msg_id LEFT JOIN v ON v.msg_id = msg.msg_id LEFT JOIN emp ON emp.company = ok.claimed_company LEFT JOIN fs ON fs.msg_id = msg.msg_id
  LEFT JOIN post ON ok.asks AND post.domain = o.known_domain AND post.role = ok.role LEFT JOIN dv ON dv.document_id = ok.document_id),
pg6 AS (SELECT msg_id, 0 AS position, 'practices' AS stage, CASE WHEN refused OR trim(coalesce(message, '')) = '' THEN 'skipped' ELSE 'done' END AS status, w2 AS w, false AS positive, coalesce(practices, 0) || ' finding(s)' AS says, 'no message' AS unasked FROM vf
UNION ALL SELECT msg_id, 1, 'employer', CASE WHEN refused THEN 'skipped' WHEN employer_checked THEN 'done' ELSE 'error' END, w3, known_domain IS NOT NULL, coalesce('own domain: ' || known_domain, 'no own site found'), 'no company named' FROM vf
UNION ALL SELECT msg_id, 2, 'domain', CASE WHEN refused THEN 'skipped' ELSE 'done' END, w1, coalesce(domain_verdict = 'matches_claim', false), replace(domain_verdict, '_', ' '), 'refused' FROM vf
UNION ALL SELECT msg_id, 3, 'attestation', CASE WHEN refused OR attestation_state = 'none' THEN 'skipped' WHEN attestation_state = 'valid' THEN 'done' ELSE 'error' END, w0, false, replace(attestation_state, '_', ' '), 'no attestation' FROM vf
UNION ALL SELECT msg_id, 4, 'posting', CASE WHEN refused OR NOT posting_wanted THEN 'skipped' WHEN posting_checked THEN 'done' ELSE 'error' END, w5, coalesce(posting_found, false), CASE WHEN posting_found THEN 'listed' ELSE 'not listed' END, 'not asked for' FROM vf
UNION ALL SELECT msg_id, 5, 'document', CASE WHEN refused OR document_id IS NULL THEN 'skipped' ELSE 'done' END, w4, coalesce(document_verdict = 'clean', false), document_verdict, 'no document' FROM vf),
pp AS (SELECT msg_id, position, stage, status, ['info', 'low', 'medium', 'high', 'critical'][1 + coalesce(w, 0)] AS severity, positive, CASE WHEN status = 'skipped' THEN unasked ELSE coalesce(says, '') END AS summary FROM pg6)
"""


def _per_stage(which: int) -> str:
    return "CASE stage " + " ".join(f"WHEN '{k}' THEN {_quote(v[which])}" for k, v in STAGES.items()) + " END"


def oracle_sql() -> dict[str, str]:
    instructions = _instruction_rows("layer")
    orchestration = _orchestration()
    unknown = _instruction_rows("'unknown'")
    return {
        "d_hosts": f"SELECT page_id, domain, {_name('domain')} AS name, {_tld('domain')} AS tld FROM (SELECT page_id, {_domain('url')} AS domain FROM pages) x",
        "d_sender_tokens": f"""SELECT msg_id, token, plain, levenshtein(plain, token) AS distance, {_hiring('plain', 'token')} AS hiring_word
            FROM (SELECT msg_id, {_token('claimed_company')} AS token, {_bare(_skeleton(_name(_domain('sender'))))} AS plain FROM ({for_oracle(derive.OUTREACH)}) o) x""",
        "d_sender_verdicts": _SENDERS + "SELECT msg_id, domain, verdict, len(found) AS n_findings, array_to_string(list_transform(found, lambda x: x.c), ',') AS codes FROM v",
        "d_sender_summary": _SENDERS + "SELECT verdict, coalesce(-found[1].k, 0) AS max_rank, count(*) AS n FROM v GROUP BY ALL",
        "r_practices": "WITH " + _practice_rows() + "SELECT msg_id, code, tier, severity, matched, strpos(message, matched) - 1 AS at FROM r WHERE matched <> ''",
        "r_practice_tiers": "WITH " + _practice_rows() + "SELECT m.msg_id, " + ", ".join(f"count(*) FILTER (r.tier = '{t}' AND r.matched <> '') AS {t}" for t in R.TIERS) + " FROM m JOIN r ON r.msg_id = m.msg_id GROUP BY m.msg_id",
        "i_instructions": f"WITH {instructions} SELECT doc_id, code, severity, CASE layer WHEN 'hidden' THEN 1.0 WHEN 'metadata' THEN 0.95 WHEN 'visible' THEN CASE WHEN discussed THEN 0.3 ELSE 0.5 END ELSE 0.6 END::double AS confidence, matched, strpos(body, matched) - 1 AS at FROM i WHERE matched <> ''",
        "u_unicode": f"WITH s AS ({for_oracle(derive.TEXTS)}), {_UNICODE} SELECT * FROM u",
        "l_text_verdicts": f"""WITH s AS ({for_oracle(derive.TEXTS)}), {_UNICODE}, {unknown},
            f AS (SELECT doc_id, code, severity FROM u UNION ALL SELECT doc_id, code, severity FROM i WHERE matched <> ''), k AS (SELECT *, {_RANK} AS rank FROM f)
            SELECT s.doc_id, CASE WHEN max(rank) >= 3 THEN 'manipulated' WHEN max(rank) = 2 THEN 'review' ELSE 'clean' END AS verdict, count(k.code) AS n_findings, length(any_value(s.body)) AS chars,
            coalesce(string_agg(k.code, ',' ORDER BY -rank, k.code), '') AS codes FROM s LEFT JOIN k ON k.doc_id = s.doc_id GROUP BY s.doc_id""",
        "e_candidate_domains": f"WITH {_RESULTS} SELECT company, base, round(w / 1000.0, 3)::double AS score FROM r4",
        "e_employers": f"WITH {_RESULTS}, {_EMPLOYERS} SELECT * FROM emp",
        "p_postings": _POSTINGS,
        "l_span_reasons": f"WITH {_SPANS} SELECT document_id, span_idx, array_to_string(why, ',') AS reasons, len(why) > 0 AS hidden FROM sp",
        "l_layers": f"""WITH {_SPANS} SELECT document_id, md5(coalesce(string_agg(text, ' ' ORDER BY span_idx) FILTER (len(why) = 0), '')) AS visible_md5,
            md5(coalesce(string_agg(text, ' ' ORDER BY span_idx) FILTER (len(why) > 0), '')) AS hidden_md5, count(*) AS n_spans, count(*) FILTER (len(why) > 0) AS hidden_spans FROM sp GROUP BY document_id""",
        "l_body_styles": f"""WITH {_SPANS}, st AS (SELECT document_id, font, round(size, 1) AS size1, sum(length(trim(text))) AS n, min(span_idx) AS i FROM sp WHERE len(why) = 0 GROUP BY ALL)
            SELECT document_id, font AS body_font, size1 AS body_size FROM st QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC, i) = 1""",
        "l_fonts": f"WITH {_SPANS}, {_FONTS} SELECT * FROM ft",
        "l_documents": f"""WITH {_documents()}, dr AS (SELECT *, {_rank('severity')} AS rank FROM dx)
            SELECT dl.document_id, {_VERDICT.format('coalesce(rank, 0)')} AS verdict, count(dr.code) AS n_findings FROM dl LEFT JOIN dr ON dr.document_id = dl.document_id GROUP BY dl.document_id""",
        "l_overlays": f"WITH {_SPANS}, {_OVERLAYS} SELECT document_id, i, substr(ta, 1, 80) AS a, substr(tb, 1, 80) AS b FROM nu WHERE i <= {L.MOST_OVERLAYS}",
        "l_provenance": f"""SELECT document_id, code, severity FROM (SELECT document_id, CASE producer WHEN '' THEN 'DOC_NO_PROVENANCE' WHEN 'DocuSign' THEN 'DOC_HR_PROVENANCE' WHEN 'Workday and Word' THEN 'DOC_HR_PROVENANCE' WHEN 'LibreOffice 7' THEN 'DOC_GENERIC_PROVENANCE' END AS code,
            CASE WHEN producer IN ('DocuSign', 'Workday and Word') THEN 'info' WHEN producer = 'Handmade' THEN NULL ELSE 'low' END AS severity FROM ({for_oracle(derive.METADATA)}) m) x""",
        "l_field_kinds": f"""WITH l AS (SELECT doc_id, t || CASE i % 5 WHEN 0 THEN '' WHEN 1 THEN ' $1,200.50' WHEN 2 THEN ' 12/01/2026' WHEN 3 THEN ' Mar 4' ELSE ' John Smith' END AS t FROM {derive.LINES_ORACLE})
            SELECT doc_id, CASE WHEN regexp_matches(t, {_quote(L.MONEY)}) THEN 'money' WHEN regexp_matches(t, {_quote(L.DATE)}) THEN 'date' WHEN regexp_matches(t, {_quote(L.NAME)}) THEN 'name' ELSE 'none' END AS kind, count(*) AS n FROM l GROUP BY ALL""",
        "t_attestations": """WITH s AS (SELECT page_id, page_id % 8 AS n, page_id % 3 = 2 AS away, page_id % 5 = 0 AS other FROM pages),
            k AS (SELECT *, CASE n WHEN 0 THEN CASE WHEN other THEN 'wrong_recipient' ELSE 'valid' END WHEN 1 THEN 'expired' WHEN 2 THEN 'unknown_key' WHEN 3 THEN 'bad_signature' WHEN 4 THEN 'unavailable' WHEN 5 THEN 'unreadable' WHEN 6 THEN 'none' ELSE 'unreadable_expiry' END AS state FROM s)
            SELECT page_id, state, CASE WHEN state = 'none' THEN '' WHEN state IN ('unreadable', 'unavailable') THEN 'ATTEST_NOT_CHECKED:info' WHEN state = 'valid' AND away THEN 'ATTEST_ISSUER_MISMATCH:critical' WHEN state = 'valid' THEN 'ATTEST_VALID:info'
            WHEN state IN ('expired', 'wrong_recipient') THEN 'ATTEST_INVALID:high' ELSE 'ATTEST_INVALID:critical' END AS findings FROM k""",
        "t_digests": f"""SELECT company, substr(sha256('recipient:me@' || company || '.com'), 1, 32) AS recipient,
            substr(sha256('{{"max_results": 6, "q": "' || company || ' official website careers"}}'), 1, 16) AS search_key FROM ({for_oracle(derive.COMPANIES)}) n""",
        "o_verifications": orchestration + "SELECT cast(msg_id AS varchar) AS msg_id, domain_verdict, known_domain, attestation_state, posting_found, document_verdict, max_severity, state, n_findings FROM vf",
        "o_findings": orchestration + "SELECT cast(msg_id AS varchar) AS msg_id, position, code, severity, layer, confidence::double AS confidence FROM fx",
        "o_progress": orchestration + "SELECT cast(msg_id AS varchar) AS msg_id, position, stage, status, severity, positive, summary FROM pp",
        "o_events": orchestration + """SELECT cast(msg_id AS varchar) AS msg_id, 0 AS position, CASE WHEN refused THEN 'error' ELSE 'start' END AS event, '' AS stage, CASE WHEN refused THEN headline ELSE '' END AS says FROM vf
            UNION ALL SELECT cast(pp.msg_id AS varchar), pp.position + 1, 'progress', pp.stage, pp.status FROM pp JOIN vf ON vf.msg_id = pp.msg_id WHERE NOT vf.refused UNION ALL SELECT cast(msg_id AS varchar), 7, 'result', '', state FROM vf WHERE NOT refused""",
        "o_trace": orchestration + f"""SELECT substr(sha256(cast(msg_id AS varchar)), 1, 16) AS run_id, cast(msg_id AS varchar) AS msg_id, * EXCLUDE (msg_id) FROM (
            SELECT msg_id, 0 AS position, 'reasoning' AS step_type, 'Read the message' AS label, NULL AS tool_name, 'sender ' || sender || ', company ' || claimed_company AS summary, 'success' AS status FROM vf WHERE NOT refused
            UNION ALL SELECT msg_id, position + 1, 'tool_call', {_per_stage(2)}, {_per_stage(1)}, summary, CASE status WHEN 'done' THEN 'success' ELSE 'error' END FROM pp WHERE status <> 'skipped'
            UNION ALL SELECT msg_id, 7, 'final_answer', 'Conclude', NULL, max_severity || ': ' || headline, 'success' FROM vf WHERE NOT refused) t""",
        "z_rate_limits": """WITH RECURSIVE e AS (SELECT event_id, cast(user_id AS varchar) AS client, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
            w AS (SELECT event_id, client, ts, n, 1 AS count, ts AS start FROM e WHERE n = 1
            UNION ALL SELECT e.event_id, e.client, e.ts, e.n, CASE WHEN e.ts - w.start >= INTERVAL 1 DAY THEN 1 ELSE w.count + 1 END, CASE WHEN e.ts - w.start >= INTERVAL 1 DAY THEN e.ts ELSE w.start END FROM w JOIN e ON e.client = w.client AND e.n = w.n + 1)
            SELECT event_id, client, count, count <= 2 AS allowed, CASE WHEN count > 2 THEN round(greatest(86400 - epoch(ts - start), 1.0), 3) END AS retry_after FROM w""",
        "z_client_keys": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || (user_id % 250) ELSE 'peer-' || user_id END AS client FROM events",
        "s_anchors": r"""WITH a AS (SELECT url, regexp_extract(x, '(?is)\bhref\s*=\s*["'']([^"'']+)["'']', 1) AS href FROM (SELECT url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=\s*["''][^"'']+["''][^>]*>.*?</a>')) AS x FROM pages) y)
            SELECT url, count(*) AS n_links, min(href) AS first_href, max(href) AS last_href FROM a GROUP BY url""",
    }
