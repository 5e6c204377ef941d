"""Domains, URLs and e-mail addresses as native column expressions.

Null in, null out, unless a docstring says otherwise; empty strings count as missing. All builders stay inside code
generation: no Python function runs per row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public suffixes known without a full list; load a longer one with load_suffixes().
SUFFIXES = (
    "com net org edu gov mil int info biz name pro io co ai app dev me tv eu us uk de fr es pt it nl be ch at se no dk fi pl cz ru ua jp cn in br mx ca au nz za ie "
    "co.uk org.uk ac.uk gov.uk co.jp ne.jp or.jp ac.jp com.au net.au org.au co.nz com.br com.mx co.za co.in com.cn com.tr com.sg com.hk co.kr"
).split()
#: Reserved top-level names of test data; used where invented hosts must have a suffix.
RESERVED = ["example", "test", "invalid", "co.example", "co.test", "co.invalid"]
#: Mailbox providers whose addresses belong to persons, not to the domain.
WEBMAIL = ["gmail.com", "googlemail.com", "yahoo.com", "outlook.com", "hotmail.com", "live.com", "msn.com", "icloud.com", "aol.com", "gmx.de", "gmx.net", "web.de", "proton.me", "mail.ru", "yandex.ru"]
FILE_ENDINGS = ["png", "jpg", "jpeg", "gif", "svg", "webp", "css", "js", "ico", "pdf", "zip", "mp4", "woff", "woff2", "json", "xml"]
#: What a link's path or query holds that may lead to addresses, and the segments that count once more.
HINTS = [
    "contact", "support", "help", "about", "legal", "privacy", "impressum", "kontakt", "customer", "service", "connect", "reach", "team", "career", "press", "investor",
    "sitemap", "site-map", "abuse", "phishing", "foot", "get-in", "inquiry", "inquiries", "ayuda", "aide", "contacto", "contato", "kund", "kunden", "fraud",
]
STRONG_SEGMENT = r"/(contact|support|help|legal|impress|privacy|kontakt|mail)(/|$|\.html?)"

#: Most suffixes that are tested as one pattern; a longer list is tested label by label.
PATTERN_SUFFIXES = 500

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
URL = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s<>()\[\]\"']*)?"


def _list(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def load_suffixes(df: DataFrame, column: str = "suffix", most: int = 20_000) -> list[str]:
    """A suffix table as a list; more rows than ``most`` are an error, as the list goes into the plan."""
    rows = df.select(F.lower(F.trim(column))).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} suffixes")
    return sorted(r[0] for r in rows if r[0])


def labels(host: Column) -> Column:
    """Labels of a host, empty ones dropped."""
    return F.filter(F.split(F.lower(F.trim(host)), r"\."), lambda x: x != "")


def normalize_domain(d: Column) -> Column:
    """Trimmed, small letters, no dot at the end."""
    return F.regexp_replace(F.lower(F.trim(d)), r"\.+$", "")


def strip_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def email_host(address: Column) -> Column:
    """What follows the last @, null without one."""
    return F.when(F.instr(address, "@") > 0, normalize_domain(F.substring_index(address, "@", -1)))


def host_of(url: Column) -> Column:
    """Host of a URL in small letters without user, port and ``www.``; null if there is none."""
    h = F.regexp_extract(F.trim(url), r"^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.when(h != "", strip_www(F.lower(h)))


def with_scheme(url: Column) -> Column:
    """The URL, http:// put before one without a scheme."""
    u = F.trim(url)
    return F.when(u.rlike(r"^(?i:[a-z][a-z0-9+.-]*)://"), u).otherwise(F.concat(F.lit("http://"), u))


def site_root(url: Column) -> Column:
    """``scheme://host/`` of an http URL, else null."""
    scheme = F.lower(F.regexp_extract(F.trim(url), r"^(?i:(https?))://", 1))
    return F.when((scheme != "") & host_of(url).isNotNull(), F.concat(scheme, F.lit("://"), host_of(url), F.lit("/")))


def site_roots(urls: Column) -> Column:
    """Site roots of an array, first ones kept in order."""
    return F.array_distinct(F.filter(F.transform(urls, site_root), lambda x: x.isNotNull()))


def visit_key(url: Column) -> Column:
    """The URL without its fragment."""
    return F.substring_index(F.trim(url), "#", 1)


def link_priority(url: Column, hints: Sequence[str] = HINTS) -> Column:
    """2 for each hint within ``path?query``, 1 more where that has a strong segment."""
    rest = F.regexp_replace(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*", "")
    rest = F.regexp_replace(rest, "#.*$", "")
    path, asked = F.substring_index(rest, "?", 1), F.when(F.contains(rest, F.lit("?")), F.regexp_replace(rest, r"^[^?]*\?", "")).otherwise(F.lit(""))
    rest = F.concat(F.when(path == "", F.lit("/")).otherwise(path), F.lit("?"), asked)
    hits = F.size(F.filter(_list(hints), lambda x: F.contains(rest, x)))
    strong = rest.rlike(STRONG_SEGMENT)
    return F.when(url.isNotNull(), (hits * 2 + F.when(strong, 1).otherwise(0)).cast("double"))


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The longest known suffix of a host, '' if none is known."""
    known = _list(list(suffixes))
    parts = labels(host)
    n = F.size(parts)
    at = F.array_min(F.filter(F.when(n >= 1, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))), lambda i: F.array_contains(known, F.array_join(F.slice(parts, i, n - i + 1), "."))))
    return F.when(host.isNotNull(), F.coalesce(F.array_join(F.slice(parts, at, n - at + 1), "."), F.lit("")))


def registrable(host: Column, suffixes: Sequence[str] = SUFFIXES, fallback: str = "null") -> Column:
    """Label and suffix of a host. Without a known suffix, or label before it: null, '' or the host, as ``fallback`` says."""
    if len(suffixes) <= PATTERN_SUFFIXES:
        # The leftmost label after which only a suffix follows: the one before the longest suffix.
        clean = F.regexp_replace(F.regexp_replace(normalize_domain(host), r"\.{2,}", "."), r"^\.", "")
        pattern = r"(?:^|\.)([^.]+\.(?:" + "|".join(re.escape(x) for x in sorted(suffixes, key=len, reverse=True)) + "))$"
        got = F.regexp_extract(clean, pattern, 1)
        found = F.when(got != "", got)
    else:
        known = _list(list(suffixes))
        parts = labels(host)
        n = F.size(parts)
        at = F.array_min(F.filter(F.when(n >= 2, F.sequence(F.lit(2), F.greatest(n, F.lit(2)))), lambda i: F.array_contains(known, F.array_join(F.slice(parts, i, n - i + 1), "."))))
        found = F.array_join(F.slice(parts, at - 1, n - at + 2), ".")
    other = {"null": F.lit(None).cast("string"), "empty": F.lit(""), "host": normalize_domain(host)}[fallback]
    return F.when(host.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(found, other))


def registrable_naive(host: Column) -> Column:
    """Two labels, three below a second level such as co.uk; for hosts without a suffix list."""
    parts = labels(host)
    n = F.size(parts)
    second = F.element_at(parts, F.when(n >= 2, -2).otherwise(-1))
    three = (n >= 3) & (F.length(F.element_at(parts, F.when(n >= 1, -1).otherwise(1))) == 2) & second.isin("co", "com", "org", "net", "ac", "gov", "edu")
    return F.when(n >= 2, F.array_join(F.slice(parts, F.when(three, n - 2).otherwise(n - 1), F.when(three, 3).otherwise(2)), ".")).otherwise(F.array_join(parts, "."))


def domain_set(addresses: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """Registrable domains of an array of addresses or URLs; text that is neither gives none."""
    host = lambda a: F.coalesce(host_of(a), email_host(a))
    return F.array_distinct(F.filter(F.transform(F.coalesce(addresses, F.array().cast("array<string>")), lambda a: registrable(host(a), suffixes)), lambda x: x.isNotNull()))


def sld(domain: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The label before the suffix, null without a known suffix."""
    return F.substring_index(registrable(domain, suffixes), ".", 1)


def domains_overlap(a: Column, b: Column, suffixes: Sequence[str] = SUFFIXES, strict_suffix: bool = False) -> Column:
    """Whether two arrays of domains share a name. Suffixes must be known and, only if strict, equal."""
    pick = (lambda x: registrable(x, suffixes)) if strict_suffix else (lambda x: sld(x, suffixes))
    side = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), pick), lambda x: x.isNotNull())
    return F.arrays_overlap(side(a), side(b))


def sender_key(address: Column, suffixes: Sequence[str] = SUFFIXES, webmail: Sequence[str] = WEBMAIL) -> Column:
    """The whole address for shared mailbox providers, else its registrable domain, else its host or text."""
    low = F.lower(F.trim(address))
    host = F.coalesce(email_host(low), normalize_domain(low))
    domain = registrable(host, suffixes, "host")
    return F.when(domain.isin(list(webmail)), low).otherwise(domain)


def is_email(s: Column) -> Column:
    return F.coalesce(F.trim(s).rlike(f"^{EMAIL}$"), F.lit(False))


def strip_trailing_junk(s: Column) -> Column:
    return F.regexp_replace(F.trim(s), r"[.,;:)\]}>\"']+$", "")


def emails_in(text: Column) -> Column:
    """All addresses in a text, in order, repeats kept."""
    return F.regexp_extract_all(text, F.lit(f"({EMAIL})"), F.lit(1))


def standalone_domains(text: Column) -> Column:
    """``postmaster@domain`` for each bare ``@domain`` in a text that is no file name."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9._%+-])@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"), F.lit(1))
    kept = F.filter(found, lambda d: ~F.lower(F.substring_index(d, ".", -1)).isin(FILE_ENDINGS))
    return F.transform(kept, lambda d: F.concat(F.lit("postmaster@"), F.lower(d)))


def clean_emails(items: Column) -> Column:
    """Valid addresses of an array, junk stripped, one spelling (the first) of those equal but for case."""
    valid = F.filter(F.transform(items, strip_trailing_junk), is_email)
    low = F.transform(valid, F.lower)
    return F.filter(F.transform(valid, lambda x, i: F.when(F.array_position(low, F.lower(x)) == (i + 1).cast("long"), x)), lambda x: x.isNotNull())


def mailto_address(href: Column) -> Column:
    """The address of a mailto link without its query, decoded; null for other links."""
    raw = F.regexp_extract(F.trim(href), r"^(?i:mailto:)([^?]*)", 1)
    return F.when(raw != "", F.trim(F.try_url_decode(F.regexp_replace(raw, r"\+", "%2B"))))


def anchors(html: Column) -> Column:
    """href values of all anchors."""
    return F.regexp_extract_all(html, F.lit(r"(?i)<a[^>]*\shref=[\"']([^\"']+)[\"']"), F.lit(1))


def urls_in(text: Column) -> Column:
    """Distinct http URLs of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({URL})"), F.lit(1)))


def sitemap_locations(xml: Column) -> Column:
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), F.trim)


def is_sitemap_index(xml: Column) -> Column:
    return xml.rlike("(?i)<sitemapindex")


def host_allowed(host: Column, allowed: Column) -> Column:
    """Whether a host is one of an array of allowed hosts or below one."""
    h = normalize_domain(host)
    return F.coalesce(F.exists(F.transform(allowed, normalize_domain), lambda a: (h == a) | F.endswith(h, F.concat(F.lit("."), a))), F.lit(False))


def host_suffixes(host: Column) -> Column:
    """The host and every host above it; exploded, they turn the test of host_allowed into an equi-join."""
    parts = labels(host)
    n = F.size(parts)
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, n - i + 1), ".")))


def suffix_match(host: Column, core: Column) -> Column:
    h, c = normalize_domain(host), normalize_domain(core)
    return (h == c) | F.endswith(h, F.concat(F.lit("."), c))


def weak_match(host: Column, core: Column) -> Column:
    """Equal, below, or of the same naive registrable domain."""
    return suffix_match(host, core) | (registrable_naive(host) == registrable_naive(core))


def blocked_for_expansion(domain: Column) -> Column:
    """Government and military domains, which a knowledge base never takes over by itself."""
    return normalize_domain(domain).rlike(r"(^|\.)(gov|mil|gob|gouv|bund)(\.[a-z]{2})?$")


def brand_prefixes(domain: Column) -> Column:
    """The first 4 and 6 characters of the first label."""
    first = F.substring_index(normalize_domain(domain), ".", 1)
    return F.array_distinct(F.filter(F.array(F.when(F.length(first) >= 4, F.left(first, F.lit(4))), F.when(F.length(first) >= 6, F.left(first, F.lit(6)))), lambda x: x.isNotNull()))


def token_overlap(a: Column, b: Column) -> Column:
    """Whether two labels share a part of 4 characters or more between hyphens."""
    parts = lambda c: F.filter(F.split(F.lower(c), "[-_]+"), lambda x: F.length(x) >= 4)
    return F.arrays_overlap(parts(a), parts(b))


def is_ip_host(host: Column) -> Column:
    return F.coalesce(host.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$|^\[?[0-9a-fA-F]*:[0-9a-fA-F:]+\]?$"), F.lit(False))


def rejects_grants(apex: Column, org: Column) -> Column:
    """Whether an apex ends in grants.org although the organisation's name says nothing of grants."""
    return F.coalesce(F.endswith(F.lower(apex), F.lit("grants.org")) & ~F.contains(F.lower(F.coalesce(org, F.lit(""))), F.lit("grant")), F.lit(False))
