"""Headers of messages as native column expressions over array<struct<name,value>> and texts."""

from __future__ import annotations

from collections.abc import Sequence
from email.header import decode_header as _decode
from email.header import make_header

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def header(headers: Column, name: str) -> Column:
    """First value of a header, any case of its name; null if it is missing."""
    return F.try_element_at(headers_named(headers, name), F.lit(1))


def headers_named(headers: Column, name: str) -> Column:
    """All values of a header in order."""
    return F.transform(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), lambda h: h["value"])


def decode_words(value: str | None) -> str | None:
    if value is None:
        return None
    try:
        return str(make_header(_decode(value)))
    except (LookupError, ValueError, UnicodeDecodeError):
        return "".join(p.decode("utf-8", "replace") if isinstance(p, bytes) else p for p, _ in _decode(value)) if "=?" in value else value


@F.pandas_udf(StringType())
def decode_header(s: pd.Series) -> pd.Series:
    """Encoded words of a header decoded; an unknown character set as UTF-8 with replacements."""
    return s.map(decode_words, na_action="ignore")


def sender_name(raw: Column) -> Column:
    """Name of a From header: ``addr (Name)``, ``Name <addr>``, else the text itself."""
    bracket = F.regexp_extract(raw, r"^\s*[^\s<>()]+@[^\s<>()]+\s+\(([^)]*)\)", 1)
    named = F.regexp_extract(raw, r"^\s*\"?([^\"<]*?)\"?\s*<[^<>]*>\s*$", 1)
    return F.when(bracket != "", F.trim(bracket)).when(raw.rlike(r"<[^<>]*>\s*$"), F.trim(named)).otherwise(F.trim(raw))


def sender_address(raw: Column) -> Column:
    bracket = F.regexp_extract(raw, r"^\s*([^\s<>()]+@[^\s<>()]+)\s+\([^)]*\)", 1)
    angle = F.regexp_extract(raw, r"<([^<>]*)>[^<>]*$", 1)
    return F.when(bracket != "", bracket).when(angle != "", F.trim(angle)).otherwise(F.trim(raw))


def received_for(received: Column) -> Column:
    """Addresses after ``for`` in the Received headers."""
    found = F.transform(received, lambda r: F.regexp_extract(r, r"(?i)\bfor\s+<?([^\s<>;]+@[^\s<>;]+)>?", 1))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def auth_results(headers: Column) -> Column:
    """struct(dmarc, spf, dkim, dkim_domain, spf_domain, auth_domain) from the authentication headers in order of trust."""
    ar = F.concat_ws(" ; ", headers_named(headers, "Authentication-Results"), headers_named(headers, "ARC-Authentication-Results"))
    got = lambda text, p: F.nullif(F.lower(F.regexp_extract(text, p, 1)), F.lit(""))
    spf_text = F.concat_ws(" ", headers_named(headers, "Received-SPF"))
    signature = F.concat_ws(" ; ", headers_named(headers, "DKIM-Signature"))
    dkim_domain = F.coalesce(got(ar, r"(?i)header\.(?:d|i)=@?([^\s;]+)"), got(signature, r"(?i)(?:^|[;\s])d=([^\s;]+)"))
    spf_domain = F.coalesce(got(ar, r"(?i)smtp\.mailfrom=(?:[^\s;@]*@)?([^\s;]+)"), got(spf_text, r"(?i)domain of (?:[^\s@]*@)?([^\s]+)"))
    return F.struct(
        got(ar, r"(?i)\bdmarc=(\w+)").alias("dmarc"),
        F.coalesce(got(ar, r"(?i)\bspf=(\w+)"), got(spf_text, r"^\s*(\w+)")).alias("spf"),
        got(ar, r"(?i)\bdkim=(\w+)").alias("dkim"),
        dkim_domain.alias("dkim_domain"),
        spf_domain.alias("spf_domain"),
        F.coalesce(dkim_domain, spf_domain).alias("auth_domain"),
    )


def auth_status(dmarc: Column, spf: Column, dkim: Column) -> Column:
    """pass, fail or none: DMARC decides, else any pass, else any fail."""
    low = [F.coalesce(F.lower(c), F.lit("")) for c in (dmarc, spf, dkim)]
    return (
        F.when(low[0] == "pass", "pass").when(low[0] == "fail", "fail")
        .when((low[1] == "pass") | (low[2] == "pass"), "pass")
        .when(low[1].isin("fail", "softfail") | (low[2] == "fail"), "fail").otherwise("none")
    )


def join_key(path: Column) -> Column:
    """The last two segments of a path."""
    parts = F.split(F.regexp_replace(path, r"[\\]", "/"), "/")
    return F.concat_ws("/", F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2))


def user_of_path(path: Column, folder: str = "field") -> Column:
    """The segment after a folder name, else the one above the file."""
    named = F.regexp_extract(path, rf"(?:^|/){folder}/([^/]+)/", 1)
    parts = F.split(path, "/")
    return F.when(named != "", named).when(F.size(parts) >= 2, F.element_at(parts, F.when(F.size(parts) >= 2, -2).otherwise(-1)))


#: Marks of subjects that are skipped as replies and forwards.
REPLY_MARKS = ["re:", "fwd:", "fw:", "回复:", "转发:", "reply:"]
#: Marks of other languages, for callers that want them too.
MORE_MARKS = ["aw:", "wg:", "tr:", "sv:", "vs:", "rv:", "enc:"]


def is_reply_subject(subject: Column, anchored: bool = False, marks: Sequence[str] = REPLY_MARKS) -> Column:
    """Whether a subject carries a reply or forward mark: anywhere in it, or at its beginning only."""
    low = F.lower(F.coalesce(subject, F.lit("")))
    return F.exists(F.array(*[F.lit(m) for m in marks]), (lambda m: F.startswith(F.ltrim(low), m)) if anchored else (lambda m: F.contains(low, m)))


def address_format(name: Column, address: Column) -> Column:
    """``Name <addr>``, or the address alone."""
    return F.when(F.coalesce(F.trim(name), F.lit("")) != "", F.concat(name, F.lit(" <"), address, F.lit(">"))).otherwise(address)


def truthy(value: Column) -> Column:
    """Texts and numbers that mean yes: true, yes, y, 1, phish, or a number of at least 0.5."""
    low = F.lower(F.trim(value.cast("string")))
    return F.coalesce(low.isin("true", "yes", "y", "t", "phish", "phishing") | (F.expr("1") == F.when(low.try_cast("double") >= 0.5, 1)), F.lit(False))


def tri_state(value: Column) -> Column:
    """A nullable boolean from the many spellings of yes, no and unknown."""
    low = F.lower(F.trim(value.cast("string")))
    return F.when(low.isin("true", "yes", "y", "t", "1", "1.0"), F.lit(True)).when(low.isin("false", "no", "n", "f", "0", "0.0"), F.lit(False))


def is_real_sender(address: Column) -> Column:
    """Whether an address can be a person's: well formed, no role, list or anonymous name before the @."""
    low = F.lower(F.trim(address))
    roles = r"^(?:no-?reply|do-?not-?reply|postmaster|mailer-daemon|bounce[s]?|notifications?|newsletter|support|info|admin|webmaster|team|service|alerts?|list|owner)(?:[.+_-].*)?@"
    return F.coalesce(low.rlike(r"^[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+$") & ~low.rlike(roles), F.lit(False))


def valid_record(subject: Column, body: Column, least: int = 80, most: int = 6000) -> Column:
    """A mail with a subject and a body of a usual length."""
    return (F.coalesce(F.trim(subject), F.lit("")) != "") & F.coalesce(F.length(body).between(least, most), F.lit(False))


def listed_headers(names: Column, prefixes: Sequence[str]) -> Column:
    """Those of an array of header names that begin, in small letters, with one of the listed prefixes."""
    low = F.array(*[F.lit(p.lower()) for p in prefixes]) if prefixes else F.array().cast("array<string>")
    return F.filter(names, lambda h: F.exists(low, lambda p: F.startswith(F.lower(h), p)))
