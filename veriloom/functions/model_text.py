"""Short, plain text for comparison detectors, as native expressions; and headers with labels."""

from __future__ import annotations

import html as _html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Words that are read, and the length from which a word is none.
WORDS, LONGEST = 200, 30


def page_breaks(t: Column) -> Column:
    """A page's text with its breaks and blocks as line ends, its head dropped and its links marked; small letters."""
    t = F.regexp_replace(t, r"\s+", " ")
    t = F.regexp_replace(t, r"(?i)\s*<br\s*/?>\s*|</div\s*>\s*", "\n")
    t = F.regexp_replace(t, r"(?i)</(?:p|h[0-9])\s*>\s*", "\n\n")
    t = F.regexp_replace(t, r"(?is)<head>.*?<\s*(?:/head|body)[^>]*>", "")
    t = F.regexp_replace(t, r"(?is)<a\s+href=\"[^\"]+\"[^>]*>.*?</a>", " <url> ")
    return F.lower(F.trim(t))


def detector_words(t: Column) -> Column:
    """Small letters, words and the marks <url>, <email>, <file> only: escapes, quote marks and introductions of earlier
    mails gone, ``n't`` written out, the first words only and none that is very long."""
    t = F.regexp_replace(t, r"\\[nrt]|=\r?\n", " ")
    t = F.regexp_replace(t, r"(?m)^>+ ?", "")
    t = F.regexp_replace(t, r"(?s)\nOn .{0,200}?wrote:", " ")
    t = F.array_join(F.slice(F.filter(F.split(t, r"\s+"), lambda w: F.length(w) < LONGEST), 1, WORDS), " ")
    t = F.regexp_replace(t, r"(?i)n['’]t\b", " not ")
    t = F.regexp_replace(t, r"(?i)<?https?://[^\s<>]+>?", " \x01url\x02 ")
    t = F.regexp_replace(t, r"(?i)<?(?:mailto:)?[^@\s<>]+@[^@\s<>]+\.[\w-]+[^\s<>]*>?", " \x01email\x02 ")
    t = F.regexp_replace(t, r"(?i)<[^@\s<>]+\.[\w-]+>", " \x01file\x02 ")
    t = F.regexp_replace(t, r"[^a-zA-Z\x{01}\x{02}]+", " ")
    return F.lower(F.trim(F.translate(t, "\x01\x02", "<>")))


LABELLED = StructType([StructField(n, StringType()) for n in ("sender", "recipient", "subject")])


@F.pandas_udf(LABELLED)
def label_headers(sender: pd.Series, recipient: pd.Series, subject: pd.Series, identities: pd.Series, inconsistent: pd.Series, matched: pd.Series) -> pd.DataFrame:
    """Headers as HTML: the sender marked by whether it fits, identities marked elsewhere. All values are escaped first."""
    import re

    def mark(text: str | None, names: list[str]) -> str:
        safe = _html.escape(text or "")
        if not names:
            return safe
        pattern = re.compile("|".join(re.escape(_html.escape(n)) for n in sorted(names, key=len, reverse=True)), re.I)
        return pattern.sub(lambda m: f'<span class="identity">{m[0]}</span>', safe)

    rows = []
    for s, r, t, names, bad, who in zip(sender, recipient, subject, identities, inconsistent, matched, strict=True):
        names = [n for n in (names if names is not None else []) if n]
        note = f' title="not a sender of {_html.escape(who or "")}"' if bad else ""
        rows.append((f'<span class="{"inconsistent" if bad else "sender"}"{note}>{_html.escape(s or "")}</span>', mark(r, names), mark(t, names)))
    return pd.DataFrame(rows, columns=LABELLED.names)
