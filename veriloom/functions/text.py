"""Body text: cleaning, cutting, HTML to text; native column expressions first, Arrow functions where a tree or a fixpoint is needed."""

from __future__ import annotations

import html as _html
import quopri
import re
import unicodedata
from collections.abc import Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

#: Characters that hide text from readers or from matching.
HIDDEN = "​‌‍⁠﻿­‎‏‪‫‬‭‮⁦⁧⁨⁩"
REPLY_MARKERS = [
    r"-{2,}\s*Original Message\s*-{2,}", r"-{2,}\s*Forwarded [Mm]essage\s*-{2,}", r"Begin forwarded message:", r"(?m)^On .{5,200} wrote:$", r"(?m)^From: .{2,200}$\n^(?:Sent|Date): ", r"(?m)^_{10,}$",
]
#: Words whose share is a feature of a page, looked for anywhere in its text.
SENSITIVE = ["user", "pass", "password", "credit", "card", "login", "name", "account", "id", "submit", "alert", "warning", "sign", "access"]


# ---------------------------------------------------------------- native expressions


def collapse_spaces(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, r"[ \t]+", " "))


def drop_hidden(t: Column) -> Column:
    """Zero-width and direction characters removed."""
    return F.translate(t, HIDDEN, "")


def hidden_characters(t: Column) -> Column:
    """The distinct control and format characters of a text, line ends and tabs aside."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(r"([\p{Cc}\p{Cf}&&[^\n\r\t]])"), F.lit(1))))


def shrink_urls(t: Column) -> Column:
    """URLs cut to ``scheme://host``. As everywhere in this chain a host needs three labels; others stay."""
    return F.regexp_replace(t, r"(https?://(?:[A-Za-z0-9-]+\.){2,}[A-Za-z]{2,})(?::[0-9]+)?(?:[/?#][^\s)>\]]*)?", "$1")


def clean_text(t: Column) -> Column:
    """Tags, repeated spaces and dots, hidden and control characters removed, URLs shortened; line ends become spaces."""
    t = F.regexp_replace(t, r"<[^<>]*>", " ")
    t = F.translate(t, "\xa0", " ")
    t = drop_hidden(t)
    t = F.regexp_replace(t, r"[\s]+", " ")
    t = F.regexp_replace(t, r"\.{2,}", ".")
    t = F.regexp_replace(t, r"[\p{Cc}\p{Cf}]", "")
    return F.trim(shrink_urls(t))


def cut_reply(t: Column, markers: Sequence[str] = REPLY_MARKERS) -> Column:
    """The text before the first mark of an earlier message."""
    return F.when(t.isNotNull(), F.element_at(F.split(t, "|".join(f"(?:{m})" for m in markers), 2), 1))


def cut_at_first(t: Column, markers: Sequence[str]) -> Column:
    """The text before the first of some plain strings."""
    at = F.least(*[F.when(F.instr(t, m) > 0, F.instr(t, m)).otherwise(F.length(t) + 1) for m in markers], F.length(t) + 1)
    return F.substring(t, F.lit(1), at - 1)


def drop_link_text(t: Column) -> Column:
    """``(http…)`` removed."""
    return F.regexp_replace(t, r"\s?\(https?://[^)]*\)", "")


def clean_entity(t: Column) -> Column:
    return F.regexp_replace(F.trim(t), r"[()\[\]:*^]", "")


def strip_trailing_number(t: Column) -> Column:
    return F.regexp_replace(t, r"_\d+$", "")


def strip_trailing_punctuation(t: Column) -> Column:
    return F.regexp_replace(t, r"[\p{Punct}\s]+$", "")


def safe_name(t: Column, most: int = 60) -> Column:
    """A token fit for a file name."""
    return F.left(F.regexp_replace(F.regexp_replace(F.trim(t), r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", ""), F.lit(most))


def match_case(word: Column, pattern: Column) -> Column:
    """The word in the case of another: small, capitals, or capitalised."""
    return F.when(pattern == F.upper(pattern), F.upper(word)).when(F.substring(pattern, 1, 1) == F.upper(F.substring(pattern, 1, 1)), F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 20)))).otherwise(F.lower(word))


def visible_text(html: Column) -> Column:
    """Text of a page: script, style and noscript dropped, tags to spaces, spaces collapsed. Entities stay; see unescape()."""
    t = html
    for tag in ("script", "style", "noscript"):
        t = F.regexp_replace(t, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", " "), r"[\s\x{a0}\x{200b}\x{ad}]+", " "))


def unwrap_links(html: Column) -> Column:
    return F.regexp_replace(html, r"(?i)</?(a|span)\b[^>]*>", "")


def unwrap_emphasis(html: Column) -> Column:
    return F.regexp_replace(html, r"(?i)</?(font|strong|b)\b[^>]*>", "")


def remove_images(html: Column) -> Column:
    return F.regexp_replace(html, r"(?i)<img\b[^>]*>", "")


def drop_scripts(html: Column) -> Column:
    t = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", "")
    return F.regexp_replace(t, r"(?s)<!--.*?-->", "")


def inject_css(html: Column, css: str) -> Column:
    """A style block before </head>, or before everything where there is no head."""
    block = f"<style>{css}</style>"
    return F.when(F.instr(F.lower(html), "</head>") > 0, F.regexp_replace(html, r"(?i)</head>", re.sub(r"([\\$])", r"\\\1", block) + "</head>")).otherwise(F.concat(F.lit(block), html))


def escape_html(t: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def css_length(html: Column) -> Column:
    return F.aggregate(F.regexp_extract_all(html, F.lit(r"(?is)<style[^>]*>(.*?)</style>"), F.lit(1)), F.lit(0), lambda s, x: s + F.length(x))


def has_script(html: Column) -> Column:
    return F.coalesce(html.rlike("(?i)<script"), F.lit(False))


def sensitive_ratio(t: Column, words: Sequence[str] = SENSITIVE) -> Column:
    """Share of the listed words that a text contains anywhere."""
    hits = F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(t), w)))
    return F.when(t.isNotNull(), hits / F.lit(len(words)))


def word_array(t: Column) -> Column:
    """Words between spaces, no empty ones; an empty array for an empty text."""
    return F.filter(F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " "), lambda w: w != "")


def chunk_words(t: Column, size: int, prefix: str = "") -> Column:
    """The text in consecutive stretches of ``size`` words, all but the first begun with a prefix."""
    words = word_array(t)
    n = F.size(words)
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(size)))
    lead = [F.lit(w) for w in prefix.split()]
    part = lambda i: F.array_join(F.slice(words, i, size), " ")
    return F.transform(starts, lambda i: F.when(i == 1, part(i)).otherwise(F.concat(F.lit(prefix + " ") if lead else F.lit(""), part(i))))


def sentences(t: Column) -> Column:
    return F.filter(F.split(t, r"\.\s+"), lambda s: F.trim(s) != "")


def next_step_urls(t: Column, actions: Column) -> Column:
    """The first ``(http…)`` of each sentence that follows a sentence with one of the actions."""
    has = lambda x, acts: F.exists(acts, lambda a: F.contains(x, a))
    after = lambda s, i: F.regexp_extract(F.coalesce(F.try_element_at(s, (i + 2).cast("int")), F.lit("")), r"\((https?://[^)\s]+)", 1)
    # the sentences and actions are variables of an outer lambda: they are computed once for a text, not at every sentence
    within = lambda v: F.transform(v["s"], lambda x, i: F.when(has(x, v["a"]), after(v["s"], i)))
    both = F.struct(sentences(t).alias("s"), F.coalesce(actions, F.array().cast("array<string>")).alias("a"))
    urls = F.element_at(F.transform(F.array(both), within), 1)
    return F.array_distinct(F.filter(urls, lambda u: u.isNotNull() & (u != "")))


def bad_word_count(t: Column, words: Sequence[str]) -> Column:
    """Occurrences of all listed words anywhere in the text."""
    total = F.lit(0)
    for w in words:
        total = total + F.regexp_count(F.lower(t), F.lit(re.escape(w)))
    return F.when(t.isNotNull(), total)


def word_stats(t: Column) -> Column:
    """struct(words, distinct_words, chars, richness)."""
    w = F.transform(word_array(t), F.lower)
    n = F.size(w)
    return F.struct(n.alias("words"), F.size(F.array_distinct(w)).alias("distinct_words"), F.length(t).alias("chars"), F.when(n > 0, F.size(F.array_distinct(w)) / n).otherwise(F.lit(-1.0)).alias("richness"))


# ---------------------------------------------------------------- Arrow functions


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    """HTML entities decoded."""
    return s.map(_html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def nfkd_ascii(s: pd.Series) -> pd.Series:
    """Accents dropped after compatibility decomposition; letters without a plain form stay."""
    return s.map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)), na_action="ignore")


@F.pandas_udf(StringType())
def quoted_printable(s: pd.Series) -> pd.Series:
    """One level of quoted-printable decoded, as UTF-8."""
    return s.map(lambda t: quopri.decodestring(t.encode()).decode("utf-8", "replace"), na_action="ignore")


_SPLIT_LETTERS = re.compile(r"(?<!\S)((?:[^\W\d_] ){2,}[^\W\d_])(?!\S)")


def unfragment_text(t: str) -> str:
    """``P a y P a l`` joined, until nothing changes; a capital after a small letter begins no new word."""
    while (new := _SPLIT_LETTERS.sub(lambda m: m[1].replace(" ", ""), t)) != t:
        t = new
    return t


@F.pandas_udf(StringType())
def unfragment(s: pd.Series) -> pd.Series:
    return s.map(unfragment_text, na_action="ignore")


_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0|opacity\s*:\s*0(?![.\d])|max-height\s*:\s*0|mso-hide\s*:\s*all", re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Tree(HTMLParser):
    """One walk over a page: its text, links, depth and leaves."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.depth = self.deepest = 0
        self.leaves: list[tuple[str, int]] = []
        self.stack: list[list] = []
        self.links: list[tuple[str, list[str]]] = []
        self.hidden_spans = 0
        self.forms = self.images = 0
        self.rtl = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if self.stack:
            self.stack[-1][2] = True
        if tag == "a" and a.get("href"):
            self.links.append((a["href"].strip(), []))
        self.forms += tag == "form"
        self.images += tag == "img"
        self.rtl = self.rtl or a.get("dir", "").lower() == "rtl" or "rtl" in a.get("style", "").lower()
        hides = bool(_HIDING.search(a.get("style", ""))) or "hidden" in a
        if tag in _VOID:
            self.leaves.append((tag, len(self.stack) + 1))
            if tag == "br":
                self.out.append("\n")
            return
        off = tag in ("script", "style", "head", "noscript", "title") or hides
        self.hidden_spans += hides
        self.skip += off
        self.stack.append([tag, off, False])
        self.deepest = max(self.deepest, len(self.stack))

    def handle_endtag(self, tag: str) -> None:
        if not any(x[0] == tag for x in self.stack):
            return
        while self.stack:
            name, off, had = self.stack.pop()
            if not had:
                self.leaves.append((name, len(self.stack) + 1))
            self.skip -= off
            if name == tag:
                break
        if tag == "a" and self.links and not self.skip:
            self.out.append(f" ({self.links[-1][0]})" if self.links[-1][0].startswith("http") else "")
        if tag in ("p", "div", "tr", "li", "td", "h1", "h2", "h3", "table"):
            self.out.append(" ")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(data)
            if self.links:
                self.links[-1][1].append(data)


def _walk(html: str) -> _Tree:
    t = _Tree()
    t.feed(html)
    t.close()
    while t.stack:
        name, _, had = t.stack.pop()
        if not had:
            t.leaves.append((name, len(t.stack) + 1))
    return t


def html_to_text(html: str, keep_brackets: bool = False) -> str:
    """Readable text with ``text (href)`` for links; hidden elements and, unless kept, bracketed text dropped."""
    text = "".join(_walk(html).out)
    if not keep_brackets:
        text = re.sub(r"\[[^\]\n]*\]", "", text)
    return re.sub(r"[ \t\xa0]+", " ", re.sub(r"\s*\n\s*", "\n", text)).strip()


@F.pandas_udf(StringType())
def html_text(s: pd.Series) -> pd.Series:
    return s.map(html_to_text, na_action="ignore")


def sanitise(html: str) -> str:
    """HTML without hidden characters, scripts, styles and hidden elements with all that is in them."""
    html = html.translate({ord(c): None for c in HIDDEN})
    html = re.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1>", "", html)
    pattern = re.compile(r"(?is)<(span|div|p|font|td)\b[^>]*style\s*=\s*(\"[^\"]*\"|'[^']*')[^>]*>(?:(?!<\1\b).)*?</\1>")
    while True:
        new = pattern.sub(lambda m: "" if _HIDING.search(m[2]) else m[0], html)
        if new == html:
            return html
        html = new


@F.pandas_udf(StringType())
def sanitise_html(s: pd.Series) -> pd.Series:
    return s.map(sanitise, na_action="ignore")


HTML_FEATURES = StructType(
    [StructField(n, IntegerType()) for n in ("depth", "leaves", "leaf_types", "links", "forms", "images", "hidden", "text_length", "css_length")]
    + [StructField("leaf_depth_mean", DoubleType()), StructField("leaf_depth_std", DoubleType()), StructField("unique_domain_ratio", DoubleType()), StructField("has_script", BooleanType()), StructField("rtl", BooleanType())]
)


@F.pandas_udf(HTML_FEATURES)
def html_features(s: pd.Series) -> pd.DataFrame:
    """Shape of the tree, links, hidden parts and sizes of a page; all zero for null."""
    rows = []
    for html in s:
        t = _walk(html or "")
        depths = [d for _, d in t.leaves]
        mean = sum(depths) / len(depths) if depths else 0.0
        std = (sum((d - mean) ** 2 for d in depths) / len(depths)) ** 0.5 if depths else 0.0
        hosts = [m[1].lower() for h, _ in t.links if (m := re.match(r"(?i)https?://([^/:?#]+)", h))]
        css = sum(len(x) for x in re.findall(r"(?is)<style[^>]*>(.*?)</style>", html or ""))
        rows.append((t.deepest, len(depths), len({n for n, _ in t.leaves}), len(t.links), t.forms, t.images, t.hidden_spans, len("".join(t.out).strip()), css, mean, std, len(set(hosts)) / len(hosts) if hosts else -1.0, "<script" in (html or "").lower(), t.rtl))
    return pd.DataFrame(rows, columns=HTML_FEATURES.names)


def decode_cfemail(hexed: str) -> str | None:
    """An address hidden as hex, XORed with its first byte; null if it is none."""
    try:
        data = bytes.fromhex(hexed)
    except ValueError:
        return None
    text = bytes(b ^ data[0] for b in data[1:]).decode("utf-8", "ignore") if len(data) > 1 else ""
    return text if re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s]+", text) else None


def page_emails(html: str | None) -> list[str]:
    """All addresses of a page: hidden ones, mailto links, the decoded source, the visible text; first spelling kept."""
    if not html:
        return []
    found = [decode_cfemail(x) for x in re.findall(r"(?i)(?:data-cfemail=[\"']|/cdn-cgi/l/email-protection#)([0-9a-f]+)", html)]
    found += [_html.unescape(x).split("?")[0] for x in re.findall(r"(?i)href=[\"']mailto:([^\"']+)", html)]
    address = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
    plain = _html.unescape(html)
    found += re.findall(address, plain) + re.findall(address, html_to_text(html, True))
    out: dict[str, str] = {}
    for x in found:
        x = re.sub(r"[.,;:)\]}>\"']+$", "", (x or "").strip())
        if re.fullmatch(address, x):
            out.setdefault(x.lower(), x)
    return list(out.values())


@F.pandas_udf(ArrayType(StringType()))
def html_emails(s: pd.Series) -> pd.Series:
    return s.map(page_emails)


@F.pandas_udf(StringType())
def label_html(html: pd.Series, identities: pd.Series, actions: pd.Series) -> pd.Series:
    """Spans around identities and actions in the text parts of a page, whatever their case; empty lists change nothing."""

    def one(page: str | None, who: list | None, what: list | None) -> str | None:
        if page is None:
            return None
        terms = [(x, "identity") for x in (who if who is not None else []) if x] + [(x, "action") for x in (what if what is not None else []) if x]
        if not terms:
            return page
        kind = {x.lower(): k for x, k in terms}
        pattern = re.compile("|".join(re.escape(x) for x, _ in sorted(terms, key=lambda t: -len(t[0]))), re.I)
        parts = re.split(r"(<[^>]*>)", page)
        return "".join(p if p.startswith("<") else pattern.sub(lambda m: f'<span class="{kind[m[0].lower()]}">{m[0]}</span>', p) for p in parts)

    return pd.Series([one(*x) for x in zip(html, identities, actions, strict=True)])


@F.pandas_udf(StringType())
def trim_middle(s: pd.Series, most: pd.Series) -> pd.Series:
    """Middle sentences dropped one by one until a text is short enough."""

    def one(t: str | None, n: int) -> str | None:
        if t is None:
            return None
        parts = re.split(r"(?<=[.!?])\s+", t)
        while len(parts) > 1 and sum(map(len, parts)) + len(parts) - 1 > n:
            parts.pop(len(parts) // 2)
        return " ".join(parts)[:n]

    return pd.Series([one(*x) for x in zip(s, most, strict=True)])


@F.pandas_udf(StringType())
def sentence_case(s: pd.Series) -> pd.Series:
    return s.map(lambda t: re.sub(r"(^|[.!?]\s+)([^\W\d_])", lambda m: m[1] + m[2].upper(), t.lower()), na_action="ignore")
