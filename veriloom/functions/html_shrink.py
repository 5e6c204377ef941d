"""HTML made smaller step by step until it fits a size, and texts put together for size-limited consumers."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Attributes that say something about a page's meaning.
KEPT = frozenset(["src", "href", "alt", "title", "name", "id", "class"])
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def drop_scripts(html: str) -> str:
    html = re.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1>", "", html)
    return re.sub(r"(?s)<!--.*?-->", "", html)


def keep_attributes(html: str, kept: frozenset[str] = KEPT) -> str:
    """Only the kept attributes of every tag."""

    def tag(m: re.Match) -> str:
        pairs = re.findall(r"""([\w:-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", m[2])
        rest = "".join(f" {k}={v}" for k, v in pairs if k.lower() in kept)
        return f"<{m[1]}{rest}{'/' if m[2].rstrip().endswith('/') else ''}>"

    return re.sub(r"(?s)<([a-zA-Z][\w-]*)((?:\s+[^<>]*)?)>", tag, html)


class _Nodes(HTMLParser):
    """Start, end and whether there is text for every element."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=False)
        self.lines = [0]
        for line in html.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.stack: list[list] = []
        self.done: list[tuple[int, int, bool, int]] = []
        self.html = html

    def _at(self) -> int:
        row, col = self.getpos()
        return self.lines[row - 1] + col

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _VOID:
            if tag in ("img", "input"):
                self._text()
            return
        self.stack.append([tag, self._at(), False])

    def _text(self) -> None:
        for x in self.stack:
            x[2] = True

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._text()

    def handle_entityref(self, name: str) -> None:
        self._text()

    handle_charref = handle_entityref

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                end = self.html.find(">", self._at())
                for name, start, text in self.stack[k:]:
                    if name == tag:
                        self.done.append((start, end + 1 if end >= 0 else len(self.html), text, k))
                del self.stack[k:]
                return


def _elements(html: str) -> list[tuple[int, int, bool, int]]:
    n = _Nodes(html)
    n.feed(html)
    n.close()
    return sorted(n.done)


def drop_textless(html: str) -> str:
    """Elements without any text, image or field removed."""
    out, at = [], 0
    for start, end, text, _ in _elements(html):
        if not text and start >= at:
            out.append(html[at:start])
            at = end
    return "".join(out) + html[at:]


def unwrap_emphasis(html: str) -> str:
    return re.sub(r"(?i)</?(font|strong|b)\b[^>]*>", "", html)


def shorten_url(url: str, most: int = 10) -> str:
    """A URL with each part of its path, its query and its fragment cut to a length."""
    try:
        p = urlsplit(url)
    except ValueError:
        return url[: most * 4]
    return urlunsplit((p.scheme, p.netloc, "/".join(x[:most] for x in p.path.split("/")), p.query[:most], p.fragment[:most]))


def shorten_urls(html: str) -> str:
    return re.sub(r"""(?i)(\b(?:href|src)\s*=\s*)(["'])(.*?)\2""", lambda m: f"{m[1]}{m[2]}{shorten_url(m[3])}{m[2]}", html)


def remove_middle(html: str) -> str:
    """The middle one of the outermost elements below the body removed; a text without elements loses its middle tenth."""
    inner = re.search(r"(?is)<body\b[^>]*>(.*)</body>", html)
    body, base = (inner[1], inner.start(1)) if inner else (html, 0)
    nodes = _elements(body)
    if nodes:
        top = min(d for *_, d in nodes)
        outer = [n for n in nodes if n[3] == top]
        while len(outer) == 1 and (inside := [n for n in nodes if outer[0][0] < n[0] and n[1] <= outer[0][1]]):
            depth = min(d for *_, d in inside)
            outer = [n for n in inside if n[3] == depth]
        start, end = outer[len(outer) // 2][:2]
        return html[: base + start] + html[base + end :]
    cut = max(1, len(html) // 10)
    mid = len(html) // 2
    return html[: mid - cut // 2] + html[mid + cut - cut // 2 :]


def shrink(html: str, most: int) -> str:
    """The first step after which the page fits: scripts, attributes, empty elements, emphasis, URLs, then middle parts."""
    for step in (drop_scripts, keep_attributes, drop_textless, unwrap_emphasis, shorten_urls):
        if len(html) <= most:
            return html
        html = step(html)
    while len(html) > most:
        smaller = remove_middle(html)
        if len(smaller) >= len(html):
            return html[:most]
        html = smaller
    return html


@F.pandas_udf(StringType())
def shrink_html(s: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else shrink(h, n) for h, n in zip(s, most, strict=True)])


@F.pandas_udf(StringType())
def prompt_text(text: pd.Series, html: pd.Series, most: pd.Series) -> pd.Series:
    """The page, shrunk, and the plain text after it while both fit; the plain text alone where there is no page."""
    out = []
    for t, h, n in zip(text, html, most, strict=True):
        page = shrink(h, n) if h else ""
        plain = t or ""
        out.append(page if page and len(page) + len(plain) > n else (page + "\n" + plain if page else plain[:n]))
    return pd.Series(out)
