"""The library's functions for SQL: register(spark) once, then use them by name."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, StringType, StructField, StructType

from veriloom.functions import text as T
from veriloom.functions.headers import decode_header
from veriloom.functions.html_shrink import shrink_html
from veriloom.operators.matching import cluster_strings, embed, fuzzy_ratio
from veriloom.sources.mail import MboxSource, split_mbox


@udtf(returnType=StructType([StructField("position", IntegerType()), StructField("content", BinaryType())]))
class MboxMessages:
    """mbox_messages(content): the messages of a mailbox file."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        for k, m in enumerate(split_mbox(bytes(content or b"")), 1):
            yield k, m


@udtf(returnType=StructType([StructField("url", StringType()), StructField("mailto", BooleanType())]))
class PageLinks:
    """page_links(html, base): absolute links of a page and mailto links."""

    def eval(self, html: str, base: str) -> Iterator[tuple]:
        for h in re.findall(r"(?i)<a[^>]*\shref=[\"']([^\"']+)[\"']", html or ""):
            if h.lower().startswith("mailto:"):
                yield h, True
            elif re.match(r"https?://", url := urljoin(base or "", h)):
                yield url, False


@udtf(returnType=StructType([StructField("email", StringType())]))
class HtmlEmails:
    """html_emails(html): the addresses of a page."""

    def eval(self, html: str) -> Iterator[tuple]:
        for e in T.page_emails(html):
            yield (e,)


FUNCTIONS = {
    "decode_header": decode_header, "html_text": T.html_text, "sanitise_html": T.sanitise_html, "nfkd_ascii": T.nfkd_ascii, "unfragment": T.unfragment, "unescape_html": T.unescape, "html_features": T.html_features,
    "cluster_strings": cluster_strings, "fuzzy_ratio": fuzzy_ratio, "embed_name": embed, "shrink_html": shrink_html,
}
TABLE_FUNCTIONS = {"mbox_messages": MboxMessages, "page_links": PageLinks, "html_emails": HtmlEmails}


def register(spark: SparkSession) -> None:
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
    for name, f in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, f)
    spark.dataSource.register(MboxSource)
