"""Queries of operators that no table of the test data feeds as it is: mails and pages are made from its rows.

They have no SQL: the results come from parsers, clusterers, models and streams. Tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions import domains as D
from veriloom.functions import text as T
from veriloom.operators import features as X
from veriloom.operators import matching as M
from veriloom.operators.detect import decide
from veriloom.operators.expand import crawl
from veriloom.operators.recognise import recognise
from veriloom.session import shared_path, table
from veriloom.sources.mail import parse_messages
from veriloom.streaming.mail_stream import first_contact_stream


def raw_mails(s: SparkSession, d: str) -> DataFrame:
    """(path, content) of one message per document, with headers from its mail's metadata."""
    docs = table(s, d, "documents").select("doc_id", "subject", "text", "join_key")
    meta = table(s, d, "mail_meta").groupBy("join_key").agg(F.min("sender_address").alias("sender"), F.min("auth_status").alias("auth"), F.min("from_domain").alias("domain"))
    rows = docs.join(meta, "join_key", "left")
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("From: Some Sender <"), F.coalesce("sender", F.lit("nobody@letterbox.example")), F.lit(">")),
        F.lit("To: Reader <reader@quickpost.example>"),
        F.concat(F.lit("Subject: "), F.regexp_replace(F.coalesce("subject", F.lit("")), r"[\r\n]+", " ")),
        F.concat(F.lit("Message-ID: <"), F.col("doc_id").cast("string"), F.lit("@"), F.coalesce("domain", F.lit("letterbox.example")), F.lit(">")),
        F.concat(F.lit("Authentication-Results: mx.example; spf="), F.coalesce("auth", F.lit("none"))),
        F.lit("Date: Fri, 01 Mar 2024 10:00:00 +0100"),
        F.lit("Content-Type: text/plain; charset=utf-8"),
        F.lit(""),
        F.coalesce("text", F.lit("")),
    )
    return rows.select(F.concat(F.lit("mails/"), F.col("doc_id").cast("string"), F.lit(".eml")).alias("path"), F.encode(head, "utf-8").alias("content"))


def parse_mail(s: SparkSession, d: str) -> DataFrame:
    """Every document put into a message and parsed again."""
    m = parse_messages(raw_mails(s, d))
    return m.select("path", "sender_address", F.size("to_addresses").alias("n_to"), "subject", F.length("body_text").alias("n_body"), "date_ts", F.size("headers").alias("n_headers"), "parse_error")


def message_features(s: SparkSession, d: str) -> DataFrame:
    """Header and body features of every document as a message."""
    m = parse_messages(raw_mails(s, d)).select("path", "headers", "body_text", "body_html", "subject", "sender_address")
    m = X.with_links(m, "body_text", "body_html")
    features = X.header_features(F.col("headers")) | X.body_features(F.col("body_text"), F.col("body_html"), F.col("subject"), F.col("sender_address"), D.RESERVED, F.col("_urls"), F.col("_hosts"))
    return X.with_features(m, features).drop("headers", "body_text", "body_html", "subject", "sender_address", "_urls", "_hosts")


def cluster_names(s: SparkSession, d: str) -> DataFrame:
    """The capitalised names of each text clustered, distinct ones in order; no group is larger than one text."""
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Z][a-z]{3,}(?: [A-Z][a-z]{3,})+)"), F.lit(1)))
    rows = table(s, d, "documents").where("text is not null").select("doc_id", names.alias("names")).where(F.size("names") > 1)
    return rows.select("doc_id", F.size("names").alias("names"), M.cluster_strings("names").alias("clusters"))


def claimed_brands(s: SparkSession, d: str) -> DataFrame:
    """Nearest brand of each distinct claimed identity by the default embedding, where near enough."""
    return M.match_names(table(s, d, "decision"), "claimed_identity", table(s, d, "kb"), "brand", 0.6).withColumn("score", F.round("score", 6))


def recognised(s: SparkSession, d: str) -> DataFrame:
    """Identities, requests and roles of every document by the default recogniser."""
    names = [r[0] for r in table(s, d, "kb").select("brand").limit(200_001).collect()]
    return recognise(table(s, d, "documents").select("doc_id", "text"), F.col("text"), names).select("doc_id", "identities", F.size("actions").alias("n_actions"), "relations", "cta_urls")


def mail_verdicts(s: SparkSession, d: str) -> DataFrame:
    """Every document, parsed as a message, to its verdict: gates, recognition, matching, official domains, decision."""
    m = parse_messages(raw_mails(s, d))
    out = decide(m.select("path", "sender_name", "sender_address", "to_addresses", "reply_to", "subject", "body_text"), table(s, d, "kb"), suffixes=D.RESERVED)
    return out.select("path", "verdict", "status", "matched", F.size("actions").alias("n_actions"))


def pages(s: SparkSession, d: str) -> DataFrame:
    """(url, html): a small web made of the knowledge base, each brand's site linking to its contact page and the next brand."""
    from pyspark.sql import Window as W

    kb = table(s, d, "kb").select("brand", F.lower(F.element_at("domains", 1)).alias("host"))
    linked = kb.withColumn("next", F.coalesce(F.lead("host").over(W.orderBy("host")), F.col("host")))
    home = F.format_string('<html><body><h1>%s</h1><a href="/contact">Contact</a> <a href="https://%s/">Partner</a> <a href="/logo.png">Logo</a></body></html>', "brand", "next")
    contact = F.format_string('<html><body><p style="display:none">secret</p>Write to <a href="mailto:info@%s?subject=Hi">info@%s</a> or help@%s.</body></html>', "host", "host", "host")
    return linked.select(F.concat(F.lit("https://"), "host", F.lit("/")).alias("url"), home.alias("html")).unionByName(linked.select(F.concat(F.lit("https://"), "host", F.lit("/contact")).alias("url"), contact.alias("html")))


def page_features(s: SparkSession, d: str) -> DataFrame:
    """Text, addresses and shape of every page of the small web."""
    p = pages(s, d)
    f = p.select("url", T.html_text("html").alias("text"), T.html_emails("html").alias("emails"), T.html_features("html").alias("f"))
    return f.select("url", "text", "emails", "f.depth", "f.leaves", "f.links", "f.hidden")


def crawl_frontier(s: SparkSession, d: str) -> DataFrame:
    """Pages reached from the first brand's site, and the hop of each."""
    rows = pages(s, d).collect()  # the web of the fixed knowledge base stands in for the network
    web = {r[0]: r[1] for r in rows}
    hosts = sorted({u.split("/")[2] for u in web})
    seeds = s.createDataFrame([(f"https://{hosts[0]}/",)], "url string")
    visited, _ = crawl(s, seeds, hosts, web.get)
    return visited


def stream_first_contact(s: SparkSession, d: str) -> DataFrame:
    """First contacts of flagged events as a stream run to its end."""
    source, out = shared_path(s, "stream-in"), shared_path(s, "stream-out")
    e = table(s, d, "events").where("event_type = 'error'")
    e.select(F.col("user_id").cast("string").alias("user"), F.lit("s").alias("sender_key"), F.floor("value").cast("string").alias("claimed_identity"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("mail_id"), F.col("ts").cast("timestamp").cast("double").alias("at")).write.parquet(source)
    stream = s.readStream.schema("user string, sender_key string, claimed_identity string, mail_id string, at double").parquet(source)
    checkpoint = shared_path(s, "stream-checkpoint")
    run = first_contact_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return s.read.parquet(out)


def detector_scores(s: SparkSession, d: str) -> DataFrame:
    """Two detectors and a meta detector fitted on the classified rows: addresses and subjects as features."""
    q = table(s, d, "req2_llm_classified").select("file", "label", F.coalesce("subject", F.lit("")).alias("subject"), F.coalesce("from_addr", F.lit("")).alias("addr"), F.coalesce("from_name", F.lit("")).alias("name")).dropDuplicates(["file"])
    q = q.withColumn("url_chars", F.filter(F.split(F.lower("addr"), ""), lambda c: c != ""))
    numbers = {"subject_length": F.length("subject"), "name_length": F.length("name"), "addr_digits": F.regexp_count("addr", F.lit("[0-9]")), "addr_dots": F.regexp_count("addr", F.lit(r"\.")), "upper": F.regexp_count("subject", F.lit("[A-Z]"))}
    q = X.with_features(q, {k: v.cast("double") for k, v in numbers.items()})
    columns = [f"f_{k}" for k in numbers]
    first = X.score(X.tree_detector(columns).fit(q), q, "tree")
    second = X.score(X.url_detector().fit(first), first, "url")
    final = X.score(X.meta_detector(["tree_score", "url_score"]).fit(second), second, "meta")
    return final.select("file", "label", F.round("tree_score", 6).alias("tree_score"), F.round("url_score", 6).alias("url_score"), F.round("meta_score", 6).alias("meta_score"))


QUERIES = {
    "parse_mail": parse_mail,
    "message_features": message_features,
    "cluster_names": cluster_names,
    "claimed_brands": claimed_brands,
    "recognised": recognised,
    "mail_verdicts": mail_verdicts,
    "page_features": page_features,
    "crawl_frontier": crawl_frontier,
    "stream_first_contact": stream_first_contact,
    "detector_scores": detector_scores,
}
