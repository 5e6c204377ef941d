"""Structural features of messages and the comparison detectors built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions.domains import SUFFIXES, email_host, host_of, is_ip_host, registrable, urls_in
from veriloom.functions.headers import header, headers_named
from veriloom.functions.text import bad_word_count, css_length, has_script, sensitive_ratio, word_stats

#: Headers that a complete mail has.
USUAL_HEADERS = ["from", "to", "subject", "date", "message-id", "mime-version", "content-type", "received", "return-path", "reply-to"]
#: Words that are counted in subjects and in bodies.
BAD_SUBJECT = ["verify", "bank", "debit", "payment", "suspend"]
BAD_BODY = ["link", "click", "confirm", "user", "customer", "client", "suspend", "restrict", "verify", "payment", "protect"]


def member_ratio(values: Column, wanted: Column) -> Column:
    """Share of an array's values that equal one; -1 for an empty array."""
    n = F.size(values)
    return F.when(n > 0, F.size(F.filter(values, lambda x: x == wanted)) / n).otherwise(F.lit(-1.0))


def header_features(headers: Column) -> dict[str, Column]:
    """Numbers read from the headers; missing headers count 0, missing ratios -1."""
    named = lambda n: headers_named(headers, n)
    first = lambda n: F.coalesce(header(headers, n), F.lit(""))
    mid = first("Message-ID")
    mid_left, mid_right = F.regexp_extract(mid, r"<?([^@<>]*)@", 1), F.regexp_extract(mid, r"@([^<>]*)>?", 1)
    boundary = F.regexp_extract(first("Content-Type"), r"(?i)boundary=\"?([^\";]+)", 1)
    charset = F.lower(F.regexp_extract(first("Content-Type"), r"(?i)charset=\"?([^\";\s]+)", 1))
    names = F.transform(headers, lambda h: F.lower(h["name"]))
    froms = F.filter(F.transform(F.concat(named("From"), named("Reply-To"), named("Return-Path")), lambda v: email_host(F.regexp_replace(F.element_at(F.split(v, r"\s+"), -1), "[<>]", ""))), lambda x: x.isNotNull())
    out = {
        "n_headers": F.size(headers),
        "n_distinct_headers": F.size(F.array_distinct(names)),
        "n_usual_headers": F.size(F.array_intersect(names, F.array(*[F.lit(x) for x in USUAL_HEADERS]))),
        "n_received": F.size(named("Received")),
        "n_x_headers": F.size(F.filter(names, lambda n: F.startswith(n, F.lit("x-")))),
        "from_length": F.length(first("From")),
        "subject_length": F.length(first("Subject")),
        "has_reply_to": (F.size(named("Reply-To")) > 0).cast("int"),
        "has_return_path": (F.size(named("Return-Path")) > 0).cast("int"),
        "boundary_length": F.length(boundary),
        "boundary_is_hex": boundary.rlike("^[0-9a-fA-F]+$").cast("int"),
        "boundary_digits": F.regexp_count(boundary, F.lit("[0-9]")),
        "boundary_dashes": F.regexp_count(boundary, F.lit("[-=_]")),
        "charset_known": charset.isin("utf-8", "us-ascii", "iso-8859-1", "windows-1252").cast("int"),
        "id_length": F.length(mid_left),
        "id_is_hex": mid_left.rlike("^[0-9a-fA-F]+$").cast("int"),
        "id_dots": F.regexp_count(mid_left, F.lit(r"\.")),
        "id_domain_length": F.length(mid_right),
        "id_domain_is_from": (mid_right != F.lit("")).cast("int") * (F.lower(mid_right) == F.coalesce(email_host(F.regexp_replace(first("From"), r".*<|>.*", "")), F.lit(""))).cast("int"),
        "id_digits": F.regexp_count(mid_left, F.lit("[0-9]")),
        "id_dashes": F.regexp_count(mid_left, F.lit("[-_]")),
        "id_dollars": F.regexp_count(mid_left, F.lit("[$]")),
        "id_plus": F.regexp_count(mid_left, F.lit("[+]")),
        "id_missing": (mid == "").cast("int"),
        "id_brackets": mid.rlike("^<.*>$").cast("int"),
        "boundary_missing": (boundary == "").cast("int"),
        "boundary_is_number": boundary.rlike("^[0-9]+$").cast("int"),
        "boundary_has_next": boundary.rlike("(?i)next").cast("int"),
        "boundary_has_part": boundary.rlike("(?i)part").cast("int"),
        "charset_missing": (charset == "").cast("int"),
        "n_to": F.regexp_count(first("To"), F.lit("@")),
        "n_cc": F.regexp_count(first("Cc"), F.lit("@")),
        "n_bcc": F.regexp_count(first("Bcc"), F.lit("@")),
        "n_from": F.size(named("From")),
        "n_content_type": F.size(named("Content-Type")),
        "n_dkim": F.size(named("DKIM-Signature")),
        "n_auth": F.size(named("Authentication-Results")),
        "n_list_headers": F.size(F.filter(names, lambda n: F.startswith(n, F.lit("list-")))),
        "multipart": F.lower(first("Content-Type")).startswith("multipart").cast("int"),
        "is_html": F.lower(first("Content-Type")).startswith("text/html").cast("int"),
        "subject_encoded": F.contains(first("Subject"), F.lit("=?")).cast("int"),
        "from_encoded": F.contains(first("From"), F.lit("=?")).cast("int"),
        "from_has_name": first("From").rlike(r"\S.*<").cast("int"),
        "date_missing": (first("Date") == "").cast("int"),
        "mailer_missing": (F.coalesce(header(headers, "X-Mailer"), header(headers, "User-Agent"), F.lit("")) == "").cast("int"),
        "usual_ratio": F.when(F.size(names) > 0, F.size(F.array_intersect(names, F.array(*[F.lit(x) for x in USUAL_HEADERS]))) / len(USUAL_HEADERS)).otherwise(F.lit(-1.0)),
        "x_ratio": F.when(F.size(names) > 0, F.size(F.filter(names, lambda n: F.startswith(n, F.lit("x-")))) / F.size(names)).otherwise(F.lit(-1.0)),
        "reply_differs": F.when(F.size(named("Reply-To")) > 0, (F.lower(F.regexp_extract(first("Reply-To"), r"@([^>\s]+)", 1)) != F.lower(F.regexp_extract(first("From"), r"@([^>\s]+)", 1))).cast("int")).otherwise(F.lit(-1)),
        "return_differs": F.when(F.size(named("Return-Path")) > 0, (F.lower(F.regexp_extract(first("Return-Path"), r"@([^>\s]+)", 1)) != F.lower(F.regexp_extract(first("From"), r"@([^>\s]+)", 1))).cast("int")).otherwise(F.lit(-1)),
        "received_ratio": F.when(F.size(names) > 0, F.size(named("Received")) / F.size(names)).otherwise(F.lit(-1.0)),
        "from_domain_ratio": F.when(F.size(froms) > 0, F.size(F.array_distinct(froms)) / F.size(froms)).otherwise(F.lit(-1.0)),
    }
    return {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in out.items()}


def with_links(messages: DataFrame, text: str, html: str, urls: str = "_urls", hosts: str = "_hosts") -> DataFrame:
    """messages with the URLs of a body and their hosts as columns, so that features read them instead of the texts."""
    both = F.concat_ws(" ", F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(html), F.lit("")))
    found = messages.withColumn(urls, F.when(F.contains(both, F.lit("://")), urls_in(both)).otherwise(F.array().cast("array<string>")))
    return found.withColumn(hosts, F.transform(urls, host_of))


def body_features(text: Column, html: Column, subject: Column, sender: Column, suffixes: Sequence[str] = SUFFIXES, urls: Column | None = None, hosts: Column | None = None) -> dict[str, Column]:
    """Numbers read from bodies and links; nulls count as empty texts. urls, hosts: those of with_links(), if they are known."""
    t, h, s = F.coalesce(text, F.lit("")), F.coalesce(html, F.lit("")), F.coalesce(subject, F.lit(""))
    urls = urls_in(F.concat_ws(" ", t, h)) if urls is None else urls
    hosts = F.transform(urls, host_of) if hosts is None else hosts
    own = registrable(email_host(sender), suffixes, "host")
    stats = word_stats(t)
    foreign = F.size(F.filter(hosts, lambda x: registrable(x, suffixes, "host") != F.coalesce(own, F.lit(""))))
    out = {
        "n_urls": F.size(urls),
        "n_url_hosts": F.size(F.array_distinct(hosts)),
        "n_ip_hosts": F.size(F.filter(hosts, is_ip_host)),
        "n_foreign_hosts": foreign,
        "url_dots": F.aggregate(hosts, F.lit(0), lambda a, x: F.greatest(a, F.regexp_count(F.coalesce(x, F.lit("")), F.lit(r"\.")))),
        "subject_words": F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")),
        "subject_is_reply": F.lower(s).rlike(r"^\s*(re|fw|fwd|aw|wg)\s*:").cast("int"),
        "subject_bad_words": bad_word_count(s, BAD_SUBJECT),
        "body_bad_words": bad_word_count(t, BAD_BODY),
        "body_words": stats["words"],
        "body_distinct_words": stats["distinct_words"],
        "body_chars": stats["chars"],
        "body_richness": stats["richness"],
        "sensitive_ratio": sensitive_ratio(F.concat_ws(" ", t, h)),
        "css_length": css_length(h),
        "has_script": has_script(h).cast("int"),
        "n_forms": F.regexp_count(h, F.lit("(?i)<form")),
        "n_images": F.regexp_count(h, F.lit("(?i)<img")),
        "html_share": F.length(h) / (F.length(h) + F.length(t) + F.lit(1)),
    }
    return {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in out.items()}


def with_features(messages: DataFrame, features: dict[str, Column], prefix: str = "f_") -> DataFrame:
    """messages with each feature as a double column."""
    return messages.select("*", *[v.alias(prefix + k) for k, v in features.items()])


def structural_detector(columns: list[str], label: str = "label") -> Pipeline:
    """Scaled features into boosted trees."""
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="features"), GBTClassifier(labelCol=label, maxIter=20, seed=42)])


def url_detector(column: str = "url_chars", label: str = "label") -> Pipeline:
    """Character 3-grams of URLs, hashed, into a linear model."""
    return Pipeline(stages=[NGram(n=3, inputCol=column, outputCol="grams"), HashingTF(inputCol="grams", outputCol="features", numFeatures=1 << 16), LogisticRegression(labelCol=label, regParam=0.01)])


def tree_detector(columns: list[str], label: str = "label") -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep"), DecisionTreeClassifier(labelCol=label, maxDepth=5, seed=42)])


def score(model: PipelineModel, rows: DataFrame, name: str) -> DataFrame:
    """rows with ``<name>_score`` (probability of class 1) and ``<name>_class``."""
    out = model.transform(rows)
    return out.withColumn(f"{name}_score", vector_to_array("probability")[1]).withColumn(f"{name}_class", F.col("prediction").cast("int")).drop("raw", "features", "grams", "rawPrediction", "probability", "prediction")


def meta_detector(scores: list[str], label: str = "label") -> Pipeline:
    """A linear model over other detectors' scores."""
    return Pipeline(stages=[VectorAssembler(inputCols=scores, outputCol="features", handleInvalid="keep"), LogisticRegression(labelCol=label)])
