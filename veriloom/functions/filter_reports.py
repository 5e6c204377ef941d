"""Reports of mail filters read as tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def symbols(report: Column) -> Column:
    """map<symbol, score> of the lines ``Symbol: NAME (1.50)…`` of a filter's report; the first score of a repeated one."""
    lines = F.filter(F.split(report, r"\r?\n"), lambda x: x.rlike(r"^\s*Symbol:"))
    name = lambda x: F.regexp_extract(x, r"^\s*Symbol:\s*([A-Za-z0-9_]+)", 1)
    score = lambda x: F.regexp_extract(x, r"\((-?\d+(?:\.\d+)?)\)", 1).try_cast("double")
    named = F.filter(F.transform(lines, lambda x: F.struct(name(x).alias("key"), F.coalesce(score(x), F.lit(0.0)).alias("value"))), lambda s: s["key"] != "")
    keys = F.transform(named, lambda s: s["key"])
    once = F.filter(F.transform(named, lambda s, k: F.when(F.array_position(keys, s["key"]) == (k + 1).cast("long"), s)), lambda s: s.isNotNull())
    return F.map_from_entries(once)


def report_summary(report: Column) -> Column:
    """struct(spam, score, required, action) of a report."""
    metric = F.regexp_extract(report, r"(?m)^\s*(?:Metric:[^;]*;\s*)?Spam:\s*(\w+)", 1)
    score = F.regexp_extract(report, r"(?m)^\s*Score:\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    required = F.regexp_extract(report, r"(?m)^\s*Score:\s*-?\d+(?:\.\d+)?\s*/\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    action = F.regexp_extract(report, r"(?m)^\s*Action:\s*(.+?)\s*$", 1)
    return F.struct(F.lower(metric).isin("true", "yes").alias("spam"), score.alias("score"), required.alias("required"), F.nullif(action, F.lit("")).alias("action"))


def status_header(value: Column) -> Column:
    """struct(spam, score, required) of an ``X-Spam-Status`` header; a header that can't be read gives no and zero."""
    yes = F.lower(F.regexp_extract(value, r"^\s*(\w+)", 1)) == "yes"
    number = lambda k: F.coalesce(F.regexp_extract(value, rf"{k}=(-?\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0))
    return F.struct(F.coalesce(yes, F.lit(False)).alias("spam"), number("score").alias("score"), number("required").alias("required"))


def token_cost(tokens: Column, price_per_thousand: float) -> Column:
    return F.sum(tokens) / 1000 * F.lit(price_per_thousand)
