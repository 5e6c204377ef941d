"""Measures over result tables: rates, breakdowns, medians, per-mail maxima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_results_meta(results: DataFrame, meta: DataFrame, key: str = "join_key") -> DataFrame:
    """Results with their mail's metadata; columns of metadata that clash get ``_meta``. No row in common is an error
    that the caller finds by the empty result."""
    clash = [c for c in meta.columns if c in results.columns and c != key]
    return results.join(meta.withColumnsRenamed({c: f"{c}_meta" for c in clash}), key)


def rates(mails: DataFrame) -> DataFrame:
    """Static and adaptive false-positive rate, reduction, exemptions and alerts of decided mails."""
    n = F.count(F.lit(1))
    s, a = F.count_if("static_fp"), F.count_if("adaptive_fp")
    return mails.agg(
        n.alias("mails"), F.round(s / n, 9).alias("static_fpr"), F.round(a / n, 9).alias("adaptive_fpr"), F.round(F.when(s > 0, 1 - a / s), 9).alias("reduction"),
        F.count_if(F.col("action") == "dmarc_exempt").alias("exempt"), a.alias("alerts"),
    )


def interactions(mails: DataFrame, user: str) -> DataFrame:
    """Alerts per user: mean, upper median and largest, over users with any. The median is taken from the histogram of
    counts, so no list of all users is gathered."""
    from pyspark.sql import Window as W

    per = mails.where("adaptive_fp").groupBy(user).agg(F.count(F.lit(1)).alias("n"))
    histogram = per.groupBy("n").agg(F.count(F.lit(1)).alias("users"))
    ranked = histogram.withColumn("upto", F.sum("users").over(W.orderBy("n"))).withColumn("all", F.sum("users").over(W.partitionBy()))
    median = F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("n")))
    return ranked.agg(F.sum("users").alias("users"), F.round(F.sum(F.col("n") * F.col("users")) / F.sum("users"), 9).alias("mean"), median.alias("upper_median"), F.max("n").alias("most"))


def breakdown(results: DataFrame, status: str, hit: Column) -> DataFrame:
    """Rows and hits by status, with a row (null) for all."""
    return results.rollup(status).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"), F.grouping(status).cast("int").alias("total"))


def rate_by(rows: DataFrame, group: str, hit: Column) -> DataFrame:
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit.cast("double")), 9).alias("rate"))


def best_per(rows: DataFrame, key: str, score: str, pos: str, values: list[str]) -> DataFrame:
    """The row of highest score of each key, the first in position among equal ones."""
    rank = F.struct(F.coalesce(F.col(score), F.lit(float("-inf"))), -F.col(pos))
    return rows.groupBy(key).agg(F.max_by(F.struct(*values, score, pos), rank).alias("b")).select(key, *[f"b.{c}" for c in (*values, score, pos)])


def vote(probabilities: list[Column]) -> Column:
    """Mean of several estimators' probabilities; null ones don't count."""
    known = F.filter(F.array(*probabilities), lambda p: p.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known))


def top_links(links: DataFrame, source: str, url: str, priority: str, hop: str) -> DataFrame:
    """The links of each page to follow: 15 at the first hop, else 6, by priority, then by name."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy(source).orderBy(F.desc(priority), url))
    return links.withColumn("rn", n).where(F.col("rn") <= F.when(F.col(hop) == 0, 15).otherwise(6))


def report_rate(results: DataFrame, flagged: Column, seconds: Column) -> DataFrame:
    """(rate, median_seconds): the share of flagged results and the median of their run times."""
    return results.agg(F.avg(F.coalesce(flagged, F.lit(False)).cast("int")).alias("rate"), F.median(seconds).alias("median_seconds"))


def top_tags(rows: DataFrame, tag: str, k: int = 5) -> DataFrame:
    """(tag, n): the k most frequent values, ties by name."""
    return rows.where(F.col(tag).isNotNull()).groupBy(tag).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), tag).limit(k)


def match_rates(rows: DataFrame, kind: str, score: Column, threshold: float = 0.78) -> DataFrame:
    """(kind, rate): the share of each kind of change after which the score is still above the threshold."""
    return rows.groupBy(kind).agg(F.avg((score > threshold).cast("int")).alias("rate"))


def before_after(rows: DataFrame, kind: str, before: Column, after: Column) -> DataFrame:
    """(kind, n, rate_before, rate_after): how often an entity was found as it stood and after its change; nulls count as not found."""
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    return rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), rate(before).alias("rate_before"), rate(after).alias("rate_after"))


def most_important(model, names: list[str], k: int = 3) -> list[tuple[str, float]]:
    """The k features a fitted tree model relies on most, largest first, ties by name."""
    weights = model.featureImportances.toArray().tolist()
    return sorted(zip(names, weights, strict=True), key=lambda x: (-x[1], x[0]))[:k]
