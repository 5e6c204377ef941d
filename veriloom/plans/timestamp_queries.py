"""Queries of the timestamp operator over the mail stream and its decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.operators.timestamps import STATED, normalise_timestamps
from veriloom.session import table

#: Seconds from which two instants of one mail count as different.
LEAST_DIFFERENCE_S = 60


def instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(side, join_key, instant columns) of every mail_meta and decision row."""
    both = table(spark, sf_dir, "mail_meta").select(F.lit("mail").alias("side"), "join_key", "date_iso")
    both = both.unionByName(table(spark, sf_dir, "decision").select(F.lit("decision").alias("side"), "join_key", "date_iso"))
    both = both.withColumn("source", F.split_part("join_key", F.lit("/"), F.lit(1)))
    zones = table(spark, sf_dir, "mailbox").where("user_name is not null").groupBy(F.col("user_name").alias("source")).agg(F.max("tz_name").alias("tz_name"))
    return normalise_timestamps(both, "date_iso", "source", "tz_name", STATED, zones=zones)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """join_keys whose mail_meta and decision rows state instants at least 60 seconds apart.

    Some pair of one row each is that far apart if and only if the extremes are, so a mail's rows are reduced to four
    numbers before the shuffle and no row is joined with another.
    """
    at = lambda side: F.when(F.col("side") == side, F.col("instant_s"))
    ends = (
        instants(spark, sf_dir)
        .where("instant_s is not null and join_key is not null")
        .groupBy("join_key")
        .agg(F.min(at("mail")).alias("m0"), F.max(at("mail")).alias("m1"), F.min(at("decision")).alias("d0"), F.max(at("decision")).alias("d1"))
    )
    return ends.where((F.col("m1") - F.col("d0") >= LEAST_DIFFERENCE_S) | (F.col("d1") - F.col("m0") >= LEAST_DIFFERENCE_S)).select("join_key")


def p3_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(side, join_key, date_iso, instant_s, instant_status, instant_format, instant_posterior) of every row of mail_meta and decision."""
    return instants(spark, sf_dir).drop("source")


def p3_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each table have which status and format."""
    return instants(spark, sf_dir).groupBy("side", "instant_status", "instant_format").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p3_found": p3_found, "p3_instants": p3_instants, "p3_status_counts": p3_status_counts}
