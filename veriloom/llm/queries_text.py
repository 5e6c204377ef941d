"""Queries of the character problems: look-alike text (1) and wrongly decoded text (2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm.mojibake import damaged_fields
from veriloom.llm.unicode_forms import cases, normalise_text
from veriloom.session import table


def _documents(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("rec_key"), *fields)


def _classified(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    return table(spark, sf_dir, "req2_llm_classified").select(F.col("file").alias("rec_key"), *fields)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_table, rec_key) of texts and display names with characters that only look like the usual ones."""
    docs = cases(_documents(spark, sf_dir, "text"), ["rec_key"], "text")
    names = cases(_classified(spark, sf_dir, "from_name"), ["rec_key"], "from_name").distinct()
    tag = lambda df, t: df.select(F.lit(t).alias("src_table"), "rec_key")
    return tag(docs, "documents").unionByName(tag(names, "req2_llm_classified"))


def p1_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_table, rec_key, text_tidy, text_key): every text and every display name with its readable and its comparison form."""
    docs = normalise_text(_documents(spark, sf_dir, "text"), "text").select(F.lit("documents").alias("src_table"), "rec_key", "text_tidy", "text_key")
    names = normalise_text(_classified(spark, sf_dir, "from_name"), "from_name").select(F.lit("req2_llm_classified").alias("src_table"), "rec_key", "text_tidy", "text_key")
    return docs.unionByName(names)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_table, rec_key, field) of fields that were decoded wrongly in any part."""
    docs = damaged_fields(_documents(spark, sf_dir, "text", "subject"), ["rec_key"], ["text", "subject"])
    rows = damaged_fields(_classified(spark, sf_dir, "subject"), ["rec_key"], ["subject"]).select("rec_key", "field").distinct()
    tag = lambda df, t: df.select(F.lit(t).alias("src_table"), "rec_key", "field")
    return tag(docs, "documents").unionByName(tag(rows, "req2_llm_classified"))


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_table, rec_key, field, original): the damaged fields of both tables with their original text as far as it is known."""
    docs = damaged_fields(_documents(spark, sf_dir, "text", "subject"), ["rec_key"], ["text", "subject"])
    rows = damaged_fields(_classified(spark, sf_dir, "subject"), ["rec_key"], ["subject"])
    tag = lambda df, t: df.select(F.lit(t).alias("src_table"), "rec_key", "field", "original")
    return tag(docs, "documents").unionByName(tag(rows, "req2_llm_classified"))


QUERIES = {"p1_found": p1_found, "p1_normalised": p1_normalised, "p2_found": p2_found, "p2_repaired": p2_repaired}
