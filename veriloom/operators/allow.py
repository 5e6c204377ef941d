"""Allow-lists and first contacts: who has been confirmed for which identity, and which mail was the first to claim one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriloom.session import shared_path


def mark_allowed(mails: DataFrame, allow: DataFrame, user: str = "user", key: str = "sender_key", target: str = "claimed_identity") -> DataFrame:
    """mails with ``allowed``: whether a pair of the mail's user, or of everybody (null user), is on the list."""
    own = allow.where("user is not null").select(F.col("user").alias("_u"), F.col("sender_key").alias("_k"), F.col("target").alias("_t")).distinct().withColumn("_own", F.lit(True))
    everybody = allow.where("user is null").select(F.col("sender_key").alias("_k2"), F.col("target").alias("_t2")).distinct().withColumn("_all", F.lit(True))
    joined = mails.join(own, (mails[user] == F.col("_u")) & (mails[key] == F.col("_k")) & (mails[target] == F.col("_t")), "left")
    joined = joined.join(everybody, (mails[key] == F.col("_k2")) & (mails[target] == F.col("_t2")), "left")
    return joined.withColumn("allowed", F.coalesce("_own", "_all", F.lit(False))).drop("_u", "_k", "_t", "_own", "_k2", "_t2", "_all")


def suppress(verdict: Column, status: Column, allowed: Column) -> tuple[Column, Column]:
    """Verdict and status after the allow-list."""
    hit = verdict & allowed
    return verdict & ~allowed, F.when(hit, F.concat(status, F.lit(" [whitelisted]"))).otherwise(status)


def first_contacts(mails: DataFrame, keys: list[str], order: list[str], flagged: Column, exempt: Column) -> DataFrame:
    """mails with ``action`` (ok, dmarc_exempt, flag_first_contact, whitelist_suppressed), ``static_fp`` and ``adaptive_fp``.

    Only the first flagged mail that is not exempt alerts for its keys. The first is found by an aggregation with
    map-side combine and joined back, so a key that holds a third of all mails is not sorted in one task.
    """
    counted = flagged & ~exempt
    rank = F.struct(*[F.col(c) for c in order])
    first = mails.where(counted).groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.min(rank).alias("_first"))
    joined = mails.join(first, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left").drop(*[f"_k_{k}" for k in keys])
    is_first = rank == F.col("_first")
    action = F.when(~flagged, "ok").when(exempt, "dmarc_exempt").when(is_first, "flag_first_contact").otherwise("whitelist_suppressed")
    return joined.withColumn("action", action).withColumn("static_fp", counted).withColumn("adaptive_fp", counted & F.coalesce(is_first, F.lit(False))).drop("_first")


def running_totals(mails: DataFrame, order: list[str], values: list[str], part: Column) -> DataFrame:
    """mails with ``running_<value>``: totals up to and with each mail in the order.

    The order is taken within parts (a coarser form of the first order column, such as its day); the parts' subtotals,
    one row each, carry the running sum from part to part. No task sees more than one part.
    """
    rows = mails.withColumn("_part", part)
    totals = rows.groupBy("_part").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select("_part", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_b_{v}") for v in values])
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = rows.select("*", *[F.sum(v).over(inside).alias(f"_w_{v}") for v in values]).join(base, "_part")
    return out.select(*mails.columns, *[(F.col(f"_b_{v}") + F.col(f"_w_{v}")).alias(f"running_{v}") for v in values])


#: Parts of a group of which the first rows are found before those of the group.
SALTS = 64


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str = "seq", most: int | None = None) -> DataFrame:
    """rows with their number (from 0) within their group, at most so many each if asked; ties in any order.

    No task holds a whole group. With ``most`` each of SALTS parts of a group keeps its first ones, and the group's come
    from those. Without, the rows are range-sorted once, so a large group lies in several partitions one after the other,
    and each partition's count of a group is added to the numbers in the later ones.
    """
    if most is not None:
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
        some = salted.withColumn(name, F.row_number().over(W.partitionBy(*group, "_salt").orderBy(*order))).where(F.col(name) <= most).drop("_salt")
        return some.withColumn(name, (F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1).cast("long")).where(F.col(name) < most)
    path = shared_path(rows.sparkSession, "numbered")
    rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    ranged = rows.sparkSession.read.parquet(path)
    counts = ranged.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_part").alias("_p"), "_before")
    inside = ranged.withColumn(name, (F.row_number().over(W.partitionBy(*group, "_part").orderBy(*order)) - 1).cast("long"))
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]
    joined = inside.join(before, [F.col("_part") == F.col("_p"), *same])
    return joined.withColumn(name, F.col(name) + F.col("_before")).select(*rows.columns, name)


def per_user_sequence(mails: DataFrame, user: str, order: list[str], most: int | None = None) -> DataFrame:
    """mails with ``seq``, their number (from 0) within their user, at most so many each if asked."""
    return numbered(mails, [user], order, "seq", most)


def save_allow(allow: DataFrame, path: str) -> None:
    """The list, sorted, written over the one before; it is settled in the shared folder first, so it may come from it."""
    spark = allow.sparkSession
    settled = shared_path(spark, "allow")
    allow.dropDuplicates().write.parquet(settled)
    spark.read.parquet(settled).orderBy("user", "sender_key", "target").coalesce(1).write.mode("overwrite").parquet(path)
