"""A message to its verdict: gates, recognition, the identities that count, matching, official domains, decision.

In order: a reply or forward is skipped; so is a sender whose domain is on the list of allowed ones; all others are
recognised, their first identities are matched with the knowledge base, and the domains they write from, or lead to, are
compared with the official ones of the brand, or with the recipients' where an internal role is claimed.

Edge cases: null subjects, addresses and bodies count as empty; repeated paths are decided together; an empty knowledge
base leaves every named organisation unmatched.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from veriloom.functions.domains import SUFFIXES, domain_set, domains_overlap
from veriloom.functions.headers import is_reply_subject
from veriloom.functions.text import clean_entity
from veriloom.operators.matching import BRAND, ROLE, cluster_any, first_role, official_domains
from veriloom.operators.recognise import ROLES, recognise
from veriloom.operators.verdict import verdict
from veriloom.session import shared_path

#: What the gates say of a message they let pass unread.
REPLY, ALLOWED_SENDER = "Non-original email (Reply/Forward)", "Sent from an whitelisted address"


@dataclass(frozen=True)
class Mode:
    """How messages are decided: whether any recognised identity may match or the first ones only, whether a warning needs a request."""

    relax: bool = False
    check_action: bool = True
    brand: float = BRAND
    role: float = ROLE


#: The two presets: for runs over files, and for a server that asks for any match.
STRICT, RELAXED = Mode(), Mode(relax=True)


def leading(identities: list[str]) -> list[str]:
    """The clusters of similar identities in order, up to and with the first whose representative is longer than three characters."""
    long = lambda first: len(re.sub(r"[@!:;.]", "", first).strip()) > 3
    clusters = cluster_any([x for x in identities if x is not None], last=long)
    return list(dict.fromkeys(x for c in clusters for x in c))


@F.pandas_udf(ArrayType(StringType()))
def leading_identities(s: pd.Series) -> pd.Series:
    return s.map(lambda a: [] if a is None else leading(list(a)))


def from_allowed_domain(senders: Column, allowed: Sequence[str], suffixes: Sequence[str] = SUFFIXES) -> Column:
    """Whether one of the sender's domains is on a list of allowed ones (a setting: at most 10,000)."""
    if len(allowed) > 10_000:
        raise ValueError("more than 10,000 allowed sender domains")
    listed = F.array(*[F.lit(x.strip().lower()) for x in allowed if x.strip()]) if allowed else F.array().cast("array<string>")
    return F.coalesce(domains_overlap(senders, listed, suffixes), F.lit(False))


def decide(messages: DataFrame, kb: DataFrame, roles: DataFrame | None = None, allowed: Sequence[str] = (), mode: Mode = STRICT, suffixes: Sequence[str] = SUFFIXES, recogniser: Callable | None = None, names: list[str] | None = None) -> DataFrame:
    """(path, verdict, status, matched, identities, actions, relations, cta_urls) of every path of messages (path, sender_name,
    sender_address, to_addresses, reply_to, subject, body_text).

    names: what the default recogniser knows; else the brands of kb, which is then a list within recognise()'s bound.
    Messages are read once, when this is called: what was recognised is kept in a table below the shared checkpoint folder.
    """
    senders = domain_set(F.array("sender_address"), suffixes)
    gate = F.when(is_reply_subject(F.col("subject")), REPLY).when(from_allowed_domain(senders, allowed, suffixes), ALLOWED_SENDER)
    if names is None:
        names = [r[0] for r in kb.select("brand").where("brand is not null").distinct().limit(200_001).collect()] if recogniser is None else []
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    text = F.concat(F.lit("Subject: "), blank("subject"), F.lit(" \n From: "), blank("sender_name"), F.lit(" \n Body: "), blank("body_text"))
    read = recognise(messages.withColumn("_gate", gate), text, names, recogniser, F.col("_gate").isNull())
    clean = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: clean_entity(x)), lambda x: x.isNotNull())
    read = read.withColumns({"_ids": clean("identities"), "_rels": clean("relations")})
    read = read.withColumn("_first", F.col("_ids") if mode.relax else leading_identities("_ids"))
    step = F.when(F.size("cta_urls") > 0, F.col("cta_urls")).otherwise(F.array(F.coalesce(F.col("reply_to"), F.lit(""))))
    read = read.withColumns({"_senders": F.array_union(senders, domain_set(step, suffixes)), "_recipients": domain_set(F.col("to_addresses"), suffixes), "_all": F.concat("_ids", "_rels")})
    kept = ["identities", "actions", "relations", "cta_urls"]
    # What was read is a table without texts: matching and the joins pass over it several times, over the messages never again.
    spark = messages.sparkSession
    stored = shared_path(spark, "recognised")
    read.select("path", "_gate", "_ids", "_rels", "_first", "_senders", "_recipients", "_all", *kept).dropDuplicates(["path"]).write.parquet(stored)
    marked = spark.read.parquet(stored)
    seen = marked.where("_gate is null")
    official = official_domains(seen, "path", "_first", kb, mode.brand)
    if roles is None:
        roles = spark.createDataFrame([(r,) for r in ROLES], "role string")
    internal = first_role(seen, "path", "_all", roles, mode.role)
    joined = seen.join(official, "path", "left").join(internal, "path", "left")
    overlaps = [domains_overlap(F.col("_senders"), F.col(c), suffixes) for c in ("official", "_recipients")]
    joined = joined.withColumns({"_official": overlaps[0], "_inside": overlaps[1]})
    v = verdict(F.col("_ids"), F.col("_rels"), F.col("actions"), F.col("_senders"), F.col("_recipients"), F.col("official"), F.col("brands"), F.col("role"), mode.check_action, suffixes, (F.col("_official"), F.col("_inside")))
    decided = joined.withColumn("_v", v).select("path", "_v.verdict", "_v.status", "_v.matched", *kept)
    none = F.array().cast("array<string>")
    passed = marked.where("_gate is not null").select("path", F.lit(False).alias("verdict"), F.col("_gate").alias("status"), F.lit(None).cast("array<string>").alias("matched"), *[none.alias(c) for c in kept])
    return decided.unionByName(passed)
