"""Identities, requests and internal roles recognised in a message.

The recogniser is a plug-in: any function from texts to recognitions. The default is a dictionary and pattern recogniser,
deterministic and without weights; figures published for trained models do not hold for it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from veriloom.functions.text import next_step_urls

#: Verbs of requests and words of internal roles.
REQUESTS = "click verify confirm update open download review sign pay transfer reply call visit log submit provide change reset enable activate install scan send buy".split()
ROLES = ["it helpdesk", "help desk", "human resources", "hr department", "payroll", "it department", "mail administrator", "system administrator", "accounts payable", "front desk", "customer service", "webmaster", "security team", "management", "admin"]
RECOGNITION = StructType([StructField(n, ArrayType(StringType())) for n in ("identities", "actions", "relations")])

_CAPITAL = re.compile(r"(?:[A-ZÀ-Þ][\w'’-]+)(?:\s+(?:of|&|and|de|the)\s+[A-ZÀ-Þ][\w'’-]+|\s+[A-ZÀ-Þ][\w'’-]+){0,3}")
_REQUEST = re.compile(rf"\b(?:{'|'.join(REQUESTS)})\b")
_TEAM = re.compile(r"(?i)\bthe\s+(.{3,40}?)\s+team\b")


def default_recogniser(names: frozenset[str] = frozenset(), roles: tuple[str, ...] = tuple(ROLES)) -> Callable[[str | None], tuple[list[str], list[str], list[str]]]:
    """A recogniser of known names (small letters), capitalised names of a sign-off, requests and roles."""

    def recognise(text: str | None) -> tuple[list[str], list[str], list[str]]:
        if not text:
            return [], [], []
        found: dict[str, str] = {}
        for m in _CAPITAL.finditer(text):
            words = m[0].split()
            for n in range(min(4, len(words)), 0, -1):
                part = " ".join(words[:n])
                if part.lower() in names:
                    found.setdefault(part.lower(), part)
                    break
        for m in _TEAM.finditer(text):
            found.setdefault(m[1].lower(), m[1])
        low = text.lower()
        relations = [r for r in roles if r in low]
        sentences = [s.strip().rstrip(".") for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
        actions = [s for s in sentences if _REQUEST.search(s.lower())]
        if not found and not relations and re.search(r"(?i)\bfrom:\s*admin", text):
            relations = ["admin"]
        return list(found.values()), list(dict.fromkeys(actions)), relations

    return recognise


def recognise(messages: DataFrame, text: Column, names: list[str], recogniser: Callable | None = None, wanted: Column | None = None) -> DataFrame:
    """messages with ``identities``, ``actions``, ``relations`` and ``cta_urls``.

    names: known names, at most 200,000, as they go to every executor with the function.
    wanted: messages that are read; nothing is recognised in the others, and the recogniser is not asked.
    """
    if len(names) > 200_000:
        raise ValueError("more than 200,000 known names")
    known = frozenset(n.lower() for n in names)

    @F.pandas_udf(RECOGNITION)
    def run(s: pd.Series, asked: pd.Series) -> pd.DataFrame:
        f = recogniser or default_recogniser(known)
        return pd.DataFrame([f(t) if a else ([], [], []) for t, a in zip(s, asked, strict=True)], columns=RECOGNITION.names)

    asked = F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))
    out = messages.withColumns({"_text": F.when(asked, text), "_asked": asked}).withColumn("_r", run("_text", "_asked"))
    out = out.select(*messages.columns, "_text", "_r.identities", "_r.actions", "_r.relations")
    return out.withColumn("cta_urls", next_step_urls(F.col("_text"), F.col("actions"))).drop("_text")


def spans_of_tags(tokens: DataFrame, group: str, pos: str, tag: str, token: str) -> DataFrame:
    """(group, start, end, label, text) of B-/I- runs: a run begins at each B and at an I that continues nothing."""
    from pyspark.sql import Window as W

    w = W.partitionBy(group).orderBy(pos)
    label = F.when(F.col(tag) != "O", F.substring(tag, 3, 100))
    rows = tokens.withColumn("_l", label).withColumn("_p", F.lag("_l").over(w))
    begins = F.col("_l").isNotNull() & (F.startswith(F.col(tag), F.lit("B-")) | F.col("_p").isNull() | (F.col("_p") != F.col("_l")))
    rows = rows.withColumn("_run", F.sum(begins.cast("int")).over(w)).where("_l is not null")
    return rows.groupBy(group, "_run").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.first("_l").alias("label"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, token))), lambda x: x[token]), " ").alias("text")).drop("_run")


def entity_scores(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """One row of precision, recall and F1 of exact spans."""
    p = predicted.select(*keys).distinct().withColumn("p", F.lit(1))
    g = gold.select(*keys).distinct().withColumn("g", F.lit(1))
    both = p.join(g, keys, "full").agg(F.sum(F.coalesce(F.col("p") * F.col("g"), F.lit(0))).alias("hit"), F.count("p").alias("np"), F.count("g").alias("ng"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = both.select(ratio("hit", "np").alias("precision"), ratio("hit", "ng").alias("recall"))
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
