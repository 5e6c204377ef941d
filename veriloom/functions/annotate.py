"""Annotations put on tokens, and results shown as HTML."""

from __future__ import annotations

import html as _html
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: The labels of tokens.
LABELS = ["O", "B-identity", "I-identity", "B-relation", "I-relation", "B-action", "I-action"]
#: An identity's last mention counts only within so many tokens of the end.
TAIL = 100


def occurrences(tokens: list[str], wanted: list[str]) -> list[int]:
    """Where a sequence of tokens begins, all places."""
    n = len(wanted)
    return [k for k in range(len(tokens) - n + 1) if n and tokens[k : k + n] == wanted]


def places(tokens: Column, wanted: Column) -> Column:
    """The same as a native expression over arrays, from 0. Both are variables of an outer lambda, so that they are computed
    once for a row and not at every place; whole slices are compared only where the first token fits."""

    def within(x: Column) -> Column:
        t, w = x["t"], x["w"]
        n, m = F.size(t), F.size(w)
        starts = F.when((m > 0) & (n >= m), F.sequence(F.lit(0), n - m))
        return F.coalesce(F.filter(starts, lambda k: F.when(F.get(t, k).eqNullSafe(F.get(w, F.lit(0))), F.slice(t, k + 1, m) == w)), F.array().cast("array<int>"))

    return F.element_at(F.transform(F.array(F.struct(tokens.alias("t"), wanted.alias("w"))), within), 1)


def first_and_last(tokens: list[str], wanted: list[str]) -> list[int]:
    """The first place, and the last if it lies near the end."""
    at = occurrences(tokens, wanted)
    return at[:1] + ([at[-1]] if len(at) > 1 and at[-1] >= len(tokens) - TAIL else [])


def tags(text: str, annotations: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """(tokens, tags) of a text with annotated parts; relations are put over identities, actions under both."""
    tokens = re.findall(r"\w+|[^\w\s]", text or "")
    out = ["O"] * len(tokens)
    for kind in ("action", "identity", "relation"):
        for part, label in annotations:
            if label != kind:
                continue
            wanted = re.findall(r"\w+|[^\w\s]", part or "")
            for k in first_and_last(tokens, wanted) if kind == "identity" else occurrences(tokens, wanted):
                out[k : k + len(wanted)] = [f"B-{kind}"] + [f"I-{kind}"] * (len(wanted) - 1)
    return tokens, out


TAGGED = StructType([StructField("tokens", ArrayType(StringType())), StructField("tags", ArrayType(StringType()))])


@F.pandas_udf(TAGGED)
def tag_annotations(text: pd.Series, parts: pd.Series, labels: pd.Series) -> pd.DataFrame:
    """Tokens and tags of texts with arrays of annotated parts and their labels."""
    rows = [tags(t, list(zip(p if p is not None else [], k if k is not None else [], strict=False))) for t, p, k in zip(text, parts, labels, strict=True)]
    return pd.DataFrame(rows, columns=TAGGED.names)


def first_subtoken_labels(word_ids: Column, labels: Column) -> Column:
    """Labels of sub-tokens: a word's own at its first, -100 at all others and where there is no word."""
    before = F.concat(F.array(F.lit(None).cast("int")), word_ids)
    return F.transform(word_ids, lambda w, k: F.when(w.isNull() | w.eqNullSafe(F.try_element_at(before, k + 1)), F.lit(-100)).otherwise(F.try_element_at(labels, (w + 1).cast("int"))))


def page(title: Column, sender: Column, body: Column) -> Column:
    """A page of one result."""
    return F.format_string("<html><body><h3>%s</h3><p>%s</p><div>%s</div></body></html>", F.coalesce(title, F.lit("")), F.coalesce(sender, F.lit("")), F.coalesce(body, F.lit("")))


def explanation(verdict: Column, status: Column) -> Column:
    """One sentence for a reader."""
    return (
        F.when(verdict & status.startswith("Internal"), F.concat(F.lit("This mail speaks for "), F.substring_index(status, ": ", -1), F.lit(" but does not come from your organisation.")))
        .when(verdict, F.concat(F.lit("This mail claims to come from "), status, F.lit(" but its sender does not belong to it.")))
        .when(status.startswith("Consistent"), F.lit("The sender fits who the mail claims to be from."))
        .otherwise(F.lit("No claim about the sender was recognised."))
    )


def fenced_json(text: Column) -> Column:
    """A reply's JSON without the fence around it, and without what stands before or after its outermost braces."""
    bare = F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", "")
    found = F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.when(found != "", found)


@F.pandas_udf(StringType())
def token_table(tokens: pd.Series, labels: pd.Series, scores: pd.Series) -> pd.Series:
    """Tokens with their labels and scores as an HTML table."""

    def one(t: list | None, k: list | None, s: list | None) -> str:
        rows = zip(t if t is not None else [], k if k is not None else [], s if s is not None else [], strict=False)
        return "<table>" + "".join(f"<tr><td>{_html.escape(str(a))}</td><td>{_html.escape(str(b))}</td><td>{float(c):.3f}</td></tr>" for a, b, c in rows) + "</table>"

    return pd.Series([one(*x) for x in zip(tokens, labels, scores, strict=True)])


def to_entities(rows: list[dict]) -> str:
    """Entities as JSON, each place and label once, in order."""
    seen = {(r["start"], r["end"], r["label"]): r for r in rows}
    return json.dumps([seen[k] for k in sorted(seen)], ensure_ascii=False)
