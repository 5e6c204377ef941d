"""Places where outside services come in: translation, language detection, rendering with text recognition, chat models.

Each takes a function and is off without one. A text is handed over once however often it occurs, in batches, with bounded
retries; a call that keeps failing leaves null and says why.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tries of one call, and the seconds before the second; they double.
TRIES, WAIT = 3, 0.5
#: A few words of grammar that tell languages apart.
TELLTALES = {
    "en": "the and of to is that for with was this".split(), "de": "der die und das ist nicht ein mit für auf".split(), "fr": "le la les et des est une que pour dans".split(),
    "es": "el los que una por con para las del está".split(), "pt": "não uma os para com das foi são ao em".split(), "ru": "и в не на что с по это как мы".split(), "it": "il che di non per una sono gli del con".split(),
}


def call(f: Callable[[str], object], value: str, tries: int = TRIES, wait: float = WAIT) -> tuple[object, str | None]:
    """(result, error) of a call that may fail for a while."""
    for k in range(tries):
        try:
            return f(value), None
        except Exception as e:  # noqa: BLE001 whatever the service raises
            error = f"{type(e).__name__}: {e}"[:200]
            if k + 1 < tries:
                time.sleep(wait * 2**k)
    return None, error


def once_each(df: DataFrame, column: str, f: Callable[[str], str | None] | None, result: str, wait: float = WAIT) -> DataFrame:
    """df with ``result`` and ``<result>_error``; without a function the result is the column itself."""
    if f is None:
        return df.withColumn(result, F.col(column)).withColumn(f"{result}_error", F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_t").to_pylist()
            got = [call(f, t, wait=wait) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array([None if r is None else str(r) for r, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], names=["_t", result, f"{result}_error"])

    distinct = df.select(F.col(column).alias("_t")).where("_t is not null").distinct()
    done = distinct.mapInArrow(run, f"_t string, `{result}` string, `{result}_error` string")
    return df.join(done, df[column] == F.col("_t"), "left").drop("_t")


def language(column: str):
    """The language whose telltale words a text has most of, '' without any; a stand-in for a detector."""
    words = F.split(F.lower(F.coalesce(F.col(column), F.lit(""))), r"[^\p{L}]+")
    count = lambda telltales: F.size(F.filter(words, lambda w: w.isin(telltales)))
    hits = [F.struct(count(t).alias("n"), F.lit(code).alias("code")) for code, t in TELLTALES.items()]
    best = F.array_max(F.array(*hits))
    return F.when(best["n"] > 0, best["code"]).otherwise("")


def text_or_rendered(df: DataFrame, text: str, html: str, render: Callable[[str], str | None] | None, least: int = 30) -> DataFrame:
    """df with ``readable``: the text where it is long enough, else what rendering the page gives. The two kinds are
    separate branches, so nothing is rendered in vain."""
    if render is None:
        return df.withColumn("readable", F.col(text))
    long = F.coalesce(F.length(F.trim(F.col(text))) >= least, F.lit(False))
    easy = df.where(long).withColumn("readable", F.col(text))
    hard = once_each(df.where(~long), html, render, "readable").drop("readable_error")
    return easy.unionByName(hard)
