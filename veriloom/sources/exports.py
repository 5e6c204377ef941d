"""Messages and results written out: mail files rebuilt from tables, positives with a manifest, labelled copies."""

from __future__ import annotations

import os
from collections.abc import Iterator
from email.message import EmailMessage

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veriloom.operators.allow import numbered


def mail_text(frm: str | None, to: str | None, subject: str | None, date: str | None, body: str | None) -> str:
    """A message as text; line ends within headers become spaces, so that no value can add a header."""
    m = EmailMessage()
    for name, value in (("From", frm), ("To", to), ("Subject", subject), ("Date", date)):
        if value:
            m[name] = " ".join(str(value).split())
    m.set_content(body or "")
    return m.as_string()


@F.pandas_udf(StringType())
def build_eml(frm: pd.Series, to: pd.Series, subject: pd.Series, date: pd.Series, body: pd.Series) -> pd.Series:
    return pd.Series([mail_text(*x) for x in zip(frm, to, subject, date, body, strict=True)])


def materialise(rows: DataFrame, user: str = "user", key: str = "file", time: str = "epoch") -> DataFrame:
    """(join_key ``user/seq.eml``, eml, epoch) of labelled rows; undated ones keep their order as their time."""
    return numbered(rows, [user], [key]).select(
        F.concat(F.col(user), F.lit("/"), F.col("seq").cast("string"), F.lit(".eml")).alias("join_key"), F.col(user).alias("user"),
        build_eml("sender", "receiver", "subject", "date", "body").alias("eml"), F.coalesce(F.col(time), F.col("seq").cast("double")).alias("epoch"),
    )


def write_files(files: DataFrame, folder: str, name: str = "file_name", text: str = "eml") -> int:
    """Writes each text under its name below a folder all executors see; returns how many were written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, t in zip(pdf[name], pdf[text], strict=True):
                path = os.path.normpath(os.path.join(folder, n))
                if not path.startswith(os.path.normpath(folder) + os.sep):
                    raise ValueError(f"name leaves the folder: {n}")
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "w", encoding="utf-8") as f:
                    f.write(t or "")
            yield pd.DataFrame({"n": [len(pdf)]})

    return int(files.select(name, text).mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def read_jsonl(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
