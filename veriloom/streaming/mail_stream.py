"""Streams: new mail files scored once as they arrive, and per-user allow-lists that grow with first contacts.

Processing is in order of arrival; the batch form (operators.allow.first_contacts) is in order of time. They agree where
mails arrive in order. Within a micro-batch, mails are put in order first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veriloom.sources.mail import parse_messages

FIRST_CONTACT = "user string, sender_key string, claimed_identity string, mail_id string, at double, action string"


def mail_files(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Message rows of single-mail files as they appear in a folder; each file once, kept by the checkpoint."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return parse_messages(raw.where(F.lower("path").rlike(r"\.(eml|txt)$")))


def score_and_append(stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "path"):
    """Scores each micro-batch and appends it under its batch number; a batch run again replaces its own files only."""

    def each(batch: DataFrame, number: int) -> None:
        score(batch.dropDuplicates([key])).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_contact_stream(flagged: DataFrame) -> DataFrame:
    """(… action) of flagged mails (user, sender_key, claimed_identity, mail_id, at): the first of each sender and identity
    alerts, later ones are suppressed. The state holds one row per user, sender and identity, not per mail."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first = state.get[0] if state.exists else None
        columns = ["user", "sender_key", "claimed_identity", "mail_id", "at", "action"]
        best: pd.DataFrame | None = None  # the rows of the earliest mail so far: all that is kept of the key's batches
        for rows in batches:
            if first is not None:
                yield rows.assign(action=rows["mail_id"].map(lambda m: "flag_first_contact" if m == first else "whitelist_suppressed"))[columns]
                continue
            rows = rows if best is None else pd.concat([best, rows])
            is_best = rows["mail_id"] == rows.sort_values(["at", "mail_id"], kind="stable")["mail_id"].iloc[0]
            best = rows[is_best]
            yield rows[~is_best].assign(action="whitelist_suppressed")[columns]
        if best is not None and len(best):
            first = best["mail_id"].iloc[0]
            yield best.assign(action="flag_first_contact")[columns]
        state.update((first,))

    return flagged.groupBy("user", "sender_key", "claimed_identity").applyInPandasWithState(update, FIRST_CONTACT, "first string", "append", GroupStateTimeout.NoTimeout)


def unique_mails(stream: DataFrame, key: str, event_time: str, delay: str = "7 days") -> DataFrame:
    """Each key once within the delay that late mail is waited for."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def counts_by_window(stream: DataFrame, event_time: str, length: str = "1 day", delay: str = "7 days", by: str = "action") -> DataFrame:
    """Mails by window of event time and a column."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, length), by).agg(F.count(F.lit(1)).alias("n"))
