"""The consistency verdict of a message as nested conditions over its recognised identities, roles and domains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from veriloom.functions.domains import SUFFIXES, domains_overlap


def _none(a: Column) -> Column:
    return F.coalesce(F.size(a) == 0, F.lit(True))


def verdict(identities: Column, relations: Column, actions: Column, senders: Column, recipients: Column, official: Column, brands: Column, role: Column, check_action: bool = True, suffixes: Sequence[str] = SUFFIXES, overlaps: tuple[Column, Column] | None = None) -> Column:
    """struct(verdict, status, matched).

    In order: nothing recognised; brands with official domains against the sender's domains; an internal role against the
    recipients' domains where no organisation is named; else no matched brand. ``overlaps`` gives the two overlap tests
    (sender-official, sender-recipient) if they are known already.
    """
    blank = _none(F.filter(F.coalesce(identities, F.array().cast("array<string>")), lambda x: F.trim(x) != ""))
    with_official, with_recipients = overlaps or (domains_overlap(senders, official, suffixes), domains_overlap(senders, recipients, suffixes))
    acts = ~_none(actions) if check_action else F.lit(True)
    foreign = ~_none(official) & ~with_official
    inner = blank & role.isNotNull()
    result = lambda v, s: F.struct(F.lit(v).alias("verdict"), s.alias("status"), F.when(~_none(brands), F.array_sort(brands)).alias("matched"))
    return (
        F.when(_none(identities) & _none(relations), result(False, F.lit("No Prediction")))
        .when(foreign & acts, result(True, F.array_join(F.array_sort(brands), ", ")))
        .when(foreign, result(False, F.array_join(F.array_sort(brands), ", ")))
        .when(~_none(official) & with_official, result(False, F.lit("Consistent")))
        .when(inner & ~with_recipients & acts, result(True, F.concat(F.lit("Internal: "), role)))
        .when(inner & ~with_recipients, result(False, F.concat(F.lit("Internal: "), role)))
        .when(inner & with_recipients, result(False, F.concat(F.lit("Consistent: "), role)))
        .otherwise(result(False, F.lit("No Matched Brand")))
    )


def claimed_identity(matched: Column, identities: Column, statuses: Sequence[str] = ("no prediction", "no matched brand")) -> Column:
    """The identity a message claims: its matched brands, or what was recognised, sorted, joined, in small letters."""
    pick = F.when(~_none(matched), matched).otherwise(F.coalesce(identities, F.array().cast("array<string>")))
    text = F.lower(F.array_join(F.array_sort(F.array_distinct(F.transform(pick, F.trim))), " "))
    return F.when(text.isin(*statuses, "nan", "set()", "none"), F.lit("")).otherwise(F.trim(text))


def banner(verdict_col: Column, status: Column, suppressed: Column) -> Column:
    """Which of the four states a reader is shown."""
    return F.when(suppressed, "trusted").when(verdict_col, "warning").when(status.startswith("Consistent"), "consistent").otherwise("unknown")
