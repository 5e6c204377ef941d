"""Mixed timestamp texts to one UTC instant each.

Every value is read under all formats that can hold it. Where more than one reading is valid (day or month first, order
of a short year), a per-source mixture over the readings is fitted by expectation-maximisation; the posterior chooses a
reading, and a value whose best posterior stays under ``min_posterior`` is marked ``ambiguous`` instead of guessed.

Values in the forms that have one reading only and state their own offset (ISO 8601 with offset, plain numbers of seconds or
milliseconds) are read by native expressions and never reach Python, the zones or the mixtures. Only values of several
readings meet the mixture of their source.

Edge cases: null, empty and non-time texts get status ``missing`` / ``no_time``; a bare date ``date_only``; an impossible
date or clock ``impossible``; a wall clock without known zone ``no_zone``; a wall clock that its zone shows twice or never
``local_twice`` / ``local_never``. All of these have a null instant. Texts of any length are read whole.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from datetime import datetime
from zoneinfo import ZoneInfo

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Offsets in minutes of the zone letters that count; any other letters name no zone.
ZONE_LETTERS = {
    "UTC": 0, "UT": 0, "GMT": 0, "Z": 0,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600, "AST": -240, "ADT": -180, "NST": -210, "NDT": -150,
    "WET": 0, "WEST": 60, "BST": 60, "IST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "JST": 540,
}

#: Month names of the languages that the mail clients write.
MONTH_NAMES = [
    "january januar janvier enero janeiro gennaio jan january. janv ene",
    "february februar février fevrier febrero fevereiro febbraio feb févr fev",
    "march märz marz mars marzo março marco mar mär",
    "april avril abril aprile apr avr abr",
    "may mai mayo maio maggio",
    "june juni juin junio junho giugno jun",
    "july juli juillet julio julho luglio jul juil",
    "august août aout agosto aug ago",
    "september septembre septiembre setembro settembre sep sept set",
    "october oktober octobre octubre outubro ottobre oct okt out",
    "november novembre noviembre novembro nov",
    "december dezember décembre decembre diciembre dezembro dicembre dec dez déc dic",
]
MONTHS = {name: k for k, names in enumerate(MONTH_NAMES, 1) for name in names.split()}

_CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?"
_AMPM = r"(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?:\s*(?P<off>[+-]\d{2}:?\d{2}|[+-]\d{2}(?!\d)))?(?:\s*\[(?P<id1>[A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*)\]|\s*\(?(?P<zl>[A-Za-z]{1,5})\)?(?![A-Za-z/_])|\s+(?P<id2>[A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)+))?"
_WEEKDAY = r"(?:[^\W\d_]{2,12}\.?,?\s+)?"

#: Format components: name and pattern. The first that matches whole is the value's family.
FAMILIES = [
    ("iso", rf"(?P<y>\d{{4}})-(?P<mo>\d{{2}})-(?P<d>\d{{2}})[T\s]\s*{_CLOCK}{_AMPM}{_ZONE}"),
    ("compact", r"(?P<y>\d{4})(?P<mo>\d{2})(?P<d>\d{2})[T ]?(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?:[.,](?P<f>\d+))?(?:(?P<zl>Z)|(?P<off>[+-]\d{2}:?\d{2}))"),
    ("compact_t", r"(?P<y>\d{4})(?P<mo>\d{2})(?P<d>\d{2})T(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?:[.,](?P<f>\d+))?"),
    ("ymd_slash", rf"(?P<y>\d{{4}})[/.](?P<mo>\d{{1,2}})[/.](?P<d>\d{{1,2}})[T,\s]\s*{_CLOCK}{_AMPM}{_ZONE}"),
    ("slash", rf"(?P<n1>\d{{1,2}})/(?P<n2>\d{{1,2}})/(?P<y>\d{{4}}|\d{{2}})[,\s]\s*{_CLOCK}{_AMPM}{_ZONE}"),
    ("dot", rf"(?P<n1>\d{{1,2}})\.(?P<n2>\d{{1,2}})\.(?P<y>\d{{4}}|\d{{2}})[,\s]\s*{_CLOCK}{_AMPM}{_ZONE}"),
    ("dash", rf"(?P<n1>\d{{1,2}})-(?P<n2>\d{{1,2}})-(?P<y>\d{{4}}|\d{{2}})[,\s]\s*{_CLOCK}{_AMPM}{_ZONE}"),
    ("day_month", rf"{_WEEKDAY}(?P<d>\d{{1,2}})(?:\.|st|nd|rd|th|er|º)?(?:\s+(?:de\s+|of\s+)?|-)(?P<mon>[^\W\d_]+)\.?,?(?:\s+(?:de\s+)?|-)(?P<y>\d{{4}}|\d{{2}}),?\s+(?:(?:at|um|à|a las|às)\s+)?{_CLOCK}{_AMPM}{_ZONE}"),
    ("month_day", rf"{_WEEKDAY}(?P<mon>[^\W\d_]+)\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}),?\s+(?:at\s+)?{_CLOCK}{_AMPM}{_ZONE}"),
    ("ctime", rf"[^\W\d_]{{2,12}}\s+(?P<mon>[^\W\d_]+)\s+(?P<d>\d{{1,2}})\s+{_CLOCK}(?:\s+(?P<zl>[A-Z]{{1,5}}))?\s+(?P<y>\d{{4}})"),
]
_COMPILED = [(name, re.compile(pattern)) for name, pattern in FAMILIES]
_NUMBER = re.compile(r"(-?)(\d+)(?:\.(\d+))?")
_FAST = re.compile(r"(\d{4})-(\d\d)-(\d\d)[T ](\d\d):(\d\d)(?::(\d\d)(?:[.,](\d+))?)?(?:(Z)|([+-])(\d\d):?(\d\d)(?:\[[A-Za-z_/+\-0-9]+\])?)")
_BARE = re.compile(r"\d{4}-\d{1,2}-\d{1,2}|\d{1,4}[./]\d{1,2}[./]\d{1,4}|\d{1,2}-\d{1,2}-\d{2,4}")

#: Families whose numbers can be read in several orders, with the readings of (n1, n2).
ORDERS = {"slash": ("mdy", "dmy"), "dot": ("dmy", "mdy"), "dash": ("dmy", "mdy")}

#: The stated reading of this project's tables: prior weight of each order, 0 for one that is never meant.
STATED = {"slash": {"mdy": 1.0, "dmy": 0.0}, "dot": {"dmy": 1.0, "mdy": 0.0}}


@functools.lru_cache(maxsize=1024)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:
        return None


def _days(y: int, m: int, d: int) -> int:
    """Days since 1970-01-01 of a proleptic Gregorian date."""
    y -= m <= 2
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + (-3 if m > 2 else 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


_MDAYS = (0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def _valid(y: int, m: int, d: int) -> bool:
    if not (1 <= m <= 12 and d >= 1 and 1 <= y <= 9999):
        return False
    return d <= _MDAYS[m] or (m == 2 and d == 29 and (y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)))


def _wall(y: int, mo: int, d: int, h: int, mi: int, s: int, zone: ZoneInfo) -> tuple[int | None, str]:
    at = datetime(y, mo, d, h, mi, s, tzinfo=zone)
    a, b = at.utcoffset(), at.replace(fold=1).utcoffset()
    if a != b:
        return None, "local_twice" if a > b else "local_never"
    return int(_days(y, mo, d) * 86400 + h * 3600 + mi * 60 + s - a.total_seconds()), "ok"


def _number(text: str) -> tuple[int | None, str, str] | None:
    m = _NUMBER.fullmatch(text)
    if not m:
        return None
    sign, whole = m[1], m[2].lstrip("0") or "0"
    if m[3] is None and len(m[2]) == 14 and _valid(int(m[2][:4]), int(m[2][4:6]), int(m[2][6:8])) and 1900 <= int(m[2][:4]) <= 2100:
        return None
    if m[3] is None and len(m[2]) == 8 and m[2][:2] in ("19", "20") and _valid(int(m[2][:4]), int(m[2][4:6]), int(m[2][6:])):
        return None, "date_only", "compact"
    n = len(whole)
    unit = 0 if n <= 11 else 3 if n <= 14 else 6 if n <= 17 else 9 if n <= 20 else None
    if unit is None:
        return None, "no_time", "number"
    value = int(whole) // 10**unit
    return (-value if sign else value), "ok", ("epoch_s", "epoch_ms", "epoch_us", "epoch_ns")[unit // 3]


def read(text: str | None, zone_name: str | None, weights: dict[str, float] | None, min_posterior: float = 0.9) -> tuple[int | None, str, str | None, float | None]:
    """(instant in seconds since 1970 UTC, status, format, posterior) of one value.

    weights: the source's mixture weights, keys like ``slash:mdy``. Fractions of a second are cut off.
    """
    if text is None:
        return None, "missing", None, None
    m = _FAST.fullmatch(text)
    if m:
        y, mo, d, h, mi, s = int(m[1]), int(m[2]), int(m[3]), int(m[4]), int(m[5]), int(m[6] or 0)
        if not _valid(y, mo, d) or h > 23 or mi > 59 or s > 59:
            return None, "impossible", "iso", None
        off = 0
        if m[9]:
            off = int(m[10]) * 60 + int(m[11])
            if off > 14 * 60 or int(m[11]) > 59:
                return None, "impossible", "iso", None
            if m[9] == "-":
                off = -off
        return _days(y, mo, d) * 86400 + h * 3600 + mi * 60 + s - off * 60, "ok", "iso", 1.0
    text = text.strip()
    if not text:
        return None, "missing", None, None
    if m := _FAST.fullmatch(text):
        return read(text, zone_name, weights, min_posterior)
    if text[0] in "-0123456789" and (number := _number(text)):
        return *number, 1.0 if number[0] is not None else None
    for family, pattern in _COMPILED:
        if m := pattern.fullmatch(text):
            break
    else:
        return None, "date_only" if _BARE.fullmatch(text) else "no_time", None, None
    g = m.groupdict()
    y = int(g["y"]) + (2000 if len(g["y"]) == 2 else 0)
    h, mi, s = int(g["h"]), int(g["mi"]), int(g.get("s") or 0)
    if ap := g.get("ap"):
        if not 1 <= h <= 12:
            return None, "impossible", family, None
        h = h % 12 + (12 if ap in "pP" else 0)
    if h > 23 or mi > 59 or s > 59:
        return None, "impossible", family, None
    posterior = 1.0
    if g.get("n1"):
        n = (int(g["n1"]), int(g["n2"]))
        found: dict[tuple[int, int], float] = {}
        best = None
        for order in ORDERS[family]:
            w = (weights or {}).get(f"{family}:{order}", 0.5)
            day = n if order == "mdy" else n[::-1]  # (month, day)
            if w > 0 and _valid(y, *day):
                found[day] = found.get(day, 0.0) + w
        if not found:
            return None, "impossible", family, None
        total = sum(found.values())
        best = max(found, key=lambda k: (found[k], k))
        posterior = found[best] / total
        mo, d = best
        if posterior < min_posterior:
            return None, "ambiguous", family, posterior
    else:
        mo = int(g["mo"]) if g.get("mo") else MONTHS.get(g["mon"].lower().rstrip("."), 0)
        d = int(g["d"])
        if g.get("mon") and not mo:
            return None, "no_time", None, None
        if not _valid(y, mo, d):
            return None, "impossible", family, None
    local = _days(y, mo, d) * 86400 + h * 3600 + mi * 60 + s
    if off := g.get("off"):
        digits = off[1:].replace(":", "")
        minutes = int(digits[:2]) * 60 + int(digits[2:] or 0)
        if minutes > 14 * 60 or int(digits[2:] or 0) > 59:
            return None, "impossible", family, None
        return local - (-minutes if off[0] == "-" else minutes) * 60, "ok", family, posterior
    if name := g.get("id1") or g.get("id2"):
        zone = _zone(name)
        if zone is None and name.upper() in ZONE_LETTERS:
            return local - ZONE_LETTERS[name.upper()] * 60, "ok", family, posterior
        if zone is None:
            return None, "no_zone", family, None
    elif letters := g.get("zl"):
        if letters.upper() not in ZONE_LETTERS:
            return None, "no_zone", family, None
        return local - ZONE_LETTERS[letters.upper()] * 60, "ok", family, posterior
    else:
        zone = _zone(zone_name) if zone_name else None
        if zone is None:
            return None, "no_zone", family, None
    instant, status = _wall(y, mo, d, h, mi, s, zone)
    return instant, status, family, posterior if instant is not None else None


def _evidence(value: Column) -> Column:
    """A value's family and which of its orders are valid, as ``slash:10``; null where only one reading exists."""
    parts = [F.regexp_extract(value, r"^\s*(\d{1,2})([/.-])(\d{1,2})[/.-](?:\d{4}|\d{2})[,\s]", k) for k in (1, 2, 3)]
    n1, n2 = parts[0].cast("int"), parts[2].cast("int")
    family = F.when(parts[1] == "/", "slash").when(parts[1] == ".", "dot").when(parts[1] == "-", "dash")
    mdy, dmy = (n1 <= 12) & (n2 <= 31), (n2 <= 12) & (n1 <= 31)
    bit = lambda c: F.when(c, "1").otherwise("0")
    first = F.when(family == "slash", bit(mdy)).otherwise(bit(dmy))
    second = F.when(family == "slash", bit(dmy)).otherwise(bit(mdy))
    return F.when(parts[1] != "", F.concat(family, F.lit(":"), first, second))


def em(evidence: dict[str, dict[str, int]], priors: dict[str, dict[str, float]], rounds: int = 30) -> dict[str, float]:
    """Mixture weights of the orders of each family from counts of values by valid orders (``11`` both, ``10`` first only).

    priors: weight of an order before any value is seen, 0 for one that is never meant (its values are then impossible).
    """
    out: dict[str, float] = {}
    for family, orders in ORDERS.items():
        prior = priors.get(family) or {}
        alpha = [prior.get(o, 0.5) for o in orders]
        pi = [a / (sum(alpha) or 1.0) for a in alpha]
        counts = evidence.get(family, {})
        for _ in range(rounds):
            got = list(alpha)
            for bits, n in counts.items():
                like = [p * (b == "1") for p, b in zip(pi, bits, strict=True)]
                total = sum(like)
                if total > 0:
                    got = [g + n * x / total for g, x in zip(got, like, strict=True)]
            got = [g if a > 0 else 0.0 for g, a in zip(got, alpha, strict=True)]
            new = [g / (sum(got) or 1.0) for g in got]
            if max(abs(a - b) for a, b in zip(new, pi, strict=True)) < 1e-9:
                break
            pi = new
        out |= {f"{family}:{o}": p for o, p in zip(orders, pi, strict=True)}
    return out


def fit_mixtures(df: DataFrame, value: str, source: str, priors: dict[str, dict[str, float]]) -> DataFrame:
    """(source, weights map) by EM.

    The values are counted by source and evidence class before anything is grouped in Python, so a group has at most a
    dozen rows whatever a source's size.
    """
    counts = (
        df.select(F.col(source).alias("source"), _evidence(F.col(value)).alias("evidence"))
        .where("evidence is not null and source is not null")
        .groupBy("source", "evidence")
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        evidence: dict[str, dict[str, int]] = {}
        for e, n in zip(pdf["evidence"], pdf["n"], strict=True):
            family, bits = e.split(":")
            evidence.setdefault(family, {})[bits] = int(n)
        w = em(evidence, priors)
        return pd.DataFrame({"source": [pdf["source"].iloc[0]], "weights": [list(w.items())]})

    def typed(pdf: pd.DataFrame) -> pd.DataFrame:
        out = fit(pdf)
        out["weights"] = [dict(x) for x in out["weights"]]
        return out

    return counts.groupBy("source").applyInPandas(typed, "source string, weights map<string,double>")


#: What Spark's own reader takes as these texts mean it: offsets beyond 14 hours are left to the formats.
_ISO = r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.][0-9]{1,6})?(?:Z|[+-](?:(?:0[0-9]|1[0-3]):?[0-5][0-9]|14:?00))$"
_SECONDS, _MILLIS = r"^[1-9][0-9]{8,9}(?:[.][0-9]+)?$", r"^[1-9][0-9]{12}$"


def native_instants(df: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """(the rows of df that native expressions read, with the four result columns; the other rows of df)."""
    v = F.col(value)
    form = F.when(v.rlike(_ISO), "iso").when(v.rlike(_SECONDS), "epoch_s").when(v.rlike(_MILLIS), "epoch_ms")
    number = F.substring_index(v, ".", 1).try_cast("long")
    seconds = F.unix_seconds(v.try_cast("timestamp"))
    instant = F.when(F.col("instant_format") == "iso", seconds).when(F.col("instant_format") == "epoch_s", number).otherwise(F.floor(number / 1000))
    kept = [c for c in df.columns if c not in RESULTS]
    marked = df.select(*kept, form.alias("instant_format"))
    done = marked.where("instant_format is not null").select(*kept, instant.alias("instant_s"), "instant_format")
    status = F.when(F.col("instant_s").isNull(), "impossible").otherwise("ok")
    done = done.select(*kept, "instant_s", status.alias("instant_status"), "instant_format", F.when(F.col("instant_s").isNotNull(), 1.0).alias("instant_posterior"))
    return done, marked.where("instant_format is null").drop("instant_format")


#: Columns of the result.
RESULTS = ["instant_s", "instant_status", "instant_format", "instant_posterior"]


def normalise_timestamps(df: DataFrame, value: str, source: str, zone: str, priors: dict[str, dict[str, float]] | None = None, min_posterior: float = 0.9, zones: DataFrame | None = None) -> DataFrame:
    """df with ``instant_s`` (bigint seconds UTC, null if the value names none), ``instant_status``, ``instant_format`` and ``instant_posterior``.

    value: the column of texts; source: the column whose values share a mixture; zone: the column of the wall clock's
    zone name (null: unknown). zones: a table (source, zone) that has it instead of df; its sources are unique, and only
    the rows whose texts need it are joined with it. priors: see em(); None learns every order from the data alone.
    Columns of df with the names of the results are replaced.
    """
    from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

    priors = priors or {}
    done, rest = native_instants(df, value)
    kept = rest.columns
    mixtures = fit_mixtures(rest, value, source, priors).withColumnsRenamed({"source": "__source", "weights": "__weights"})
    if zones is not None:
        rest = rest.join(zones.withColumnRenamed(source, "__zoned"), F.col(source) == F.col("__zoned"), "left").drop("__zoned")
    default = em({}, priors)
    schema = pa.schema([("instant_s", pa.int64()), ("instant_status", pa.string()), ("instant_format", pa.string()), ("instant_posterior", pa.float64())])
    fields = [df.schema[c] for c in kept] + [StructField("instant_s", LongType()), StructField("instant_status", StringType()), StructField("instant_format", StringType()), StructField("instant_posterior", DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names = batch.column(value).to_pylist(), batch.column(zone).to_pylist()
            learnt = batch.column("__weights").to_pylist() if "__weights" in batch.schema.names else [None] * len(texts)
            rows = [read(t, z, dict(w) if w else default, min_posterior) for t, z, w in zip(texts, names, learnt, strict=True)]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            arrays = [batch.column(c) for c in kept] + [pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=kept + RESULTS)

    several = _evidence(F.col(value)).isNotNull() & F.col(source).isNotNull()
    single = rest.where(~F.coalesce(several, F.lit(False))).mapInArrow(run, StructType(fields))
    mixed = rest.where(several).join(mixtures, F.col(source) == F.col("__source"), "left").drop("__source").mapInArrow(run, StructType(fields))
    return done.unionByName(single).unionByName(mixed)
