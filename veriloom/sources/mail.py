"""Mail as tables: single messages, mailbox files, folders, add-in requests, corpora in CSV, JSON lines and Parquet.

Messages that cannot be parsed keep their row with ``parse_error`` set; nothing is dropped in silence.
"""

from __future__ import annotations

import email
import email.policy
import json
import os
import re
from collections.abc import Iterator
from datetime import timezone
from email.message import Message
from email.utils import getaddresses, parsedate_to_datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, StringType, StructType

from veriloom.functions.domains import SUFFIXES, registrable, sender_key
from veriloom.functions.headers import decode_words
from veriloom.operators.allow import numbered
from veriloom.schema import ADDIN, MESSAGE

MAIL_ENDINGS, CONTAINER_ENDINGS = (".eml", ".txt"), (".mbox",)
OPTIONAL_ENDINGS = (".msg", ".pst")


# ---------------------------------------------------------------- parsing


def _payload(part: Message) -> str:
    data = part.get_payload(decode=True)
    if data is None:
        return ""
    for charset in (part.get_content_charset() or "utf-8", "utf-8", "latin-1"):
        try:
            return data.decode(charset)
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("utf-8", "ignore")


def bodies(msg: Message) -> tuple[str, str]:
    """(text, html) of all parts, alternatives one after another."""
    text, html = [], []
    for part in msg.walk():
        if part.is_multipart() or part.get_content_disposition() == "attachment":
            continue
        if part.get_content_type() == "text/plain":
            text.append(_payload(part))
        elif part.get_content_type() == "text/html":
            html.append(_payload(part))
    return "\n".join(text), "\n".join(html)


def parse_bytes(path: str, content: bytes | None) -> dict:
    """One message as a row of the message schema."""
    row = dict.fromkeys(x.strip().split(" ")[0] for x in MESSAGE.replace("struct<name:string,value:string>", "s").split(", "))
    row["path"] = path
    try:
        msg = email.message_from_bytes(content or b"", policy=email.policy.compat32)
        heads = [(k, re.sub(r"\s*\r?\n\s+", " ", str(v))) for k, v in msg.items()]
        get = lambda name: next((v for k, v in heads if k.lower() == name), None)
        every = lambda *names: [v for k, v in heads if k.lower() in names]
        raw_from = get("from")
        if raw_from is not None:
            m = re.match(r"\s*([^\s<>()]+@[^\s<>()]+)\s+\(([^)]*)\)", raw_from)
            angle = re.search(r"<([^<>]*)>[^<>]*$", raw_from)
            name, address = (m[2], m[1]) if m else (raw_from[: angle.start()].strip(' "'), angle[1].strip()) if angle else (raw_from.strip(), raw_from.strip())
            row["sender_name"], row["sender_address"] = decode_words(name), address
        people = getaddresses(every("to", "cc", "bcc")) or getaddresses(every("delivered-to"))
        for r in every("received"):
            if m := re.search(r"(?i)\bfor\s+<?([^\s<>;]+@[^\s<>;]+)>?", r):
                people.append(("", m[1]))
        seen: dict[str, str] = {}
        for n, a in people:
            if a:
                seen.setdefault(a, decode_words(n) or "")
        row["to_addresses"], row["to_names"] = list(seen), list(seen.values())
        reply = getaddresses(every("reply-to"))
        row["reply_to"] = reply[0][1] if reply and reply[0][1] else None
        row["subject"] = decode_words(get("subject"))
        row["body_text"], row["body_html"] = bodies(msg)
        row["headers"] = [{"name": k, "value": v} for k, v in heads]
        row["msg_id"] = get("message-id")
        row["n_parts"] = len(msg.get_payload()) if msg.is_multipart() else 1
        row["date_iso"] = get("date")
        if row["date_iso"]:
            try:
                when = parsedate_to_datetime(row["date_iso"])
                row["date_ts"] = when.astimezone(timezone.utc) if when.tzinfo else when.replace(tzinfo=timezone.utc)
            except (TypeError, ValueError, IndexError):
                row["date_ts"] = None
        if not heads:
            row["parse_error"] = "no header"
    except Exception as e:  # noqa: BLE001 a bad message must not end the job
        row["parse_error"] = f"{type(e).__name__}: {e}"[:300]
    return row


def parse_messages(raw: DataFrame) -> DataFrame:
    """Message rows of (path, content) rows; the content goes no further than this step."""
    schema = StructType.fromDDL(MESSAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = [parse_bytes(p, c) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            yield from pa.Table.from_pylist(rows, schema=arrow).to_batches()

    return raw.select("path", "content").mapInArrow(run, schema)


# ---------------------------------------------------------------- scans


def resolve_input(path: str) -> list[str]:
    """Kinds of mail files below a path; FileNotFoundError if there is none such, ValueError for another kind of file."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    if os.path.isfile(path):
        ending = os.path.splitext(path)[1].lower()
        if ending not in MAIL_ENDINGS + CONTAINER_ENDINGS + OPTIONAL_ENDINGS:
            raise ValueError(f"unsupported kind of mail file: {ending or path}")
        return [ending]
    return sorted({os.path.splitext(f)[1].lower() for _, _, files in os.walk(path) for f in files} & {*MAIL_ENDINGS, *CONTAINER_ENDINGS, *OPTIONAL_ENDINGS})


def read_folder(spark: SparkSession, path: str, exclude: str | None = None, folder: str | None = None) -> DataFrame:
    """Raw rows of all single messages below a path (any case of their endings), pruned by a pattern and a folder name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(F.lower("path").rlike(r"\.(eml|txt)$"))
    if exclude:
        files = files.where(~F.col("path").rlike(exclude))
    if folder:
        files = files.where(F.contains(F.lower("path"), F.lit(f"/{folder.lower()}/")))
    return files.select("path", "modificationTime", "length", "content")


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    """Message rows of a file or folder, mailbox files included, each mail once by path."""
    kinds = resolve_input(path)
    parts = []
    if any(k in MAIL_ENDINGS for k in kinds):
        parts.append(read_folder(spark, path).select("path", "content"))
    if ".mbox" in kinds:
        spark.dataSource.register(MboxSource)
        parts.append(spark.read.format("mbox").load(path).select("path", "content"))
    if optional := [k for k in kinds if k in OPTIONAL_ENDINGS]:
        convert_optional(optional[0])
    raw = parts[0] if parts else spark.createDataFrame([], "path string, content binary")
    for p in parts[1:]:
        raw = raw.unionByName(p)
    return parse_messages(raw.dropDuplicates(["path"]))


def convert_optional(ending: str) -> None:
    """Readers of .msg and .pst need packages this library does not bring."""
    raise NotImplementedError(f"{ending} files need an optional converter; export them as .mbox or .eml")


_FROM_LINE = re.compile(rb"(?m)^From .*\d{4}.*\r?\n")


def split_mbox(data: bytes) -> list[bytes]:
    """The messages of a mailbox file, quoted ``>From`` lines restored."""
    starts = [m for m in _FROM_LINE.finditer(data) if m.start() == 0 or data[: m.start()].endswith((b"\n\n", b"\r\n\r\n"))]
    out = []
    for k, m in enumerate(starts):
        end = starts[k + 1].start() if k + 1 < len(starts) else len(data)
        out.append(re.sub(rb"(?m)^>(>*From )", rb"\1", data[m.end() : end]))
    return out


class MboxSource(DataSource):
    """``spark.read.format("mbox").load(path)``: one partition per mailbox file, rows (path, position, content)."""

    @classmethod
    def name(cls) -> str:
        return "mbox"

    def schema(self) -> str:
        return "path string, position int, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _MboxReader(self.options["path"])


class _MboxReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        if os.path.isfile(self.path):
            return [InputPartition(self.path)]
        found = sorted(os.path.join(d, f) for d, _, files in os.walk(self.path) for f in files if f.lower().endswith(".mbox"))
        return [InputPartition(f) for f in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            for k, content in enumerate(split_mbox(f.read()), 1):
                yield (f"{partition.value}#{k}", k, content)


# ---------------------------------------------------------------- other imports


def parse_addin(requests: DataFrame, column: str) -> DataFrame:
    """Requests of the mail add-in (JSON texts) as message-like rows, without building a message and parsing it again."""
    r = requests.withColumn("r", F.from_json(column, ADDIN))
    people = F.concat(*[F.coalesce(F.col(f"r.{x}"), F.array()) for x in ("to", "cc", "bcc")])
    return r.select(
        F.col("r.sender.displayName").alias("sender_name"),
        F.col("r.sender.emailAddress").alias("sender_address"),
        F.transform(people, lambda p: p["displayName"]).alias("to_names"),
        F.transform(people, lambda p: p["emailAddress"]).alias("to_addresses"),
        F.col("r.subject").alias("subject"),
        F.col("r.body").alias("body_html"),
        F.transform(F.coalesce(F.col("r.attachments"), F.array()), lambda a: a["name"]).alias("attachment_names"),
        F.when(F.col("r").isNull() | F.col("r.sender").isNull(), "no sender").alias("parse_error"),
    )


@F.pandas_udf(ArrayType(StringType()))
def split_concatenated_json(s: pd.Series) -> pd.Series:
    """JSON objects written one after another, as an array of texts; braces within strings don't count. What is no JSON ends
    the list as it stands."""
    decoder = json.JSONDecoder()

    def cut(text: str | None) -> list[str] | None:
        if text is None:
            return None
        out, at = [], 0
        while (m := re.compile(r"\S").search(text, at)) is not None:
            try:
                end = decoder.raw_decode(text, m.start())[1]
            except ValueError:
                end = len(text)
            out.append(text[m.start() : end].rstrip())
            at = end
        return out

    return s.map(cut)


def read_corpus_csv(spark: SparkSession, path: str, most_per_user: int | None = None, most: int | None = None) -> DataFrame:
    """(file, user, message) of a CSV dump of a corpus, inbox folders only, at most so many mails per user, and in all, if asked."""
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    rows = rows.where(F.col("file").rlike("(?i)/inbox/")).withColumn("user", F.substring_index("file", "/", 1))
    if most_per_user is not None:
        rows = numbered(rows, ["user"], ["file"], "seq", most_per_user)
    return rows if most is None else rows.limit(most)


def sample_bodies(rows: DataFrame, body: str, key: str, n: int, seed: int = 0, words: int = 10) -> DataFrame:
    """n rows with bodies of at least so many words, the same ones for a seed whatever the partitions."""
    fit = rows.where(F.size(F.filter(F.split(F.col(body), r"\s+"), lambda w: w != "")) >= words)
    return fit.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def read_header_names(spark: SparkSession, path: str, most: int = 10_000) -> list[str]:
    """A list of registered header names: the first column of a CSV file with a heading; a setting, so a longer one is an error."""
    names = [r[0] for r in spark.read.option("header", "true").csv(path).limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} header names")
    return [n.strip() for n in names if n and n.strip()]


def read_parquet_splits(spark: SparkSession, path: str, columns: list[str], label: str | None = None, benign: str | None = None) -> DataFrame:
    """Columns of a Parquet file or folder of splits with the split's name, one label only if asked."""
    rows = spark.read.parquet(path)
    if label is not None and benign is not None:
        rows = rows.where(F.trim(F.col(label).cast("string")) == benign)
    return rows.select(*columns, F.regexp_extract(F.col("_metadata.file_name"), r"^([A-Za-z]+)", 1).alias("split"))


def kb_domains(kb: DataFrame, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """(brand, domain, registrable) of a knowledge base, each domain once in small letters."""
    rows = kb.select("brand", F.explode_outer("domains").alias("d")).select("brand", F.lower(F.trim("d")).alias("domain")).distinct()
    return rows.withColumn("registrable", registrable(F.col("domain"), suffixes, "host"))


def load_allow(rows: DataFrame, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """An allow-list with its keys in the present form, each pair once."""
    return rows.select(F.col("user"), sender_key(F.col("sender_key"), suffixes).alias("sender_key"), F.lower(F.trim("target")).alias("target")).dropDuplicates()


def not_yet_done(incoming: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """Rows not processed before; to be put right above the scan, before anything expensive."""
    return incoming.join(done.select(key).distinct(), key, "left_anti")


def export_csv(results: DataFrame, path: str) -> None:
    """Results as CSV with arrays as JSON texts."""
    flat = [F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in results.dtypes]
    results.select(*flat).write.mode("append").option("header", "true").csv(path)


def positives_manifest(results: DataFrame) -> DataFrame:
    """Flagged mails with file names that don't collide: the base name, numbered where it repeats."""
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    rows = results.where("verdict").withColumn("base", base)
    rows = numbered(rows, ["base"], ["path"], "_n")
    return rows.withColumn("file_name", F.concat(F.col("base"), F.when(F.col("_n") > 0, F.concat(F.lit("_"), F.col("_n").cast("string"))).otherwise(""), F.lit(".eml"))).drop("base", "_n")
