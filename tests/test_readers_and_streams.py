"""Readers, writers, streams and detectors over small made inputs."""

import json
from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from veriloom.functions.filter_reports import token_cost
from veriloom.functions.html_shrink import prompt_text
from veriloom.functions.text import label_html
from veriloom.operators import evaluate as E
from veriloom.operators import features as X
from veriloom.operators.perturb import SIMILAR, accent_all, move_sentence_up, similar_char
from veriloom.sources import mail as S
from veriloom.streaming import mail_stream as M


def test_corpus_csv(spark, tmp_path):
    rows = [(f"ann/inbox/{k}.", f"line one\nsaid \"{k}\"") for k in range(5)] + [("ann/sent/1.", "x"), ("bob/Inbox/1.", "y"), (None, "z")]
    pd.DataFrame(rows, columns=["file", "message"]).to_csv(tmp_path / "corpus.csv", index=False)
    got = S.read_corpus_csv(spark, str(tmp_path / "corpus.csv"))
    assert {r.file for r in got.collect()} == {f"ann/inbox/{k}." for k in range(5)} | {"bob/Inbox/1."}
    few = S.read_corpus_csv(spark, str(tmp_path / "corpus.csv"), 2)
    assert sorted((r.user, r.seq) for r in few.collect()) == [("ann", 0), ("ann", 1), ("bob", 0)]
    assert S.read_corpus_csv(spark, str(tmp_path / "corpus.csv"), 2, most=1).count() == 1


def test_splits_names_and_addin(spark, tmp_path):
    df = spark.createDataFrame([(" 0 ", "a"), ("1", "b"), (None, "c")], "label string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "data"))
    (next((tmp_path / "data").glob("*.parquet"))).rename(tmp_path / "data" / "train-000.parquet")
    got = S.read_parquet_splits(spark, str(tmp_path / "data"), ["text"], "label", "0").collect()
    assert [(r.text, r.split) for r in got] == [("a", "train")]
    (tmp_path / "names.csv").write_text("Header\nReceived\n Message-ID \n\n")
    assert S.read_header_names(spark, str(tmp_path / "names.csv")) == ["Received", "Message-ID"]
    person = lambda n: {"displayName": n, "emailAddress": f"{n}@b.example"}
    requests = [json.dumps({"subject": "s", "sender": person("ann"), "to": [person("bob")], "cc": [person("cy")], "body": "<p>x</p>", "attachments": [{"name": "f.pdf"}]}), "{}", None, "no json"]
    rows = S.parse_addin(spark.createDataFrame([(r,) for r in requests], "j string"), "j").collect()
    assert rows[0].sender_address == "ann@b.example" and rows[0].to_names == ["bob", "cy"] and rows[0].attachment_names == ["f.pdf"] and rows[0].parse_error is None
    assert [r.parse_error for r in rows[1:]] == ["no sender"] * 3


def test_results_written(spark, tmp_path):
    results = spark.createDataFrame([("x/a.eml", True, ["b"]), ("y/a.eml", True, []), ("z/a.eml", False, None), ("z/c.txt", True, None)], "path string, verdict boolean, matched array<string>")
    S.export_csv(results, str(tmp_path / "out"))
    S.export_csv(results.where("false"), str(tmp_path / "out"))
    back = spark.read.option("header", "true").option("escape", "\\").csv(str(tmp_path / "out"))
    assert back.count() == 4 and back.where("path = 'x/a.eml'").first().matched == '["b"]'
    assert sorted(r.file_name for r in S.positives_manifest(results).collect()) == ["a.eml", "a_1.eml", "c.eml"]


def test_stream_of_mail_files(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    (box / "one.eml").write_text("From: A <a@b.example>\nTo: C <c@d.example>\nSubject: s\n\nbody")
    (box / "note.bin").write_text("x")
    score = lambda batch: batch.select("path", "sender_address")
    for number in (1, 2):
        run = M.score_and_append(M.mail_files(spark, str(box)), score, str(tmp_path / "scored"), str(tmp_path / "checkpoint"))
        run.awaitTermination()
        assert spark.read.parquet(str(tmp_path / "scored")).count() == number
        (box / "two.txt").write_text("From: B <b@b.example>\n\nbody")
    assert {r.sender_address for r in spark.read.parquet(str(tmp_path / "scored")).collect()} == {"a@b.example", "b@b.example"}


def test_windows_and_late_mail(spark, tmp_path):
    at = lambda day, hour=0: datetime(2024, 1, day, hour)
    rows = [("a", at(1), "ok"), ("a", at(1, 5), "ok"), ("b", at(1, 6), "flag"), ("c", at(20), "ok")]
    schema = "id string, at timestamp, action string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def run(df, name):
        df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    assert sorted(r.id for r in run(M.unique_mails(stream, "id", "at"), "once").collect()) == ["a", "b", "c"]
    # the later mail moves the watermark past the first day, whose windows are then complete
    assert {(r.action, r.n) for r in run(M.counts_by_window(stream, "at"), "windows").collect()} == {("ok", 2), ("flag", 1)}


def test_first_contacts_over_batches(spark, tmp_path):
    rows = [("u", "s", "i", f"m{k}", float(100 - k)) for k in range(30)] + [("u", "s", "i", "m29", 71.0), ("v", "s", "i", "x", 1.0)]
    schema = "user string, sender_key string, claimed_identity string, mail_id string, at double"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    run = M.first_contact_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("contacts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = [(r.mail_id, r.action) for r in spark.table("contacts").collect()]
    assert len(got) == 32 and sorted(m for m, a in got if a == "flag_first_contact") == ["m29", "m29", "x"]


def test_texts_and_changes(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    names = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    assert one(label_html(F.lit('<a title="Velora">VELORA: click</a>'), names("velora"), names("click"))) == '<a title="Velora"><span class="identity">VELORA</span>: <span class="action">click</span></a>'
    assert one(label_html(F.lit("<p>x</p>"), names(), names())) == "<p>x</p>" and one(label_html(F.lit(None).cast("string"), names("x"), names())) is None
    assert one(prompt_text(F.lit("plain"), F.lit(None).cast("string"), F.lit(3))) == "pla" and one(prompt_text(F.lit("plain"), F.lit("<p>x</p>"), F.lit(100))) == "<p>x</p>\nplain"
    assert one(move_sentence_up(names("A.", "B.", "C."), F.lit(1))) == ["A, B.", "C."] and one(move_sentence_up(names("A."), F.lit(0))) == ["A."]
    assert one(accent_all(F.lit("yes"))) == "ýéś"
    assert one(similar_char(F.lit("bank"), F.lit(1))) == "bɑnk" and one(similar_char(F.lit("BANK"), F.lit(1))) == "BANK" and len(SIMILAR) == 38
    assert spark.createDataFrame([(500,), (1500,), (None,)], "n int").agg(token_cost(F.col("n"), 0.25).alias("c")).first().c == 0.5


def test_structural_detector(spark):
    rows = [(float(k % 7), float(k), int(k > 30)) for k in range(60)]
    df = spark.createDataFrame(rows, "f_a double, f_b double, label int")
    model = X.structural_detector(["f_a", "f_b"]).fit(df)
    got = X.score(model, df, "tree")
    assert got.where("tree_class = label").count() == 60 and got.columns == ["f_a", "f_b", "label", "tree_score", "tree_class"]
    assert E.most_important(model.stages[-1], ["f_a", "f_b"], 1)[0][0] == "f_b"
