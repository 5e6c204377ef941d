import time

import pytest
from pyspark.sql import functions as F

from veriloom.functions import annotate as N
from veriloom.functions import filter_reports as R
from veriloom.functions import html_shrink as S
from veriloom.functions.registry import register
from veriloom.sources.exports import mail_text, materialise, write_files

PAGE = '<html><body><p style="x" id="a">One</p><div><span></span></div><p>Two <b>bold</b></p><p>Three</p><a href="https://a.example/averyverylongpath/x?query=longlonglong">l</a><script>x</script></body></html>'


def test_shrink_steps():
    assert "<script" not in S.drop_scripts(PAGE)
    assert 'style="x"' not in S.keep_attributes(PAGE) and 'id="a"' in S.keep_attributes(PAGE)
    assert "<span>" not in S.drop_textless(PAGE) and "One" in S.drop_textless(PAGE)
    assert "<b>" not in S.unwrap_emphasis(PAGE)
    assert S.shorten_url("https://a.example/averyverylongpath/x?query=longlonglong") == "https://a.example/averyveryl/x?query=long"
    smaller = S.remove_middle(S.drop_textless(PAGE))
    assert "One" in smaller and "</body>" in smaller and len(smaller) < len(PAGE)
    for n in (400, 250, 120, 30, 0):
        assert len(S.shrink(PAGE, n)) <= n or n >= len(PAGE)
    assert S.shrink("", 5) == ""


def test_tags():
    tokens, tags = N.tags("Oliswick Travel asks: verify now. Bye Oliswick Travel", [("Oliswick Travel", "identity"), ("verify now", "action")])
    assert tags[:2] == ["B-identity", "I-identity"] and tags[-2:] == ["B-identity", "I-identity"] and tags.count("B-action") == 1
    assert N.tags(None, []) == ([], [])


def test_annotations_native(spark):
    row = spark.createDataFrame([(["a", "b", "a", "b", "c"], ["a", "b"], [None, 0, 0, 1, None], [7, 8])], "t array<string>, w array<string>, ids array<int>, labels array<int>")
    got = row.select(N.places(F.col("t"), F.col("w")).alias("p"), N.first_subtoken_labels(F.col("ids"), F.col("labels")).alias("l")).first()
    assert got.p == [0, 2] and got.l == [-100, 7, -100, 8, -100]
    t = spark.createDataFrame([('```json\n{"a": 1}\n```',), ("no json",), (None,)], "t string")
    assert [r.v for r in t.select(N.fenced_json(F.col("t")).alias("v")).collect()] == ['{"a": 1}', None, None]
    tagged = spark.createDataFrame([("a b", ["a"], ["action"]), (None, None, None)], "t string, p array<string>, k array<string>").select(N.tag_annotations("t", "p", "k").alias("x")).collect()
    assert tagged[0].x.tags == ["B-action", "O"] and tagged[1].x.tags == []


def test_filter_reports(spark):
    report = "Metric: default; Spam: true\nScore: 7.50 / 15.00\nAction: add header\nSymbol: A_B (1.50)[x]\nSymbol: C (-0.50)\nSymbol: A_B (9)\nnoise"
    row = spark.createDataFrame([(report, "Yes, score=6.1 required=5.0 tests=X"), ("", "junk"), (None, None)], "r string, h string")
    got = row.select(R.symbols(F.col("r")).alias("s"), R.report_summary(F.col("r")).alias("m"), R.status_header(F.col("h")).alias("h")).collect()
    assert got[0].s == {"A_B": 1.5, "C": -0.5} and got[0].m.spam and got[0].m.score == 7.5 and got[0].m.required == 15.0
    assert got[0].h.spam and got[0].h.score == 6.1 and not got[1].h.spam and got[1].s == {}


def test_exports(spark, tmp_path):
    assert "\nEvil:" not in mail_text("a@b.example", None, "x\r\nEvil: y", None, "body")
    rows = spark.createDataFrame([("u", "f1", "a@b.example", "c@d.example", "s", None, "body", None), ("u", "f2", None, None, None, None, None, 5.0)], "user string, file string, sender string, receiver string, subject string, date string, body string, epoch double")
    out = materialise(rows).orderBy("join_key").collect()
    assert [(r.join_key, r.epoch) for r in out] == [("u/0.eml", 0.0), ("u/1.eml", 5.0)] and "body" in out[0].eml
    assert write_files(materialise(rows).withColumnRenamed("join_key", "file_name"), str(tmp_path)) == 2
    assert (tmp_path / "u" / "0.eml").read_text().startswith("From: a@b.example")
    with pytest.raises(Exception, match="leaves the folder"):
        write_files(spark.createDataFrame([("../x", "t")], "file_name string, eml string"), str(tmp_path / "in"))


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("select html_text('<p>a</p>') as t").first().t == "a"
    assert spark.sql("select cluster_strings(array('PayPal', 'PayPal Inc')) as c").first().c == [["PayPal", "PayPal Inc"]]
    rows = spark.sql("""select url, mailto from page_links('<a href="/x">x</a><a href="mailto:a@b.example">m</a>', 'https://a.example/')""").collect()
    assert {(r.url, r.mailto) for r in rows} == {("https://a.example/x", False), ("mailto:a@b.example", True)}
    assert [r.email for r in spark.sql("select email from html_emails('write a@b.example')").collect()] == ["a@b.example"]


def test_model_text_and_hooks(spark):
    from veriloom.functions.model_text import detector_words, label_headers, page_breaks
    from veriloom.operators.hooks import call, language, once_each, text_or_rendered

    t = spark.createDataFrame([("Don't click <http://a.example/x>!\n> old\nmail me@a.example now " + "x" * 40,), (None,)], "t string")
    assert t.select(detector_words(F.col("t")).alias("v")).first().v == "do not click <url> old mail <email> now"
    assert t.select(page_breaks(F.lit('<head>x</head>A<br>B<a href="u">c</a>')).alias("v")).first().v == "a\nb <url>"
    row = spark.createDataFrame([("a<b", "Oliswick", "s", ["oliswick"], True, "Brand")], "s string, r string, t string, i array<string>, b boolean, m string")
    got = row.select(label_headers("s", "r", "t", "i", "b", "m").alias("v")).first().v
    assert "a&lt;b" in got.sender and '<span class="identity">Oliswick</span>' in got.recipient
    seen = []

    def flaky(x):
        seen.append(x)
        if len(seen) < 3:
            raise OSError("later")
        return x.upper()

    assert call(flaky, "a", wait=0) == ("A", None) and call(lambda x: 1 / 0, "a", 2, 0)[0] is None
    d = spark.createDataFrame([("a",), ("a",), (None,)], "x string")
    assert sorted((r.x or "", r.y or "") for r in once_each(d, "x", str.upper, "y").collect()) == [("", ""), ("a", "A"), ("a", "A")]
    assert once_each(d, "x", None, "y").where("y = 'a'").count() == 2
    l = spark.createDataFrame([("the plan of the week is good",), ("der Plan ist nicht für heute",), ("",), (None,)], "x string")
    assert [r.v for r in l.select(language("x").alias("v")).collect()] == ["en", "de", "", ""]
    pages = spark.createDataFrame([("long enough text that is readable by itself", "<p>"), ("short", "<b>page</b>")], "t string, h string")
    assert sorted(r.readable for r in text_or_rendered(pages, "t", "h", lambda p: "rendered").collect()) == ["long enough text that is readable by itself", "rendered"]


def test_places_in_long_texts(spark):
    """A computed array of tokens is computed once for a row, not at every place; nulls and ends count as in a slice."""
    rows = [("the team " * 30_000 + "the", 0), ("a the team", 1), ("team the", 2), ("", 3), (None, 4)]
    df = spark.createDataFrame(rows, "text string, k int")
    began = time.monotonic()
    got = {r.k: r.p for r in df.select("k", N.places(F.split(F.lower("text"), " "), F.array(F.lit("the"), F.lit("team"))).alias("p")).collect()}
    assert time.monotonic() - began < 30
    assert got[0] == list(range(0, 60_000, 2)) and [got[k] for k in (1, 2, 3, 4)] == [[1], [], [], []]
    odd = spark.createDataFrame([([None, "a", None, "a"], [None, "a"]), (["a"], []), (["a"], None), ([], ["a"]), (["a"], ["a", "b"])], "t array<string>, w array<string>")
    assert [r.p for r in odd.select(N.places(F.col("t"), F.col("w")).alias("p")).collect()] == [[0, 2], [], [], [], []]
