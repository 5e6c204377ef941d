"""Messages to verdicts, numbering without large groups, and the smaller operators."""

import random
import time

import pytest
from pyspark.sql import functions as F

from veriloom.functions import domains as D
from veriloom.functions.headers import MORE_MARKS, is_reply_subject, listed_headers
from veriloom.functions.text import next_step_urls
from veriloom.operators import evaluate as E
from veriloom.operators.allow import numbered
from veriloom.operators.detect import ALLOWED_SENDER, RELAXED, REPLY, Mode, decide, leading
from veriloom.operators.matching import cluster_any, cluster_close
from veriloom.sources.mail import sample_bodies, split_concatenated_json

MAIL = "path string, sender_name string, sender_address string, to_addresses array<string>, reply_to string, subject string, body_text string"
KB = [("Velora Bank", ["velorabank.example"]), ("Kestan Motors", ["kestanmotors.example", "kestan.test"]), ("Abc", ["abc.example"])]


def mail(path, body, sender="a@letterbox.example", to=("me@home.example",), reply=None, subject="hello", name="Someone"):
    return (path, name, sender, list(to), reply, subject, body)


def test_every_way_to_a_verdict(spark):
    kb = spark.createDataFrame(KB, "brand string, domains array<string>")
    rows = [
        mail("false-sender", "Velora Bank has blocked your account. Please click the link below."),
        mail("no-request", "Velora Bank wishes you well."),
        mail("right-sender", "Velora Bank has news. Please click here.", "info@mail.velorabank.example"),
        mail("false-link", "Velora Bank has news. Please verify it. See (https://www.elsewhere.test/x)", "x@unrelated.test"),
        mail("reply", "Velora Bank. Please click.", subject="RE: account"),
        mail("reply-zh", "Velora Bank. Please click.", subject="回复: account"),
        mail("allowed", "Velora Bank. Please click.", "x@friends.example"),
        mail("role", "This is the it helpdesk. Please click the link."),
        mail("role-inside", "This is the it helpdesk. Please click the link.", "it@home.example"),
        mail("role-no-request", "This is the it helpdesk."),
        mail("nothing", "see you tomorrow"),
        mail("unknown", "The Wonder team greets you. Please click."),
        mail("short-first", "Abc and Velora Bank. Please click.", "x@abc.example"),
        ("nulls", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows + rows[:2], MAIL)
    got = {r.path: (r.verdict, r.status) for r in decide(df, kb, allowed=["friends.example"], suffixes=D.RESERVED).collect()}
    assert got == {
        "false-sender": (True, "Velora Bank"), "no-request": (False, "Velora Bank"), "right-sender": (False, "Consistent"), "false-link": (True, "Velora Bank"), "reply": (False, REPLY), "reply-zh": (False, REPLY),
        "allowed": (False, ALLOWED_SENDER), "role": (True, "Internal: it helpdesk"), "role-inside": (False, "Consistent: it helpdesk"), "role-no-request": (False, "Internal: it helpdesk"), "nothing": (False, "No Prediction"),
        "unknown": (False, "No Matched Brand"), "short-first": (False, "Consistent"), "nulls": (False, "No Prediction"),
    }
    strict = decide(df, kb, mode=Mode(check_action=False), suffixes=D.RESERVED).where("path = 'no-request'").first()
    assert strict.verdict and strict.matched == ["Velora Bank"]
    assert decide(df.where("false"), kb, suffixes=D.RESERVED).count() == 0
    two = spark.createDataFrame([mail("two", "Nobody Known and Kestan Motors write. Please click.")], MAIL)
    said = lambda text: (["Nobody Known", "Kestan Motors"], ["Please click."], [])
    assert decide(two, kb, suffixes=D.RESERVED, recogniser=said).first().status == "No Matched Brand"
    assert decide(two, kb, mode=RELAXED, suffixes=D.RESERVED, recogniser=said).first().status == "Kestan Motors"


def test_leading_identities():
    assert leading(["Abc", "Velora Bank", "Velora", "Kestan"]) == ["Abc", "Velora Bank", "Velora"]
    assert leading(["Velora Bank", "Kestan"]) == ["Velora Bank"] and leading([]) == [] and leading(["a.b", "c"]) == ["a.b", "c"]


@pytest.mark.parametrize("most", [None, 7])
def test_numbers_within_groups(spark, most):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), k * 7919 % 10007, "clash") for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int, _n string")
    got = {(r.g, r.k): r.seq for r in numbered(df.repartition(6), ["g"], ["k"], "seq", most).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for n, k in enumerate(sorted(r[1] for r in rows if r[0] == g)):
            if most is None or n < most:
                want[g, k] = n
    assert got == want
    assert numbered(df.where("false"), ["g"], ["k"], "seq", most).count() == 0


def test_small_operators(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(is_reply_subject(F.lit("AW: x"))) is False and one(is_reply_subject(F.lit("AW: x"), marks=MORE_MARKS)) is True
    assert one(listed_headers(F.array(F.lit("X-Spam-Level"), F.lit("Received")), ["x-spam"])) == ["X-Spam-Level"] and one(listed_headers(F.array(F.lit("A")), [])) == []
    assert one(D.rejects_grants(F.lit("bigGrants.org"), F.lit("Velora"))) is True and one(D.rejects_grants(F.lit("biggrants.org"), F.lit("Grant Fund"))) is False
    assert one(D.link_priority(F.lit("https://a.example/kontakt/x?help"))) == 2 * 2 + 1 and one(D.link_priority(F.lit("https://contact.example"))) == 0
    assert one(split_concatenated_json(F.lit('{"a": "x} {y"} {"b": 1}\n[2]'))) == ['{"a": "x} {y"}', '{"b": 1}', "[2]"] and one(split_concatenated_json(F.lit('{"a"'))) == ['{"a"'] and one(split_concatenated_json(F.lit(""))) == []
    assert cluster_close(["Velora Bank", "Kestan", "Velora Bamk", "Velora Bank"]) == [["Velora Bank", "Velora Bank"], ["Kestan"], ["Velora Bamk"]]
    df = spark.createDataFrame([("a", 0.9, True, None), ("a", 0.5, True, True), ("b", 0.8, False, True)], "kind string, s double, x boolean, y boolean")
    assert {r.kind: r.rate for r in E.match_rates(df, "kind", F.col("s")).collect()} == {"a": 0.5, "b": 1.0}
    assert {r.kind: (r.n, r.rate_before, r.rate_after) for r in E.before_after(df, "kind", F.col("x"), F.col("y")).collect()} == {"a": (2, 1.0, 0.5), "b": (1, 0.0, 1.0)}
    assert tuple(E.report_rate(df, F.col("y"), F.col("s")).first()) == (2 / 3, 0.8) and [tuple(r) for r in E.top_tags(df, "kind", 1).collect()] == [("a", 2)]
    bodies = spark.createDataFrame([(k, "word " * (k % 20)) for k in range(100)] + [(None, None)], "k int, body string")
    first = [r.k for r in sample_bodies(bodies, "body", "k", 8, seed=4).collect()]
    assert len(first) == 8 == len(set(first)) and all(k % 20 >= 10 for k in first) and first == [r.k for r in sample_bodies(bodies.repartition(5), "body", "k", 8, seed=4).collect()]


def test_checkpoint_folder_must_be_shared_on_a_cluster(monkeypatch):
    from veriloom import session

    class Context:
        master = "spark://somewhere:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

        def getConf(self):
            return {}

    fake = type("Spark", (), {"sparkContext": Context(), "conf": {}})()
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(fake)


def test_cells_find_what_is_near(spark, monkeypatch):
    import numpy as np

    from veriloom.operators import matching as M

    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(30, 24))
    vectors = [centres[rnd.integers(30)] + 0.25 * rnd.normal(size=24) for _ in range(1200)] + [centres[0]] * 600  # a third of all alike
    rows = [(k, [float(x) for x in v / np.linalg.norm(v)]) for k, v in enumerate(vectors)] + [(9999, None)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    base = df.withColumnRenamed("id", "b")
    asked = df.where("id % 50 = 0 or id = 9999")
    exact = M.nearest(asked, "id", "v", base, "b", "v", 5, exclude_self=True)
    whole = {(r.id, r.b, r["rank"]) for r in exact.collect()}
    for block in (M.BLOCK, 100):
        monkeypatch.setattr(M, "BLOCK", block)
        found = M.nearest_by_cells(asked, "id", "v", base, "b", "v", 5, exclude_self=True, sample=500)
        assert M.recall(found, exact, "id", "b").first().recall >= 0.9
    every = M.nearest_by_cells(asked, "id", "v", base, "b", "v", 5, exclude_self=True, probes=10_000)
    assert {(r.id, r.b, r["rank"]) for r in every.collect()} == whole
    assert M.nearest_by_cells(asked, "id", "v", base.where("false"), "b", "v").count() == 0 and M.nearest_by_cells(asked.where("false"), "id", "v", base, "b", "v").count() == 0
    assert M.recall(exact.where("false"), exact.where("false"), "id", "b").first().recall is None


def test_messages_are_read_once(spark, tmp_path):
    """A verdict takes one pass over the messages, however often matching and joins need what was recognised in them."""
    log = str(tmp_path / "asked")

    def said(text):
        with open(log, "a") as f:
            f.write(text.split("Body: ")[1] + "\n")
        return ["Kestan Motors"], ["Please click."], ["admin"]

    kb = spark.createDataFrame(KB, "brand string, domains array<string>")
    df = spark.createDataFrame([*(mail(f"m{k}", f"body {k}") for k in range(9)), mail("gated", "not read", subject="RE: x")], MAIL)
    got = {r.path: r.status for r in decide(df, kb, suffixes=D.RESERVED, recogniser=said).collect()}
    assert got == {"gated": REPLY} | {f"m{k}": "Kestan Motors" for k in range(9)}
    with open(log) as f:
        assert sorted(f.read().split("\n")) == ["", *(f"body {k}" for k in range(9))]


def test_clusters_end_with_the_last_one_wanted():
    names = ["Abc", "Velora Bank", "Kestan Motors", "abc ltd", "Velora", "Kestan"]
    assert cluster_any(names) == [["Abc", "abc ltd"], ["Velora Bank", "Velora"], ["Kestan Motors", "Kestan"]]
    assert cluster_any(names, last=lambda s: len(s) > 3) == [["Abc", "abc ltd"], ["Velora Bank", "Velora"]]


def test_next_step_urls_of_long_texts(spark):
    text = "Please click now. Go (https://a.example/x) here. " * 10_000
    began = time.monotonic()
    row = spark.createDataFrame([(text, ["click now", "Go (https"]), ("click. (http://b.example)", None)], "t string, a array<string>").select(next_step_urls(F.col("t"), F.col("a")).alias("u")).collect()
    assert [r.u for r in row] == [["https://a.example/x"], []] and time.monotonic() - began < 30
