import pytest
from pyspark.sql import functions as F

from veriloom.operators import allow as A
from veriloom.operators import evaluate as E
from veriloom.operators import matching as M
from veriloom.operators import perturb as P
from veriloom.operators.expand import crawl, existing_domains, official_and_other
from veriloom.operators.recognise import default_recogniser, recognise
from veriloom.operators.verdict import claimed_identity, verdict


def arrays(spark, **named):
    return spark.range(1).select(*[F.array(*map(F.lit, v)).cast("array<string>").alias(k) for k, v in named.items()])


@pytest.mark.parametrize(
    ("i", "r", "a", "s", "t", "o", "b", "role", "want"),
    [
        ([], [], ["x"], [], [], [], [], None, (False, "No Prediction")),
        (["B"], [], ["x"], ["evil.com"], [], ["b.com"], ["B"], None, (True, "B")),
        (["B"], [], [], ["evil.com"], [], ["b.com"], ["B"], None, (False, "B")),
        (["B"], [], ["x"], ["b.de"], [], ["b.com"], ["B"], None, (False, "Consistent")),
        ([], ["admin"], ["x"], ["evil.com"], ["us.com"], [], [], "admin", (True, "Internal: admin")),
        ([], ["admin"], [], ["evil.com"], ["us.com"], [], [], "admin", (False, "Internal: admin")),
        ([], ["admin"], ["x"], ["us.com"], ["us.com"], [], [], "admin", (False, "Consistent: admin")),
        (["Z"], [], ["x"], ["evil.com"], ["us.com"], [], [], None, (False, "No Matched Brand")),
        (["Z"], ["admin"], ["x"], ["evil.com"], ["us.com"], [], ["Z"], "admin", (False, "No Matched Brand")),
    ],
)
def test_verdict(spark, i, r, a, s, t, o, b, role, want):
    row = arrays(spark, i=i, r=r, a=a, s=s, t=t, o=o, b=b)
    v = row.select(verdict(F.col("i"), F.col("r"), F.col("a"), F.col("s"), F.col("t"), F.col("o"), F.col("b"), F.lit(role).cast("string")).alias("v")).first().v
    assert (v.verdict, v.status) == want


def test_claimed_identity(spark):
    row = arrays(spark, m=["B", "A"], i=["x"], n=[])
    assert row.select(claimed_identity(F.col("m"), F.col("i")).alias("v")).first().v == "a b"
    assert row.select(claimed_identity(F.col("n"), F.col("i")).alias("v")).first().v == "x"


def test_first_contacts_and_running_totals_against_loops(spark):
    import random

    rnd = random.Random(1)
    rows = [(k, rnd.choice("ab") if rnd.random() < 0.9 else None, rnd.choice("xy"), rnd.random() < 0.4, rnd.random() < 0.2, rnd.randrange(50)) for k in range(400)]
    df = spark.createDataFrame(rows, "id int, user string, who string, flagged boolean, exempt boolean, t int")
    out = {r.id: r.action for r in A.first_contacts(df, ["user", "who"], ["t", "id"], F.col("flagged"), F.col("exempt")).collect()}
    seen, want = set(), {}
    for k, u, w, f, e, t in sorted(rows, key=lambda r: (r[5], r[0])):
        want[k] = "ok" if not f else "dmarc_exempt" if e else "whitelist_suppressed" if (u, w) in seen else "flag_first_contact"
        if f and not e:
            seen.add((u, w))
    assert out == want
    totals = {r.id: r.running_t for r in A.running_totals(df.select("id", "t"), ["t", "id"], ["t"], F.floor(F.col("t") / 10)).collect()}
    total = 0
    for k, *_, t in sorted(rows, key=lambda r: (r[5], r[0])):
        total += t
        assert totals[k] == total


def test_allow_mark_with_nulls(spark):
    mails = spark.createDataFrame([("u", "k", "t"), ("v", "k", "t"), (None, None, None), ("w", "g", "t")], "user string, sender_key string, claimed_identity string")
    allow = spark.createDataFrame([("u", "k", "t"), ("u", "k", "t"), (None, "g", "t")], "user string, sender_key string, target string")
    assert sorted((r.user or "", r.allowed) for r in A.mark_allowed(mails, allow).collect()) == [("", False), ("u", True), ("v", False), ("w", True)]


def test_evaluation(spark):
    d = spark.createDataFrame([("a", True, True, "x"), ("a", True, False, "y"), ("b", True, True, "x"), ("b", False, False, "ok"), ("a", True, True, "x")], "user string, static_fp boolean, adaptive_fp boolean, action string")
    r = E.rates(d).first()
    assert (r.mails, r.static_fpr, r.adaptive_fpr, r.alerts) == (5, 0.8, 0.6, 3)
    i = E.interactions(d, "user").first()
    assert (i.users, i.mean, i.upper_median, i.most) == (2, 1.5, 2, 2)
    assert E.interactions(d.where("false"), "user").first().users is None
    links = spark.createDataFrame([("m", 0, 0.5, "u1"), ("m", 1, 0.9, "u2"), ("m", 2, 0.9, "u3"), ("n", 0, None, "u4")], "id string, pos int, s double, url string")
    assert {r.id: r.url for r in E.best_per(links, "id", "s", "pos", ["url"]).collect()} == {"m": "u2", "n": "u4"}


@pytest.mark.parametrize("size", [M.BLOCK, 16])
def test_threshold_counts_all_neighbours(spark, tmp_path, monkeypatch, size):
    from veriloom.plans.mail_queries import nn_threshold

    monkeypatch.setattr(M, "BLOCK", size)
    rows = [(k, [1.0, 0.0] if k <= 60 else [0.0, -1.0 if k == 150 else 0.5]) for k in range(151)] + [(200, None)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert {tuple(r) for r in nn_threshold(spark, str(tmp_path)).collect()} == {(0, 60), (50, 60)}


def test_nearest_broadcast_equals_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    vecs = [(k, (v / np.linalg.norm(v)).tolist()) for k, v in enumerate(rng.normal(size=(120, 8)))]
    df = spark.createDataFrame([*vecs, (999, None)], "id long, v array<double>")
    base = df.withColumnRenamed("id", "b")
    want = {(r.id, r.b, r["rank"]) for r in M.nearest(df.where("id % 10 = 0"), "id", "v", base, "b", "v", 3, exclude_self=True).collect()}
    monkeypatch.setattr(M, "BROADCAST_BYTES", 1)
    monkeypatch.setattr(M, "BLOCK", 50)
    assert {(r.id, r.b, r["rank"]) for r in M.nearest(df.where("id % 10 = 0"), "id", "v", base, "b", "v", 3, exclude_self=True).collect()} == want
    m = np.array([v for _, v in vecs])
    brute = {(q, int(j), n) for q in range(0, 120, 10) for n, j in enumerate([j for j in np.argsort(-(m @ m[q]), kind="stable") if j != q][:3], 1)}
    assert want == brute


def test_names_and_clusters(spark):
    kb = spark.createDataFrame([("Perithholm Health", ["p.example"]), ("Oliswick Travel", ["o.example"])], "brand string, domains array<string>")
    names = spark.createDataFrame([("perithholm health",), ("Perithholm Heath",), ("unrelated",), (None,), ("",)], "n string")
    got = {r.name: r.tag for r in M.match_names(names, "n", kb, "brand", 0.6).collect()}
    assert got == {"perithholm health": "Perithholm Health", "Perithholm Heath": "Perithholm Health"}
    assert M.cluster_any(["PayPal", "PayPal Inc", "Bank"]) == [["PayPal", "PayPal Inc"], ["Bank"]]
    assert M.cluster_any([]) == []


def test_typos(spark):
    row = spark.createDataFrame([("Brand",)], "w string")
    got = row.select(*[P.typo(F.col("w"), k).alias(k) for k in P.TYPOS]).first().asDict()
    assert got["repeat"] == "Brrand" and got["delete"] == "Band" and got["switch"] == "Barnd" and got["insert"] == "B​rand"
    assert row.select(P.typo(F.lit("x"), "delete").alias("v")).first().v == "x"


def test_recogniser(spark):
    who, acts, roles = default_recogniser(frozenset({"oliswick travel"}))("Oliswick Travel asks. Please verify your account. The IT helpdesk is here.")
    assert who == ["Oliswick Travel"] and acts == ["Please verify your account"] and "it helpdesk" in roles
    assert default_recogniser()(None) == ([], [], [])
    df = spark.createDataFrame([(1, "Click here. See (https://a.example/x) now."), (2, None)], "id int, t string")
    assert {r.id: r.cta_urls for r in recognise(df, F.col("t"), []).collect()}[1] == ["https://a.example/x"]


def test_crawl_and_lookup(spark):
    web = {"https://a.example/": '<a href="/contact">c</a><a href="https://other.test/">o</a><a href="/x.png">i</a>', "https://a.example/contact": "mail to info@a.example", "https://other.test/": "no@other.test"}
    seeds = spark.createDataFrame([("https://a.example/#top",), ("https://a.example/",)], "url string")
    visited, emails = crawl(spark, seeds, ["a.example"], web.get)
    assert {(r.url, r.hop) for r in visited.collect()} == {("https://a.example/", 0), ("https://a.example/contact", 1)}
    assert [(r.email, r.url) for r in emails.collect()] == [("info@a.example", "https://a.example/contact")]
    alive = existing_domains(spark.createDataFrame([("x@a.example",), ("y@b.example",)], "email string"), lambda d: d == "a.example")
    assert [r.email for r in alive.collect()] == ["x@a.example"]
    with pytest.raises(ValueError):
        official_and_other(alive, [], [])


def test_features_on_empty_and_null(spark):
    from veriloom.operators.features import body_features, header_features, with_features

    df = spark.createDataFrame([([],), (None,)], "headers array<struct<name:string,value:string>>")
    out = with_features(df, header_features(F.col("headers"))).collect()
    assert out[0]["f_n_headers"] == 0.0
    t = spark.createDataFrame([(None, None, None, None), ("see http://1.2.3.4/x", "<form>", "Re: bank", "a@b.com")], "t string, h string, s string, f string")
    rows = with_features(t, body_features(*map(F.col, "thsf"))).collect()
    assert rows[1]["f_n_ip_hosts"] == 1.0 and rows[1]["f_n_forms"] == 1.0 and rows[0]["f_n_urls"] == 0.0


def test_stream_equals_batch(spark, tmp_path):
    from veriloom.streaming.mail_stream import first_contact_stream

    rows = [("u", "k", "t", f"{k:03d}", float(k)) for k in range(6)] + [("v", "k", "t", "100", 3.0)]
    schema = "user string, sender_key string, claimed_identity string, mail_id string, at double"
    for k, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = first_contact_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [r.action for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert got.count("flag_first_contact") == 2 and len(got) == 7


def test_identity_domains(spark):
    from veriloom.operators.expand import aligned_with_brand, allowed_domains, effective_cores, merged_domains, sitemap_candidates, validated_keeps

    t = lambda *rows: spark.createDataFrame([(r,) for r in rows] or [(None,)], "domain string")
    emails = spark.createDataFrame([("a@oliswick.example",), ("b@oliswick-mail.example",), ("c@other.example",), ("d@oliswick.gov",)], "email string")
    assert [r.domain for r in validated_keeps(t("OTHER.example.", "none.example"), emails).collect()] == ["OTHER.example."]
    seen = t("oliswick-mail.example", "other.example", "oliswick.gov", "olisvvick.example")
    assert sorted(r.domain for r in aligned_with_brand(seen, t("oliswick.example")).collect()) == ["olisvvick.example", "oliswick-mail.example"]
    got = effective_cores(t("oliswick.example"), t("none.example"), t("other.example", "unseen.example"), emails)
    assert sorted(r.domain for r in got.collect()) == ["oliswick-mail.example", "oliswick.example", "other.example"]
    assert aligned_with_brand(seen, t().where("false")).count() == 0
    assert merged_domains(t("A.example"), t("a.example.", "b.example")).count() == 2
    plans = spark.createDataFrame([("o", ["https://www.a.example/x"], ["B.example"])], "org string, urls array<string>, hints array<string>")
    assert sorted(r.domain for r in allowed_domains(plans, "org", "urls", "hints").collect()) == ["a.example", "b.example"]
    urls = spark.createDataFrame([("https://a.example/contact",), ("https://a.example/x/y.html",), ("https://b.example/contact",)], "url string")
    assert [r.url for r in sitemap_candidates(urls, ["a.example"], 1).collect()] == ["https://a.example/contact"]
