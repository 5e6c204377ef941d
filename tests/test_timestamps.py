from datetime import datetime, timezone

import pytest

from veriloom.operators.timestamps import STATED, em, native_instants, normalise_timestamps, read

W = em({}, STATED)


def at(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp())


@pytest.mark.parametrize(
    ("text", "zone", "want"),
    [
        ("2019-03-01T01:00:22+01:00", None, at(2019, 3, 1, 0, 0, 22)),
        ("  2019-03-01T00:36:37+00:00 ", None, at(2019, 3, 1, 0, 36, 37)),
        ("2019-03-01T20:39+05:30", None, at(2019, 3, 1, 15, 9)),
        ("20190301T085523Z", None, at(2019, 3, 1, 8, 55, 23)),
        ("Sun, 10 Mar 2019 15:07:56 -0000", None, at(2019, 3, 10, 15, 7, 56)),
        ("03-Mar-19 18:12:14 GMT", None, at(2019, 3, 3, 18, 12, 14)),
        ("Mar 10, 2019 12:44:45 AM UTC", None, at(2019, 3, 10, 0, 44, 45)),
        ("Tue, 12 Mar 2019 04:44:15 EDT", None, at(2019, 3, 12, 8, 44, 15)),
        ("2019-03-01 00:13:03 America/New_York", None, at(2019, 3, 1, 5, 13, 3)),
        ("2019-03-01T19:44:19-05:00[America/New_York]", None, at(2019, 3, 2, 0, 44, 19)),
        ("11. April 2019, 00:38", "Europe/Berlin", at(2019, 4, 10, 22, 38)),
        ("18 de mayo de 2019 13:33", "UTC", at(2019, 5, 18, 13, 33)),
        ("Fri Mar  1 07:27:40 2019", "America/New_York", at(2019, 3, 1, 12, 27, 40)),
        ("03/04/2019 02:14 PM", "UTC", at(2019, 3, 4, 14, 14)),
        ("03.04.2019 02:14:05", "UTC", at(2019, 4, 3, 2, 14, 5)),
        ("1551612888.749745", None, 1551612888),
        ("1551552308741", None, 1551552308),
        ("1551505317948386", None, 1551505317),
        ("1551505317948386123", None, 1551505317),
    ],
)
def test_instants(text, zone, want):
    assert read(text, zone, W)[:2] == (want, "ok")


@pytest.mark.parametrize(
    ("text", "zone", "status"),
    [
        (None, None, "missing"), ("", None, "missing"), ("nan", None, "no_time"), ("x" * 5000, None, "no_time"), ("2019-03-03", None, "date_only"),
        ("2022-13-05T08:00:00Z", None, "impossible"), ("31/31/2021 25:61", "UTC", "impossible"), ("25/12/2021 10:00", "UTC", "impossible"),
        ("2019-03-25T16:43:11", None, "no_zone"), ("2021-03-28 02:39:04", "Europe/Berlin", "local_never"), ("2023-10-29 02:29:59", "Europe/Berlin", "local_twice"),
        ("2019-02-29 10:00:00", "UTC", "impossible"), ("2019-03-01 10:00:00 XYZ", "UTC", "no_zone"),
    ],
)
def test_no_instant(text, zone, status):
    assert read(text, zone, W)[:2] == (None, status)


def test_em_learns_the_order_of_a_source_and_marks_the_rest():
    w = em({"dash": {"10": 40, "11": 30}}, {})
    assert w["dash:dmy"] > 0.95
    assert read("03-04-2019 10:00", "UTC", w)[0] == at(2019, 4, 3, 10)
    assert read("03-04-2019 10:00", "UTC", em({}, {}))[1] == "ambiguous"
    assert read("03-03-2019 10:00", "UTC", em({}, {}))[1] == "ok"


def test_operator_per_source(spark):
    rows = [("a", "25-12-2020 10:00", "UTC")] * 30 + [("a", "03-04-2020 10:00", "UTC"), ("b", "12-25-2020 10:00", "UTC"), (None, None, None)] + [("b", "04-13-2020 10:00", "UTC")] * 30 + [("b", "03-04-2020 10:00", None)]
    df = spark.createDataFrame(rows, "source string, v string, zone string").withColumnRenamed("zone", "z")
    out = normalise_timestamps(df, "v", "source", "z")
    assert out.count() == len(rows)
    got = {r.source: r for r in out.where("v = '03-04-2020 10:00'").collect()}
    assert got["a"].instant_s == at(2020, 4, 3, 10)
    assert got["b"].instant_status == "no_zone"
    assert normalise_timestamps(df.where("false"), "v", "source", "z").count() == 0


def test_p3_against_brute_force(spark, tmp_path):
    from veriloom.plans.timestamp_queries import p3_found

    mail = [("u/1", "2020-01-01T00:00:00Z"), ("u/1", "2020-01-01T00:00:00+00:00"), ("u/2", "2020-01-01T00:00:00Z"), ("u/3", "bad"), ("v/4", "2020-01-01 10:00:00"), (None, "2020-01-01T00:00:00Z")]
    decided = [("u/1", "1577836859"), ("u/2", "1577836860"), ("u/3", "1577836860"), ("v/4", "2020-01-01T10:00:00Z"), ("w/9", None)]
    spark.createDataFrame(mail, "join_key string, date_iso string").write.parquet(str(tmp_path / "mail_meta.parquet"))
    spark.createDataFrame(decided, "join_key string, date_iso string").write.parquet(str(tmp_path / "decision.parquet"))
    spark.createDataFrame([("u", None), ("v", "Europe/Berlin")], "user_name string, tz_name string").write.parquet(str(tmp_path / "mailbox.parquet"))
    assert sorted(r[0] for r in p3_found(spark, str(tmp_path)).collect()) == ["u/2", "v/4"]


def test_native_reading_is_the_same(spark):
    """What native expressions read is what the formats say, and all else is left to them."""
    texts = [
        "2019-03-01T01:00:22+01:00", "2019-03-01 01:00:22.999-0530", "2019-03-01T01:00Z", "2024-02-29T23:59:59Z", "2023-02-29T00:00:00Z", "2022-13-05T08:00:00Z", "2022-00-05T08:00:00Z", "2022-01-00T08:00:00Z",
        "2022-01-01T24:00:00Z", "2022-01-01T10:60:00Z", "2022-01-01T10:00:60Z", "2022-01-01T10:00:00+14:00", "2022-01-01T10:00:00+14:01", "2022-01-01T10:00:00-05:60", "0001-01-01T00:00:00Z", "0000-01-01T00:00:00Z",
        "9999-12-31T23:59:59-14:00", "1969-12-31T23:59:59Z", "1551612888.749745", "1551612888", "999999999", "1551552308741", "99999999", "20190301101112", "-5", "1551505317948386", "2019-03-01T01:00:22+01:00[Europe/Berlin]",
        " 2019-03-01T00:36:37+00:00 ", "٢٠١٩-03-01T00:36:37Z", "", None, "x" * 100_000, "2019-03-01" + " " * 50_000 + "x", "03/04/2019 02:14 PM",
    ]
    df = spark.createDataFrame([(k, t, "s", "UTC") for k, t in enumerate(texts)], "k int, v string, source string, z string")
    got = {r.k: (r.instant_s, r.instant_status) for r in normalise_timestamps(df, "v", "source", "z", STATED).collect()}
    assert got == {k: read(t, "UTC", W)[:2] for k, t in enumerate(texts)}
    assert native_instants(df, "v")[0].count() == 18


def test_instants_of_a_made_mail_stream(spark, tmp_path):
    """Dashed dates have no stated order: each mailbox's own values say it, and where they don't, the value is marked."""
    from veriloom.plans.timestamp_queries import p3_instants, p3_status_counts

    mail = [(f"a/{k}", f"{13 + k % 15}-04-2020 10:00") for k in range(40)] + [(f"b/{k}", f"04-{13 + k % 15}-2020 10:00") for k in range(40)] + [(f"{u}/x", "03-04-2020 10:00") for u in "abc"] + [("c/y", "04-04-2020 10:00"), ("c/z", None)]
    spark.createDataFrame(mail, "join_key string, date_iso string").write.parquet(str(tmp_path / "mail_meta.parquet"))
    spark.createDataFrame([("a/0", "2020-01-01T10:00:00Z")], "join_key string, date_iso string").write.parquet(str(tmp_path / "decision.parquet"))
    spark.createDataFrame([(u, "UTC") for u in "abc"] + [("a", None)], "user_name string, tz_name string").write.parquet(str(tmp_path / "mailbox.parquet"))
    got = {(r.side, r.join_key): r for r in p3_instants(spark, str(tmp_path)).collect()}
    assert len(got) == len(mail) + 1
    assert got["mail", "a/x"].instant_s == at(2020, 4, 3, 10) and got["mail", "b/x"].instant_s == at(2020, 3, 4, 10)
    assert got["mail", "a/x"].instant_posterior > 0.9 and got["mail", "c/x"].instant_status == "ambiguous" and got["mail", "c/x"].instant_posterior == 0.5
    assert got["mail", "c/y"].instant_s == at(2020, 4, 4, 10) and got["mail", "c/z"].instant_status == "missing"
    counts = {(r.side, r.instant_status): r.n for r in p3_status_counts(spark, str(tmp_path)).collect()}
    assert counts["mail", "ambiguous"] == 1 and counts["mail", "ok"] == 83
