import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veriloom.llm import packing
from veriloom.llm.mixing import Mixture, invert, schedules
from veriloom.llm.packing import best_fit, p7_containers, pack
from veriloom.llm.token_sizes import count_tokens


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(50, 80))
def test_best_fit_is_valid_and_within_the_known_bound(sizes, capacity):
    boxes = best_fit(sizes, capacity)
    fill = {}
    for s, b in zip(sizes, boxes, strict=True):
        fill[b] = fill.get(b, 0) + s
    assert all(f <= capacity for f in fill.values())
    lower = -(-sum(sizes) // capacity)
    assert len(fill) <= 11 / 9 * max(lower, 1) + 4


def test_pack_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 50)
    rnd = random.Random(4)
    sizes = [(k, rnd.choice([0, 1, 7, 30, 64, 100, 130, 200, 333])) for k in range(900)] + [(9999, None)]
    df = spark.createDataFrame(sizes, "id long, n long")
    runs = spark.createDataFrame([("a", 100), ("b", 256), ("c", None)], "run_name string, capacity_tokens int")
    rows = pack(spark, df, "id", "n", runs).collect()
    for run, capacity in (("a", 100), ("b", 256)):
        mine = [r for r in rows if r.run_name == run]
        total, fill = {}, {}
        for r in mine:
            total[r.id] = total.get(r.id, 0) + r.piece_tokens
            fill[r.container] = fill.get(r.container, 0) + r.piece_tokens
        assert total == {k: n or 0 for k, n in sizes}
        assert len({(r.id, r.piece_no) for r in mine}) == len(mine)
        assert all(f <= capacity for f in fill.values())
        used = sum(fill.values())
        boxes = sum(1 for f in fill.values() if f)
        whole = best_fit([s % capacity or capacity for _, s in sizes if s], capacity)
        full = sum((s - (s % capacity or capacity)) // capacity for _, s in sizes if s)
        assert used == sum(n or 0 for _, n in sizes) and boxes <= 1.04 * (len(set(whole)) + full) + 3
        assert all(n == 1 for k, n in ((r.id, sum(1 for x in mine if x.id == r.id)) for r in mine[:50]) if (dict(sizes)[k] or 0) <= capacity)
    assert pack(spark, df.where("false"), "id", "n", runs).count() == 0
    with pytest.raises(ValueError):
        pack(spark, df, "id", "n", spark.createDataFrame([("a", 0)], "run_name string, capacity_tokens int"))


def test_items_that_never_fill_a_container(spark, monkeypatch):
    """Nothing can be joined: no container goes up the tree, and no group is larger than GROUP."""
    monkeypatch.setattr(packing, "GROUP", 100)
    seen = []
    real = packing._dealt
    monkeypatch.setattr(packing, "_dealt", lambda items, counts, number: seen.append((number, max(r["count"] for r in real(items, counts, number).groupBy("run_name", "grp").count().collect()))) or real(items, counts, number))
    df = spark.createDataFrame([(k, 60 + k % 3) for k in range(1000)], "id long, n long")
    rows = pack(spark, df, "id", "n", spark.createDataFrame([("a", 100)], "run_name string, capacity_tokens int")).collect()
    assert len({r.container for r in rows}) == len(rows) == 1000 and len(seen) == 1 and seen[0][1] <= 100
    seen.clear()
    rnd = random.Random(9)
    df = spark.createDataFrame([(k, rnd.choice([20, 35, 51, 67])) for k in range(3000)], "id long, n long")
    rows = pack(spark, df, "id", "n", spark.createDataFrame([("a", 100)], "run_name string, capacity_tokens int")).collect()
    assert len(rows) == 3000 and len({r.id for r in rows}) == 3000 and len(seen) > 1 and all(n <= 100 for _, n in seen)


def test_long_texts_are_counted_as_a_whole(monkeypatch):
    from veriloom.llm import token_sizes

    rnd = random.Random(2)
    text = "".join(rnd.choice(["word", "don't", " ", "  ", "\n", " \n", "12", "é", "!?", " x", "\t"]) for _ in range(4000))
    want = count_tokens(text)
    for size in (1, 7, 50, 999):
        monkeypatch.setattr(token_sizes, "STRETCH", size)
        assert count_tokens(text) == want
    assert count_tokens("a" * 3000) == count_tokens("a" * 3000 + "")


def test_tokens_and_query(spark, docs, document, schemas):
    assert count_tokens(None) == 0 and count_tokens("") == 0 and count_tokens("Hello world") == 2
    d = docs(documents=([document(1, "word " * 700), document(2, None), document(3, "hi")], schemas[0]), pack_targets=([("s", 256)], "run_name string, capacity_tokens int"))
    rows = p7_containers(spark, d).collect()
    assert {(r.doc_id, r.piece_tokens) for r in rows} >= {(1, 256), (2, 0), (3, 1)} and sum(r.piece_tokens for r in rows if r.doc_id == 1) == count_tokens("word " * 700)


def test_schedules():
    targets = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 8)}
    w = schedules(targets)
    for k in range(3):
        assert abs(sum(x[k] for x in w.values()) - 1) < 1e-12
    for s, (share, _) in targets.items():
        assert abs((w[s][0] + 2 * w[s][1] + w[s][2]) / 4 - share) < 1e-12
    assert w["c"][2] > w["c"][0]


def test_invert(spark):
    from pyspark.sql import functions as F

    w = [0.1, 0.2, 0.4]
    for t in (0.0, 0.2, 0.5, 0.8, 1.0):
        area = 0.1 * t + 0.1 * t * t if t <= 0.5 else 0.075 + 0.2 * (t - 0.5) + 0.2 * (t - 0.5) ** 2
        got = spark.range(1).select(invert(F.lit(area), w).alias("v")).first().v
        assert abs(got - t) < 1e-9


def test_mixture(spark):
    rnd = random.Random(5)
    rows = [(k, "big", rnd.randrange(50, 150)) for k in range(600)] + [(1000 + k, "small", 40) for k in range(30)] + [(2000, "big", 0), (2001, None, 10), (2002, "other", 10), (2003, "big", None)]
    docs = spark.createDataFrame(rows, "key long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("none", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    m = Mixture(spark, docs, targets)
    counts = {r.key: r.times_taken for r in m.counts().collect()}
    assert len(counts) == len(rows) and all(counts[1000 + k] <= 3 for k in range(30)) and counts[2000] == counts[2002] == 0
    shares = {r.source: r for r in m.shares().collect()}
    assert abs(shares["small"].actual_share - 1 / 3) < 0.02 and shares["none"].status == "no document with tokens"
    order = m.curriculum().collect()
    assert len(order) == sum(counts.values()) and [r.position for r in order] == sorted(r.position for r in order)
    late = sum(r.n_tokens for r in order if r.source == "small" and r.position > 0.5)
    assert late > sum(r.n_tokens for r in order if r.source == "small" and r.position <= 0.5)
    assert Mixture(spark, docs.where("false"), targets).counts().count() == 0
    own = Mixture(spark, docs, targets, schedule={"big": [2.0, 1.0, 0.0], "small": [0.0, 0.0, 4.0]})
    order = own.curriculum().collect()
    small = [r.position for r in order if r.source == "small"]
    assert small and min(small) >= 0.5 and abs(sum(r.n_tokens for r in order if r.source == "small") / sum(r.n_tokens for r in order) - 0.5) < 0.05
    assert sum(r.position < 0.5 for r in order if r.source == "big") > sum(r.position > 0.5 for r in order if r.source == "big")
    with pytest.raises(ValueError):
        Mixture(spark, docs, targets, schedule={"big": [1.0]})
