import random

import pytest

from veriloom.llm import canonical_list
from veriloom.llm.canonical_list import Matcher, Trie, distance, learn_phrases, map_to_list, p4_found, p4_report, reference_entries

KB = [("Perithholm Health", ["perithholmhealth.example"]), ("Perithholm Pharma", ["perithholmpharma.example"]), ("Oliswick Travel", ["oliswicktravel.example", "oliswick-travel.test"]), ("Zelugard Media", []), ("Brovuden Media", []), ("Galevik Media", []), ("Oravik Travel", []), ("Dunavik Travel", []), ("Société Verawick", None), ("Société Kroadnes", None), ("Société Dalarholm", []), ("Yaringlin & Wilortkov", ["yaringlinandwilortkov.example"]), ("University of Stenoric", []), ("University of Thamoric", []), ("University of Noravfel", [])]


@pytest.fixture(scope="module")
def matcher():
    return Matcher([(n, d or []) for n, d in KB], learned=("via quickpost",))


def brute(a, b):
    """Optimal string alignment distance."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_against_brute_force():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 8))) for _ in range(120)]
    t = Trie()
    for w in set(words):
        t.add(w, w)
    for q in words[:30]:
        want = sorted({(brute(q, w), w) for w in words if brute(q, w) <= 2})
        assert sorted({(d, k) for d, k, _ in t.search(q, 2)}) == want
    assert distance("fo", "of") == 1 and distance("", "ab") == 2


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("PERITHHOLM_HEALTH", "Perithholm Health"), ("Perthholm aHealth", "Perithholm Health"), ("OliswickTravel GmbH", "Oliswick Travel"), ("oliswick-travel.test", "Oliswick Travel"), ("noreply@oliswicktravle.example", "Oliswick Travel"),
        ("Travel Oliswick via QuickPost", "Oliswick Travel"), ("Oliswick", "Oliswick Travel"), ("Perithholm", None), ("Perithholm Choir", None), ("Oliswick Bakery Ltd", None), ("Verawick", "Société Verawick"), ("Societe Verawick™", "Société Verawick"),
        ("Wilortkov", "Yaringlin & Wilortkov"), ("Yaringlin et Wilortkov S.A.", "Yaringlin & Wilortkov"), ("University fo Stenoric", "University of Stenoric"), ("['Zelugard Media']", "Zelugard Media"), ("Ｚｅｌｕｇａｒｄ Media", "Zelugard Media"),
        ("Z e l u g a r d   M e d i a", "Zelugard Media"), ("TheOliswickTravelTeam", "Oliswick Travel"), ("unknown", None), ("", None), (None, None), ("Support", None), ("x" * 5000, None),
    ],
)
def test_values(matcher, value, want):
    assert matcher.match(value)[1] == want


def test_query(spark, docs, schemas):
    d = docs(
        kb=([(n, v) for n, v in KB], "brand string, domains array<string>"),
        req2_llm_classified=([("f1", None, None, None, None, "Oliswick", 0)] * 2 + [("f2", None, None, None, None, "Oliswick Travel", 0), ("f3", None, None, None, None, None, 0)], schemas[1]),
        decision=([("k1", "perithholm pharma"), ("k1", "perithholm pharma"), ("k2", "nobody at all")], "join_key string, claimed_identity string"),
    )
    assert sorted(tuple(r) for r in p4_found(spark, d).collect()) == [("decision", "k1", "Perithholm Pharma"), ("req2_llm_classified", "f1", "Oliswick Travel")]
    assert sum(r.n for r in p4_report(spark, d).collect()) == 7
    with pytest.raises(ValueError):
        reference_entries(spark.read.parquet(f"{d}/kb.parquet"), "brand", "domains", 3)


BRANDS = [(f"{a} {b}", (f"{a.lower()}{b.lower()}.example",)) for a, b in zip("Velora Kestan Mirado Tolbert Sunvik Orlane Peskow Gradom Hulvane Ristel Bovane Cadmire".split(), "Bank Motors Foods Travel Energy Health Media Cloud Hotels Labs Retail Post".split(), strict=True)]


@pytest.mark.parametrize("carrier", ["quickpost", "zorvimel"])
def test_words_beside_many_names_are_learnt(spark, carrier):
    """What stands beside the names of many entries names nobody, whatever it is called; nothing of it is in the code."""
    said = [f"{n} via {carrier.title()}" for n, _ in BRANDS] + [f"{n.replace(' ', '')}via{carrier}" for n, _ in BRANDS] + [f"{n} via {carrier[:-2]}{carrier[-1]}{carrier[-2]}" for n, _ in BRANDS[:4]]
    other = ["Velora Bank Choir", "Kestan Motors Choir", "Velora Choir", "nobody at all", None, ""]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(said + other)], "k int, v string")
    learned = learn_phrases(df, "v", tuple(BRANDS))
    assert f"via {carrier}" in learned and "choir" not in learned
    got = {r.value: r.match for r in map_to_list(df, ["k"], "v", tuple(BRANDS)).collect()}
    assert [got[v] for v in said] == [n for n, _ in BRANDS] * 2 + [n for n, _ in BRANDS[:4]]
    assert got["Velora Choir"] is None and got["nobody at all"] is None
    assert learn_phrases(df.where("false"), "v", tuple(BRANDS)) == ()


def test_long_values_are_read_whole():
    m = Matcher([(n, list(d)) for n, d in BRANDS])
    assert m.match("the " * 3000 + "Velora Bank")[1] == "Velora Bank"
    assert m.match("Velora Bank " + "ltd " * 3000)[1] == "Velora Bank"
    assert m.match("word " * 3000)[0] == "none"
    assert m.phrases("x " * 3000) == set()


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(canonical_list, "MEMO", 50)
    m = Matcher([(n, list(d)) for n, d in BRANDS])
    for k in range(500):
        m.match(f"somewhere{k} else{k}")
    assert len(m.memo) <= 50 and len(m.closest) <= 51
