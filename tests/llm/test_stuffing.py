import random
from collections import Counter

import numpy as np
import pyarrow as pa

from veriloom.llm import stuffing
from veriloom.llm.stuffing import _hashes, count_pairs, p9_found, p9_rules, p9_scores, verdict, words_of

SPAM = "best cheap watches garage doors sale cheap watches top garage doors hot cheap watches garage doors. " * 4
TAGS = "#casinobonus #slimtea #casinobonus #usedtyres #slimtea #casinobonus #webhosting #slimtea #usedtyres #casinobonus"
LINKS = "\n".join(f"garage doors - http://{h}.example/x" for h in "abcdefghij")
HONEST = "The plan for the week is ready, and we will look at it when you are back from the trip to the coast. "
SUBJECTS, VERBS, OBJECTS = "the old team|my good friend|our new office|a small shop|the whole group|every other member".split("|"), "has sent back|will look at|could not find|asked me for|pays a lot for|did not like".split("|"), "the long report|his first plan|their last order|the red folder|some more tea|all of the keys".split("|")


def sentences(rnd, n):
    return " ".join(f"{rnd.choice(SUBJECTS)} {rnd.choice(VERBS)} {rnd.choice(OBJECTS)}." for _ in range(n))


def test_counts_against_brute_force():
    rnd = random.Random(1)
    texts = [[rnd.choice("abcdef") for _ in range(rnd.randrange(0, 40))] for _ in range(30)]
    h, ends = _hashes(pa.array(["".join(" " + w for w in t) for t in texts]))
    pair, w1, w2, adjacent, near = count_pairs(h, np.repeat(np.arange(len(texts)), np.diff(ends)))
    name = {int(_hashes(pa.array([" " + w]))[0][0]): w for w in "abcdef"}
    got = {(name[int(a)], name[int(b)]): (int(n), int(m)) for a, b, n, m in zip(w1, w2, adjacent, near, strict=True)}
    adj, nr = Counter(), Counter()
    for t in texts:
        own = set(zip(t, t[1:]))
        adj.update(zip(t, t[1:]))
        for k in range(2, 7):
            for x, y in zip(t, t[k:]):
                nr.update({(x, y)} & own)
                nr.update({(y, x)} & own if x != y else [])
    assert got == {p: (n, nr[p]) for p, n in adj.items()}


def test_words():
    assert words_of("See https://a.example/x, #tag X-12 7 don't") == (" see \x01l \x01t \x01c don't", b"\x01" * 5)
    assert words_of("電車、 a/b") == (" 電 車 a b", b"\x02\x02\x02\x02")
    assert words_of(None) == words_of("") == ("", b"")
    assert verdict(np.empty(0, np.int64), np.empty(0)) == (0.0, 0.0, 0.0)


def rows(document):
    rnd = random.Random(2)
    plain = [document(100 + k, sentences(rnd, rnd.randrange(3, 20))) for k in range(300)]
    bag = sentences(rnd, 400).replace(".", "").split()
    rnd.shuffle(bag)
    half = " ".join(bag[:60])
    made = [SPAM, HONEST * 3, None, "", "One real sentence is here for you. " + SPAM, TAGS, sentences(rnd, 9) + "\n* price list\n* staff rota", LINKS, " ".join(bag), half + " " + sentences(rnd, 12), "Zażółć gęślą jaźń, proszę państwa bardzo uprzejmie dzisiaj wieczorem.", SPAM.title(), "cheap watches"]
    return plain + [document(k, t) for k, t in enumerate(made, 1)]


def test_p9(spark, docs, document, schemas, monkeypatch):
    d = docs(documents=(rows(document), schemas[0]))
    got = sorted(r[0] for r in p9_found(spark, d).collect())
    assert got == [1, 5, 6, 8, 9, 12]
    told = {r.doc_id: r for r in p9_scores(spark, d).collect()}
    assert len(told) == 313 and told[3].n_words == 0 and told[9].salad_share > 0.5 > told[1].salad_share
    assert {r.rule: r.n for r in p9_rules(spark, d).collect()} == {"word salad": 1, "repeated collocations": 5}
    monkeypatch.setattr(stuffing, "HOT", 3)  # nearly all pairs and words meet their counts in joins
    again = {r.doc_id: r for r in p9_scores(spark, d).collect()}
    assert again == told


def test_one_text_and_repeated_keys(spark):
    df = spark.createDataFrame([(1, SPAM), (1, SPAM), (1, HONEST), (None, TAGS)], "k int, text string")
    assert sorted((r.k or 0, r.stuffed) for r in stuffing.stuffed(spark, df, "k", "text").collect()) == [(0, True), (1, False), (1, True), (1, True)]
