import random

import pytest

from veriloom.llm import email_parts
from veriloom.llm.email_parts import SuffixAutomaton, anchors, bare_subject, inherited_lines, new_text, not_new, p5_found, p5_reduced, p5_steps, p5_subjects, paragraphs
from veriloom.llm.pii import EDGES, Lexicon, Model, Node, Words, candidates, edges_of, fit, fit_on, infer, lexicon_of, lexicon_of_texts, names_shown, p6_found, p6_messages, p6_redacted, pieces, redact, send

MAIL = """Hi Ruth,

the plan is ready. I will be there in May.

Best regards,
Mark Rasorren
Legal Counsel
+1 (617) 555-0116

On Tue, Dec 14, 2021 at 00:13 May Kroortden
<may@letterbox.example> wrote:
> Dear Mark,
>
> please answer.

Sent from my phone"""


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (MAIL, [5, 6, 7, 8, 10, 11, 12, 13, 14, 16]),
        ("new\n\nFrom: A B <a@b.example>\nSent: 1 May 2020\nTo: C D\nSubject: x\n\nold text here", [3, 4, 5, 6, 8]),
        ("From: Monday on, the front desk opens at 9.\n\nNew text.", []),
        ("> 374 % growth is what they promised.", []),
        ("A B wrote on 2020-01-01:\n| old one\n\nanswer one\n\n| old two\n\nanswer two", [1, 2, 6]),
        ("Text.\n\n-----\n\nMore text follows here, and it is a sentence.", []),
        ("As the plan wrote: keep it short.\n\n-- and by that I mean this --\n\nBye for now, it is late already.", []),
        ("", []), (None, []), ("one line", []), ("> quoted\r\nnew\r\n", [1]),
    ],
)
def test_lines(text, want):
    assert not_new(text) == want


@pytest.mark.parametrize(
    ("subject", "want"),
    [("Re: x", (True, "x")), ("AW: WG: x", (True, "x")), ("[list] Re[2]: x", (True, "[list] x")), ("x [Fwd]", (True, "x")), ("x (was: y)", (True, "x")), ("[EXT] x", (False, "[EXT] x")), ("Reminder: x", (False, "Reminder: x")), ("AWS: x", (False, "AWS: x")), ("re:x", (True, "x")), (None, (False, None)), ("", (False, ""))],
)
def test_subjects(subject, want):
    assert bare_subject(subject) == want


def test_suffix_automaton_against_brute_force():
    rnd = random.Random(3)
    for _ in range(40):
        a, b, q = ([rnd.choice("abc") for _ in range(rnd.randrange(1, 25))] for _ in range(3))
        s = SuffixAutomaton()
        s.add(a)
        s.add(b)
        got = s.inherited(q, 3)
        grams = {tuple(x[k : k + 3]) for x in (a, b) for k in range(len(x) - 2)}
        want = [False] * len(q)
        for k in range(len(q) - 2):
            if tuple(q[k : k + 3]) in grams:
                want[k : k + 3] = [True] * 3
        assert got == want


def test_inheritance_ignores_wrapping():
    old = " ".join(f"word{k}" for k in range(60))
    new = "my own answer\n" + "\n".join(" ".join(old.split()[k : k + 7]) for k in range(0, 60, 7)) + "\nmy end"
    assert inherited_lines(new, [old]) == list(range(2, 11))
    assert inherited_lines(old, [old]) == []
    assert set(anchors(old.split())) & set(anchors(new.lower().split()))


def test_p5(spark, docs, document, schemas):
    old = " ".join(f"word{k}" for k in range(80))
    rows = [document(1, old, "plan"), document(2, "I answer\n\n" + old + "\n\nthis", "Re: plan"), document(3, old, "plan"), document(4, None), document(5, "x\n> y", "")]
    d = docs(documents=(rows, schemas[0]), req2_llm_classified=([("f", None, None, None, "Re: a", None, 0)] * 2 + [("g", None, None, None, None, None, 0)], schemas[1]))
    got = sorted(tuple(r) for r in p5_found(spark, d).collect())
    assert got == [("documents", "2", 3), ("documents", "5", 2), ("req2_llm_classified", "f", 0)]


def test_p5_sources(spark, docs, document, schemas):
    w = [f"word{k}" for k in range(200)]
    run = lambda a, b: " ".join(w[a:b])
    rows = [
        document(1, run(0, 150), "plan"), document(2, "I agree\n\n" + run(20, 70) + "\n\nthat was all of it", "Re: plan"),  # a short reply to a long mail
        document(3, run(115, 140) + " and nothing else", "trip"), document(4, "my " * 30 + "\n" + run(80, 150) + "\nend", "trip"), document(5, "so\n" + run(100, 145) + "\n" + "well " * 90, "trip"),
        *(document(10 + k, f"short {k} " + run(100 + k, 126 + k), "walk") for k in range(0, 20)), document(40, run(100, 145), "walk"), document(41, "mine\n" + run(100, 145) + "\nand more of mine", "walk"),
    ]
    got = {tuple(r) for r in p5_found(spark, docs(documents=(rows, schemas[0]), req2_llm_classified=([], schemas[1]))).collect()}
    assert got == {("documents", "2", 3), ("documents", "5", 2), ("documents", "41", 2)}


def thread_rows(document, n=12):
    """A thread in which quoted text bears no mark at all, and a notice in words that no list has."""
    rnd = random.Random(11)
    notice = "Printed on recycled electrons, handled with due care by the department of harmless phrases."
    said = [" ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(900)}" for _ in range(45 + 3 * k)) for k in range(n)]  # of mails that are alike otherwise, the shorter is the earlier
    rows = [document(k, (f"my answer {k} to that\n\n" if k else "") + said[k] + ("\n\n" + said[k - 1] if k else "") + "\n\n" + notice, "Re: plan" if k else "plan") for k in range(n)]
    return rows, said, notice


@pytest.mark.parametrize("size", [64, 1])
def test_what_form_alone_does_not_find(spark, docs, document, schemas, monkeypatch, size):
    monkeypatch.setattr(email_parts, "SOURCES", size)
    monkeypatch.setattr(email_parts, "REPLIES", size)
    rows, said, notice = thread_rows(document)
    d = docs(documents=([*rows, document(90, None, None), document(91, "", "x")], schemas[0]), req2_llm_classified=([("f", None, None, None, "Re: a", None, 0), ("g", None, None, None, None, None, 0)], schemas[1]))
    told = {r.step: r for r in p5_steps(spark, d).collect()}
    assert "form" not in told and told["ending"].lines == 12 and told["inherited"].lines == 12 and told["inherited"].alone == 11
    texts = {r.rec_key: r for r in p5_reduced(spark, d).collect()}
    assert texts["0"].new_text == said[0] and texts["5"].new_text == f"my answer 5 to that\n\n{said[5]}" and texts["5"].bare_subject == "plan"
    assert texts["90"].new_text is None and texts["91"].new_text == "" and len(texts) == 14
    assert {tuple(r) for r in p5_subjects(spark, d).collect()} == {("f", "Re: a", "a", True), ("g", None, None, False)}


def test_paragraphs_and_new_text():
    assert [x[1:] for x in paragraphs("a b\nc\n\n> d\n> e\n>\n> f\n\ng")] == [(True, 1, 2), (False, 4, 5), (True, 7, 7), (True, 9, 9)]
    assert paragraphs("A  b") [0][0] == paragraphs("> a\n> B")[0][0] and paragraphs("") == []
    assert new_text("a\n\n> b\n\nc\n\n\nd", {3}) == "a\n\nc\n\n\nd" and new_text(None, {1}) is None and new_text("x", {1}) == ""


FIRST = "Peter Anna Dean Zora Ylva Colin Frieda Tomas Ines Olga Bruno Mark Ruth May".split()
LAST = "Galavlow Rasorren Kroortden Talithgard Quistad Brovane Dunelin Stenholm Verimar Oldane".split()


def made_mails(n, seed=7):
    """Mails that name people in headers, greetings and closings, and other things in runs of capitals."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        a, b = rnd.choice(FIRST), rnd.choice(LAST)
        c, d = rnd.choice(FIRST), rnd.choice(LAST)
        phone = f"+1 (617) 555-01{rnd.randrange(10, 99)}"
        out.append(
            f"Hi {c},\n\nI spoke with {rnd.choice(FIRST)} {rnd.choice(LAST)} <x@b.example> on {rnd.randrange(1, 28)} May, and Silver {rnd.choice(['Harbor Motors', 'Lake Payments'])} is closed. "
            f"The Site {rnd.choice(['Lead', 'Office'])} has order no. {rnd.randrange(10**7, 10**8)}. May I ask you for passport no. {rnd.randrange(10**7, 10**8)}K?\n\nBest regards,\n{a} {b}\nTel. {phone}\n\n"
            f"From: {c} {d} <{c.lower()}@b.example>\nTo: {a} {b} <y@b.example>\n\nDear {a},\n\nsee you in 12 Mill Road, Oldtown.\n\n{c}"
        )
    return out


@pytest.fixture(scope="module")
def model():
    return fit([MAIL] * 5 + made_mails(120))


def test_pieces(model):
    got = {(n.kind, n.piece) for n in pieces(MAIL, model)}
    assert got == {("person", "Ruth"), ("person", "Mark Rasorren"), ("person", "May Kroortden"), ("email", "may@letterbox.example"), ("phone", "+1 (617) 555-0116"), ("person", "Mark")}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Tax number QQ 89 16 30 B was rejected.", {("id_number", "QQ 89 16 30 B")}),
        ("The form asks for an ID; mine is 02 209 443 756.", {("id_number", "02 209 443 756")}),
        ("Order no. 2024/81855 and part ZK533596070027.", set()),
        ("My new address is 82 Copperfield Drive, Apt 32, Kesterton.", {("address", "82 Copperfield Drive, Apt 32, Kesterton")}),
        ("Meine neue Anschrift lautet Gerberstraße 33, 89453 Neuwexbach.", {("address", "Gerberstraße 33, 89453 Neuwexbach")}),
        ("Write to anna17 at inkwell dot co dot test please", {("email", "anna17 at inkwell dot co dot test")}),
        ("I spoke with Talithgard, Dean and they left.", {("person", "Talithgard, Dean")}),
        ("We meet on 12 May, and I will mark the plan.", set()),
        ("As Toristric said, University of Thamoric is closed.", set()),
        ("Dr. Р​eter Galavlow signed the form", {("person", "Р​eter Galavlow")}),
        ("", set()), (None, set()),
    ],
)
def test_kinds(model, text, want):
    assert {(n.kind, n.piece) for n in pieces(text, model)} == want


@pytest.mark.parametrize("word", ["rue", "Rue", "RUE", "rUE", "Chemin", "PLACE", "Impasse", "Allée", "ALLÉE", "Quai", "Route", "Square", "Cours", "Passage", "Sentier", "Villa", "Bd", "Avenue", "BOULEVARD"])
@pytest.mark.parametrize("number", ["12", "12,", "12 bis", "12 Ter,"])
def test_french_streets_in_any_case(model, word, number):
    address = f"{number} {word} Lafayette, 75009 Paris"
    assert [(n.kind, n.piece) for n in pieces(f"{address}.", model)] == [("address", address)]


def test_redaction(model):
    assert redact("Call Mark Rasorren on 020 7946 0183.", model) == "Call [PERSON] on [PHONE]."
    assert redact(None, model) is None


def test_p6(spark, docs, document, schemas):
    d = docs(documents=([document(1, MAIL), document(2, None), document(3, "Hi Ruth,\nhi Ruth")], schemas[0]), req2_llm_classified=([("f", "Ruth Rasotal (r@b.example)", None, None, None, None, 0)] * 2 + [("g", "Support", None, None, None, None, 0)], schemas[1]))
    rows = [tuple(r) for r in p6_found(spark, d).collect()]
    assert len(rows) == len(set(rows))
    assert {r for r in rows if r[0] != "documents"} == {("req2_llm_classified", "f", "person", "Ruth Rasotal"), ("req2_llm_classified", "f", "email", "r@b.example")}


def test_lexicon_is_of_all_texts(spark):
    shown = ["From: Zora Quist <z@b.example>\n\nThe plan is ready.", "x " * 3000 + "\nFrom: Zora Quist <z@b.example>\n", "From: Ylva Quist <y@b.example>"]
    for others in (0, 300):
        df = spark.createDataFrame([*enumerate(shown), *((k + 3, f"The plan {k} is ready at Silver Motors.") for k in range(others)), (-1, None)], "k int, text string")
        model = fit_on(df, "text", "k", most=5)
        assert "Zora" in model.given and "Ylva" not in model.given and ("Motors" in model.words.others) == (others > 0)
    texts = made_mails(60)
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    assert lexicon_of(df, "text") == lexicon_of_texts(texts)


@pytest.mark.parametrize("most", [1, 200_000])
def test_lexicon_does_not_depend_on_size(spark, monkeypatch, most):
    """A word that comes often enough is kept however many runs there are; packed words give the answers of a set."""
    monkeypatch.setattr("veriloom.llm.pii.MOST_OTHERS", most)
    texts = ["The plan is ready at Silver Motors."] * 5 + [f"Bronze Harbour {x} and Golden Harbour {x}." for x in "abcdefgh"] * 20 + made_mails(40)
    got = lexicon_of(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "text")
    want = lexicon_of_texts(texts)
    assert {"Silver", "Motors", "Golden"} <= set(got.others) and got == want and (type(got.others) is Words) == (most == 1)
    assert {n.piece for t in made_mails(5) for n in pieces(t, fit(texts, got))} == {n.piece for t in made_mails(5) for n in pieces(t, fit(texts, want))}
    packed = Words(["b", "ä", "a", "b", ""])
    assert packed == {"", "a", "b", "ä"} and len(packed) == 4 and "c" not in packed and "zz" not in packed and None not in packed and "ä" in packed and "x" not in Words([])


def test_names_that_no_other_text_shows(model):
    """A doubtful mention follows the sure one of the same name: only the messages make it a piece."""
    text = "Dear Ayesha,\n\nthe plan is ready, and Ayesha will know.\n\nThanks"
    plain = Model(Lexicon(), {"p:bias": -1.0, "p:greeting": 3.0}, dict.fromkeys(EDGES, 0.0) | {"equal": 2.5})
    nodes = candidates(text, plain)[0]
    assert infer([nodes], plain) == 1
    assert [(n.piece, n.belief > 0) for n in nodes] == [("Ayesha", True)] * 2 and nodes[1].score < 0
    assert redact("Please call Priya Quistad on 020 7946 0183.", model) == "Please call [PERSON] on [PHONE]."


def test_a_third_of_the_names_unknown():
    texts = made_mails(200)
    words = lexicon_of_texts(texts)
    full = fit(texts, words)
    less = fit(texts, Lexicon(words.given - {"Peter", "Zora", "Olga", "Bruno", "Dean"}, words.others, words.surnames))
    held = made_mails(60, seed=8)
    want = [{n.piece for n in pieces(t, full) if n.kind == "person"} for t in held]
    got = [{n.piece for n in pieces(t, less) if n.kind == "person"} for t in held]
    assert sum(len(w & g) for w, g in zip(want, got, strict=True)) >= 0.9 * sum(map(len, want))
    assert all(v >= 0 for v in full.edges.values()) and full.edges["equal"] > 0


def test_messages_against_brute_force():
    import itertools
    import math

    import numpy as np

    score, edges, strength = np.array([0.4, -0.3, 1.1, -0.8]), np.array([[0, 1], [1, 2], [1, 3]]), np.array([0.9, 0.5, 1.3])
    total = np.zeros((4, 2))
    for labels in itertools.product((0, 1), repeat=4):
        weight = math.exp(sum(s for s, y in zip(score, labels) if y) + sum(j * (labels[a] == labels[b]) for (a, b), j in zip(edges, strength)))
        for k, y in enumerate(labels):
            total[k, y] += weight
    assert np.allclose(send(score, edges, strength, rounds=200), np.log(total[:, 1] / total[:, 0]), atol=0.02)


def test_edges():
    node = lambda kind, line, key, surname="": Node(kind, line, 0, 1, key, [], surname=surname)
    nodes = [node("person", 0, "p:clara", "rasor"), node("phone", 0, "t:1"), node("person", 1, "p:clarra"), node("person", 2, "p:peter", "rasor"), node("person", 3, "p:clara"), node("person", 4, "p:markus")]
    assert sorted(edges_of(nodes)) == [(0, 1, 1), (0, 2, 3), (0, 3, 3), (0, 4, 2), (2, 4, 3)]
    assert infer([], Model()) == 0 and list(Model().edges) == list(EDGES)


def test_p6_outputs(spark, docs, document, schemas):
    d = docs(documents=([document(k, t) for k, t in enumerate(made_mails(60), 1)] + [document(99, None)], schemas[0]), req2_llm_classified=([("f", "Ruth Rasorren", None, None, None, None, 0), ("g", None, None, None, None, None, 0)], schemas[1]))
    rows = {(r.src_table, r.rec_key): r.redacted for r in p6_redacted(spark, d).collect()}
    assert rows["req2_llm_classified", "f"] == "[PERSON]" and rows["req2_llm_classified", "g"] is None and rows["documents", "99"] is None
    assert "[PERSON]" in rows["documents", "1"] and len(rows) == 63
    told = {r.kind: r for r in p6_messages(spark, d).collect()}
    assert told["person"].nodes >= told["person"].pieces > 0 and told["phone"].pieces == 60


def test_names_shown():
    assert names_shown("\n\n > From: Zora Quist <z@b.example>\n| Ylva Quist wrote on 1 May\n\nHi Xenia,\n") == {"Zora", "Ylva", "Xenia"}
    assert names_shown("\n> " * 200_000 + "De : x") == set()


def test_plain_lines_meet_no_patterns(monkeypatch):
    """Lines that show neither a colon at hand nor a rule, quote mark or address are settled without the long patterns."""
    from veriloom.llm import email_parts as E

    class Never:
        def match(self, text, *_):
            raise AssertionError(text)

    for name in ("_FROM", "_SEPARATOR", "_RULE", "_INTRO", "_INTRO_START", "_INTRO_END", "_PREFIX"):
        monkeypatch.setattr(E, name, Never())
    assert E.not_new("The plan is ready\nOn 3 May we meet at 10.\n\nIt is a > b here, <b>bold</b> and fine") == []
