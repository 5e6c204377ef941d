import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veriloom.llm.mojibake import repair
from veriloom.llm.queries_text import p1_found, p1_normalised, p2_found, p2_repaired
from veriloom.llm.unicode_forms import canonical, is_case, normalise_text, tidy


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Ｌａｂｓ", "Labs"), ("ﬁnd", "find"), ("𝗕𝗮𝗻𝗸", "Bank"), ("café", "café"), ("a​b", "ab"), ("a b", "a b"), ("Ѕuррort", "Support"),
        ("пoкa", "пока"), ("drɑft", "draft"), ("　x", " x"), ("T­r", "Tr"),
    ],
)
def test_cases(text, want):
    assert is_case(text) and tidy(text) == want


@pytest.mark.parametrize("text", [None, "", "plain", "naïve café", "Привет, SMS-код", "👩‍💻 👍🏽", "½ 2º €5 5 µm ™ №", "「会議」。", "“quoted” – it’s…", "Ångström", "Москва", "Ωmega" if False else "10 kΩ"])
def test_no_cases(text):
    assert not is_case(text) and tidy(text) == text


def test_forms_compare_equal():
    assert canonical("Ｃａｆé​  SHOP") == canonical("café shop") == "café shop"
    assert canonical(None) is None and canonical("") == ""
    assert canonical("STRASSE") == canonical("Straße")


@pytest.mark.parametrize(
    ("wrong", "right"),
    [
        ("CafÃ© â€“ Itâ€™s", "Café – It’s"), ("CafГ©", "Café"), ("Caf├⌐", "Café"), ("Reuni√≥n", "Reunión"), ("Ã¢â‚¬Å“xÃ¢â‚¬Â\x9d", "“x”"), ("PrŽcisions sur le dŽlai", "Précisions sur le délai"),
        ("Reзu de X", "Reçu de X"), ("Rⁿckfrage", "Rückfrage"), ("Ïîæàëóéñòà, ïðîâåðüòå", "Пожалуйста, проверьте"), ("рПДФЧЕТДЙФЕ", "Подтвердите"),
        ("mixed café and CafÃ©", "mixed café and Café"),
    ],
)
def test_repair(wrong, right):
    assert repair(wrong) == (True, right)


@pytest.mark.parametrize("text", [None, "", "plain", "ATENÇÃO: A REUNIÃO", "Größe, déjà vu, ¿Qué?", "├── data\n│   └── old", "√87 ≤ 90 °C", "Привет, мир", "請求書の確認", "l’été – d’accord", "Ѕuррort"])
def test_sound_texts(text):
    assert repair(text) == (False, text)


def test_losses_are_found():
    assert repair("Caf�")[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["größer", "Übergabe", "café", "réunion", "informação", "Señor", "año", "naïve", "fête", "São"]), min_size=1, max_size=6), st.sampled_from(["cp1252", "cp437", "mac-roman", "cp1251"]))
def test_round_trip_of_utf8_read_wrongly(words, wrong):
    right = " ".join(words)
    try:
        text = right.encode().decode(wrong)
    except UnicodeDecodeError:
        return
    assert repair(text) == (True, right)


def test_queries(spark, docs, document, schemas):
    d = docs(
        documents=([document(1, "a​b"), document(2, "CafÃ© ​", "ok"), document(3, None, "Reзu de X"), document(4, ""), document(5, "plain " * 20000)], schemas[0]),
        req2_llm_classified=([("f1", "Ѕuррort", None, None, "CafÃ©", None, 0)] * 2 + [("f2", None, None, None, None, None, 0), (None, "Ｘ", None, None, None, None, 0)], schemas[1]),
    )
    assert sorted((r.src_table, r.rec_key or "") for r in p1_found(spark, d).collect()) == [("documents", "1"), ("req2_llm_classified", ""), ("req2_llm_classified", "f1")]
    assert sorted(tuple(r) for r in p2_found(spark, d).collect()) == [("documents", "2", "text"), ("documents", "3", "subject"), ("req2_llm_classified", "f1", "subject")]
    out = normalise_text(spark.read.parquet(f"{d}/req2_llm_classified.parquet").withColumnRenamed("subject", "text_key"), "from_name")
    assert out.count() == 4 and out.where("from_name is null and text_key is not null").count() == 0


SENTENCES = [
    "Bitte prüfen Sie die Unterlagen für das nächste Gespräch, der Zug hatte Verspätung.", "Könnten Sie uns bis Dienstag die Größe der Lieferung bestätigen?", "Le reçu manque, et la pièce n'est pas arrivée à l'hôtel.",
    "La réunion a été déplacée après notre échange.", "Mañana llamaré a la oficina para saber quién se ocupa del diseño.", "A informação não está na mensagem, amanhã há outra reunião.",
    "Пожалуйста, проверьте документы до конца недели.", "Поезд опоздал, и я пропустил начало доклада.", "会議は来週に変更されました。資料を確認してください。", "請求書はまだ届いていません。ご連絡をお待ちしております。",
]


def test_how_much_is_restored():
    """Held-out sentences read under a wrong encoding: nearly all are found, and most of them come back letter by letter."""
    from veriloom.llm.mojibake import CYRILLIC_PAIRS, JAPANESE_PAIRS, LATIN_PAIRS

    found = restored = n = 0
    utf8 = [("utf-8", w) for w in ("cp1252", "latin-1", "mac-roman", "cp437", "cp850", "cp1251")]
    for s in SENTENCES:
        own = CYRILLIC_PAIRS if "а" in s else JAPANESE_PAIRS if "。" in s else LATIN_PAIRS
        for true, wrong in [*utf8, *own]:
            try:
                text = s.encode(true).decode(wrong)
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if text == s:
                continue
            n += 1
            damaged, got = repair(text)
            found += damaged
            restored += got == s
    print(n, found / n, restored / n)
    assert n > 120 and found >= 0.95 * n and restored >= 0.8 * n


def test_outputs_of_all_fields(spark, docs, document, schemas):
    d = docs(
        documents=([document(1, "a​b"), document(2, "CafÃ©", "ok"), document(3, None, None), document(4, "")], schemas[0]),
        req2_llm_classified=([("f1", "Ѕuррort", None, None, "CafÃ©", None, 0)] * 2 + [("f2", None, None, None, None, None, 0)], schemas[1]),
    )
    rows = {(r.src_table, r.rec_key): (r.text_tidy, r.text_key) for r in p1_normalised(spark, d).collect()}
    assert rows["documents", "1"] == ("ab", "ab") and rows["documents", "3"] == (None, None) and rows["documents", "4"] == ("", "") and rows["req2_llm_classified", "f1"] == ("Support", "support")
    assert p1_normalised(spark, d).count() == 7
    assert sorted(tuple(r) for r in p2_repaired(spark, d).collect()) == [("documents", "2", "text", "Café")] + [("req2_llm_classified", "f1", "subject", "Café")] * 2
