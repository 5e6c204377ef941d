import pytest
from pyspark.sql import functions as F

from veriloom.functions import domains as D
from veriloom.functions import headers as H
from veriloom.functions import text as T


@pytest.fixture
def value(spark):
    def get(column, **named):
        row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>").alias(k) for k, v in named.items()] or [F.lit(1).alias("one")])
        return row.select(column.alias("v")).first()[0]

    return get


@pytest.mark.parametrize(
    ("host", "want"),
    [("a.b.brand.co.uk", "brand.co.uk"), ("brand.com", "brand.com"), ("www.x.brand.de", "brand.de"), ("brand.unknownzone", None), ("com", None), ("co.uk", "co.uk"), ("..a..com.", "a.com"), ("", None), (None, None)],
)
def test_registrable(value, host, want, monkeypatch):
    assert value(D.registrable(F.lit(host).cast("string"))) == want
    monkeypatch.setattr(D, "PATTERN_SUFFIXES", 0)
    assert value(D.registrable(F.lit(host).cast("string"))) == want


def test_overlap_compares_names_not_suffixes(value):
    a, b = F.array(F.lit("brand.com")), F.array(F.lit("mail.brand.de"))
    assert value(D.domains_overlap(a, b)) is True
    assert value(D.domains_overlap(a, b, strict_suffix=True)) is False
    assert value(D.domains_overlap(a, F.array(F.lit("brand.nosuch")))) is False
    assert value(D.domains_overlap(a, F.array().cast("array<string>"))) is False


def test_hosts_and_roots(value):
    assert value(D.host_of(F.lit("https://User@WWW.Brand.example:8080/x?y#z"))) == "brand.example"
    assert value(D.host_of(F.lit("no url"))) is None
    assert value(D.site_root(F.lit("HTTP://www.Brand.example/a/b"))) == "http://brand.example/"
    assert value(D.site_roots(F.array(*map(F.lit, ["https://a.example/x", "https://a.example/y", "ftp://b.example/"])))) == ["https://a.example/"]
    assert value(D.visit_key(F.lit(" https://a.example/x#top "))) == "https://a.example/x"
    assert value(D.host_allowed(F.lit("mail.brand.example"), F.array(F.lit("brand.example.")))) is True
    assert value(D.host_allowed(F.lit("otherbrand.example"), F.array(F.lit("brand.example")))) is False
    assert value(D.host_suffixes(F.lit("a.b.c"))) == ["a.b.c", "b.c", "c"]


def test_emails(value):
    text = F.lit("Write to A@b.example, a@B.example; or c@d.test. and @handle.png @brand.example")
    assert value(D.emails_in(text)) == ["A@b.example", "a@B.example", "c@d.test"]
    assert value(D.clean_emails(D.emails_in(text))) == ["A@b.example", "c@d.test"]
    assert value(D.standalone_domains(text)) == ["postmaster@brand.example"]
    assert value(D.mailto_address(F.lit("mailto:info%40a.example?subject=Hi"))) == "info@a.example"
    assert value(D.mailto_address(F.lit("https://a.example"))) is None
    assert value(D.sender_key(F.lit("Me@Gmail.com"))) == "me@gmail.com"
    assert value(D.sender_key(F.lit("x@mail.brand.co.uk"))) == "brand.co.uk"
    assert value(D.strip_trailing_junk(F.lit(' a@b.example.>" '))) == "a@b.example"


def test_text_chain(value):
    assert value(T.shrink_urls(F.lit("see https://b.a.com/x?y and https://a.com/x"))) == "see https://b.a.com and https://a.com/x"
    assert value(T.cut_reply(F.lit("new\n-----Original Message-----\nold"))) == "new\n"
    assert value(T.clean_text(F.lit("a <b>bold</b>​  text...\x07"))) == "a bold text."
    assert value(T.chunk_words(F.lit("a b c d e"), 2, "Body:")) == ["a b", "Body: c d", "Body: e"]
    assert value(T.next_step_urls(F.lit("Please verify now. Go to it (https://a.example/x) soon. End"), F.array(F.lit("verify")))) == ["https://a.example/x"]
    assert value(T.match_case(F.lit("word"), F.lit("ABC"))) == "WORD"
    assert value(T.bad_word_count(F.lit("Click click here"), ["click"])) == 2
    assert value(T.word_stats(F.lit("")))["words"] == 0
    assert value(T.inject_css(F.lit("<html><head></head></html>"), "p{}")) == "<html><head><style>p{}</style></head></html>"
    assert value(T.inject_css(F.lit("<p>x</p>"), "p{}")) == "<style>p{}</style><p>x</p>"
    assert value(T.remove_images(F.lit("a<img src=x>b"))) == "ab"


def test_html():
    page = '<html><head><style>p{}</style></head><body><p>Hi&amp;bye <span style="display:none">hidden</span><a href="https://a.example/x">here</a></p></body></html>'
    assert T.html_to_text(page) == "Hi&bye here (https://a.example/x)"
    assert "hidden" not in T.sanitise(page)
    key = "5a"
    hexed = key + "".join(f"{b ^ 0x5A:02x}" for b in b"info@a.example")
    assert T.decode_cfemail(hexed) == "info@a.example"
    assert T.decode_cfemail("zz") is None
    assert T.page_emails(f'<a data-cfemail="{hexed}"></a><a href="mailto:Help@a.example?x">h</a> help@a.example') == ["info@a.example", "Help@a.example"]
    assert T.page_emails(None) == []
    assert T.unfragment_text("P a y P a l is") == "PayPal is"


def test_headers(value):
    raw = F.lit("Jane Doe <jane@a.example>")
    assert (value(H.sender_name(raw)), value(H.sender_address(raw))) == ("Jane Doe", "jane@a.example")
    raw = F.lit("jane@a.example (Jane)")
    assert (value(H.sender_name(raw)), value(H.sender_address(raw))) == ("Jane", "jane@a.example")
    assert H.decode_words("=?utf-8?q?Caf=C3=A9?=") == "Café"
    assert value(H.auth_status(F.lit("fail"), F.lit("pass"), F.lit("pass"))) == "fail"
    assert value(H.auth_status(F.lit(None).cast("string"), F.lit("pass"), F.lit("none"))) == "pass"
    assert value(H.auth_status(*[F.lit(None).cast("string")] * 3)) == "none"
    assert value(H.join_key(F.lit("mailroom/field/u/inbox/2.eml"))) == "inbox/2.eml"
    assert value(H.user_of_path(F.lit("mailroom/field/u/inbox/2.eml"))) == "u"
    assert value(H.is_reply_subject(F.lit("Software: x"))) is True
    assert value(H.is_reply_subject(F.lit("Software: x"), anchored=True)) is False
    for v, want in (("True", True), ("0", False), ("n/a", None)):
        assert value(H.tri_state(F.lit(v))) is want
    assert value(H.truthy(F.lit("0.7"))) is True
    assert value(H.truthy(F.lit("no"))) is False
