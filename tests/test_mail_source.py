import mailbox
from email.message import EmailMessage

import pytest

from veriloom.sources.mail import parse_bytes, read_mail, resolve_input, split_mbox


def message(k, html=False):
    m = EmailMessage()
    m["From"], m["To"], m["Subject"] = f"Sender {k} <s{k}@a.example>", "r@b.example", f"Mail {k}"
    m["Date"] = "Fri, 01 Mar 2024 10:00:00 +0100"
    m.set_content(f"body {k}\nFrom here on it goes")
    if html:
        m.add_alternative(f"<p>body {k}</p>", subtype="html")
    return m


def test_parse():
    r = parse_bytes("p", message(1, True).as_bytes())
    assert (r["sender_name"], r["sender_address"], r["to_addresses"], r["subject"]) == ("Sender 1", "s1@a.example", ["r@b.example"], "Mail 1")
    assert r["body_text"].startswith("body 1") and "<p>" in r["body_html"] and r["date_ts"].hour == 9 and r["parse_error"] is None
    assert parse_bytes("p", b"")["parse_error"] == "no header"
    assert parse_bytes("p", None)["parse_error"] == "no header"
    assert parse_bytes("p", b"Subject: =?nosuch?q?x?=\n\nb")["body_text"] == "b"


def test_folder_with_mailbox(spark, tmp_path):
    (tmp_path / "one.EML").write_bytes(message(0).as_bytes())
    box = mailbox.mbox(str(tmp_path / "box.mbox"))
    for k in (1, 2, 3):
        box.add(message(k))
    box.flush()
    rows = read_mail(spark, str(tmp_path)).select("path", "subject", "body_text").collect()
    assert sorted(r.subject for r in rows) == ["Mail 0", "Mail 1", "Mail 2", "Mail 3"]
    assert all("From here on" in r.body_text for r in rows)
    assert len(split_mbox(b"")) == 0


def test_kinds(tmp_path):
    (tmp_path / "x.csv").write_text("a")
    with pytest.raises(ValueError):
        resolve_input(str(tmp_path / "x.csv"))
    with pytest.raises(FileNotFoundError):
        resolve_input(str(tmp_path / "none.eml"))
    (tmp_path / "y.eml").write_text("a")
    assert resolve_input(str(tmp_path)) == [".eml"]
