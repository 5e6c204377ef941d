"""Schemas of messages, recognitions, results and imports."""

from __future__ import annotations

RAW_MAIL = "path string, modificationTime timestamp, length bigint, content binary"
AUTH = "struct<dmarc:string,spf:string,dkim:string,dkim_domain:string,spf_domain:string,auth_domain:string>"
MESSAGE = (
    "path string, msg_id string, sender_name string, sender_address string, to_names array<string>, to_addresses array<string>, reply_to string, subject string, "
    "body_text string, body_html string, headers array<struct<name:string,value:string>>, date_ts timestamp, date_iso string, n_parts int, parse_error string"
)
RECOGNITION = "path string, identities array<string>, actions array<string>, relations array<string>, cta_urls array<string>, seconds double"
RESULT = (
    "path string, sender_name string, sender_address string, to_addresses array<string>, subject string, identities array<string>, actions array<string>, relations array<string>, "
    "cta_urls array<string>, verdict boolean, status string, matched array<string>, seconds double"
)
ALLOW = "user string, sender_key string, target string"
ADDIN = "subject string, sender struct<displayName:string,emailAddress:string>, to array<struct<displayName:string,emailAddress:string>>, cc array<struct<displayName:string,emailAddress:string>>, bcc array<struct<displayName:string,emailAddress:string>>, body string, attachments array<struct<name:string,content:string>>"
