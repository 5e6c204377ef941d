"""All queries of the core and their SQL."""

from __future__ import annotations

from veriloom.plans import fixture_queries, mail_queries, timestamp_queries

FLAGSHIP = "first_contact"


def all_queries() -> dict:
    return mail_queries.REGISTRY | fixture_queries.QUERIES | timestamp_queries.QUERIES


def all_oracle_sql() -> dict[str, str]:
    return dict(mail_queries.SQL)
