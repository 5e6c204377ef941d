"""All queries of this subpackage and their SQL, where SQL can say them."""

from __future__ import annotations

from veriloom.llm import canonical_list, email_parts, mixing, packing, pii, queries_text, stuffing

QUERIES = queries_text.QUERIES | canonical_list.QUERIES | email_parts.QUERIES | pii.QUERIES | packing.QUERIES | mixing.QUERIES | stuffing.QUERIES
ORACLE_SQL: dict[str, str] = {}
