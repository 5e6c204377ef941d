"""Every query of this subpackage over tables without rows, and over rows of nulls."""

import pytest

from veriloom.llm.catalogue import QUERIES

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, subject string, user_name string, join_key string",
    "req2_llm_classified": "file string, from_name string, from_addr string, sender_domain string, is_personal_webmail boolean, subject string, claimed_organization string, from_address_is_official string, label int, reason string",
    "decision": "join_key string, user_name string, date_iso string, sender string, claimed_identity string, pred_phish boolean, action string, static_fp boolean, adaptive_fp boolean",
    "kb": "brand string, domains array<string>, vec array<float>",
    "mix_targets": "source string, target_share double, max_repeats int",
    "pack_targets": "run_name string, capacity_tokens int",
}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {}
    for kind in ("empty", "nulls"):
        d = tmp_path_factory.mktemp(kind)
        for name, schema in SCHEMAS.items():
            width = schema.count(",") + 1
            rows = [] if kind == "empty" else [tuple([None] * width)] * 3
            spark.createDataFrame(rows, schema).write.parquet(str(d / f"{name}.parquet"))
        out[kind] = str(d)
    return out


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_without_rows(spark, folders, name):
    rows = QUERIES[name](spark, folders["empty"]).collect()
    assert rows == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows_of_nulls(spark, folders, name):
    rows = QUERIES[name](spark, folders["nulls"]).collect()
    if name.endswith("_found"):
        assert rows == []
