import pytest


@pytest.fixture
def docs(spark, tmp_path):
    """Writes small tables into a data folder: docs(documents=[...], ...) -> folder."""

    def make(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return make


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, subject string, user_name string, join_key string, rec_key string"
REQ = "file string, from_name string, from_addr string, sender_domain string, subject string, claimed_organization string, label int"


@pytest.fixture
def document():
    return lambda k, text, subject=None, source="a", user="u": (k, text, "en", source, len(text or ""), subject, user, None, "clash")


@pytest.fixture
def schemas():
    return DOCS, REQ
