import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Build a documents table from (doc_id, text) rows."""

    def make(rows):
        full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return make
