import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Make a documents table from (doc_id, text) or (doc_id, text, lang) rows, with a clashing extra column."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), 1) for r in rows]
        return spark.createDataFrame(full, DOC + ", node int")
    return make
