import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, counts string, times string, n string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from (doc_id, text, lang, source), with further columns that clash with names of the operators."""

    def make(rows):
        return spark.createDataFrame([(i, t, la, s, len(t or ""), "x", "y", "z") for i, t, la, s in rows], COLUMNS)

    return make
