import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text) rows, with columns that clash with the operators' own."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), 0.5, "x") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string")

    return make
