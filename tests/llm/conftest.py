import pytest


@pytest.fixture()
def docs_of(spark):
    """Rows (doc_id, text) -> a documents frame with the other columns too."""

    def make(rows):
        full = [(d, t, "en", "src", len(t or "")) for d, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)

    return make
