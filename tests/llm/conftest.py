import pytest


@pytest.fixture(scope="session")
def table(spark):
    """Make a documents table with all of its columns from (id, text) pairs, or (id, text, lang, source)."""

    def make(rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "s")), None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return make
