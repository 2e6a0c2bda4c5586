import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes documents of (doc_id, text[, lang[, source]])."""

    def make(*rows):
        out = [(r[0], r[1], *(r[2:] or ("en",)), *(() if len(r) > 3 else ("s",)), None) for r in rows]
        return spark.createDataFrame(out, DOCS)

    return make
