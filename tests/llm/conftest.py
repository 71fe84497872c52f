import pytest
from brute import awkward

TEXT = "doc_id long, text string, lang string, source string, n_chars long, th string, key string, score string"


@pytest.fixture
def docs(spark):
    """Makes tables with clashing extra columns from (id, text) pairs."""

    def make(*rows):
        data = [(i, t, "en", None if i is None else f"s{i % 2}", len(t or ""), "x", None, "y") for i, t in rows]
        return spark.createDataFrame(data, TEXT)

    return make


@pytest.fixture
def odd(docs):
    return docs(*awkward())
