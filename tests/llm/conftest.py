import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tag string"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with an extra column; texts by position, ids from 0 unless given as pairs."""

    def make(texts):
        rows = [(i, t) if not isinstance(t, tuple) else t for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "s", len(t) if t else None, "x") for i, t in rows], DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
