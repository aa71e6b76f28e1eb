import pytest
from oracle import connect


@pytest.fixture(scope="session")
def con(sf_dir):
    return connect(sf_dir)


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with a column whose name clashes."""

    def make(rows, **columns):
        data = [(i, t, "en", columns.get("source", "s"), None if t is None else len(t), 0) for i, t in rows]
        return spark.createDataFrame(
            data, "doc_id long, text string, lang string, source string, n_chars long, fp int")

    return make
