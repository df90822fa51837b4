import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs."""
    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)
    return make


@pytest.fixture(scope="session")
def sf_dir():
    import os
    path = os.path.join(os.environ.get("LINEAMIX_TESTDATA", "/root/testdata"), os.environ.get("LINEAMIX_TEST_SF", "sf0.001"))
    if not os.path.isdir(path):
        pytest.skip("benchmark tables are not here")
    return path
