import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from texts, ids from 0."""
    def make(texts, source="a", lang="en"):
        return spark.createDataFrame(
            [(i, t, lang, source, len(t or "")) for i, t in enumerate(texts)], DOCS)
    return make
