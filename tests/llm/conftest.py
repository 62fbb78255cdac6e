import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def docs_schema():
    return T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                         T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def make_docs(spark, docs_schema):
    """documents rows from texts; ids from 0."""

    def make(texts, langs=None, ids=None):
        ids = ids if ids is not None else list(range(len(texts)))
        langs = langs if langs is not None else ["en"] * len(texts)
        rows = [(i, t, la, "src0", len(t) if t is not None else None) for i, t, la in zip(ids, texts, langs)]
        return spark.createDataFrame(rows, docs_schema)

    return make
