import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def rows(texts, first=0):
    return [(first + i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]


#: null, empty, white space, special strings, repeated, very long, other scripts
ODD = [None, "", " ", "\n\n", "a", "the cat's hat", "the cat's hat", "x<|endoftext|>y", "<|startoftext|>", "é" * 5000, "中文 текст 😀 ½", "word " * 30000, "nospace" * 3000, "\x1c\x85\xa0 á", "'S 'LL İ ß 12345"]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, first=0):
        return spark.createDataFrame(rows(texts, first), DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    return make_docs(ODD).unionByName(make_docs(["the cat's hat"], 5)).unionByName(make_docs([None, "orphan"], 100).selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars"))
