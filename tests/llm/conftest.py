import pytest


@pytest.fixture(autouse=True, scope="session")
def shipped(spark):
    from maskwright.llm.common import ship

    ship(spark)


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def make_docs(spark):
    """Documents of texts, or of (doc_id, text)."""

    def make(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)

    return make


@pytest.fixture
def folder(tmp_path):
    """A folder of tables, written by name."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


#: Texts that every operator must take: null, empty, white space, no words, one word, repeated, very long.
ODD = [None, "", " \n\t ", "!!! ???", "word", "same text here", "same text here", "long " * 60_000, "é\u0301 \U0001f600 \ufb01\u00a0x"]


@pytest.fixture
def odd():
    return list(ODD)
