import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    def make(*texts, ids=None, lang="en"):
        ids = ids or range(len(texts))
        return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], DOCS)

    return make
