import pytest


@pytest.fixture
def docs(spark):
    """Documents with columns whose names clash with what operators use inside."""

    def make(texts, ids=None, langs=None):
        ids = range(len(texts)) if ids is None else ids
        langs = [None] * len(texts) if langs is None else langs
        rows = [(i, t, g, "s", "x", 1, "w") for i, t, g in zip(ids, texts, langs, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key string, n long, word string")

    return make


@pytest.fixture
def odd_texts():
    """Null, empty, blank, one word, repeats, beyond ASCII, very long."""
    long = " ".join(f"w{i % 997} v{i % 31}." for i in range(6000))
    return [None, "", " \n\t", "one", "one", "Élan vital – ñ 漢字 😀 a", long, long, "a b c d e f g h", "A B C D E F G H"]
