import pytest

from plantpulse.llm.common import prepare

#: Texts every operator must stand: NULL, empty, blank, tiny, long, repeated.
ODD = [None, "", " ", "\n\n", "a", "a b", "A  b\tc\r\nd", "é漢字🙂 ok.", "x" * 50_000, "word " * 3000, "Same text, twice.",
       "Same text, twice.", "Mail me@example.com or +1 (555) 555-1234, 10.0.0.1 now.", "4111 1111 1111 1111",
       "x<|endoftext|>y <|startoftext|>"]


@pytest.fixture()
def odd_docs(spark):
    """Odd texts, a NULL id, a repeated row, and columns whose names clash."""
    prepare(spark)
    rows = [(i, t, "en", i, 0.5, i, "k") for i, t in enumerate(ODD)]
    rows += [(None, "no id here at all", "en", 1, 0.5, 0, "k"), (3, ODD[3], "en", 3, 0.5, 3, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n long, score double, rep long, `base` string")


@pytest.fixture()
def no_docs(odd_docs):
    return odd_docs.limit(0)
