import pytest

DOCS = "doc_id long, text string, lang string, score string, node string, h1 string, bucket string, n_words string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang]) rows, with extra columns whose names clash with the operators' own."""
    def make(rows):
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "a", "b", "c", "d", "e") for r in rows], DOCS)
    return make


ODD_ROWS = [(None, "a text without an id that has some words in it"), (900, None), (901, ""), (902, " \n\t "), (903, "x"),
            (904, "repeated row with a few words in it"), (904, "repeated row with a few words in it"), (905, "long " * 20000)]


@pytest.fixture(scope="session")
def odd_rows():
    return list(ODD_ROWS)
