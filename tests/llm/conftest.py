import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, quality string, size string, `node` string, `group` string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and very long texts, repeated rows and ids, clashing extra columns."""
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again", "en", "b", 1), (2, "the quick brown fox jumps over the lazy dog again", "en", "b", 1),
        (2, "the quick brown fox jumps over the lazy dog again", "en", "b", 1), (3, None, "en", None, None), (4, "", None, "a", 0), (5, "   \n\t ", "en", "a", 5),
        (None, "the quick brown fox jumps over the lazy dog again", "en", "a", 1), (6, long, "en", "c", len(long)), (7, long + " tail", "en", "c", 1), (8, "one", "de", "é", 3),
        (8, "two different texts under one id here", "de", "é", 3), (9, "x" * 300_000, "en", None, 1),
    ]
    return spark.createDataFrame([(*r, "q", "s", "n", "g") for r in rows], DDL)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DDL)
