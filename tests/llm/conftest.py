import pytest

WORDS = "the cat sat on a mat and then it ran off to see what was on the other side of that old stone wall before dawn".split()


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and blank texts, a very long text, ties, repeated rows and a clashing extra column."""
    rows = [
        (1, "the cat sat on the mat and it was good to see that", "en", None),
        (1, "the cat sat on the mat and it was good to see that", "en", None),
        (2, "The CAT sat on the mat and it was good to see that", None, 3),
        (3, None, "en", 1),
        (4, "", "en", 1),
        (5, " \t\n ", "en", 1),
        (None, "a row without an id", None, None),
        (None, None, None, None),
        (6, "word", "de", 2),
        (7, "é漢字 😀 <|endoftext|> <|im_end|>", "de", 2),
        (8, " ".join(WORDS[i * i % len(WORDS)] + str(i % 977) for i in range(30000)), "fr", 2),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, node long")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, node long")
