import pytest

#: Column names that the operators use themselves.
CLASHING = ("size", "slot", "shard", "digits", "digest", "content", "salt", "member", "score", "predicted", "rejected",
            "lang_pred", "n_words", "capitals", "piece", "length", "rank", "words", "node", "key", "label", "at", "ids")
LONG = "one two three four five six seven eight nine ten " * 6000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns named like the operators' own."""
    rows = [
        (1, "A plain text with some words in it, and a few more of them."), (2, None), (3, ""), (4, "   \n "), (5, LONG),
        (6, "A plain text with some words in it, and a few more of them."), (6, "A plain text with some words in it, and a few more of them."),
        (7, "123 !!! ???"), (None, "no id"), (None, None), (8, "short"), (9, "short"), (10, LONG),
    ]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return frame.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHING])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
