import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty and very long texts, ties, repeated rows, and a word without white space.
PARAGRAPH = " ".join(f"word{i}" for i in range(60))
HARD = [
    (1, PARAGRAPH + "\nshared line of text here", "en", "a", 5),
    (2, PARAGRAPH + "\nshared line of text here", "en", "a", 5),
    (3, "", "en", "b", 0),
    (4, None, None, None, None),
    (None, "no id " + PARAGRAPH, "en", "b", 3),
    (None, None, None, None, None),
    (5, "repeated row one two three four five six", "en", "a", 1),
    (5, "repeated row one two three four five six", "en", "a", 1),
    (6, "x" * 30_000, "en", "a", 2),
    (7, " ".join(f"long{i % 977}" for i in range(40_000)), "de", "c", 9),
    (8, " \t\n\x0b ", "en", "c", 5),
    (9, "Licensed under the Apache License, Version 2.0.\n\nShared LINE of text here \n", "en", "a", 5),
    (10, "ÄÖ ß 你好 <|endoftext|> 👩\u200d👧 \u00a0 x", "zh", "b", 5),
    (11, "of of of of of of of of of of of of", "en", "b", 5),
]


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(HARD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
