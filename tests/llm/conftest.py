import pytest

#: Null, empty, blank, repeated and very long texts, ties, and columns whose names clash with the operators' own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kind int, part string, bits double, score string, range int"
LONG = "The quick brown fox, of the old house, jumps over the lazy dog and runs. " * 4000


def odd_rows():
    rows = [
        (1, "The idiot and the clown walked to the worthless house of the old king.", "en", "a"),
        (1, "The idiot and the clown walked to the worthless house of the old king.", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "b"),
        (4, " \n\t ", "en", "b"),
        (5, LONG, "en", "c"),
        (6, "x", "de", None),
        (None, "A text without an id. Released under the MIT License.", "en", "a"),
        (7, "Write to a.b@c.example or call +1 (269) 555-3296. é\U0001f600 <|endoftext|>", None, "c"),
        (8, "Write to a.b@c.example or call +1 (269) 555-3296. é\U0001f600 <|endoftext|>", "fr", "c"),
    ]
    return [(i, t, lang, source, len(t or ""), 9, "p", 0.5, "s", 3) for i, t, lang, source in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts_by_id(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
