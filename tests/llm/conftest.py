import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, t string"

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs home again today", "en", "b"),
    (2, "the quick brown  fox jumps over the lazy dog and runs home again today", "en", "a"),
    (3, "The quick\tbrown fox jumps over the lazy dog and runs home again today", "en", "a"),
    (4, None, None, None),
    (5, "", "en", "a"),
    (6, " \n\t ", "en", "b"),
    (7, "zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich heute Nacht", "de", "c"),
    (8, "日本語 😀 mixed text é́ <|endoftext|>  x y\r\n\n z", "en", None),
    (9, "word " * 4000, "en", "b"),
    (9, "word " * 4000, "en", "b"),
    (None, "a text without an id that nobody else has at all in this small table", "en", "a"),
    (10, "one", "en", "c"),
    (11, "You are an idiot! " * 3, "en", "d"),
    (12, "!!! ??? ...", "en", "d"),
]


@pytest.fixture
def docs(spark):
    """Nulls in any column, empty and long texts, ties, a repeated row, extra columns with names that operators use."""
    return spark.createDataFrame([(i, t, la, s, len(t or ""), "x", "clash") for i, t, la, s in TEXTS], SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
