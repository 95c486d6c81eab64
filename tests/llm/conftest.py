import pytest

#: Texts with the shapes that break things: null, empty, blank, short, long, repeated, odd characters.
TEXTS = [
    None, "", " \n\t ", "one", "One", "one two", "a b c d e f g h i j k l m n o p q r s t u v w x y z", "a b c d e f g h i j k l m n o p q r s t u v w x y z",
    "word " * 5000, "é ü 日本 " * 40, "x" * 30000, "line one here\nline one here\n\nline two", "<|endoftext|> and then \x1c odd　space", "mail me@example.org, call +49 30 1234567",
]


@pytest.fixture
def odd_docs(spark):
    """Odd texts, repeated rows, null keys, and extra columns whose names operators use inside."""
    rows = [(i, t, None if i % 4 == 0 else f"s{i % 3}", "lang", i, "x", "y", True, 0) for i, t in enumerate(TEXTS)]
    rows += [(3, "one", "s0", None, None, None, None, None, None), (None, "null key", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, `__text` string, component string, kept boolean, size int")
