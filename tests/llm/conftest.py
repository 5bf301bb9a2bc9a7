import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, file string, _row int, tokens int"
TEXTS = [
    None, "", " \t\n", "one", "one two", "Alpha beta GAMMA delta epsilon zeta eta theta", "alpha  BETA gamma\tdelta epsilon zeta eta theta",
    "ALPHA beta gamma delta epsilon zeta eta theta", "caf\u00e9 cre\u0300me \ufb01n \uff21", "cafe\u0301 cr\u00e8me fin A", "\u00c9COLE \u0130stanbul \u03a3\u03a3", "x" * 5000,
    "long word " * 4000, "long word " * 3999 + "end", "<|im_end|> <\\| <| a|b", "na\u00efve \U0001d518 \u4e2d\u6587 \U0001f600 text here and there",
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns whose names clash with the operators' own."""
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 3 else f"s{i % 3}", None if t is None else len(t), "f", i, 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], (None, "one two three four", "en", "s1", 18, "f", 0, 1)], DOCS).repartition(4)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
