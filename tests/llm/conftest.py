import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy string, shard string, component_id string, __class string, score string, __slot string, __shard string, __id string, __lang string, value string"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls in any column, empty and long texts, repeated rows, and columns with names that the operators use."""
    long = " ".join(f"word{i % 997} and{i}" for i in range(60_000))
    rows = [
        (1, "the cat and the dog of the house with that", "en", "a", 5, "x", "y", "z", "u", "v"),
        (1, "the cat and the dog of the house with that", "en", "a", 5, "x", "y", "z", "u", "v"),
        (2, None, "en", "a", None, None, None, None, None, None),
        (3, "", None, "a", 0, None, None, None, None, None),
        (4, "  \n\t ", "fr", None, 0, None, None, None, None, None),
        (None, "a text without id but with a number of words", None, None, None, None, None, None, None, None),
        (5, long, "en", "b", len(long), None, None, None, None, None),
        (6, "123 456 !!! \U0001f600", "de", "b", 1, None, None, None, None, None),
        (7, "le chat et le chien de la maison avec que", "fr", "b", 1, None, None, None, None, None),
        (8, "\x00 zero \x00 byte", "en", "c", 1, None, None, None, None, None),
    ]
    return spark.createDataFrame([(*r, "p", "q", "r", "s", "t") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
