import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, extra int"


def word(r: random.Random) -> str:
    return "".join(r.choice("abcdeéß") for _ in range(r.randrange(1, 7)))


def text(r: random.Random, n: int) -> str:
    return "".join(word(r) + r.choice([" ", " ", " ", "  ", "\n", ".\n", "\t"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeats, clashing column names."""
    r = random.Random(7)
    base = text(r, 120)
    long = text(r, 30_000)
    rows = [
        (1, base, "en", "a", 1, "x", 1),
        (2, base, "en", "a", 1, "x", 1),  # a copy
        (2, base, "en", "a", 1, "x", 1),  # a repeated row
        (3, base.upper(), None, "a", None, None, None),
        (4, None, "en", "b", 0, None, 2),
        (5, "", "en", "b", 0, "", 3),
        (6, " \n\t\x0b\f\r ", "en", None, 5, "y", 4),
        (None, base[:300], "en", "c", 9, "z", 5),
        (None, None, None, None, None, None, None),
        (7, long, "de", "a", 7, "x", 6),
        (8, long + " und mehr", "de", "c", 7, "x", 6),
        (9, "one two three", "en", "c", 3, "x", 7),
        (9, "one two three four", "en", "c", 3, "x", 7),  # one id, two texts
        (10, "\n\n\nLine number one is here\nline NUMBER one is here \n", "en", "a", 3, "x", 7),
        (11, "Line number one is here\nshort\nshort\nanother line of the text", "en", "b", 3, "x", 7),
        (12, "日本語 の 文章 😀 emoji  no break", "ja", "b", 3, "x", 7),
    ]
    rows += [(20 + i, text(r, r.randrange(1, 90)), "en", r.choice("abc"), i, str(i), i) for i in range(30)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
