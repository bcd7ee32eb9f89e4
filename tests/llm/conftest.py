import random

import pytest

from tests.conftest import SF0001, SF001, spark  # noqa: F401


@pytest.fixture(scope="session")
def odd(spark):  # noqa: F811
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    body = lambda n: " ".join(rng.choice(words) for _ in range(n))
    a, long_text = body(120), body(40_000)
    rows = [(1, a, "en", "s"), (2, a, "en", "s"), (2, a, "en", "s"), (3, None, None, None), (4, "", "en", None),
            (None, body(80), "de", "s"), (5, " \n\t ", "de", "t"), (6, long_text, "en", "s"), (7, "a" * 50_000, "en", "s"),
            (8, "1." * 5000 + "@" + "+" * 300, "en", "s"), (9, "Σİ́ J̌ <|endoftext|>  x", "fr", "t"), (10, "word", "fr", "t"),
            (11, a + " tail", "en", "s")]
    rows = [(*r, len(r[1] or ""), "x", 0.5, True) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "labels string, score double, kept boolean")


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")


def table(spark, name, sf=SF0001):  # noqa: F811
    return spark.read.parquet(f"{sf}/{name}.parquet")


__all__ = ["SF0001", "SF001"]
