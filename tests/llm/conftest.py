from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, norm string, sha int, salt int, node string, tile long, digest string, entity string, votes int, file string, n long"


def frame(spark, rows):
    """Documents with columns whose names clash with those that operators make; rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None, *[None] * 10) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, rare characters."""
    rng = random.Random(3)
    long = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))) for _ in range(60_000))
    return [
        (1, "The quick brown fox jumps over the lazy dog, again and again."),
        (2, None),
        (3, ""),
        (4, " \t\n\x0b\f\r "),
        (5, "The  quick brown fox jumps over the\tlazy dog, again and again."),
        (5, "The  quick brown fox jumps over the\tlazy dog, again and again."),
        (None, "a text without id"),
        (None, "a text without id"),
        (6, long),
        (7, "x" * 50_000),
        (8, "日本語 é ß \U0001f600 ▁ \x00 <|endoftext|> </s>"),
        (9, "one"),
        (10, "two words"),
        (11, "TWO WORDS"),
        (12, "1234 !!! ???"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return frame(spark, odd_rows).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])
