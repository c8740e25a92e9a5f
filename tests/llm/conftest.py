import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "size long, score double, fp string, shard int, slot long, target double, copies long, _place int, n long, count long"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "of", "and", "ont", "erea", "thing", "le", "ñasco", "über"]) + rng.choice(["", "er", "le", "an"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    long = prose(1, 30_000)
    passage = prose(2, 70)
    rows = [
        (1, prose(3, 120), "en", "a"),
        (2, None, "en", "a"),
        (3, "", "de", None),
        (4, " \t\n ", None, "b"),
        (5, long, "fr", "b"),
        (6, long, "fr", "b"),
        (6, long, "fr", "b"),
        (None, prose(3, 120), "en", None),
        (None, None, None, None),
        (7, "x" * 300_000, "en", "c"),
        (8, prose(4, 30) + " " + passage + " " + prose(5, 30), "en", "a"),
        (9, prose(6, 10) + "\n" + passage + " " + prose(7, 80), "de", "ä"),
        (10, passage, "es", "Z"),
        (11, "日本語 テキスト 😀 \x1c  word", "ja", "a"),
        (12, "1234 5678 !!!", "en", "a"),
        (13, prose(3, 120) + " more", "en", "a"),
        (14, "one two", "en", "c"),
        (15, "one  two   three four <|endoftext|> five ", "en", "c"),
    ]
    return [(i, t, g, s, None if i == 3 else len(t or "")) for i, t, g, s in rows]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows with further columns whose names operators might use."""
    extra = (5, 0.5, "x", 1, 2, 3.0, 4, 5, None, 7)
    return spark.createDataFrame([r + extra for r in odd_rows], DOCS + ", " + CLASHING)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def some_docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def some_rows(some_docs):
    return [tuple(r) for r in some_docs.collect()]
