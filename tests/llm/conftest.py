import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(spark, rows, kind=DOCS):
    return spark.createDataFrame(rows, kind)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and clashing names."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(rnd.choice(words) for _ in range(60_000))
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (None, "no id here at all", "en", None, 3),
        (5, long, "en", "a", len(long)), (6, long, "en", "b", len(long)), (7, "tie", "de", "b", 3), (8, "tie", "de", "b", 3), (8, "tie", "de", "b", 3),
        (9, "one two three four", "fr", "c", 18), (10, "é ñ <|endoftext|> \U0001d4b3\n\nx\x0by", "es", "c", None),
    ]
    clash = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, shard string, slot int, u string, w string, kept string, rank_ int, component_id string"
    return spark.createDataFrame([(*r, *[None] * 9) for r in rows], clash)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
