import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and over river Mühle écoute señal data it's we'll 42 x1 naïve <|endoftext|> ½ ２ \x1c tab\there don't".split(" ")


def rows(n=60, seed=1):
    """Small documents with nulls, empty and long texts, copies and equal ids."""
    r = random.Random(seed)
    out = [(i, " ".join(r.choices(WORDS, k=r.choice([1, 5, 40, 300]))) + r.choice(["", "\n", "  \n\nend"]), "en", f"s{i % 3}", 0) for i in range(n)]
    out += [(n, None, None, None, None), (n + 1, "", "en", "s1", 0), (n + 2, "   \n ", "en", "s1", 0), (3, out[3][1], "en", "s1", 0), (None, "no id", "en", "s1", 0), (n + 3, "long " * 20_000, "en", "s1", 0)]
    return out + [(n + 10 + i, out[5][1], "en", "s0", 0) for i in range(10)]


@pytest.fixture(scope="session")
def small(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(small):
    """The same rows with further columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    for name in ("row", "key", "ids", "piece", "n", "k", "word", "span", "fp", "line", "host", "c"):
        small = small.withColumn(name, F.lit(name))
    return small
