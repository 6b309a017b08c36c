import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def make(spark, rows, extra=()):
    """Rows (doc_id, text[, lang[, source]]); ``extra`` names columns that clash with what operators use within."""
    full = [(r[0], r[1], *(r[2:3] or ("en",)), *(r[3:4] or ("s",)), len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    for c in extra:
        from pyspark.sql import functions as F

        df = df.withColumn(c, F.lit("x"))
    return df


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ba", "ne", "lo", "ti", "su", "ra", "mi"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


CLASH = ("row", "id", "key", "weight", "tokens", "slot", "block", "score", "unit", "part", "band", "root", "token", "n", "keep", "count", "hash", "doc.x", "text.y", "__place", "__row", "__id", "__set", "__weight", "__logppl", "__tokens", "__source", "set", "cell", "links", "gram", "unit.1")
EDGE = [(1, None), (2, ""), (3, " \n "), (4, "..."), (None, "a b c d"), (5, "x"), (6, "same text here again"), (6, "same text here again"), (7, "\U0001F600 é ß " * 3)]


@pytest.fixture
def edge(spark):
    return make(spark, [*EDGE, (8, prose(8, 30_000))], CLASH)
