import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: columns whose names clash with working columns of the operators
CLASHES = ("_key", "_text", "size", "fp", "score", "anchor", "list", "v", "doc", "component_id", "_h", "target")


@pytest.fixture(scope="session")
def make(spark):
    """documents from (doc_id, text[, lang[, source]]) rows, with or without clashing columns."""

    def build(rows, clash=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if clash:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit("clash") for c in CLASHES})
        return df

    return build


@pytest.fixture(scope="session")
def prose():
    """Random words, some of them common."""

    def text(seed, n, words=400):
        rng = random.Random(seed)
        pool = ["".join(rng_word.choice("abcdefghij") for _ in range(rng_word.randint(2, 8))) for rng_word in (random.Random(i) for i in range(words))]
        return " ".join(pool[min(int(rng.expovariate(0.02)), words - 1)] for _ in range(n))

    return text
