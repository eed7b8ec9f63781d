import random

import pytest

#: (doc_id, text, lang, source, n_chars); ids repeat, every column has nulls, one row repeats as a whole.
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    rng = random.Random(7)
    words = ["alpha", "beta", "Gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "été", "ß", "a1b2"]
    body = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = body(60)
    rows = [(i, body(rng.randint(1, 80)), rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), i) for i in range(60)]
    rows += [(100 + i, base if i % 2 else base.replace(" ", "\n\t", 3), "en", "s0", None) for i in range(12)]
    rows += [(200, None, None, None, None), (201, "", "en", "s1", 0), (202, " \n\t ", "en", "s1", 3), (None, base, "en", None, 1), (None, None, None, None, None)]
    rows += [(203, "x" * 20_000, "en", "s1", 1), (204, "word " * 4_000, "de", "s0", 1), (205, "a\nb\na\n\n \na", "de", "s0", 1)]
    return rows + [rows[0], rows[0], (200, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns named like those that operators add or use."""
    from pyspark.sql import functions as F

    names = ["row", "kept", "fp", "id", "key", "tokens", "turn", "block", "place", "shard", "slot", "row_number", "ids", "decoded", "score",
             "spans", "lang_pred", "base_failed", "n_words", "host", "path", "rule", "verdict", "plain", "doc", "weight", "range", "train"]
    return odd.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
