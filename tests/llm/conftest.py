import random

import pytest

EXTRA = "score double, n_words string, label string, t string, h string, text2 string, lang string, source string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with further columns, whose names clash with the operators' own."""

    def make(rows):
        data = [(d, t, 0.5, "w", "l", "t", "h", "x", "en", "s") for d, t in rows]
        return spark.createDataFrame(data, f"doc_id bigint, text string, {EXTRA}")

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Null, empty and very long texts, repeated rows, a null id, texts without words."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    random.seed(5)
    long = " ".join(random.choice(words) + str(random.randrange(1000)) for _ in range(40_000))
    rows = [(1, None), (2, ""), (3, long), (4, "the same row twice, once more"), (4, "the same row twice, once more"),
            (None, "a text without an id is kept as it is"), (5, "### !!! ..."), (6, "\n\n\n"), (7, "É é ß 日本 😀 \x00   end"), (8, "one")]
    return make_docs(rows)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
