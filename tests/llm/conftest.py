import random

import pytest


@pytest.fixture(scope="session")
def words():
    """Text of so many words from a small vocabulary, by seed."""

    def make(n: int, seed: int, vocabulary: int = 400) -> str:
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(("", "", ".", "\n")) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd(words):
    """(doc_id, text): nulls, empty, blank and very long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(2)
    base = words(120, 1)
    near = base.split(" ")
    rows = [(0, None), (1, ""), (2, " \t\n\x0b\x0c\r "), (3, "one"), (4, "One two"), (5, base), (6, base), (6, base), (7, base.upper()), (8, words(120, 2))]
    for i in range(9, 14):
        copy = list(near)
        for _ in range(i - 8):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
        rows.append((i, " ".join(copy)))
    rows += [(14, words(30_000, 3)), (15, "é ñ 日本 👍   x"), (16, "a" * 3000), (17, "ab" * 1000 + base), (18, words(9, 4)), (19, "one"), (20, " ".join(["same"] * 50)), (None, "one"), (None, None)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd):
    """The same with the other columns of documents, and columns whose names operators use themselves."""
    rows = [(i, t, None if n % 7 == 0 else "en" if n % 2 else "fr", None if n % 5 == 0 else f"s{n % 3}", len(t or ""), n, "v", 0.5, n) for n, (i, t) in enumerate(odd)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k int, cluster string, score double, row int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
