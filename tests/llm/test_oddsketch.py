import random

import numpy as np
import pytest

from textloom.llm import oddsketch

from . import brute


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_components(odd, odd_docs, k, percent):
    """Nulls, empty, blank and very long texts, ties, repeated rows, near copies, clashing columns; null-id rows by their sets."""
    rows = oddsketch.components(odd_docs, k, percent).collect()
    numbered = [(i if i is not None else 1000 + n, t) for n, (i, t) in enumerate(odd)]
    want = brute.op6(numbered, k, percent)
    known = lambda x: x if x < 1000 else None
    assert sorted(map(tuple, rows), key=repr) == sorted(((known(i), n, known(root)) for i, n, root in want), key=repr)


def test_op11_hot_group(spark):
    """Hundreds of near copies, of which some are linked by others only: several rounds, then the last step."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 6, 9))):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[i % 7][1]) for i in range(60)] + [(2000, "a b"), (2001, "A  B"), (2002, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in oddsketch.op11(docs).collect())
    assert got == sorted(brute.op6(rows, 3, 85))
    assert sum(i != c for i, _, c in got) > 60


def test_dedup_keeps_one_of_each(spark, odd_docs, no_docs):
    assert oddsketch.op11(no_docs).count() == 0
    found = oddsketch.op11(odd_docs)
    assert found.where("NOT (kept <=> (doc_id <=> component_id))").count() == 0
    kept = oddsketch.dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 5 in ids and not {6, 7, 19} & set(ids) and {0, 1, 2, 3, 8, 14} <= set(ids)


def test_sketches_never_rule_out_whole_samples(spark):
    """Up to SAMPLE shingles no similar pair has more ones than allowed; beyond it, none of many has."""
    rng = np.random.default_rng(3)
    pairs = []
    for size in (1, 2, 7, 20, 100, 900, 1500, 6000):
        for _ in range(6):
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            change = int(len(a) * 0.08)
            b = np.unique(np.concatenate([a[: len(a) - change], rng.integers(0, 2**64, change, dtype=np.uint64)])) if change else a
            rng.shuffle(c := a.copy())
            b = np.unique(np.concatenate([c[change:], rng.integers(0, 2**64, change, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both):
                pairs.append((len(a), len(b), oddsketch.odd_sketch(a).tolist(), oddsketch.odd_sketch(b).tolist()))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pairs, "n long, m long, a array<long>, b array<long>")
    df = df.select(oddsketch.ones_apart(F.col("a"), F.col("b")).alias("apart"), oddsketch.ones_allowed(F.col("n"), F.col("m"), 85).alias("most"))
    assert len(pairs) > 30 and df.where("apart > most").count() == 0


def test_bands_find_similar_sets():
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(400):
        a = np.unique(rng.integers(0, 2**64, 200, dtype=np.uint64))
        rng.shuffle(a)
        b = np.unique(np.concatenate([a[16:], rng.integers(0, 2**64, 16, dtype=np.uint64)]))  # similarity 0.85
        missed += not np.any(oddsketch.bands(np.sort(a)) == oddsketch.bands(b))
    assert missed <= 1
