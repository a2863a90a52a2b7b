"""What the driver holds and starts in the pipeline's stages."""

import random
import weakref

from textloom.llm import jaccard, langid


def staged_edges(monkeypatch):
    labels, stage = [], jaccard.stage
    monkeypatch.setattr(jaccard, "stage", lambda df, label: labels.append(label) or stage(df, label))
    return labels


def test_links_that_are_stars_need_no_round(spark, monkeypatch):
    links = spark.createDataFrame([(1, 5), (6, 1), (2, 3), (4, 4), (5, 1)], "a long, b long")
    labels = staged_edges(monkeypatch)
    assert sorted(map(tuple, jaccard.contract(links).collect())) == [(3, 2), (5, 1), (6, 1)]
    assert labels == ["edges"]


def test_classes_of_random_links(spark, monkeypatch):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(100, 130)]
    for rows in ([], chain, [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]):
        root = {x: x for r in rows for x in r}
        for _ in root:
            for a, b in rows:
                root[a] = root[b] = min(root[a], root[b])
        got = jaccard.contract(spark.createDataFrame(rows, "a long, b long"))
        assert sorted(map(tuple, got.collect())) == sorted((x, r) for x, r in root.items() if x != r)


def test_one_text_has_its_values_at_a_time(spark, monkeypatch):
    alive, most, vector = weakref.WeakSet(), [0], langid.LanguageModel.vector

    def watched(self, at, counts):
        found = vector(self, at, counts).view(Watched)
        alive.add(found)
        most[0] = max(most[0], len(alive))
        return found

    monkeypatch.setattr(langid.LanguageModel, "vector", watched)
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abcdefgh "[i % 3 :]) for _ in range(40)), f"l{i % 3}") for i in range(60)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.id_bucket("doc_id", 5) != 9)
    assert len(model.labels) == 3 and most[0] <= 3


class Watched(langid.np.ndarray):
    __hash__ = object.__hash__

    def __eq__(self, other):
        return self is other
