"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

The model is trained with follow-the-regularised-leader (per-coordinate step sizes, elastic-net penalty: the L1 part
zeroes weights, the L2 part shrinks them) and its confidences are calibrated by one temperature on rows that the
weights have not seen.

Scale: document frequencies come from every labelled training document (one vector of ``DIMS`` counts per task,
summed in a shuffle). The weights are fitted on at most ``per_label`` distinct texts a label, a documented bound, found
by a cut of the texts' hashes, so no label's rows meet in a task; what the driver holds is bounded by that, by ``DIMS``
and by the number of labels. Scoring is one map over the whole texts, without a shuffle.

Defined results: text that is null or has no letter gives ``und`` and score 0; with no labelled training row every
text gives ``und``; of labels that score alike the first in order wins; rows repeat as often as in the input, and rows
that share an id are scored each by its text; texts of any length are read whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, id_bucket

#: Hashed feature space (a power of two).
DIMS = 1 << 16
ORDERS = (1, 2, 3)
UNKNOWN = "und"
#: Hashes of texts lie below this.
HASHES = 1 << 53
_MULT = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashed 1- to 3-grams of the lower-cased text, and how often each occurs."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    found = []
    for n in ORDERS:
        if len(codes) < n:
            break
        h = np.full(len(codes) - n + 1, n, dtype=np.uint32)
        for i in range(n):
            h = (h ^ codes[i : len(codes) - n + 1 + i]) * _MULT[i]
            h ^= h >> np.uint32(15)
        found.append(h & np.uint32(DIMS - 1))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    counts = np.bincount(np.concatenate(found), minlength=DIMS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class LanguageModel:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[at]
        return x / (np.linalg.norm(x) or 1.0)

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or not text or not has_letter(text):
            return UNKNOWN, 0.0
        at, counts = gram_counts(text)
        p = softmax(self.logits(at, self.vector(at, counts)) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


class Vectors(Sequence):
    """Grams and TF-IDF values of the rows numbered ``use``; a row's values are made when asked for and not kept."""

    def __init__(self, model: LanguageModel, rows: list[tuple[np.ndarray, np.ndarray]], use: np.ndarray) -> None:
        self.model, self.rows, self.use = model, rows, use

    def __len__(self) -> int:
        return len(self.use)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at, counts = self.rows[self.use[i]]
        return at, self.model.vector(at, counts)


def _views(lists: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists as arrays over the column's own buffers."""
    found = []
    for chunk in lists.chunks:
        values, ends = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        found += [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return found


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit_ftrl(
    rows: Sequence[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_labels: int, *,
    alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, epochs: int = 3, seed: int = 7,
) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over sparse rows (indices, values): weights and biases of a multinomial logistic regression."""
    z, n = np.zeros((DIMS + 1, n_labels)), np.zeros((DIMS + 1, n_labels))

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0.0, (np.sign(zs) * l1 - zs) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, DIMS), np.append(x, 1.0)  # the last feature is the bias
            w = weights(at)
            p = softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(DIMS + 1))
    return w[:DIMS], w[DIMS]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean())

    lo, hi, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    a, b = hi - r * (hi - lo), lo + r * (hi - lo)
    for _ in range(40):
        if loss(a) < loss(b):
            hi, b = b, a
            a = hi - r * (hi - lo)
        else:
            lo, a = a, b
            b = lo + r * (hi - lo)
    return float(np.exp((lo + hi) / 2))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of ``docs`` each hashed n-gram occurs, and how many documents have any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        df = np.zeros(DIMS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                at, _ = gram_counts(text)
                df[at] += 1
                df[DIMS] += len(at) > 0
        at = np.flatnonzero(df)
        yield {"gram": at, "n": df[at]}

    got = arrow_map(docs.select("text"), count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIMS + 1, np.int64)
    for gram, n in got:
        df[gram] = n
    return df[:DIMS], int(df[DIMS])


def hash_cuts(train: DataFrame, per_label: int) -> dict[str, int]:
    """For each label the hash up to which it has ``per_label`` distinct texts, or all.

    train: lang, h. Labels are counted first; then only hashes that are low enough to matter are looked at.
    """
    distinct = train.distinct()
    enough = per_label + 5 * int(per_label**0.5) + 10
    labels = {r.lang: min(1.0, enough / r.n) for r in distinct.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not labels:
        return {}
    low = F.element_at(F.create_map(*(F.lit(x) for lang, share in labels.items() for x in (lang, int(share * HASHES)))), F.col("lang"))
    found: dict[str, list[int]] = {lang: [] for lang in labels}
    for lang, h in train.where(F.col("h") <= low).distinct().collect():
        found[lang].append(h)
    return {lang: sorted(hs)[:per_label][-1] for lang, hs in found.items() if hs}


def fit(docs: DataFrame, trainable: Column, *, per_label: int = 800, calibrate_every: int = 4) -> LanguageModel:
    """Learn from the rows of ``docs`` (doc_id, text, lang) where ``trainable`` holds.

    per_label: the bound of fitted texts a label, taken in the order of a hash of the text; every ``calibrate_every``-th
    of them only sets the temperature.
    """
    train = docs.where(trainable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    df, n_docs = document_frequencies(train)
    train = train.select("lang", F.pmod(F.xxhash64("text"), F.lit(HASHES)).alias("h"), "text")
    cuts = hash_cuts(train.where(F.col("text").rlike(r"\p{L}")).select("lang", "h"), per_label)
    cut = F.element_at(F.create_map(*(F.lit(x) for item in cuts.items() for x in item)), F.col("lang")) if cuts else F.lit(None).cast("long")
    # per_label texts a label bound the sample; copies meet again and count once
    sample = train.where(F.col("h") <= cut).dropDuplicates(["lang", "h"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for lang, h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if has_letter(text):
                    at, counts = gram_counts(text)
                    yield {"lang": [lang], "h": [h], "at": [at], "counts": [counts]}

    rows = arrow_map(sample, features, "lang string, h long, at array<int>, counts array<int>").toArrow()
    order = rows.select(["lang", "h"]).append_column("i", pa.array(range(len(rows)), pa.int64())).sort_by([("lang", "ascending"), ("h", "ascending")])
    names, grams = order.column("lang").to_pylist(), list(zip(_views(rows.column("at")), _views(rows.column("counts")), strict=True))
    grams = [grams[i] for i in order.column("i").to_pylist()]
    labels = sorted(set(names))
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    model = LanguageModel(labels, idf, np.zeros((DIMS, len(labels))), np.zeros(len(labels)))
    if not labels:
        return model
    y = np.array([labels.index(x) for x in names])
    held = np.array([(i + 1) % calibrate_every == 0 for i in range(len(names))])
    if held.all() or not held.any():
        held[:] = False
    use = np.flatnonzero(~held)
    model.weights, model.bias = fit_ftrl(Vectors(model, grams, use), y[use], len(labels))
    if held.any():
        model.temperature = fit_temperature(np.array([model.logits(*x) for x in Vectors(model, grams, np.flatnonzero(held))]), y[held])
    return model


def predict(docs: DataFrame, model: LanguageModel, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns of every row, with lang_pred and score; the model (under 5 MB a 10 labels) is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*carry, "text").schema.fields[:-1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        m = sent.value
        for batch in batches:
            found = [m.predict(text) for text in batch.column(len(kept)).to_pylist()]
            yield {f.name: batch.column(i) for i, f in enumerate(kept)} | {
                "lang_pred": [x[0] for x in found], "score": [x[1] for x in found],
            }

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return arrow_map(docs.select(*carry, "text"), score, f"{ddl}, lang_pred string, score double")


def op4(docs: DataFrame) -> DataFrame:
    """The contract's query: learn from four fifths of the labelled documents, predict all."""
    model = fit(docs, id_bucket("doc_id", 5) != 0)
    found = predict(docs, model)
    return found.select("doc_id", (id_bucket("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
