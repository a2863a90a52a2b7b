"""Language-model scoring: a log-bilinear neural model of words, trained by noise-contrastive estimation.

Outputs are the end, the ``WORDS`` most frequent words, each with vectors of its own, and ``TAIL`` classes that all other
words fall in by their last two bytes; within a tail class a word has its share of the class's training tokens, one
unseen word included. A token's score is the product of its context's vector (that of the token before) and its own,
plus a bias; it is normalised over all outputs, so the scores are true log-probabilities over all words. The
normalisers of all contexts come from batched matrix products, once.

Training is stochastic: each step draws (context, token) pairs by their counts over *all* training documents, and noise
tokens from the unigram distribution, and moves the vectors so that pairs are told from noise.

Scale: token counts and pair counts are summed in a shuffle with pre-aggregation in each task. Token counts are kept as
a table; the ``HEAD`` most frequent tokens (a fixed bound) are broadcast, every other token of a text is looked up by a
join, so the vocabulary may grow without limit. The driver holds at most HEAD tokens and OUTPUTS**2 pair counts.

Defined results: null text is empty (only the end is scored); with no training token the counts are 0 and N is 0; a null
id counts as empty text in the split; each input row gives one row, repeated rows too.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, id_bucket, most_frequent, stage, utf8

#: Outputs: 0 before the text (context only), 1 the end, then WORDS frequent words, then TAIL classes.
OUTPUTS, TAIL = 4096, 256
WORDS = OUTPUTS - TAIL - 2
START, END = 0, 1
#: Tokens whose counts are broadcast; the others are joined.
HEAD = 1 << 16
#: Tokens handled at once by a Python worker, and pairs that it holds before it hands them on.
CHUNK, PAIRS = 200_000, 1_000_000
END_TOKEN = b""


def tokens(text: bytes) -> list[bytes]:
    """A-Z lower-cased words between the six ASCII blanks."""
    return text.lower().split()  # of bytes: both only look at ASCII


def tail_class(token: bytes) -> int:
    return OUTPUTS - TAIL + zlib.crc32(token[-2:]) % TAIL


def token_counts(texts: DataFrame, flush: int = 300_000) -> DataFrame:
    """token, c over all rows of ``texts`` (a column of UTF-8 bytes); the end is the empty token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(tokens(text.as_py()))
                seen[END_TOKEN] += 1
                if len(seen) > flush:
                    yield {"token": list(seen), "c": list(seen.values())}
                    seen.clear()
        yield {"token": list(seen), "c": list(seen.values())}

    return arrow_map(texts, count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Head:
    """The most frequent tokens: output, log10(c + 1), and log10 of their share of their output."""

    index: dict[bytes, int]
    cls: np.ndarray
    log_count: np.ndarray
    log_share: np.ndarray
    log_rest: np.ndarray  # by output: -log10 of what the shares are taken of

    def classes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Place among the head (-1: not there) and output of each word."""
        get = self.index.get
        at = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        cls = self.cls[at]
        for i in np.flatnonzero(at < 0):
            cls[i] = tail_class(words[i])
        return at, cls


@dataclass
class LogBilinear:
    """Vectors and log normalisers of contexts, vectors and biases of outputs."""

    context: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    normaliser: np.ndarray

    def log_p(self, before: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 probability of each output after its context."""
        score = np.einsum("ij,ij->i", self.context[before], self.output[cls]) + self.bias[cls] - self.normaliser[before]
        return score.astype(np.float64) / np.log(10)


@dataclass
class LanguageModel:
    train_tokens: int
    train_words: int
    head: Head
    neural: LogBilinear


def contexts(cls: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The output before each token; ``starts``: where texts begin."""
    before = np.empty_like(cls)
    before[1:] = cls[:-1]
    before[starts] = START
    return before


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes], np.ndarray]]:
    """(rows, words, starts): rows without their text; a text's words come whole, with the end after them."""
    rows: list = []
    words: list[bytes] = []
    starts: list[int] = []
    for batch in batches:
        keys = list(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True)) or [()] * len(batch)
        for key, text in zip(keys, batch.column(batch.num_columns - 1), strict=True):
            rows.append(key)
            starts.append(len(words))
            words += tokens(text.as_py())
            words.append(END_TOKEN)
            if len(words) >= CHUNK:
                yield rows, words, np.array(starts)
                rows, words, starts = [], [], []
    if rows:
        yield rows, words, np.array(starts)


def pair_counts(texts: DataFrame, head: Head) -> tuple[np.ndarray, np.ndarray]:
    """The (context * OUTPUTS + output) pairs that occur in any row, and how often."""
    sent = texts.sparkSession.sparkContext.broadcast(head)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for _, words, starts in chunks(batches):
            _, cls = sent.value.classes(words)
            held.append(np.unique(contexts(cls, starts).astype(np.int32) * OUTPUTS + cls, return_counts=True))
            if sum(len(x) for x, _ in held) > PAIRS:
                held = [_summed(held)]
                if len(held[0][0]) > PAIRS // 2:
                    yield {"pair": held[0][0], "n": held[0][1]}
                    held = []
        if held:
            pair, n = _summed(held)
            yield {"pair": pair, "n": n}

    got = arrow_map(texts, count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow().sort_by("pair")
    return got.column("pair").to_numpy(), got.column("n").to_numpy()


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pair, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    return pair, np.bincount(at, np.concatenate([n for _, n in parts]), len(pair)).astype(np.int64)


def fit_nce(
    pair: np.ndarray, n: np.ndarray, *, size: int = 32, noise: int = 512, batch: int = 4096, steps: int = 800, rate: float = 0.05, seed: int = 1,
) -> LogBilinear:
    """A model fitted to pair counts. Each step tells ``batch`` drawn pairs from ``noise`` drawn tokens, with AdaGrad."""
    rng = np.random.default_rng(seed)
    unigram = np.bincount(pair % OUTPUTS, n, OUTPUTS) + 0.5
    unigram[START] = 1e-3
    unigram /= unigram.sum()
    log_noise = np.log(noise * unigram).astype(np.float32)
    seen, drawn_noise = np.cumsum(n), np.cumsum(unigram)
    context, output = (rng.normal(0, 0.1, (OUTPUTS, size)).astype(np.float32) for _ in range(2))
    bias = np.log(unigram).astype(np.float32)
    paces = [np.full((OUTPUTS, 1), 1e-3, np.float32), np.full((OUTPUTS, 1), 1e-3, np.float32), np.full(OUTPUTS, 1e-3, np.float32)]
    for _ in range(steps if len(pair) else 0):
        drawn = pair[np.searchsorted(seen, rng.integers(0, seen[-1], batch), side="right")]
        before, token = drawn // OUTPUTS, drawn % OUTPUTS
        other = np.minimum(np.searchsorted(drawn_noise, rng.random(noise)), OUTPUTS - 1)
        c, t, o = context[before], output[token], output[other]
        true = (c * t).sum(1) + bias[token] - log_noise[token]
        false = c @ o.T + (bias[other] - log_noise[other])
        true = 1 / (1 + np.exp(-np.clip(true, -30, 30))) - 1  # from here on gradients by the score
        false = 1 / (1 + np.exp(-np.clip(false, -30, 30)))
        g_context, g_output = np.zeros_like(context), np.zeros_like(output)
        np.add.at(g_context, before, true[:, None] * t + false @ o)
        np.add.at(g_output, token, true[:, None] * c)
        np.add.at(g_output, other, false.T @ c)
        g_bias = (np.bincount(token, true, OUTPUTS) + np.bincount(other, false.sum(0), OUTPUTS)).astype(np.float32)
        for x, pace, g in zip((context, output, bias), paces, (g_context, g_output, g_bias), strict=True):
            pace += (g * g).mean(1, keepdims=True) if g.ndim > 1 else g * g
            x -= rate * g / np.sqrt(pace)
    normaliser = np.empty(OUTPUTS, np.float32)
    for begin in range(0, OUTPUTS, 512):
        score = context[begin : begin + 512] @ output.T + bias
        score[:, START] = -np.inf  # never an output
        top = score.max(1, keepdims=True)
        normaliser[begin : begin + 512] = (top + np.log(np.exp(score - top).sum(1, keepdims=True)))[:, 0]
    return LogBilinear(context, output, bias, normaliser)


def fit(docs: DataFrame, trainable: Column) -> tuple[LanguageModel, DataFrame]:
    """The model, and the staged table of all token counts, learned from the rows of ``docs`` where ``trainable`` holds."""
    texts = docs.where(trainable).select(utf8().alias("text"))
    counts = stage(token_counts(texts), "token-counts")
    tail = F.crc32(F.substring(F.col("token"), -2, 2)) % TAIL
    sums = counts.groupBy(F.when(F.length("token") > 0, tail).alias("tail")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    n, v = sum(r.n for r in sums), sum(r.v for r in sums)
    got = most_frequent(counts.where(F.length("token") > 0), "token", "c", HEAD).toArrow()
    top = list(zip(got.column("token").to_pylist(), got.column("c").to_pylist(), strict=True))
    top.sort(key=lambda x: (-x[1], x[0]))
    rest = np.ones(OUTPUTS)  # one unseen word
    for r in sums:
        if r.tail is not None:
            rest[OUTPUTS - TAIL + r.tail] += r.n + r.v
    for word, c in top[:WORDS]:  # these are outputs of their own
        rest[tail_class(word)] -= c + 1
    log_rest = np.where(np.arange(OUTPUTS) < OUTPUTS - TAIL, 0.0, -np.log10(rest))
    ends = next((r.n for r in sums if r.tail is None), 0)
    cls = np.array([END, *(END + 1 + i if i < WORDS else tail_class(w) for i, (w, _) in enumerate(top)), 0])
    log_count = np.log10(np.array([ends, *(c for _, c in top), 0]) + 1.0)
    log_share = np.where(cls < OUTPUTS - TAIL, 0.0, log_count + log_rest[cls])
    head = Head({END_TOKEN: 0} | {w: i + 1 for i, (w, _) in enumerate(top)}, cls.astype(np.int32), log_count, log_share, log_rest)
    return LanguageModel(n, v, head, fit_nce(*pair_counts(texts, head))), counts


def score(docs: DataFrame, model: LanguageModel, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        import uuid

        m: LanguageModel = sent.value
        mark = uuid.uuid4().int & (2**63 - 1)  # of this task attempt; the rows are staged before anything joins by uid
        for rows, words, starts in chunks(batches):
            at, cls = m.head.classes(words)
            there = at >= 0
            logs = m.neural.log_p(contexts(cls, starts), cls)
            logs += np.where(there, m.head.log_share[at], m.head.log_rest[cls])
            sums = [np.add.reduceat(x, starts) for x in (np.where(there, m.head.log_count[at], 0.0), logs, (there & (m.head.log_count[at] > 0)).astype(np.int64))]
            ends = np.append(starts[1:], len(words))
            missing = np.flatnonzero(~there)
            cut = np.searchsorted(missing, ends)
            lists, begin = [], 0
            for end in cut:
                lists.append([words[i] for i in missing[begin:end]])
                begin = end
            uids = [(mark + i) & (2**63 - 1) for i in range(len(rows))]
            mark += len(rows)
            yield {"uid": uids, "doc_id": [r[0] for r in rows], "n_tokens": ends - starts, "head_count": sums[0], "head_score": sums[1], "head_known": sums[2], "rest": lists}

    ddl = "uid long, doc_id long, n_tokens long, head_count double, head_score double, head_known long, rest array<binary>"
    rows = stage(arrow_map(docs.select(F.col("doc_id").cast("long"), utf8().alias("text")), run, ddl), "lm-rows")
    rare = rows.select("uid", F.explode("rest").alias("token")).join(counts, "token")
    rare = rare.groupBy("uid").agg(F.sum(F.log10(F.col("c") + 1)).alias("rare_count"), F.count("*").alias("rare_known"))
    none = F.lit(0)
    log_all = float(np.log10(model.train_tokens + model.train_words + 1))
    return rows.drop("rest").join(rare, "uid", "left").select(
        "doc_id", "n_tokens",
        (F.col("head_known") + F.coalesce("rare_known", none)).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("head_count") + F.coalesce("rare_count", none) - F.col("n_tokens") * log_all).alias("base_score"),
        (F.col("head_score") + F.coalesce("rare_count", none)).alias("score"),
    )


def op9(docs: DataFrame) -> DataFrame:
    """The contract's query: learn from six sevenths of the documents, score all."""
    model, counts = fit(docs, id_bucket("doc_id", 7) != 2)
    found = score(docs, model, counts)
    return found.select("doc_id", (id_bucket("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
