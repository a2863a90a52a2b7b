"""Benchmark decontamination: a prefix-filtered join of documents with the word windows of benchmark items.

A window (``window`` consecutive item words, or the whole of a shorter item) is a set of two-word shingles. For exact
containment one shingle of the window must be in the text, so the join prefix of a window is its rarest shingle alone;
rarity is the shingle's number of occurrences in all documents. Where a prefix shingle occurs in a text, the shingle's
position in the window and both lengths bound where the window would lie, and the words there are compared with the
window's own. Every surviving place is an exact occurrence.

Scale: the documents are only mapped over. The windows are broadcast in blocks of at most ``BLOCK_WORDS`` item words,
a size that is checked; a longer item is cut into parts that overlap by a window. One block (the usual case) needs no
shuffle; more blocks are more passes over the documents, one block at a time on the driver and in the workers, whose
hits are brought together by document.

Defined results: null or wordless texts have no words and no hits; items without words are left out; an item
with a null id counts for hits and contamination, not for n_items and items_sha256; item rows that repeat count once;
repeated documents each get their own row; texts of any length are read whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, stage, utf8

#: Item words in a broadcast block (about half a KB each as Python objects).
BLOCK_WORDS = 200_000
#: Lower-cases A-Z, keeps a-z, 0-9 and all bytes of non-ASCII characters, and blanks the rest.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def windows(item: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    """The item's windows in order; a shorter item is one window, an empty one none."""
    if len(item) < size:
        return [tuple(item)] if item else []
    return [tuple(item[i : i + size]) for i in range(len(item) - size + 1)]


def shingles(window: tuple[bytes, ...]) -> list[tuple[bytes, ...]]:
    return list(zip(window, window[1:], strict=False)) or [window]


class WindowIndex:
    """Windows by first word and shingle of their join prefix."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], size: int, frequency: dict[tuple[bytes, ...], int]) -> None:
        self.by_word: dict[bytes, dict[tuple[bytes, ...], list[tuple[int, tuple[bytes, ...], tuple[str, ...]]]]] = defaultdict(lambda: defaultdict(list))
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item_id, item in items:
            for w in windows(item, size):
                owners[w] |= set() if item_id is None else {item_id}
        for w, ids in owners.items():
            parts = shingles(w)
            at = min(range(len(parts)), key=lambda i: (frequency.get(parts[i], 0), parts[i], i))
            self.by_word[parts[at][0]][parts[at]].append((at, w, tuple(ids)))
        self.by_word = {k: dict(v) for k, v in self.by_word.items()}  # plain, for pickling
        self.first = frozenset(self.by_word)

    def hits(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans [start, end) of the windows that occur, and the items they are of."""
        first, spans, found = self.first, [], set()
        if first.isdisjoint(text):
            return spans, found
        for i, word in enumerate(text):
            if word not in first:
                continue
            prefixes = self.by_word[word]
            for prefix in ((word,), (word, text[i + 1])) if i + 1 < len(text) else ((word,),):
                for at, window, ids in prefixes.get(prefix, ()):
                    start = i - at
                    end = start + len(window)
                    if start >= 0 and end <= len(text) and tuple(text[start:end]) == window:
                        spans.append((start, end))
                        found.update(ids)
        return spans, found


def covered(spans: list[tuple[int, int]]) -> int:
    """How many words lie in any of the spans."""
    total, reach = 0, 0
    for start, end in sorted(spans):
        if end > reach:
            total += end - max(start, reach)
            reach = end
    return total


def item_blocks(benchmark: DataFrame, size: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items in blocks of bounded size, streamed to the driver one partition at a time."""
    block, n = [], 0
    rows = benchmark.where(F.col("text").isNotNull())
    for row in rows.select(F.col("item_id").cast("string").alias("item_id"), utf8().alias("text")).distinct().toLocalIterator():
        item = words(bytes(row.text))
        for start in range(0, max(1, len(item) - size + 1), BLOCK_WORDS):
            part = item[start : start + BLOCK_WORDS + size - 1]
            if part:
                block.append((row.item_id, part))
                n += len(part)
            if n >= BLOCK_WORDS:
                yield block
                block, n = [], 0
    if block:
        yield block


def corpus_frequency(docs: DataFrame, items: list[tuple[str, list[bytes]]], size: int) -> dict[tuple[bytes, ...], int]:
    """Occurrences in all documents of the block's shingles."""
    wanted = {s for _, item in items for w in windows(item, size) for s in shingles(w)}
    order = sorted(wanted)
    sent = docs.sparkSession.sparkContext.broadcast(({s: i for i, s in enumerate(order)}, frozenset(s[0] for s in order)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        index, first = sent.value
        seen: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0):
                ws = words(text.as_py())
                for i, word in enumerate(ws):
                    if word in first:
                        for s in ((word,), (word, ws[i + 1])) if i + 1 < len(ws) else ((word,),):
                            if s in index:
                                seen[index[s]] += 1
        yield {"shingle": list(seen), "n": list(seen.values())}

    got = arrow_map(docs.select(utf8().alias("text")), count, "shingle int, n long").groupBy("shingle").agg(F.sum("n").alias("n")).collect()
    return {order[r.shingle]: r.n for r in got}


def _ahead(blocks: Iterator[list]) -> Iterator[tuple[list, bool]]:
    """Each block, and whether it is the only one."""
    first = next(blocks, None)
    if first is not None:
        second = next(blocks, None)
        yield first, second is None
        if second is not None:
            yield second, False
            yield from ((b, False) for b in blocks)


def hits(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs``."""
    spark = docs.sparkSession
    keyed = found = None
    for items, only in _ahead(item_blocks(benchmark, size)):
        sent = spark.sparkContext.broadcast(WindowIndex(items, size, corpus_frequency(docs, items, size)))
        if only:
            return _one_block(docs, sent)
        if keyed is None:
            keyed = stage(docs.select(F.col("doc_id").cast("long"), utf8().alias("text")).withColumn("row", F.monotonically_increasing_id()), "decontam-rows")
        part = stage(_spans(keyed, sent), "decontam-spans")
        sent.destroy()
        found = part if found is None else found.union(part)
    if keyed is None:
        return _one_block(docs, None)
    base = _one_block(keyed, None, ("doc_id", "row"))
    merged = found.groupBy("row").applyInPandas(_merge, "row long, hit long, items array<string>")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return base.join(merged, "row", "left").select(
        "doc_id", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"),
    )


def _merge(pdf):  # noqa: ANN001, ANN202 (pandas): a document's spans from all blocks
    import pandas as pd

    spans = [tuple(s) for row in pdf["spans"] for s in zip(row[::2], row[1::2], strict=True)]
    return pd.DataFrame({"row": pdf["row"][:1], "hit": [covered(spans)], "items": [sorted({x for row in pdf["items"] for x in row})]})


def _spans(docs: DataFrame, sent) -> DataFrame:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = {"row": [], "spans": [], "items": []}
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                spans, ids = sent.value.hits(words(text.as_py()))
                if spans:
                    out["row"].append(row)
                    out["spans"].append([x for s in spans for x in s])
                    out["items"].append(list(ids))
            yield out

    return arrow_map(docs.select("row", "text"), run, "row long, spans array<int>, items array<string>")


def _one_block(docs: DataFrame, sent, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            n_words, n_hit, n_items, digest = [], [], [], []
            for text in batch.column(len(carry)):
                ws = words(text.as_py())
                spans, ids = sent.value.hits(ws) if sent else ([], set())
                n_words.append(len(ws))
                n_hit.append(covered(spans))
                n_items.append(len(ids))
                digest.append(hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest())
            yield {c: batch.column(i) for i, c in enumerate(carry)} | {
                "n_words": n_words, "n_hit": n_hit, "n_items": n_items, "items_sha256": digest, "contaminated": [n > 0 for n in n_hit],
            }

    ddl = ", ".join(f"{c} long" for c in carry) + ", n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return arrow_map(docs.select(*(F.col(c).cast("long").alias(c) for c in carry), utf8().alias("text")), run, ddl)


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of an item.

    One block of items is a map. Of more blocks each gives the hashes of the texts that it hits; those rows go at the end.
    """
    at, bad = docs.columns.index("text"), None
    th = F.xxhash64(F.coalesce("text", F.lit("")), F.lit(1)), F.xxhash64(F.coalesce("text", F.lit("")), F.lit(2))
    for items, only in _ahead(item_blocks(benchmark, size)):
        sent = docs.sparkSession.sparkContext.broadcast(WindowIndex(items, size, corpus_frequency(docs, items, size)))

        def run(batches: Iterator[pa.RecordBatch], at: int = at, hit: bool = False, sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                found = [bool((t := text.as_py()) and sent.value.hits(words(t.encode()))[0]) for text in batch.column(at)]
                yield batch.filter(pa.array([x == hit for x in found], pa.bool_()))

        if only:
            return docs.mapInArrow(run, docs.schema)
        texts = docs.select("text", th[0].alias("t1"), th[1].alias("t2"))
        part = stage(texts.mapInArrow(lambda b, run=run: run(b, 0, True), texts.schema).select("t1", "t2").distinct(), "decontam-hit")
        sent.destroy()
        bad = part if bad is None else bad.union(part)
    if bad is None:
        return docs
    whole = docs.select(F.struct("*").alias("whole"), th[0].alias("t1"), th[1].alias("t2"))
    return whole.join(bad.distinct(), ["t1", "t2"], "left_anti").select("whole.*")


def op7(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return hits(docs, benchmark, 10)
