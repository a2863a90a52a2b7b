"""Best-fit packing of documents into bins of fixed length, under conflicts.

Documents are cut into pieces of at most ``capacity`` tokens; pieces are placed in the order of falling length. A bin
carries bitmaps of what it holds: one of duplicate clusters (no two pieces of a cluster share a bin; a document that
occurs once is in no cluster) and ``per_source`` of sources (a bin holds at most that many documents of a source; bitmap
j says which sources it holds j + 1 times). Bins are ordered by what is left in them, and bins with the same left and
the same bitmaps are one class. For a piece the search starts at the bins with just enough room and goes on to the
successor until it finds a compatible class: the tightest compatible bin. A class that conflicts is passed as a whole,
so thousands of bins with one cluster or a full source cost one step. If there is no compatible bin, one is opened.

By default ``per_source`` follows the corpus: about as many documents as its most frequent source has in a bin's worth
of tokens, two at least.

Scale: lengths and cluster digests come from one map over whole texts; only (id, source, cluster, length) is shuffled,
and the words where the packed texts are asked for (a shard has about 2^20 of them, and whole documents).
Documents are dealt by a hash of the id to shards of about ``shard_tokens`` tokens, packed each in one task, so no
source, cluster or key decides how much a task gets; the conflicts hold in every bin all the same. Shards grow in
number with the corpus, not in size.

Defined results: null and empty texts have one token (the end); a null source is a source of its own; equal rows are
copies of each other; pieces of one length are placed in the order of id, then cluster; a document longer than a bin
fills bins of its own and its rest is packed as a piece; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, id_key, stage, utf8

CAPACITY = 2048
SHARD_TOKENS = 1 << 20


@dataclass
class Bin:
    id: int
    left: int
    clusters: int = 0
    sources: list[int] = field(default_factory=list)


class Bins:
    """Open bins by what is left in them, then full sources, then clusters, with a bitmap of the sizes that occur."""

    def __init__(self, capacity: int, per_source: int) -> None:
        self.capacity, self.per_source = capacity, per_source
        self.by_left: list[dict[int, dict[int, list[Bin]]]] = [{} for _ in range(capacity + 1)]
        self.sizes, self.count = 0, 0

    def place(self, need: int, source: int, cluster: int | None) -> Bin:
        """The tightest bin with room that holds neither the cluster nor the source too often; or a new one."""
        above, bit = self.sizes >> need, 0 if cluster is None else 1 << cluster
        while above:
            left = need + (above & -above).bit_length() - 1
            for full, classes in self.by_left[left].items():
                if not full >> source & 1 and (held := next((c for c in classes if not c & bit), None)) is not None:
                    return self._put(self._take(left, full, held), need, source, bit)
            above &= above - 1
        self.count += 1
        return self._put(Bin(self.count - 1, self.capacity, 0, [0] * self.per_source), need, source, bit)

    def _take(self, left: int, full: int, clusters: int) -> Bin:
        at = self.by_left[left]
        found = at[full][clusters].pop()
        if not at[full][clusters]:
            del at[full][clusters]
            if not at[full]:
                del at[full]
                if not at:
                    self.sizes &= ~(1 << left)
        return found

    def _put(self, b: Bin, need: int, source: int, bit: int) -> Bin:
        b.left -= need
        b.clusters |= bit
        for j, held in enumerate(b.sources):
            if not held >> source & 1:
                b.sources[j] = held | 1 << source
                break
        if b.left:
            self.by_left[b.left].setdefault(b.sources[-1], {}).setdefault(b.clusters, []).append(b)
            self.sizes |= 1 << b.left
        return b


def pack(rows: list[tuple], capacity: int, per_source: int) -> list[tuple[int, int, int, int, int]]:
    """(row, piece, start, n_tokens, bin) for rows of (order, source, cluster, n_tokens)."""
    sources: dict = {}
    clusters: dict = {}
    copies = Counter(cluster for _, _, cluster, _ in rows)
    pieces = []
    for i, (order, source, cluster, n) in enumerate(rows):
        s = sources.setdefault(source, len(sources))
        c = clusters.setdefault(cluster, len(clusters)) if copies[cluster] > 1 else -1
        for piece, start in enumerate(range(0, n, capacity)):
            pieces.append((-min(capacity, n - start), order, piece, start, i, s, c))
    pieces.sort()
    bins = Bins(capacity, per_source)
    return [(i, piece, start, -need, bins.place(-need, s, c if c >= 0 else None).id) for need, _, piece, start, i, s, c in pieces]


def lengths(docs: DataFrame, texts: bool = False) -> DataFrame:
    """row, doc_id, k, source, cluster, n_tokens (and text: the words, joined by blanks) of every row; staged. Tokens:
    words between ASCII blanks, and one end.

    cluster: the digest of the lower-cased words, so copies up to case and blanks are duplicates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: Counter[tuple] = Counter()  # of equal rows, so that they are dealt apart
        for batch in batches:
            n, digest, row = [], [], []
            for k, text in zip(batch.column(1).to_pylist(), batch.column(3), strict=True):
                words = text.as_py().lower().split()
                n.append(len(words) + 1)
                digest.append(xxhash.xxh3_128_digest(b" ".join(words)))
                row.append(xxhash.xxh3_64_intdigest(digest[-1], (k + seen[k]) & (2**64 - 1)) >> 1)
                seen[k] += 1
            said = {"text": [b" ".join(text.as_py().split()).decode() for text in batch.column(3)]} if texts else {}
            yield {**said, "row": row, "doc_id": batch.column(0), "k": batch.column(1), "source": batch.column(2), "n_tokens": n, "cluster": digest}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_key().alias("k"), F.col("source").cast("string").alias("source"), utf8().alias("text"))
    return stage(arrow_map(rows, run, "row long, doc_id long, k long, source string, n_tokens long, cluster binary" + ", text string" * texts), "lengths")


def best_fit(rows: DataFrame, *, capacity: int = CAPACITY, per_source: int | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, piece, start, n_tokens, shard, bin of every piece of ``rows`` (as of ``lengths``); and text, if they have it."""
    texts = "text" in rows.columns
    by_source = rows.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs"))
    total, most = by_source.agg(F.sum("n"), F.max("docs")).first()
    total = total or 0
    shards = max(1, -(-total // shard_tokens))
    if per_source is None:
        per_source = max(2, -(-capacity * (most or 0) // max(1, total)))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = table.sort_by([("k", "ascending"), ("cluster", "ascending")])
        got = list(zip(range(order.num_rows), order.column("source").to_pylist(), order.column("cluster").to_pylist(), order.column("n_tokens").to_pylist(), strict=True))
        placed = pack(got, capacity, per_source)
        ids = order.column("doc_id").to_pylist()
        i, piece, start, n, b = zip(*placed, strict=True)
        words = [t.split(" ") for t in order.column("text").to_pylist()] if texts else []
        said = {"text": pa.array([" ".join(words[x][a : a + m]) for x, a, m in zip(i, start, n, strict=True)], pa.string())} if texts else {}
        return pa.table({
            "doc_id": pa.array([ids[x] for x in i], pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
            "n_tokens": pa.array(n, pa.int64()), "shard": pa.array([key[0].as_py()] * len(i), pa.int64()), "bin": pa.array(b, pa.int32()), **said,
        })

    return dealt.groupBy("shard").applyInArrow(run, "doc_id long, piece int, start long, n_tokens long, shard long, bin int" + ", text string" * texts)


def op10(docs: DataFrame) -> DataFrame:
    return best_fit(lengths(docs))
