"""MinHash near-dedup with odd sketches: banded candidates, judged by parity bitmaps, confirmed on full sets.

Documents with one set of word shingles are one set from the start, known by its 128-bit digest.

1. A set has BANDS bands of ROWS MinHash values each (random multiplicative permutations); sets that agree in a whole
   band share a bucket. At a similarity of 0.85 a link is missed with a chance of 1.2e-5.
2. Its odd sketch is a bitmap of BITS parities: the SAMPLE least shingle hashes (a bottom-k MinHash sample, the whole set
   up to that size) each flip one bit. The XOR of two sketches has at most as many ones as the samples have differences,
   so more ones than similar sets may have rule a pair out: always rightly while both sets are whole in their samples,
   else with six standard deviations of the sample to spare.
3. Buckets of near copies in thousands would give pairs in millions, so a round tries each set against one set of
   another class a bucket (the least id first, then drawn ones), and keeps the candidate of least XOR count. Candidates
   are verified on the full shingle sets, links are united (``jaccard.linked``, ``jaccard.contract``). Rounds go on while
   they find links and the pairs left are many. Then, in buckets with more than one class, every set outside the bucket's
   largest class meets all sets of other classes there, so a link between classes can't be missed but for the chance
   above; a class itself is never paired out.

Scale: BANDS short rows a set are shuffled; only sets that share a bucket carry their sketch further, texts move for
candidates alone, and nothing about single documents reaches the driver.

Defined results: null, empty or blank text has the empty set, is linked with nothing and is its own class; a text with
fewer words than a shingle is one shingle; equal rows are linked; rows that share an id but not a text are documents of
their own; a null id is a class's id only if all its ids are null; texts of any length are read whole; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, release, stage, staged_so_far
from .jaccard import Shingler, contract, distinct_sets, keyed, keys, linked

BANDS, ROWS = 24, 6
BITS, SAMPLE = 512, 1024
#: Pairs a bucket entry that may be left to the last step while rounds still find links (a comparison of two sketches
#: is far cheaper than what a round moves).
LEFT = 256
_rng = np.random.default_rng(23)
_FACTORS = (_rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1))[:, None]
_TURNS = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)[:, None]
_MIX, _BIT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BAND = np.arange(1, BANDS + 1, dtype=np.uint64)
#: Shingles whose permutations are computed at once.
_BLOCK = 512


def bands(shingles: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band's number and MinHash values."""
    x = ((shingles * _MIX) >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), _BLOCK):
        np.minimum(least, ((x[i : i + _BLOCK] ^ _TURNS) * _FACTORS).min(1), out=least)
    h = _BAND.copy()
    for column in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        h = (h ^ column) * _MIX
        h ^= h >> np.uint64(29)
    return h


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the least SAMPLE of the sorted hashes, as BITS / 64 integers."""
    places = ((shingles[:SAMPLE] * _BIT) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def sketched(texts: DataFrame, k: int) -> DataFrame:
    """doc_id, k, th, n_shingles, digest, grp (the digest again), bands and sketch (null where the set is empty); staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        shingles = Shingler(k)
        for batch in batches:
            sets = [shingles(text.as_py()) for text in batch.column(3)]
            digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield {
                "doc_id": batch.column(0), "k": batch.column(1), "th": batch.column(2), "n_shingles": [len(s) for s in sets], "digest": digest, "grp": digest,
                "bands": [bands(s).view(np.int64) if len(s) else None for s in sets], "sketch": [odd_sketch(s) if len(s) else None for s in sets],
            }

    return stage(arrow_map(texts, run, "doc_id long, k long, th long, n_shingles long, digest binary, grp binary, bands array<long>, sketch array<long>"), "sketches")


def ones_apart(a: Column, b: Column) -> Column:
    """The population count of the XOR of two sketches."""
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, BITS // 64)), F.bit_count(a[0].bitwiseXOR(b[0])))


def ones_allowed(n: Column, m: Column, percent: int) -> Column:
    """The greatest XOR count of sketches of similar sets of these sizes; below 0 if no such sets are similar."""
    both, most = F.ceil(percent * (n + m) / (100 + percent)), F.greatest(n, m)
    share = F.least(F.lit(1.0), SAMPLE / most)
    common = both / most
    spare = F.when(most > SAMPLE, 6 * F.sqrt(SAMPLE * common * F.greatest(F.lit(0.0), 1 - common))).otherwise(0)
    limit = F.least(n, F.lit(SAMPLE)) + F.least(m, F.lit(SAMPLE)) - 2 * (both * share - spare)
    return F.when(100 * F.least(n, m) < percent * most, -1).otherwise(limit)


def star(index: DataFrame, roots: DataFrame | None, turn: int, percent: int) -> DataFrame:
    """a, b: each set with the one of its buckets' centres, of another class, whose sketch is nearest."""
    if roots is None:
        own = index.withColumn("root", F.col("rid"))
    else:
        own = index.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    place = F.struct((F.xxhash64("root", F.lit(turn)) if turn > 1 else F.col("least")).alias("by"), "root", "rid", "n", "sketch")
    ends = own.groupBy("bucket").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1")
    met = own.join(ends, "bucket").withColumn("to", F.when(F.col("root") == F.col("lo")["root"], F.col("hi")).otherwise(F.col("lo"))).where(F.col("root") != F.col("to")["root"])
    met = met.withColumn("apart", ones_apart(F.col("sketch"), F.col("to")["sketch"])).where(F.col("apart") <= ones_allowed(F.col("n"), F.col("to")["n"], percent))
    best = met.groupBy("rid").agg(F.min(F.struct("apart", F.col("to")["rid"].alias("to"))).alias("best"))
    return best.select(F.least("rid", "best.to").alias("a"), F.greatest("rid", "best.to").alias("b")).distinct()


def classes(rows: DataFrame, sets: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """node, root: for each set that is linked with another, the least set of its class."""
    named = sets.select("rid", F.col("n_shingles").alias("n"), "rep.k", "rep.th", F.coalesce("rep.doc_id", F.lit(2**63 - 1)).alias("least"))
    lists = stage(rows.where("digest IS NOT NULL").select("k", "th", "bands", "sketch").join(named, ["k", "th"]).select("rid", "n", "least", "bands", "sketch").dropDuplicates(["rid"]), "lists")
    every = lists.select("rid", F.explode("bands").alias("bucket"))
    shared = every.groupBy("bucket").agg(F.count("*").alias("times")).where("times > 1").select("bucket")
    index = stage(every.join(shared, "bucket").join(lists.drop("bands"), "rid"), "buckets")
    entries = index.count()

    links = tried = roots = None
    turn = 0
    while True:
        pairs = star(index, roots, turn, percent)
        pairs = stage(pairs.join(tried, ["a", "b"], "left_anti") if turn else pairs, "pairs")
        tried = tried.union(pairs) if turn else pairs
        more = stage(linked(pairs, sets, texts, k, percent), "links")
        links, turn = links.union(more) if turn else more, turn + 1
        roots = contract(links)
        own = index.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
        by_class = own.groupBy("bucket", "root").agg(F.count("*").alias("c"))
        main = by_class.groupBy("bucket").agg(F.max(F.struct("c", "root")).alias("main"), F.sum("c").alias("all"), F.count("*").alias("classes")).where("classes > 1")
        main = stage(main.select("bucket", "main.root", (F.col("all") - F.col("main.c")).alias("rest"), "all").withColumnRenamed("root", "main"), "open")
        left = main.agg(F.sum(F.col("rest").cast("double") * F.col("all"))).first()[0] or 0
        if left <= LEFT * entries or more.isEmpty():
            break
    x = own.join(main.select("bucket", "main"), "bucket").where("root != main").alias("x")
    y = own.join(main.select("bucket", "main"), "bucket").alias("y")
    near = ones_apart(F.col("x.sketch"), F.col("y.sketch")) <= ones_allowed(F.col("x.n"), F.col("y.n"), percent)
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.rid") < F.col("y.rid"))
    met = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.root") != F.col("y.root")) & once & near)
    met = met.select(F.least("x.rid", "y.rid").alias("a"), F.greatest("x.rid", "y.rid").alias("b")).distinct()
    pairs = stage(met.join(tried, ["a", "b"], "left_anti"), "pairs")
    more = stage(linked(pairs, sets, texts, k, percent), "links")
    return roots if more.isEmpty() else contract(links.union(more))


def classed(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows, and digest and best of every set that isn't empty; best: the class's row of least id, then text hash."""
    mark = staged_so_far()
    texts = keyed(docs)
    rows = sketched(texts, k)
    sets = distinct_sets(rows)
    roots = classes(rows, sets, texts, k, percent)
    own = sets.join(roots.withColumnRenamed("node", "rid"), "rid", "left").select("digest", "rep", F.coalesce("root", "rid").alias("root"))
    best = stage(own.groupBy("root").agg(F.min("rep").alias("best")), "best")
    found = stage(own.select("digest", "root").join(best, "root").select("digest", "best"), "classes")
    release(mark, rows, found)
    return rows, found


def components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the least id of the class) of every row."""
    rows, found = classed(docs, k, percent)
    joined = rows.select("doc_id", "n_shingles", "digest").join(found, "digest", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"))


def dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Of each class the row of ``docs`` with the least id, then text hash (of equal rows one); all rows without words."""
    _, found = classed(docs, k, percent)
    whole = docs.select(*keys(), F.struct("*").alias("whole"))  # an extra column of any name does no harm
    chosen = whole.join(found.select("best.k", "best.th").distinct(), ["k", "th"], "left_semi").dropDuplicates(["k", "th"])
    blank = F.regexp_like(F.coalesce("text", F.lit("")), F.lit("^[ \\t\\n\\x0B\\f\\r]*$"))
    return chosen.select("whole.*").union(docs.where(blank))


def op11(docs: DataFrame) -> DataFrame:
    found = components(docs, 3, 85)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
