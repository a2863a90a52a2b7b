"""N-gram Jaccard join: which documents' shingle sets are similar, by a grouped prefix join, and their classes.

Sets of word shingles (as 64-bit hashes) are equal only together, so documents with one set are one *set* from the
start, known by the 128-bit digest of its shingles and numbered once; document ids play no part until the classes are
found. With sets ordered by rarity, two sets of similarity ``t`` share one of the first ``n - ceil(t * n) + 1`` shingles
of each (their prefixes).

1. Rarity: frequent shingles are counted over all documents by lossy counting in each task and a sum; the ``RARITY``
   most frequent (a fixed bound) are broadcast and come last in the order, the others follow their hash. Any order is
   right; this one keeps common passages out of the prefixes.
2. Sets with one prefix and one size are a group. Groups are what the prefix index holds and what pairs are made of,
   filtered by size, by the overlap that the positions in the prefixes still allow, and by how many prefix shingles
   similar sets of their sizes must share. Groups are expanded to their
   members for verification, which intersects the whole sets.
3. Near copies in thousands would give pairs in millions, so the pairs of a prefix shingle are first tried against one
   of its sets only ("star"), verified, and united into classes. The centre is the set of least id in the first two
   rounds; more rounds with centres drawn by a hash of the class, up to ``STARS``, follow only while the pairs that are
   left are over ``LEFT`` times the prefix entries. Then every pair of groups that share a prefix shingle *and are not yet in one
   class* is verified. No link between different classes can be missed: any pair left out is in one class already.

Scale: one row a prefix shingle is shuffled (a tenth of the shingles at 0.9), each set travels once a verification
round, joins on hot keys are split by adaptive execution, and classes are found by alternating star contractions over
staged tables. Nothing about single documents reaches the driver.

Defined results: null, empty or blank text has the empty set, is linked with nothing and is its own class; a text with
fewer words than a shingle is one shingle; equal rows are linked; rows that share an id but not a text are documents of
their own, linked only by their sets; a null id is never a class's id unless all are null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, arrow_map, most_frequent, release, stage, staged_so_far, utf8

#: Shingles whose frequency is broadcast.
RARITY = 1 << 17
#: A task keeps the shingles seen this often among COUNTED shingles.
COUNTED, SEEN = 1_000_000, 3
#: Rounds of stars at most; more or fewer rounds change the work, not the classes.
STARS, LEFT = 6, 64
#: Candidates whose keys may be broadcast to fetch their texts; beyond it they are joined.
FEW = 1 << 20
#: Words whose hashes a task remembers.
KNOWN_WORDS = 1 << 18
_MUL = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


class Shingler:
    """Hashed shingle sets of texts.

    A word's hash is 64 bits of BLAKE2b, a cryptographic hash, so that no two words can be made up to agree.
    """

    def __init__(self, k: int) -> None:
        self.k = k
        self._hash = _WordHashes()

    def word_hashes(self, text: bytes) -> np.ndarray:
        """Of the words between the six ASCII blanks, A-Z lower-cased (``lower`` and ``split`` of bytes know ASCII only)."""
        words = text.lower().split()
        return np.fromiter(map(self._hash.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: bytes) -> np.ndarray:
        """The sorted distinct shingle hashes."""
        h = self.word_hashes(text)
        if not len(h):
            return h
        span = min(self.k, len(h))
        out = np.full(len(h) - span + 1, span, np.uint64)
        for i in range(span):
            out = (out ^ h[i : len(h) - span + 1 + i]) * _MUL[i % 3]
            out ^= out >> np.uint64(31)
        out.sort()
        fresh = np.ones(len(out), bool)
        np.not_equal(out[1:], out[:-1], out=fresh[1:])
        return out[fresh]


def frequent_shingles(texts: DataFrame, k: int) -> np.ndarray:
    """The most frequent shingles' hashes, least frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        shingles, parts, total = Shingler(k), [], 0
        for batch in batches:
            for text in batch.column(0):
                parts.append(shingles(text.as_py()))
                total += len(parts[-1])
                if total > COUNTED:
                    yield _often(parts)
                    parts, total = [], 0
        if parts:
            yield _often(parts)

    mark = staged_so_far()
    counts = arrow_map(texts.select("text"), run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    top = most_frequent(stage(counts, "shingle-counts"), "hash", "n", RARITY).toArrow().sort_by([("n", "ascending"), ("hash", "descending")])
    release(mark)
    return top.column("hash").to_numpy().view(np.uint64)


def _often(parts: list[np.ndarray]) -> dict:
    h, n = np.unique(np.concatenate(parts), return_counts=True)
    return {"hash": h[n >= SEEN].view(np.int64), "n": n[n >= SEEN]}


class Order:
    """Rarity: shingles that aren't frequent by hash, then the frequent ones by frequency."""

    def __init__(self, frequent: np.ndarray) -> None:
        self.rank = np.argsort(frequent)
        self.sorted = frequent[self.rank]

    def prefix(self, shingles: np.ndarray, size: int) -> np.ndarray:
        if not len(self.sorted):
            return shingles[:size]
        at = np.minimum(np.searchsorted(self.sorted, shingles), len(self.sorted) - 1)
        common = self.sorted[at] == shingles
        rare = shingles[~common]
        if len(rare) >= size:
            return rare[:size]
        return np.concatenate([rare, shingles[common][np.argsort(self.rank[at[common]], kind="stable")]])[:size]


def prefix_length(n: int, percent: int) -> int:
    return n - (n * percent + 99) // 100 + 1


def keys() -> list[Column]:
    """What finds a row's text again: k (the id, 0 for null) and th (a hash of the text)."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, k, th and the text's bytes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keys(), utf8().alias("text"))


def set_rows(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, k, th, n_shingles, digest, grp and prefix (null where the set is empty) of every row; staged."""
    sent = texts.sparkSession.sparkContext.broadcast(Order(frequent_shingles(texts, k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        shingles = Shingler(k)
        for batch in batches:
            sets = [shingles(text.as_py()) for text in batch.column(3)]
            prefix = [sent.value.prefix(s, prefix_length(len(s), percent)).view(np.int64) if len(s) else None for s in sets]
            yield {
                "doc_id": batch.column(0), "k": batch.column(1), "th": batch.column(2), "n_shingles": [len(s) for s in sets], "prefix": prefix,
                "digest": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "grp": [xxhash.xxh3_128_digest(p.tobytes(), len(s)) if len(s) else None for p, s in zip(prefix, sets, strict=True)],
            }

    return stage(arrow_map(texts, run, "doc_id long, k long, th long, n_shingles long, digest binary, grp binary, prefix array<long>"), "sets")


def distinct_sets(rows: DataFrame) -> DataFrame:
    """rid (a number), digest, n_shingles, grp and rep of every set that isn't empty; staged, so the numbers stand.

    rep: of the set's rows the one of least id, then text hash, and how many rows are equal to it.
    """
    alike = rows.where(F.col("digest").isNotNull()).groupBy("digest", "n_shingles", "grp", "doc_id", "k", "th").agg(F.count("*").alias("copies"))
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k", "th", "copies")).alias("rep")
    sets = alike.groupBy("digest", "n_shingles", "grp").agg(rep)
    return stage(sets.withColumn("rid", F.monotonically_increasing_id()), "distinct-sets")


def contract(links: DataFrame) -> DataFrame:
    """node, root of the linked nodes (columns a, b): the least node of each class, by alternating star contractions."""
    mark = staged_so_far()
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    while not _are_stars(edges):
        # large star: greater neighbours go to the least of a node's neighbourhood
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: a node and its lesser neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = stage(small.where("u != v").distinct(), "edges")
        release(mark, edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether each edge (u > v) hangs on a root: no node has two edges up, and none that has one has others below.

    That is where the contractions end, found by one count a node instead of by another round that changes nothing.
    """
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return (nodes.where("up > 0").agg(F.max(F.col("up") + F.col("down"))).first()[0] or 0) <= 1


def linked(pairs: DataFrame, sets: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar: both whole texts are brought to the pair and their sets intersected."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct().join(sets, "rid").select("rid", "rep.k", "rep.th", "rep.copies")
    wanted = stage(wanted, "wanted")
    n, copies = wanted.agg(F.count("*"), F.max("copies")).first()
    wanted = wanted.drop("copies")
    there = texts.join(F.broadcast(wanted) if n <= FEW else wanted, ["k", "th"]).select("rid", "text")
    if (copies or 1) > 1:  # rows that repeat, ids included
        there = there.dropDuplicates(["rid"])
    brought = pairs.join(there.select(F.col("rid").alias("a"), F.col("text").alias("text_a")), "a").join(there.select(F.col("rid").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        shingles = Shingler(k)
        for batch in batches:
            out = {"a": [], "b": []}
            last, sb = None, None
            for a, b, ta, tb in zip(*batch.columns[:2], *batch.columns[2:], strict=True):
                a, b = a.as_py(), b.as_py()
                if b != last:
                    last, sb = b, shingles(tb.as_py())
                sa = shingles(ta.as_py())
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                if 100 * both >= percent * (len(sa) + len(sb) - both):
                    out["a"].append(a)
                    out["b"].append(b)
            yield out

    return arrow_map(brought.select("a", "b", "text_a", "text_b"), run, "a long, b long")


def classes(rows: DataFrame, sets: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """node, root: for each set that is linked with another, the least set of its class."""
    spark = rows.sparkSession
    groups = sets.groupBy("grp").agg(F.min("rid").alias("gid"), F.max("n_shingles").alias("n"), F.count("*").alias("size"))
    members = stage(sets.join(groups, "grp").select("gid", "rid", "n", "size", "rep.doc_id", "rep.k", "rep.th"), "groups")
    whole = members.where("gid = rid").select("gid", "n", "k", "th", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("least"))
    members = members.select("gid", "rid", "n", "size")
    lists = rows.where(F.col("digest").isNotNull()).select("k", "th", "prefix").join(whole, ["k", "th"]).select("gid", "n", "least", "prefix").dropDuplicates(["gid"])
    every = lists.select("gid", "n", "least", F.posexplode("prefix").alias("pos", "shingle"))
    shared = every.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1").select("shingle")
    index = stage(every.join(shared, "shingle"), "prefix-index")
    entries = index.count()

    inside = members.where("size > 1 AND gid != rid").select(F.col("gid").alias("a"), F.col("rid").alias("b"))
    links, roots, star = spark.createDataFrame([], "a long, b long"), None, 0
    while True:
        pairs = star_pairs(index, roots, star, percent)
        pairs = stage((pairs if star else pairs.union(inside)).distinct(), "pairs")
        links = stage(links.union(linked(pairs, sets, texts, k, percent)), "links")
        roots, star = contract(links), star + 1
        if star < 2:
            continue
        # what is left: pairs of groups with a common prefix shingle whose members are not all in one class
        placed = members.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
        placed = stage(placed.select("gid", "rid", "n", "size", "root"), "placed")
        spread = placed.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
        own = index.drop("least").join(spread, "gid")
        open_ = own.groupBy("shingle").agg(F.min("lo").alias("least"), F.max("hi").alias("most")).where("least != most").select("shingle")
        own = stage(own.join(open_, "shingle"), "open-index")
        if star == STARS or own.count() <= entries // LEFT:
            break
        by_class = own.groupBy("shingle", "lo").agg(F.count("*").alias("c")).groupBy("shingle").agg(F.sum("c").cast("double").alias("c"), F.sum(F.col("c") * F.col("c")).alias("in"))
        if (by_class.agg(F.sum((F.col("c") * F.col("c") - F.col("in")) / 2)).first()[0] or 0) <= LEFT * entries:
            break
    x, y = own.alias("x"), own.alias("y")
    # the first shingle that two similar sets share has all the others behind it, which bounds its place in both prefixes
    need = _least_shared(F.col("x.n"), F.col("y.n"), percent)
    met = x.join(
        y,
        (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.gid") < F.col("y.gid"))
        & ~((F.col("x.lo") == F.col("x.hi")) & (F.col("y.lo") == F.col("y.hi")) & (F.col("x.lo") == F.col("y.lo")))
        & _sizes_fit(F.col("x.n"), F.col("y.n"), percent) & _may_link(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), percent)
        & (F.col("x.pos") <= _prefix(F.col("x.n"), percent) - need) & (F.col("y.pos") <= _prefix(F.col("y.n"), percent) - need),
    )
    met = met.select(F.col("x.gid").alias("ga"), F.col("y.gid").alias("gb")).distinct()
    la, lb = (lists.select(F.col("gid").alias(g), F.col("n").alias(f"n_{g}"), F.col("prefix").alias(f"p_{g}")) for g in ("ga", "gb"))
    met = met.join(la, "ga").join(lb, "gb")
    met = met.where(F.size(F.array_intersect("p_ga", "p_gb")) >= _least_shared(F.col("n_ga"), F.col("n_gb"), percent)).select("ga", "gb")
    mixed = spread.where("lo != hi").select(F.col("gid").alias("ga"), F.col("gid").alias("gb"))
    a = placed.select(F.col("gid").alias("ga"), F.col("rid").alias("a"), F.col("root").alias("root_a"))
    b = placed.select(F.col("gid").alias("gb"), F.col("rid").alias("b"), F.col("root").alias("root_b"))
    pairs = met.union(mixed).join(a, "ga").join(b, "gb").where("root_a != root_b")
    pairs = stage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    more = stage(linked(pairs, sets, texts, k, percent), "links")
    if more.isEmpty():
        return roots
    return contract(links.union(more))


def star_pairs(index: DataFrame, roots: DataFrame | None, star: int, percent: int) -> DataFrame:
    """a, b: each group with the centre of one of its shingles, of another class, with which it shares the most."""
    if roots is None:
        own = index.withColumn("root", F.col("gid"))
    else:
        own = index.join(roots.withColumnRenamed("node", "gid"), "gid", "left").withColumn("root", F.coalesce("root", "gid"))
    place = F.struct((F.xxhash64("root", F.lit(star)) if star > 1 else F.col("least")).alias("by"), "root", "gid", "n", "pos")
    ends = own.groupBy("shingle").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1")
    met = own.join(ends, "shingle").withColumn("to", F.when(F.col("root") == F.col("lo")["root"], F.col("hi")).otherwise(F.col("lo")))
    met = met.where(F.col("root") != F.col("to")["root"])
    # a pair that shares but few of the prefix shingles it would have to is left for later
    shared_by = met.groupBy("gid", "n", F.col("to")["gid"].alias("to"), F.col("to")["n"].alias("m")).agg(F.count("*").alias("c"))
    shared_by = shared_by.where(_sizes_fit(F.col("n"), F.col("m"), percent) & (2 * F.col("c") >= _least_shared(F.col("n"), F.col("m"), percent)))
    best = shared_by.groupBy("gid").agg(F.max_by("to", F.struct("c", -F.col("to"))).alias("to"))
    return best.select(F.least("gid", "to").alias("a"), F.greatest("gid", "to").alias("b"))


def _least_overlap(n, m, percent: int):  # noqa: ANN001, ANN202 (columns)
    return F.ceil(percent * (n + m) / (100 + percent))


def _prefix(n, percent: int):  # noqa: ANN001, ANN202
    return n - F.ceil(percent * n / 100) + 1


def _sizes_fit(n, m, percent: int):  # noqa: ANN001, ANN202
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _may_link(n_a, pos_a, n_b, pos_b, percent: int):  # noqa: ANN001, ANN202
    """Whether sets of these sizes may be similar if these are the places of the first prefix shingle they share."""
    return 1 + F.least(n_a - pos_a - 1, n_b - pos_b - 1) >= _least_overlap(n_a, n_b, percent)


def _least_shared(n, m, percent: int):  # noqa: ANN001, ANN202
    """How many prefix shingles similar sets of these sizes share at least.

    Take the set whose prefix ends first in the order. At most size - overlap of its shingles aren't in the other set, so
    of its prefix at least length - size + overlap are; and they are in the other's prefix, which reaches further.
    """
    return F.greatest(F.lit(1), _least_overlap(n, m, percent) + 1 - F.ceil(percent * F.greatest(n, m) / 100))


def classed(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows, and digest and best of every set that isn't empty; best: the class's row of least id (as in ``rep``)."""
    mark = staged_so_far()
    texts = keyed(docs)
    rows = set_rows(texts, k, percent)
    sets = distinct_sets(rows)
    roots = classes(rows, sets, texts, k, percent)
    own = sets.join(roots.withColumnRenamed("node", "rid"), "rid", "left").select("digest", "rep", F.coalesce("root", "rid").alias("root"))
    best = stage(own.groupBy("root").agg(F.min("rep").alias("best")), "best")
    found = stage(own.select("digest", "root").join(best, "root").select("digest", "best"), "classes")
    release(mark, rows, found)
    return rows, found


def components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and root (the least id of the class) of every row."""
    rows, found = classed(docs, k, percent)
    joined = rows.select("doc_id", "n_shingles", "digest").join(found, "digest", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("root"))


def op6(docs: DataFrame) -> DataFrame:
    return components(docs, 3, 90).withColumnRenamed("root", "component_id")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Of each class the row of ``docs`` with the least id (of several texts of that id the one of least hash, of equal
    rows one); all rows without words."""
    _, found = classed(docs, k, percent)
    blank = F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACES)) == ""
    whole = docs.where(~blank).select(*keys(), F.struct("*").alias("whole"))  # an extra column of any name does no harm
    chosen = whole.join(found.select("best.k", "best.th").distinct(), ["k", "th"], "left_semi").dropDuplicates(["k", "th"])
    return chosen.select("whole.*").union(docs.where(blank))
