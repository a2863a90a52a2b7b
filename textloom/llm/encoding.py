"""Time-ordered target encoding: for every row, how often its value was a hit before, in the other folds.

Rows are events and questions at once: each has a key (any column), a time, a fold, and stands for ``n`` lines of which
``s`` are hits. ``with_history`` adds the n and s of all rows with the same key, another fold and a lesser time.

1. Rows are dealt by ranges of (key, time), so a shard holds the events and the questions of many keys together, and a
   hot key's rows lie in several shards, each a slice of time. Ties of key and time may be cut apart too, so no key,
   however hot, decides what a task gets.
2. A task goes through its sorted shard CHUNK rows at a time: for each fold the ranks of its (key, time) pairs are a
   sorted array with prefix sums of n and s; ``searchsorted`` finds each question's position in the four other folds,
   less the position where its key begins. What the open key has so far is carried from chunk to chunk.
3. Of its first and last key a shard leaves a row each, with sums by fold. Their running sums over the shards before are
   a shard's offsets (five rows a shard, so bounded by the number of partitions, a setting), which are broadcast and
   added to the rows of the shard's first key.

Rates are chained: the rate of all history is the prior of the attribute's rate (item kind, vendor nation, client
segment), which is the prior of the id's rate. Clients are encoded at one row a sale; vendors and items at one row
(sale, item, vendor); so seven passes, each one range shuffle, and no join on hot keys but those to the attributes,
which adaptive execution splits.

Defined results: null item and client ids are the id -1; a null vendor id is a value of its own; null attributes and ids
not in their table share one value; of several rows of an attribute table with one id the least attribute counts; lines
without a sale id, a sale or a time go; lines of a sale id that occurs in several rows of ``sales`` belong to each of
them (a row for each client and time); repeated lines count as often as they occur; a null flag is no return; empty tables give an empty result; columns
other than the named ones are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import release, small_batches, stage, staged_so_far

FOLDS = 5
#: The prior of all history, in millionths, and the lines that a prior weighs.
PRIOR, WEIGHT = 500_000, 50
#: Rows a task looks at together.
CHUNK = 1 << 16
_SUMS = ("tot_n", "tot_s", "at_n", "at_s")


def rate(n: str, s: str, prior: str) -> Column:
    """floor((1000000 * s + WEIGHT * prior) / (n + WEIGHT)), or the prior where there is no history."""
    return F.expr(f"CAST(IF({n} < 1, {prior}, (1000000 * {s} + {WEIGHT} * {prior}) DIV ({n} + {WEIGHT})) AS BIGINT)")


def with_history(df: DataFrame, key: str | None, ties: tuple[str, ...]) -> DataFrame:
    """``df`` and hist_n, hist_s: sums of n and s over rows of equal key (null is a key; None: all rows), other folds and lesser ``at``.

    ``df`` has the columns at (a time, not null), fold (0 to 4), n and s (long); ``ties`` make the order of rows of one
    key and time definite. The result reads a staged table.
    """
    order = [*([key] if key else []), "at", *ties]
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    small_batches(df.sparkSession)
    extra = [StructField("hist_n", LongType()), StructField("hist_s", LongType()), StructField("part", IntegerType()), StructField("cont", IntegerType()), StructField("mark", IntegerType())]
    sums = [StructField(x, ArrayType(LongType())) for x in _SUMS]
    schema = StructType([StructField(f.name, f.dataType) for f in df.schema] + extra + sums)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(key, TaskContext.get().partitionId())
        kept, rows = [], 0
        for batch in batches:
            kept.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                yield shard.counted(pa.Table.from_batches(kept).combine_chunks().to_batches()[0])
                kept, rows = [], 0
        if rows:
            yield shard.counted(pa.Table.from_batches(kept).combine_chunks().to_batches()[0])
        yield from shard.marks()

    found = stage(dealt.mapInArrow(run, schema), f"history-{key or 'all'}")
    by = [key] if key else []
    each = found.where("mark IS NOT NULL").select(*by, "at", "part", "mark", F.posexplode(F.arrays_zip(*_SUMS)).alias("fold", "v")).select(*by, "at", "part", "mark", "fold", "v.*")
    before = lambda *c: Window.partitionBy(*by, *c, "fold").orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    each = each.select("part", "mark", "fold", *(F.coalesce(F.sum(x).over(before() if x[:3] == "tot" else before("at")), F.lit(0)).alias(x) for x in _SUMS)).where("mark = 0")
    others = Window.partitionBy("part")
    offsets = each.select("part", "fold", *((F.sum(x).over(others) - F.col(x)).alias(f"off_{x}") for x in _SUMS))
    out = found.where("mark IS NULL").join(F.broadcast(offsets), ["part", "fold"], "left")
    for x in "ns":
        earlier = F.col(f"off_tot_{x}")
        more = F.when(F.col("cont") == 1, earlier - F.col(f"off_at_{x}")).when(F.col("cont") == 2, earlier).otherwise(0)
        out = out.withColumn(f"hist_{x}", F.col(f"hist_{x}") + more)
    return out.select(*names, "hist_n", "hist_s")


@dataclass
class _Shard:
    """What a task knows of the key that is open at the end of what it has seen."""

    key: str | None
    part: int
    first: tuple | None = None  # key and time of the first row
    in_first: bool = True  # the first key is still open
    last: tuple | None = None  # key and time of the last row
    before: np.ndarray = field(default_factory=lambda: np.zeros((2, FOLDS), np.int64))  # n, s by fold before that time
    at: np.ndarray = field(default_factory=lambda: np.zeros((2, FOLDS), np.int64))  # and at it

    def counted(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.num_rows
        at = batch.column("at").cast(pa.int64()).to_numpy(zero_copy_only=False)
        fold, n, s = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("fold", "n", "s"))
        new_key = np.ones(rows, bool)
        if self.key:
            codes = batch.column(self.key).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new_key[1:] = codes[1:] != codes[:-1]
        else:
            new_key[1:] = False
        new_time = new_key.copy()
        new_time[1:] |= at[1:] != at[:-1]
        own, rank = np.cumsum(new_key) - 1, np.cumsum(new_time)
        begins = rank[new_key][own]
        hist = np.zeros((2, rows), np.int64)
        for f in range(FOLDS):
            mine = np.flatnonzero(fold == f)
            times = rank[mine]
            here, start = np.searchsorted(times, rank), np.searchsorted(times, begins)
            for out, x in zip(hist, (n, s), strict=True):
                sums = np.concatenate([[0], np.cumsum(x[mine])])
                out += np.where(fold == f, 0, sums[here] - sums[start])
        value = (lambda i: batch.column(self.key)[i].as_py()) if self.key else lambda i: None
        head, tail = (value(0), int(at[0])), (value(rows - 1), int(at[-1]))
        self.first = self.first or head
        goes_on = self.last is not None and self.last[0] == head[0]
        if goes_on:
            until = int(np.searchsorted(own, 0, "right"))
            early = at[:until] == self.last[1]
            for i in range(2):
                seen = self.before[i] + self.at[i]
                hist[i, :until] += np.where(early, (self.before[i].sum() - self.before[i])[fold[:until]], (seen.sum() - seen)[fold[:until]])
        cont = np.zeros(rows, np.int32)
        if self.in_first and (self.last is None or goes_on):
            until = int(np.searchsorted(own, 0, "right"))
            cont[:until] = np.where(at[:until] == self.first[1], 1, 2)
        self.in_first = self.in_first and (self.last is None or goes_on) and own[-1] == 0
        # the key that stays open
        whole = goes_on and own[-1] == 0
        if not whole:
            self.before[:], self.at[:] = 0, 0
        elif self.last[1] < tail[1]:
            self.before += self.at
            self.at[:] = 0
        begin = int(np.searchsorted(own, own[-1]))
        cut = begin + int(np.searchsorted(at[begin:], tail[1]))
        for i, x in enumerate((n, s)):
            np.add.at(self.before[i], fold[begin:cut], x[begin:cut])
            np.add.at(self.at[i], fold[cut:], x[cut:])
        self.last = tail
        none = [pa.nulls(rows, pa.int32())] + [pa.nulls(rows, pa.list_(pa.int64()))] * 4
        new = [pa.array(hist[0]), pa.array(hist[1]), pa.array(np.full(rows, self.part, np.int32)), pa.array(cont), *none]
        return self._batch(batch, new)

    def _batch(self, batch: pa.RecordBatch, new: list[pa.Array]) -> pa.RecordBatch:
        self.schema = batch.schema
        return pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "hist_n", "hist_s", "part", "cont", "mark", *_SUMS])

    def marks(self) -> Iterator[pa.RecordBatch]:
        """A row of the first key and one of the last."""
        if self.first is None:
            return
        cols = []
        for f in self.schema:
            if f.name == "at":
                cols.append(pa.array([self.first[1], self.last[1]], pa.int64()).cast(f.type))
            elif f.name == self.key:
                cols.append(pa.array([self.first[0], self.last[0]], f.type))
            else:
                cols.append(pa.nulls(2, f.type))
        nil, total = [0] * FOLDS, self.before + self.at
        sums = [[nil, list(map(int, x))] for x in (*total, *self.at)]
        new = [pa.nulls(2, pa.int64()), pa.nulls(2, pa.int64()), pa.array([self.part] * 2, pa.int32()), pa.nulls(2, pa.int32()), pa.array([0, 1], pa.int32()), *(pa.array(x, pa.list_(pa.int64())) for x in sums)]
        yield self._batch(pa.RecordBatch.from_arrays(cols, schema=self.schema), new)


def attribute(table: DataFrame, key: str, value: str) -> DataFrame:
    """key and value, one row a key; staged, as a join on top of a sum can't split a hot key's rows."""
    found = table.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"of_{key}")).agg(F.min(value).alias(value))
    return stage(found, f"of-{key}")


def encoded(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame) -> DataFrame:
    """Lines by (sale_id, item_id, vendor_id), n_lines, n_returned and the encodings of item, vendor and client."""
    mark = staged_so_far()
    lines = lines.where("sale_id IS NOT NULL").select("sale_id", F.coalesce("item_id", F.lit(-1)).cast("long").alias("item_id"), "vendor_id", F.coalesce(F.col("flag") == "returned", F.lit(False)).cast("long").alias("hit"))
    own = lines.groupBy("sale_id", "item_id", "vendor_id").agg(F.count("*").alias("n"), F.sum("hit").alias("s"))
    of_sale = lines.groupBy("sale_id").agg(F.count("*").alias("n"), F.sum("hit").alias("s"))

    fold = F.pmod(F.crc32(F.col("sale_id").cast("string").cast("binary")), F.lit(FOLDS)).cast("int").alias("fold")
    sold = sales.where("sale_id IS NOT NULL AND sold_at IS NOT NULL").select("sale_id", F.coalesce("client_id", F.lit(-1)).cast("long").alias("client_id"), F.col("sold_at").alias("at"), fold)
    sold = sold.groupBy(*sold.columns).agg(F.count("*").alias("copies"))
    sold = sold.join(attribute(clients, "client_id", "segment"), F.col("client_id") == F.col("of_client_id"), "left").drop("of_client_id").join(of_sale, "sale_id")
    sold = sold.withColumn("n", F.col("n") * F.col("copies")).withColumn("s", F.col("s") * F.col("copies"))
    ties = ("sale_id", "client_id")
    sold = with_history(sold, None, ties).withColumn("p_all", rate("hist_n", "hist_s", str(PRIOR))).drop("hist_n", "hist_s")
    sold = with_history(sold, "segment", ties).withColumn("p", rate("hist_n", "hist_s", "p_all")).drop("hist_n", "hist_s", "segment")
    sold = with_history(sold, "client_id", ("sale_id",)).withColumn("client_rate", rate("hist_n", "hist_s", "p")).withColumnRenamed("hist_n", "client_n")
    sold = sold.select("sale_id", "at", "fold", "client_id", "copies", "p_all", "client_n", "client_rate")

    found = own.join(attribute(items, "item_id", "kind"), F.col("item_id") == F.col("of_item_id"), "left").drop("of_item_id")
    found = found.join(attribute(vendors, "vendor_id", "nation_id"), F.col("vendor_id") == F.col("of_vendor_id"), "left").drop("of_vendor_id").join(sold, "sale_id")
    found = found.withColumn("n", F.col("n") * F.col("copies")).withColumn("s", F.col("s") * F.col("copies")).drop("copies")
    for attr, key, name in (("kind", "item_id", "item"), ("nation_id", "vendor_id", "vendor")):
        ties = ("sale_id", "client_id", "item_id", "vendor_id")
        found = with_history(found, attr, ties).withColumn("p", rate("hist_n", "hist_s", "p_all")).drop("hist_n", "hist_s", attr)
        found = with_history(found, key, tuple(c for c in ties if c != key)).withColumn(f"{name}_rate", rate("hist_n", "hist_s", "p"))
        found = found.withColumnRenamed("hist_n", f"{name}_n").drop("hist_s", "p")
    kept = stage(found.select("sale_id", "item_id", "vendor_id", F.col("n").alias("n_lines"), F.col("s").alias("n_returned"), "item_n", "item_rate", "vendor_n", "vendor_rate", "client_n", "client_rate"), "encoded")
    release(mark, kept)
    return kept


def op13(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame) -> DataFrame:
    return encoded(lines, sales, items, vendors, clients)
