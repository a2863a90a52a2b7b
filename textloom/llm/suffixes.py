"""Exact removal of long repeated byte strings, by column-wise construction of a multi-document suffix order.

A string of ``SIZE`` bytes is a repeat if it also starts anywhere else, in any document. The work is dealt out so that
equal strings meet:

1. Every window of SIZE bytes has an anchor, the least of its 32-byte grams by hash (leftmost on ties). Equal windows
   have equal anchors, so only anchors whose hash occurs twice can matter; the others drop out after one count.
2. Neighbouring windows with one anchor make a piece. Equal pieces are collapsed in each task, and again where they
   meet, so a group of exact copies costs one piece a task; equal pieces at even distances (a run of one byte, any
   period) are one row of places.
3. The pieces that share their anchor hash with another form a collection, aligned at the anchors. Its suffix order is
   built from the right: each round inserts one symbol a piece, read from the next column of an external file, deals the
   collection out by it (stably, so the order of the suffixes behind it is kept: the step of the Burrows-Wheeler
   transform) and updates the common prefixes of neighbours. Columns, order and common prefixes are files that are read
   and written in sequence, a block at a time. Where a common prefix reaches SIZE, both windows are repeats; equal
   windows have equal anchors, so collections of several anchors can be built as one.
4. Repeats go back to the documents as byte ranges, which are united and cut out.

Scale: a count of (hash, n), pre-aggregated in each task; a bitmap of fixed size, broadcast, that keeps the pieces of
unrepeated anchors at home (it only saves traffic, never decides); a shuffle of each task's distinct pieces; and one of the texts
with their ranges. A collection of over ``LARGEST`` distinct pieces (a common passage with ever other surroundings) is
split: its windows become collections of their own, keyed by their content, so no task holds an unbounded group.

Defined results: null text is empty; texts under SIZE bytes are kept whole; rows that repeat, ids included, are copies
of each other, and each gives a row; texts of any length are read whole, in parts that overlap; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, id_key, stage, utf8

SIZE = 200
GRAM = 32
#: Bytes handled at once; positions fit in the low bits of a key.
BLOCK, POSITION = 1 << 19, (1 << 20) - 1
#: Bits of the broadcast bitmap of repeated anchors (16 MB).
BITS = 1 << 27
#: Distinct pieces that one collection may have in memory.
LARGEST = 100_000
#: Distinct pieces that a task holds before it hands them on.
AT_ONCE = 200_000
#: Pieces whose collections are built together.
TOGETHER = 20_000
#: Pieces whose columns are laid out at once, and places of the order that are handled at once.
STRIPE, PLACES = 4096, 1 << 17
_PLACE = np.dtype([("id", "<i4"), ("lcp", "<i2")])
_TABLE = np.random.default_rng(5).integers(0, 2**64, 256, dtype=np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every GRAM bytes, by doubling."""
    h, width = _TABLE[buf], 1
    while width < GRAM:
        x = h[:-width] * _A
        x ^= x >> np.uint64(32)
        x += h[width:]
        x *= _B
        h, width = x, 2 * width
    return h ^ (h >> np.uint64(29))


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    width = 1
    while 2 * width <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (size - width)], x[size - width :]) if size > width else x


def anchor_runs(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window, anchor position and anchor hash of each run of windows with one anchor.

    ends: where each text in ``buf`` ends; windows do not cross texts.
    """
    if len(buf) < SIZE:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    hashes = gram_hashes(buf)
    keys = (hashes & ~np.uint64(POSITION)) | np.arange(len(hashes), dtype=np.uint64)
    at = (sliding_min(keys, SIZE - GRAM + 1) & np.uint64(POSITION)).astype(np.int64)
    starts = np.arange(len(at))
    valid = starts + SIZE <= np.repeat(ends, np.diff(ends, prepend=0))[: len(at)]
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    first = np.flatnonzero(fresh)
    stop = np.append(np.flatnonzero(~valid), len(at))
    last = np.minimum(np.append(first[1:], len(at)), stop[np.searchsorted(stop, first)]) - 1
    return first, last, at[first], hashes[at[first]]


def blocks(rows: Iterator[tuple[tuple, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple], np.ndarray]]:
    """(bytes, ends, keys, offsets): texts put together up to BLOCK bytes; a longer text comes in parts that overlap."""
    parts: list[bytes] = []
    keys: list[tuple] = []
    offsets: list[int] = []
    total = 0
    for key, text in rows:
        for begin in range(0, max(1, len(text) - SIZE + 1), BLOCK - SIZE + 1):
            part = text[begin : begin + BLOCK]
            if len(part) < SIZE:
                continue
            if total + len(part) > BLOCK and parts:
                yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), keys, np.array(offsets)
                parts, keys, offsets, total = [], [], [], 0
            parts.append(part)
            keys.append(key)
            offsets.append(begin)
            total += len(part)
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), keys, np.array(offsets)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes]]:
    for batch in batches:
        keys = zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True) if batch.num_columns > 1 else [()] * len(batch)
        for key, text in zip(keys, batch.column(batch.num_columns - 1), strict=True):
            yield key, text.as_py()


def anchor_counts(texts: DataFrame) -> DataFrame:
    """hash, n of all anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for buf, ends, _, _ in blocks(_texts(batches)):
            h, n = np.unique(anchor_runs(buf, ends)[3].view(np.int64), return_counts=True)
            yield {"hash": h, "n": n}

    return arrow_map(texts.select("text"), run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def bitmap_of(hashes: DataFrame) -> np.ndarray:
    """A bitmap of BITS bits with the low bits of each hash set."""
    bit = F.pmod(F.col("hash"), F.lit(BITS))
    words = hashes.groupBy(F.shiftright(bit, 6).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(hash, {BITS}) % 64 as int))")).alias("bits"))
    got = words.toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes.view(np.uint64) & np.uint64(BITS - 1)
    return (bitmap.view(np.uint64)[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


MEMBER = "pid binary, k long, th long, at long, step int, times int, hash long, anchor int, piece binary, n long"


def members(texts: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """Every piece that may have a repeat, in two sorts of rows.

    Places (pid, k, th, at, step, times): the piece's identity, owner and places (at, at + step, ..., so many). Pieces
    (pid, hash, anchor, piece, n): each piece once a task, with its anchor's hash, the anchor's place in it, its bytes,
    and how often the task saw it.
    """
    sent = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: dict[bytes, list] = {}
        for buf, ends, keys, offsets in blocks(_texts(batches)):
            first, last, at, hashes = anchor_runs(buf, ends)
            use = np.flatnonzero(in_bitmap(sent.value, hashes))
            first, last, at, signed = first[use], last[use], at[use], hashes[use].view(np.int64)
            owner = np.searchsorted(ends, first, side="right")
            begins = ends - np.diff(ends, prepend=0)
            raw = buf.tobytes()
            pids: list[bytes] = []
            new = np.ones(len(first), bool)  # another piece than the one before
            piece, known = b"", []
            for i, (a, b, anchor, h) in enumerate(zip(first.tolist(), last.tolist(), (at - first).tolist(), signed.tolist(), strict=True)):
                before, piece = piece, raw[a : b + SIZE]
                if piece == before and known[1] == anchor:
                    known[3] += 1
                    new[i] = False
                    pids.append(pids[-1])
                    continue
                pids.append(pid := xxhash.xxh3_128_digest(piece, anchor))
                known = seen.setdefault(pid, [h, anchor, piece, 0])
                known[3] += 1
            at = first - begins[owner] + offsets[owner]
            heads, steps, times = progressions(new, owner, at)
            n = len(heads)
            yield {
                "pid": [pids[i] for i in heads], "k": [keys[i][0] for i in owner[heads]], "th": [keys[i][1] for i in owner[heads]], "at": at[heads],
                "step": steps, "times": times, "hash": [None] * n, "anchor": [None] * n, "piece": [None] * n, "n": [None] * n,
            }
            if len(seen) > AT_ONCE:
                yield _pieces(seen)
                seen = {}
        yield _pieces(seen)

    return arrow_map(texts.select("k", "th", "text"), run, MEMBER)


def progressions(new: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First index, step and length of runs of equal pieces of one owner at even distances."""
    n = len(at)
    step = np.diff(at, prepend=0)
    same = ~new
    same[1:] &= owner[1:] == owner[:-1]
    same[:1] = False
    uneven = np.zeros(n, bool)
    uneven[2:] = same[2:] & same[1:-1] & (step[2:] != step[1:-1])
    heads = np.flatnonzero(~same | uneven)
    times = np.diff(np.append(heads, n))
    return heads, np.where(times > 1, step[np.minimum(heads + 1, max(n - 1, 0))], 0) if n else step, times


def _pieces(seen: dict[bytes, list]) -> dict:
    h, anchor, piece, n = ([x[i] for x in seen.values()] for i in range(4))
    none = [None] * len(seen)
    return {"pid": list(seen), "k": none, "th": none, "at": none, "step": none, "times": none, "hash": h, "anchor": anchor, "piece": piece, "n": n}


def window_repeats(pieces: DataFrame) -> DataFrame:
    """pid, ranges for collections that are too large to be held: each window is a collection of its own.

    The windows of equal content are counted with pre-aggregation, so nothing is gathered.
    """
    distinct = pieces.groupBy("hash", "pid", "anchor", "piece").agg(F.sum("n").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for pid, piece, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                count = len(piece) - SIZE + 1
                keys = [xxhash.xxh3_128_digest(piece[i : i + SIZE]) for i in range(count)]
                yield {"key": keys, "pid": [pid] * count, "begin": range(count), "n": [n] * count}

    windows = arrow_map(distinct.select("pid", "piece", "n"), run, "key binary, pid binary, begin int, n long")
    twice = windows.groupBy("key").agg(F.sum("n").alias("all")).where(F.col("all") > 1).select("key")
    found = windows.join(twice, "key").groupBy("pid").agg(F.collect_list("begin").alias("begins"))
    return found.select("pid", F.flatten(F.transform("begins", lambda b: F.array(b, b + SIZE))).alias("ranges"))


class Columns:
    """The symbols of pieces that are aligned at their anchors, column by column from the right, in a file.

    The file is made a stripe of pieces at a time and holds a stripe's columns one after the other.
    """

    def __init__(self, file: BinaryIO, pieces: list[bytes], right: np.ndarray, width: int) -> None:
        """right: how many columns lie to the right of each piece."""
        self.file, self.n = file, len(pieces)
        self.stripes = []
        for begin in range(0, self.n, STRIPE):
            part = pieces[begin : begin + STRIPE]
            grid = np.zeros((width, len(part)), np.uint8)
            for i, p in enumerate(part):
                grid[right[begin + i] : right[begin + i] + len(p), i] = np.frombuffer(p, np.uint8)[::-1]
            self.stripes.append((file.tell(), len(part)))
            file.write(grid.tobytes())

    def __getitem__(self, column: int) -> np.ndarray:
        out = []
        for start, size in self.stripes:
            self.file.seek(start + column * size)
            out.append(self.file.read(size))
        return np.frombuffer(b"".join(out), np.uint8)


class SuffixOrder:
    """The collection's suffixes at a column, in order: places (piece id, common prefix with the place before) in a file."""

    def __init__(self, anchor: np.ndarray, now: BinaryIO, next_: BinaryIO) -> None:
        self.anchor, self.now, self.next, self.count = anchor, now, next_, 0

    def places(self, joining: np.ndarray, c: int) -> Iterator[np.ndarray]:
        """The pieces that end here, which come first, and the places of those that still reach column ``c``.

        A common prefix spans the places that are left out before it.
        """
        new = np.zeros(len(joining), _PLACE)
        new["id"] = joining
        self.now.seek(0)
        least = SIZE
        for begin in range(0, max(1, self.count), PLACES):
            block = np.frombuffer(self.now.read(min(PLACES, self.count - begin) * _PLACE.itemsize), _PLACE).copy()
            if begin == 0:
                block["lcp"][:1] = 0
                block = np.concatenate([new, block])
            keep = np.flatnonzero(-self.anchor[block["id"]] <= c)
            if len(keep) < len(block) or least < SIZE:
                low = np.minimum.reduceat(np.append(block["lcp"], np.int16(SIZE)), np.append(0, keep + 1))
                low[0] = min(low[0], least)
                least = int(low[-1])
                block = block[keep]
                block["lcp"] = low[:-1]
            if len(block):
                yield block

    def insert(self, symbols: np.ndarray, joining: np.ndarray, c: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """One round: the places are dealt stably by their pieces' symbols in column ``c``, a symbol's part after the other.

        Where neighbours now share SIZE symbols, their ids are given. Between two places of one symbol the common prefix
        is the least of those passed over, and one more.
        """
        parts = None
        if self.count + len(joining) > PLACES:  # several blocks: the parts are counted first
            count = sum((np.bincount(symbols[b["id"]], minlength=256) for b in self.places(joining, c)), np.zeros(256, np.int64))
            parts = np.cumsum(count) - count
        gap = np.full(256, -1, np.int16)  # least common prefix since the symbol's last place; -1: none yet
        last = np.full(256, -1, np.int32)
        total = 0
        self.next.seek(0)
        for block in self.places(joining, c):
            lcp, sym = block["lcp"], symbols[block["id"]]
            by = np.argsort(sym, kind="stable")
            key = sym[by]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            stop = np.append(first[1:], len(by)) - 1
            found = np.zeros(len(by), np.int16)
            a, b = by[:-1], by[1:]
            same = key[1:] == key[:-1]
            near = same & (b == a + 1)
            found[1:][near] = lcp[b[near]] + 1
            far = np.flatnonzero(same & ~near)
            if len(far):
                spans = np.empty(2 * len(far), np.int64)
                spans[::2], spans[1::2] = a[far] + 1, b[far] + 1
                found[1:][far] = np.minimum.reduceat(np.append(lcp, np.int16(0)), spans)[::2] + 1
            ahead = np.minimum.accumulate(lcp)
            start = key[first]
            found[first] = np.where(gap[start] >= 0, np.minimum(gap[start], ahead[by[first]]) + 1, 0)
            np.minimum(found, SIZE, out=found)
            dealt = np.empty(len(by), _PLACE)
            ids = block["id"][by]
            dealt["id"], dealt["lcp"] = ids, found
            full = np.flatnonzero(found >= SIZE)
            if len(full):
                before = np.empty_like(ids)
                before[1:] = ids[:-1]
                before[first] = last[start]
                yield ids[full], before[full]
            behind = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.int16(SIZE))
            gap[gap >= 0] = np.minimum(gap[gap >= 0], ahead[-1])
            gap[start], last[start] = behind[by[stop] + 1], ids[stop]
            total += len(by)
            if parts is None:
                self.next.write(dealt.tobytes())
                continue
            for f, t in zip(first.tolist(), stop.tolist(), strict=True):
                self.next.seek(int(parts[key[f]]) * _PLACE.itemsize)
                self.next.write(dealt[f : t + 1].tobytes())
                parts[key[f]] += t + 1 - f
        self.now, self.next, self.count = self.next, self.now, total


def repeated_windows(anchor: np.ndarray, pieces: list[bytes]) -> list[np.ndarray]:
    """For each piece, which of its windows occur in another piece at the same place from the anchor."""
    n = len(pieces)
    length = np.array([len(p) for p in pieces])
    end = length - anchor  # columns are counted from the anchor: a piece lies in [-anchor, end)
    right, left = int(end.max()), -int(anchor.max())
    marks = np.zeros((n, int(length.max()) - SIZE + 1), bool)
    joins = np.argsort(-end, kind="stable").astype(np.int32)
    join_at = -end[joins]
    with tempfile.TemporaryFile() as file, tempfile.TemporaryFile() as one, tempfile.TemporaryFile() as two:
        columns, order = Columns(file, pieces, right - end, right - left), SuffixOrder(anchor, one, two)
        for c in range(right - 1, left - 1, -1):
            joining = joins[np.searchsorted(join_at, -c - 1) : np.searchsorted(join_at, -c - 1, side="right")]
            for ids, before in order.insert(columns[right - 1 - c], joining, c):
                for side in (ids, before):
                    marks[side, c + anchor[side]] = True
    return [marks[i, : length[i] - SIZE + 1] for i in range(n)]


def runs(mask: np.ndarray) -> list[int]:
    """[from, to) bytes of the piece that marked windows cover, flat."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    out: list[int] = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if out and a <= out[-1]:
            out[-1] = b - 1 + SIZE
        else:
            out += [a, b - 1 + SIZE]
    return out


def repeats(pieces: DataFrame) -> DataFrame:
    """pid and covered byte ranges of the ``pieces`` (hash, pid, anchor, piece, n) that hold repeats."""

    def build(rows: list[tuple]) -> dict:
        out = {"pid": [], "ranges": []}
        group = np.cumsum([0] + [a[0] != b[0] for a, b in zip(rows, rows[1:], strict=False)])
        size = np.bincount(group)
        alone = size[group] == 1
        for row in rows:
            if row[4] > 1:
                out["pid"].append(row[1])
                out["ranges"].append([0, len(row[3])])
        several = [row for row, single in zip(rows, alone, strict=True) if not single]
        if several:
            found = repeated_windows(np.array([r[2] for r in several]), [r[3] for r in several])
            for row, mask in zip(several, found, strict=True):
                if row[4] == 1 and mask.any():
                    out["pid"].append(row[1])
                    out["ranges"].append(runs(mask))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and row[1] == rows[-1][1]:  # the same piece from another task
                    rows[-1] = (*rows[-1][:4], rows[-1][4] + row[4])
                    continue
                if len(rows) >= TOGETHER and row[0] != rows[-1][0]:
                    yield build(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield build(rows)

    dealt = pieces.repartition("hash").sortWithinPartitions("hash", "pid")
    return arrow_map(dealt.select("hash", "pid", "anchor", "piece", "n"), run, "pid binary, ranges array<int>")


def cover(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of byte ranges as maximal runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the removed ranges and kept bytes, of every row."""
    texts = docs.select(id_key().alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), utf8().alias("text"), F.col("doc_id").cast("long"))
    twice = anchor_counts(texts).where("n > 1").select("hash")
    found = stage(members(texts, bitmap_of(twice)), "pieces")
    pieces = found.where("piece is not null")
    counts = pieces.groupBy("hash", "pid").agg(F.lit(1)).groupBy("hash").agg(F.count("*").alias("n"))
    large = stage(counts.where(F.col("n") > LARGEST).select("hash"), "large-collections")
    if large.isEmpty():
        repeated = repeats(pieces)
    else:
        repeated = repeats(pieces.join(large, "hash", "left_anti")).unionByName(window_repeats(pieces.join(large, "hash", "left_semi")))
    back = found.where("piece is null").select("pid", "k", "th", "at", "step", "times").join(repeated, "pid")
    # places in a row overlap, as a piece is longer than any step: from the first one's begin to the last one's end
    far = (F.col("times") - 1) * F.col("step")
    reach = F.transform("ranges", lambda x, i: F.col("at") + x + F.when(i % 2 == 1, far).otherwise(0))
    spans = back.groupBy("k", "th").agg(F.collect_set(reach).alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept")}
            for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                gone = cover([x for s in spans or () for x in zip(s[::2], s[1::2], strict=True)])
                kept, begin = [], 0
                for a, b in gone:
                    kept.append(text[begin:a])
                    begin = b
                kept = b"".join([*kept, text[begin:]])
                row = (doc_id, len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), [x for s in gone for x in s], kept)
                for c, v in zip(out, row, strict=True):
                    out[c].append(v)
            yield out

    joined = texts.join(spans.hint("shuffle_hash"), ["k", "th"], "left").select("doc_id", "text", "found")
    return arrow_map(joined, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<long>, kept binary")


def op3(docs: DataFrame) -> DataFrame:
    return dedup(docs).drop("removed", "kept")
