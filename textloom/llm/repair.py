"""Conversation structure repair: the cheapest edits that give every conversation the form (system)? (user assistant)*.

A conversation's rows, by turn (null first), then role and text, are the layers of a graph whose nodes are what has been
said so far: nothing, a system row, a user row, an assistant row. Keep (0), Rerole (2) and Delete (3) lead a row on,
Insert (2) stays in the layer; a row that is kept or reroled in spite of a cut-off end costs 1 more; blank rows and
repeats have to go. Costs of reaching a node and costs from it to the end together say which arcs are tight, that is on
some cheapest path; the path is walked from the start, a frontier of nodes at a time, by the least letter (D, I, K, R)
that any tight arc from the frontier has. From one node a letter leads to one node, so the frontier of one start is one
node, and a piece's walk is a map from states to states.

A conversation may hold a third of all rows, so none is ever one group:

1. Equal rows of a conversation are one row with a count. Which row said the same first is a minimum by (conversation,
   role, text), brought to its row by a sum over the whole row, so no join meets a hot key.
2. Rows are dealt by ranges of their order and cut into pieces of at most 2**PIECE_BITS rows. A piece's costs from state
   to state are a 4 x 4 matrix; matrices are combined by minimum and sum, FAN pieces at a time, in as many levels as the
   longest conversation needs, and costs from the start and to the end come down again (``carried``).
3. With both, each piece marks its tight arcs and walks from each state that a cheapest path can enter by. Those maps
   are combined the same way, and tell each piece which of its walks is the one.

A SHA-256 of a whole conversation can't be had in parts: rows are dealt by conversation, sorted, and hashed as they
stream by, a batch in memory at a time. The audit string is as long as the conversation, as is asked for.

Defined results: nulls in role and text are one space; a null conv_id is a conversation, a null turn comes first; equal
rows of a turn are repeats of one row; rows of one turn follow role, then text; a role counts by its first letter, and
roles of other letters have to be reroled or deleted; a conversation without rows left has zeros, an empty audit and the
hash of the empty text; texts of any length are read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, arrow_map, release, stage, staged_so_far

#: Rows in a piece are 2**PIECE_BITS at most, pieces combined at once 2**FAN_BITS.
PIECE_BITS, FAN_BITS = 12, 10
FAR = 1 << 50
STATES = ("nothing", "system", "user", "assistant")
#: The state after an inserted or reroled row, and after a kept one of initial s, u, a or another (-1: not allowed).
NEXT = (2, 2, 3, 2)
KEPT = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
DELETE, INSERT, REROLE = 3, 2, 2
_LAWFUL = ((0, 1), (1, 2), (2, 1))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of any inserts from state to state; of a row's code; and of both, by code: 4 * (2 * must go + cut off) + initial."""
    ins = np.full((4, 4), FAR)
    for q in range(4):
        at = q
        for cost in (0, INSERT, 2 * INSERT):
            ins[q, at] = min(ins[q, at], cost)
            at = NEXT[at]
    row = np.full((16, 4, 4), FAR)
    for code in range(16):
        goes, cut, initial = code >> 3, code >> 2 & 1, code & 3
        for q in range(4):
            row[code, q, q] = DELETE
            if not goes:
                row[code, q, NEXT[q]] = min(row[code, q, NEXT[q]], REROLE + cut)
                if (to := KEPT[q][initial]) >= 0:
                    row[code, q, to] = cut
    return ins, row, np.stack([times(ins, r) for r in row])


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of matrices by minimum and sum."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(-2), FAR)


INSERTS, ROW, STEP = _tables()
#: From the start; to the end (with inserts), and that it is the end.
START, END = [0, FAR, FAR, FAR], [0, 2 * INSERT, INSERT, 0, 1]


def placed(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, copies) as distinct rows in order: first (said first), blank, cut, initial, at; staged."""
    own = ("conv_id", "turn", "role", "text")
    first = turns.groupBy("conv_id", "role", "text").agg(F.min(F.struct(F.col("turn").isNotNull().alias("there"), "turn")).alias("first"))
    first = first.select("conv_id", F.col("first.turn").alias("turn"), "role", "text", F.lit(0).cast("long").alias("copies"), F.lit(True).alias("first"))
    rows = turns.select(*own, F.col("copies").cast("long"), F.lit(False).alias("first")).union(first).groupBy(*own).agg(F.sum("copies").alias("copies"), F.max("first").alias("first"))
    rows = rows.repartitionByRange(*own).sortWithinPartitions(*own)
    said = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    found = rows.select(
        *own, "copies", "first", (said == "").alias("blank"), (~F.substring(said, -1, 1).isin(".", "!", "?")).alias("cut"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"), F.monotonically_increasing_id().alias("at"),
    )
    return stage(found, "placed")


def pieces_of(rows: DataFrame) -> DataFrame:
    """conv_id, piece, steps: at, code and copies of its rows in order."""
    goes = F.col("blank") | ~F.col("first")
    code = (F.when(goes, 8).otherwise(0) + F.when(F.col("cut"), 4).otherwise(0) + F.col("initial")).cast("int")
    steps = rows.select("conv_id", F.shiftright("at", PIECE_BITS).alias("piece"), F.struct("at", code.alias("code"), "copies").alias("step"))
    return steps.groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list("step")).alias("steps"))


class _Steps:
    """The steps of a batch of pieces, and passes over all pieces at once, a row of each at a time."""

    def __init__(self, column: pa.ListArray) -> None:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.offsets = column.offsets.to_numpy().astype(np.int64)
        flat = column.flatten()
        self.offsets -= self.offsets[0]
        self.at, self.code, self.copies = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        self.lengths = np.diff(self.offsets)
        self._order = np.argsort(-self.lengths, kind="stable")
        self._alive = np.searchsorted(-self.lengths[self._order], -np.arange(self.lengths.max(initial=0)), "left")

    def rounds(self) -> Iterator[tuple[np.ndarray, int]]:
        for i, n in enumerate(self._alive):
            yield self._order[:n], i

    def matrices(self) -> np.ndarray:
        m = np.tile(np.where(np.eye(4, dtype=bool), 0, FAR), (len(self.lengths), 1, 1))
        for own, i in self.rounds():
            row = self.offsets[own] + i
            m[own] = np.minimum(times(m[own], STEP[self.code[row]]) + DELETE * (self.copies[row] - 1)[:, None, None], FAR)
        return m

    def costs(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By row: costs of reaching its layer's nodes, of going on from them, and from the next layer's."""
        reach, on, after = (np.empty((len(self.code), 4), np.int64) for _ in range(3))
        now = start.copy()
        for own, i in self.rounds():
            row = self.offsets[own] + i
            reach[row] = (now[own][:, :, None] + INSERTS).min(1)
            now[own] = (now[own][:, :, None] + STEP[self.code[row]]).min(1) + DELETE * (self.copies[row] - 1)[:, None]
        now = end.copy()
        for own, i in self.rounds():
            row = self.offsets[own + 1] - 1 - i
            after[row] = now[own]
            now[own] = (STEP[self.code[row]] + now[own][:, None, :]).min(2) + DELETE * (self.copies[row] - 1)[:, None]
            on[row] = now[own]
        return reach, on, after

    def choices(self, reach: np.ndarray, on: np.ndarray, after: np.ndarray, best: np.ndarray) -> np.ndarray:
        """By row and state the least letter of a tight arc: 0 D, 1 I, 2 K, 3 R, 4 none."""
        extra = (DELETE * (self.copies - 1))[:, None]
        best = np.repeat(best, self.lengths)[:, None]
        keeps, stays = (self.code < 8)[:, None], (self.code >> 2 & 1)[:, None]
        to = np.array(KEPT)[:, self.code & 3].T
        kept = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), 1), FAR)
        choice = np.full(reach.shape, 4, np.int8)
        for letter, cost in ((3, np.where(keeps, REROLE + stays + extra + after[:, NEXT], FAR)), (2, np.where(keeps, stays + extra + kept, FAR)), (1, INSERT + on[:, NEXT]), (0, DELETE + extra + after)):
            choice[reach + cost == best] = letter
        return choice


def carried(pieces: DataFrame) -> DataFrame:
    """From conv_id, piece and m (matrix, first and last initial, unlawful neighbours) of every piece: f, costs of reaching it;
    b, costs from its end to the conversation's end, and whether that is its end; total, the whole's cost and unlawful neighbours."""
    most = pieces.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    listed = F.array_sort(F.collect_list(F.struct("piece", "m"))).alias("parts")
    longs = lambda x: F.array(*(F.lit(v).cast("long") for v in x))
    if most <= 1 << FAN_BITS:
        lists = pieces.groupBy("conv_id").agg(listed).select("conv_id", "parts", longs(START).alias("f"), longs(END).alias("b"), F.lit(None).cast("array<long>").alias("total"))
    else:
        lists = stage(pieces.groupBy("conv_id", F.shiftright("piece", FAN_BITS).alias("above")).agg(listed), "lists")
        above = carried(stage(arrow_map(lists, _up, "conv_id long, piece long, m array<long>"), "above")).select(F.col("conv_id").alias("c"), "piece", "f", "b", "total")
        lists = lists.join(above, (F.col("above") == F.col("piece")) & F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "parts", "f", "b", "total")
    return arrow_map(lists, _down, "conv_id long, piece long, f array<long>, b array<long>, total array<long>")


def _parts(x: pa.Scalar) -> tuple[list[int], np.ndarray]:
    values = x.values
    return values.field(0).to_pylist(), np.array(values.field(1).to_pylist(), np.int64)


def _whole(m: np.ndarray) -> np.ndarray:
    whole = m[0].copy()
    for x in m[1:]:
        whole[:16] = times(whole[:16].reshape(4, 4), x[:16].reshape(4, 4)).ravel()
        whole[18] += x[18] + ((whole[17], x[16]) not in _LAWFUL)
        whole[17] = x[17]
    return whole


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield {"conv_id": batch.column(0), "piece": batch.column(1), "m": [_whole(_parts(x)[1]) for x in batch.column(2)]}


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("conv_id", "piece", "f", "b", "total")}
        for conv, parts, f, b, total in zip(*batch.columns, strict=True):
            conv, f, b, total = conv.as_py(), np.array(f.as_py()), np.array(b.as_py()), total.as_py()
            names, m = _parts(parts)
            if total is None:
                whole = _whole(m)
                total = [int(min((f[:, None] + whole[:16].reshape(4, 4)).min(0) + b[:4])), int(whole[18])]
            ends = [b]
            for x in m[:0:-1]:
                ends.append(np.append(np.minimum((x[:16].reshape(4, 4) + ends[-1][:4]).min(1), FAR), 0))
            for name, x, end in zip(names, m, reversed(ends), strict=True):
                for k, v in zip(out, (conv, name, f, end, total), strict=True):
                    out[k].append(v)
                f = np.minimum((f[:, None] + x[:16].reshape(4, 4)).min(0), FAR)
        yield out


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        steps = _Steps(batch.column(2))
        ends = []
        for a, b in zip(steps.offsets, steps.offsets[1:], strict=False):
            own = steps.code[a:b] & 3
            ends.append([own[0], own[-1], sum((x, y) not in _LAWFUL for x, y in zip(own, own[1:], strict=False)) + int((steps.copies[a:b] - 1).sum())])
        yield {"conv_id": batch.column(0), "piece": batch.column(1), "m": list(np.concatenate([steps.matrices().reshape(-1, 16), np.array(ends, np.int64)], axis=1))}


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        steps = _Steps(batch.column(2))
        f, b, total = (np.array(batch.column(i).to_pylist(), np.int64) for i in (3, 4, 5))
        reach, on, after = steps.costs(f, b[:, :4])
        choice = steps.choices(reach, on, after, total[:, 0]).tolist()
        code, copies = steps.code.tolist(), steps.copies.tolist()
        out: dict[str, list] = {k: [] for k in ("m", "walks")}
        for p, (begin, end) in enumerate(zip(steps.offsets.tolist(), steps.offsets[1:].tolist(), strict=False)):
            m, walks = np.full((4, 4), FAR), []
            for q in np.flatnonzero(f[p] + on[begin] == total[p, 0]).tolist():
                walk = {"entry": q, **_walk(q, choice[begin:end], code[begin:end], copies[begin:end], bool(b[p, 4]))}
                m[q, walk.pop("exit")] = 0
                walks.append(walk)
            out["m"].append([*m.ravel(), 0, 0, 0])
            out["walks"].append(walks)
        yield {"conv_id": batch.column(0), "piece": batch.column(1), "at": [steps.at[a:b] for a, b in zip(steps.offsets, steps.offsets[1:], strict=False)], **out}


def _walk(q: int, choice: list[list[int]], code: list[int], copies: list[int], last: bool) -> dict:
    """audit, lead (initials of rows inserted before each row, and at the end), act (K, D, or the new role's initial) and exit."""
    audit, leads, acts = [], [], []
    for at, initial, n in zip(choice, code, copies, strict=True):
        lead = ""
        while at[q] == 1:
            q = NEXT[q]
            lead += STATES[q][0]
        letter = at[q]
        if letter == 2:
            q = KEPT[q][initial & 3]
        elif letter == 3:
            q = NEXT[q]
        audit.append("I" * len(lead) + "DIKR"[letter] + "D" * (n - 1))
        leads.append(lead)
        acts.append("K" if letter == 2 else STATES[q][0] if letter == 3 else "D")
    lead = ""
    while last and q in (1, 2):
        q = NEXT[q]
        lead += STATES[q][0]
    return {"audit": "".join(audit) + "I" * len(lead), "lead": [*leads, lead], "act": acts, "exit": q}


_WALKS = "array<struct<entry: int, audit: string, lead: array<string>, act: array<string>>>"


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of turns (conv_id, turn, role, text, copies): the distinct rows in order (``placed``); total, audit and what is done
    to each row, by piece (conv_id, piece, total, at, audit, lead, act); and the repaired rows (``rewritten``)."""
    rows = placed(turns)
    pieces = stage(pieces_of(rows), "pieces")
    both = lambda a, b: a.join(b.withColumnsRenamed({"conv_id": "c", "piece": "p"}), (F.col("piece") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c"))).drop("c", "p")
    costs = carried(stage(arrow_map(pieces, _matrices, "conv_id long, piece long, m array<long>"), "matrices"))
    whole = stage(both(pieces, costs), "costs")
    walks = stage(arrow_map(whole.select("conv_id", "piece", "steps", "f", "b", "total"), _walks, f"conv_id long, piece long, at array<long>, m array<long>, walks {_WALKS}"), "walks")
    entered = carried(walks.select("conv_id", "piece", "m")).select("conv_id", "piece", "f")
    chosen = both(walks.drop("m"), entered).withColumn("walk", F.filter("walks", lambda w: F.get("f", w["entry"]) == 0)[0])
    chosen = both(chosen.select("conv_id", "piece", "at", "walk.*"), whole.select("conv_id", "piece", "total"))
    chosen = stage(chosen.select("conv_id", "piece", "total", "at", "audit", "lead", "act"), "chosen")
    return rows, chosen, rewritten(rows, chosen)


def rewritten(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """conv_id, role and text of the repaired rows; dealt by conversation, in order within it."""
    each = chosen.select("conv_id", F.explode(F.arrays_zip("at", "lead", "act")).alias("x"), F.element_at("at", -1).alias("end"))
    done = each.select("conv_id", F.coalesce("x.at", "end").alias("at"), F.when(F.col("x.at").isNull(), 2).otherwise(0).alias("part"), "x.lead", "x.act", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    none = F.lit(None).cast("string")
    said = rows.where("first AND NOT blank").select("conv_id", "at", F.lit(1).alias("part"), none.alias("lead"), none.alias("act"), "role", "text")
    both = done.union(said).repartition("conv_id").sortWithinPartitions("conv_id", "at", "part")
    return arrow_map(both, _rewrite, "conv_id long, role string, text string")


_ROLES = {x[0]: x for x in STATES[1:]}


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    act = "D"
    for batch in batches:
        out: dict[str, list] = {"conv_id": [], "role": [], "text": []}
        for conv, part, lead, does, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6)), strict=True):
            if part == 1:
                new = [] if act == "D" else [(role if act == "K" else _ROLES[act], text)]
            else:
                new, act = [(_ROLES[x], "") for x in lead], does or "D"
            for r, t in new:
                out["conv_id"].append(conv)
                out["role"].append(r)
                out["text"].append(t)
        yield out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The digest of each conversation's ``role:text`` lines; rows come by conversation, in order."""
    known, conv, digest = False, None, None
    for batch in batches:
        for c, role, text in zip(*batch.columns, strict=True):
            c = c.as_py()
            if not known or c != conv:
                if known:
                    yield {"conv_id": [conv], "sha": [digest.hexdigest()]}
                known, conv, digest = True, c, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role.as_py()}:{text.as_py()}".encode())
    if known:
        yield {"conv_id": [conv], "sha": [digest.hexdigest()]}


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies after the damage that the contract deals by the crc32 of ``conv_id:turn``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dealt = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), dealt.alias("hit"))
    after: dict[str, Column] = {
        "role": F.when(F.col("hit") == 4, "user").otherwise(F.col("role")),
        "text": F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
        "copies": F.when(F.col("hit") == 3, 2).otherwise(1),
    }
    return rows.where("hit != 0").select("conv_id", "turn", *(c.alias(n) for n, c in after.items()))


def report(rows: DataFrame, chosen: DataFrame, fixed: DataFrame) -> tuple[DataFrame, ...]:
    """Of every conversation with rows: gaps; counts of faults; unlawful neighbours, cost and audit; the repaired rows' digest."""
    gaps = rows.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    faults = rows.groupBy("conv_id").agg(
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"), F.sum(F.when(F.col("blank"), 0).otherwise(F.col("copies") - F.col("first").cast("long"))).alias("duplicate"),
        F.sum((~F.col("blank") & F.col("first") & F.col("cut")).cast("long")).alias("truncated"),
    )
    audits = chosen.groupBy("conv_id").agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("piece", "audit"))).alias("parts"))
    audits = audits.select("conv_id", F.col("total")[1].alias("illegal"), F.col("total")[0].alias("cost"), F.array_join(F.col("parts.audit"), "").alias("audit"))
    return gaps, faults, audits, arrow_map(fixed, _hashed, "conv_id long, sha string").withColumnRenamed("sha", "repaired_sha256")


_NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def op12(conversations: DataFrame) -> DataFrame:
    mark = staged_so_far()
    parts = report(*repair(damaged(conversations)))
    columns = (*_NUMBERS, "audit", "repaired_sha256")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for part in parts:  # one row a conversation each; a sum of them needs no null-safe joins
        every = every.unionByName(part, allowMissingColumns=True)
    found = every.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in columns))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in _NUMBERS} | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))}
    kept = stage(found.select("conv_id", *(v.alias(k) for k, v in zero.items())), "repaired")
    release(mark, kept)
    return kept
