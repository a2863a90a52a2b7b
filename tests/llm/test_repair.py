import hashlib
import heapq
import random
import re
from zlib import crc32

import pytest

from textloom.llm import repair

COLS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
LAWFUL = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, lines) of rows (role, text, fault), searched by cost, then audit, over (row, lines' initials)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, lines
        if (i, last) in done:
            continue
        done.add((i, last))
        for r in "ua":
            if to := step.get((last, r)):
                heapq.heappush(heap, (cost + 2, audit + "I", i, to, (*lines, names[r] + ":")))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, lines))
        if fault not in ("blank", "duplicate"):
            more = fault == "truncated"
            if to := step.get((last, role[:1])):
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, to, (*lines, f"{role}:{text}")))
            for r in "ua":
                if to := step.get((last, r)):
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, to, (*lines, f"{names[r]}:{text}")))
    raise AssertionError


def brute(turns):
    space = lambda x: " " if x is None else str(x)
    convs = {}
    for conv, turn, role, text in turns:
        rows = convs.setdefault(conv, [])
        hit = crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        rows += [(turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faulty = set(), []
        for _, role, text in rows:
            said = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            faulty.append((role, text, "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""))
            seen.add((role, text))
        at = [t for t, _, _ in rows if t is not None]
        initials = [role[:1] for role, _, _ in faulty]
        cost, audit, lines = cheapest(faulty)
        assert LAWFUL.fullmatch("".join(x[:1] for x in lines))
        count = lambda x, f=faulty: sum(y[2] == x for y in f)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
        out.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def turns(seed):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    rows = []
    for conv in (*range(25), None):
        for turn in range(rng.randrange(1, 12)):
            rows.append((conv, pick(None, turn, turn, turn, turn + 3), pick("user", "assistant", "system", "user", "tool", "", None), pick("Yes.", "No", " \t", None, f"é {turn}! \x0b", "why?", "a.b")))
    rows += [(500, t, ("user", "assistant")[t % 2], f"{t % 40} said{pick('.', '', '!')}") for t in range(150)]  # a third of all rows
    rows += [(501, 3, "user", "same.")] * 9 + [(502, 0, "user", "x" * 200_000 + ".")]
    return rows + rows[:20]


@pytest.mark.parametrize(("bits", "fan"), [(12, 10), (1, 1)])
def test_op12(spark, monkeypatch, bits, fan):
    """Nulls, empty and very long texts, ties, repeated rows, one hot conversation; as one piece and as many, combined in levels."""
    monkeypatch.setattr(repair, "PIECE_BITS", bits)
    monkeypatch.setattr(repair, "FAN_BITS", fan)
    rows = turns(1)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, piece int, at string").repartition(3)
    assert sorted((tuple(r[c] for c in COLS) for r in repair.op12(docs).collect()), key=repr) == brute(rows)


def test_op12_nothing_left(spark):
    gone = next(i for i in range(999) if crc32(f"{i}:0".encode()) % 20 == 0)
    docs = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r[c] for c in COLS) for r in repair.op12(docs).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.op12(docs.limit(0)).count() == 0
