import threading
import time

from pyspark.sql import functions as F

from textloom.functions import jobs
from textloom.operators import edits, lines, reads, search

ASKED = "request int, doc_id long, " + reads.REQUEST


def test_requests(spark, docs_of):
    docs = lines.normalised(docs_of("a\nb\nc\nd", ""))
    rows = [
        (0, None, None, None, False), (0, 2, 2, None, False), (0, 9, None, None, True), (0, 3, 9, "", True), (0, 0, 0, None, False), (0, -4, 1, None, None),
        (0, None, -1, None, False), (0, 0, None, "f", False), (0, None, None, "f", True), (0, None, None, "f", False), (1, None, None, None, None), (1, 2, None, None, False), (7, None, None, None, True),
    ]
    asked = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ASKED)
    found = reads.answered(docs, asked, most_lines=3).select("doc_id", "start", "most", "symbol", "map", "status", "first_line", "last_line", "truncated", "with_map").collect()
    got = {tuple(r)[:5]: tuple(r)[5:] for r in found}
    assert len(found) == len(rows) - 1
    assert [got[r] for r in rows[:-1]] == [
        ("ok", 1, 3, True, True), ("ok", 2, 3, False, False), ("past_end", None, None, False, False), ("ok", 3, 4, False, True), ("ok", 1, 3, True, True), ("ok", 1, 1, False, False),
        ("ok", None, None, False, False), ("conflict", None, None, False, False), ("conflict", None, None, False, False), ("ok", 1, 3, True, False), ("ok", 1, 1, False, False), ("past_end", None, None, False, False),
    ]


def test_notices(docs_of):
    docs = lines.normalised(docs_of("x\nx\nx", "x\0", None))
    assert search.limit_notice(docs, "x", 4).first() == (4, None)
    assert search.limit_notice(docs, "x", 3).first()["notice"].startswith("[3 matches are shown")
    assert [r.doc_id for r in search.summary(search.text_only(docs), "x").collect()] == [0]
    assert [r.doc_id for r in search.binary_warnings(docs).collect()] == [1]


def test_call_forms(spark):
    one = [("replace", None, None, "a", "b", False)]
    rows = [
        (0, None, "a", None, "b", None, True), (1, None, None, "a", None, "b", None), (2, None, "a", None, None, None, None), (3, None, None, None, None, "b", None),
        (4, None, None, None, None, None, None), (5, [], "a", None, "b", None, None), (6, one, "z", None, None, None, None),
    ]
    got = {r.doc_id: r for r in edits.from_calls(spark.createDataFrame(rows, "doc_id long, " + edits.CALL)).collect()}
    assert [got[i].status for i in range(7)] == ["ok", "ok", "invalid", "invalid", "invalid", "invalid", "ok"]
    assert [bool(got[i].warning) for i in range(7)] == [True, True, False, False, False, False, False]
    assert [tuple(got[i].edits[0]) for i in (0, 1, 6)] == [(0, "replace", None, None, "a", "b", True), (0, "replace", None, None, "a", "b", False), (0, *one[0])]
    assert all(got[i].edits is None for i in (2, 3, 4, 5))


def test_unchanged_edits_are_named():
    row = dict(op="set_line", anchor="1:c8", end_anchor=None, old_text=None, replace_all=False)
    same = edits.edit_text("alpha\nbeta", [row | dict(idx=0, new_text="alpha")])
    assert (same.status, same.unchanged) == ("no_change", [0]) and "1:c8|alpha" in same.message
    back = edits.edit_text("alpha\nbeta", [row | dict(idx=0, new_text="gamma"), dict(idx=1, op="replace", anchor=None, end_anchor=None, old_text="gamma", new_text="alpha", replace_all=False)])
    assert back.status == "no_change" and back.message.endswith("These lines stay as they are:\n1:c8|alpha")


def test_cancel(spark):
    raised = []

    def run():
        with jobs.cancellable(spark, "slow"):
            try:
                spark.range(1 << 40).agg(F.max(F.xxhash64("id"))).collect()
            except Exception as e:
                raised.append(e)

    worker = threading.Thread(target=run, daemon=True)
    worker.start()
    deadline = time.time() + 30
    while worker.is_alive() and time.time() < deadline:
        jobs.cancel(spark, "slow")
        time.sleep(0.5)
    worker.join(1)
    assert raised and spark.range(3).count() == 3
