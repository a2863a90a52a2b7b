"""Benchmark items with a null id still mark the documents that hold them."""

from textloom.llm import decontam

from . import brute


def test_op7_items_with_a_null_id(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "x y"), (3, "x y p q")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, "b c"), (5, "x y"), (None, "p q"), (None, None)], "item_id long, text string")
    want = [(1, 2, 0, brute.sha(""), True), (2, 2, 1, brute.sha("5"), True), (3, 4, 1, brute.sha("5"), True)]
    for words in (decontam.BLOCK_WORDS, 1):
        monkeypatch.setattr(decontam, "BLOCK_WORDS", words)
        got = decontam.op7(docs, benchmark).select("doc_id", "n_hit", "n_items", "items_sha256", "contaminated").collect()
        assert sorted(tuple(r) for r in got) == want
        assert decontam.clean(docs, benchmark).count() == 0
