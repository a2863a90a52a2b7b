import hashlib
import random

import corpus_pipeline as pipeline


def text(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_each_stage_does_its_work(spark, tmp_path):
    item = text(30, 99)
    key = hashlib.sha1(b"x").hexdigest()
    near = text(200, 5).split(" ")
    near[100] = "changed"
    rows = [(i, text(80, i), "xx", "s0") for i in range(10, 40)]
    rows += [(1, "123 456 !!", "xx", "s0"), (2, None, None, None), (3, text(200, 5), "xx", "s1"), (4, " ".join(near), "xx", "s1"), (5, text(40, 6) + " " + item, "xx", "s0"), (6, text(30, 7) + f' token = "{key}" ' + text(30, 8), "xx", "s0")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, whole string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "ngram_jaccard", "decontaminate", "secret_scan", "best_fit_packing"]
    gone = [{1, 2}, {4}, {5}, set()]
    left = {r[0] for r in rows}
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        d = stage(spark, d, str(tmp_path))
        assert d.columns == docs.columns
        left -= gone[i]
        d.write.parquet(str(tmp_path / f"s{i}"))
        d = spark.read.parquet(str(tmp_path / f"s{i}"))
        assert {r.doc_id for r in d.collect()} == left
    (r,) = d.where("doc_id = 6").collect()
    assert '"[SECRET]"' in r.text and key not in r.text and r.n_chars == len(r.text)
    packed = pipeline.STAGES[-1][1](spark, d, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == left
    pieces = {}
    for r in packed.collect():
        pieces.setdefault(r.doc_id, []).append((r.piece, r.text))
    kept = {r.doc_id: r.text for r in d.collect()}
    assert {i: " ".join(t for _, t in sorted(p)).split() for i, p in pieces.items()} == {i: t.split() for i, t in kept.items()}
    assert {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()} == left


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Null and repeated ids, null texts, null sources and a very long text."""
    long = text(250_000, 77)
    rows = [(i, text(80, i), "xx", "s0") for i in range(10, 30)] + [(None, text(60, 41), "xx", None), (None, text(60, 42), None, "s1"), (7, text(60, 43), "xx", "s1"), (7, text(60, 44), "xx", "s1"), (7, text(60, 44), "xx", "s1"), (8, None, "xx", None), (9, long, "xx", "s2")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, text(30, 99)), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.text for r in got if r.doc_id in (None, 7)) == sorted(text(60, i) for i in (41, 42, 43, 44))
    assert " ".join(r.text for r in sorted((r for r in got if r.doc_id == 9), key=lambda r: r.piece)).split() == long.split()
    assert {r.doc_id for r in got} == {*range(10, 30), None, 7, 9}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
