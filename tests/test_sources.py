from textloom.operators import lines
from textloom.sources import files, splits


def test_scan_statuses_and_empty_files(spark, tmp_path):
    for name, content in {"a.txt": b"x\r\ny", "b.bin": b"\x83\xc8\x1d\x9f", "c.png": b"png", "d.txt": b"", "e.txt": b"a\0b"}.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rpartition("/")[2]: (r.status, r.text) for r in files.scan(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.txt": ("text", "x\r\ny"), "b.bin": ("binary", None), "c.png": ("image", None), "d.txt": ("text", ""), "e.txt": ("binary", None)}
    assert {r.path.rpartition("/")[2] for r in files.scan(spark, f"file://{tmp_path}", "*.txt").collect()} == {"a.txt", "d.txt", "e.txt"}


def test_paths(spark, tmp_path):
    assert files.resolved("@x y", "/w") == "/w/x y"
    assert files.resolved("/a") == "/a"
    assert files.resolved("~/q").endswith("/q") and not files.resolved("~/q").startswith("~")
    (tmp_path / "f").write_text("x")
    assert [files.path_status(spark, f"file://{tmp_path}{p}") for p in ("/f", "", "/none")] == ["ok", "folder", "missing"]


def test_write_back(spark, docs_of):
    raw = "\ufeffa\r\nb\r\n"
    d = lines.normalised(docs_of(raw))
    assert d.select(files.restored("text", "has_bom", "ending").alias("t")).first().t == raw


def test_lines_of_files_keep_the_last(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n\n")
    assert files.text_lines(spark, f"file://{tmp_path}/a.txt").count() == 3


def test_only_changed_files_are_mapped_again(spark):
    now = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "path string, modified long")
    known = spark.createDataFrame([("a", 1, "old"), ("b", 1, "old"), ("z", 1, "old")], "path string, modified long, map string")
    made = []

    def build(stale):
        from pyspark.sql import functions as F

        made.extend(sorted(r.path for r in stale.collect()))
        return stale.select("path", "modified", F.lit("new").alias("map"))

    got = {r.path: r.map for r in files.refreshed(now, known, build).collect()}
    assert made == ["b", "c"] and got == {"a": "old", "b": "new", "c": "new"}


def test_split_lines_equal_whole_ones(spark, tmp_path):
    """Many byte ranges of one file; CRLF, bare CR, marks, long lines, and texts with and without a last line end."""
    import random

    rng = random.Random(8)
    piece = lambda: "".join(rng.choice(("word ", "é", "日本", "", "x" * 300)) for _ in range(rng.randrange(9)))
    texts = {f"r{i}": "".join(piece() + rng.choice(("\n", "\r\n", "\r", "\n\n", "\r\r\n")) for _ in range(rng.randrange(1, 120))) + rng.choice(("", "end", "end\r", "\n")) for i in range(12)}
    texts |= {"one": "x", "end": "x\n", "cr": "a\r", "crlf": "a\r\n", "mark": "\ufeffa\nb", "mark2": "\ufeffa\n", "only": "\n", "big": "".join(f"line {i}\n" for i in range(20_000))}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    got = splits.numbered_lines(spark, f"file://{tmp_path}")
    assert splits._rows(spark, f"file://{tmp_path}/big").rdd.getNumPartitions() > 20
    rows = got.collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")
    found = {}
    for r in rows:
        found.setdefault(r.path.rpartition("/")[2], []).append((r.line_no, r.text))
    for name, text in texts.items():
        want = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n").split("\n")
        assert sorted(found[name]) == list(enumerate(want, 1)), name


def test_parts_of_a_file_are_numbered_through(spark, tmp_path):
    """Parts by the number in their names; a mark is text but at the very start; only the last part has a last empty line."""
    texts = {"a": ["\ufeffx\ny\r\n", "\ufeffz\n\n", "\ufeff\ufeff\n", "w\r\n"], "b": ["one\n", "two"], "c": ["".join(f"{k} {i}\n" for i in range(500)) for k in range(12)]}
    for name, parts in texts.items():
        (tmp_path / f"file={name}").mkdir()
        for i, text in enumerate(parts):
            (tmp_path / f"file={name}" / f"part-{99_995 + i:05}-x.c000.txt").write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    rows = splits.numbered_lines(spark, f"file://{tmp_path}", parts=True).collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, parts in texts.items():
        want = "".join(parts).removeprefix("\ufeff").replace("\r\n", "\n").split("\n")
        assert sorted((r.line_no, r.text) for r in rows if r.path.endswith(f"/file={name}")) == list(enumerate(want, 1)), name


def test_a_file_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from textloom.plans import stored

    spark.range(4000).selectExpr("id AS doc_id", "concat('d', id, '\n', repeat('x', 500)) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(stored.work, "folder", lambda spark, label: f"file://{tmp_path}/texts")
    monkeypatch.setattr(stored, "PART_BYTES", 20_000, raising=False)
    rows = stored.lines_of_files(spark, str(tmp_path)).where("file = 3").collect()
    assert max(f.stat().st_size for f in tmp_path.glob("texts/file=*/part*")) < 60_000
    want = [x for i in range(3, 4000, 16) for x in (f"d{i}", "x" * 500)] + [""]
    assert [r.text for r in sorted(rows, key=lambda r: r.line_no)] == want and len({r.line_no for r in rows}) == len(want)
