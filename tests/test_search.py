import pytest

from textloom.operators import anchors, lines, ranges, search


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_grep_forms(docs_of):
    d = docs_of("one\nTwo.\nthree", "nothing", "two", "")
    assert rows(search.grep(d, "t.o"), "doc_id", "line_no") == [(2, 1)]
    assert rows(search.grep(d, "t.o", ignore_case=True), "doc_id", "line_no") == [(0, 2), (2, 1)]
    assert rows(search.grep(d, "o.", literal=True), "doc_id", "line_no") == [(0, 2)]
    assert rows(search.grep(d, "TWO.", literal=True, ignore_case=True), "doc_id", "line_no") == [(0, 2)]


def test_context_overlap_and_gaps(docs_of):
    text = "\n".join("x" if i in (2, 4, 9) else f"l{i}" for i in range(1, 13))
    got = rows(search.grep(docs_of(text), "^x$", context=1), "line_no", "kind", "gap")
    assert [g[0] for g in got] == [1, 2, 3, 4, 5, 8, 9, 10]
    assert [g[0] for g in got if g[1] == "match"] == [2, 4, 9]
    assert [g[0] for g in got if g[2]] == [8]


@pytest.mark.parametrize(("n", "shown"), [(50, 50), (51, 10)])
def test_cap_from_51_matches(docs_of, n, shown):
    d = docs_of("\n".join(["x"] * n))
    assert search.grep(d, "x", cap=True).count() == shown
    assert [r.more for r in search.more_matches(d, "x").collect()] == ([41] if n > 50 else [])


def test_summary_and_limit(docs_of):
    d = docs_of("x\nx", "x", "x\nx\nx", "y")
    assert [(r.doc_id, r.matches) for r in search.summary(d, "x").collect()] == [(2, 3), (0, 2), (1, 1)]
    assert [(r.doc_id, r.line_no) for r in search.first_matches(d, "x", 3).collect()] == [(0, 1), (0, 2), (1, 1)]


def test_rendering(docs_of):
    d = docs_of("alpha\nbeta\ngamma")
    assert search.rendered(lines.anchored(search.grep(d, "beta", context=1))).first().block == "--- 0 (1 matches) ---\n0:  1:c8|alpha\n0:>>2:89|beta\n0:  3:6d|gamma"


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ([(10, 20), (15, 25)], [(10, 25)]), ([(10, 20), (22, 30)], [(10, 30)]), ([(10, 20), (23, 30)], [(10, 20), (23, 30)]),
        ([(40, 50), (10, 20), (18, 30)], [(10, 30), (40, 50)]), ([(1, 10), (5, 15), (12, 20)], [(1, 20)]), ([(5, 5)], [(5, 5)]), ([], []),
        ([(1, 100), (5, 6), (50, 60)], [(1, 100)]),
    ],
)
def test_range_merge(spark, given, want):
    df = spark.createDataFrame([(0, a, b) for a, b in given], "doc_id long, start_line int, end_line int")
    once = ranges.merged(df)
    assert rows(once, "start_line", "end_line") == want
    assert rows(ranges.merged(once), "start_line", "end_line") == want


def test_range_lines(spark, docs_of):
    r = spark.createDataFrame([(0, 2, 4)], "doc_id long, start_line int, end_line int")
    assert rows(ranges.expanded(r, docs_of("a\nb\nc")), "line_no", "text") == [(2, "b"), (3, "c"), (4, "")]


def test_anchors_verify_and_move(spark, docs_of):
    n = lines.anchored(lines.lines(docs_of("\n".join(["a", "b", "c", "d", "c"] + [f"x{i}" for i in range(40)] + ["far"]))))
    h = {r.text: r.hash for r in n.collect()}
    a = spark.createDataFrame([(0, 1, h["a"]), (0, 1, h["b"]), (0, 2, h["c"]), (0, 1, h["far"]), (0, 99, h["a"])], "doc_id long, line_no int, hash string")
    assert rows(anchors.verified(a, n), "line_no", "status") == [(1, "changed"), (1, "changed"), (1, "ok"), (2, "changed"), (99, "missing")]
    moved = {(r.line_no, r.hash): r.new_line for r in anchors.relocated(a, n).collect()}
    assert moved[1, h["b"]] == 2 and moved[2, h["c"]] is None and moved[1, h["far"]] is None


def test_similar_lines(spark, docs_of):
    e = spark.createDataFrame([(0, 1, "const a = one")], "doc_id long, line_no int, content string")
    got = anchors.similar(e, docs_of("const a = two\n\nlet b\nconst a = one\nconst c = 1\na const\nnone here")).orderBy("rank").collect()
    assert [(r.found_line, r.rank) for r in got] == [(4, 1), (1, 2), (5, 3)]


def test_symbol_lookup(spark):
    from textloom.operators import symbols

    names = [("parse", ["parse"]), ("parseConfig", ["parseConfig"]), ("canParse", ["canParse"]), ("Foo", ["Foo"]), ("run", ["Foo", "run"]), ("run", ["Bar", "run"]), ("readConfigFile", ["readConfigFile"])]
    s = spark.createDataFrame([(0, i, p, n, i + 1, i + 1) for i, (n, p) in enumerate(names)], "doc_id long, sym_id int, path array<string>, name string, start_line int, end_line int")
    q = ["parse", "PARSE", "Foo.run", "run@5", "run", "pars", "config", "File", "zzz", " ", "Foo. run"]
    got = {r.query: (r.status, r.tier, [c.name for c in r.candidates]) for r in symbols.lookup(s, spark.createDataFrame([(x,) for x in q], "query string")).collect()}
    assert got["parse"] == ("found", "exact", ["parse"])
    assert got["PARSE"] == ("found", "case-insensitive", ["parse"])
    assert got["Foo.run"][:2] == got["Foo. run"][:2] == ("found", "path")
    assert got["run@5"][:2] == ("found", "name@line")
    assert got["run"] == ("ambiguous", "exact", ["run", "run"])
    assert got["pars"] == ("ambiguous", "prefix", ["parse", "parseConfig"])
    assert got["config"] == ("ambiguous", "word", ["parseConfig", "readConfigFile"])
    assert got["File"] == ("found", "word", ["readConfigFile"])
    assert "zzz" not in got and " " not in got
