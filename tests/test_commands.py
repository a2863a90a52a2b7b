import pyarrow as pa
import pytest

from textloom.operators import commands, condense
from textloom.streaming import commands as stream


def run(spark, *pairs, strict=False):
    d = spark.createDataFrame([(i, c, o) for i, (c, o) in enumerate(pairs)], "event_id long, command string, output string")
    return [(r.route, r.condensed, r.saved) for r in commands.condensed(d, strict).orderBy("event_id").collect()]


LONG = "\n".join(f"line {i}" for i in range(12))


def test_routes(spark):
    cases = [
        ("npm test", "x", "test"), ("  GIT status", "## main", "none"), ("git status", "## main", "git status"), ("git show x", "y", "none"), ("npx eslint .", "", "empty"),
        ("npx eslint .", "ok", "lint"), ("tsc --noEmit", "x", "build"), ("make", "x", "build tools"), ("makefile", "x", "none"), ("cargo build", "x", "build"), ("cargo test", "x", "test"),
        ("npm ci", "x", "install"), ("npm init", "x", "none"), ("sudo docker build .", "x", "docker"), ("ls -la", "x", "listing"), ("ls -a", "x", "none"), ("treeify", "x", "none"),
        ("http GET x", "x", "http"), ("httpd", "x", "none"), ("scp a b", "x", "transfer"), ("echo", "x", "none"), (None, "x", "none"), ("make", None, "empty"),
    ]
    assert [r[0] for r in run(spark, *((c, o) for c, o, _ in cases))] == [want for *_, want in cases]


def test_line_filters(spark):
    make = "\n".join(["make[1]: Entering directory `x'"] * 11 + ["a.c:1: error: bad", "[ 10%] Building warning: odd", "plain"])
    install = "\n".join(["npm http fetch"] * 10 + ["added 3 packages", "up to date in 2s", "noise"])
    docker = "\n".join(["Sending build context", " ---> 0123456789ab", ""] * 4 + ["Step 1/2 : FROM x", "  Successfully built abc", "ERROR: no", "Something"])
    rsync = "\n".join(["sending incremental file list"] + [f"dir/f{i}.txt" for i in range(10)] + ["done", "sent 10 bytes  received 3 bytes", "   1,234 100%    1.00MB/s"])
    got = run(spark, ("make", make), ("npm install", install), ("docker build .", docker), ("rsync -av a b", rsync), ("make", "\n".join(["[ 10%] Building"] * 12)), ("npm i", LONG), ("make", "[ 10%] Building"))
    assert got[0][1] == "a.c:1: error: bad\n[ 10%] Building warning: odd\nplain"
    assert got[1][1] == "added 3 packages\nup to date in 2s"
    assert got[2][1] == "Step 1/2 : FROM x\nSuccessfully built abc\nERROR: no"
    assert got[3][1] == "done\nsent 10 bytes  received 3 bytes"
    assert got[4][0] == got[5][0] == "none" and got[5][1] == LONG
    assert got[6][1] == "[ 10%] Building"


def test_saved_counts_escape_sequences(spark):
    assert run(spark, ("echo", "\x1b[1mhi\x1b[0m"), ("vitest", "\x1b[1m📄")) == [("none", "hi", 8), ("test", "📄", 4)]


def test_git(spark):
    log = "\n".join(["x" * 90] + [f"c{i}" for i in range(24)])
    got = run(spark, ("git log", log), ("git status -sb", "## main...origin/main\nM  a\n M b\nMM c\n?? d\nUU e"), ("git diff", DIFF))
    assert got[0][1].split("\n")[0] == "x" * 77 + "..." and got[0][1].endswith("... and 5 more commits")
    assert got[1][1] == "📌 main\n✅ Staged: 2 files\n  a\n  c\n📝 Modified: 2 files\n  b\n  c\n❓ Untracked: 1 files\n  d\n⚠️  Conflicts: 1 files"
    assert got[2][1] == "\n📄 f.py\n  @@ -1,9 +1,9 @@\n  ... (2 context lines)\n   c2\n   c3\n   c4\n  -old\n  +new\n   d0\n   d1\n   d2\n  ... (1 context lines)\n  +1 -1"


DIFF = "\n".join(["diff --git a/f.py b/f.py", "index 1..2", "--- a/f.py", "+++ b/f.py", "@@ -1,9 +1,9 @@", *(f" c{i}" for i in range(5)), "-old", "+new", *(f" d{i}" for i in range(4))])


def test_large_diff_is_cut_in_the_middle():
    text = "\n".join(["diff --git a/f b/f", "@@ -1 +1 @@", *(f"+{i}" for i in range(200))])
    out = condense.condensed_diff(text).split("\n")
    assert "  ... +103 more changes" in out and out[3] == "  +0" and out[-2] == "  +199"


def test_lint(spark):
    text = "\n".join(["src/a.ts:1:2: bad [no-x]"] * 2 + ["src/b.ts:3:4: worse [no-y]", "warning: hm at src/c.ts:5:6", "noise"])
    out = run(spark, ("eslint src", text), ("eslint src", "all fine"))
    assert out[0][1].startswith("ESLint: 3 errors, 1 warnings in 3 files\n" + "═" * 39 + "\nTop rules:\n  no-x (2x)\n  no-y (1x)\n  unknown (1x)\n\nTop files:\n  src/a.ts (2 issues)\n    no-x (2)\n")
    assert out[1][1] == "✓ ESLint: No issues found"


def test_reports_passed_over_are_read_when_strict(spark):
    stylish = "/w/src/a.ts\n  1:2  error  Bad thing  no-x\n  3:4  warning  Odd  no-y\n"
    compiler = "src/a.ts(1,2): error TS2322: Type"
    plain, strict = run(spark, ("eslint", stylish), ("tsc", compiler)), run(spark, ("eslint", stylish), ("tsc", compiler), strict=True)
    assert plain[0][1] == "✓ ESLint: No issues found" and plain[1][1] == "✓ Build successful (0 units compiled)"
    assert strict[0][1].startswith("ESLint: 1 errors, 1 warnings in 1 files") and "❌ 1 error(s)" in strict[1][1]


def test_build_blocks():
    text = "   Compiling a\nerror[E1]: bad\n  --> x.rs\n   |\n\n more\nerror: second\nwarning: w\nrest\nerror: third"
    units, blocks, warnings = condense.build_blocks(text)
    assert (units, [len(b) for b in blocks], warnings) == (1, [5, 1, 1], 1)
    assert condense.condensed_build("   Compiling a\n   Compiling b\ndone") == "✓ Build successful (2 units compiled)"


def test_listing_and_http():
    text = "\n".join([f"a/f{i}" for i in range(60)] + [f"b/c/f{i}" for i in range(50)] + ["find: no: Permission denied"])
    assert condense.condensed_listing(text) == "find: no: Permission denied\n\na/ (60 files)\nb/c/ (50 files)\n\nTotal: 110 files in 2 directories"
    body = ["HTTP/1.1 200 OK", "Content-Type: x", "", *(f"b{i}" for i in range(205))]
    assert condense.condensed_http("\n".join(body)).split("\n")[-2:] == ["b199", "[... 5 more lines]"]
    assert condense.condensed_http("\n".join(body[3:])).split("\n")[-1] == "[... 5 more lines]"


@pytest.mark.parametrize(
    ("text", "counts"),
    [("12 passed, 1 failed, 2 skipped", (12, 1, 2)), ("Tests 1 failed | 2 passed", (2, 1, 0)), ("test result: ok. 5 passed; 2 failed;", (0, 5, 2)), ("ok a\nok b\nFAIL c", (2, 1, 0))],
)
def test_test_counts(text, counts):
    assert condense.test_counts(text) == counts


def test_test_summaries(spark):
    d = spark.createDataFrame([(0, "pytest", "3 passed"), (1, "pytest | cat", "3 passed"), (2, 'git commit -m "test"', "x"), (3, "jest", "1 failed\n" + "y\n" * 9000)], "event_id long, command string, output string")
    got = [r.summary for r in commands.test_summaries(d).orderBy("event_id").collect()]
    assert got[0] == "📋 Test Results:\n   ✅ 3 passed" and got[1] is None and got[2] is None
    assert got[3].startswith("... (output truncated, showing last 8000 chars)\ny")


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    pairs = [("make", LONG), ("git log", LONG), ("echo", "x")]
    d = spark.createDataFrame([(i, c, o) for i, (c, o) in enumerate(pairs)], stream.SCHEMA)
    d.write.parquet(str(tmp_path / "in"))
    stream.write_condensed(stream.read_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, commands.condensed(d).collect()))
    assert {r.route for r in stream.savings(d).collect()} == {"build tools", "git log", "none"}


def test_a_reducer_that_breaks_shows(spark, monkeypatch):
    def broken(command, output):
        raise KeyError

    events = spark.createDataFrame([(1, "git diff", "diff --git a/x b/x\n"), (2, "find . -name x", "a/b\n" * 30), (3, "echo", "x")], "event_id long, command string, output string")
    assert {r.status for r in commands.condensed(events).collect()} == {"ok"}
    monkeypatch.setitem(commands.REDUCERS, "listing", broken)
    route = pa.array(["listing", "git diff", "listing"])
    got = commands._stateful.func(route, pa.array(["find", "git diff", "find"]), pa.array(["a", "x", None]))
    assert got.field("failed").to_pylist() == [True, False, False]
