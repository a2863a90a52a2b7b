import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import linehash, text
from textloom.operators import lines


def one(spark, column, *values, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_hash_vectors():
    words = "line1 beta gamma alpha ALPHA BETA INSERTED beta-UPDATED".split()
    assert [linehash.two_digits(w) for w in words] == "02 89 6d c8 f8 21 6d be".split()
    assert linehash.two_digits("exportclassUserDirectory{") == "91"
    assert linehash.two_digits("\ufffd" * 10) == "f5"
    assert linehash.two_digits("") == "05"


def test_plain_hash_is_the_modules():
    xxhash = pytest.importorskip("xxhash")
    rng = random.Random(0)
    for n in range(80):
        data = rng.randbytes(n)
        assert linehash.plain_xxh32(data) == xxhash.xxh32_intdigest(data)


def test_hash_ignores_blanks_and_line_ends(spark):
    got = one(spark, linehash.line_hash("x"), "be ta", "beta\r", "\u00a0beta\u3000", "beta", "bet\u0085a")
    assert got[:4] == ["89"] * 4 and got[4] != "89"


@pytest.mark.parametrize(
    ("raw", "ending", "bare", "n"),
    [("line1\r\nline2\r\nline3\r\n", "crlf", False, 4), ("line1\rline2\rline3\r", "lf", True, 4), ("a\nb\r\n", "lf", False, 3), ("", "lf", False, 1), ("a\n\n", "lf", False, 3)],
)
def test_endings(spark, docs_of, raw, ending, bare, n):
    row = lines.normalised(docs_of(raw)).first()
    assert (row.ending, row.bare_cr) == (ending, bare)
    assert "\r" not in row.text
    assert lines.lines(lines.normalised(docs_of(raw))).count() == n


def test_bom_is_taken_off_once(docs_of):
    row = lines.normalised(docs_of("\ufeff\ufeffx")).first()
    assert (row.has_bom, row.text) == (True, "\ufeffx")


def test_binary(spark):
    cases = [b"a\0b", bytes(range(0xF6, 0x100)), b"\xff\xfe\xfd\xfcNEEDLE\xfb\xfa\xf9", "ok \ufffd".encode(), b""]
    assert one(spark, text.is_binary("x"), *cases, schema="x binary") == [True, True, True, False, False]


def test_truncation(spark):
    assert one(spark, text.truncate("x", 5), "abcde", "abcdef") == ["abcde", "ab..."]
    assert one(spark, text.truncate("x", 2), "ab", "abc") == ["ab", "..."]
    assert one(spark, text.truncate_middle("x", 2), "1\n2\n3\n4") == ["1\n\n... 2 lines omitted ...\n\n4"]
    assert one(spark, text.truncate_middle("x", 4), "1\n2\n3\n4") == ["1\n2\n3\n4"]


def test_ansi(spark):
    assert one(spark, text.strip_ansi("x"), "\x1b[31mred\x1b[0m", "\x1b]0;title\x07x", "\x1b]8;;u\x1b\\y", "plain") == ["red", "x", "y", "plain"]


def test_sizes_and_paths(spark):
    assert one(spark, text.format_size("x"), 1023, 1280, 1024 * 1024, schema="x long") == ["1023 B", "1.3 KB", "1.0 MB"]
    long = "home/someone/projects/engine/source/very/deep/file.py"
    assert one(spark, text.compact_path("x"), "a/b/c/d", long) == ["a/b/c/d", "home/.../deep/file.py"]
    assert one(spark, text.directory("x"), "a", "/a", "a/b/", "a//b", "/", "a/b/c") == [".", "/", "a", "a", "/", "a/b"]


def test_utf16(spark):
    assert one(spark, text.utf16_length("x"), "abc", "é", "📄") == [3, 1, 2]


def test_slice_and_head(docs_of):
    d = docs_of("\n".join(f"l{i}" for i in range(1, 101)))
    assert [(r.line_no, r.text) for r in lines.lines(d, offset=99, limit=5).orderBy("line_no").collect()] == [(99, "l99"), (100, "l100")]
    assert lines.lines(d, offset=200).count() == 0
    got = lines.head(d, most_lines=10).collect()
    assert len(got) == 10 and got[0].total == 100 and got[0].truncated
    # "1:hh|l1" has 7 bytes, each further one a line end more
    assert lines.head(d, most_bytes=7 + 8 * 2).count() == 3
    assert not lines.head(docs_of("x")).first().truncated


def test_anchor_parsing(spark):
    p = lines.parsed_anchor("x")
    refs = ["5:ab", " 5 : AB |text|more", "5:ab  trailing", "0:ab", "5:abc", "x:ab", "5:ab|"]
    got = one(spark, p, *refs)
    assert [(r.line, r.hash, r.content) for r in got] == [
        (5, "ab", None), (5, "AB", "text|more"), (5, "ab", None), (None, None, None), (None, None, None), (None, None, None), (5, "ab", ""),
    ]


def test_similarity(spark):
    d = spark.createDataFrame([("a b c", "b c d e"), (" x ", "x"), ("a", "b")], "a string, b string")
    assert [r[0] for r in d.select(text.token_similarity(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 0.0]
