import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.operators import search, trigrams
from textloom.operators.trigrams import ALL, condition, fold


def holds(c, text):
    have = {fold(text)[i : i + 3] for i in range(len(text))}
    if isinstance(c, str):
        return c == ALL or c in have
    return (all if c[0] == "and" else any)(holds(x, text) for x in c[1])


def test_conditions():
    assert condition("abcd") == ("and", ["abc", "bcd"]) and condition("ABc") == "abc" and condition("ab") == ALL
    assert condition("[Tt]ion") == ("and", ["ion", "tio"]) and condition("ab|cde") == ALL and condition("abc|def") == ("or", ["abc", "def"])
    assert condition("abc.*def") == ("and", ["abc", "def"]) and condition("(ab)+c") == ALL and condition("xyz(?=abc)") == "xyz"
    assert condition("colou?r") == ("or", [("and", ["col", "lor", "olo"]), ("and", ["col", "lou", "olo", "our"])])
    assert condition(r"\Qa.c\E\d") == "a.c" and condition("a.c+", literal=True) == ("and", [".c+", "a.c"]) and condition(r"\p{L}abc") == ALL and condition("(?i)Straße") == condition("straße")
    assert condition("abc*") == ALL and condition("abcd*") == "abc" and condition("abc{2}d") == "abc" and condition("[^a]bcd") == "bcd" and condition("(?x)a b c") == ALL and condition("(unclosed") == ALL


def test_a_text_that_matches_meets_the_condition():
    rng = random.Random(2)
    atoms = ["a", "b", "ab", "abc", "[ab]", "[^a]", ".", "(a|bc)", "(abc|bca|c)", "a?", "b*", "c+", "(ab){2}", "(?:b|ca)?", "^", "$", r"\w", r"\.", "(?=a)", "C"]
    tried = 0
    for _ in range(3000):
        pattern = "".join(rng.choice(atoms) for _ in range(rng.randrange(1, 7)))
        c, matcher = condition(pattern), re.compile(pattern, re.IGNORECASE)
        for _ in range(6):
            text = "".join(rng.choice("abcABC.") for _ in range(rng.randrange(12)))
            if matcher.search(text):
                tried += 1
                assert holds(c, text), (pattern, text, c)
    assert tried > 1000


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(5)
    texts = ["\n".join(" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(6)) for _ in range(3)) for _ in range(200)]
    texts[3] += "\nRare Straße É needle"
    texts[150] += "\nanother NEEDLE\nline"
    texts[7] = None
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = str(tmp_path_factory.mktemp("index")) + "/i"
    trigrams.build(docs, path, F.pmod("doc_id", F.lit(16)))
    return docs, path


@pytest.mark.parametrize(("pattern", "how", "most"), [
    ("needle", {}, 2), ("NEEDLE", {"ignore_case": True}, 2), ("straSSe|nee[dt]le", {"ignore_case": True}, 2), ("STRAße é", {"literal": True, "ignore_case": True}, 1), ("a", {}, 16), ("^[a-f]+ ", {}, 16), ("nowhere at all", {}, 0), ("needle$", {"context": 1}, 2),
])
def test_same_rows_as_the_scan(spark, index, pattern, how, most):
    docs, path = index
    want = sorted(map(tuple, search.grep(docs, pattern, **how).collect()))
    assert sorted(map(tuple, trigrams.grep(spark, path, pattern, **how).collect())) == want
    among = trigrams.blocks(spark, path, pattern, literal=how.get("literal", False))
    assert (16 if among is None else len(among)) <= most


def test_unread_blocks_are_not_opened(spark, index):
    _, path = index
    among = trigrams.blocks(spark, path, "needle")
    plan = trigrams.texts(spark, path, among)._jdf.queryExecution().executedPlan().toString()
    assert len(among) <= 2 and re.search(r"PartitionFilters: \[[^\]]*block#\d+ IN", plan)
    read = {r[0] for r in trigrams.texts(spark, path, among).select(F.input_file_name()).distinct().collect()}
    assert {f.split("block=")[1].split("/")[0] for f in read} == set(map(str, among))
