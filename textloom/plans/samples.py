"""Made-up sources, command outputs and edits, and what the rules make of them, for queries with SQL.

A sample is written with WORD (and UPPER) for a name of the row and with a middle line that occurs as often as the row
says, so names and line numbers follow the data. Symbols: name, kind, first and last line; a line is (n, m): n plus m
times the number of middle lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import spread
from ..operators import commands, edits, maps, outline
from ..sources.tables import table

Line = tuple[int, int]
#: language id: text before, middle line, text after, symbols.
SAMPLES: dict[str, tuple[str, str, str, list[tuple[str, str, Line, Line]]]] = {
    "python": (
        "import os.path\nfrom . import q\nclass WORD(B):\n    x: int = 1\n    @a.b(1)\n    def f(self, y: int = 2, *z) -> str:\n", "        pass\n", "        return ''\nMOST_UPPER = 1\nWORD: int = 2\n",
        [("WORD", "class", (3, 0), (7, 1)), ("f", "function", (6, 0), (7, 1)), ("MOST_UPPER", "constant", (8, 1), (8, 1)), ("WORD", "variable", (9, 1), (9, 1))],
    ),
    "json": ('{"WORD": 1, "b": [{}],', "\n", ' "c": {}, "d": []}', [("WORD: number", "variable", (1, 0), (1, 0)), ("b: [](1) {...}", "variable", (2, 0), (2, 0)), ("c: {...}", "variable", (3, 0), (3, 0)), ("d: []", "variable", (4, 0), (4, 0))]),
    "yaml": ("", "# c\n", "WORD:\n  b: 1\n  - c: 2\nd: x\n", [("WORD", "property", (1, 1), (3, 1)), ("b", "property", (2, 1), (2, 1)), ("c", "variable", (3, 1), (3, 1)), ("d", "property", (4, 1), (5, 1))]),
    "toml": ("", "# c\n", "x = 1\n[WORD]\ny = 2\n[[t]]\nz = 1", [("x", "property", (1, 1), (1, 1)), ("[WORD]", "class", (2, 1), (3, 1)), ("y", "property", (3, 1), (3, 1)), ("[[t]]", "variable", (4, 1), (5, 1)), ("z", "property", (5, 1), (5, 1))]),
    "markdown": ("# WORD\n", "text\n", "### B\n```\n# no\n```\n## C\n# D", [("WORD", "class", (1, 0), (1, 1)), ("B", "class", (2, 1), (5, 1)), ("C", "class", (6, 1), (6, 1)), ("D", "class", (7, 1), (7, 1))]),
    "sql": (
        "CREATE TABLE a.WORD (\n", " x int,\n", " y int\n);\ncreate unique index i on b (x);\nALTER TABLE b ADD y int\nCREATE PROCEDURE p AS 1;",
        [("TABLE WORD", "class", (1, 0), (3, 1)), ("INDEX i ON b", "variable", (4, 1), (4, 1)), ("ALTER TABLE b", "variable", (5, 1), (5, 1)), ("FUNCTION p", "function", (6, 1), (6, 1))],
    ),
    "c": ("#define M 1\nstruct WORD {\n", " int a;\n", "};\nint f(int a) {\n  if (a) {\n  }\n}\nint g(void);\n", [("M", "constant", (1, 0), (1, 0)), ("WORD", "class", (2, 0), (3, 1)), ("f", "function", (4, 1), (7, 1)), ("g", "function", (8, 1), (8, 1))]),
    "cpp": (
        "namespace n {\nclass WORD {\npublic:\n", "  // c\n", "  WORD();\n  int f() { return 1; }\n};\n}\nint main() { return 0; }\n",
        [("n", "class", (1, 0), (7, 1)), ("WORD", "class", (2, 0), (6, 1)), ("WORD", "method", (4, 1), (4, 1)), ("f", "method", (5, 1), (5, 1)), ("main", "function", (8, 1), (8, 1))],
    ),
    "rust": (
        "pub struct WORD { x: i32 }\nimpl WORD {\n", "  // c\n", "  fn f(&self) -> char { '{' }\n}\nenum E { A }\n",
        [("WORD", "class", (1, 0), (1, 0)), ("x", "variable", (1, 0), (1, 0)), ("f", "method", (3, 1), (3, 1)), ("E", "enum", (5, 1), (5, 1)), ("A", "variable", (5, 1), (5, 1))],
    ),
    "clojure": ("(ns a.WORD)\n(defn f [x]\n", "  ;; c\n", "  x)\n(def y 1)", [("a.WORD", "module", (1, 0), (1, 0)), ("f", "function", (2, 0), (3, 1)), ("y", "variable", (4, 1), (4, 1))]),
    "typescript": (
        "const WORD = 1\nexport function f(x: number) {\n", "  x()\n", '  return "}"\n}\nclass C {\n  m(): void {}\n}\n',
        [("f", "function", (2, 0), (4, 1)), ("C", "class", (5, 1), (7, 1)), ("m", "method", (6, 1), (6, 1)), ("WORD", "variable", (1, 0), (1, 0))],
    ),
    "go": (
        "package p\ntype WORD struct {\n\tA int\n}\nfunc (t *WORD) M() {\n", "\tx()\n", "}\nfunc f() {}\nconst c = 1\n",
        [("WORD", "class", (2, 0), (4, 0)), ("A", "variable", (3, 0), (3, 0)), ("*WORD.M", "method", (5, 0), (6, 1)), ("f", "function", (7, 1), (7, 1)), ("c", "constant", (8, 1), (8, 1))],
    ),
    "text": ("class WORD\n", " x\n", "def f(x)\nCREATE TABLE t\n", [("WORD", "class", (1, 0), (1, 1)), ("f", "function", (2, 1), (2, 1)), ("t", "table", (3, 1), (3, 1))]),
}


def sources(spark: SparkSession, folder: str, language: str) -> DataFrame:
    """A source a part, as doc_id, text and language_id."""
    before, middle, after, _ = SAMPLES[language]
    word = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    whole = F.concat(F.lit(before), F.repeat(F.lit(middle), "p_size"), F.lit(after))
    named: Column = F.replace(F.replace(whole, F.lit("WORD"), word), F.lit("UPPER"), F.upper(word))
    return spread(table(spark, folder, "part").select("p_partkey", "p_size")).select(F.col("p_partkey").alias("doc_id"), named.alias("text"), F.lit(language).alias("language_id"))


def outlined(language: str):  # noqa: ANN201
    """A query: the symbols of every source of a language."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        found = outline.symbols(outline.file_maps(sources(spark, folder, language)))
        return found.select("doc_id", "name", "kind", "start_line", "end_line")

    return query


def outlined_sql(language: str) -> str:
    rows = ", ".join(f"('{name}', '{kind}', {a}, {b}, {c}, {d})" for name, kind, (a, b), (c, d) in SAMPLES[language][3])
    return f"""WITH v(name, kind, a, b, c, d) AS (VALUES {rows})
SELECT p_partkey AS doc_id, replace(replace(name, 'WORD', 'p' || p_partkey), 'UPPER', 'P' || p_partkey) AS name, kind,
  (a + b * p_size)::INT AS start_line, (c + d * p_size)::INT AS end_line FROM part, v"""


# --- command output ----------------------------------------------------------------------------------------------------

#: route: command, output before, middle line, output after, and what is left of it, as SQL (n: middle lines, w: the word).
OUTPUTS: dict[str, tuple[str, str, str, str, str]] = {
    "build_tools": ("make all", "[ 10%] Building\n" * 9, "make[1]: Entering directory `x'\n", "WORD.c:1: error: bad\nplain", "w || '.c:1: error: bad' || lf || 'plain'"),
    "install": ("npm install", "npm http fetch\n" * 9, "noise\n", "added 3 packages WORD\nup to date in 2s", "'added 3 packages ' || w || lf || 'up to date in 2s'"),
    "docker": (
        "docker build .", "Sending build context\n" * 9, " ---> 0123456789ab\n", "Step 1/2 : FROM WORD\n  Successfully built abc\nERROR: no\nSomething",
        "'Step 1/2 : FROM ' || w || lf || 'Successfully built abc' || lf || 'ERROR: no'",
    ),
    "transfer": ("rsync -av a b", "sending incremental file list\n" * 9, "dir/WORD.txt\n", "done\nsent 10 bytes  received 3 bytes\n   1,234 100%    1.00MB/s", "'done' || lf || 'sent 10 bytes  received 3 bytes'"),
    "git_log": (
        "git log", "WORD c\n" * 10, "c\n", "end",
        "repeat(w || ' c' || lf, 10) || CASE WHEN n > 9 THEN repeat('c' || lf, 10) || '... and ' || (n - 9) || ' more commits' ELSE repeat('c' || lf, n) || 'end' END",
    ),
    "git_diff": (
        "git diff", "diff --git a/WORD.py b/WORD.py\nindex 1..2\n--- a/WORD.py\n+++ b/WORD.py\n@@ -1,9 +1,9 @@\n", " c\n", " c2\n c3\n c4\n-old\n+new\n d0\n d1\n d2\n d3",
        "lf || '📄 ' || w || '.py' || lf || '  @@ -1,9 +1,9 @@' || lf || '  ... (' || n || ' context lines)' || lf || '   c2' || lf || '   c3' || lf || '   c4' || lf || '  -old' || lf || '  +new'"
        " || lf || '   d0' || lf || '   d1' || lf || '   d2' || lf || '  ... (1 context lines)' || lf || '  +1 -1'",
    ),
    "git_status": (
        "git status", "## main...origin/main\nM  a\n M b\nMM c\nUU d\n", "?? WORD\n", "A  WORD.py",
        "'📌 main' || lf || '✅ Staged: 3 files' || lf || '  a' || lf || '  c' || lf || '  ' || w || '.py' || lf || '📝 Modified: 2 files' || lf || '  b' || lf || '  c' || lf"
        " || '❓ Untracked: ' || n || ' files' || lf || repeat('  ' || w || lf, least(n, 3)) || CASE WHEN n > 3 THEN '  ... +' || (n - 3) || ' more' || lf ELSE '' END || '⚠️  Conflicts: 1 files'",
    ),
    "lint": (
        "eslint src", "a/x.ts:1:2: bad [r1]\na/x.ts:2:2: bad [r2]\n", "warning: odd [r3] at WORD.ts:3:4\n", "done",
        "'ESLint: 2 errors, ' || n || ' warnings in 2 files' || lf || repeat('═', 39) || lf || 'Top rules:' || lf || CASE WHEN n > 1 THEN '  r3 (' || n || 'x)' || lf || '  r1 (1x)' || lf || '  r2 (1x)'"
        " ELSE '  r1 (1x)' || lf || '  r2 (1x)' || lf || '  r3 (1x)' END || lf || lf || 'Top files:' || lf || CASE WHEN n > 2 THEN '  ' || w || '.ts (' || n || ' issues)' || lf || '    r3 (' || n || ')' || lf ELSE '' END"
        " || '  a/x.ts (2 issues)' || lf || '    r1 (1)' || lf || '    r2 (1)' || lf || CASE WHEN n > 2 THEN '' ELSE '  ' || w || '.ts (' || n || ' issues)' || lf || '    r3 (' || n || ')' || lf END",
    ),
    "listing": (
        "find . -name x", "a/f\n" * 200, "b/c/WORD\n", "b/c/z\nfind: no: Permission denied",
        "'find: no: Permission denied' || lf || lf || 'a/ (200 files)' || lf || 'b/c/ (' || (n + 1) || ' files)' || lf || lf || 'Total: ' || (n + 201) || ' files in 2 directories'",
    ),
    "http": ("curl http://WORD", "b\n" * 200, "WORD\n", "end", "repeat('b' || lf, 200) || '[... ' || (n + 1) || ' more lines]'"),
    "build": ("cargo build", "", "   Compiling WORD\n", "done", "'✓ Build successful (' || n || ' units compiled)'"),
}


def condensed(route: str):  # noqa: ANN201
    """A query: what is left of the output of a route's command, and how much it saves."""
    command, before, middle, after, _ = OUTPUTS[route]

    def query(spark: SparkSession, folder: str) -> DataFrame:
        word = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
        said = lambda x: F.replace(x, F.lit("WORD"), word)
        output = said(F.concat(F.lit(before), F.repeat(F.lit(middle), "p_size"), F.lit(after)))
        events = spread(table(spark, folder, "part").select("p_partkey", "p_size")).select(F.col("p_partkey").alias("event_id"), said(F.lit(command)).alias("command"), output.alias("output"))
        return commands.condensed(events).select("event_id", "condensed", "saved")

    return query


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def condensed_sql(route: str) -> str:
    command, before, middle, after, left = OUTPUTS[route]
    parts = " || ".join((_literal(before), f"repeat({_literal(middle)}, n)", _literal(after)))
    # sizes are in UTF-16 units: a character beyond the first plane has two
    wide = "length(x) + length(regexp_replace(x, '[^\\x{10000}-\\x{10ffff}]', '', 'g'))"
    return f"""WITH p AS (SELECT p_partkey AS event_id, p_size AS n, 'p' || p_partkey AS w, chr(10) AS lf FROM part),
o AS (SELECT event_id, replace({parts}, 'WORD', w) AS output, {left} AS condensed FROM p)
SELECT event_id, condensed, ({wide.replace('x)', 'output)').replace('(x,', '(output,')}) - ({wide.replace('x)', 'condensed)').replace('(x,', '(condensed,')}) AS saved FROM o"""


# --- edits -------------------------------------------------------------------------------------------------------------

#: Hashes of lines (fixed values).
HASHES = {"alpha": "c8", "beta": "89", "gamma": "6d"}
Edit = tuple[str, str | None, str | None, str | None, str]
#: name: text before, middle line, text after; edits (operation, line named by its text and number, end line, old text,
#: new text); and status and text afterwards, as SQL (n: middle lines, w: the word, t: the text before).
EDITS: dict[str, tuple[str, str, str, list[Edit], str, str]] = {
    "moved": ("", "x\n", "alpha\nbeta\ngamma", [("set_line", "alpha 1", None, None, "WORD")], "CASE WHEN n <= 20 THEN 'applied' ELSE 'mismatch' END", "CASE WHEN n <= 20 THEN replace(t, 'alpha', w) ELSE t END"),
    "range": ("", "x\n", "alpha\nbeta\ngamma\nend", [("replace_lines", "alpha 1+n", "gamma 3+n", None, "WORD\ny")], "'applied'", "repeat('x' || lf, n) || w || lf || 'y' || lf || 'end'"),
    "delete": ("WORD\n", "x\n", "beta\nend", [("set_line", "beta 2+n", None, None, "")], "'applied'", "w || lf || repeat('x' || lf, n) || 'end'"),
    "repeated": ("alpha\n", "x\n", "end", [("insert_after", "alpha 1", None, None, "WORD"), ("insert_after", "alpha 1", None, None, "WORD"), ("set_line", "alpha 1", None, None, "A")], "'applied'", "'A' || lf || w || lf || repeat('x' || lf, n) || 'end'"),
    "echoed": ("alpha\n", "x\n", "beta\nend", [("insert_after", "beta 2+n", None, None, "beta\nWORD")], "'applied'", "'alpha' || lf || repeat('x' || lf, n) || 'beta' || lf || w || lf || 'end'"),
    "prefixed": ("alpha\n", "x\n", "beta", [("set_line", "alpha 1", None, None, "1:c8|WORD"), ("set_line", "beta 2+n", None, None, "+WORD")], "'applied'", "w || lf || repeat('x' || lf, n) || w"),
    "fuzzy": ("“WORD”—it’s  \n", "x\n", "end", [("replace", None, None, "\"WORD\"-it's", "it")], "'applied'", "'it  ' || lf || repeat('x' || lf, n) || 'end'"),
    "stale": ("alpha\n", "x\n", "beta", [("set_line", "beta 1", None, None, "WORD"), ("set_line", "gamma 2+n", None, None, "y")], "'mismatch'", "t"),
    "unchanged": ("alpha\n", "x\n", "WORD", [("set_line", "alpha 1", None, None, "alpha")], "'no_change'", "t"),
    "not_found": ("alpha\n", "x\n", "WORD", [("replace", None, None, "nowhere", "y")], "'not_found'", "t"),
    "beyond": ("alpha\n", "x\n", "WORD", [("set_line", "beta 9+n", None, None, "y")], "'missing_line'", "t"),
}


def _place(named: str | None) -> Column:
    """LINE:HASH of a line that is named by its text and number."""
    if named is None:
        return F.lit(None).cast("string")
    text, number = named.split()
    fixed, _, more = number.partition("+")
    line = F.lit(int(fixed)) + (F.col("p_size") if more else F.lit(0))
    return F.concat(line.cast("string"), F.lit(f":{HASHES[text]}"))


def edited(name: str):  # noqa: ANN201
    """A query: status and text of every document after its edits."""
    before, middle, after, changes, _, _ = EDITS[name]

    def query(spark: SparkSession, folder: str) -> DataFrame:
        parts = table(spark, folder, "part")
        said = lambda x: F.replace(x, F.lit("WORD"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")))
        docs = parts.select(F.col("p_partkey").alias("doc_id"), said(F.concat(F.lit(before), F.repeat(F.lit(middle), "p_size"), F.lit(after))).alias("text"))
        rows = [
            F.struct(
                F.lit(i).alias("idx"), F.lit(op).alias("op"), _place(at).alias("anchor"), _place(end).alias("end_anchor"), said(F.lit(old).cast("string")).alias("old_text"),
                said(F.lit(new)).alias("new_text"), F.lit(False).alias("replace_all"),
            )
            for i, (op, at, end, old, new) in enumerate(changes)
        ]
        asked = parts.select(F.col("p_partkey").alias("doc_id"), F.inline(F.array(*rows)))
        return edits.applied(docs, asked).select("doc_id", "status", "text")

    return query


def edited_sql(name: str) -> str:
    before, middle, after, _, status, text = EDITS[name]
    parts = " || ".join((_literal(before), f"repeat({_literal(middle)}, p_size)", _literal(after)))
    return f"""WITH p AS (SELECT p_partkey AS doc_id, p_size AS n, 'p' || p_partkey AS w, chr(10) AS lf, replace({parts}, 'WORD', 'p' || p_partkey) AS t FROM part)
SELECT doc_id, {status} AS status, {text} AS text FROM p"""


def edit_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls in the older form, half of it, none and the present form, by a part's size; and their documents afterwards."""
    parts = table(spark, folder, "part")
    text = F.concat(F.lit("alpha "), F.col("p_name"))
    turn = F.col("p_size") % 4
    calls = parts.select(
        F.col("p_partkey").alias("doc_id"), F.when(turn < 2, "alpha").alias("oldText"), F.lit(None).cast("string").alias("old_text"), F.lit(None).cast("string").alias("newText"),
        F.when(turn == 0, F.col("p_brand")).alias("new_text"), F.lit(None).cast("boolean").alias("all"),
        F.when(turn == 2, F.array(F.struct(
            F.lit("replace").alias("op"), F.lit(None).cast("string").alias("anchor"), F.lit(None).cast("string").alias("end_anchor"), F.lit("alpha").alias("old_text"), F.lit("beta").alias("new_text"), F.lit(False).alias("replace_all"),
        ))).alias("edits"),
    )
    found = edits.from_calls(calls)
    docs = parts.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))
    done = edits.applied(docs, found.select("doc_id", F.inline("edits"))).select("doc_id", "text")
    said = found.select("doc_id", "status", F.coalesce("message", "warning", F.lit("")).alias("message"))
    return said.join(done, "doc_id", "left").select("doc_id", "status", "message", F.coalesce("text", F.lit("")).alias("text"))


def edit_unchanged_report(spark: SparkSession, folder: str) -> DataFrame:
    """What is said of edits that change nothing: a line set to itself, in every document."""
    parts = table(spark, folder, "part")
    docs = parts.select(F.col("p_partkey").alias("doc_id"), F.concat(F.repeat(F.lit("x\n"), "p_size"), F.lit("alpha")).alias("text"))
    none = F.lit(None).cast("string")
    asked = parts.select(
        F.col("p_partkey").alias("doc_id"), F.lit(0).alias("idx"), F.lit("set_line").alias("op"), F.concat((F.col("p_size") + 1).cast("string"), F.lit(f":{HASHES['alpha']}")).alias("anchor"),
        none.alias("end_anchor"), none.alias("old_text"), F.lit("alpha").alias("new_text"), F.lit(False).alias("replace_all"),
    )
    return edits.applied(docs, asked).select("doc_id", "status", "message", F.size("unchanged").alias("n"))


def mapped(most: int):  # noqa: ANN201
    """A query: the maps of the TypeScript sources within ``most`` bytes."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        docs = sources(spark, folder, "typescript")
        found = outline.file_maps(docs.withColumn("total_bytes", F.octet_length("text")), carried=("total_bytes",))
        return maps.rendered(found.withColumn("name", F.lit("src/f.ts")), most=most)

    return query


def edit_diff(last_only: bool):  # noqa: ANN201
    """A query: the diff of a last line that becomes two, alone or with the first line changed too."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        parts = table(spark, folder, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_size").alias("n"))
        none = F.lit(None).cast("string")
        change = lambda i, at, text: F.struct(F.lit(i).alias("idx"), F.lit("set_line").alias("op"), at.alias("anchor"), none.alias("end_anchor"), none.alias("old_text"), F.lit(text).alias("new_text"), F.lit(False).alias("replace_all"))
        last = change(1, F.concat((F.col("n") + 2).cast("string"), F.lit(f":{HASHES['beta']}")), "last\nmore")
        rows = [last] if last_only else [change(0, F.lit(f"1:{HASHES['alpha']}"), "new"), last]
        docs = parts.select("doc_id", F.concat(F.lit("alpha\n"), F.repeat(F.lit("x\n"), "n"), F.lit("beta")).alias("text"))
        return edits.applied(docs, parts.select("doc_id", F.inline(F.array(*rows)))).select("doc_id", "first_changed", "diff")

    return query


def _map_sql(level: str) -> str:
    head = "lf || bar || lf || 'File Map: f.ts' || lf || len(string_split(t, lf)) || ' lines │ ' || strlen(t) || ' B │ TypeScript' || lf || bar || lf || lf"
    named = {
        "full": "'f(x: number): [2-' || (n + 4) || ']' || lf || 'class C: [' || (n + 5) || '-' || (n + 7) || ']' || lf || '  m(): void: [' || (n + 6) || ']'",
        "outline": "'[Map ≤50.0 KB | outline]' || lf || lf || 'f: [2-' || (n + 4) || ']' || lf || 'class C: [' || (n + 5) || '-' || (n + 7) || ']'",
    }[level]
    before, middle, after, _ = SAMPLES["typescript"]
    return f"""WITH p AS (SELECT p_partkey AS doc_id, p_size AS n, 'p' || p_partkey AS w, chr(10) AS lf, repeat('─', 60) AS bar,
  replace({_literal(before)} || repeat({_literal(middle)}, p_size) || {_literal(after)}, 'WORD', 'p' || p_partkey) AS t FROM part)
SELECT doc_id, '{level}' AS level, {head} || {named} || lf || w || ' = ... [1]' || lf || lf || bar || lf || 'A slice from LINE on shows a symbol''s text.' || lf || bar AS map_text FROM p"""


def _diff_sql(last_only: bool) -> str:
    pad = lambda x: f"lpad(({x})::VARCHAR, d, ' ')"
    kept = lambda a, b: f"array_to_string(list_transform(range({a}, {b}), lambda i: ' ' || {pad('i')} || CASE i WHEN 1 THEN ' alpha' ELSE ' x' END), chr(10))"
    both = f"'-' || {pad(1)} || ' alpha' || lf || '+' || {pad(1)} || ' new' || lf || {kept(2, 'n + 2')}"
    # of n + 1 lines before the change four stay
    one = f"CASE WHEN n > 3 THEN ' ' || repeat(' ', d) || ' ...' || lf || {kept('n - 2', 'n + 2')} ELSE {kept(1, 'n + 2')} END"
    end = f"lf || '-' || {pad('n + 2')} || ' beta' || lf || '+' || {pad('n + 2')} || ' last' || lf || '+' || {pad('n + 3')} || ' more'"
    return f"""WITH p AS (SELECT p_partkey AS doc_id, p_size AS n, length((p_size + 3)::VARCHAR)::INT AS d, chr(10) AS lf FROM part)
SELECT doc_id, {'n + 2' if last_only else '1'} AS first_changed, {one if last_only else both} || {end} AS diff FROM p"""


_MORE = {
    "edit_calls": edit_calls, "edit_unchanged_report": edit_unchanged_report, "edit_diff_between": edit_diff(False), "edit_diff_context": edit_diff(True),
    "map_full": mapped(maps.MOST), "map_outline": mapped(300),
}
_MORE_SQL = {
    "edit_diff_between": _diff_sql(False), "edit_diff_context": _diff_sql(True), "map_full": _map_sql("full"), "map_outline": _map_sql("outline"),
    "edit_calls": """SELECT p_partkey AS doc_id, CASE WHEN p_size % 4 IN (1, 3) THEN 'invalid' ELSE 'ok' END AS status,
  CASE p_size % 4 WHEN 0 THEN 'The text and its replacement were taken as one replacing edit.' WHEN 1 THEN 'A call without edits needs both the text and its replacement.'
    WHEN 3 THEN 'No edits.' ELSE '' END AS message,
  CASE p_size % 4 WHEN 0 THEN p_brand || ' ' || p_name WHEN 2 THEN 'beta ' || p_name ELSE '' END AS text FROM part""",
    "edit_unchanged_report": f"""SELECT p_partkey AS doc_id, 'no_change' AS status,
  'The edits change nothing.' || chr(10) || 'Edit 0 leaves ' || (p_size + 1) || ':{HASHES['alpha']}|alpha as it is.' AS message, 1 AS n FROM part""",
}


def queries() -> dict:
    made = {f"outline_{x}": outlined(x) for x in SAMPLES}
    made |= {f"condensed_{x}": condensed(x) for x in OUTPUTS}
    return made | {f"edit_{x}": edited(x) for x in EDITS} | _MORE


def oracle_sql() -> dict[str, str]:
    made = {f"outline_{x}": outlined_sql(x) for x in SAMPLES}
    made |= {f"condensed_{x}": condensed_sql(x) for x in OUTPUTS}
    return made | {f"edit_{x}": edited_sql(x) for x in EDITS} | _MORE_SQL
