"""Sources put together from declaration forms in any order, and the symbols that the rules give for them.

A part's source has 3 to 8 forms; which, follows its key, size and the place. WORD is a name of the part and place. A
form's symbols: name, parent, kind, exported, first and last line in the form; imports are rows of kind ``import``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import spread
from ..operators import outline
from ..sources.tables import table

Row = tuple[str, str | None, str, bool | None, int, int]
Y, N = True, False
IMPORT = "import"

FORMS: dict[str, tuple[str, list[tuple[str, list[Row]]]]] = {
    "typescript": ("", [
        ('import { a } from "./WORD"\n', [("./WORD", None, IMPORT, None, 0, 0)]),
        ('const WORD = "x;{"\n', [("WORD", None, "variable", N, 1, 1)]),
        ('export function WORD(a: string = "}") {\n  return /[}]/\n}\n', [("WORD", None, "function", Y, 1, 3)]),
        ("const WORD = `a\n${ { b: `}` } }\n`\n", [("WORD", None, "variable", N, 1, 3)]),
        ("class WORD {\n  m() { return '}' }\n  n = \"s\"\n}\n", [("WORD", None, "class", N, 1, 4), ("m", "WORD", "method", None, 2, 2), ("n", "WORD", "variable", None, 3, 3)]),
        ("export interface WORD {\n  a: string\n}\n", [("WORD", None, "interface", Y, 1, 3)]),
        ('type WORD = {\n  a: "b"\n} | "c"\n', [("WORD", None, "type", N, 1, 3)]),
        ('export enum WORD { A = "x", B };\n', [("WORD", None, "enum", Y, 1, 1), ("A", "WORD", "variable", None, 1, 1), ("B", "WORD", "variable", None, 1, 1)]),
        ("let WORD = a / b / c; // ' {\n", [("WORD", None, "variable", N, 1, 1)]),
        ("function WORD() {}\nexport { WORD }\n", [("WORD", None, "function", Y, 1, 1)]),
        ("/* { */ export abstract class WORD extends B<C> {\n  private get v(): string { return `{` }\n}\n", [("WORD", None, "class", Y, 1, 3), ("get v", "WORD", "method", None, 2, 2)]),
        ("const WORD = (a: number) => {\n  return a\n}\n", [("WORD", None, "variable", N, 1, 3)]),
    ]),
    "go": ("package p\n", [
        ('import "WORD"\n', [("WORD", None, IMPORT, None, 0, 0)]),
        ('var WORD = "x"\n', [("WORD", None, "variable", N, 1, 1)]),
        ("const WORD = `{\n`\n", [("WORD", None, "constant", N, 1, 2)]),
        ('func WORD(a int) string {\n\treturn "}"\n}\n', [("WORD", None, "function", N, 1, 3)]),
        ('type QWORD struct {\n\tA, B int; C string `json:"{"`\n}\n', [("QWORD", None, "class", Y, 1, 3), ("A", "QWORD", "variable", None, 2, 2), ("B", "QWORD", "variable", None, 2, 2), ("C", "QWORD", "variable", None, 2, 2)]),
        ("type WORD interface {\n\tM() error\n}\n", [("WORD", None, "interface", N, 1, 3), ("M", "WORD", "method", None, 2, 2)]),
        ("func (t *WORD) M() {\n\tx := '{'\n}\n", [("*WORD.M", None, "method", Y, 1, 3)]),
        ('var (\n\tWORD = "a" // {\n)\n', [("WORD", None, "variable", N, 2, 2)]),
        ("type WORD func(a int) error\n", [("WORD", None, "type", N, 1, 1)]),
        ('func QWORD[T any](x T) { y := "a" }\n', [("QWORD", None, "function", Y, 1, 1)]),
    ]),
    "rust": ("", [
        ("use a::WORD;\n", [("a::WORD", None, IMPORT, None, 0, 0)]),
        ('const WORD: &str = r#"{"#;\n', [("WORD", None, "variable", N, 1, 1)]),
        ("pub fn WORD<'a>(x: &'a str) -> char { '{' }\n", [("WORD", None, "function", Y, 1, 1)]),
        ("pub struct WORD { pub a: i32, b: Vec<u8> }\n", [("WORD", None, "class", Y, 1, 1), ("a", "WORD", "variable", Y, 1, 1), ("b", "WORD", "variable", N, 1, 1)]),
        ("enum WORD { A, B(i32) }\n", [("WORD", None, "enum", N, 1, 1), ("A", "WORD", "variable", None, 1, 1), ("B", "WORD", "variable", None, 1, 1)]),
        ("trait WORD {\n    fn m(&self);\n}\n", [("WORD", None, "interface", N, 1, 3), ("m", "WORD", "method", N, 2, 2)]),
        ("struct WORD;\nimpl WORD {\n    pub fn f() -> &'static str { \"}\" }\n}\n", [("WORD", None, "class", N, 1, 1), ("f", "WORD", "method", Y, 3, 3)]),
        ("mod WORD {\n    fn g() {}\n}\n", [("WORD", None, "class", N, 1, 3), ("g", "WORD", "function", N, 2, 2)]),
        ("type WORD = u8; // {\n", [("WORD", None, "type", N, 1, 1)]),
        ("/* { /* } */ */ static WORD: u8 = b'{';\n", [("WORD", None, "variable", N, 1, 1)]),
    ]),
    "cpp": ("", [
        ('#include "WORD.h"\n', [("WORD.h", None, IMPORT, None, 0, 0)]),
        ("int WORD() { return 1; }\n", [("WORD", None, "function", Y, 1, 1)]),
        ("class WORD {\npublic:\n  int f() { return '}'; }\nprivate:\n  int v = 1;\n};\n", [("WORD", None, "class", Y, 1, 6), ("f", "WORD", "method", Y, 3, 3), ("v", "WORD", "variable", N, 5, 5)]),
        ('struct WORD {\n  const char* s = R"x(})x";\n};\n', [("WORD", None, "class", Y, 1, 3), ("s", "WORD", "variable", Y, 2, 2)]),
        ("enum class WORD { A, B };\n", [("WORD", None, "enum", Y, 1, 1), ("A", "WORD", "variable", None, 1, 1), ("B", "WORD", "variable", None, 1, 1)]),
        ("namespace WORD {\nint g() { return 0; } // {\n}\n", [("WORD", None, "class", Y, 1, 3), ("g", "WORD", "function", Y, 2, 2)]),
        ("using WORD = int;\n", [("WORD", None, "type", Y, 1, 1)]),
        ("typedef int WORD;\n", [("WORD", None, "type", Y, 1, 1)]),
        ("template <typename T> T WORD(T a) { return a; }\n", [("WORD", None, "function", Y, 1, 1)]),
        ("/* { */ static int WORD(int a) { return a; }\n", [("WORD", None, "function", N, 1, 1)]),
    ]),
}


def sources(spark: SparkSession, folder: str, language: str) -> DataFrame:
    """A source a part, as doc_id, text and language_id."""
    before, forms = FORMS[language]
    texts = F.array(*(F.lit(text) for text, _ in forms))
    places = F.sequence(F.lit(0), (2 + F.col("p_size") % 6).cast("int"))
    form = lambda j: ((F.col("p_partkey") * (2 * j + 1) + F.col("p_size") + j * j) % len(forms)).cast("int")
    named = lambda j: F.replace(F.get(texts, form(j)), F.lit("WORD"), F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("_"), j.cast("string")))
    text = F.concat(F.lit(before), F.array_join(F.transform(places, named), ""))
    return spread(table(spark, folder, "part").select("p_partkey", "p_size")).select(F.col("p_partkey").alias("doc_id"), text.alias("text"), F.lit(language).alias("language_id"))


def outlined(language: str):  # noqa: ANN201
    """A query: symbols with their parents and export flags, and imports, of every source of a language."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        maps = outline.file_maps(sources(spark, folder, language))
        none = lambda kind: F.lit(None).cast(kind)
        row = lambda *values: F.struct(*(v.alias(n) for v, n in zip(values, ("name", "parent", "kind", "is_exported", "start_line", "end_line"), strict=True)))
        symbols = F.transform("symbols", lambda s: row(s["name"], F.get(s["path"], F.size(s["path"]) - 2), s["kind"], s["is_exported"], s["start_line"], s["end_line"]))
        imports = F.transform("imports", lambda x: row(x, none("string"), F.lit(IMPORT), none("boolean"), F.lit(0), F.lit(0)))
        return maps.select("doc_id", "status", F.inline(F.concat(symbols, imports)))  # one pass: a second use would scan again

    return query


def outlined_sql(language: str) -> str:
    before, forms = FORMS[language]
    said = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool | int) else f"'{x}'"
    lines = ", ".join(f"({i}, {text.count(chr(10))})" for i, (text, _) in enumerate(forms))
    rows = ", ".join(f"({i}, {', '.join(map(said, r))})" for i, (_, own) in enumerate(forms) for r in own)
    word = "'p' || doc_id || '_' || j"
    return f"""WITH f(form, lines) AS (VALUES {lines}), s(form, name, parent, kind, is_exported, a, b) AS (VALUES {rows}),
p AS (SELECT p_partkey AS doc_id, j, (p_partkey * (2 * j + 1) + p_size + j * j) % {len(forms)} AS form FROM part, range(3 + p_size % 6) t(j)),
o AS (SELECT p.*, {before.count(chr(10))} + coalesce(sum(lines) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM p JOIN f USING (form))
SELECT doc_id, 'scanned' AS status, replace(name, 'WORD', {word}) AS name, replace(parent, 'WORD', {word}) AS parent, kind, is_exported::BOOLEAN AS is_exported,
  CASE kind WHEN '{IMPORT}' THEN 0 ELSE base + a END::INT AS start_line, CASE kind WHEN '{IMPORT}' THEN 0 ELSE base + b END::INT AS end_line
FROM o JOIN s USING (form)"""


def queries() -> dict[str, object]:
    return {f"outline_composed_{x}": outlined(x) for x in FORMS}


def oracle_sql() -> dict[str, str]:
    return {f"outline_composed_{x}": outlined_sql(x) for x in FORMS}
