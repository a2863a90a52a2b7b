import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import maps, outline
from textloom.operators.outline.model import flat
from textloom.operators.outline.tokens import Syntax, tokenise
from textloom.plans import composed


def names(text, language):
    found = outline.outline(text, language)
    return [("/".join(path), s.kind, s.start, s.end) for _, _, path, s in flat(found.symbols)] if found else None


CASES = {
    "csv": ('a,b,"c,d"\n1,"x ""y""",3\n', [("1 rows × 3 columns", "table", 1, 3), ("a", "property", 1, 1), ("b", "property", 1, 1), ("c,d", "property", 1, 1), ('Sample: 1, x "y", 3', "variable", 2, 2)]),
    "json": ('{"a": 1, "b": [{}], "c": {}, "d": []}', [("a: number", "variable", 1, 1), ("b: [](1) {...}", "variable", 2, 2), ("c: {...}", "variable", 3, 3), ("d: []", "variable", 4, 4)]),
    "yaml": ("# c\na:\n  b: 1\n  - c: 2\nd: x\n", [("a", "property", 2, 4), ("a/b", "property", 3, 3), ("a/c", "variable", 4, 4), ("d", "property", 5, 6)]),
    "toml": ("x = 1\n[s]\ny = 2\n[[t]]\nz = 1", [("x", "property", 1, 1), ("[s]", "class", 2, 3), ("[s]/y", "property", 3, 3), ("[[t]]", "variable", 4, 5), ("[[t]]/z", "property", 5, 5)]),
    "markdown": ("# A\n### B\n```\n# no\n```\n## C\n# D", [("A", "class", 1, 1), ("A/B", "class", 2, 5), ("A/C", "class", 6, 6), ("D", "class", 7, 7)]),
    "sql": ("CREATE TABLE a.b (\n x int\n);\ncreate unique index i on b (x);\nALTER TABLE b ADD y int\nCREATE PROCEDURE p AS 1;", [("TABLE b", "class", 1, 3), ("INDEX i ON b", "variable", 4, 4), ("ALTER TABLE b", "variable", 5, 5), ("FUNCTION p", "function", 6, 6)]),
    "python": ("import os.path\nclass A:\n    def f(self):\n        pass\nX = 1\ny: int = 2\n", [("A", "class", 2, 4), ("A/f", "function", 3, 4), ("X", "constant", 5, 5), ("y", "variable", 6, 6)]),
    "c": ("#define M 1\nstruct s {\n int a;\n};\nint f(int a) {\n  if (a) {\n  }\n}\nint g(void);\n", [("M", "constant", 1, 1), ("s", "class", 2, 4), ("f", "function", 5, 8), ("g", "function", 9, 9)]),
    "go": ("package p\ntype T struct {\n\tA int\n}\nfunc (t *T) M() {\n}\nfunc f() {}\nconst c = 1\n", [("T", "class", 2, 4), ("T/A", "variable", 3, 3), ("*T.M", "method", 5, 6), ("f", "function", 7, 7), ("c", "constant", 8, 8)]),
    "rust": ("pub struct P { x: i32 }\nimpl P {\n  fn f(&self) -> char { '{' }\n}\nenum E { A }\n", [("P", "class", 1, 1), ("P/x", "variable", 1, 1), ("P/f", "method", 3, 3), ("E", "enum", 5, 5), ("E/A", "variable", 5, 5)]),
    "cpp": ("namespace n {\nclass A {\npublic:\n  A();\n  int f() { return 1; }\n};\n}\nint main() { return 0; }\n", [("n", "class", 1, 7), ("n/A", "class", 2, 6), ("n/A/A", "method", 4, 4), ("n/A/f", "method", 5, 5), ("main", "function", 8, 8)]),
    "clojure": ("(ns a.b)\n(defn f [x]\n  x)\n(def y 1)", [("a.b", "module", 1, 1), ("f", "function", 2, 3), ("y", "variable", 4, 4)]),
    "typescript": ("const a = 1\nexport function f(x: number) {\n  return \"}\"\n}\nclass C {\n  m(): void {}\n}\n", [("f", "function", 2, 4), ("C", "class", 5, 7), ("C/m", "method", 6, 6), ("a", "variable", 1, 1)]),
    "unknown": ("class A\n\ndef f(x)\nCREATE TABLE t\n", [("A", "class", 1, 2), ("f", "function", 3, 3), ("t", "table", 4, 4)]),
}


@pytest.mark.parametrize("language", CASES)
def test_scanners(language):
    assert names(CASES[language][0], language) == CASES[language][1]


@pytest.mark.parametrize("language", [*outline.SCANNERS, "unknown"])
def test_scanners_take_anything(language):
    for text in ("", "\n", "}{)(", "\x00", '"' * 99, "{" * 2000, "(" * 2000, "a" * 50_000, "/* open", "class", "def", "é(\n"):
        found = outline.outline(text, language)
        assert found is None or found.status != "failed"


def test_a_broken_scanner_shows(monkeypatch):
    def broken(text, name):
        raise KeyError

    monkeypatch.setitem(outline.SCANNERS, "go", broken)
    assert (outline.outline("func f() {}", "go").status, outline.outline("x", "go").symbols) == ("failed", [])
    assert outline.outline("x", "go").status == "failed" and outline.outline("def f(): pass", None).status == "keywords"


def composed_text(language, order):
    before, forms = composed.FORMS[language]
    text, rows, line = before, [], before.count("\n")
    for j, i in enumerate(order):
        said, own = forms[i]
        word = f"w{j}"
        text += said.replace("WORD", word)
        rows += [(n.replace("WORD", word), p and p.replace("WORD", word), k, e, line + a if k != "import" else 0, line + b if k != "import" else 0) for n, p, k, e, a, b in own]
        line += said.count("\n")
    return text, rows


@pytest.mark.parametrize("language", composed.FORMS)
def test_declarations_in_any_order(language):
    """Strings, templates, regex literals and comments with brackets in them take no declaration in."""
    rng = random.Random(3)
    for _ in range(60):
        text, want = composed_text(language, [rng.randrange(len(composed.FORMS[language][1])) for _ in range(rng.randrange(1, 12))])
        found = outline.outline(text, language)
        got = [(s.name, path[-2] if len(path) > 1 else None, s.kind, s.exported, s.start, s.end) for _, _, path, s in flat(found.symbols)]
        assert sorted(got + [(i, None, "import", None, 0, 0) for i in found.imports], key=repr) == sorted(want, key=repr), text


@pytest.mark.parametrize("language", [*composed.FORMS, "c", "clojure", "python"])
def test_time_follows_the_source(language):
    import time

    took = []
    for n in (300, 1200):
        if language in composed.FORMS:
            text = composed_text(language, [i % len(composed.FORMS[language][1]) for i in range(5 * n)])[0]
        else:
            text = {"c": "struct s {\n int a;\n};\n", "clojure": "(defn f [x]\n x)\n", "python": "class A:\n  def f(self): pass\n"}[language] * (5 * n)
        took.append(min(_timed(time.process_time, text, language) for _ in range(2)))
    assert took[1] < 5 * took[0] + 0.2


def _timed(clock, text, language):
    began = clock()
    outline.outline(text, language)
    return clock() - began


def test_tokens():
    text = "a(b[\n{ `x${ f({}) }y` } // }\n= /[(]/ ]c /* \n */ '"
    found = tokenise(text, Syntax(templates=True, regex=True))
    assert (found.close[1], found.close[3], found.close[5]) == (len(text), text.index("]c") + 1, text.index("} //") + 1)
    assert found.depth == [0, 0, 0, 0] and [text[a:b] for a, b in found.literals] == ["`x${", "}y`", "/[(]/", "'"]
    assert tokenise("{\n{ /* {\n */\n }\n", Syntax()).depth == [0, 1, 2, 2, 1]


def test_extern_blocks_and_operators():
    found = outline.outline('extern "C" {\nint f(void);\n}\nclass A {\npublic:\n  A operator+(A b);\n  void A::~A();\n};\nstd::vector<int> B::g() {}\n', "cpp")
    assert [(s.name, s.kind) for _, _, _, s in flat(found.symbols)] == [("f", "function"), ("A", "class"), ("operator+", "method"), ("A::~A", "method"), ("B::g", "method")]


def test_json_lines_and_sessions():
    log = "\n".join([
        '{"type":"session","cwd":"/w","timestamp":"2024-01-02T03:04:05Z"}', '{"type":"message","message":{"role":"user","content":[{"type":"text","text":"hi  there"}]}}',
        '{"type":"message","message":{"role":"assistant","content":"x"}}', '{"type":"model_change","provider":"p","modelId":"m"}', '{"type":"compaction"}', '{"type":"message","message":{"role":"user","content":"again"}}', "bad", "",
    ])
    assert names(log, "jsonl") == [
        ("Session: /w (2024-01-02 03:04 UTC)", "module", 1, 1), ("Stats: 2 user, 1 assistant, 1 compaction, 1 model change", "property", 1, 7), ("[User] hi there", "function", 2, 4),
        ("[Model] p/m", "namespace", 4, 4), ("[Compaction]", "namespace", 5, 5), ("[User] again", "function", 6, 7),
    ]
    many = "\n".join('{"k":%d}' % i for i in range(30))
    got = names(many, "jsonl")
    assert got[0][0] == "Schema: object {k}" and len(got) == 7 and got[-1][0] == "... 20 more lines"


def test_long_texts_reach_their_scanner():
    long = "x" * 20_000_001
    log = '{"type":"session","cwd":"/w","timestamp":"2024-01-02T03:04:05Z"}\n{"type":"message","message":{"role":"user","content":"hi"}}\n{"type":"message","message":{"role":"assistant","content":"%s"}}'
    assert names(log % long, "jsonl") == [("Session: /w (2024-01-02 03:04 UTC)", "module", 1, 1), ("Stats: 1 user, 1 assistant", "property", 1, 3), ("[User] hi", "function", 2, 3)]
    assert names(f"# A\n{long}\n# B", "markdown") == [("A", "class", 1, 2), ("B", "class", 3, 3)]
    many = "".join(f"k{i}:\n  a: 1\n" for i in range(50_000))
    assert len(names(many, "yaml")) == 100_000


def test_exports_docs_and_imports():
    ts = outline.outline('import {x} from "./x"\n/** Does. */\nfunction f(a: string): void {}\nexport { f }', "typescript")
    assert (ts.imports, ts.symbols[0].doc, ts.symbols[0].exported, ts.symbols[0].signature) == (["./x"], "Does.", True, "(a: string): void")
    py = outline.outline('import os\nfrom a.b import c\n@d\nasync def _f(x: int, *y) -> str:\n    """Doc.\n    more"""', "python")
    assert py.imports == ["a.b", "os"]
    s = py.symbols[0]
    assert (s.signature, s.modifiers, s.doc, s.exported) == ("(x: int, *y) -> str", ["async", "d"], "Doc.", False)
    py = outline.outline("import os.path\nfrom . import d\nfrom ..e import f\n@a.b(1)\nclass C(B):\n    X = 1\n    y: int\n    class D: pass\n    def f(self):\n        def g(): pass\nMOST: int = 1\na = b = 2\n", "python")
    assert py.imports == [".", "..e", "os.path"]
    assert [(s.name, s.kind, s.signature, s.modifiers) for s in py.symbols] == [("C", "class", None, ["a.b"]), ("MOST", "constant", None, [])]
    assert [(s.name, s.kind, s.children) for s in py.symbols[0].children] == [("D", "class", []), ("f", "function", [])]


def test_go_names_types_and_imports():
    go = outline.outline('package p\nimport f "fmt"\nimport (\n\t_ "a/b"\n\t"c"\n)\nvar a, b int\nconst k = 1\nfunc F[T any](x, y int, z ...string) (n int, err error) {\n}\nfunc (t T) g(int, string) error { return nil }\n', "go")
    assert go.imports == ["f fmt", "a/b", "c"]
    assert [(s.name, s.kind, s.signature, s.exported) for s in go.symbols] == [
        ("a", "variable", " int", False), ("b", "variable", " int", False), ("k", "constant", None, False),
        ("F", "function", "(x int, y int, z ...string) (n int, err error)", True), ("T.g", "method", "(T) g(int, string) error", False),
    ]


def test_comments_between_members():
    cpp = outline.outline("class A {\npublic:\n  // c\n  A();\n  /* d */ int f();\n};\n", "cpp")
    assert [(s.name, s.kind) for s in cpp.symbols[0].children] == [("A", "method"), ("f", "method")]


def test_c_scanner_reads_each_line_once():
    import time

    took = []
    for n in (4_000, 16_000):
        text = "".join(f"int f{i}(int a);\n" for i in range(n)) + "".join(f"int g{i}(void) {{\n  if (a) {{ }}\n}}\n" for i in range(n))
        began = time.process_time()
        found = outline.outline(text, "c")
        took.append(time.process_time() - began)
        assert len(found.symbols) == 2 * n and (found.symbols[-1].start, found.symbols[-1].end) == (n + 3 * n - 2, n + 3 * n)
    assert took[1] < 8 * took[0] + 0.5


def test_language_by_extension(spark):
    d = spark.createDataFrame([(p,) for p in ("a/b.PY", "x.tsx", ".py", "a.b/c", "x.h", "q.edn")], "p string")
    assert [tuple(r) for r in d.select(outline.language(F.col("p")), outline.language(F.col("p"), 1)).collect()] == [
        ("python", "Python"), ("typescript", "TypeScript"), (None, None), (None, None), ("c-header", "C Header"), ("clojure", "EDN"),
    ]


def symbols(n, wide=10):
    return [dict(name=f"s{i}" + "x" * wide, kind="function", start_line=i, end_line=i, signature="(a)", modifiers=[], docstring=None, depth=0) for i in range(1, n + 1)]


def test_map_levels():
    args = ("f.py", 2048, "Python", 10, ["os"])
    s = [dict(name="A", kind="class", start_line=1, end_line=9, signature=None, modifiers=["@d"], docstring="Doc", depth=0), dict(name="m", kind="method", start_line=2, end_line=2, signature="(x)", modifiers=[], docstring=None, depth=1)]
    level, text = maps.render_within(*args, s)
    assert level == "full" and "class @d A: [1-9] — Doc" in text and "  m(x): [2]" in text and "imports: os" in text and "10 lines │ 2.0 KB │ Python" in text
    assert "m: [2]" not in maps.render(*args, s, "outline")
    assert maps.render_within(*args, symbols(600))[0] == "compact"
    assert maps.render_within(*args, symbols(1200))[0] == "outline"
    level, text = maps.render_within(*args, symbols(9000))
    assert level == "truncated" and len(text.encode()) <= maps.MOST and "more symbols ─ ─ ─" in text
    each = int(text.split(" | ")[1].split(" of ")[0]) // 2
    assert len(maps.render(*args, symbols(9000), "truncated", each + 1).encode()) > maps.MOST


def test_maps_of_documents(spark):
    d = spark.createDataFrame([(1, "python", "def f():\n    pass\n", "a/f.py"), (2, "python", "x = (", "g.py"), (3, None, None, None)], "doc_id long, language_id string, text string, name string")
    found = outline.file_maps(d, name="name")
    assert [(r.doc_id, r.name, r.path) for r in outline.symbols(found).collect()] == [(1, "f", ["f"])]
    made = maps.rendered(found.join(d.select("doc_id", "name", F.octet_length("text").alias("total_bytes")), "doc_id")).collect()
    assert len(made) == 1 and made[0].level == "full" and "File Map: f.py" in made[0].map_text


@pytest.mark.parametrize(("language", "text"), [
    ("rust", "pub struct A { pub x: i32 }\nenum E { B }\nimpl A {\n  // c\n  fn f(&self) -> char { '{' }\n}\n" * 20),
    ("cpp", "namespace n {\nclass A {\npublic:\n  // c\n  A();\n  int v = 1;\n};\n}\nenum E { B };\nint f(int a) { return a; }\n" * 20),
])
def test_patterns_are_not_looked_up_again_for_a_statement(language, text, monkeypatch):
    """Millions of small sources: what a statement costs is what they cost."""
    import re

    outline.outline(text, language)
    asked = []
    look_up = re._compile
    monkeypatch.setattr(re, "_compile", lambda *given: asked.append(given) or look_up(*given))
    assert len(outline.outline(text, language).symbols) > 20 and len(asked) == 0
