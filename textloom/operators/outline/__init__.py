"""Structure of documents: language by extension, one scanner a language, and symbols as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.batches import pieces
from . import code, data, prose
from .model import Outline, flat

#: Language id and name by extension.
LANGUAGES = {
    ".py": ("python", "Python"), ".pyw": ("python", "Python"), ".pyi": ("python", "Python"),
    ".ts": ("typescript", "TypeScript"), ".tsx": ("typescript", "TypeScript"), ".mts": ("typescript", "TypeScript"), ".cts": ("typescript", "TypeScript"),
    ".js": ("javascript", "JavaScript"), ".jsx": ("javascript", "JavaScript"), ".mjs": ("javascript", "JavaScript"), ".cjs": ("javascript", "JavaScript"),
    ".go": ("go", "Go"), ".rs": ("rust", "Rust"), ".c": ("c", "C"), ".h": ("c-header", "C Header"),
    ".cpp": ("cpp", "C++"), ".cc": ("cpp", "C++"), ".cxx": ("cpp", "C++"), ".hpp": ("cpp", "C++"), ".hxx": ("cpp", "C++"),
    ".clj": ("clojure", "Clojure"), ".cljs": ("clojure", "ClojureScript"), ".cljc": ("clojure", "Clojure"), ".edn": ("clojure", "EDN"),
    ".sql": ("sql", "SQL"), ".json": ("json", "JSON"), ".jsonc": ("json", "JSON"), ".jsonl": ("jsonl", "JSON Lines"),
    ".md": ("markdown", "Markdown"), ".mdx": ("markdown", "Markdown"), ".yml": ("yaml", "YAML"), ".yaml": ("yaml", "YAML"),
    ".toml": ("toml", "TOML"), ".csv": ("csv", "CSV"), ".tsv": ("csv", "TSV"),
}

SCANNERS: dict[str, Callable[[str, str], Outline | None]] = {
    "python": code.python, "typescript": code.typescript, "javascript": code.typescript, "go": code.go, "rust": code.rust, "c": code.c,
    "c-header": code.cpp, "cpp": code.cpp, "clojure": code.clojure, "sql": prose.sql, "json": data.json_outline, "jsonl": data.jsonl,
    "markdown": prose.markdown, "yaml": data.yaml, "toml": data.toml, "csv": data.csv,
}


def extension(path: Column) -> Column:
    """The lower-cased extension with its dot, or nothing; a leading dot of a name is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def language(path: Column, part: int = 0) -> Column:
    """Language id (part 0) or name (part 1) by extension; null where it is unknown."""
    known = F.create_map(*(F.lit(x) for ext, names in LANGUAGES.items() for x in (ext, names[part])))
    return F.try_element_at(known, extension(path))


def outline(text: str, language_id: str | None, name: str = "") -> Outline | None:
    """The language's scanner; where it finds no structure, the keyword outline; else none.

    One odd document doesn't fail the job, but a scanner that breaks shows in the status, with or without keywords.
    """
    title = next((n for i, n in LANGUAGES.values() if i == language_id), "Unknown")
    found, failed = None, False
    if scan := SCANNERS.get(language_id or ""):
        try:
            found = scan(text, name)
        except Exception:
            failed = True
    if found:
        return found
    found = prose.keywords(text, name, title) or (Outline(title, text.count("\n") + 1, []) if failed else None)
    if found:
        found.status = "failed" if failed else "keywords"
    return found


SYMBOLS = (
    "sym_id int, parent_id int, depth int, path array<string>, name string, kind string, start_line int, end_line int, signature string, "
    "modifiers array<string>, docstring string, is_exported boolean"
)
MAP = f"language string, total_lines int, imports array<string>, detail_level string, status string, symbols array<struct<{SYMBOLS.replace(' int', ':int').replace(' string', ':string').replace(' array', ':array').replace(' boolean', ':boolean')}>>"


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def file_maps(docs: DataFrame, key: str = "doc_id", language_id: str = "language_id", name: str | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """key, language, total_lines, imports, detail_level, status (``Outline.status``) and symbols (flat, in pre-order) of documents with structure.

    Columns named in ``carried`` go along as they are, so that nothing has to be joined to the maps again.
    """
    source = docs.select(F.col(language_id).alias("_l"), (F.col(name) if name else F.lit("")).alias("_n"), F.coalesce("text", F.lit("")).alias("_t"), key, *carried)
    ddl = f"{', '.join(f'{c} {source.schema[c].dataType.simpleString()}' for c in (key, *carried))}, {MAP}"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            asked = zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)
            found = [(i, o) for i, (lang, title, text) in enumerate(asked) if (o := outline(text, lang, title or ""))]
            kept = [c.take(pa.array([i for i, _ in found], pa.int64())) for c in batch.columns[3:]]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip([*kept, *_columns([o for _, o in found], schema)], schema, strict=True)], schema=schema)

    return source.mapInArrow(run, ddl)


def _columns(found: list[Outline], schema: pa.Schema) -> list[pa.Array]:
    """The columns of MAP; all symbols' members as flat columns, which is several times as fast as a dictionary a symbol."""
    whole = ([o.language for o in found], [o.lines for o in found], [o.imports for o in found], [o.level for o in found], [o.status for o in found])
    offsets, rows = [0], []
    for o in found:
        rows += [(i, parent, len(path) - 1, path, s.name, s.kind, s.start, s.end, s.signature, s.modifiers, s.doc, s.exported) for i, parent, path, s in flat(o.symbols)]
        offsets.append(len(rows))
    of = schema.field("symbols").type
    fields = [of.value_type.field(i) for i in range(of.value_type.num_fields)]
    columns = zip(*rows, strict=True) if rows else ([] for _ in fields)
    members = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
    names = ("language", "total_lines", "imports", "detail_level", "status")
    return [*(pa.array(x, schema.field(n).type) for n, x in zip(names, whole, strict=True)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), members)]


def symbols(maps: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a symbol."""
    return maps.select(key, F.inline("symbols"))
