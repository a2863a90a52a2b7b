"""Outlines of source code: Python by its own parser, the brace languages by a statement scanner, Clojure by a reader."""

from __future__ import annotations

import ast
import re

from .model import Outline, Source, Statement, Symbol, split_top, statements
from .tokens import SIGN, Syntax

TYPESCRIPT = Syntax(templates=True, regex=True)
GO = Syntax(raw="`")
RUST = Syntax(chars=True, nested=True, raw="rust")
CPP = Syntax(raw="cpp")
CLOJURE = Syntax(";", None, '"')


def python(text: str, name: str = "") -> Outline | None:
    """Classes with their methods and nested classes, functions, upper-case constants and annotated names."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    imports = set()
    for node in ast.walk(tree):
        match node:
            case ast.Import(names=names):
                imports.update(x.name for x in names)
            case ast.ImportFrom(module=module, level=level):
                imports.add("." * level + (module or ""))
    symbols = [s for node in tree.body for s in _python(node)]
    return Outline("Python", text.count("\n") + (not text.endswith("\n")), symbols, sorted(imports))


def _python(node: ast.stmt) -> list[Symbol]:
    """A statement's symbols. A function's inside is its own; of a class only what can be called or is a class shows."""
    span = node.lineno, node.end_lineno
    match node:
        case ast.ClassDef(name=name, body=body):
            inner = [s for x in body if isinstance(x, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef) for s in _python(x)]
            return [Symbol(name, "class", *span, None, inner, _decorators(node), _first_line(node), name[0] != "_")]
        case ast.FunctionDef(name=name) | ast.AsyncFunctionDef(name=name):
            marks = ["async"] * isinstance(node, ast.AsyncFunctionDef) + _decorators(node)
            return [Symbol(name, "function", *span, _python_signature(node), [], marks, _first_line(node), name[0] != "_")]
        case ast.Assign(targets=targets) if all(isinstance(t, ast.Name) for t in targets):
            return [Symbol(t.id, "constant", *span) for t in targets if t.id.isupper()]
        case ast.AnnAssign(target=ast.Name(id=name)):
            return [Symbol(name, "constant" if name.isupper() else "variable", *span)]
    return []


def _decorators(node: ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef) -> list[str]:
    called = (d.func if isinstance(d, ast.Call) else d for d in node.decorator_list)
    return [ast.unparse(d) for d in called if isinstance(d, ast.Name | ast.Attribute)]


def _first_line(node: ast.AST) -> str | None:
    return (ast.get_docstring(node) or "").partition("\n")[0].strip() or None


def _python_signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    """The plain and starred parameters (keyword-only ones aren't shown) and the result."""
    a = node.args
    shown = [("", x) for x in a.args] + [(star, x) for star, x in (("*", a.vararg), ("**", a.kwarg)) if x]
    typed = (star + x.arg + (f": {ast.unparse(x.annotation)}" if x.annotation else "") for star, x in shown)
    return f"({', '.join(typed)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")


#: Words that look like a function's name and aren't.
C_CONTROL = ("if", "while", "for", "switch", "return")
_C_FORMS = re.compile(
    r"(?:typedef\s+)?(?P<what>struct|enum|union)\s+(?P<tag>\w+)?\s*\{"
    rf"|(?P<result>\w+(?:\s*\*)?)\s+(?P<name>(?!(?:{'|'.join(C_CONTROL)})\b)\w+)\s*\((?P<given>[^)]*)\)\s*[{{;]?",
    re.A,
)


def c(text: str, name: str = "") -> Outline:
    """Definitions at brace depth 0, and macros anywhere, in one pass.

    Definitions wait on a stack for the brace that closes the first block from their line on, so each line is read once.
    """
    symbols: list[Symbol] = []
    waiting: list[Symbol] = []  # their block has not closed; all of one depth
    depth, net, lines = 0, 0, text.split("\n")
    for number, line in enumerate(lines, 1):
        bare = line.strip()
        if m := re.match(r"#define\s+(\w+)", bare, re.A):
            symbols.append(Symbol(m[1], "constant", number, number))
        elif depth <= 0 and not bare.startswith(("//", "/*")) and (m := _C_FORMS.match(bare)):
            if m["what"]:
                made = Symbol(m["tag"] or "(anonymous)", "enum" if m["what"] == "enum" else "class", number, number, modifiers=["union"] * (m["what"] == "union"))
            else:
                made = Symbol(m["name"], "function", number, number, f"({m['given']}): {m['result']}", exported=not line.strip().startswith("static"))
            symbols.append(made)
            if not waiting:
                net = 0
            waiting.append(made)
        for brace in re.findall("[{}]", line):
            step = 1 if brace == "{" else -1
            depth, net = depth + step, net + step
            if brace == "}" and net == 0:
                for s in waiting:
                    s.end = number
                waiting = []
    return Outline("C", len(lines), symbols)


# --- TypeScript and JavaScript -------------------------------------------------------------------------------------

_TS_HEAD = re.compile(r"(?P<marks>(?:(?:export|default|declare|abstract|async|public|private|protected|static|readonly|override)\s+)*)(?P<rest>[\s\S]*)")
_TS_ORDER = ("function", "class", "interface", "type", "enum", "variable")


def _callable(head: str) -> str:
    """``(parameters): result`` of a declaration's head."""
    at = head.find("(")
    depth = 0
    for i in range(at, len(head)):
        depth += (head[i] == "(") - (head[i] == ")")
        if depth == 0:
            rest = re.match(r"\s*:\s*([\s\S]*?)\s*(?:=>)?\s*$", head[i + 1 :])
            return head[at : i + 1] + (f": {rest[1].rstrip('{; ').strip()}" if rest and rest[1] else "")
    return head[at:]


def typescript(text: str, name: str = "") -> Outline:
    src = Source(text, TYPESCRIPT)
    found: dict[str, list[Symbol]] = {k: [] for k in _TS_ORDER}
    imports: list[str] = []
    exported: set[str] = set()
    for st in statements(src, 0, len(text), newline=True):
        head, masked = src.clean(st.start, st.head_end), " ".join(src.masked[st.start : st.head_end].split())
        whole = src.clean(st.start, st.end)
        if re.match(r"import\b", masked):
            m = re.search(r"""(?:from\s*|import\s*)["']([^"']+)["']""", whole)
            if m and m[1] not in imports:
                imports.append(m[1])
            continue
        if m := re.match(r"export\s*(?:type\s*)?\{([^}]*)\}", whole):
            exported |= {re.split(r"\s+as\s+", x.strip())[0] for x in m[1].split(",")}
            continue
        if m := re.fullmatch(r"export default (\w+);?", whole):
            exported.add(m[1])
            continue
        m = _TS_HEAD.match(masked)
        marks, rest = m["marks"].split(), m["rest"]
        is_exported = "export" in marks
        modifiers = [x for x in marks if x not in ("export", "declare")]
        start, end, doc = src.line(st.start), src.line(max(st.start, st.end - 1)), src.block_doc(st.start)
        add = lambda kind, title, signature=None, children=(): found[kind].append(Symbol(title, kind, start, end, signature, list(children), modifiers, doc, is_exported))  # noqa: E731, B023
        if m := re.match(r"function\s*\*?\s*(\w*)", rest):
            add("function", m[1] or "default", _callable(head))
        elif m := re.match(r"class\s+(\w+)(.*)", rest):
            add("class", m[1], m[2].strip() and f" {m[2].strip()}" or None, _ts_members(src, st))
        elif m := re.match(r"interface\s+(\w+)", rest):
            add("interface", m[1])
        elif m := re.match(r"type\s+(\w+)[^=]*=", rest):
            value = whole.split("=", 1)[1].strip().rstrip(";")
            add("type", m[1], f" = {value if len(value) <= 200 else value[:197] + '...'}")
        elif m := re.match(r"(?:const\s+)?enum\s+(\w+)", rest):
            members = [re.match(r"\s*([\w$]+)", x) for x in split_top(src.masked[slice(*st.body)])] if st.body else []
            names = [x[1] for x in members if x]
            shown = ", ".join(names[:5]) + ", ..." * (len(names) > 5)
            add("enum", m[1], f" {{ {shown} }}", _enum_members(src, st.body))
        elif m := re.match(r"(?:const|let|var)\s+(\w+)\s*(:[^=]+)?", rest):
            add("variable", m[1], m[2].strip() if m[2] else None)
    roots = [s for k in _TS_ORDER for s in found[k]]
    for s in roots:
        s.exported = s.exported or s.name in exported
    return Outline("TypeScript", text.count("\n") + 1, roots, imports)


_ENUM_MEMBER = re.compile(r"\s*([A-Za-z_$][\w$]*)")


def _enum_members(src: Source, body: tuple[int, int] | None) -> list[Symbol]:
    out = []
    if body:
        at = body[0]
        for part in split_top(src.masked[slice(*body)]):
            if m := _ENUM_MEMBER.match(part):
                line = src.line(at + m.start(1))
                out.append(Symbol(m[1], "variable", line, line))
            at += len(part) + 1
    return out


def _ts_members(src: Source, st: Statement) -> list[Symbol]:
    out = []
    for inner in statements(src, *st.body, newline=True) if st.body else ():
        head, masked = src.clean(inner.start, inner.head_end), " ".join(src.masked[inner.start : inner.head_end].split())
        m = _TS_HEAD.match(masked)
        marks, rest = m["marks"].split(), m["rest"]
        span = src.line(inner.start), src.line(max(inner.start, inner.end - 1))
        doc = src.block_doc(inner.start)
        if m := re.match(r"(get|set)\s+([\w$#]+)\s*\(", rest):
            out.append(Symbol(f"{m[1]} {m[2]}", "method", *span, _callable(head), [], marks, doc))
        elif m := re.match(r"\*?([\w$#]+)\s*\??\s*(?:<[^(]*>)?\(", rest):
            out.append(Symbol(m[1], "method", *span, _callable(head), [], marks, doc))
        elif m := re.match(r"([\w$#]+)\s*[?!]?\s*(?::\s*([^=;]+?))?\s*(?:[=;]|$)", rest):
            out.append(Symbol(m[1], "variable", *span, f": {m[2]}" if m[2] else None, [], marks, doc))
    return out


# --- Go --------------------------------------------------------------------------------------------------------------


def go(text: str, name: str = "") -> Outline:
    src = Source(text, GO)
    symbols: list[Symbol] = []
    imports: list[str] = []
    for st in statements(src, 0, len(text), newline=True):
        head, whole = src.clean(st.start, st.head_end), src.text[st.start : st.end]
        span = src.line(st.start), src.line(max(st.start, st.end - 1))
        doc = src.doc_above(st.start, "//")

        def add(title: str, kind: str, signature: str | None = None, lines: tuple[int, int] = span, doc: str | None = doc, children: list[Symbol] | None = None) -> None:
            if title != "_":
                symbols.append(Symbol(title, kind, *lines, signature, children or [], [], doc, "A" <= title.rpartition(".")[2][:1] <= "Z"))

        if head.startswith("import"):
            imports += [f"{alias} {path}" if alias not in ("", ".", "_", "import") else path for alias, path in re.findall(r'(?:([\w.]+)\s+)?"([^"]+)"', whole)]
        elif m := re.match(r"func\s*\(\s*(?:\w+\s+)?(\*?\s*[\w.]+)(?:\[[^\]]*\])?\s*\)\s*(\w+)(.*)", head):
            receiver = m[1].replace(" ", "")
            add(f"{receiver}.{m[2]}", "method", f"({receiver}) {m[2]}{_go_signature(m[3])}")
        elif m := re.match(r"func\s+(\w+)(.*)", head):
            add(m[1], "function", _go_signature(m[2]))
        elif m := re.match(r"(type|const|var)\s*\(", head):
            inside = src.masked.index("(", st.start) + 1
            for part in statements(src, inside, st.end - 1, newline=True):
                line = src.line(part.start), src.line(max(part.start, part.end - 1))
                if n := re.match(r"(\w+(?:\s*,\s*\w+)*)(.*)", src.clean(part.start, part.head_end)):
                    _go_spec(m[1], n[1], n[2].strip(), line, src.doc_above(part.start, "//"), part, src, add)
        elif m := re.match(r"(type|const|var)\s+(\w+(?:\s*,\s*\w+)*)(.*)", head):
            _go_spec(m[1], m[2], m[3].strip(), span, doc, st, src, add)
    return Outline("Go", text.count("\n") + 1, symbols, imports)


def _go_signature(rest: str) -> str:
    """Parameters and results, each name with its type; type parameters aren't shown."""
    out: list[str] = []
    rest = rest.strip()
    while rest[:1] in ("[", "(") and len(out) < 2:
        depth = 0
        for end, ch in enumerate(rest):
            depth += (ch in "[(") - (ch in ")]")
            if depth == 0:
                break
        if rest[0] == "(":
            out.append(f"({', '.join(_go_params(rest[1:end]))})")
        elif out:
            break
        rest = rest[end + 1 :].strip()
    return " ".join([*out, rest] if rest and len(out) < 2 else out)


def _go_params(text: str) -> list[str]:
    parts = [x.strip() for x in split_top(text) if x.strip()]
    typed = [re.match(r"(?!(?:func|map|chan|struct|interface)\b)(\w+)\s+(.+)", x) for x in parts]
    if not any(typed):
        return parts
    out, of = [], ""
    for part, m in zip(reversed(parts), reversed(typed), strict=True):
        of = m[2] if m else of
        out.append(f"{m[1] if m else part} {of}".strip())
    return out[::-1]


def _go_spec(what: str, title: str, rest: str, span: tuple[int, int], doc: str | None, st: Statement, src: Source, add) -> None:  # noqa: ANN001
    if what != "type":
        of = rest.partition("=")[0].strip()
        for one in re.split(r"\s*,\s*", title):
            add(one, "constant" if what == "const" else "variable", f" {of}" if of else None, span, doc)
        return
    kind = "class" if rest.startswith("struct") else "interface" if rest.startswith("interface") else "type"
    children = []
    for part in statements(src, *st.body, newline=True) if st.body and kind != "type" else ():
        text = src.clean(part.start, part.end).rstrip("; ")
        line = src.line(part.start)
        if kind == "interface" and (m := re.match(r"(\w+)(\(.*)", text)):
            children.append(Symbol(m[1], "method", line, line, m[2]))
        elif kind == "class" and (m := re.match(r"(\w+(?:\s*,\s*\w+)*)\s+([^`]+)", text)):
            children += [Symbol(x.strip(), "variable", line, line, f" {m[2].strip()}") for x in m[1].split(",")]
    return add(title, kind, None if kind != "type" else f" {rest}", span, doc, children)


# --- Rust ------------------------------------------------------------------------------------------------------------

_VISIBLE = r"(pub(?:\([^)]*\))?\s+)?"
_RUST_ATTRIBUTES = re.compile(r"(?:\s*#!?\[[^\]]*\]\s*)*")
_RUST_USE = re.compile(_VISIBLE + r"use\s+(.+)")
_RUST_HEAD = re.compile(
    _VISIBLE + r"(?:default\s+)?((?:const\s+|async\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s+)?)*fn|struct|enum|union|trait|unsafe\s+trait|impl|mod|const|static|type|macro_rules!)\b!?\s*(.*)"
)
_RUST_TITLE = re.compile(r"(?:mut\s+)?(\w+)")
_RUST_GENERIC, _RUST_PATH = re.compile(r"^<[^>]*>\s*"), re.compile(r"[\w:]*")
_RUST_FIELD = re.compile(r"(?:\s*#\[[^\]]*\])*\s*(pub(?:\([^)]*\))?\s+)?(\w+)\s*:\s*")


def rust(text: str, name: str = "") -> Outline:
    src = Source(text, RUST)
    imports: list[str] = []
    return Outline("Rust", text.count("\n") + 1, _rust(src, 0, len(text), imports), imports)


def _rust(src: Source, lo: int, hi: int, imports: list[str], member: bool = False) -> list[Symbol]:
    out: list[Symbol] = []
    attached: list[tuple[str, Symbol, list[Symbol]]] = []
    for st in statements(src, lo, hi):
        head, lead = src.clean(st.start, st.head_end).rstrip(" ;"), 0
        if head.startswith("#"):
            head = head[_RUST_ATTRIBUTES.match(head).end() :]
            lead = _RUST_ATTRIBUTES.match(src.masked[st.start : st.head_end]).end()
        if _RUST_USE.match(head):
            imports.append(src.clean(st.start + lead, st.end).rstrip(";").split("use ", 1)[1])
            continue
        m = _RUST_HEAD.match(head)
        if not m:
            continue
        span = src.line(st.start + lead), src.line(max(st.start, st.end - 1))
        doc = src.doc_above(st.start, "///")
        public, what, rest = bool(m[1]), m[2].split()[-1], m[3]
        title = _RUST_TITLE.match(rest)
        new = lambda kind, children=(), t=None: Symbol(t or (title[1] if title else "?"), kind, *span, head, list(children), [], doc, public)  # noqa: E731, B023
        if what == "fn":
            out.append(new("method" if member else "function"))
        elif what in ("struct", "union"):
            fields = _rust_fields(src, st.body)
            out.append(new("class", fields))
        elif what == "enum":
            out.append(new("enum", _enum_members(src, st.body)))
        elif what == "trait":
            out.append(new("interface", _rust(src, *st.body, imports, True) if st.body else ()))
        elif what == "mod":
            out.append(new("class", _rust(src, *st.body, imports) if st.body else ()))
        elif what == "impl":
            target = _RUST_GENERIC.sub("", rest).split(" where ")[0].split(" for ")[-1]
            target = _RUST_PATH.match(target)[0].rpartition("::")[2] or "impl"
            attached.append((target, new("class", t=f"impl {target}"), _rust(src, *st.body, imports, True) if st.body else []))
        elif what == "macro_rules!":
            out.append(Symbol(title[1] if title else "?", "function", *span, head, [], [], doc, False))
        else:
            out.append(new("type" if what == "type" else "variable"))
    owners = {s.name: s for s in out if s.kind in ("class", "enum", "interface")}
    for target, stand_in, methods in attached:
        if owner := owners.get(target):
            owner.children += methods
        else:
            stand_in.children = methods
            out.append(stand_in)
            owners[stand_in.name] = stand_in
    return out


def _rust_fields(src: Source, body: tuple[int, int] | None) -> list[Symbol]:
    out = []
    if body:
        at = body[0]
        for part in split_top(src.masked[slice(*body)]):
            if m := _RUST_FIELD.match(part):
                line = src.line(at + m.start(2))
                out.append(Symbol(m[2], "variable", line, line, f": {src.clean(at + m.end(), at + len(part))}", exported=bool(m[1])))
            at += len(part) + 1
    return out


# --- C++ -------------------------------------------------------------------------------------------------------------


def cpp(text: str, name: str = "") -> Outline:
    directed = "#" in text
    src = Source(_CPP_DIRECTIVE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text) if directed else text, CPP)
    src.text = text
    imports = _CPP_INCLUDE.findall(text) if directed else []
    return Outline("C++", text.count("\n") + 1, _cpp(src, 0, len(text), None, True), imports)


_CPP_NAME = re.compile(r"(?:\w+(?:<[^<>]*>)?::)*(?:operator\s*[^\s\w(]+|~?\w+)")
_CPP_DIRECTIVE = re.compile(r"(?m)^[ \t]*#.*(?:\\\n.*)*$")
_CPP_INCLUDE = re.compile(r'(?m)^\s*#\s*include\s*[<"]([^>"]+)[>"]')
_CPP_ACCESS = re.compile(r"(public|private|protected)\s*:\s*")
_CPP_LEAD = re.compile(r"(?:(?:public|private|protected)\s*:\s*)*")
_CPP_TEMPLATE = re.compile(r"template\s*<")
_CPP_NAMESPACE = re.compile(r"(?:inline\s+)?namespace\s*([\w:]*)\s*$")
_CPP_EXTERN = re.compile(rf"extern\s*{SIGN}*\s*$")
_CPP_CLASS = re.compile(r"(?:typedef\s+)?(class|struct|union)\s+(?:\w+\s*\([^)]*\)\s*)?(\w+)?[^;(]*$")
_CPP_ENUM = re.compile(r"(?:typedef\s+)?enum\s+(?:class\s+|struct\s+)?(\w+)?")
_CPP_USING = re.compile(r"using\s+(\w+)\s*=")
_CPP_TYPEDEF = re.compile(r"typedef\b.*?(\w+)\s*$")
_CPP_OTHER = re.compile(r"(?:using|friend|return|if|for|while|switch|static_assert|class|struct|enum|union)\b")
_CPP_STATIC = re.compile(r"static\b")
_CPP_FIELD = re.compile(r"(?:[\w:<>,*&\s]+?[\s*&])(\w+)\s*(?:\[[^\]]*\])?\s*(?:[={].*)?$")
_CPP_RESULT = re.compile(r"(?:[\w:<>,*&\s~\[\]]|\.\.\.)*")


def _cpp_called(head: str) -> tuple[str, str] | None:
    """What stands before the name that is called first, and that name."""
    at = head.find("(")
    before, last = head[: max(at, 0)].rstrip(), None
    for last in _CPP_NAME.finditer(before):
        pass
    if not last or last.end() != len(before) or not _CPP_RESULT.fullmatch(before, 0, last.start()):
        return None
    return before[: last.start()].strip(), last[0].replace(" ", "")


def _cpp(src: Source, lo: int, hi: int, owner: str | None, public: bool) -> list[Symbol]:
    out: list[Symbol] = []
    for st in statements(src, lo, hi):
        head = src.clean(st.start, st.head_end).rstrip(" ;")
        while m := _CPP_ACCESS.match(head):
            public, head = m[1] == "public", head[m.end() :]
        template = ""
        if _CPP_TEMPLATE.match(head):
            depth = 0
            for i, ch in enumerate(head):
                depth += (ch == "<") - (ch == ">")
                if ch == ">" and depth == 0:
                    template, head = head[: i + 1] + " ", head[i + 1 :].strip()
                    break
        begin = st.start + _CPP_LEAD.match(src.masked[st.start : st.head_end]).end()
        span = src.line(begin), src.line(max(st.start, st.end - 1))
        new = lambda t, kind, sig=None, children=(): Symbol(t, kind, *span, sig, list(children), [], src.block_doc(begin) or src.doc_above(begin, "///"), public)  # noqa: E731, B023
        unnamed = lambda kind: f"<anonymous@{kind}:{span[0]}>"  # noqa: E731, B023
        if m := _CPP_NAMESPACE.match(head):
            out.append(new(m[1] or unnamed("namespace"), "class", head, _cpp(src, *st.body, None, True) if st.body else ()))
        elif st.body and head.startswith("extern") and _CPP_EXTERN.match(src.masked[st.start : st.head_end].strip()):
            out += _cpp(src, *st.body, owner, public)
        elif st.body and (m := _CPP_CLASS.match(head)):
            title = m[2] or unnamed(m[1])
            out.append(new(title, "class", template + head, _cpp(src, *st.body, m[2], m[1] != "class")))
        elif st.body and (m := _CPP_ENUM.match(head)):
            out.append(new(m[1] or unnamed("enum"), "enum", head, _enum_members(src, st.body)))
        elif m := _CPP_USING.match(head):
            out.append(new(m[1], "type", template + head))
        elif m := _CPP_TYPEDEF.match(head):
            out.append(new(m[1], "type", head))
        elif _CPP_OTHER.match(head):
            continue
        elif named := _cpp_called(head):
            result, title = named
            simple = title.rpartition("::")[2]
            method = owner is not None or "::" in title
            if not result and simple.lstrip("~") != (owner or title.split("::")[0]) and not method:
                continue
            symbol = new(title, "method" if method else "function", template + head.split(" : ")[0])
            symbol.exported = public and (owner is not None or not _CPP_STATIC.match(head))
            out.append(symbol)
        elif owner and (m := _CPP_FIELD.match(head)):
            out.append(new(m[1], "variable", head))
    return out


# --- Clojure ---------------------------------------------------------------------------------------------------------

_CLJ = re.compile(r'"(?:\\[\s\S]|[^"\\])*"|;[^\n]*|\\(?:[a-z]+|.)|#\?@?|[()\[\]{}]|[^\s,()\[\]{}";]+')
#: Forms that define something.
CLJ_FORMS = {
    "ns": "module", "def": "variable", "defonce": "variable", "defn": "function", "defn-": "function", "defmacro": "function", "defmulti": "function",
    "defmethod": "method", "defprotocol": "interface", "defrecord": "class", "deftype": "class", "definterface": "interface",
}
_PAIRS = {"(": ")", "[": "]", "{": "}"}


def _read(text: str) -> list:
    """Forms as (start, end, value): value a token, or a list of forms headed by its bracket."""
    stack: list[tuple[int, list]] = [(0, [""])]
    for m in _CLJ.finditer(text):
        token = m[0]
        if token[0] == ";":
            continue
        if token in _PAIRS:
            stack.append((m.start(), [token]))
        elif token in ")]}":
            if len(stack) > 1:
                start, form = stack.pop()
                stack[-1][1].append((start, m.end(), form))
        else:
            stack[-1][1].append((m.start(), m.end(), token))
    while len(stack) > 1:
        start, form = stack.pop()
        stack[-1][1].append((start, len(text), form))
    return stack[0][1][1:]


def clojure(text: str, name: str = "") -> Outline:
    src = Source(text, CLOJURE)
    imports: list[str] = []
    symbols: list[Symbol] = []
    _clojure(_read(text), src, symbols, imports, [])
    return Outline("Clojure", text.count("\n") + 1, symbols, imports)


def _clojure(forms: list, src: Source, out: list[Symbol], imports: list[str], marks: list[str]) -> None:
    after_reader = False
    for start, end, form in forms:
        if form in ("#?", "#?@"):
            after_reader = True
            continue
        if after_reader and isinstance(form, list):
            for key, branch in zip(form[1::2], form[2::2], strict=False):
                _clojure([branch], src, out, imports, [f"platform-{str(key[2]).lstrip(':')}"])
            after_reader = False
            continue
        if not (isinstance(form, list) and form[0] == "(" and len(form) > 2 and form[1][2] in CLJ_FORMS):
            continue
        what = form[1][2]
        parts = [f for f in form[2:] if not (isinstance(f[2], str) and f[2].startswith("^"))]
        private = what == "defn-" or any(isinstance(f[2], str) and f[2].startswith("^:private") for f in form[2:4])
        if not parts or not isinstance(parts[0][2], str):
            continue
        title, rest = parts[0][2], parts[1:]
        doc = None
        if rest and isinstance(rest[0][2], str) and rest[0][2].startswith('"') and (what not in ("def", "defonce") or len(rest) > 1):
            doc = rest[0][2].strip('"').strip().split("\n")[0]
        span = src.line(start), src.line(end - 1)
        params = next((f for f in rest if isinstance(f[2], list) and f[2][0] == "["), None)
        signature = src.clean(params[0], params[1]) if params and what not in ("def", "defonce", "ns") else None
        children = []
        if what == "defmethod" and rest:
            title = f"{title} {src.clean(rest[0][0], rest[0][1])}"
        elif what in ("defprotocol", "definterface"):
            for f in rest:
                if isinstance(f[2], list) and f[2][0] == "(" and len(f[2]) > 1 and isinstance(f[2][1][2], str):
                    children.append(Symbol(f[2][1][2], "method", src.line(f[0]), src.line(f[1] - 1), src.clean(f[2][2][0], f[2][2][1]) if len(f[2]) > 2 else None))
        elif what == "ns":
            imports += _clojure_imports(rest)
        out.append(Symbol(title, CLJ_FORMS[what], *span, signature, children, list(marks), doc, not private))


def _clojure_imports(clauses: list, mark: str = "") -> list[str]:
    found = []
    for _, _, clause in clauses:
        if isinstance(clause, list) and clause[0] == "(" and len(clause) > 1 and clause[1][2] in (":require", ":import", ":use"):
            platform = ""
            for _, _, entry in clause[2:]:
                if entry in ("#?", "#?@"):
                    platform = "?"
                elif platform and isinstance(entry, list):
                    for key, branch in zip(entry[1::2], entry[2::2], strict=False):
                        tag = str(key[2]).lstrip(":")
                        inner = branch[2][1:] if isinstance(branch[2], list) and branch[2] and branch[2][0] == "[" and len(branch[2]) > 1 and isinstance(branch[2][1][2], list) else [branch]
                        found += [f"{_first_name(x[2])} ({tag})" for x in inner]
                    platform = ""
                else:
                    found.append(_first_name(entry))
    return found


def _first_name(entry: object) -> str:
    return str(entry[1][2]) if isinstance(entry, list) and len(entry) > 1 else str(entry)
