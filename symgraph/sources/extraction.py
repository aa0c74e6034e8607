"""Symbols, containment and references of source files.

Python is parsed by its own grammar. TypeScript, JavaScript, Go, Rust and Java are read by their braces: strings and comments are blanked out, a
table of patterns for each language finds what declarations begin, the braces say where they end, and what lies within another is
contained in it. A file in any other language has its file node. All of it runs in Arrow batches, a file at a time.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = {
    "tag": pa.string(), "id": pa.string(), "kind": pa.string(), "name": pa.string(), "qualified_name": pa.string(), "file_path": pa.string(), "language": pa.string(), "start_line": pa.int32(), "end_line": pa.int32(),
    "source": pa.string(), "target": pa.string(), "line": pa.int32(), "signature": pa.string(), "docstring": pa.string(), "visibility": pa.string(), "is_exported": pa.bool_(), "is_async": pa.bool_(), "is_static": pa.bool_(),
    "is_abstract": pa.bool_(), "decorators": pa.list_(pa.string()),
}
_TYPES = {pa.string(): "string", pa.int32(): "int", pa.bool_(): "boolean", pa.list_(pa.string()): "array<string>"}
ROWS = ", ".join(f"{n} {_TYPES[t]}" for n, t in FIELDS.items())
SCRIPTS = ("typescript", "tsx", "javascript", "jsx")


@dataclass
class Found:
    """The rows of one file."""

    path: str
    language: str
    rows: list[dict] = field(default_factory=list)

    def node(self, kind: str, name: str, qualified: str, first: int, last: int, parent: str | None, **more) -> str:
        me = f"file:{self.path}" if kind == "file" else kind + ":" + hashlib.sha256(f"{self.path}:{kind}:{name}:{first}".encode()).hexdigest()[:32]
        if not name:
            return me
        base = {"is_exported": False, "is_async": False, "is_static": False, "is_abstract": False}
        self.rows.append({"tag": "node", "id": me, "kind": kind, "name": name, "qualified_name": qualified, "file_path": self.path, "language": self.language, "start_line": first, "end_line": last, **base, **more})
        if parent:
            self.rows.append({"tag": "edge", "kind": "contains", "source": parent, "target": me, "file_path": self.path, "language": self.language})
        return me

    def ref(self, kind: str, name: str | None, line: int, owner: str) -> None:
        if name:
            self.rows.append({"tag": "ref", "kind": kind, "name": name, "source": owner, "line": line, "file_path": self.path, "language": self.language})


# Python


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        left = _dotted(node.value)
        return node.attr if left in (None, "self", "cls") else f"{left}.{node.attr}"
    return None


def _comments_above(lines: list[str], first: int, mark: str = "#") -> str | None:
    """The comment lines right above a line (counted from 1), without their marks."""
    out: list[str] = []
    at = first - 2
    while at >= 0 and lines[at].strip().startswith(mark):
        out.append(lines[at].strip().lstrip(mark).strip())
        at -= 1
    return "\n".join(reversed(out)) or None


def _python(found: Found, content: str, top: str) -> None:
    lines = content.split("\n")

    def calls(tree: ast.AST, owner: str, names: tuple[str, ...]) -> None:
        """Calls belong to the outer function, also those of functions within; classes within are symbols."""
        if isinstance(tree, ast.ClassDef):
            visit([tree], owner, names, False)
            return
        if isinstance(tree, ast.Call):
            found.ref("calls", _dotted(tree.func), tree.lineno, owner)
        for x in ast.iter_child_nodes(tree):
            calls(x, owner, names)

    def visit(body: list[ast.stmt], owner: str, names: tuple[str, ...], in_class: bool) -> None:
        for x in body:
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                is_class = isinstance(x, ast.ClassDef)
                marks = [d for d in (_dotted(d.func if isinstance(d, ast.Call) else d) for d in x.decorator_list) if d]
                kind = "class" if is_class else "property" if in_class and "property" in marks else "method" if in_class else "function"
                more = {"decorators": marks or None, "docstring": _comments_above(lines, min([x.lineno, *(d.lineno for d in x.decorator_list)]))}
                if not is_class:
                    returns = f" -> {ast.unparse(x.returns)}" if x.returns else ""
                    more |= {"signature": f"({ast.unparse(x.args)}){returns}", "is_async": isinstance(x, ast.AsyncFunctionDef), "is_static": "staticmethod" in marks, "is_abstract": any(m.endswith("abstractmethod") for m in marks)}
                me = found.node(kind, x.name, "::".join([*names, x.name]), x.lineno, x.end_lineno or x.lineno, owner, **more)
                for d in marks:
                    found.ref("decorates", d, x.lineno, me)
                if is_class:
                    for b in x.bases:
                        found.ref("extends", _dotted(b.value if isinstance(b, ast.Subscript) else b), x.lineno, me)
                    visit(x.body, me, (*names, x.name), True)
                else:
                    for y in x.body:
                        calls(y, me, (*names, x.name))
            elif isinstance(x, ast.Import):
                for a in x.names:
                    found.node("import", a.name, "::".join([*names, a.name]), x.lineno, x.end_lineno or x.lineno, owner, signature=ast.unparse(x))
            elif isinstance(x, ast.ImportFrom):
                module = "." * x.level + (x.module or "")
                found.node("import", module, "::".join([*names, module]), x.lineno, x.end_lineno or x.lineno, owner, signature=ast.unparse(x))
                for name in [module, *[a.asname or a.name for a in x.names if a.name != "*"]]:
                    found.ref("imports", name, x.lineno, owner)
            elif isinstance(x, ast.Assign | ast.AnnAssign) and not in_class and isinstance(t := x.targets[0] if isinstance(x, ast.Assign) else x.target, ast.Name) and not (isinstance(x, ast.Assign) and len(x.targets) > 1):
                value = ast.unparse(x.value) if x.value is not None else None
                sign = None if value is None else "= " + value[:100] + ("..." if len(value) > 100 else "")
                found.node("constant" if t.id.isupper() else "variable", t.id, "::".join([*names, t.id]), x.lineno, x.end_lineno or x.lineno, owner, signature=sign)
                calls(x, owner, names)
            elif isinstance(x, ast.If | ast.Try | ast.With | ast.For | ast.While):
                for y in ast.iter_child_nodes(x):
                    if isinstance(y, ast.stmt):
                        visit([y], owner, names, in_class)
                    elif isinstance(y, ast.ExceptHandler):
                        visit(y.body, owner, names, in_class)
                    else:
                        calls(y, owner, names)
            else:
                calls(x, owner, names)

    visit(ast.parse(content).body, top, (), False)


# Languages with braces

_BLANK = {
    "script": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`", re.S),
    "go": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`", re.S),
    "rust": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])'|\"(?:\\.|[^\"\\])*\"", re.S),
    "java": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*'|\"\"\".*?(?:\"\"\"|\Z)|\"(?:\\.|[^\"\\\n])*\"", re.S),
}
_GENERIC = r"(?:<[^{};()]*>)?"
_JAVA_MODS = r"(?=\S)(?P<mods>(?:(?:public|private|protected|static|final|abstract|synchronized|default|native)\s+)*)"
#: (kind, pattern, where it may stand): top - in a file or namespace, type - right in a type, any. A pattern ends before the body's brace.
_DECLARED = {
    "script": [
        ("class", r"(?P<mods>(?:export\s+|default\s+|abstract\s+)*)\bclass\s+(?P<name>\w+)" + _GENERIC + r"(?P<heirs>[^{;]*)(?=\{)", "any"),
        ("interface", r"(?P<mods>(?:export\s+|default\s+)*)\binterface\s+(?P<name>\w+)" + _GENERIC + r"(?P<heirs>[^{;]*)(?=\{)", "any"),
        ("enum", r"(?P<mods>(?:export\s+|const\s+)*)\benum\s+(?P<name>\w+)\s*(?=\{)", "any"),
        ("type_alias", r"(?P<mods>(?:export\s+)*)\btype\s+(?P<name>\w+)\s*" + _GENERIC + r"\s*=", "top"),
        ("function", r"(?P<mods>(?:export\s+|default\s+|async\s+)*)\bfunction\s*\*?\s*(?P<name>\w+)\s*" + _GENERIC + r"\s*(?P<sign>\([^{;]*)(?=\{)", "top"),
        ("function", r"(?P<mods>(?:export\s+)*)\b(?:const|let|var)\s+(?P<name>\w+)[^=;{}]*=\s*(?P<async>async\s*)?(?P<sign>" + _GENERIC + r"\([^;{}]*\)[^;{}=]*=>|\w+\s*=>|function\b[^{;]*)", "top"),
        ("bound", r"(?P<mods>(?:export\s+)*)\b(?P<word>const|let|var)\s+(?P<name>\w+)\s*(?::[^=;{}]*)?(?P<value>=[^;\n]*)?", "top"),
        ("method", r"(?P<mods>(?:(?:public|private|protected|static|async|abstract|readonly|override|get|set)\s+)*)(?<![\w.])(?P<name>[\w$#]+)\s*" + _GENERIC + r"\s*(?P<sign>\((?:[^(){};]|\([^(){};]*\))*\)\s*(?::[^{};]*)?)(?=\{)", "type"),
        ("property", r"(?P<mods>(?:(?:public|private|protected|static|abstract|readonly|declare)\s+)*)(?<![\w.])(?P<name>[\w$#]+)\s*[?!]?\s*(?P<sign>:[^;{}()=\n]+|=[^;\n{}(]*)\s*(?:[;\n=])", "type"),
    ],
    "go": [
        ("method", r"\bfunc\s*\(\s*\w*\s*\*?\s*(?P<receiver>\w+)[^)]*\)\s*(?P<name>\w+)\s*(?P<sign>\([^{]*)(?=\{)", "top"),
        ("function", r"\bfunc\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?\s*(?P<sign>\([^{]*)(?=\{)", "top"),
        ("struct", r"\btype\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?\s*struct\s*(?=\{)", "top"),
        ("interface", r"\btype\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?\s*interface\s*(?=\{)", "top"),
        ("type_alias", r"\btype\s+(?P<name>\w+)\s*=?\s*(?!struct\b|interface\b|=)[\w\[\]*.]", "top"),
        ("bound", r"(?m)^(?P<word>const|var)\s+(?P<name>\w+)[^=\n(]*(?P<value>=[^\n]*)?", "top"),
    ],
    "rust": [
        ("function", r"(?P<mods>(?:pub(?:\([^)]*\))?\s+|async\s+|const\s+|unsafe\s+)*)\bfn\s+(?P<name>\w+)\s*" + _GENERIC + r"\s*(?P<sign>\([^{;]*)(?=[{;])", "any"),
        ("struct", r"(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)\bstruct\s+(?P<name>\w+)" + _GENERIC + r"[^{;(]*(?=\{)", "any"),
        ("enum", r"(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)\benum\s+(?P<name>\w+)" + _GENERIC + r"[^{;]*(?=\{)", "any"),
        ("interface", r"(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)\btrait\s+(?P<name>\w+)" + _GENERIC + r"(?P<heirs>[^{;]*)(?=\{)", "any"),
        ("type_alias", r"(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)\btype\s+(?P<name>\w+)\s*" + _GENERIC + r"\s*=", "top"),
        ("impl", r"\bimpl\b\s*" + _GENERIC + r"\s*(?:(?P<trait>[\w:]+)" + _GENERIC + r"\s+for\s+)?(?P<name>\w+)" + _GENERIC + r"[^{;]*(?=\{)", "any"),
        ("bound", r"(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)\b(?P<word>const|static)\s+(?:mut\s+)?(?P<name>\w+)\s*:[^=;]*(?P<value>=[^;\n]*)?", "top"),
    ],
    "java": [
        ("class", _JAVA_MODS + r"\b(?:class|record)\s+(?P<name>\w+)\s*" + _GENERIC + r"(?P<heirs>[^{;]*)(?=\{)", "any"),
        ("interface", _JAVA_MODS + r"(?<!@)\binterface\s+(?P<name>\w+)\s*" + _GENERIC + r"(?P<heirs>[^{;]*)(?=\{)", "any"),
        ("enum", _JAVA_MODS + r"\benum\s+(?P<name>\w+)\s*(?P<heirs>[^{;]*)(?=\{)", "any"),
        ("method", _JAVA_MODS + _GENERIC + r"\s*(?P<returns>[\w.\[\]<>?, ]+?\s+)?(?<![\w.])(?P<name>\w+)\s*(?P<sign>\((?:[^(){};]|\([^(){};]*\))*\)\s*(?:throws[^{;]*)?)(?=[{;])", "type"),
        ("field", _JAVA_MODS + r"(?P<returns>[\w.\[\]]+(?:<[^;{}()]*>)?(?:\[\])?\s+)(?P<name>\w+)\s*(?P<sign>=[^;]*)?;", "type"),
    ],
}
_COMPILED = {f: [(k, re.compile(p), w) for k, p, w in ps] for f, ps in _DECLARED.items()}
_TYPE_KINDS = ("class", "interface", "struct", "enum", "impl")
_NOT_CALLED = frozenset("if for while switch catch return function func fn new super this match else do try typeof await yield throw import class struct enum interface trait impl in of as instanceof sizeof defer go select loop unsafe move where let const var synchronized assert".split())
_CALL = re.compile(r"(?P<new>\bnew\s+)?(?P<name>[A-Za-z_$][\w$]*(?:(?:\.|::)[A-Za-z_$][\w$]*)*)\s*(?:<[\w\s,.<>\[\]]*>)?(?P<bang>!)?\s*\(")
_HEIRS = re.compile(r"\b(extends|implements)\s+([^{]*?)(?=\bextends\b|\bimplements\b|$)", re.S)


@dataclass
class _Part:
    kind: str
    name: str
    start: int
    body: int
    end: int
    head: re.Match
    where: str
    id: str = ""
    qualified: tuple[str, ...] = ()


def _family(language: str) -> str | None:
    return "script" if language in SCRIPTS else language if language in _COMPILED else None


def _braces(text: str) -> dict[int, int]:
    """The end of each brace's block; unclosed ones end with the text."""
    out, open_ = {}, []
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.start()
    return out | {at: len(text) for at in open_}


def _names_of(text: str) -> list[str]:
    flat = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", text))
    return re.findall(r"(?:^|,)\s*([\w.:]+)", flat)


def _braced(found: Found, content: str, top: str) -> None:
    family = _family(found.language)
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    text = _BLANK[family].sub(blank, content)
    ends, lines = _braces(text), content.split("\n")
    starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def line(at: int) -> int:
        lo, hi = 0, len(starts)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if starts[mid] <= at else (lo, mid)
        return lo

    parts: list[_Part] = []
    taken: set[int] = set()
    for kind, pattern, where in _COMPILED[family]:
        for m in pattern.finditer(text):
            at = m.start("name")
            if at in taken or kind != "function" and m["name"] in _NOT_CALLED:
                continue
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            body = m.end() if text[m.end() : m.end() + 1] == "{" else -1
            if kind == "function" and body < 0:
                nxt = re.compile(r"\s*\{").match(text, m.end())
                body = nxt.end() - 1 if nxt else -1
            stop = re.compile(r"[;\n]").search(text, m.end("name"))
            end = ends[body] + 1 if body in ends else stop.start() if stop else len(text)
            parts.append(_Part(kind, m["name"], start, body, end, m, where))
            taken.add(at)
    parts.sort(key=lambda p: (p.start, -p.end))
    stack: list[_Part] = []
    kept: list[_Part] = []
    for p in parts:
        while stack and stack[-1].end <= p.start:
            stack.pop()
        over = stack[-1] if stack else None
        in_type = over is not None and over.kind in _TYPE_KINDS
        direct = over is None or text.count("{", over.body + 1, p.start) == text.count("}", over.body + 1, p.start)
        if p.where == "type" and not (in_type and direct) or p.where == "top" and (over is not None or text.count("{", 0, p.start) != text.count("}", 0, p.start)):
            continue
        if family == "rust" and p.kind == "function" and over is not None and not in_type:
            continue
        if family == "go" and p.kind == "bound" and p.name == "_":
            continue
        _declare(found, p, over, lines, line, family, top)
        kept.append(p)
        if p.body >= 0:
            stack.append(p)
    _members(found, kept, text, line)
    _imports(found, content, text, line, family, top)
    _calls(found, kept, text, line, top)


def _declare(found: Found, p: _Part, over: _Part | None, lines: list[str], line, family: str, top: str) -> None:
    head, groups = p.head, p.head.re.groupindex
    mods = (head["mods"] or "").split() if "mods" in groups else []
    names = over.qualified if over is not None else ()
    parent = over.id if over is not None else top
    first, last = line(p.start), line(max(p.start, p.end - 1))
    exported = {"script": "export" in mods or (bool(over) and False), "go": p.name[:1].isupper(), "rust": any(m.startswith("pub") for m in mods), "java": "public" in mods}[family]
    visibility = next((m for m in mods if m in ("public", "private", "protected")), "public" if family == "rust" and exported else "private" if family == "rust" else None)
    if p.kind == "impl":
        known = next((r for r in found.rows if r["tag"] == "node" and r["name"] == p.name and r["kind"] in ("struct", "enum", "interface")), None)
        p.id, p.qualified = (known["id"] if known else top), (p.name,)
        if known and head["trait"]:
            found.ref("implements", head["trait"].rpartition("::")[2], first, known["id"])
        return
    kind, sign = p.kind, " ".join((head["sign"] or "").split()) if "sign" in groups else None
    if kind == "bound":
        kind = "constant" if head["word"] in ("const", "static") else "variable"
        value = (head["value"] or "").strip().lstrip("=").strip()
        sign = "= " + value[:100] + ("..." if len(value) > 100 else "") if value else None
    if "receiver" in groups:
        names = (head["receiver"],)
    p.kind, p.qualified = kind, (*names, p.name)
    p.id = found.node(
        kind, p.name, "::".join(p.qualified), first, last, parent, signature=sign or None, docstring=_doc(lines, first), visibility=visibility, is_exported=exported,
        is_async="async" in mods or bool("async" in groups and head["async"]), is_static="static" in mods, is_abstract="abstract" in mods,
    )
    if "heirs" in groups and head["heirs"]:
        if family == "rust":
            for name in _names_of(head["heirs"].lstrip(" :").replace("+", ",")):
                found.ref("extends", name, first, p.id)
        for m in _HEIRS.finditer(head["heirs"]):
            for name in _names_of(m[2]):
                found.ref(m[1], name, first, p.id)


def _doc(lines: list[str], first: int) -> str | None:
    at, out = first - 2, []
    while at >= 0 and re.match(r"\s*(//|/\*|\*|#\[|@)", lines[at]):
        if not re.match(r"\s*(#\[|@)", lines[at]):
            out.append(re.sub(r"^\s*(///?!?|/\*+|\*+/|\*)\s?|\*+/\s*$", "", lines[at]).strip())
        at -= 1
    return "\n".join(x for x in reversed(out) if x) or None


def _members(found: Found, parts: list[_Part], text: str, line) -> None:
    """Members of enums, and, in Go, what a struct embeds."""
    for p in parts:
        if p.body < 0:
            continue
        body = text[p.body + 1 : p.end - 1]
        if p.kind == "enum":
            depth, at = 0, 0
            for m in re.finditer(r"[{}()\[\]]|[,;]|\b[A-Za-z_]\w*", body):
                if m[0] in "{([":
                    depth += 1
                elif m[0] in "})]":
                    depth -= 1
                elif m[0] == ";" and depth == 0:
                    break
                elif m[0] == ",":
                    at = 0 if depth == 0 else at
                elif depth == 0 and not at:
                    at = 1
                    here = line(p.body + 1 + m.start())
                    found.node("enum_member", m[0], "::".join([*p.qualified, m[0]]), here, here, p.id)
        elif p.kind == "struct" and found.language == "go":
            for m in re.finditer(r"(?m)^\s*\*?([A-Z]\w*|\w+\.[A-Z]\w*)\s*$", body):
                found.ref("extends", m[1], line(p.body + 1 + m.start(1)), p.id)


_IMPORTS = {
    "script": re.compile(r"""\bimport\s+(?:[^'";]*?\sfrom\s*)?['"]([^'"]+)['"]|\brequire\(\s*['"]([^'"]+)['"]\s*\)"""),
    "java": re.compile(r"(?m)^\s*import\s+(?:static\s+)?([\w.*]+)\s*;"),
    "rust": re.compile(r"(?m)^\s*(?:pub\s+)?use\s+([^;]+);"),
}


def _imports(found: Found, content: str, text: str, line, family: str, top: str) -> None:
    if family == "go":
        spots = []
        for m in re.finditer(r"(?m)^import\s*(\()?", text):
            stop = text.find(")", m.end()) if m[1] else text.find("\n", m.end())
            spots += [(m.end() + x.start(1), x[1]) for x in re.finditer(r'"([^"]+)"', content[m.end() : stop if stop >= 0 else len(content)])]
    else:
        spots = [(m.start(), next(g for g in m.groups() if g)) for m in _IMPORTS[family].finditer(content) if not text[m.start() :].startswith(" ") or content[m.start()].isspace()]
    for at, name in spots:
        here = line(at + len(content[at:]) - len(content[at:].lstrip()))
        name = " ".join(name.split())
        found.node("import", name, name, here, here, top, signature=content.split("\n")[here - 1].strip())
        if family != "java":
            found.ref("imports", name, here, top)


def _calls(found: Found, parts: list[_Part], text: str, line, top: str) -> None:
    heads = {p.head.start("name") for p in parts}
    owners = sorted((p for p in parts if p.id and p.kind not in ("import", "property", "field", "type_alias")), key=lambda p: p.start)
    stack: list[_Part] = []
    k = 0
    for m in _CALL.finditer(text):
        while k < len(owners) and owners[k].start <= m.start():
            stack.append(owners[k])
            k += 1
        while stack and stack[-1].end <= m.start():
            stack.pop()
        name = m["name"].replace("::", ".") if found.language != "rust" else m["name"]
        bare = re.sub(r"^(this|self|super|Self)(\.|::)", "", name)
        if m.start("name") in heads or bare in _NOT_CALLED or m["bang"] or re.search(r"(\bfunction\s*\*?|\bfunc|\bfn|\bclass)\s*$", text[max(0, m.start() - 12) : m.start()]):
            continue
        inner = next((p for p in reversed(stack) if p.end > m.start()), None)
        if inner is not None and inner.kind in ("interface", "enum", "struct") and m.start() > inner.body >= 0:
            continue  # a declaration without a body
        owner = inner.id if inner is not None else top
        found.ref("instantiates" if m["new"] else "calls", bare.rpartition(".")[2] if m["new"] else bare, line(m.start("name")), owner)


# Web frameworks

_ROUTE = re.compile(r"@(?P<on>\w+)\.(?P<verb>route|get|post|put|patch|delete|options|head)\(\s*['\"](?P<path>[^'\"]*)['\"](?P<rest>[^)]*)\)")
_DEF = re.compile(r"\b(?:async\s+)?def\s+(\w+)")
_URL = re.compile(r"\b(?:path|re_path|url)\(\s*r?['\"](?P<path>[^'\"]*)['\"]\s*,\s*(?P<handler>include\(\s*['\"](?P<module>[^'\"]+)['\"]|[\w.]+)")
_VIEWSET = re.compile(r"\.register\(\s*r?['\"](?P<path>[^'\"]*)['\"]\s*,\s*(?P<handler>[\w.]+)")


def _routes(found: Found, content: str, top: str) -> None:
    """Route nodes of Flask, FastAPI and Django files, with references to what handles them."""
    text = re.sub(r"#[^\n]*", " ", content)

    def route(name: str, at: int, handler: str | None, kind: str = "references") -> None:
        here = text.count("\n", 0, at) + 1
        me = found.node("route", name, f"{found.path}::{name}", here, here, top)
        found.ref(kind, handler, here, me)

    if re.search(r"\bimport\s+flask\b|\bfrom\s+(flask|fastapi)\b|\bimport\s+fastapi\b", text):
        for m in _ROUTE.finditer(text):
            listed = re.search(r"methods\s*=\s*[\[(]\s*['\"](\w+)", m["rest"])
            verb = m["verb"].upper() if m["verb"] != "route" else listed[1].upper() if listed else "GET"
            handler = _DEF.search(text, m.end())
            route(f"{verb} {m['path']}", m.start(), handler[1] if handler else None)
    if re.search(r"\bfrom\s+(django|rest_framework)\b", text):
        for m in _URL.finditer(text):
            if m["module"]:
                route(f"URL {m['path']}", m.start(), m["module"], "imports")
            else:
                route(f"URL {m['path']}", m.start(), re.sub(r"\.as_view$", "", m["handler"]).rpartition(".")[2])
        for m in _VIEWSET.finditer(text):
            if re.search(r"View(Set)?$", m["handler"]):
                route(f"VIEWSET /{m['path']}", m.start(), m["handler"].rpartition(".")[2])


def symbols(path: str, content: str | None, language: str) -> list[dict]:
    """The rows of one file: its own node first; if it can't be parsed, what was found until then and an error row."""
    content = content or ""
    found = Found(path, language)
    top = found.node("file", path.rsplit("/", 1)[-1], path, 1, content.count("\n") + 1, None)
    try:
        if language == "python":
            _python(found, content, top)
            _routes(found, content, top)
        elif _family(language):
            _braced(found, content, top)
    except (SyntaxError, ValueError, RecursionError) as e:
        found.rows.append({"tag": "error", "name": str(e), "file_path": path, "language": language})
    return found.rows


def extract(sources: DataFrame) -> DataFrame:
    """Rows (see FIELDS) of sources (path, content, language): tag node, edge, ref or error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content, language in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                out = symbols(path, content, language)
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], t) for n, t in FIELDS.items()], names=list(FIELDS))

    return sources.select("path", "content", "language").mapInArrow(run, ROWS)


def valid(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, refs) of extracted rows that can be stored: nodes with id, kind, name and path, edges between such, references from such."""
    filled = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("id", "kind", "name", "file_path")]
    nodes = rows.where("tag = 'node'").where(filled[0] & filled[1] & filled[2] & filled[3]).dropDuplicates(["id"])
    ids = nodes.select("id")
    edges = rows.where("tag = 'edge'").join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    refs = rows.where("tag = 'ref'").join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    columns = [c for c in FIELDS if c not in ("tag", "source", "target", "line")]
    refs = refs.select(F.col("source").alias("from_node_id"), F.col("name").alias("reference_name"), F.col("kind").alias("reference_kind"), "line", "file_path", "language")
    return nodes.select(*columns), edges.select("kind", "source", "target", "line"), refs
