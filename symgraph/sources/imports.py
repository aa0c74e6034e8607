"""What source files import, and where the imported files may be."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from symgraph.functions.builtins import IMPORT_MODULES, NODE_MODULES

_SCRIPTS = ("typescript", "javascript", "tsx", "jsx")
#: Suffixes to try, in order.
SUFFIXES = {
    "typescript": ".ts .tsx .d.ts .js .jsx /index.ts /index.tsx /index.js",
    "tsx": ".tsx .ts .d.ts .js .jsx /index.tsx /index.ts /index.js",
    "javascript": ".js .jsx .mjs .cjs /index.js /index.jsx",
    "jsx": ".jsx .js /index.jsx /index.js",
    "python": ".py /__init__.py",
    "rust": ".rs /mod.rs",
    "go": ".go",
    "java": ".java",
    "csharp": ".cs",
}
ALIASES = {"@/": "src/", "~/": "src/", "@src/": "src/", "src/": "src/"}
Mapping = tuple[str, str, str, bool, bool]  # local name, exported name, source, default, namespace


def is_external(source: str, language: str) -> bool:
    """Whether a module's name can't be one of the project's files."""
    if source.startswith("."):
        return False
    if language in _SCRIPTS:
        return source in NODE_MODULES or not source.startswith(("@/", "~/", "src/"))
    if language == "python":
        return source.split(".")[0] in IMPORT_MODULES
    return language == "go" and "/internal/" not in source


def module_files(module: str) -> list[tuple[str, bool]]:
    """Paths of a dotted Python module, the first that exists counts; True: any path that ends so."""
    if not module or module.startswith("."):
        return []
    base = module.replace(".", "/")
    ends = [base + x for x in SUFFIXES["python"].split()]
    return [(p, False) for p in ends] + [(p, True) for p in ends]


def import_files(source: str, of: str, language: str) -> list[tuple[str, bool]]:
    """Paths of what the file ``of`` imports as ``source``, in the order in which they are tried."""
    if is_external(source, language):
        return []
    suffixes = [*SUFFIXES.get(language, "").split(), ""]
    if source.startswith("."):
        base = posixpath.normpath(posixpath.join(posixpath.dirname(of), source))
        return [(base + x, False) for x in suffixes]
    bases = [new + source[len(alias) :] for alias, new in ALIASES.items() if source.startswith(alias)]
    out = [(b + x, False) for b in bases for x in suffixes]
    if language == "python" and "." in source:
        out += module_files(source)
    return out + [(source + x, False) for x in suffixes]


def _renamed(part: str, between: str) -> tuple[str, str] | None:
    m = re.match(rf"(\w+)\s*{between}\s*(\w+)", part)
    return (m[2], m[1]) if m else None


def _python(content: str) -> list[Mapping]:
    out: list[Mapping] = []
    for m in re.finditer(r"from\s+(?P<source>[\w.]+)\s+import\s+(?P<names>[^#\n]+)", content):
        for part in map(str.strip, m["names"].split(",")):
            both = _renamed(part, r"\sas\s")
            bare = part.strip("() ")
            if both:
                out.append((*both, m["source"], False, False))
            elif re.fullmatch(r"\w+", bare):
                out.append((bare, bare, m["source"], False, False))
    for m in re.finditer(r"^import\s+(?P<source>[\w.]+)(?:\s+as\s+(?P<alias>\w+))?", content, re.M):
        out.append((m["alias"] or m["source"].rpartition(".")[2], "*", m["source"], False, True))
    return out


_ES = re.compile(r"""import\s+(?:(?P<default>\w+)\s*,?\s*)?(?:\{(?P<named>[^}]+)\})?\s*(?:\*\s+as\s+(?P<space>\w+))?\s*from\s*(?P<q>['"])(?P<source>[^'"]+)['"]""")
_REQUIRE = re.compile(r"""(?:const|let|var)\s+(?:(?P<default>\w+)|\{(?P<named>[^}]+)\})\s*=\s*require\((?P<q>['"])(?P<source>[^'"]+)['"]\)""")


def _script(content: str) -> list[Mapping]:
    out: list[Mapping] = []
    for pattern, between in ((_ES, r"\sas\s"), (_REQUIRE, ":")):
        for m in pattern.finditer(content):
            if m["default"]:
                out.append((m["default"], "default", m["source"], True, False))
            for part in filter(None, map(str.strip, (m["named"] or "").split(","))):
                out.append((*(_renamed(part, between) or (part, part)), m["source"], False, False))
            if pattern is _ES and m["space"]:
                out.append((m["space"], "*", m["source"], False, True))
    return out


def _go(content: str) -> list[Mapping]:
    one = r"""(?:(?P<alias>\w+)\s+)?["'](?P<source>[^"']+)["']"""
    block = re.search(r"import\s*\(\s*(.*?)\s*\)", content, re.S)
    found = [*re.finditer(r"import\s+" + one, content), *(re.finditer(one, block[1]) if block else ())]
    return [(m["alias"] or m["source"].rpartition("/")[2], "*", m["source"], False, True) for m in found]


def mappings(content: str, language: str) -> list[Mapping]:
    """The imports of a file's text, in the order that later finds go by."""
    if language in _SCRIPTS:
        return _script(content)
    return {"python": _python, "go": _go}.get(language, lambda _: [])(content)


_PATHS = "array<struct<path: string, ending: boolean>>"
IMPORTS = f"file_path string, language string, ordinal int, local_name string, exported_name string, source string, is_default boolean, is_namespace boolean, files {_PATHS}, modules {_PATHS}"


def extract_imports(sources: DataFrame) -> DataFrame:
    """Rows (see IMPORTS) of sources (path, content, language). files: where the imported file may be; modules: where it may be if the name is itself a Python module."""
    paths = pa.list_(pa.struct([("path", pa.string()), ("ending", pa.bool_())]))
    names = ["file_path", "language", "ordinal", "local_name", "exported_name", "source", "is_default", "is_namespace", "files", "modules"]
    types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), paths, paths]

    def listed(found: list[tuple[str, bool]]) -> list[dict]:
        return [{"path": p, "ending": e} for p, e in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content, language in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for k, (local, exported, source, default, space) in enumerate(mappings(content or "", language)):
                    module = source if space else f"{source}.{local}"
                    modules = listed(import_files(module, path, language) + module_files(module)) if language == "python" else []
                    rows.append((path, language, k, local, exported, source, default, space, listed(import_files(source, path, language)), modules))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=names)

    return sources.select("path", "content", "language").mapInArrow(run, IMPORTS)
