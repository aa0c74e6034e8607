"""What a query's words ask for: terms, stems, symbols and the project's own name."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable

STOP = frozenset(
    """
    a affect affected all also an and are as at be been break breaks bug but by called can class code could did do does done each every failing file files fix for found
    from function give had happen happens has have he how i if implement implemented in into is it its just look made may me method might more my need needs no not of on
    only or our out over shall she should show so some such tell than that the then they this to type up used using want was we what when where which who why will with
    work works would you your
    """.split()
)
#: English that isn't meant as a symbol.
PLAIN = frozenset(
    """
    about add affect affected affects after again all also and any are been before being between both but call called calling can change changed changes changing check
    checked checks class classes code could create created creates data decide decides did does doing done during each else failed failing find flow flows for found from
    further get had handle handles handling has have having here how implement implementation implements incoming interface interfaces into its just layer level levels
    like look made make may method methods more most need needs not once only other outgoing read reads request requests response responses return returned returns run
    running runs same set should show silently some start starts stop stops such system take taken takes than that the them then there this through trigger triggers use
    used using very want wants was were what when where which who why will with without work works would write writes written
    """.split()
)


def _undoubled(base: str) -> set[str]:
    return {base, base + "e"} | ({base[:-1]} if len(base) > 1 and base[-1] == base[-2] else set())


def stems(term: str) -> set[str]:
    """Shorter forms of a term, each common suffix taken off; of at least three letters."""
    t = term.lower()
    n = len(t)
    out: set[str] = set()
    for suffix, least in (("ing", 5), ("er", 4)):
        if t.endswith(suffix) and n > least:
            out |= _undoubled(t[: -len(suffix)])
    if re.search("[ts]ion$", t) and n > 5:
        out.add(t[:-3])
    if t.endswith("ment") and n > 6:
        out.add(t[:-4])
    if n > 4:
        plural = re.search("(ies|es|(?<!s)s)$", t)
        if plural:
            out.add(t[: plural.start()] + ("y" if plural[1] == "ies" else ""))
        if re.search("(?<!e)ed$", t):
            out |= {t[:-1], t[:-2]} | ({t[:-3] + "y"} if t.endswith("ied") and n > 5 else set())
    return {v for v in out if len(v) > 2 and v != t}


def split_camel(text: str) -> str:
    return re.sub("([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub("([a-z])([A-Z])", r"\1 \2", text))


def search_terms(query: str, with_stems: bool = True) -> set[str]:
    """Lower-cased identifiers of a query, their parts, and (if asked for) stems; stop words and what has under three letters are left out."""
    whole = r"\b(?:[a-zA-Z][a-zA-Z0-9]*(?:[A-Z][a-z]+)+|[A-Z][a-z]+(?:[A-Z][a-z]*)+)\b", r"\b[a-zA-Z][a-zA-Z0-9]*(?:_[a-zA-Z0-9]+)+\b"
    out = {m.lower() for pattern in whole for m in re.findall(pattern, query) if len(m) > 2}
    parts = re.findall("[a-z0-9]+", re.sub("[_.]+", " ", split_camel(query)).lower())
    out |= {p for p in parts if len(p) > 2 and p not in STOP}
    return out | {v for t in out for v in stems(t) if v not in STOP} if with_stems else out


_SYMBOLS = (
    (r"\b(?:[A-Z][a-z]+(?:[A-Z][a-z]*)*|[a-z]+(?:[A-Z][a-z]*)+)\b", 2, 0),
    (r"\b_*[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b", 3, re.I),
    (r"\b_[a-z][a-z0-9]+\b", 3, re.I),
    (r"\b__[a-z][a-z0-9]*__\b", 1, re.I),
    (r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b", 1, 0),
    (r"\b[A-Z]{2,}\b", 2, 0),
    (r"\b[a-z][a-z0-9]{2,}\b", 3, 0),
)


def query_symbols(query: str) -> list[str]:
    """What may be a symbol's name in a query, plain English left out: the longest first, then by the alphabet."""
    found = {m for pattern, least, flags in _SYMBOLS for m in re.findall(pattern, query, flags) if len(m) >= least}
    for dotted in re.findall(r"\b[a-zA-Z_]\w*(?:\.[a-zA-Z_]\w*)+\b", query, re.A):
        found |= {dotted, *(p for p in dotted.split(".") if len(p) > 1)}
    return sorted((x for x in found if x.lower() not in PLAIN), key=lambda x: (-len(x), x))


def plain_name(raw: str) -> str:
    return re.sub("[^a-z0-9]", "", raw.lower())


def project_tokens(root_name: str, read: Callable[[str], str | None]) -> set[str]:
    """Plain names, of five letters or more, that a project goes by: its folder's, and those of its manifests. read: a manifest's text or None."""
    names: list = [root_name]
    try:
        names.append(tomllib.loads(read("pyproject.toml") or "").get("project", {}).get("name"))
    except (tomllib.TOMLDecodeError, AttributeError):
        pass
    try:
        scoped = json.loads(read("package.json") or "{}").get("name")
        names.append(scoped.removeprefix("@").split("/", 1)[-1] if isinstance(scoped, str) else None)
    except (ValueError, AttributeError):
        pass
    module = re.search(r"^\s*module\s+(\S+)\s*$", read("go.mod") or "", re.M)
    names.append(module[1].rsplit("/", 1)[-1] if module else None)
    return {p for p in (plain_name(n) for n in names if isinstance(n, str)) if len(p) > 4}


def is_test_query(query: str) -> bool:
    return "test" in query.lower() or "spec" in query.lower()
