"""A report in Markdown on what a question is about: source by file, call path, callers, relations, within a budget of characters.

What is searched, walked and ranked are DataFrame plans over the whole graph; the report itself is about some two hundred symbols and eight files, and is
put together on the driver.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from symgraph.operators import context as C
from symgraph.operators import ranking
from symgraph.plans.lineage import cut

BODIES = ("function", "method", "property")
WHOLE_LINES, WHOLE_FACTOR, SECTION_FACTOR, OVERSIZED, CEILING, SIGNATURES, DENSE, PADDING = 220, 3, 1.5, 2, 25_000, 24, 20, 3
Read = Callable[[str], str | None]


def _body(lines: list[str], n: Row) -> str:
    return "\n".join(lines[n.start_line - 1 : n.end_line])


def _placed(n: Row) -> bool:
    return n.start_line > 0 and n.end_line >= n.start_line


def needs_skeleton(symbols: list[Row], spine: set[str], unique: set[str], entries: set[str], lines: list[str], budget: int) -> bool:
    """Whether a file is shown by signatures with a few bodies: where the bodies of what matters exceed the budget, or, if nothing in particular matters, twenty callables and more."""
    matters = spine | unique | entries
    bodies = [n for n in symbols if n.kind in BODIES]
    chars = sum(len(_body(lines, n)) for n in bodies if n.id in matters and _placed(n))
    if matters and chars <= budget:
        return False
    if any(n.id in spine for n in symbols):
        return any(n.id in matters and n.id not in spine for n in bodies)
    return sum(n.id in matters for n in bodies) >= 2 or len(bodies) >= DENSE


def skeleton(symbols: list[Row], lines: list[str], spine: set[str], unique: set[str], entries: set[str], budget: int) -> tuple[str, str]:
    """(source, 'focused' or 'skeleton'): bodies of what is on the spine, of unique names and of entries, in this order, as far as one and a half budgets go; of other callables their signatures, at most 24."""
    rank = {n.id: next((k for k, ids in enumerate((spine, unique, entries)) if n.id in ids), None) for n in symbols if n.kind in BODIES}
    shown, spent = set(), 0
    for n in sorted((n for n in symbols if rank.get(n.id) is not None and _placed(n)), key=lambda n: rank[n.id]):
        size = len(_body(lines, n))
        if not shown or spent + size <= int(budget * SECTION_FACTOR):
            shown.add(n.id)
            spent += size
    out, covered, signatures = [], 0, 0
    order = sorted((n for n in symbols if n.kind in BODIES), key=lambda n: n.start_line)
    for n in order:
        if n.start_line <= covered:
            continue
        if n.id in shown:
            out += [f"{k}\t{lines[k - 1]}" for k in range(n.start_line, min(n.end_line, len(lines)) + 1)]
            covered = n.end_line
        elif signatures == SIGNATURES:
            left = sum(m.start_line > n.start_line and m.id not in shown for m in order)
            out += [f"    ... +{left} more signatures"] if left else []
            break
        elif n.start_line <= len(lines):
            near = range(n.start_line, min(n.start_line + 4, len(lines) + 1))
            at = next((k for k in near if re.search(rf"\b{re.escape(n.name)}\b", lines[k - 1])), n.start_line)
            out.append(f"{at}\t{lines[at - 1].strip()}")
            signatures += 1
    return "\n".join(out), "focused" if shown else "skeleton"


def numbered(lines: list[str], clusters: list[Row] | None = None) -> str:
    """Lines with their numbers: all but blank ones at the end, or those of clusters, three more on each side, with a mark between."""
    if clusters is None:
        last = max((k for k, x in enumerate(lines) if x.strip()), default=-1)
        return "\n".join(f"{k + 1}\t{x}" for k, x in enumerate(lines[: last + 1]))
    parts = []
    for c in sorted(clusters, key=lambda c: c.start_line):
        lo, hi = max(0, c.start_line - 1 - PADDING), min(len(lines), c.end_line + PADDING)
        parts.append("\n".join(f"{k + 1}\t{lines[k]}" for k in range(lo, hi)))
    return "\n... (gap) ...\n".join(parts)


def section(path: str, symbols: list[Row], source: str, language: str, most: int, tag: str = "") -> str:
    names = list(dict.fromkeys(f"{n.name}({n.kind})" for n in symbols if n.kind not in ("import", "export")))
    more = f", +{len(names) - most} more" if len(names) > most else ""
    return f"#### {path} — {', '.join(names[:most])}{more}{' · ' + tag if tag else ''}\n\n```{language}\n{source}\n```\n"


def capped(text: str, budget: int) -> tuple[str, bool]:
    """A section that must be there, cut to one and a half budgets."""
    most = int(budget * SECTION_FACTOR)
    if len(text) <= most:
        return text, False
    note = "\n\n... (cut to the budget; ask again by the names of symbols for the rest)"
    return text[: max(0, most - len(note))] + note, True


def relations(edges: list[Row], names: dict[str, str], most: int = 10) -> str:
    by: dict[str, list[str]] = {}
    for e in edges:
        if e.kind != "contains" and e.source in names and e.target in names:
            by.setdefault(e.kind, []).append(f"- {names[e.source]} → {names[e.target]}")
    lines = [x for kind, pairs in by.items() for x in (f"**{kind}:**", *pairs[:most], *([f"- ... and {len(pairs) - most} more"] if len(pairs) > most else []), "")]
    return "\n".join(["### Relationships", "", *lines]) if by else ""


def callers(rows: list[Row], most: int = 4) -> str:
    """rows: (name, file_path, start_line, callers, files, test_files), the last two lists."""
    lines = []
    for r in rows:
        where = ", ".join(f"`{f}`" for f in r.files[:most]) + (f" +{len(r.files) - most} more" if len(r.files) > most else "")
        tests = ", ".join(f"`{f}`" for f in r.test_files[:most]) + (f" +{len(r.test_files) - most}" if len(r.test_files) > most else "")
        lines.append(f"- `{r.name}` ({r.file_path}:{r.start_line}) — {r.callers} caller{'s' * (r.callers != 1)}{' in ' + where if where else ''}; {'tests: ' + tests if tests else 'no tests found'}")
    return "\n".join(["### Blast radius", "", *lines, ""]) if lines else ""


def flow(steps: list[Row]) -> str:
    lines = [x for k, n in enumerate(steps) for x in (["   ↓ calls"] if k else []) + [f"{k + 1}. {n.name} ({n.file_path}:{n.start_line})"]]
    return "\n".join(["## Flow", "", *lines, ""]) if steps else ""


def not_shown(left: dict[str, list[Row]], most: int = 10) -> str:
    lines = [f"- {path}: {', '.join(f'{n.name}:{n.start_line}' for n in symbols[:5])}" for path, symbols in list(left.items())[:most]]
    return "\n".join(["### Not shown", "", *lines, *([f"- ... and {len(left) - most} more files"] if len(left) > most else [])]) if left else ""


def fitted(text: str, most: int, left: dict[str, list[Row]], of_file: Callable[[str], list[Row]]) -> str:
    """A text of at most about ``most`` characters: only its source is cut, between two files if that keeps a third of it, and the files cut off are named."""
    if len(text) <= most:
        return text
    note, mark = "\n\n... (cut to the budget; ask again by name for the rest)", "\n### Source Code\n"
    at = text.find(mark)
    head, source = (text[: at + len(mark)], text[at + len(mark) :]) if at > 0 else ("", text)
    room = most - len(head) - len(note) - (60 + 120 * len(left) if left else 0)
    if room <= 200:
        return text[: max(0, most - len(note))] + note[:most]
    between = source[:room].rfind("\n#### ")
    end = between if between > 0.3 * room else max(source[:room].rfind("\n"), 1)
    for path in re.findall(r"^#### (\S+)", source[end:], re.M):
        left.setdefault(path, of_file(path))
    return head + source[:end] + ("\n" + not_shown(left) if left else "") + note


def explore(nodes: DataFrame, edges: DataFrame, query: str, read: Read, most_chars: int | None = None, most_files: int | None = None, project: frozenset[str] | set[str] = frozenset()) -> str:
    """The report on a query; read gives a file's text or None."""
    spark = nodes.sparkSession
    n_files = nodes.where("kind = 'file'").count()
    budget = ranking.output_budget(n_files)
    budget["chars"], budget["files"] = most_chars or budget["chars"], most_files or budget["files"]
    seeds = cut(C.named_seeds(nodes, query, project=project))
    kept, among = C.relevant_context(nodes, edges, query, 8, 3, 200, 0.2, project=project)
    kept = kept.unionByName(nodes.join(seeds.select("id"), "id", "left_semi").join(kept.select("id"), "id", "left_anti").withColumn("root", F.lit(False)))
    kept = cut(kept)
    symbols = kept.collect()  # some two hundred
    if not symbols:
        return f'Nothing found for "{query}"'
    by_id = {n.id: n for n in symbols}
    named = {r.id: r.score for r in seeds.collect()}
    roots = {n.id for n in symbols if n.root}
    entries = roots | named.keys()
    unique = {r.id for r in ranking.unique_names(kept, seeds).collect()}
    start = spark.createDataFrame([(i, float(named.get(i, 10.0))) for i in sorted(entries)], "id string, score double")
    walk = cut(ranking.random_walk(kept, among, start))
    score = {r.id: r.score for r in walk.collect()}
    worth = spark.createDataFrame([(i, named.get(i, 0.0) + 100 * s) for i, s in score.items()], "id string, score double")
    of_entries = kept.join(start.select("id"), "id", "left_semi").select("file_path")
    files = ranking.relevant_files(ranking.file_scores(kept, walk), 0.06, ranking.heuristic_scores(kept, among, seeds, start), of_entries)
    paths = [r.file_path for r in ranking.select_files(files, kept.join(seeds.select("id"), "id", "left_semi").select("file_path"), budget["files"], query).orderBy("place").collect()]
    chain = [by_id.get(r.id) or nodes.where(F.col("id") == r.id).first() for r in ranking.flow_chain(edges, seeds).orderBy("step").collect()] if len(named) > 1 else []
    spine = {n.id for n in chain}
    top = kept.where("root").orderBy("id").limit(5)
    links = among.collect()

    out = [f"## Exploration: {query}", "", f"{len(symbols)} symbols in {len({n.file_path for n in symbols})} files.", ""]
    out += [x for x in (callers(ranking.callers_of(nodes, edges, top).orderBy("id").collect()), relations(links, {n.id: n.name for n in symbols}), flow(chain)) if x]
    out += ["### Source Code", ""]
    total, shown, trimmed, left = len("\n".join(out)), 0, False, {}

    def add(text: str, needed: bool) -> bool:
        nonlocal total, shown, trimmed
        if not needed and total + len(text) > 0.9 * budget["chars"]:
            trimmed = True
            return False
        if needed:
            text, cut_off = capped(text, budget["chars_per_file"])
            trimmed |= cut_off
        out.append(text)
        total, shown = total + len(text), shown + 1
        return True

    def of_file(path: str) -> list[Row]:
        return [n for n in symbols if n.file_path == path]

    def of_skeleton(path: str, lines: list[str]) -> str | None:
        source, tag = skeleton(of_file(path), lines, spine, unique, entries, budget["chars_per_file"])
        return section(path, of_file(path), source, of_file(path)[0].language, budget["symbols"], tag) if source else None

    for path in paths:
        mine, content = of_file(path), read(path)
        needed = any(n.id in entries for n in mine)
        if content is None or not mine:
            left[path] = mine
            continue
        lines = content.split("\n")
        if len(lines) <= WHOLE_LINES and len(content) <= WHOLE_FACTOR * budget["chars_per_file"]:
            text = section(path, mine, numbered(lines), mine[0].language, budget["symbols"])
        elif needs_skeleton(mine, spine, unique, entries, lines, budget["chars_per_file"]):
            text = of_skeleton(path, lines)
        else:
            in_file = kept.where((F.col("file_path") == path) & (F.col("kind") != "file")).drop("root")
            whole = spark.createDataFrame([(f"file:{path}", "file", path, 1, len(lines))], "id string, kind string, file_path string, start_line int, end_line int")
            found = cut(ranking.clusters(in_file.unionByName(whole, allowMissingColumns=True), budget["gap"], worth, among))
            picked = ranking.within_budget(found, min(budget["chars_per_file"], max(0, budget["chars"] - total - 200))).collect()
            trimmed |= len(picked) < found.count()
            wide = len(picked) == 1 and 60 * (picked[0].end_line - picked[0].start_line + 1) > OVERSIZED * budget["chars_per_file"]
            text = of_skeleton(path, lines) if wide else None
            if text is None and picked:
                inside = [n for n in mine if any(c.start_line <= n.start_line <= c.end_line for c in picked)]
                first = [n for n in mine if n.id in entries and n not in inside]
                text = section(path, first + inside, numbered(lines, picked), mine[0].language, budget["symbols"])
        if text is None or not add(text, needed):
            left[path] = mine
    out += [x for x in (not_shown(left),) if x]
    out += ["", f"> {shown} files are shown above; what is listed under 'Not shown' can be asked for by name." if shown else "> Some sections were cut; ask by name for the rest." if trimmed else ""]
    if n_files >= 500:
        out += ["", f"> {ranking.call_budget(n_files)} reports are a fair number for a project of {n_files:,} files."]
    return fitted("\n".join(out), min(int(1.5 * budget["chars"]), CEILING), left, of_file)


def context_json(kept: list[Row], among: list[Row]) -> str:
    """A context as JSON: nodes, edges and roots."""
    plain: dict[str, Any] = {"nodes": [{k: v for k, v in n.asDict().items() if k != "root"} for n in kept], "edges": [e.asDict() for e in among], "roots": [n.id for n in kept if n.root]}
    return json.dumps(plain, sort_keys=True)


def context_markdown(query: str, kept: list[Row], among: list[Row]) -> str:
    lines = [f"## Context: {query}", "", "### Entry points", *[f"- {n.name} ({n.kind}) {n.file_path}:{n.start_line}" for n in kept if n.root], "", "### Near them", *[f"- {n.name} ({n.kind}) {n.file_path}:{n.start_line}" for n in kept if not n.root], ""]
    return "\n".join([*lines, relations(among, {n.id: n.name for n in kept})])


def context_tree(kept: list[Row], among: list[Row]) -> str:
    """Roots, and under each what it holds, calls or extends, once in the whole tree."""
    names = {n.id: f"{n.name} ({n.kind})" for n in kept}
    below: dict[str, list[tuple[str, str]]] = {}
    for e in sorted(among, key=lambda e: (e.kind, e.target)):
        below.setdefault(e.source, []).append((e.kind, e.target))
    out, seen = [], set()

    def walk(node: str, mark: str, deep: int) -> None:
        seen.add(node)
        out.append("  " * deep + mark + names[node])
        for kind, x in below.get(node, ()):
            if x in names and x not in seen:
                walk(x, f"{kind}: ", deep + 1)

    for n in kept:
        if n.root and n.id not in seen:
            walk(n.id, "", 0)
    return "\n".join(out)


def size_text(n: int) -> str:
    return f"{n} B" if n < 1024 else f"{n / 1024:.1f} KB" if n < 1 << 20 else f"{n / (1 << 20):.1f} MB"
