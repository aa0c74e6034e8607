"""Text of HTML pages, by wrappers inferred from the pages of a host: union-free regular expressions over tokens.

A page is a stream of tags and texts (scripts, styles and comments are left out, attributes and inline marks don't count). Repeats that
stand next to one another fold into repeated groups; pages of a host that fold alike are one sample. The host's wrapper starts as one sample and is aligned
with each other in turn: common tokens stay, what only one side has becomes an optional group, a unit that one side has repeated becomes
a repeated group, and every text is a slot. Slots that several distinct pages fill, all with one text, are part of the template; copies of a page count once.
The wrapper is then compiled to a regular expression and matched against each page's tokens; what its slots hold are the page's fields, and the fields of
slots whose texts are long, by themselves or beside the host's longest, make up the page's text.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm.tables import shared_table, small_batches

#: A slot is main text if its texts have on average this share of the characters of the host's longest ones, or this many; the wrappers' size up to which they are broadcast.
SHARE, LONG, BROADCAST_BYTES = 0.05, 25, 8 << 20
#: Layouts of a host that one task aligns, and cells of an alignment's table: longer ones are halved first.
LAYOUTS, CELLS = 64, 1 << 20
TEXT = "#"
_SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"<(/?[a-zA-Z][a-zA-Z0-9]*)[^<>]*>|<[!?][^<>]*>")
INLINE = {"b", "i", "em", "strong", "span", "u", "small", "font", "br", "sup", "sub", "code", "abbr", "mark"}


def tokens(page: str) -> tuple[list[str], list[str]]:
    """(tokens, texts): the tags' names, with # for each text; and the texts, white space folded."""
    out: list[str] = []
    texts: list[str] = []
    parts = _TAG.split(_SKIP.sub("", page))
    run: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape(" ".join(run)).split())
        run.clear()
        if text:
            out.append(TEXT)
            texts.append(text)

    for i in range(0, len(parts), 2):
        if parts[i]:
            run.append(parts[i])
        if i + 1 < len(parts):
            tag = (parts[i + 1] or "").lower()
            if tag and tag.lstrip("/") not in INLINE:
                flush()
                out.append(tag)
    flush()
    return out, texts


# A node is a token, ["+", nodes] or ["?", nodes]; beside each list of nodes runs a flat list of its texts' statistics:
# [characters, texts, lowest and highest hash of a text, lowest and highest hash of a page that has one].
def _join(a: list, b: list) -> list:
    return [[x[0] + y[0], x[1] + y[1], min(x[2], y[2]), max(x[3], y[3]), min(x[4], y[4]), max(x[5], y[5])] for x, y in zip(a, b, strict=True)]


def _slots(node) -> int:
    return (node == TEXT) if isinstance(node, str) else sum(map(_slots, node[1]))


def _numbers(nodes: list, known: dict[str, int]) -> np.ndarray:
    """Equal nodes have equal numbers."""
    return np.array([known.setdefault(n if isinstance(n, str) else json.dumps(n), len(known)) for n in nodes], np.int64)


def _repeats(ids: np.ndarray, period: int) -> bool:
    """Whether any unit of so many nodes is followed by itself."""
    same = ids[:-period] == ids[period:]
    if period == 1:
        return bool(same.any())
    total = np.append(0, np.cumsum(same))
    return bool((total[period:] - total[:-period] == period).any())


def fold(nodes: list, stats: list[list]) -> tuple[list, list[list]]:
    """Nodes with repeated units folded, of any length, the shortest first; stats: a list of statistics for each node."""
    period, known = 1, {}
    ids = _numbers(nodes, known)
    while 2 * period <= len(nodes):
        if not _repeats(ids, period):
            period += 1
            continue
        i, changed = 0, False
        out, kept = [], []
        while i < len(nodes):
            unit = nodes[i : i + period]
            j = i + period
            while len(unit) == period and nodes[j : j + period] == unit:
                j += period
            if j > i + period and not (period == 1 and not isinstance(unit[0], str) and unit[0][0] == "?"):
                got = [s for x in stats[i : i + period] for s in x]
                for k in range(i + period, j, period):
                    got = _join(got, [s for x in stats[k : k + period] for s in x])
                inner = unit[0][1] if period == 1 and not isinstance(unit[0], str) else unit
                out.append(["+", inner])
                kept.append(got)
                i, changed = j, True
            else:
                out.append(nodes[i])
                kept.append(stats[i])
                i += 1
        nodes, stats = out, kept
        ids = _numbers(nodes, known)
        period = 1 if changed and period > 1 else period + 1
    return nodes, stats


def _row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of a with each beginning of b."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0)))
    return row


def common(a: np.ndarray, b: np.ndarray) -> str:
    """An alignment by a longest common subsequence: = for a number of both, - of a only, + of b only.

    Its table is worked out a row at a time; where it would have more than CELLS cells, a is halved at the best place in b, so long pages take memory in proportion to their length.
    """
    m, n = len(a), len(b)
    if not m or not n:
        return "-" * m + "+" * n
    if m > 1 and m * n > CELLS:
        half = m // 2
        at = int(np.argmax(_row(a[:half], b) + _row(a[half:][::-1], b[::-1])[::-1]))
        return common(a[:half], b[:at]) + common(a[half:], b[at:])
    best = np.zeros((m + 1, n + 1), np.int32)
    for i in range(m - 1, -1, -1):
        best[i, :-1] = np.maximum.accumulate(np.maximum(best[i + 1, :-1], np.where(b == a[i], best[i + 1, 1:] + 1, 0))[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < m or j < n:
        if i < m and j < n and a[i] == b[j] and best[i, j] == best[i + 1, j + 1] + 1:
            out.append("=")
            i, j = i + 1, j + 1
        elif j >= n or (i < m and best[i + 1, j] >= best[i, j + 1]):
            out.append("-")
            i += 1
        else:
            out.append("+")
            j += 1
    return "".join(out)


def absorb(nodes: list, stats: list[list], groups: list) -> tuple[list, list[list]]:
    """Nodes in which single runs of a repeated unit of ``groups`` become repeated too."""
    for g in groups:
        unit, n, i = g[1], len(g[1]), 0
        while i + n <= len(nodes):
            if nodes[i : i + n] == unit:
                nodes = [*nodes[:i], g, *nodes[i + n :]]
                stats = [*stats[:i], [s for x in stats[i : i + n] for s in x], *stats[i + n :]]
            i += 1
        i = 0
        while i + 1 < len(nodes):  # two groups of the unit side by side are one
            if nodes[i] == g == nodes[i + 1]:
                stats = [*stats[:i], _join(stats[i], stats[i + 1]), *stats[i + 2 :]]
                nodes = [*nodes[: i + 1], *nodes[i + 2 :]]
            else:
                i += 1
    return nodes, stats


def _groups(nodes: list) -> list:
    out = []
    for n in nodes:
        if not isinstance(n, str) and n[0] == "+" and n not in out:
            out.append(n)
    return out


class Wrapper:
    """Nodes with, for each, the number of its optional group (0: none) and its texts' statistics."""

    def __init__(self, nodes: list, stats: list[list]):
        self.nodes, self.stats, self.option, self.options = list(nodes), list(stats), [0] * len(nodes), 0

    def absorb(self, groups: list) -> None:
        for g in groups:
            n, i = len(g[1]), 0
            while i + n <= len(self.nodes):
                if self.nodes[i : i + n] == g[1] and len(set(self.option[i : i + n])) == 1:
                    self.nodes[i : i + n] = [g]
                    self.stats[i : i + n] = [[s for x in self.stats[i : i + n] for s in x]]
                    self.option[i : i + n] = [self.option[i]]
                i += 1

    def align(self, nodes: list, stats: list[list]) -> None:
        """Take in one more sample, by the longest common subsequence of nodes."""
        self.absorb(_groups(nodes))
        nodes, stats = absorb(nodes, stats, _groups(self.nodes))
        a, b = self.nodes, nodes
        known: dict[str, int] = {}
        ways = common(_numbers(a, known), _numbers(b, known))
        out, kept, option = [], [], []
        i = j = 0
        fresh: dict[tuple, int] = {}

        def put(node, stat, group) -> None:
            if group and group not in fresh:
                self.options += 1
                fresh[group] = self.options
            out.append(node)
            kept.append(stat)
            option.append(fresh.get(group, 0) if group else 0)

        runs = 0
        last = ""
        for way in ways:
            if way == "=":
                kind, o = "both", self.option[i]
                put(a[i], _join(self.stats[i], stats[j]), ("old", o, runs * bool(o) if last != "both" else runs) if o else None)
                i, j = i + 1, j + 1
            elif way == "-":
                kind = "mine"
                runs += last != kind
                put(a[i], self.stats[i], ("mine", runs, self.option[i]))
                i += 1
            else:
                kind = "its"
                runs += last != kind
                put(b[j], stats[j], ("its", runs))
                j += 1
            if kind == "both" and last != "both":
                runs += 1
            last = kind
        self.nodes, self.stats, self.option = out, kept, option

    def tree(self) -> tuple[list, list]:
        """Nodes with the optional groups made, and the statistics of all slots in order."""
        out: list = []
        last = 0
        for node, o in zip(self.nodes, self.option, strict=True):
            if not o:
                out.append(node)
            elif o == last:
                out[-1][1].append(node)
            else:
                out.append(["?", [node]])
            last = o
        return out, [s for x in self.stats for s in x]


def compile_wrapper(nodes: list, alphabet: dict[str, str]) -> str:
    """The pattern over one character for each token; each slot is a group of its own."""

    def walk(ns: list) -> str:
        return "".join("(" + alphabet[TEXT] + ")" if n == TEXT else alphabet[n] if isinstance(n, str) else "(?:" + walk(n[1]) + ")" + n[0] for n in ns)

    return walk(nodes)


def _names(nodes: list, into: dict[str, str]) -> dict[str, str]:
    for n in nodes:
        if isinstance(n, str):
            into.setdefault(n, chr(0xE000 + len(into)))
        else:
            _names(n[1], into)
    return into


def merge(samples: list[tuple[list, list[list], int]]) -> tuple[list, list]:
    """(nodes, statistics of all slots) of a wrapper that takes in all samples (nodes, statistics of each node, pages); a sample may be a wrapper's nodes itself."""
    order = sorted(samples, key=lambda s: (-s[2], json.dumps(s[0])))
    w = Wrapper(order[0][0], order[0][1])
    for nodes, stats, _ in order[1:]:
        w.align(nodes, stats)
    return w.tree()


def chosen(nodes: list, stats: list, share: float = SHARE) -> dict:
    """A wrapper: {nodes, template: slots with one text on distinct pages, main: slots of the text}."""
    template = [i for i, s in enumerate(stats) if s[2] == s[3] and s[4] != s[5]]
    length = {i: s[0] / s[1] for i, s in enumerate(stats) if i not in set(template)}
    least = min(LONG, share * max(length.values(), default=0))
    return {"nodes": nodes, "template": template, "main": [i for i, n in length.items() if n >= least]}


def infer(samples: list[tuple[list, list[list], int]], share: float = SHARE) -> dict:
    """A wrapper of samples."""
    return chosen(*merge(samples), share)


def _split(stats: list, nodes: list) -> list[list]:
    """Flat statistics to a list for each node."""
    out, at = [], 0
    for n in nodes:
        k = _slots(n)
        out.append(stats[at : at + k])
        at += k
    return out


def sample(page: str) -> tuple[list, list[list]]:
    toks, texts = tokens(page)
    stats, at = [], 0
    whole = int.from_bytes(hashlib.blake2b(json.dumps([toks, texts]).encode(), digest_size=7).digest())
    for t in toks:
        if t == TEXT:
            h = zlib.crc32(texts[at].encode())
            stats.append([[len(texts[at]), 1, h, h, whole, whole]])
            at += 1
        else:
            stats.append([])
    return fold(toks, stats)


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (host, nodes, stats, pages) for each kind of page of a host in this partition."""
    seen: dict[tuple[str, str], list] = {}

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array([json.dumps(v[0]) for v in seen.values()], pa.string()), pa.array([v[1] for v in seen.values()], pa.int64())], names=["host", "nodes", "stats", "pages"])
        seen.clear()
        return out

    for b in batches:
        for host, page in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            nodes, stats = sample(page)
            flat, key = [s for x in stats for s in x], (host, json.dumps(nodes))
            if key in seen:
                seen[key][0] = _join(seen[key][0], flat)
                seen[key][1] += 1
            else:
                seen[key] = [flat, 1]
        if len(seen) > 20_000:
            yield rows()
    yield rows()


def _merged(batches: Iterator[pa.RecordBatch], share: float | None) -> Iterator[pa.RecordBatch]:
    """Batches (host, part, nodes, stats, pages) sorted by host and part; one row for each part, or, with share, one (host, wrapper)."""
    now, kinds = None, {}

    def row() -> pa.RecordBatch:
        nodes, stats = merge([(json.loads(k), _split(v[0], json.loads(k)), v[1]) for k, v in kinds.items()])
        if share is not None:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.string()), pa.array([json.dumps(chosen(nodes, stats, share))], pa.string())], names=["of_host", "wrapper"])
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.string()), pa.array([json.dumps(nodes)], pa.string()), pa.array([json.dumps(stats)], pa.string()), pa.array([sum(v[1] for v in kinds.values())])], names=["host", "nodes", "stats", "pages"])

    for b in batches:
        for host, part, nodes, stats, pages in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if (host, part) != now and kinds:
                yield row()
                kinds = {}
            now = host, part
            stats = json.loads(stats)
            if nodes in kinds:
                kinds[nodes] = [_join(kinds[nodes][0], stats), kinds[nodes][1] + pages]
            else:
                kinds[nodes] = [stats, pages]
    if kinds:
        yield row()


class Matcher:
    def __init__(self, wrapper: str):
        import regex

        got = json.loads(wrapper)
        self.alphabet = _names(got["nodes"], {TEXT: chr(0xE000)})
        self.pattern = regex.compile(compile_wrapper(got["nodes"], self.alphabet))
        self.template, self.main = set(got["template"]), set(got["main"])

    def fields(self, toks: list[str], texts: list[str]) -> list[tuple[int, str]] | None:
        """(slot, text) in the order of the page; None where the wrapper doesn't match."""
        stream = "".join([self.alphabet.get(t, "") for t in toks])
        m = self.pattern.fullmatch(stream)
        if m is None:
            return None
        at = sorted((s, k) for k in range(self.pattern.groups) for s, e in m.spans(k + 1) if e > s)
        return [(k, texts[i]) for i, (_, k) in enumerate(at)]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Matcher] = {}
    for b in batches:
        out: list[tuple] = []
        for page, wrapper in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if page is None:
                out.append((False, None, None, None))
                continue
            if wrapper not in known:
                if len(known) > 200:
                    known.clear()
                known[wrapper] = Matcher(wrapper)
            m = known[wrapper]
            toks, texts = tokens(page)
            got = m.fields(toks, texts)
            if got is None:  # can't be, for a wrapper takes in all pages of its host; the texts are kept all the same
                out.append((False, [-1] * len(texts), texts, "\n".join(texts)))
            else:
                got = [(k, t) for k, t in got if k not in m.template]
                out.append((True, [k for k, _ in got], [t for _, t in got], "\n".join(t for k, t in got if k in m.main)))
        types = [pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string()]
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["page_id", "host", "matched", "slots", "fields", "text"])


def extracted(pages: DataFrame, share: float = SHARE, layouts: int = LAYOUTS) -> DataFrame:
    """(page_id, host, matched, slots, fields, text) for every row of pages.

    fields: the texts that the host's wrapper has slots for, with the slots' numbers; text: those of the main slots, a line each. A null html
    has matched false and nulls; an empty one has no fields; a null url is of the host ''; a page alone on its host, or with nothing but copies of
    itself, has no template; repeated rows are extracted each; long pages count whole; an empty table gives an empty result; columns other than page_id, url and html are not looked at. Wrappers are broadcast
    only if they are smaller than ``BROADCAST_BYTES`` in all, else joined by host.
    """
    spark = pages.sparkSession
    small_batches(spark, 500)
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), F.col("html").cast("string").alias("html"))
    found = "host string, nodes string, stats string, pages bigint"
    kinds = shared_table(rows.where("html IS NOT NULL").mapInArrow(_samples, found), "layouts")
    while True:  # layouts of a host are merged LAYOUTS at a time, so that no host is one task's; each round leaves a sixty-fourth
        count = kinds.groupBy("host").agg(F.countDistinct("nodes").alias("n"))
        most = count.agg(F.max("n")).first()[0] or 0
        parts = kinds.join(count, "host").select("host", F.pmod(F.xxhash64("nodes"), F.ceil(F.col("n") / layouts)).alias("part"), "nodes", "stats", "pages")
        grouped = parts.repartition("host", "part").sortWithinPartitions("host", "part")
        if most <= layouts:
            made = grouped.mapInArrow(lambda it: _merged(it, share), "of_host string, wrapper string")
            break
        kinds = shared_table(grouped.mapInArrow(lambda it: _merged(it, None), found), "layouts")
    wrappers = shared_table(made, "wrappers")
    size = wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    side = F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers
    both = rows.join(side, F.col("host") == F.col("of_host"), "left").select("page_id", "host", "html", "wrapper")
    return both.mapInArrow(_extract, "page_id bigint, host string, matched boolean, slots array<int>, fields array<string>, text string")
