"""Traversals, level by level: each level is one join of the frontier with the edges, and what was seen is left out by an anti join."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgraph.functions.names import dirname
from symgraph.plans.lineage import cut, small


def steps(edges: DataFrame, direction: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """(a, b): from a one gets to b."""
    return _ways(edges, direction, kinds).distinct()


def _ways(edges: DataFrame, direction: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    e = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    out, back = e.select(F.col("source").alias("a"), F.col("target").alias("b")), e.select(F.col("target").alias("a"), F.col("source").alias("b"))
    return {"outgoing": out, "incoming": back}.get(direction, out.unionByName(back)).where("a <> b")


def levels(edges: DataFrame, start: DataFrame, direction: str, kinds: tuple[str, ...] = (), depth: int | None = None, through: DataFrame | None = None) -> DataFrame:
    """(id, depth): everything within depth steps of start (id) at its least depth, start itself at 0; no depth: all.

    A level is a join of the frontier with the edges, made distinct after it and not before; a frontier of few nodes, by count, is broadcast,
    so that a level reads the edges and shuffles only what it finds. Each level is checkpointed, and the loop ends when one is empty. through: (id) of the only nodes that may be entered.
    """
    hop = _ways(edges, direction, kinds)
    seen = cut(start.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier, d = seen.select("id"), 0
    while depth is None or d < depth:
        d += 1
        ahead = hop.join(small(frontier).withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        ahead = ahead if through is None else ahead.join(through, "id", "left_semi")
        frontier = cut(ahead.join(seen.select("id"), "id", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(d)))
        if d % 8 == 0:
            seen = cut(seen)
    return seen


PRIORITY = {"contains": 0, "calls": 1}


def traverse(nodes: DataFrame, edges: DataFrame, node: str, direction: str = "outgoing", kinds: tuple[str, ...] = (), node_kinds: tuple[str, ...] = (), depth: int | None = None, limit: int | None = None, include_start: bool = True) -> DataFrame:
    """(id, depth, parent, kind): a breadth-first tree; the parent is the first of the level before, by kind of edge (contains, calls, others), then by id.

    Only nodes of node_kinds are entered; of all that is reached the first ``limit`` by depth, kind of edge and id stay. Without the start if it isn't wanted.
    """
    allowed = nodes.where(F.col("kind").isin(*node_kinds)).select("id") if node_kinds else nodes.select("id")
    reached = levels(edges, one(edges, node).join(nodes.select("id"), "id", "left_semi"), direction, kinds, depth, allowed)
    e = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    out, back = (e.select(F.col(x).alias("parent"), F.col(y).alias("id"), "kind") for x, y in (("source", "target"), ("target", "source")))
    ways = {"outgoing": out, "incoming": back}.get(direction, out.unionByName(back))
    rank = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in PRIORITY.items()], F.lit(2))
    before = reached.select(F.col("id").alias("parent"), (F.col("depth") + 1).alias("depth"))
    tree = ways.join(reached.where("depth > 0"), "id").join(before, ["parent", "depth"]).groupBy("id", "depth").agg(F.min(F.struct(rank.alias("rank"), "parent", "kind")).alias("by"))
    found = tree.select("id", "depth", "by.parent", "by.kind", "by.rank")
    if include_start:
        found = found.unionByName(reached.where("depth = 0").select("id", "depth", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("kind"), F.lit(-1).alias("rank")))
    found = found.orderBy("depth", "rank", "id").limit(limit) if limit is not None else found
    return found.select("id", "depth", "parent", "kind")


def depth_first(nodes: DataFrame, edges: DataFrame, node: str, direction: str = "outgoing", kinds: tuple[str, ...] = (), depth: int = 3, limit: int = 1000) -> DataFrame:
    """(step, id, depth): nodes in the order of a depth-first walk, each node's next by kind of edge and id.

    The walk itself has an order that no parallel plan gives; it is done on the driver, over the ``limit`` nodes nearest to the start at most, and the edges among them.
    """
    spark = edges.sparkSession
    near = traverse(nodes, edges, node, direction, kinds, (), depth, limit)
    ids = cut(near.select("id"))
    e = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    inside = e.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    ahead: dict[str, list[tuple]] = {}
    for r in inside.select("source", "target", "kind").distinct().collect():  # edges among at most ``limit`` nodes
        for x, y, way in ((r["source"], r["target"], "outgoing"), (r["target"], r["source"], "incoming")):
            if direction in (way, "both"):
                ahead.setdefault(x, []).append((PRIORITY.get(r["kind"], 2), y))
    out, seen, waiting = [], set(), [(node, 0)] if not ids.isEmpty() else []
    while waiting:
        here, d = waiting.pop()
        if here in seen:
            continue
        seen.add(here)
        out.append((len(out), here, d))
        if d < depth:
            waiting += [(y, d + 1) for _, y in sorted(ahead.get(here, ()), reverse=True) if y not in seen]
    return spark.createDataFrame(out, "step int, id string, depth int")


def one(nodes_or_edges: DataFrame, node: str) -> DataFrame:
    return nodes_or_edges.sparkSession.createDataFrame([(node,)], "id string")


def deep(edges: DataFrame, node: str, direction: str, kinds: tuple[str, ...], depth: int | None) -> DataFrame:
    """Callers, callees, testers or tested targets: levels without the node itself."""
    return levels(edges, one(edges, node), direction, kinds, depth).where("depth > 0")


def call_graph(edges: DataFrame, node: str, depth: int = 2) -> DataFrame:
    """(id, caller_depth, callee_depth)."""
    kinds = ("calls", "references", "imports")
    up = levels(edges, one(edges, node), "incoming", kinds, depth).withColumnRenamed("depth", "caller_depth")
    down = levels(edges, one(edges, node), "outgoing", kinds, depth).withColumnRenamed("depth", "callee_depth")
    return up.join(down, "id", "full")


def hierarchy(edges: DataFrame, node: str, compat: bool = False) -> DataFrame:
    """(id, side, depth): ancestors and descendants by extends and implements; compat: ancestors alone."""
    kinds = ("extends", "implements")
    up = deep(edges, node, "outgoing", kinds, None).withColumn("side", F.lit("ancestor"))
    return up if compat else up.unionByName(deep(edges, node, "incoming", kinds, None).withColumn("side", F.lit("descendant")))


def usages(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """(kind, id, name, file_path, line) of all that points at node."""
    e = edges.where(F.col("target") == node).select("kind", F.col("source").alias("id"), "line")
    return e.join(nodes.select("id", "name", "file_path"), "id").select("kind", "id", "name", "file_path", "line")


CONTAINERS = ("class", "interface", "struct", "trait", "protocol", "module", "enum")


def impact(nodes: DataFrame, edges: DataFrame, node: str, depth: int = 3) -> DataFrame:
    """(id, depth): what a change of node may reach, at its least depth. What a type or module contains is as near as it is; any other incoming edge is a step.

    What is ``depth`` steps away is there, but leads no further.
    """
    holders = nodes.where(F.col("kind").isin(*CONTAINERS)).select(F.col("id").alias("a"))
    inside = edges.where("kind = 'contains'").select(F.col("source").alias("a"), F.col("target").alias("b")).join(holders, "a", "left_semi")
    hop = _ways(edges, "incoming")
    seen, frontier = None, one(edges, node).join(nodes.select("id"), "id", "left_semi")
    for d in range(depth + 1):
        level = frontier if seen is None else frontier.join(seen.select("id"), "id", "left_anti")
        new = level = cut(level.select("id").distinct())
        while d < depth and not new.isEmpty():
            kids = inside.join(small(new).withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
            kids = kids.join(level, "id", "left_anti")
            new = cut(kids if seen is None else kids.join(seen.select("id"), "id", "left_anti"))
            level = level.unionByName(new)
        found = level.withColumn("depth", F.lit(d))
        seen = cut(found if seen is None else seen.unionByName(found))
        frontier = hop.join(level.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id"))
    return seen


def path(edges: DataFrame, start: str, end: str, kinds: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """(step, id): a shortest way by outgoing edges, however long (or of up to ``most`` steps), of equal ones that with the lowest predecessors; no rows where there is none."""
    spark = edges.sparkSession
    reached = levels(edges, one(edges, start), "outgoing", kinds, most)
    reached = cut(reached)
    goal = reached.where(F.col("id") == end).first()
    if goal is None:
        return spark.createDataFrame([], "step int, id string")
    hop, way = _ways(edges, "outgoing", kinds), [(goal["depth"], end)]
    for d in range(goal["depth"] - 1, -1, -1):  # one row a step
        before = hop.where(F.col("b") == way[-1][1]).join(small(reached.where(F.col("depth") == d)), F.col("a") == F.col("id"), "left_semi").agg(F.min("a")).first()[0]
        way.append((d, before))
    return spark.createDataFrame(sorted(way), "step int, id string")


def children(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    kids = edges.where((F.col("kind") == "contains") & (F.col("source") == node)).select(F.col("target").alias("id"))
    return nodes.join(kids, "id", "left_semi")


def ancestors(edges: DataFrame, node: str) -> DataFrame:
    """(id, depth) of what contains node, outwards."""
    return deep(edges, node, "incoming", ("contains",), None)


def context(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """(role, kind, id, name, file_path): what surrounds a node, by role: focal, ancestor, child, incoming, outgoing (with the edge's kind), type (type_of, returns), and import of the file that it is in. Raises ValueError where there is no such node."""
    of = nodes.select("id", "name", "file_path")
    if nodes.where(F.col("id") == node).isEmpty():
        raise ValueError(f"no such node: {node}")
    up = ancestors(edges, node)
    none = F.lit(None).cast("string").alias("kind")
    into = edges.where((F.col("target") == node) & (F.col("kind") != "contains")).select(F.lit("incoming").alias("role"), "kind", F.col("source").alias("id"))
    out = edges.where((F.col("source") == node) & (F.col("kind") != "contains"))
    files = nodes.where("kind = 'file'").join(up.select("id"), "id", "left_semi").select(F.col("id").alias("source"))
    parts = [
        one(edges, node).select(F.lit("focal").alias("role"), none, "id"),
        up.select(F.lit("ancestor").alias("role"), none, "id"),
        children(nodes, edges, node).select(F.lit("child").alias("role"), none, "id"),
        into,
        out.select(F.lit("outgoing").alias("role"), "kind", F.col("target").alias("id")),
        out.where("kind IN ('type_of', 'returns')").select(F.lit("type").alias("role"), none, F.col("target").alias("id")).distinct(),
        edges.where("kind = 'imports'").join(files, "source", "left_semi").select(F.lit("import").alias("role"), none, F.col("target").alias("id")),
    ]
    return functools.reduce(DataFrame.unionByName, parts).join(of, "id").select("role", "kind", "id", "name", "file_path")


SUBGRAPH_KINDS = ("file", "module", "class", "struct", "interface", "trait", "function", "method", "variable", "constant", "enum", "type_alias")


def subgraph(nodes: DataFrame, edges: DataFrame, wanted: Column, with_edges: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes that fit a condition, of the kinds that make up a program, and the edges among them (or none)."""
    kept = nodes.where(F.col("kind").isin(*SUBGRAPH_KINDS) & wanted)
    ids = kept.select("id").distinct()
    among = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return kept, among if with_edges else edges.limit(0)

def dependencies(nodes: DataFrame, edges: DataFrame, file_path: str) -> DataFrame:
    """(file_path): files that a file imports from."""
    out = edges.where((F.col("kind") == "imports") & (F.col("source") == f"file:{file_path}")).select(F.col("target").alias("id"))
    return nodes.join(out, "id", "left_semi").where(F.col("file_path") != file_path).select("file_path").distinct()


def dependents(nodes: DataFrame, edges: DataFrame, file_path: str) -> DataFrame:
    """(file_path): files with an import of the file or of what it exports (in Python, all its classes, functions and variables)."""
    own = nodes.where(F.col("file_path") == file_path)
    own = own.where("kind = 'file' OR is_exported OR (language = 'python' AND kind IN ('class', 'function', 'variable', 'constant'))").select(F.col("id").alias("target"))
    users = edges.where("kind = 'imports'").join(own, "target", "left_semi").select(F.col("source").alias("id"))
    return nodes.join(users, "id", "left_semi").where(F.col("file_path") != file_path).select("file_path").distinct()


def module_structure(nodes: DataFrame) -> DataFrame:
    """(dir, files): the sorted files of each folder."""
    return nodes.where("kind = 'file'").groupBy(dirname(F.col("file_path")).alias("dir")).agg(F.array_sort(F.collect_set("file_path")).alias("files"))


def file_imports(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b): file a imports file b."""
    of = nodes.select("id", "file_path")
    e = edges.where("kind = 'imports'").join(of.select(F.col("id").alias("source"), F.col("file_path").alias("a")), "source")
    return e.join(of.select(F.col("id").alias("target"), F.col("file_path").alias("b")), "target").where("a <> b").select("a", "b").distinct()


def _on_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b): file imports, those to and from files that can be on no cycle peeled off."""
    e = cut(file_imports(nodes, edges))
    n = e.count()
    while True:
        e = cut(e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
        if (m := e.count()) == n:
            return e
        n = m


def _short_cycles(e: DataFrame, longest: int) -> DataFrame:
    """(walk): cycles of up to ``longest`` files, each once, from its lowest file on."""
    walks = e.where("a < b").select(F.array("a", "b").alias("walk"), F.col("a").alias("first"), F.col("b").alias("last"))
    found = None
    for k in range(2, longest + 1):
        closed = walks.join(e, (F.col("last") == F.col("a")) & (F.col("first") == F.col("b"))).select("walk")
        found = closed if found is None else found.unionByName(closed)
        if k < longest:
            walks = walks.join(e, F.col("last") == F.col("a")).where("b > first AND NOT array_contains(walk, b)").select(F.concat("walk", F.array("b")).alias("walk"), "first", F.col("b").alias("last"))
    return found


def short_circular_dependencies(nodes: DataFrame, edges: DataFrame, longest: int = 4) -> DataFrame:
    """(cycle): import cycles of up to ``longest`` files, each once, from its lowest file on. Files on no cycle are peeled off first."""
    return _short_cycles(_on_cycles(nodes, edges), longest).select(F.array_join("walk", " > ").alias("cycle"))


def circular_dependencies(nodes: DataFrame, edges: DataFrame, longest: int = 4) -> DataFrame:
    """(cycle): every import cycle of up to ``longest`` files and, without a bound, a shortest one for each import that is on none of those.

    So each import on a cycle is in a cycle of the result. From the imports that are left the search goes on, a level at a time, until nothing new is reached.
    """
    e = _on_cycles(nodes, edges)
    short = cut(_short_cycles(e, longest))
    n = F.size("walk")
    ring = short.select("walk", F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).select(F.expr("walk[i]").alias("a"), F.expr("walk[(i + 1) % size(walk)]").alias("b"))
    left = cut(e.join(ring.distinct(), ["a", "b"], "left_anti"))
    hop = e.select(F.col("a").alias("last"), F.col("b").alias("next"))
    found = short
    frontier = left.select(F.col("a").alias("first"), F.col("b").alias("second"), F.col("b").alias("last"), F.array("a", "b").alias("walk"))
    seen = frontier.select("first", "second", "last")
    while not frontier.isEmpty():
        ahead = frontier.join(hop, "last").groupBy("first", "second", F.col("next").alias("last")).agg(F.min("walk").alias("walk"))
        closed = cut(ahead.where("last = first").select("first", "second", "walk"))
        found = found.unionByName(closed.select(F.expr("array_position(walk, array_min(walk))").cast("int").alias("p"), "walk").select(F.expr("concat(slice(walk, p, size(walk)), slice(walk, 1, p - 1))").alias("walk")))
        ahead = ahead.join(closed.select("first", "second"), ["first", "second"], "left_anti").join(seen, ["first", "second", "last"], "left_anti")
        frontier = cut(ahead.select("first", "second", "last", F.concat("walk", F.array("last")).alias("walk")))
        seen = cut(seen.unionByName(frontier.select("first", "second", "last")))
    return found.distinct().select(F.array_join("walk", " > ").alias("cycle"))


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, incoming, outgoing, callers, calls, children, depth) of every node: one pass over the edges, counted on both ends, and the number of what contains it."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(True).alias("out")), F.struct(F.col("target").alias("id"), F.lit(False).alias("out")))).alias("e"), "kind").select("e.*", "kind")
    counted = ends.groupBy("id").agg(
        F.count_if(~F.col("out")).alias("incoming"), F.count_if(F.col("out")).alias("outgoing"), F.count_if(~F.col("out") & (F.col("kind") == "calls")).alias("callers"),
        F.count_if(F.col("out") & (F.col("kind") == "calls")).alias("calls"), F.count_if(F.col("out") & (F.col("kind") == "contains")).alias("children"),
    )
    return nodes.select("id").join(counted, "id", "left").join(containers_above(edges), "id", "left").na.fill(0)


def containers_above(edges: DataFrame) -> DataFrame:
    """(id, depth): how many nodes contain each, outwards. Each round goes one container up, and ends when none is left; a cycle, which no extraction makes, ends it after as many rounds as there are first containers."""
    up = cut(first_parent(edges))
    state, most = up.select("id", F.col("parent").alias("top"), F.lit(1).cast("bigint").alias("depth")), 0
    found, limit = None, up.count()
    while most < limit:
        state = cut(state)
        if state.isEmpty():
            break
        found = state.select("id", "depth") if found is None else found.unionByName(state.select("id", "depth"))
        above = up.select(F.col("id").alias("top"), F.col("parent").alias("_next"))
        state = state.join(above, "top").select("id", F.col("_next").alias("top"), (F.col("depth") + 1).alias("depth"))
        most += 1
    return (found if found is not None else state.select("id", "depth")).groupBy("id").agg(F.max("depth").alias("depth"))


def dead_code(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("function", "method", "class")) -> DataFrame:
    used = edges.where("kind <> 'contains'").select(F.col("target").alias("id"))
    return nodes.where(F.col("kind").isin(*kinds) & ~F.coalesce(F.col("is_exported"), F.lit(False))).join(used, "id", "left_anti")


def first_parent(edges: DataFrame) -> DataFrame:
    """(id, parent): the first container of every node."""
    w = Window.partitionBy("target").orderBy("source")
    return edges.where("kind = 'contains'").withColumn("_n", F.row_number().over(w)).where("_n = 1").select(F.col("target").alias("id"), F.col("source").alias("parent"))
