"""What of a graph a question in plain words is about: entry points by name, by definition and by text, and what surrounds them."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgraph.functions.names import is_test_file
from symgraph.functions.terms import is_test_query, query_symbols, search_terms, stems
from symgraph.operators import graph, search
from symgraph.plans.lineage import cut, small

TYPES = ("class", "interface", "struct", "trait", "protocol")
TELLING = ("function", "method", *TYPES[:3], "type_alias", "trait", "component", "route", "variable", "constant", "enum", "module", "namespace")
CALLABLE = ("function", "method", "property", "component", "class", "interface", "struct", "trait", "protocol", "enum", "route")
RECOVERED = ("calls", "extends", "implements", "references", "overrides")


def named_seeds(nodes: DataFrame, query: str, most: int = 20, project: frozenset[str] | set[str] = frozenset()) -> DataFrame:
    """(id, score) of symbols that a query names: 50 where at most three definitions have the name, else 20 for up to four that also have a type or file of the query, or for the longest.

    Names are taken in the order of ``query_symbols`` until there are ``most`` seeds; those of a name stay together. Tests count only if the query asks for them.
    """
    from symgraph.functions.terms import plain_name

    names = query_symbols(query)
    if not names:
        return nodes.limit(0).select("id", F.lit(0.0).alias("score"))
    types = sorted({n.lower() for n in names if n[0].isupper() and len(n) >= 4 and plain_name(n) not in project})
    order = {}
    for n in names:
        order.setdefault(n.lower(), len(order))
    at = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])[F.lower("name")]
    test = is_test_file(F.col("file_path"))
    found = nodes.where(F.lower("name").isin(list(order)) & F.col("kind").isin(*CALLABLE)).withColumn("_at", at).withColumn("_test", test)
    found = found if is_test_query(query) else found.where(~F.col("_test"))
    w = Window.partitionBy("_at")
    by_body = ["_test", (F.col("start_line") - F.col("end_line")).asc(), "id"]
    context = F.lit(False)
    for t in types:
        context = context | F.lower("file_path").contains(t) | F.lower("qualified_name").contains(t)
    found = found.withColumn("_n", F.count("*").over(w)).withColumn("_in", context)
    found = found.withColumn("_hit", F.max("_in").over(w)).withColumn("_k", F.row_number().over(Window.partitionBy("_at", "_in").orderBy(*by_body)))
    picks = found.where((F.col("_n") <= 3) | F.when(F.col("_hit"), F.col("_in") & (F.col("_k") <= 4)).otherwise(F.col("_k") <= 1))
    sums = picks.groupBy("_at").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each name of the query
    picks = picks.join(sums.withColumn("_before", before).where(F.col("_before") < most).select("_at"), "_at", "left_semi")
    return picks.select("id", F.when(F.col("_n") <= 3, 50.0).otherwise(20.0).alias("score"))


def _definitions(nodes: DataFrame, symbols: list[str], each: int) -> DataFrame:
    """(id, score): types whose names begin like a word of the query, or a shorter form of one, written as a type's name."""
    titles = sorted({t.lower() for s in {x for y in symbols for x in (y, *stems(y))} if (t := s[0].upper() + s[1:].lower()) != s})
    kinds = (*TYPES, "enum", "type_alias")
    low = F.lower("name")
    hits = nodes.where(F.col("kind").isin(*kinds)).withColumn("_title", F.explode(F.filter(F.array(*[F.lit(t) for t in titles]) if titles else F.array().cast("array<string>"), lambda t: low.startswith(t))))
    score = 16.0 + F.greatest(F.lit(0.0), 10 - (F.length("name") - F.length("_title")) / 3)
    ranked = hits.withColumn("score", score).withColumn("_k", F.row_number().over(Window.partitionBy("_title").orderBy(F.desc("score"), "name", "id")))
    return ranked.where(F.col("_k") <= each).groupBy("id").agg(F.max("score").alias("score"))


def entry_points(nodes: DataFrame, edges: DataFrame, query: str, limit: int = 3, least: float = 0.3, kinds: tuple[str, ...] = TELLING, project: frozenset[str] | set[str] = frozenset()) -> DataFrame:
    """(id, score) of at most ``limit`` symbols: those named by the query, types whose names begin like its words, and what text search finds for each term, by the best score; tests count for less."""
    symbols = query_symbols(query)
    parts = []
    if symbols:
        exact = search.by_exact_names(nodes, symbols, 50, list(kinds))
        together = exact.groupBy("file_path").agg((20.0 * (F.countDistinct(F.lower("name")) - 1)).alias("_more"))
        exact = exact.join(together, "file_path").select("id", (F.col("score") + F.col("_more")).alias("score")).orderBy(F.desc("score"), "id").limit(max(2 * limit, 1))
        both = exact.unionByName(_definitions(nodes, symbols, limit).join(exact.select("id"), "id", "left_anti"))
        parts.append(both.orderBy(F.desc("score"), "id").limit(3 * limit))
    hits = [search.search(nodes, t, 2 * limit, kinds=list(kinds), project=project).select("id", "score") for t in sorted(search_terms(query))]
    if hits:
        text = functools.reduce(DataFrame.unionByName, hits).groupBy("id").agg((F.max("score") + 5 * (F.count("*") - 1)).alias("score"))
        parts.append(text.orderBy(F.desc("score"), "id").limit(2 * limit))
    if not parts:
        return nodes.limit(0).select("id", F.lit(0.0).alias("score"))
    every = functools.reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.max("score").alias("score")).join(nodes.select("id", "kind", "file_path"), "id")
    weight = F.lit(1.0) if is_test_query(query) else F.when(is_test_file(F.col("file_path")), 0.3).otherwise(1.0)
    every = every.withColumn("score", F.col("score") * weight).orderBy(F.desc("score"), "id").limit(3 * limit).where(F.col("score") >= least)
    through = every.where("kind IN ('import', 'export')").join(edges.where("kind IN ('imports', 'exports')").select(F.col("source").alias("id"), "target"), "id").select(F.col("target").alias("id"), "score")
    every = every.where("kind NOT IN ('import', 'export')").select("id", "score").unionByName(through).groupBy("id").agg(F.max("score").alias("score"))
    return every.orderBy(F.desc("score"), "id").limit(limit)


def _around(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int, each: int, kinds: tuple[str, ...]) -> DataFrame:
    """(id): of each root the ``each`` nearest symbols of the kinds, both ways; all roots' frontiers go a step at a time together."""
    allowed = nodes.where(F.col("kind").isin(*kinds)).select("id")
    out, back = edges.select(F.col("source").alias("a"), F.col("target").alias("b")), edges.select(F.col("target").alias("a"), F.col("source").alias("b"))
    hop = out.unionByName(back).where("a <> b")
    seen = cut(roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")))
    frontier = seen
    for d in range(1, depth + 1):
        ahead = cut(small(frontier).join(hop, F.col("id") == F.col("a")).select("root", F.col("b").alias("id")).distinct())
        ahead = ahead.join(allowed.join(small(ahead.select("id")), "id", "left_semi"), "id", "left_semi")
        frontier = cut(ahead.join(seen, ["root", "id"], "left_anti").select("root", "id", F.lit(d).alias("depth")))
        seen = seen.unionByName(frontier)  # root, id, depth
    near = seen.withColumn("_k", F.row_number().over(Window.partitionBy("root").orderBy("depth", "id"))).where(F.col("_k") <= each)
    return near.select("id").distinct()


def relevant_context(nodes: DataFrame, edges: DataFrame, query: str, limit: int = 3, depth: int = 1, most: int = 20, least: float = 0.3, kinds: tuple[str, ...] = TELLING, project: frozenset[str] | set[str] = frozenset()) -> tuple[DataFrame, DataFrame]:
    """(nodes with ``root``, edges): entry points, the types above and below them, and what is near, with the edges among all that.

    About ``most`` symbols: a quarter of it for the types, its share of it around each entry; of a file at most a fifth of it (five at least) stay, entries
    and types first, and of tests 15 in a hundred (three at least), unless the query asks for them.
    """
    if not query.strip():
        return nodes.limit(0).withColumn("root", F.lit(False)), edges.limit(0)
    roots = cut(entry_points(nodes, edges, query, limit, least, kinds, project))
    n = roots.count()
    of_type = roots.join(nodes.where(F.col("kind").isin(*TYPES)).select("id"), "id", "left_semi").select("id")
    lineage = [graph.levels(edges, of_type, way, ("extends", "implements")).where("depth > 0").select("id") for way in ("outgoing", "incoming")]
    family = lineage[0].unionByName(lineage[1]).distinct().orderBy("id").limit(max(1, most // 4))
    ids = cut(roots.select("id").unionByName(family).unionByName(_around(nodes, edges, roots, depth, max(1, most // max(1, n)), kinds)).distinct())
    kept = nodes.join(small(ids), "id", "left_semi").join(roots.select("id", F.lit(True).alias("root")), "id", "left").withColumn("root", F.coalesce("root", F.lit(False)))
    worth = F.when(F.col("root"), 10).otherwise(0) + F.when(F.col("kind").isin(*TYPES, "enum"), 3).otherwise(0)
    kept = kept.withColumn("_k", F.row_number().over(Window.partitionBy("file_path").orderBy(worth.desc(), "id"))).where(F.col("_k") <= max(5, most // 5)).drop("_k")
    if not is_test_query(query):
        test = is_test_file(F.col("file_path"))
        few = kept.where(test).orderBy(F.col("root").desc(), "id").limit(max(3, most * 15 // 100))
        kept = kept.where(~test).unionByName(few)
    kept = cut(kept)
    among = edges.where(F.col("kind").isin(*RECOVERED, "contains"))
    few = small(kept)
    among = among.join(few.select(F.col("id").alias("source")), "source", "left_semi").join(few.select(F.col("id").alias("target")), "target", "left_semi")
    return kept, among
