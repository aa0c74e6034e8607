"""Relevance: random walks with restart, file scores, and clusters of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgraph.functions.names import is_test_file
from symgraph.functions.terms import is_test_query
from symgraph.operators.walk import walked
from symgraph.plans.lineage import cut, small

ALPHA, ROUNDS = 0.25, 25
KINDS = ("calls", "references", "imports", "extends", "implements", "contains", "instantiates", "tests")


def random_walk(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, alpha: float = ALPHA, rounds: int = ROUNDS) -> DataFrame:
    """(id, score): walks over undirected edges among nodes that restart, with a chance of alpha, at seeds (id, and their ``score``, or 1); parallel edges weigh more.

    The mass of nodes without edges is spread evenly. Without seeds, or with none that scores, all nodes score alike. See ``walk.walked`` for how.
    """
    ids = nodes.select("id").distinct()
    start = seeds.select("id", F.col("score") if "score" in seeds.columns else F.lit(1.0).alias("score")).groupBy("id").agg(F.max("score").cast("double").alias("_s"))
    found = start.agg(F.sum("_s")).first()[0] or 0.0
    n = ids.count()
    if not found or not n:
        return ids.withColumn("score", F.lit(1.0 / max(n, 1)))
    e = edges.where(F.col("kind").isin(*KINDS) & (F.col("source") != F.col("target"))).select("source", "target")
    if rounds < 1:
        return ids.join(start, "id", "left").select("id", (F.coalesce("_s", F.lit(0.0)) / found).alias("score"))
    return walked(ids, e, start.select("id", (F.col("_s") / found).alias("restart")), n, alpha, rounds)


def file_scores(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    return nodes.where("kind NOT IN ('import', 'export')").join(scores, "id").groupBy("file_path").agg(F.sum("score").alias("score"))


def heuristic_scores(nodes: DataFrame, edges: DataFrame, named: DataFrame, entries: DataFrame) -> DataFrame:
    """(file_path, score): of a file's symbols 50 for each that was named, 10 for an entry, 3 for what an entry is linked with, 1 for others."""
    entry = entries.select("id").distinct()
    near = edges.join(entry.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id"))
    near = near.unionByName(edges.join(entry.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id"))).distinct()
    marks = [named.select("id").distinct().withColumn("_named", F.lit(True)), entry.withColumn("_entry", F.lit(True)), near.withColumn("_near", F.lit(True))]
    out = nodes.where("kind NOT IN ('import', 'export')").select("id", "file_path")
    for m in marks:
        out = out.join(m, "id", "left")
    worth = F.when(F.col("_named"), 50.0).when(F.col("_entry"), 10.0).when(F.col("_near"), 3.0).otherwise(1.0)
    return out.groupBy("file_path").agg(F.sum(worth).alias("score"))


def relevant_files(files: DataFrame, least: float = 0.06, heuristic: DataFrame | None = None, entry_files: DataFrame | None = None) -> DataFrame:
    """(file_path, score): the walk's score and a tenth of the heuristic one, of files that have at least a share of the walk's best or an entry; of all, where fewer than two would be left."""
    both = files.select("file_path", F.col("score").alias("_walk"))
    both = both.join(heuristic.select("file_path", F.col("score").alias("_more")), "file_path", "full") if heuristic is not None else both.withColumn("_more", F.lit(0.0))
    both = both.select("file_path", F.coalesce("_walk", F.lit(0.0)).alias("_walk"), (F.coalesce("_walk", F.lit(0.0)) + 0.1 * F.coalesce("_more", F.lit(0.0))).alias("score"))
    both = both.join(entry_files.select("file_path").distinct().withColumn("_entry", F.lit(True)), "file_path", "left") if entry_files is not None else both.withColumn("_entry", F.lit(False))
    top = both.agg(F.max("_walk").alias("_top"))
    gated = both.crossJoin(F.broadcast(top)).withColumn("_ok", (F.col("_walk") >= least * F.col("_top")) | F.coalesce("_entry", F.lit(False)))
    n = gated.agg(F.count_if("_ok").alias("_n"))
    return gated.crossJoin(F.broadcast(n)).where("_ok OR _n < 2").select("file_path", "score")


def select_files(scores: DataFrame, named_files: DataFrame, most: int, query: str) -> DataFrame:
    """(file_path, score, place): files with named symbols first, tests last unless the query asks for them, then by score."""
    marked = scores.join(named_files.select("file_path").distinct().withColumn("_named", F.lit(True)), "file_path", "left")
    late = F.lit(False) if is_test_query(query) else is_test_file(F.col("file_path"))
    order = [F.coalesce("_named", F.lit(False)).desc(), late.asc(), F.desc("score"), F.asc("file_path")]
    first = marked.orderBy(*order).limit(most)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("file_path", "score", "place")  # at most ``most`` rows


#: Characters in all, files, characters a file, gap, symbols in a header, by the number of files below.
BUDGETS = ((150, (13_000, 4, 3_800, 7, 5)), (500, (18_000, 5, 3_800, 8, 6)), (5_000, (24_000, 8, 6_500, 12, 10)), (None, (24_000, 8, 7_000, 15, 15)))


def output_budget(files: int) -> dict[str, int]:
    found = next(b for most, b in BUDGETS if most is None or files < most)
    return dict(zip(("chars", "files", "chars_per_file", "gap", "symbols"), found, strict=True))


def call_budget(files: int) -> int:
    """How many calls of explore a project of so many files is worth."""
    return next((n for most, n in ((500, 1), (5_000, 2), (15_000, 3), (25_000, 4)) if files < most), 5)


ENVELOPES = ("file", "module", "class", "struct", "interface", "enum", "namespace", "protocol", "trait", "component")
POINT = 2.0


def clusters(nodes: DataFrame, gap: int = 15, scores: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """(file_path, cluster, start_line, end_line, symbols, importance, best): symbols of a file whose lines lie at most ``gap`` apart.

    nodes: a file's node tells its lines, and is no symbol here. Envelopes of over half a file are left out, and what they score goes in equal shares to the
    symbols inside; a cluster that starts in one goes back to its start. Lines from which other symbols are used are points of their own, each with an
    importance of 2. Where a file has nothing but such envelopes, each is a cluster. scores: (id, score).
    """
    length = nodes.where("kind = 'file'").select("file_path", F.col("end_line").alias("_lines"))
    n = nodes.where("kind <> 'file'").select("id", "kind", "file_path", "start_line", "end_line").join(length, "file_path", "left")
    n = n.join(scores.select("id", F.col("score").cast("double")), "id", "left").na.fill(0.0, ["score"]) if scores is not None else n.withColumn("score", F.lit(0.0))
    wide = F.col("kind").isin(*ENVELOPES) & (F.col("_lines") > 0) & (F.col("end_line") - F.col("start_line") + 1 > 0.5 * F.col("_lines"))
    n = n.withColumn("_wide", F.coalesce(wide, F.lit(False)))
    only_wide = n.groupBy("file_path").agg(F.min("_wide").alias("_all"))
    n = n.join(only_wide, "file_path")
    alone = n.where("_all").select("file_path", "start_line", "end_line", "score", F.row_number().over(Window.partitionBy("file_path").orderBy("start_line", "id")).cast("bigint").alias("cluster"))
    alone = alone.select("file_path", "cluster", "start_line", "end_line", F.lit(1).cast("bigint").alias("symbols"), F.col("score").alias("importance"), F.col("score").alias("best"))
    kept, gone = n.where("NOT _wide"), n.where("_wide AND NOT _all").select("file_path", F.col("id").alias("env"), F.col("start_line").alias("lo"), F.col("end_line").alias("hi"), F.col("score").alias("_give"))
    inside = gone.join(kept.select("file_path", "id", "start_line", "end_line"), "file_path").where("start_line >= lo AND end_line <= hi")  # a file has few envelopes of over half of it
    share = inside.groupBy("env").agg(F.count("*").alias("_n"))
    given = inside.where("_give > 0").join(share, "env").groupBy("id").agg(F.sum(F.col("_give") / F.col("_n")).alias("_got"))
    ranges = kept.join(given, "id", "left").where("start_line > 0 AND end_line >= start_line").select("file_path", "start_line", "end_line", (F.col("score") + F.coalesce("_got", F.lit(0.0))).alias("score"), F.col("id").alias("_tie"), F.lit(1).alias("_symbol"), F.lit(1).cast("bigint").alias("_n"))
    if edges is not None:
        used = edges.where("kind <> 'contains' AND line > 0").select("source", "line", "target").join(kept.select(F.col("id").alias("source"), "file_path"), "source").select("file_path", "line", "target").distinct()
        used = used.groupBy("file_path", "line").agg(F.count("*").alias("_n"))  # points of a line lie in the same cluster
        ranges = ranges.unionByName(used.select("file_path", F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.lit(POINT).alias("score"), F.lit("~").alias("_tie"), F.lit(0).alias("_symbol"), "_n"))
    w = Window.partitionBy("file_path").orderBy("start_line", "end_line", "_tie")
    reach = F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.withColumn("_new", F.when(F.col("start_line") <= reach + gap, 0).otherwise(1)).withColumn("cluster", F.sum("_new").over(w))
    out = ranges.groupBy("file_path", "cluster").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.sum("_symbol").alias("symbols"), F.sum(F.col("score") * F.col("_n")).alias("importance"), F.max("score").alias("best"))
    outer = out.join(gone, "file_path").where("start_line BETWEEN lo AND hi").groupBy("file_path", "cluster").agg(F.min("lo").alias("_lo"))
    out = out.join(outer, ["file_path", "cluster"], "left").withColumn("start_line", F.coalesce("_lo", "start_line"))
    return out.select(*alone.columns).unionByName(alone)


def within_budget(clustered: DataFrame, budget: int, per_line: int = 60) -> DataFrame:
    """The clusters of each file that fit a budget of characters, by best symbol, density, importance and shortness; the first always stays, and nothing after what doesn't fit."""
    lines = F.col("end_line") - F.col("start_line") + 1
    w = Window.partitionBy("file_path").orderBy(F.desc("best"), (F.col("importance") / F.greatest(lines, F.lit(1))).desc(), F.desc("importance"), lines, "start_line")
    out = clustered.withColumn("_spent", F.sum(per_line * lines).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    return out.where((F.col("_spent") <= budget) | (F.col("_n") == 1)).drop("_spent", "_n")


def flow_chain(edges: DataFrame, named: DataFrame, depth: int = 8, bridge: int = 1) -> DataFrame:
    """(step, id): the longest way by calls from one named symbol (id) to another, of at least three symbols, with at most ``bridge`` others running between named ones.

    Each level is one join of all named symbols' frontiers, broadcast if they are few, with the calls; a symbol is entered once from each start, by the way with the fewest others at its end, then by the ids on it.
    """
    names = cut(named.select("id").distinct())
    hop = edges.where("kind = 'calls' AND source <> target").select(F.col("source").alias("last"), F.col("target").alias("next"))
    spots = small(names).select(F.col("id").alias("next"), F.lit(True).alias("_named"))
    frontier = names.select(F.col("id").alias("start"), F.col("id").alias("last"), F.lit(0).alias("streak"), F.array("id").alias("walk"))
    seen, best = cut(frontier.select("start", "last")), None
    for _ in range(depth - 1):
        ahead = small(frontier).join(hop, "last").join(spots, "next", "left").select("start", F.col("next").alias("last"), F.when(F.col("_named"), 0).otherwise(F.col("streak") + 1).alias("streak"), F.concat("walk", F.array("next")).alias("walk"))
        ahead = ahead.where(F.col("streak") <= bridge).join(seen, ["start", "last"], "left_anti")
        frontier = cut(ahead.groupBy("start", "last").agg(F.min(F.struct("streak", "walk")).alias("b")).select("start", "last", "b.*"))
        found = frontier.where("streak = 0").agg(F.min("walk")).first()[0]
        if found is not None:
            best = found
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier.select("start", "last")))
    rows = list(enumerate(best)) if best is not None and len(best) >= 3 else []
    return edges.sparkSession.createDataFrame(rows, "step int, id string")


def blast_radius(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, callers, files, test_files): how many symbols call or refer to each root, and from how many files, tests apart."""
    e = edges.where("kind IN ('calls', 'references', 'imports')").select("source", "target").join(roots.select(F.col("id").alias("target")), "target", "left_semi")
    users = e.join(nodes.select(F.col("id").alias("source"), "file_path"), "source").repartition(max(8, -(-edges.count() // 1_000_000)), "target")  # all that follows is counted where it then is
    per_file = users.groupBy("target", "source", "file_path").agg(F.lit(1).alias("_one")).groupBy("target", "file_path").agg(F.count("*").alias("_n")).withColumn("_test", is_test_file(F.col("file_path")))
    return per_file.groupBy(F.col("target").alias("root")).agg(F.sum("_n").alias("callers"), F.count_if(~F.col("_test")).alias("files"), F.count_if(F.col("_test")).alias("test_files"))


def unique_names(nodes: DataFrame, named: DataFrame, most: int = 3) -> DataFrame:
    """(id) of named symbols whose name at most ``most`` nodes have."""
    rare = nodes.groupBy("name").agg(F.count("*").alias("_n")).where(F.col("_n") <= most)
    return nodes.join(named.select("id").distinct(), "id", "left_semi").join(rare, "name", "left_semi").select("id")


def callers_of(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, name, file_path, start_line, callers, files, test_files): of each root that anything uses, how many symbols do, and from which files, tests apart; both lists sorted."""
    e = edges.where("kind IN ('calls', 'references', 'imports')").join(roots.select(F.col("id").alias("target")), "target", "left_semi").select("target", "source").distinct()
    users = e.join(nodes.select(F.col("id").alias("source"), "file_path"), "source").withColumn("_test", is_test_file(F.col("file_path")))
    found = users.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("callers"), F.array_sort(F.collect_set(F.when(~F.col("_test"), F.col("file_path")))).alias("files"), F.array_sort(F.collect_set(F.when(F.col("_test"), F.col("file_path")))).alias("test_files"))
    return roots.select("id", "name", "file_path", "start_line").join(found, "id")
