"""Filters, projections and point lookups; every order ends in the id, so that it is total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALLS = ("calls",)
REACH = ("calls", "references", "imports")


def by_name(nodes: DataFrame, name: str, ignore_case: bool = False) -> DataFrame:
    return nodes.where(F.lower("name") == name.lower() if ignore_case else F.col("name") == name)


def by_qualified_name(nodes: DataFrame, pattern: str) -> DataFrame:
    """Symbols whose qualified name fits a pattern of ``*`` and ``?``."""
    regex = "".join({"*": ".*", "?": "."}.get(c, c if c.isalnum() or c in "_: " else "\\" + c) for c in pattern)
    return nodes.where(F.col("kind").isin("function", "method", "class", "interface", "struct", "enum", "variable") & F.col("qualified_name").rlike(f"^{regex}$"))


def of_file(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(F.col("file_path") == path).orderBy("start_line", "id")


def of_kinds(nodes: DataFrame, kinds: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
    out = nodes.where(F.col("kind").isin(kinds)) if kinds else nodes
    return out.where(F.col("language").isin(languages)) if languages else out


def by_filters(nodes: DataFrame, kinds: list[str] | None = None, languages: list[str] | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    return of_kinds(nodes, kinds, languages).orderBy("name", "id").offset(offset).limit(limit)


def edges_page(edges: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return edges.orderBy("kind", "source", "target", "line").offset(offset).limit(limit)


def dataflow_of(flows: DataFrame, function: str) -> DataFrame:
    return flows.where(F.col("function_id") == function)


def claim_bundle(claims: DataFrame, grounding: DataFrame) -> DataFrame:
    """claims with ``groundings``: the places (file_path, relation, start_line, end_line) that bear each one out, in their order; none give an empty list."""
    places = grounding.groupBy(F.col("claim_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("file_path", "start_line", "end_line", "relation"))).alias("groundings"))
    empty = F.array().cast("array<struct<file_path: string, start_line: int, end_line: int, relation: string>>")
    return claims.join(places, "id", "left").withColumn("groundings", F.coalesce("groundings", empty))


def page(nodes: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return nodes.orderBy("file_path", "start_line", "id").offset(offset).limit(limit)


def by_substring(nodes: DataFrame, part: str, limit: int = 30, exclude_prefix: bool = False) -> DataFrame:
    low = F.lower("name")
    out = nodes.where(low.contains(part.lower()))
    out = out.where(~low.startswith(part.lower())) if exclude_prefix else out
    return out.orderBy(F.length("name"), "name", "id").limit(limit)


def exact_name_files(nodes: DataFrame, name: str) -> DataFrame:
    return by_name(nodes, name, True).select("file_path").distinct()


def search_text(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.concat_ws(" ", F.nullif(F.col("name"), F.lit("")), F.nullif(F.col("qualified_name"), F.lit(""))).alias("search_text"))


def incoming(edges: DataFrame, node: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    out = edges.where(F.col("target") == node)
    return out.where(F.col("kind").isin(*kinds)) if kinds else out


def outgoing(edges: DataFrame, node: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    out = edges.where(F.col("source") == node)
    return out.where(F.col("kind").isin(*kinds)) if kinds else out


def among(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges both of whose ends are in ids (id)."""
    ids = ids.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("kind") == "file").alias("files"))
    return n.crossJoin(edges.agg(F.count("*").alias("edges")))


def covering(spans: DataFrame, points: DataFrame, width: int = 64) -> DataFrame:
    """spans (file, lo, hi, ...) that hold points (file, line), ends included: a range join by buckets of ``width`` lines."""
    cells = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    asked = points.withColumn("_cell", F.floor(F.col("line") / width))
    return cells.join(asked, ["file", "_cell"]).where("line BETWEEN lo AND hi").drop("_cell")
