"""Changes to files, as a table or stream of (path, content, removed), brought into a store batch by batch.

References are kept when they are resolved, each edge names its own, and so a change touches just what may come out otherwise: the
references of changed files, and those of whose names, or imports, a part is the name of a symbol that came or went. Dispatch and test edges
are made anew. All tables of a change are named in one commit: readers see the state before or after it, also if it fails half-way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from symgraph.functions.names import language
from symgraph.operators import linking
from symgraph.plans.lineage import cut
from symgraph.sources.extraction import extract, valid
from symgraph.sources.imports import extract_imports
from symgraph.sources.store import GraphStore

RESOLVED, DISPATCH, TESTS = "resolution:", "heuristic:synthesis", "test-analysis"


def _parts(name: str) -> Column:
    return F.filter(F.array_union(F.split(F.lower(name), r"[.:/]+"), F.array(F.lower(name), F.lower(F.substring_index(name, "/", -1)))), lambda x: x != "")


def _affected(refs: DataFrame, imports: DataFrame, gone: DataFrame, names: DataFrame) -> DataFrame:
    """refs (all columns) of changed files, or with a part, or an import, among names (low)."""
    of_file = refs.join(gone.withColumnRenamed("path", "file_path"), "file_path", "left_semi").select("ref_id")
    by_part = refs.select("ref_id", F.explode(_parts("reference_name")).alias("low")).join(names, "low", "left_semi").select("ref_id")
    renamed = imports.select("file_path", "local_name", F.explode(F.array(F.lower("exported_name"), F.element_at(F.split(F.lower("source"), "[./]+"), -1))).alias("low")).join(names, "low", "left_semi").select("file_path", "local_name").distinct()
    by_import = refs.withColumn("local_name", F.split("reference_name", r"\\.")[0]).join(renamed, ["file_path", "local_name"], "left_semi").select("ref_id")
    return refs.join(of_file.unionByName(by_part).unionByName(by_import).distinct(), "ref_id", "left_semi")


def apply_delta(store: GraphStore, changed: DataFrame) -> dict[str, int]:
    """Replace the rows of changed files, drop those of removed ones, and link anew what that touches; of a path's several rows the last by ``seq`` (where there is one) counts.

    Returns counts: files, nodes, edges, resolved and unresolved references, errors.
    """
    if "seq" in changed.columns:
        w = Window.partitionBy("path").orderBy(F.desc("seq"))
        changed = changed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    changed = cut(changed.withColumn("language", language(F.col("path"))))
    gone, new = changed.select("path").distinct(), changed.where("NOT removed")
    rows = cut(extract(new))
    nodes_new, edges_new, refs_new = valid(rows)
    w = Window.partitionBy("from_node_id", "reference_name", "reference_kind", "line").orderBy("file_path")
    key = F.sha2(F.concat_ws("\x00", "from_node_id", "reference_name", "reference_kind", F.col("line").cast("string"), F.row_number().over(w).cast("string")), 256)
    refs_new = cut(refs_new.withColumn("ref_id", key))
    of_path = gone.withColumnRenamed("path", "file_path")
    keep = {t: store.table(t).join(of_path, "file_path", "left_anti") for t in ("nodes", "refs", "imports", "dataflow_edges")}
    before = store.table("nodes").join(of_path, "file_path", "left_semi")
    nodes = cut(keep["nodes"].unionByName(nodes_new, allowMissingColumns=True))
    refs = cut(keep["refs"].unionByName(refs_new))
    imports = cut(keep["imports"].unionByName(extract_imports(new)))
    files = store.table("files").join(gone, "path", "left_anti")
    errors = rows.where("tag = 'error'").groupBy(F.col("file_path").alias("path")).agg(F.max("name").alias("errors"))
    files = files.unionByName(new.select("path", F.sha2("content", 256).alias("content_hash"), "language", F.length("content").cast("bigint").alias("size")).join(errors, "path", "left"))

    names = cut(before.select(F.lower("name").alias("low")).unionByName(nodes_new.select(F.lower("name").alias("low"))).distinct())
    touched = cut(_affected(refs, imports, gone, names))
    resolved = cut(linking.resolve(touched, nodes, imports))
    ids = nodes.select("id")
    old = store.table("edges").where(F.col("provenance").isNull() | ~(F.col("provenance").startswith(DISPATCH) | F.col("provenance").startswith(TESTS)))
    # structural edges of other files stay; resolved ones of references that are still there and weren't touched
    base = old.where("ref_id IS NULL").join(before.select(F.col("id").alias("target")), "target", "left_anti").join(before.select(F.col("id").alias("source")), "source", "left_anti")
    linked = old.where("ref_id IS NOT NULL").join(refs.select("ref_id"), "ref_id", "left_semi").join(touched.select("ref_id"), "ref_id", "left_anti").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    fresh = linking.resolved_edges(touched, resolved, nodes)
    every = cut(base.unionByName(linked).unionByName(edges_new, allowMissingColumns=True).unionByName(fresh, allowMissingColumns=True))
    every = cut(every.unionByName(linking.dispatch_edges(nodes, every).select(F.lit("calls").alias("kind"), "source", "target", F.lit(DISPATCH).alias("provenance")), allowMissingColumns=True))
    every = cut(every.unionByName(linking.test_edges(nodes, every).select(F.lit("tests").alias("kind"), "source", "target", F.lit(TESTS).alias("provenance")), allowMissingColumns=True))
    store.commit({"nodes": nodes, "edges": every, "refs": refs, "imports": imports, "files": files, "dataflow_edges": keep["dataflow_edges"]})
    n_refs, n_resolved = refs.count(), every.where("ref_id IS NOT NULL").count()
    return {"files": new.count(), "nodes": nodes_new.count(), "edges": every.count(), "resolved": n_resolved, "unresolved": n_refs - n_resolved, "errors": errors.count()}


def follow(store: GraphStore, stream: DataFrame, checkpoint: str) -> StreamingQuery:
    """Apply all that is there of a stream of changes; a batch that is repeated replaces its own rows."""
    return stream.writeStream.foreachBatch(lambda batch, _: apply_delta(store, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
