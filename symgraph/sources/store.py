"""A graph's tables as Parquet snapshots in a folder; a small manifest names the current ones, so a failed write changes nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from symgraph.sources.imports import IMPORTS

SCHEMAS = {
    "nodes": "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, is_exported boolean, is_async boolean, is_static boolean, is_abstract boolean, docstring string, signature string, visibility string, decorators array<string>",
    "edges": "kind string, source string, target string, line int, provenance string, ref_id string",
    "files": "path string, content_hash string, language string, size bigint, errors string",
    "refs": "ref_id string, from_node_id string, reference_name string, reference_kind string, line int, file_path string, language string",
    "imports": IMPORTS,
    "dataflow_edges": "file_path string, source_start_line int, source_end_line int, target_start_line int, target_end_line int, variable string, function_id string, provenance string",
    "summary_claims": "id string, claim_type string, claim_text string",
    "claim_grounding": "claim_id string, file_path string, relation string, start_line int, end_line int",
}


class GraphStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _manifest(self) -> dict[str, str]:
        return {r["table"]: r["path"] for r in self.spark.read.schema("version bigint, table string, path string").json(f"{self.root}/manifest").orderBy("version").collect()}

    @staticmethod
    def create(spark: SparkSession, root: str) -> GraphStore:
        store = GraphStore(spark, root)
        if store.exists():
            raise FileExistsError(root)
        store.commit({t: spark.createDataFrame([], s) for t, s in SCHEMAS.items()})
        return store

    @staticmethod
    def open(spark: SparkSession, root: str) -> GraphStore:
        store = GraphStore(spark, root)
        if not store.exists():
            raise FileNotFoundError(root)
        return store

    def exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(self._manifest()[name])

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """Write new snapshots of tables, then name them in one append to the manifest."""
        version = self.spark.read.json(f"{self.root}/manifest").count() if self.exists() else 0
        rows = []
        for name, df in tables.items():
            path = f"{self.root}/{name}-{uuid.uuid4().hex}"
            have = set(df.columns)
            df.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(SCHEMAS[name])]).write.parquet(path)
            rows.append((version, name, path))
        self.spark.createDataFrame(rows, "version bigint, table string, path string").coalesce(1).write.mode("append").json(f"{self.root}/manifest")

    def insert_nodes(self, nodes: DataFrame) -> None:
        """Those whose id is new; of equal new ids one is taken."""
        self.commit({"nodes": self.table("nodes").unionByName(nodes.dropDuplicates(["id"]).join(self.table("nodes").select("id"), "id", "left_anti"), allowMissingColumns=True)})

    def append(self, name: str, rows: DataFrame) -> None:
        self.commit({name: self.table(name).unionByName(rows, allowMissingColumns=True)})

    def delete_files(self, paths: DataFrame) -> None:
        """All rows of the files in paths (path), and edges that touch their symbols."""
        gone = paths.select("path").distinct()
        ids = self.table("nodes").join(gone.withColumnRenamed("path", "file_path"), "file_path", "left_semi").select("id")
        of_path = {t: self.table(t).join(gone.withColumnRenamed("path", "file_path"), "file_path", "left_anti") for t in ("nodes", "refs", "imports", "dataflow_edges")}
        edges = self.table("edges").join(ids.withColumnRenamed("id", "source"), "source", "left_anti").join(ids.withColumnRenamed("id", "target"), "target", "left_anti")
        self.commit({**of_path, "edges": edges, "files": self.table("files").join(gone, "path", "left_anti")})

    def delete_by_provenance(self, name: str, prefix: str) -> int:
        """Delete edges or dataflow edges whose provenance begins so; how many went. Those without provenance stay."""
        rows = self.table(name)
        hit = F.coalesce(F.col("provenance").startswith(prefix), F.lit(False))
        n = rows.where(hit).count()
        self.commit({name: rows.where(~hit)})
        return n

    def replace(self, name: str, rows: DataFrame, key: str) -> None:
        """Rows in place of those that have the same key; of several new rows with a key one is taken."""
        self.commit({name: self.table(name).join(rows.select(key), key, "left_anti").unionByName(rows.dropDuplicates([key]), allowMissingColumns=True)})

    def unresolved(self) -> DataFrame:
        """References that no edge stands for."""
        return self.table("refs").join(self.table("edges").select("ref_id"), "ref_id", "left_anti")

    def delete_dataflow(self, paths: DataFrame) -> None:
        self.commit({"dataflow_edges": self.table("dataflow_edges").join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_anti")})

    def delete_refs(self, paths: DataFrame) -> None:
        self.commit({"refs": self.table("refs").join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_anti")})

    def set_claims(self, claims: DataFrame, grounding: DataFrame) -> None:
        """All claims and what bears them out, in place of those that are there."""
        self.commit({"summary_claims": claims, "claim_grounding": grounding})
