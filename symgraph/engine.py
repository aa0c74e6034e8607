"""A code graph of a project: index it, change it, ask it."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.operators import graph, lookup, ranking, search
from symgraph.operators.context import relevant_context
from symgraph.report import explore
from symgraph.sources.files import changes, scan
from symgraph.sources.project import LocalFiles, Settings, git_files
from symgraph.sources.store import GraphStore
from symgraph.streaming.delta import apply_delta


class CodeGraph:
    """Everything that can be asked of one project's store; all answers are DataFrames."""

    def __init__(self, spark: SparkSession, root: str, store: GraphStore, settings: Settings):
        self.spark, self.root, self.store, self.settings = spark, root, store, settings
        self.files = LocalFiles(root)

    @staticmethod
    def create(spark: SparkSession, root: str, where: str, settings: Settings | None = None) -> CodeGraph:
        """A new graph of the project at root, stored in the folder ``where``; an error if there is one."""
        settings = settings or Settings()
        store = GraphStore.create(spark, where)
        settings.save(root)
        return CodeGraph(spark, root, store, settings)

    @staticmethod
    def open(spark: SparkSession, root: str, where: str) -> CodeGraph:
        return CodeGraph(spark, root, GraphStore.open(spark, where), Settings.load(root))

    def _scan(self) -> DataFrame:
        known = git_files(self.root)
        listed = None if known is None else self.spark.createDataFrame([(p,) for p in known], "path string")
        found = scan(self.spark, self.root, tuple(self.settings.include), tuple(self.settings.exclude), self.settings.max_file_size, listed)
        return found.where(F.col("language").isin(self.settings.languages)) if self.settings.languages else found

    def index_all(self) -> dict[str, int]:
        """Bring in files that are new or whose content changed, by their hashes, which come before any parsing. Files that are gone stay until they are deleted."""
        now = self._scan()
        todo = changes(now, self.store.table("files")).where("change <> 'removed'").select("path")
        return apply_delta(self.store, now.join(todo, "path", "left_semi").select("path", "content", F.lit(False).alias("removed")))

    def index_file(self, path: str) -> dict[str, int]:
        return self.apply_delta([path], [])

    def delete_file(self, path: str) -> None:
        self.apply_delta([], [path])

    def apply_delta(self, changed: list[str], removed: list[str]) -> dict[str, int]:
        """Files, by their paths in the project, that changed (or came) and that were removed."""
        rows = [(p, self.files.read(p), False) for p in changed] + [(p, None, True) for p in removed]
        return apply_delta(self.store, self.spark.createDataFrame(rows, "path string, content string, removed boolean"))

    @property
    def nodes(self) -> DataFrame:
        return self.store.table("nodes")

    @property
    def edges(self) -> DataFrame:
        return self.store.table("edges")

    def search(self, query: str, limit: int = 20) -> DataFrame:
        return search.search(self.nodes, query, limit, project=self.files.name_tokens())

    def callers(self, node: str, depth: int = 1) -> DataFrame:
        return graph.deep(self.edges, node, "incoming", lookup.REACH, depth)

    def callees(self, node: str, depth: int = 1) -> DataFrame:
        return graph.deep(self.edges, node, "outgoing", lookup.REACH, depth)

    def testers(self, node: str, depth: int = 1) -> DataFrame:
        return graph.deep(self.edges, node, "incoming", ("tests",), depth)

    def tested_targets(self, node: str, depth: int = 1) -> DataFrame:
        return graph.deep(self.edges, node, "outgoing", ("tests",), depth)

    def call_graph(self, node: str, depth: int = 2) -> DataFrame:
        return graph.call_graph(self.edges, node, depth)

    def type_hierarchy(self, node: str) -> DataFrame:
        return graph.hierarchy(self.edges, node)

    def usages(self, node: str) -> DataFrame:
        return graph.usages(self.nodes, self.edges, node)

    def impact(self, node: str, depth: int = 3) -> DataFrame:
        return graph.impact(self.nodes, self.edges, node, depth)

    def path(self, start: str, end: str, kinds: tuple[str, ...] = ()) -> DataFrame:
        return graph.path(self.edges, start, end, kinds)

    def context(self, node: str) -> DataFrame:
        return graph.context(self.nodes, self.edges, node)

    def circular_dependencies(self) -> DataFrame:
        return graph.circular_dependencies(self.nodes, self.edges)

    def dead_code(self) -> DataFrame:
        return graph.dead_code(self.nodes, self.edges)

    def metrics(self) -> DataFrame:
        return graph.metrics(self.nodes, self.edges)

    def relevant_context(self, query: str, **how: float) -> tuple[DataFrame, DataFrame]:
        return relevant_context(self.nodes, self.edges, query, project=self.files.name_tokens(), **how)

    def explore(self, query: str, most_chars: int | None = None, most_files: int | None = None) -> str:
        return explore(self.nodes, self.edges, query, self.files.read, most_chars, most_files, self.files.name_tokens())

    def claims(self, text: str, claim_type: str | None = None, limit: int = 20) -> DataFrame:
        """Claims found by their words, each with the places that bear it out."""
        found = search.search_claims(self.store.table("summary_claims"), text, claim_type, limit)
        return lookup.claim_bundle(found, self.store.table("claim_grounding"))

    def stats(self) -> DataFrame:
        return lookup.stats(self.nodes, self.edges)

    def blast_radius(self, nodes: list[str]) -> DataFrame:
        return ranking.blast_radius(self.nodes, self.edges, self.spark.createDataFrame([(n,) for n in nodes], "id string"))


def main(root: str, where: str | None = None) -> None:
    """Index a project and show what there is."""
    spark = SparkSession.builder.appName("symgraph").getOrCreate()
    where = where or "file://" + os.path.join(os.path.abspath(root), ".symgraph", "store")
    project = CodeGraph.open(spark, root, where) if GraphStore(spark, where).exists() else CodeGraph.create(spark, root, where)
    print(project.index_all())
    project.stats().show()
    project.search("class").select("kind", "name", "file_path", "score").show(10, False)


if __name__ == "__main__":
    main(*sys.argv[1:3])
