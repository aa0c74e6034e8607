"""The graph's queries against their SQL, and operators on small graphs with parallel edges, loops and cycles."""

import os

import pytest

from symgraph.functions import names as N
from symgraph.operators import graph as G
from symgraph.operators import linking, lookup, ranking, search
from symgraph.plans import queries
from symgraph.sources import extraction, files, projection
from symgraph.sources.store import GraphStore
from symgraph.streaming.delta import apply_delta, follow

DATA = "/root/testdata/sf0.001"
EDGE = "kind string, source string, target string, line int"
NODE = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, is_exported boolean"


@pytest.fixture(scope="module")
def edges(spark):
    calls = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), ("c", "d"), ("e", "a")]
    return spark.createDataFrame([("calls", s, t, i) for i, (s, t) in enumerate(calls)] + [("contains", "f", x, None) for x in "abcde"], EDGE)


def test_levels(edges):
    assert {tuple(r) for r in G.levels(edges, G.one(edges, "a"), "outgoing", ("calls",)).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {tuple(r) for r in G.deep(edges, "a", "incoming", ("calls",), 1).collect()} == {("c", 1), ("e", 1)}
    assert [r.id for r in G.path(edges, "e", "d", ("calls",)).orderBy("step").collect()] == ["e", "a", "b", "c", "d"]
    assert G.path(edges, "d", "e", ("calls",)).count() == 0
    assert [tuple(r) for r in G.path(edges, "a", "a").collect()] == [(0, "a")]
    nodes = edges.sparkSession.createDataFrame([(x, k, x, x, "p.py", "python", 1, 2, False) for x, k in [*((x, "function") for x in "abcde"), ("f", "file")]], NODE)
    assert {tuple(r) for r in G.impact(nodes, edges, "d", 1).collect()} == {("d", 0), ("c", 1), ("f", 1)}  # a file's other symbols aren't reached
    assert {tuple(r) for r in G.impact(nodes, edges, "d", 2).collect()} == {("d", 0), ("c", 1), ("f", 1), ("b", 2)}
    assert G.impact(nodes, edges, "none", 2).count() == 0
    assert lookup.incoming(edges, "b", ("calls",)).count() == 2  # two call sites


def test_long_paths_and_cycles(spark):
    chain = spark.createDataFrame([("calls", f"n{i:02}", f"n{i + 1:02}", 1) for i in range(34)], EDGE)
    assert [r.id for r in G.path(chain, "n00", "n34", ("calls",)).orderBy("step").collect()] == [f"n{i:02}" for i in range(35)]
    rings = [["c", "d", "e", "f", "g", "b"], ["x", "y"], ["c", "z"], ["p", "q", "r", "s", "t"]]
    imports = {(a, b) for r in rings for a, b in zip(r, r[1:] + r[:1], strict=True)} | {("y", "c"), ("e", "p"), ("t", "end")}
    nodes = spark.createDataFrame([(f"file:{x}", "file", x, x, x, "python", 1, 2, False) for x in {y for i in imports for y in i}], NODE)
    edges = spark.createDataFrame([("imports", f"file:{a}", f"file:{b}", None) for a, b in sorted(imports)], EDGE)
    short = ["c > z", "x > y"]
    assert sorted(r.cycle for r in G.short_circular_dependencies(nodes, edges).collect()) == short
    assert sorted(r.cycle for r in G.circular_dependencies(nodes, edges).collect()) == sorted([*short, "b > c > d > e > f > g", "p > q > r > s > t"])


def test_random_walk(spark, edges):
    nodes = spark.createDataFrame([(x, "function", x, x, "p.py", "python", 1, 2, False) for x in "abcdez"], NODE)
    only = edges.where("kind = 'calls'")
    score = {r.id: r.score for r in ranking.random_walk(nodes, only, G.one(only, "a")).collect()}
    assert abs(sum(score.values()) - 1) < 1e-9 and max(score, key=score.get) == "a" and score["b"] > score["d"] > score["z"]
    assert {round(r.score, 12) for r in ranking.random_walk(nodes, only, only.selectExpr("source AS id").limit(0)).collect()} == {round(1 / 6, 12)}

    def walked(seeds: dict) -> dict:
        """The same, node by node."""
        near = {x: [] for x in "abcdez"}
        for a, b in [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "a")]:
            near[a].append(b)
            near[b].append(a)
        start = {x: seeds.get(x, 0) / sum(seeds.values()) for x in near}
        now = dict(start)
        for _ in range(25):
            new = {x: 0.25 * start[x] for x in near}
            for x, v in now.items():
                for y in near[x] or near:
                    new[y] += 0.75 * v / (len(near[x]) or len(near))
            now = new
        return now

    want = walked({"a": 50.0, "z": 10.0})
    got = ranking.random_walk(nodes, only, spark.createDataFrame([("a", 50.0), ("z", 10.0)], "id string, score double")).collect()
    assert all(abs(r.score - want[r.id]) < 1e-12 for r in got) and len(got) == 6


def test_random_walk_over_blocks(spark, monkeypatch):
    import random

    import numpy as np

    from symgraph.operators import walk

    for name, value in (("ALONE_NODES", 0), ("LEAST", 3), ("CELL", 20)):
        monkeypatch.setattr(walk, name, value)
    rnd, n = random.Random(7), 60
    pairs = [(rnd.randrange(n - 5), rnd.randrange(n - 5)) for _ in range(300)]  # the last five have no edges
    nodes = spark.createDataFrame([(f"v{i}", "function", "x", "x", "p.py", "python", 1, 2, False) for i in range(n)], NODE)
    edges = spark.createDataFrame([("calls", f"v{a}", f"v{b}", 1) for a, b in pairs] + [("calls", "v1", "gone", 1), ("calls", "gone", "v2", 1), ("other", "v3", "v59", 1)], EDGE)
    w = np.zeros((n, n))
    for a, b in pairs:
        if a != b:
            w[a, b] += 1
            w[b, a] += 1
    start = np.zeros(n)
    start[4], start[57] = 0.75, 0.25
    want, deg = start, w.sum(1)
    for _ in range(25):
        want = 0.25 * start + 0.75 * (w.T @ np.where(deg > 0, want / np.maximum(deg, 1), 0) + want[deg == 0].sum() / n)
    seeds = spark.createDataFrame([("v4", 3.0), ("v57", 1.0)], "id string, score double")
    got = {r.id: r.score for r in ranking.random_walk(nodes, edges, seeds).collect()}
    assert len(got) == n and all(abs(got[f"v{i}"] - want[i]) < 1e-12 for i in range(n))
    plan = ranking.random_walk(nodes, edges, seeds, rounds=4)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("SortMergeJoin") + plan.count("HashJoin") <= 2  # edges are packed once; no round joins them
    assert {r.id: r.score for r in ranking.random_walk(nodes, edges, seeds, rounds=0).collect()}["v4"] == 0.75


def test_file_ranking_takes_all_rounds(spark, monkeypatch):
    took = []

    def walk(nodes, edges, seeds, alpha=ranking.ALPHA, rounds=ranking.ROUNDS):
        took.append((alpha, rounds))
        return nodes.selectExpr("id", "1.0D AS score")

    monkeypatch.setattr(ranking, "random_walk", walk)
    assert queries.QUERIES["e7_files"](spark, DATA).count() > 0 and took == [(0.25, 25)]


@pytest.mark.parametrize(
    ("path", "test"),
    [("tests/a.py", True), ("src/test_a.py", True), ("src/a_test.go", True), ("a/FooTest.java", True), ("src/contest.py", False), ("src/latest.py", False), ("examples/a.py", True), ("a.spec.ts", True), ("src/a.py", False)],
)
def test_test_files(spark, path, test):
    from pyspark.sql import functions as F

    assert spark.range(1).select(N.is_test_file(F.lit(path))).first()[0] is test


def test_parse_query():
    q = search.parse_query('kind:class lang:python path:"a b" name:x kind:nothing foo "bar baz"')
    assert (q.kinds, q.languages, q.paths, q.names, q.text) == (["class"], ["python"], ["a b"], ["x"], 'kind:nothing foo "bar baz"')
    assert search.parse_query("lang:klingon kind: :x").text == "lang:klingon kind: :x"


def test_globs():
    import re

    fits = lambda g, p: bool(re.match(files.glob_regex(g), p))
    assert fits("**/*.py", "a.py") and fits("**/*.py", "x/y/a.py") and not fits("**/*.py", "a.pyc") and fits("**/node_modules/**", "x/node_modules/y.js")


PY = '''import os
from .models import User as U

LIMIT = 3

class Admin(U, base.Mixin):
    @property
    def name(self):
        return self.load()

    def greet(self):
        def inner():
            helper()
        return print(os.getcwd())

def run():
    return Admin().greet()
'''


def test_extract(spark):
    table = [("m.py", PY, "python"), ("bad.py", "def (", "python"), ("x.c", "int a;\n", "c"), ("n.py", None, "python")]
    rows = extraction.extract(spark.createDataFrame(table, "path string, content string, language string")).collect()
    nodes = {(r.kind, r.name) for r in rows if r.tag == "node"}
    assert {("class", "Admin"), ("property", "name"), ("method", "greet"), ("function", "run"), ("constant", "LIMIT"), ("import", "os"), ("import", ".models"), ("file", "bad.py"), ("file", "x.c")} <= nodes and ("function", "inner") not in nodes
    refs = {(r.kind, r.name) for r in rows if r.tag == "ref"}
    assert {("extends", "U"), ("extends", "base.Mixin"), ("imports", "U"), ("imports", ".models"), ("calls", "helper"), ("calls", "load"), ("calls", "Admin"), ("calls", "os.getcwd"), ("decorates", "property")} <= refs and ("imports", "os") not in refs
    assert [r.file_path for r in rows if r.tag == "error"] == ["bad.py"]
    assert all(r.is_exported is False and r.language == ("c" if r.file_path == "x.c" else "python") for r in rows if r.tag == "node")
    assert {(r.name, r.signature) for r in rows if r.kind in ("method", "constant") and r.tag == "node"} == {("greet", "(self)"), ("LIMIT", "= 3")}


def found(path: str, text: str, language: str) -> tuple[dict, set]:
    rows = extraction.symbols(path, text, language)
    assert not [r for r in rows if r["tag"] == "error"]
    return {(r["kind"], r["qualified_name"]): r for r in rows if r["tag"] == "node"}, {(r["kind"], r["name"]) for r in rows if r["tag"] == "ref"}


def test_extract_typescript():
    nodes, refs = found(
        "a.ts",
        "import { A } from './types';\n/** A service. */\nexport class Svc extends Base<X> implements IS, Other {\n  private name: string = 'class Foo {';\n  constructor(private repo: Repo) { super(repo); this.repo.load(); }\n  async find(id: number): Promise<User> {\n    const x = new User(id);\n    return this.fetch(x, () => { helper(); });\n  }\n}\n"
        "export interface IS extends Root { find(id: number): Promise<User>; }\nenum Color { Red, Green = 2 }\nexport type Id = string;\nexport const LIMIT = 10;\nlet counter = 0;\nconst add = (a: number) => a;\nfunction main() { if (x) { add(1); } }\n",
        "typescript",
    )
    want = {("class", "Svc"), ("property", "Svc::name"), ("method", "Svc::constructor"), ("method", "Svc::find"), ("interface", "IS"), ("enum", "Color"), ("enum_member", "Color::Red"), ("enum_member", "Color::Green"), ("type_alias", "Id"), ("constant", "LIMIT"), ("variable", "counter"), ("function", "add"), ("function", "main"), ("import", "./types"), ("file", "a.ts")}
    assert nodes.keys() == want
    assert refs == {("extends", "Base"), ("implements", "IS"), ("implements", "Other"), ("extends", "Root"), ("imports", "./types"), ("instantiates", "User"), ("calls", "repo.load"), ("calls", "fetch"), ("calls", "helper"), ("calls", "add")}
    svc, find = nodes["class", "Svc"], nodes["method", "Svc::find"]
    assert svc["is_exported"] and svc["docstring"] == "A service." and (svc["start_line"], svc["end_line"]) == (3, 10) and find["is_async"] and (find["start_line"], find["end_line"]) == (6, 9) and nodes["property", "Svc::name"]["visibility"] == "private"


def test_extract_go_rust_java():
    nodes, refs = found("a.go", 'package main\n\nimport (\n\t"fmt"\n\tm "app/internal/m"\n)\n\n// User is one.\ntype User struct {\n\tBase\n\tName string\n}\n\ntype Store interface {\n\tGet(id int) *User\n}\n\ntype ID int\nconst Max = 3\n\nfunc (u *User) Greet(s string) string {\n\treturn fmt.Sprintf("%s {", u.format(s))\n}\n\nfunc newUser() *User { return nil }\n', "go")
    assert nodes.keys() == {("file", "a.go"), ("import", "fmt"), ("import", "app/internal/m"), ("struct", "User"), ("interface", "Store"), ("type_alias", "ID"), ("constant", "Max"), ("method", "User::Greet"), ("function", "newUser")}
    assert refs == {("imports", "fmt"), ("imports", "app/internal/m"), ("extends", "Base"), ("calls", "fmt.Sprintf"), ("calls", "u.format")} and nodes["struct", "User"]["docstring"] == "User is one." and not nodes["function", "newUser"]["is_exported"]
    nodes, refs = found("a.rs", 'use std::fmt;\npub struct Point { x: i32 }\nenum Shape { Circle(f64), Unit }\npub trait Draw: Base { fn draw(&self); }\nimpl Draw for Point { fn draw(&self) { println!("{}", 1); helper(self.x); } }\nimpl Point { pub fn new() -> Self { Point::make() } }\n', "rust")
    assert {("struct", "Point"), ("enum", "Shape"), ("enum_member", "Shape::Circle"), ("interface", "Draw"), ("function", "Point::draw"), ("function", "Point::new"), ("import", "std::fmt")} <= nodes.keys()
    assert {("implements", "Draw"), ("extends", "Base"), ("calls", "helper"), ("calls", "Point::make")} <= refs and ("calls", "println") not in refs
    nodes, refs = found("A.java", "import java.util.List;\npublic class App extends Base implements Runnable, Foo<Bar> {\n  private static final int MAX = 3;\n  public App(int x) { super(x); }\n  @Override\n  public void run() { helper.go(); new Thing(1); if (x) { call(); } }\n  enum Kind { A, B; }\n}\ninterface Foo<T> { void bar(int a); }\n", "java")
    assert nodes.keys() == {("file", "A.java"), ("import", "java.util.List"), ("class", "App"), ("field", "App::MAX"), ("method", "App::App"), ("method", "App::run"), ("enum", "App::Kind"), ("enum_member", "App::Kind::A"), ("enum_member", "App::Kind::B"), ("interface", "Foo"), ("method", "Foo::bar")}
    assert refs == {("extends", "Base"), ("implements", "Runnable"), ("implements", "Foo"), ("calls", "helper.go"), ("calls", "call"), ("instantiates", "Thing")} and nodes["method", "App::run"]["visibility"] == "public"


def test_extract_routes():
    nodes, refs = found("app.py", "from flask import Flask\n@app.route('/users', methods=['POST', 'GET'])  # comment\ndef users():\n    pass\n@bp.get('/x')\nasync def x():\n    pass\n", "python")
    assert {("route", "app.py::POST /users"), ("route", "app.py::GET /x")} <= nodes.keys() and {("references", "users"), ("references", "x")} <= refs
    nodes, refs = found("urls.py", "from django.urls import path, include\nurlpatterns = [path('a/', views.A.as_view()), path('api/', include('app.urls'))]\nrouter.register(r'items', ItemViewSet)\nrouter.register('no', Other)\n", "python")
    assert {("route", "urls.py::URL a/"), ("route", "urls.py::URL api/"), ("route", "urls.py::VIEWSET /items")} <= nodes.keys() and {("references", "A"), ("imports", "app.urls"), ("references", "ItemViewSet")} <= refs and ("references", "Other") not in refs


def test_valid_rows(spark):
    rows = [{"tag": "node", "id": "1", "kind": "class", "name": "A", "file_path": "p"}, {"tag": "node", "id": "2", "kind": "", "name": "B", "file_path": "p"}, {"tag": "node", "id": "3", "kind": "class", "name": "C", "file_path": None}]
    rows += [{"tag": "edge", "kind": "contains", "source": "1", "target": x} for x in "12"] + [{"tag": "ref", "kind": "calls", "name": "x", "source": x, "line": 1} for x in "13"]
    nodes, edges, refs = extraction.valid(spark.createDataFrame([[r.get(c) for c in extraction.FIELDS] for r in rows], extraction.ROWS))
    assert [r.id for r in nodes.collect()] == ["1"] and edges.count() == 1 and [r.from_node_id for r in refs.collect()] == ["1"]


def test_scan_and_changes(spark, tmp_path):
    for name, text in {"a.py": "x = 1\n", "sub/b.py": "y = 2\n", "node_modules/c.py": "z", "d.txt": "no", "big.py": "#" * 2000}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found = files.scan(spark, str(tmp_path), most=1000)
    (tmp_path / "latin.py").write_bytes(b"x = '\xe9'\n")
    found = files.scan(spark, str(tmp_path), most=1000)
    assert {(r.path, r.language, r.content is None, r.read_error) for r in found.collect()} == {("a.py", "python", False, None), ("sub/b.py", "python", False, None), ("latin.py", "python", True, "not UTF-8")}
    only = spark.createDataFrame([("a.py",)], "path string")
    found = files.scan(spark, str(tmp_path), most=1000, listed=only.unionByName(spark.createDataFrame([("sub/b.py",)], "path string")))
    known = spark.createDataFrame([("a.py", "old"), ("gone.py", "x")], "path string, content_hash string")
    assert {tuple(r) for r in files.changes(found, known).collect()} == {("a.py", "changed"), ("sub/b.py", "added"), ("gone.py", "removed")}


def test_store_and_stream(spark, tmp_path):
    root = str(tmp_path / "store")
    store = GraphStore.create(spark, root)
    with pytest.raises(FileExistsError):
        GraphStore.create(spark, root)
    with pytest.raises(FileNotFoundError):
        GraphStore.open(spark, str(tmp_path / "none"))
    delta = "path string, content string, removed boolean, seq int"
    apply_delta(store, spark.createDataFrame([("m.py", "old = 1", False, 0), ("m.py", PY, False, 1), ("n.py", "def f():\n    run()\n", False, 0)], delta))
    assert store.table("nodes").where("name = 'Admin'").count() == 1 and store.table("nodes").where("name = 'old'").count() == 0
    store.append("edges", spark.createDataFrame([("calls", "x", "y", 1, "mine:a"), ("calls", "x", "y", 1, None)], EDGE + ", provenance string"))
    assert store.delete_by_provenance("edges", "mine") == 1 and store.table("edges").where("source = 'x'").count() == 1
    spark.createDataFrame([("n.py", None, True, 2), ("k.py", "def g():\n    pass\n", False, 2)], delta).write.parquet(str(tmp_path / "in"))
    follow(store, spark.readStream.schema(delta).parquet(str(tmp_path / "in")), str(tmp_path / "ck")).awaitTermination()
    assert {r.path for r in GraphStore.open(spark, root).table("files").collect()} == {"m.py", "k.py"}
    assert store.table("refs").where("file_path = 'n.py'").count() == 0
    store.replace("files", spark.createDataFrame([("k.py", "h"), ("k.py", "h"), ("z.py", "i")], "path string, content_hash string"), "path")
    assert {(r.path, r.content_hash == "h") for r in store.table("files").collect()} == {("m.py", False), ("k.py", True), ("z.py", False)}


def test_project(spark, tmp_path):
    """Index, search, change and delete; edges into a changed file are linked anew, and a later definition is found by earlier calls."""
    import subprocess

    from symgraph.engine import CodeGraph
    from symgraph.sources.project import LocalFiles, Settings, git_files, is_supported, language_of

    root = tmp_path / "big-project"
    (root / "app").mkdir(parents=True)
    (root / "tests").mkdir()
    (root / "app" / "models.py").write_text("class User:\n    def greet(self):\n        return later()\n")
    (root / "app" / "main.py").write_text("from app.models import User\n\ndef run():\n    return User().greet()\n")
    (root / "tests" / "test_main.py").write_text("from app.main import run\n\ndef test_run():\n    run()\n")
    (root / "skip.log").write_text("no")
    assert git_files(str(root)) is None
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    (root / ".gitignore").write_text("app/secret.py\n")
    (root / "app" / "secret.py").write_text("x = 1\n")
    assert "app/secret.py" not in git_files(str(root)) and "app/main.py" in git_files(str(root))
    g = CodeGraph.create(spark, str(root), str(tmp_path / "store"))
    got = g.index_all()
    assert got["files"] == 3 and got["errors"] == 0
    name = {r.id: r.name for r in g.nodes.collect()}
    link = lambda: {(r.kind, name[r.source], name[r.target]) for r in g.edges.where("kind <> 'contains'").collect()}
    assert {("instantiates", "run", "User"), ("calls", "test_run", "run"), ("tests", "test_run", "run")} <= link()
    assert g.index_all()["files"] == 0  # nothing changed
    (root / "app" / "models.py").write_text("# moved\n\nclass User:\n    def greet(self):\n        return later()\n")
    (root / "app" / "more.py").write_text("def later():\n    pass\n")
    assert g.index_all()["files"] == 2
    name = {r.id: r.name for r in g.nodes.collect()}
    assert {("instantiates", "run", "User"), ("calls", "greet", "later"), ("tests", "test_run", "run")} <= link()
    edges = [(r.kind, r.source, r.target, r.line) for r in g.edges.collect()]
    assert len(edges) == len(set(edges)) and {x for e in edges for x in e[1:3]} <= name.keys()
    assert g.search("User", 3).orderBy("score", ascending=False).first().name == "User"
    run = next(i for i, n in name.items() if n == "run")
    assert {name[r.id] for r in g.testers(run).collect()} == {"test_run"} and name[run] == "run" and run in {r.id for r in g.callers(next(i for i, n in name.items() if n == "User")).collect()} | {run}
    g.delete_file("app/more.py")
    assert ("calls", "greet", "later") not in {(r.kind, name[r.source], name.get(r.target)) for r in g.edges.collect()} and g.store.unresolved().where("reference_name = 'later'").count() == 1
    assert CodeGraph.open(spark, str(root), str(tmp_path / "store")).nodes.count() == g.nodes.count()
    g.store.set_claims(spark.createDataFrame([("1", "note", "Users are greeted lazily"), ("2", "note", "nothing")], "id string, claim_type string, claim_text string"), spark.createDataFrame([("1", "app/main.py", "about", 1, 2)], "claim_id string, file_path string, relation string, start_line int, end_line int"))
    assert [(r.id, [x.file_path for x in r.groundings]) for r in g.claims("greeting").collect()] == [("1", ["app/main.py"])]
    files_ = LocalFiles(str(root))
    assert files_.read("../x") is None and files_.exists("app/main.py") and files_.name_tokens() == {"bigproject"} and is_supported("go") and not is_supported("c") and language_of("a/B.TSX") == "tsx"
    Settings(include=["**/*.py"]).save(str(root))
    assert Settings.load(str(root)).include == ["**/*.py"] and Settings.load(str(tmp_path)).include == Settings().include


def test_resolution(spark):
    nodes = spark.createDataFrame([("1", "function", "run", "run", "src/a/x.py", "python", 5, 9, True), ("2", "function", "run", "run", "lib/y.py", "python", 1, 2, True), ("3", "class", "Only", "Only", "lib/y.py", "python", 1, 2, True)], NODE)
    refs = spark.createDataFrame([(i, f"s{i}", n, "calls", "src/a/z.py", "python", 3) for i, n in enumerate(["run", "Only", "ONLY", "os.path", "print", "q", "nowhere"])], "ref_id int, from_node_id string, reference_name string, reference_kind string, file_path string, language string, line int")
    got = linking.resolved_edges(refs, linking.resolve(refs, nodes), nodes).collect()
    assert {(r.kind, r.source, r.target, r.provenance) for r in got} == {("calls", "s0", "1", "resolution:exact-match:0.70"), ("instantiates", "s1", "3", "resolution:exact-match:0.90")}  # no symbol is named ONLY, so the near name isn't looked for


def test_queries_match_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in (*projection.TABLES, "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(DATA, t)}.parquet'")
    for name in ("s_nodes", "s_edges", "g3_callers_deep", "g6_type_hierarchy", "g8_impact", "g16_import_cycles_short", "g17_metrics", "q11_search", "q15_name_bonus", "e12_within_budget", "r10_via_import", "t4_test_edges", "q5_bm25", "r14_resolved_edges", "r15_dispatch", "e11_clusters", "l21_range_join"):
        got, rel = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLE_SQL[name])
        assert sorted(got.columns) == sorted(rel.columns)
        at = [rel.columns.index(c) for c in got.columns]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall()), name


def test_resolution_of_all_lines(spark):
    import collections

    read = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet").collect()
    buyer, part = {r.o_orderkey: r.o_custkey for r in read("orders")}, {r.p_partkey: r.p_name.replace(" ", "_") for r in read("part")}
    nodes, best = {}, collections.defaultdict(list)
    for r in projection.nodes(spark, DATA).collect():
        nodes[r.id] = r
        if r.kind == "function":
            best[r.name].append((not r.is_exported, r.file_path, r.start_line, r.id))
    refs = {(f"method:c{buyer[r.l_orderkey]}", part[r.l_partkey]) for r in read("lineitem") if r.l_orderkey in buyer and r.l_partkey in part}
    want = {(s, min(best[name])[3], nodes[s].start_line, "resolution:exact-match:" + ("0.90" if len(best[name]) == 1 else "0.40")) for s, name in refs if s in nodes and name in best}
    got = [(r.source, r.target, r.line, r.provenance) for r in queries.QUERIES["r14_resolved_edges"](spark, DATA).collect()]
    assert len(got) == len(refs) and set(got) == want


def test_queries_of_nodes_make_no_edges(spark, monkeypatch):
    def none(*_):
        raise AssertionError("edges are made")

    monkeypatch.setattr(projection, "edges", none)
    assert queries.QUERIES["l14_substring"](spark, DATA + "/").count() > 0 and queries.QUERIES["q4_fts"](spark, DATA + "/").count() > 0
    with pytest.raises(AssertionError):
        queries.QUERIES["l9_callers"](spark, DATA + "/")


def test_edges_are_shuffled_as_numbers(spark):
    import re

    plan = projection.edges(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_partkey" in plan and not re.search(r"hashpartitioning\((o_custkey|l_suppkey)#\d+L?, l_partkey", plan)  # counted where they are sorted
    assert len(re.findall(r"hashpartitioning\(target", plan)) == 1 and {tuple(r) for r in projection.edges(spark, DATA).select("kind").distinct().collect()} == {("calls",), ("references",), ("imports",), ("contains",), ("extends",)}


def test_path_makes_no_edges_distinct(spark, monkeypatch):
    def none(*_):
        raise AssertionError("all edges are shuffled")

    monkeypatch.setattr(G, "steps", none)
    chain = spark.createDataFrame([("calls", f"n{i:02}", f"n{i + 1:02}", k) for i in range(5) for k in (1, 2)] + [("calls", "n00", "n0x", 1), ("calls", "n0x", "n02", 1)], EDGE)
    assert [r.id for r in G.path(chain, "n00", "n05", ("calls",)).orderBy("step").collect()] == ["n00", "n01", "n02", "n03", "n04", "n05"]


def _plans(monkeypatch, module):
    """The plans of what a module checkpoints from now on."""
    found, cut = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: (found.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    return found


def test_few_nodes_are_broadcast_to_the_edges(spark, monkeypatch, edges):
    plans = _plans(monkeypatch, G)
    assert {tuple(r) for r in G.call_graph(edges, "a").na.fill(-1).collect()} == {("a", 0, 0), ("c", 1, 2), ("e", 1, -1), ("b", 2, 1)}
    semi = [p for p in plans if "LeftSemi" in p]
    assert semi and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p.split("LeftSemi")[0].rsplit("\n", 1)[-1] for p in semi)


def test_flow_broadcasts_its_frontier(spark, monkeypatch, edges):
    plans = _plans(monkeypatch, ranking)
    assert [r.id for r in ranking.flow_chain(edges, spark.createDataFrame([("e",), ("b",), ("d",)], "id string")).orderBy("step").collect()] == ["e", "a", "b", "c", "d"]
    assert any("BroadcastHashJoin [last" in p for p in plans) and not any("SortMergeJoin [last" in p for p in plans)


def test_context_makes_no_edges_distinct(spark, monkeypatch, edges):
    from symgraph.operators import context

    def none(*_):
        raise AssertionError("all edges are shuffled")

    monkeypatch.setattr(G, "steps", none)
    plans = _plans(monkeypatch, context)
    nodes = spark.createDataFrame([(x, "function", x, x, "p.py", "python", 1, 2, False) for x in "abcd"], NODE)
    roots = spark.createDataFrame([("a",), ("d",)], "id string")
    assert {r.id for r in context._around(nodes, edges, roots, 1, 5, ("function",)).collect()} == {"a", "b", "c", "d"}
    assert any("BroadcastHashJoin [id" in p for p in plans) and not any("SortMergeJoin [id" in p and "[a#" in p for p in plans)


def test_context_nodes_without_distinct_edges(spark, monkeypatch, edges):
    from symgraph.operators import context

    monkeypatch.setattr(G, "steps", lambda *_: 1 / 0)
    nodes = spark.createDataFrame([(x, "function", f"name_{x}", x, "p.py", "python", 1, 2, False) for x in "abcd"], NODE)
    kept = context.relevant_context(nodes, edges, "what does name_a do", 1, 1, 20)[0].collect()
    assert {r.id for r in kept if r.root} == {"a"} and {"b", "c"} <= {r.id for r in kept}


def test_blast_radius_counts_once(spark):
    nodes = spark.createDataFrame([(i, "function", i, i, p, "python", 1, 2, False) for i, p in [("r", "a.py"), ("u", "a.py"), ("v", "b.py"), ("w", "b.py"), ("t", "tests/test_b.py"), ("s", "a.py")]], NODE)
    edges = spark.createDataFrame([("calls", "u", "r", 1), ("calls", "u", "r", 2), ("references", "u", "r", 3), ("calls", "v", "r", 1), ("calls", "w", "r", 1), ("calls", "t", "r", 1), ("calls", "t", "s", 1), ("contains", "v", "s", 1), ("calls", "gone", "s", 1)], EDGE)
    got = ranking.blast_radius(nodes, edges, nodes.where("id IN ('r', 's')"))
    assert {tuple(r) for r in got.collect()} == {("r", 4, 2, 1), ("s", 1, 0, 1)}
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()  # no row is multiplied to be counted


def test_points_of_a_line_are_one(spark):
    nodes = spark.createDataFrame([("file:a.py", "file", "a.py", "a.py", "a.py", "python", 1, 200, False), ("f", "function", "f", "f", "a.py", "python", 1, 9, False), ("g", "function", "g", "g", "a.py", "python", 100, 120, False)], NODE)
    edges = spark.createDataFrame([("calls", "f", f"x{k}", line) for k in range(50) for line in (5, 60)] + [("references", "f", "x1", 5), ("contains", "f", "x1", 150)], EDGE)
    got = ranking.clusters(nodes, 15, None, edges)
    assert sorted(tuple(r) for r in got.select("start_line", "end_line", "symbols", "importance", "best").collect()) == [(1, 9, 1, 100.0, 2.0), (60, 60, 0, 100.0, 2.0), (100, 120, 1, 0.0, 0.0)]
    import re

    assert re.search(r"keys=\[file_path#\d+, line#\d+\], functions=\[count\(1\)\]", got._jdf.queryExecution().executedPlan().toString())  # the windows have a row a line


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_depth_first(spark, edges):
    nodes = spark.createDataFrame([(x, "function", x, x, "p.py", "python", 1, 2, False) for x in "abcdef"], NODE)
    assert [(r.id, r.depth) for r in G.depth_first(nodes, edges, "f", "outgoing", (), 3).orderBy("step").collect()] == [("f", 0), ("a", 1), ("b", 2), ("c", 3), ("d", 1), ("e", 1)]
    got = {(r.id, r.depth, r.parent, r.kind) for r in G.traverse(nodes, edges, "f", "outgoing", (), (), 2, 4, False).collect()}
    assert got == {(x, 1, "f", "contains") for x in "abcd"}
    assert {r.id for r in G.traverse(nodes.where("id <> 'b'"), edges, "a", "outgoing", ("calls",)).collect()} == {"a"}  # what isn't there isn't entered


def test_context(spark, edges):
    nodes = spark.createDataFrame([(x, "file" if x == "f" else "function", x, x, "p.py", "python", 1, 2, False) for x in "abcdef"], NODE)
    got = {(r.role, r.kind, r.id) for r in G.context(nodes, edges.unionByName(spark.createDataFrame([("imports", "f", "e", None), ("returns", "a", "d", 1)], EDGE)), "a").collect()}
    assert got == {("focal", None, "a"), ("ancestor", None, "f"), ("incoming", "calls", "c"), ("incoming", "calls", "e"), ("outgoing", "calls", "b"), ("outgoing", "returns", "d"), ("type", None, "d"), ("import", None, "e")}
    with pytest.raises(ValueError):
        G.context(nodes, edges, "none")


SYMBOLS = [("1", "function", "load_user", "load_user", "Loads a user by name", "(name: str)"), ("2", "class", "UserStore", "store::UserStore", None, None), ("3", "method", "load", "UserStore::load", "load load LOAD", "(self)"), ("4", "method", "save", "UserStore::save", "", "user, user_name"), ("user-5", "function", "other", "x.y", None, None)]


@pytest.mark.parametrize("text", ["user", "load user", "load_user", "userstore OR load", "name", "nothing", "AND", "user_name"])
def test_fts_as_sqlite_ranks_it(spark, text):
    import sqlite3

    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(id, name, qualified_name, docstring, signature)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?)".replace("?, ", "", 1), [(i, n, q, d, s) for i, _, n, q, d, s in SYMBOLS])
    match = " OR ".join(f'"{w}"*' for w in text.split() if w not in ("AND", "OR"))
    want = {i: -s for i, s in con.execute("SELECT id, bm25(t, 0, 20, 5, 1, 2) FROM t WHERE t MATCH ?", (match,))} if match else {}
    nodes = spark.createDataFrame([(i, k, n, q, d, s, "p.py", "python") for i, k, n, q, d, s in SYMBOLS], "id string, kind string, name string, qualified_name string, docstring string, signature string, file_path string, language string")
    got = {r.id: r.score for r in search.search_fts(nodes, text).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_claims_as_sqlite_stems_them(spark):
    import sqlite3

    texts = ["the decompression of archives is lazy", "Archived files are decompressed", "relational tables generalize hopping ponies", "nothing here", "conflated agreed plastered motoring sized falling hissing fizzed happy sky"]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(claim_text, tokenize='porter')")
    con.executemany("INSERT INTO t VALUES (?)", [(t,) for t in texts])
    claims = spark.createDataFrame([(str(i + 1), "a" if i % 2 else "b", t) for i, t in enumerate(texts)], "id string, claim_type string, claim_text string")
    for asked in ("decompress", "archiving", "relate table", "hop pony", "generalization", "conflate", "agree", "motor", "sizing", "skies happiness"):
        match = " OR ".join(f'"{w}"*' for w in asked.split())
        want = {str(i): -s for i, s in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}
        got = {r.id: r.score for r in search.search_claims(claims, asked).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want), asked
    assert {r.claim_type for r in search.search_claims(claims, "archive", "a").collect()} == {"a"}


def test_claims_stem_only_what_may_be_asked(spark):
    import random
    import re

    from symgraph.functions import stemming

    rnd, ends = random.Random(3), ("", "s", "es", "ies", "ed", "ing", "y", "ational", "tional", "enci", "ency", "anci", "izer", "abli", "ably", "alli", "entli", "ousli", "ization", "ation", "ator", "alism", "iveness", "fulness", "ousness", "aliti", "ality", "iviti", "ivity", "biliti", "bility", "logi", "icate", "ative", "alize", "iciti", "ical", "ful", "ness", "able", "ible", "ement", "ion", "ate", "e", "ll", "eed")
    words = {"".join(rnd.choice("abeilnostrxyz") for _ in range(rnd.randrange(1, 7))) + rnd.choice(ends) + rnd.choice(ends) for _ in range(60_000)}
    for w in words:
        s = stemming.porter(w)
        assert s and w.startswith(s[: max(0, len(s) - stemming.CHANGED)]), w
    texts = [" ".join(rnd.choice(("licensed", "license", "Licensing_terms", "version", "versions", "conversion", "adverse", "open-sourced", "sources")) for _ in range(12)) for _ in range(30)] + [None, ""]
    claims = spark.createDataFrame([(str(i), "a", t) for i, t in enumerate(texts)], "id string, claim_type string, claim_text string")
    stems = [[stemming.porter(w) for w in re.findall(r"[^\W_]+", (t or "").lower())] for t in texts]
    asked = [["licens"], ["open", "sourc"], ["version"]]
    got = [tuple(r.c) for r in claims.select(stemming.stem_counts("claim_text", asked).alias("c")).collect()]
    want = [(len(s), *(sum(s[i : i + len(p) - 1] == p[:-1] and s[i + len(p) - 1].startswith(p[-1]) for i in range(len(s) - len(p) + 1)) for p in asked)) for s in stems]
    assert got == want


def test_search_falls_back(spark):
    nodes = spark.createDataFrame([(i, k, n, q, f"src/{n}.py", "python", d, s) for i, k, n, q, d, s in SYMBOLS], "id string, kind string, name string, qualified_name string, file_path string, language string, docstring string, signature string")
    first = lambda q: [r.name for r in search.search(nodes, q, 3).orderBy(F.desc("score"), "id").collect()]
    from pyspark.sql import functions as F

    assert first("load")[0] == "load"
    assert first("serstor") == ["UserStore", "load", "save"]  # within names, its own first
    assert first("UserStroe") == ["UserStore"]  # a near name
    assert first("kind:method name:sav") == ["save"] and first("path:none load") == []


def test_terms():
    from symgraph.functions import terms as T

    assert T.search_terms("how does the UserService handle sign_in requests?", False) == {"userservice", "user", "service", "handle", "sign_in", "sign", "requests"}
    assert {"handl", "cach"} <= T.stems("handling") | T.stems("caching") and T.stems("running") == {"runn", "runne", "run"} and T.stems("queries") == {"query"} and T.stems("go") == set()
    found = T.query_symbols("how does QuerySet._fetch_all call __init__ with MAX_RETRIES over HTTP")
    assert {"QuerySet._fetch_all", "QuerySet", "_fetch_all", "__init__", "MAX_RETRIES", "HTTP"} <= set(found) and "how" not in found and found == sorted(found, key=lambda x: (-len(x), x))
    manifests = {"pyproject.toml": '[project]\nname = "Big-Engine"', "package.json": '{"name": "@scope/web-client"}', "go.mod": "module example.com/x/gateway\n"}
    assert T.project_tokens("my-repo", manifests.get) == {"bigengine", "webclient", "gateway", "myrepo"}
    assert T.project_tokens("abc", {"package.json": "[", "pyproject.toml": "x ="}.get) == set()


REFS = "ref_id int, from_node_id string, reference_name string, reference_kind string, file_path string, language string, line int"


def test_resolution_strategies(spark):
    from symgraph.sources.imports import extract_imports

    def node(i, kind, name, qualified, path, line=1, language="python", exported=False):
        return (i, kind, name, qualified, path, language, line, line + 5, exported)

    nodes = spark.createDataFrame(
        [
            node("f1", "file", "models.py", "app/models.py", "app/models.py"), node("f2", "file", "utils.py", "app/utils.py", "app/utils.py"), node("f3", "file", "main.py", "app/main.py", "app/main.py"), node("f4", "file", "service.ts", "src/service.ts", "src/service.ts", language="typescript"),
            node("u", "class", "User", "User", "app/models.py"), node("g", "method", "greet", "User::greet", "app/models.py", 3), node("a", "class", "Admin", "Admin", "app/models.py", 20), node("ag", "method", "greet", "Admin::greet", "app/models.py", 22),
            node("h", "function", "helper", "helper", "app/utils.py"), node("h2", "function", "helper", "helper", "lib/other.py"), node("i", "import", "app.models", "app.models", "app/main.py"), node("only", "method", "vanish", "Ghost::vanish", "app/x.py"),
            node("svc", "class", "Service", "Service", "src/service.ts", language="typescript", exported=True), node("hid", "function", "hidden", "hidden", "src/service.ts", 9, "typescript"),
        ],
        NODE,
    )
    main = "from app.models import User, Admin as Boss\nimport app.utils as tools\nfrom app import utils\n"
    imports = extract_imports(spark.createDataFrame([("app/main.py", main, "python"), ("src/index.ts", "import { Service as Svc, hidden } from './service'\nimport * as all from '@/service'\n", "typescript")], "path string, content string, language string"))
    asked = [
        ("app.models", "imports", "i", "import-node", 0.95), ("User", "calls", "u", "import", 0.9), ("Boss", "calls", "a", "import", 0.9), ("tools.helper", "calls", "h", "import", 0.9), ("utils.helper", "calls", "h", "import", 0.85),
        ("app/utils.py", "references", "f2", "file-path", 0.95), ("other/models.py", "references", "f1", "file-path", 0.7), ("User::greet", "calls", "g", "qualified-name", 0.95), ("Admin.greet", "calls", "ag", "qualified-name", 0.85), ("admin.greet", "calls", "ag", "instance-method", 0.8),
        ("thing.vanish", "calls", "only", "instance-method", 0.7), ("the_user_greet.greet", "calls", "g", "instance-method", 0.65), ("json.loads", "calls", None, None, None), ("print", "calls", None, None, None), ("nowhere", "calls", None, None, None),
    ]
    refs = [(k, "x", n, kind, "app/main.py", "python", 1) for k, (n, kind, *_) in enumerate(asked)]
    script = [("Svc", "svc", 0.9), ("all.Service", "svc", 0.9), ("hidden", "hid", 0.9)]  # what isn't exported is found by its name only
    refs += [(100 + k, "y", n, "calls", "src/index.ts", "typescript", 1) for k, (n, *_) in enumerate(script)]
    got = {r.ref_id: (r.target, r.method, r.confidence) for r in linking.resolve(spark.createDataFrame(refs, REFS), nodes, imports).collect()}
    for k, (name, _, *want) in enumerate(asked):
        assert got.get(k, (None,) * 3) == tuple(want), name
    assert [got[100 + k][0] for k in range(3)] == ["svc", "svc", "hid"] and got[100][1] == "import" and got[102][1] == "exact-match"
    stats = {r.method: r.n for r in linking.resolution_stats(spark.createDataFrame(refs, REFS), linking.resolve(spark.createDataFrame(refs, REFS), nodes, imports)).collect()}
    assert stats["unresolved"] == 3 and sum(stats.values()) == len(refs)


def _crowded(spark, name, qualified, many=20_000):
    """So many functions of one name in one file."""
    return spark.range(many).selectExpr("concat('t', id) AS id", "'function' AS kind", f"'{name}' AS name", f"'{qualified}' AS qualified_name", "'lib/m.py' AS file_path", "'python' AS language", "CAST(10 + id AS INT) AS start_line", "CAST(11 + id AS INT) AS end_line", "true AS is_exported")


def _asking(spark, name, many=20_000):
    return spark.range(many).selectExpr("CAST(id AS INT) AS ref_id", "concat('s', id) AS from_node_id", f"'{name}' AS reference_name", "'calls' AS reference_kind", "'app/main.py' AS file_path", "'python' AS language", "CAST(id AS INT) AS line")


def _answered_soon(found, want, many=20_000):
    """20,000 references of a name that 20,000 symbols have: 400 million pairs, if each met all."""
    import time

    began = time.time()
    assert {tuple(r): n for *r, n in found.groupBy("target", "method", "confidence").count().collect()} == {want: many}
    assert time.time() - began < 20


def test_import_of_a_crowded_name(spark):
    from symgraph.sources.imports import extract_imports

    imports = extract_imports(spark.createDataFrame([("app/main.py", "from lib.m import f\n", "python")], "path string, content string, language string"))
    _answered_soon(linking.by_import(_asking(spark, "f"), _crowded(spark, "f", "f"), imports), ("t0", "import", 0.9))


def test_module_of_a_crowded_name(spark):
    from symgraph.sources.imports import extract_imports

    imports = extract_imports(spark.createDataFrame([("app/main.py", "import lib.m\n", "python")], "path string, content string, language string"))
    _answered_soon(linking.by_module(_asking(spark, "m.f"), _crowded(spark, "f", "f"), imports), ("t0", "import", 0.85))


def test_qualified_name_of_many(spark):
    _answered_soon(linking.by_qualified_name(_asking(spark, "A::f"), _crowded(spark, "f", "A::f")), ("t0", "qualified-name", 0.85))
    nodes = spark.createDataFrame([(str(i), "method", n, q, f"p{i}.py", "python", 1, 2, False) for i, (n, q) in enumerate([("f", "ab.c::f"), ("f", "b.c::f"), ("g", "b.c::f"), ("f", "f"), ("h", "xA::h"), ("h", "A::h"), ("h", "A::h")])], NODE)
    asked = ["b.c::f", "c::f", "ab.c::f", "A::h", "::f", "no::f"]
    refs = spark.createDataFrame([(i, "x", n, "calls", "q.py", "python", 1) for i, n in enumerate(asked)], REFS)
    got = {asked[r.ref_id]: (r.target, r.confidence) for r in linking.by_qualified_name(refs, nodes).collect()}
    assert got == {"b.c::f": ("0", 0.85), "c::f": ("0", 0.85), "ab.c::f": ("0", 0.95), "A::h": ("4", 0.85), "::f": ("0", 0.85)}


def test_statistics_of_a_crowded_name(spark):
    refs = _asking(spark, "run").unionByName(_asking(spark, "nowhere", 5))
    assert [tuple(r) for r in linking.resolved_stats(refs, _crowded(spark, "run", "run")).orderBy("method").collect()] == [("exact-match", 20_000), ("unresolved", 5)]
    plan = linking.resolve(refs, _crowded(spark, "run", "run"))._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # no task gets all references of a name


def test_edges_of_a_crowded_name(spark):
    e = linking.edges_of(_asking(spark, "run"), _crowded(spark, "run", "run"))
    assert {tuple(r) for r in e.select("kind", "target", "provenance").distinct().collect()} == {("calls", "t0", "resolution:exact-match:0.40")} and e.select("source", "line").distinct().count() == 20_000
    plan = e._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_import_files():
    from symgraph.sources import imports as I

    assert I.import_files("./m", "src/a/b.ts", "typescript")[:2] == [("src/a/m.ts", False), ("src/a/m.tsx", False)] and I.import_files("react", "a.ts", "typescript") == []
    assert I.import_files("@/x", "a.js", "javascript")[0] == ("src/x.js", False) and I.import_files("os.path", "a.py", "python") == [] and I.import_files("fmt", "a.go", "go") == []
    assert ("a/b.py", False) in I.import_files("a.b", "x.py", "python") and ("a/b/__init__.py", True) in I.import_files("a.b", "x.py", "python")
    assert I.mappings("import (\n f \"a/internal/b\"\n)", "go") == [("f", "*", "a/internal/b", False, True)] and I.mappings("x", "cobol") == []


def test_report(spark, tmp_path):
    """A report on a small project, and its parts on rows made for them."""
    from pyspark.sql import Row

    from symgraph import report
    from symgraph.engine import CodeGraph

    root = tmp_path / "shop"
    (root / "tests").mkdir(parents=True)
    (root / "store.py").write_text("class OrderStore:\n    def load_order(self):\n        return parse_order()\n\n\ndef parse_order():\n    return check_order()\n\n\ndef check_order():\n    return 1\n")
    (root / "main.py").write_text("from store import parse_order\n\ndef run():\n    parse_order()\n")
    big = "\n\n".join(f"def helper_{i}():\n" + "    x = 1\n" * 12 + "    return check_order()" for i in range(30))
    (root / "big.py").write_text("from store import check_order\n\n" + big + "\n")
    (root / "tests" / "test_store.py").write_text("from store import check_order\n\ndef test_check():\n    check_order()\n")
    g = CodeGraph.create(spark, str(root), str(tmp_path / "s"))
    g.index_all()
    text = g.explore("how do load_order and parse_order get to check_order and helper_3")
    assert "## Flow" in text and "1. load_order (store.py" in text and "#### store.py" in text and "7\t    return check_order()" in text and "### Blast radius" in text and "`tests/test_store.py`" in text
    assert "#### big.py" in text and "helper_3" in text and len(text) < 19_500
    left = {}
    short = report.fitted(text, 900, left, lambda path: [])
    assert len(short) <= 1100 and short.startswith("## Exploration") and left
    kept, among = (x.collect() for x in g.relevant_context("OrderStore"))
    assert any(n.name == "OrderStore" and n.root for n in kept) and "OrderStore" in report.context_markdown("q", kept, among) and report.context_tree(kept, among).startswith("OrderStore (class)") and '"roots"' in report.context_json(kept, among)
    kind = lambda i, k, lo, hi: Row(id=str(i), kind=k, name=f"n{i}", start_line=lo, end_line=hi)
    lines = [f"def n{i // 10}(): line {i}" for i in range(300)]
    many = [kind(i, "function", 10 * i + 1, 10 * i + 10) for i in range(30)]
    assert report.needs_skeleton(many, set(), set(), set(), lines, 100) and not report.needs_skeleton(many, set(), {"1"}, set(), lines, 10_000) and report.needs_skeleton(many, set(), {"1", "2"}, set(), lines, 100)
    assert report.needs_skeleton(many, {"1"}, {"2"}, set(), lines, 100) and not report.needs_skeleton(many, {"1", "2"}, set(), set(), lines, 100)
    source, tag = report.skeleton(many, lines, {"2"}, {"1"}, set(), 300)
    assert tag == "focused" and "21\tdef n2(): line 20" in source and "30\tdef n2(): line 29" in source and "11\tdef n1(): line 10" in source and "20\tdef n1(): line 19" not in source and "+5 more signatures" in source.replace("+4", "+5")
    assert report.skeleton(many, lines, set(), set(), set(), 300)[1] == "skeleton" and report.numbered(["a", "", ""]) == "1\ta"
    assert report.numbered([str(i) for i in range(40)], [Row(start_line=5, end_line=6), Row(start_line=30, end_line=30)]).split("\n")[7:9] == ["9\t8", "... (gap) ..."]
    assert report.size_text(10) == "10 B" and report.size_text(2048) == "2.0 KB" and ranking.call_budget(600) == 2 and ranking.output_budget(100)["files"] == 4 and ranking.output_budget(10**6)["gap"] == 15
