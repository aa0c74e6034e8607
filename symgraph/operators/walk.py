"""Random walks over a graph whose nodes are numbered by blocks: what a round needs of a block travels as one packed vector, and the edges stay where they are."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.plans.lineage import cut

#: Nodes, and edges (each counted both ways), of a block at most; blocks of a graph that one doesn't hold, at least; edges of a packed cell.
NODES, EDGES, LEAST, CELL = 1 << 22, 1 << 27, 8, 1 << 22
#: A graph of no more nodes and edges is one block, whose rounds are all one task's.
ALONE_NODES, ALONE_EDGES = 1 << 20, 1 << 22

_CELLS = "k int, s int, rows binary, starts binary, src binary"
_STATE = "k int, s int, y binary, loose double, deg binary, at binary, restart binary"


def _keys(spark: SparkSession, blocks: int) -> list[int]:
    """For each of so many partitions a number that Spark's hash sends there."""
    found = spark.range(64 * blocks + 64).select(F.col("id").cast("int").alias("k")).select("k", F.pmod(F.hash("k"), F.lit(blocks)).alias("p")).groupBy("p").agg(F.min("k").alias("k")).collect()
    keys = {r["p"]: r["k"] for r in found}
    return [keys[p] for p in range(blocks)]


def _numbered(ids: DataFrame, start: DataFrame, keys: list[int]) -> tuple[DataFrame, int]:
    """(b, k, hashes, at, restart): the sorted hashes of each block's ids, whose order numbers them, and where in it walks begin; and the salt with which no two ids have the same hash."""
    blocks = len(keys)

    def pack(table: pa.Table) -> pa.Table:
        h = table["h"].to_numpy()
        order = np.argsort(h)
        h, restart = h[order], table["restart"].to_numpy()[order]
        b, at = int(table["b"][0].as_py()), np.flatnonzero(restart).astype(np.int32)
        row = {"b": [b], "k": [keys[b]], "hashes": [h.tobytes()], "at": [at.tobytes()], "restart": [restart[at].tobytes()], "twice": [bool((h[1:] == h[:-1]).any())]}
        return pa.table(row, schema=pa.schema([("b", pa.int32()), ("k", pa.int32()), ("hashes", pa.binary()), ("at", pa.binary()), ("restart", pa.binary()), ("twice", pa.bool_())]))

    based = ids.join(start, "id", "left").select("id", F.coalesce("restart", F.lit(0.0)).alias("restart"))
    for salt in range(64):
        hashed = based.select(F.xxhash64(F.lit(salt), "id").alias("h"), "restart").withColumn("b", F.pmod("h", F.lit(blocks)).cast("int"))
        out = cut(hashed.groupBy("b").applyInArrow(pack, "b int, k int, hashes binary, at binary, restart binary, twice boolean"))
        if out.where("twice").isEmpty():
            return out.drop("twice"), salt
    raise RuntimeError("ids that no salt tells apart")


def _csr(dst: np.ndarray, src: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Edges by their target: the targets, where the sources of each begin, the sources."""
    order = np.argsort(dst, kind="stable")
    dst = dst[order]
    starts = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]]) if len(dst) else np.zeros(0, np.int64)
    return dst[starts].astype(np.int32).tobytes(), starts.astype(np.int32).tobytes(), src[order].astype(np.int32).tobytes()


def _find(nodes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(nodes, h)
    at[at == len(nodes)] = 0
    return at, nodes[at] == h if len(nodes) else np.zeros(len(h), bool)


def _cells(edges: DataFrame, numbered: DataFrame, salt: int, keys: list[int], count: int) -> DataFrame:
    """Rows (see _CELLS) of edges (source, target), taken both ways: k stands for the targets' block, s is the sources' block. Edges to what isn't numbered are left out."""
    blocks, spark = len(keys), edges.sparkSession
    parts = max(1, -(-count // (CELL * blocks * (blocks + 1) // 2)))
    h = edges.select(F.xxhash64(F.lit(salt), "source").alias("x"), F.xxhash64(F.lit(salt), "target").alias("y"))
    h = h.withColumn("i", F.pmod("x", F.lit(blocks)).cast("int")).withColumn("j", F.pmod("y", F.lit(blocks)).cast("int"))
    low = F.col("i") <= F.col("j")
    h = h.select(F.when(low, F.col("x")).otherwise(F.col("y")).alias("x"), F.when(low, F.col("y")).otherwise(F.col("x")).alias("y"), F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    part = F.pmod(F.xxhash64("x", "y"), F.lit(parts))
    h = h.select("x", "y", ((F.col("i") * blocks + F.col("j")) * parts + part).cast("int").alias("cell"))
    routes = [(b, ((min(b, o) * blocks + max(b, o)) * parts + p), side) for b in range(blocks) for o in range(blocks) for p in range(parts) for side in (0, 1) if (side == 0) == (b <= o) or b == o]
    to = numbered.join(F.broadcast(spark.createDataFrame(routes, "b int, cell int, side int")), "b").select("cell", "side", "hashes")  # two rows a cell
    types = pa.schema([("k", pa.int32()), ("s", pa.int32()), ("rows", pa.binary()), ("starts", pa.binary()), ("src", pa.binary())])

    def pack(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        i, j = divmod(int(key[0].as_py()) // parts, blocks)
        nodes = {s: np.frombuffer(b, np.int64) for s, b in zip(right["side"].to_pylist(), right["hashes"].to_pylist(), strict=True)}
        none = np.zeros(0, np.int64)
        (x, there), (y, too) = _find(nodes.get(0, none), left["x"].to_numpy()), _find(nodes.get(1, none), left["y"].to_numpy())
        x, y = x[there & too], y[there & too]
        out = [(j, i, np.r_[y, x], np.r_[x, y])] if i == j else [(j, i, y, x), (i, j, x, y)]
        rows = [(keys[t], s, *_csr(dst, src)) for t, s, dst, src in out if len(dst)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], f.type) for f in types], schema=types)

    packed = h.groupBy("cell").cogroup(to.groupBy("cell")).applyInArrow(pack, _CELLS)
    return cut(packed.repartition(blocks, "k").sortWithinPartitions("k"))


def _moved(cells: list[tuple], y: dict[int, np.ndarray], n: int) -> np.ndarray:
    out = np.zeros(n)
    for s, rows, starts, src in cells:
        if len(src):
            out[rows] += np.add.reduceat(y[s][src], starts)
    return out


def _unpacked(table: pa.Table) -> list[tuple]:
    """Cells, without copying them."""
    return [(s.as_py(), *(np.frombuffer(b.as_buffer(), np.int32) for b in x)) for s, *x in zip(*(table[c] for c in ("s", "rows", "starts", "src")), strict=True)]


def _steps(keys: list[int], alpha: float, n: int, rounds: int) -> tuple[Callable, Callable]:
    """What makes a first state of (cells, numbered), and what takes a state so many rounds further, the last of which gives scores."""
    blocks, types = len(keys), pa.schema([("k", pa.int32()), ("s", pa.int32()), ("y", pa.binary()), ("loose", pa.float64()), ("deg", pa.binary()), ("at", pa.binary()), ("restart", pa.binary())])

    def sent(b: int, x: np.ndarray, deg: np.ndarray, at: bytes, restart: bytes) -> pa.Table:
        """A block's scores, each divided by its node's edges, to all blocks; what it must know itself only to itself."""
        y, loose = (x / np.maximum(deg, 1) * (deg > 0)).tobytes(), float(x[deg == 0].sum())
        rows = [(keys[t], b, y, loose, *((deg.tobytes(), at, restart) if t == b else (None,) * 3)) for t in range(blocks)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), types, strict=True)], schema=types)

    def first(cells: pa.Table, numbered: pa.Table) -> pa.Table:
        r = numbered.to_pylist()[0]
        size = len(r["hashes"]) // 8
        x, deg = np.zeros(size), np.zeros(size, np.int32)
        x[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["restart"])
        for _, rows, starts, src in _unpacked(cells):
            deg[rows] += np.diff(np.r_[starts, len(src)]).astype(np.int32)
        return sent(r["b"], x, deg, r["at"], r["restart"])

    def on(times: int, last: bool) -> Callable:
        def step(cells: pa.Table, state: pa.Table) -> pa.Table:
            rows, packed = state.to_pylist(), _unpacked(cells)
            me = next(r for r in rows if r["deg"] is not None)
            deg, loose = np.frombuffer(me["deg"], np.int32), sum(r["loose"] for r in sorted(rows, key=lambda r: r["s"]))
            y = {r["s"]: np.frombuffer(r["y"]) for r in rows}
            at, restart = np.frombuffer(me["at"], np.int32), np.frombuffer(me["restart"])
            for k in range(times):
                if k:
                    y, loose = {me["s"]: x / np.maximum(deg, 1) * (deg > 0)}, float(x[deg == 0].sum())
                x = (1 - alpha) * (_moved(packed, y, len(deg)) + loose / n)
                x[at] += alpha * restart
            if not last:
                return sent(me["s"], x, deg, me["at"], me["restart"])
            return pa.table([pa.array([v], f.type) for v, f in zip((me["k"], me["s"], x.tobytes(), 0.0, None, None, None), types, strict=True)], schema=types)

        return step

    return first, on


def walked(ids: DataFrame, edges: DataFrame, start: DataFrame, n: int, alpha: float, rounds: int) -> DataFrame:
    """(id, score) of ids (id, distinct; n of them) after so many rounds over edges (source, target) taken both ways; start: (id, restart).

    Ids are hashed to 64 bits (a salt is taken with which no two meet) and numbered by block. Edges are packed once, by target, 4 bytes each way, and
    checkpointed where their target's block is; a round sends every block's vector to each block, 8 bytes a node, and holds a block at a time.
    """
    count = edges.count()
    alone = n <= ALONE_NODES and count <= ALONE_EDGES
    keys = _keys(ids.sparkSession, 1 if alone else max(LEAST, -(-n // NODES), -(-2 * count // EDGES)))
    numbered, salt = _numbered(ids, start, keys)
    cells = _cells(edges, numbered, salt, keys, count)
    first, on = _steps(keys, alpha, n, rounds)
    to = lambda df: df.repartition(len(keys), "k")
    state = cells.groupBy("k").cogroup(to(numbered).groupBy("k")).applyInArrow(first, _STATE)
    for i in range(1 if alone else rounds):
        state = cells.groupBy("k").cogroup(to(state).groupBy("k")).applyInArrow(on(rounds, True) if alone else on(1, i == rounds - 1), _STATE)

    def unpack(batches):
        for batch in batches:
            for hashes, y in zip(batch["hashes"].to_pylist(), batch["y"].to_pylist(), strict=True):
                h, score = np.frombuffer(hashes, np.int64), np.frombuffer(y)
                for k in range(0, len(h), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(h[k : k + (1 << 16)]), pa.array(score[k : k + (1 << 16)])], names=["h", "score"])

    scores = numbered.join(state.select(F.col("s").alias("b"), "y"), "b").select("hashes", "y").mapInArrow(unpack, "h bigint, score double")
    return ids.select("id", F.xxhash64(F.lit(salt), "id").alias("h")).join(scores, "h").select("id", "score")
