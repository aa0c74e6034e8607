"""Exact k nearest neighbours of a set of queries among all vectors, by KD-trees per shard.

A small tree over a bounded sample of the vectors divides space; every vector goes to a leaf of it, and a leaf with many vectors (copies of one, say)
is dealt to several shards. A shard's own tree splits at the median of the widest dimension until a leaf has at most ``LEAF``
vectors, and each node has the tight box of its vectors. Queries come in blocks of near ones. A block's search goes best first: nodes wait in a heap by the
least distance between their box and the queries' box, and a leaf's vectors are compared with those queries whose own distance to its
box doesn't exceed their kth distance so far. Each query is first searched in a shard of its own leaf; with the kth distance from there
it goes on to the shards of just those leaves whose boxes are no farther away. Vectors never travel to queries, each shard's tree is
built once a round, and of the index only the top leaves' boxes, bounded by the sample, are broadcast. Distances of all that may be
among the k are worked out from differences in double precision; ties go to the lower id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgraph.llm import kernels as K
from symgraph.llm.tables import shared_table, small_batches

NEIGHBOURS, LEAF, SHARD_ROWS, QUERIES = 10, 128, 8192, 256
#: Vectors in the sample that the top tree is made of, and how many of them a leaf of it has at least: so it has at most 512 leaves.
SAMPLE, SAMPLE_LEAF = 16_384, 32


class Tree:
    """A KD-tree with tight boxes; leaves are runs of the reordered rows."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        n = len(x)
        self.order, self.nodes, self.low, self.high = np.arange(n), [], [], []
        waiting = [(0, n, -1, 0)]
        while waiting:
            lo, hi, parent, side = waiting.pop()
            rows = self.order[lo:hi]
            low, high = x[rows].min(0), x[rows].max(0)
            me = len(self.nodes)
            self.nodes.append([lo, hi, -1, -1])
            self.low.append(low)
            self.high.append(high)
            if parent >= 0:
                self.nodes[parent][2 + side] = me
            widest = int(np.argmax(high - low))
            if hi - lo > leaf and high[widest] > low[widest]:
                mid = (hi - lo) // 2
                self.order[lo:hi] = rows[np.argpartition(x[rows, widest], mid)]
                waiting += [(lo, lo + mid, me, 0), (lo + mid, hi, me, 1)]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def leaves(self) -> list[tuple[int, int]]:
        return [(lo, hi) for lo, hi, left, _ in self.nodes if left < 0]


class Nearest:
    """The k nearest so far of a block of queries. limit: kth distances (squared) known from elsewhere."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int, limit: np.ndarray):
        self.q, self.ids, self.k, self.limit = queries, ids, k, limit
        self.low, self.high = queries.min(0), queries.max(0)
        self.square = np.einsum("ij,ij->i", queries, queries)
        self.d = np.full((len(queries), k), np.inf)
        self.near = np.full((len(queries), k), np.iinfo(np.int64).max)

    def kth(self) -> np.ndarray:
        return np.minimum(self.d[:, -1], self.limit)

    def offer(self, tree: Tree, x: np.ndarray, square: np.ndarray, ids: np.ndarray) -> None:
        def gap(node: int) -> float:
            away = np.maximum(0, np.maximum(tree.low[node] - self.high, self.low - tree.high[node]))
            return float(away @ away)

        heap = [(gap(0), 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if bound > self.kth().max() + 1e-9:
                return
            lo, hi, left, right = tree.nodes[node]
            if left >= 0:
                heapq.heappush(heap, (gap(left), left))
                heapq.heappush(heap, (gap(right), right))
                continue
            away = np.maximum(0, np.maximum(tree.low[node] - self.q, self.q - tree.high[node]))
            open_ = np.flatnonzero(np.einsum("ij,ij->i", away, away) <= self.kth() + 1e-9)
            if len(open_):
                self._take(open_, x[lo:hi], square[lo:hi], ids[lo:hi])

    def _take(self, rows: np.ndarray, x: np.ndarray, square: np.ndarray, ids: np.ndarray) -> None:
        about = self.square[rows, None] + square - 2 * (self.q[rows] @ x.T)
        slack = 1e-9 * (1 + self.square[rows, None] + square)
        about[self.ids[rows, None] == ids] = np.inf  # a vector isn't its own neighbour
        kth = self.kth()[rows]
        if len(ids) > self.k:
            kth = np.minimum(kth, np.partition(about, self.k - 1, axis=1)[:, self.k - 1])
        r, c = np.nonzero((about <= kth[:, None] + 2 * slack) & np.isfinite(about))
        if not len(r):
            return
        d = ((self.q[rows[r]] - x[c]) ** 2).sum(1)
        o_r, o_c = np.nonzero(np.isfinite(self.d[rows]))
        r, near, d = np.append(o_r, r), np.append(self.near[rows][o_r, o_c], ids[c]), np.append(self.d[rows][o_r, o_c], d)
        order = np.lexsort((near, d, r))
        r, near, d = r[order], near[order], d[order]
        at = np.arange(len(r)) - np.searchsorted(r, r)
        keep = at < self.k
        new_d, new_near = np.full((len(rows), self.k), np.inf), np.full((len(rows), self.k), np.iinfo(np.int64).max)
        new_d[r[keep], at[keep]], new_near[r[keep], at[keep]] = d[keep], near[keep]
        self.d[rows], self.near[rows] = new_d, new_near


class Top:
    """The tree over the sample: median splits of the widest dimension; it tells each vector its leaf."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.nodes: list[tuple] = []
        self.leaves = 0
        self._split(x, max(leaf, 1))

    def _split(self, x: np.ndarray, leaf: int) -> int:
        me = len(self.nodes)
        self.nodes.append(())
        widest = int(np.argmax(x.max(0) - x.min(0)))
        middle = float(np.median(x[:, widest]))
        left = x[:, widest] < middle
        if len(x) <= leaf or not left.any():
            self.nodes[me] = (self.leaves,)
            self.leaves += 1
        else:
            self.nodes[me] = (widest, middle, self._split(x[left], leaf), self._split(x[~left], leaf))
        return me

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out, waiting = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while waiting:
            node, rows = waiting.pop()
            if len(self.nodes[node]) == 1:
                out[rows] = self.nodes[node][0]
            else:
                widest, middle, left, right = self.nodes[node]
                less = x[rows, widest] < middle
                waiting += [(left, rows[less]), (right, rows[~less])]
        return out


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dims)


def _route(batches: Iterator[pa.RecordBatch], tops: dict[int, Top]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lengths = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
        leaf = np.zeros(len(lengths), np.int64)
        for m in np.unique(lengths):
            rows = np.flatnonzero(lengths == m)
            if int(m) in tops:
                leaf[rows] = tops[int(m)].leaf_of(_matrix(b.column(1).take(pa.array(rows)), int(m)))
        yield pa.RecordBatch.from_arrays([pa.array(lengths.astype(np.int64)), pa.array(leaf), b.column(0), b.column(1)], names=["dims", "leaf", "vec_id", "embedding"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of ids, values and box for each shard."""
    for b in K.whole_groups(batches, "shard"):
        shards = b.column(0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.append(True, shards[1:] != shards[:-1]))
        for lo, hi in zip(starts.tolist(), np.append(starts[1:], len(shards)).tolist(), strict=True):
            ids, x = b.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.int64), _matrix(b.column(2).slice(lo, hi - lo), int(shards[lo]) >> 42)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(shards[lo])]), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([x.min(0).tolist()], pa.list_(pa.float32())), pa.array([x.max(0).tolist()], pa.list_(pa.float32()))],
                names=["shard", "ids", "values", "low", "high"],
            )


def _search(batches: Iterator[pa.RecordBatch], k: int, leaf: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, vec_id, leaf, embedding, kth, ids, values) in the order of shard, the shard's vectors (no vec_id) before its queries, and these by leaf."""
    shard, vectors = None, None
    waiting: list[tuple] = []

    def out() -> pa.RecordBatch:
        q = np.array([w[2] for w in waiting], np.float32)
        block = Nearest(q.astype(np.float64), np.array([w[0] for w in waiting], np.int64), k, np.array([w[3] for w in waiting]))
        if vectors is not None:
            block.offer(*vectors)
        n = np.isfinite(block.d).sum(1)
        full = np.isfinite(block.d)
        ends = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
        made = pa.RecordBatch.from_arrays(
            [
                pa.array(block.ids), pa.array(np.full(len(q), shard >> 42)), pa.array([w[1] for w in waiting], pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * q.shape[1]), pa.array(q.ravel())),
                pa.ListArray.from_arrays(ends, pa.array(block.near[full])), pa.ListArray.from_arrays(ends, pa.array(block.d[full])),
            ],
            names=["vec_id", "dims", "leaf", "embedding", "near", "square"],
        )
        waiting.clear()
        return made

    for b in batches:
        shards = b.column(0).to_numpy(zero_copy_only=False)
        for r in range(b.num_rows):
            if shards[r] != shard:
                if waiting:
                    yield out()
                shard, vectors = int(shards[r]), None
            if not b.column(1)[r].is_valid:
                ids = np.frombuffer(b.column(5)[r].as_buffer(), np.int64)
                x = np.frombuffer(b.column(6)[r].as_buffer(), np.float32).astype(np.float64).reshape(len(ids), -1)
                tree = Tree(x, leaf)
                x, ids = x[tree.order], ids[tree.order]
                vectors = tree, x, np.einsum("ij,ij->i", x, x), ids
            else:
                waiting.append((b.column(1)[r].as_py(), b.column(2)[r].as_py(), b.column(3)[r].values.to_numpy(zero_copy_only=False), b.column(4)[r].as_py()))
                if len(waiting) == QUERIES:
                    yield out()
    if waiting:
        yield out()


def _further(batches: Iterator[pa.RecordBatch], k: int, boxes: dict[int, tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """For each searched query the other shards that may hold something nearer. boxes: by dims (leaf, lowest, highest, shards)."""
    for b in batches:
        dims = b.column(1).to_numpy(zero_copy_only=False)
        for m in np.unique(dims):
            rows = np.flatnonzero(dims == m)
            part = b.take(pa.array(rows))
            q, home = _matrix(part.column(3), int(m)).astype(np.float64), part.column(2).to_numpy(zero_copy_only=False)
            kth = np.array([x[-1] if len(x) == k else np.inf for x in part.column(5).to_pylist()])
            if int(m) not in boxes:
                continue
            leaf, low, high, shards = boxes[int(m)]
            for c in range(0, len(q), 256):
                away = np.maximum(0, np.maximum(low[None] - q[c : c + 256, None], q[c : c + 256, None] - high[None]))
                r, f = np.nonzero(np.einsum("ijk,ijk->ij", away, away) <= kth[c : c + 256, None] + 1e-9)
                n = shards[f]
                r, f = np.repeat(r + c, n), np.repeat(f, n)
                salt = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
                new = (leaf[f] != home[r]) | (salt > 0)
                r, f, salt = r[new], f[new], salt[new]
                for lo in range(0, len(r), 10_000):
                    s = slice(lo, lo + 10_000)
                    asked = part.take(pa.array(r[s]))
                    yield pa.RecordBatch.from_arrays([pa.array((int(m) << 42) + (leaf[f[s]] << 32) + salt[s]), asked.column(0), asked.column(2), asked.column(3), pa.array(kth[r[s]])], names=["shard", "vec_id", "leaf", "embedding", "kth"])


def _known(vectors: DataFrame) -> DataFrame:
    known = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).where(
        "vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) BETWEEN 1 AND 1000000 AND forall(embedding, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < 3e38)"
    )
    return known.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = NEIGHBOURS, leaf: int = LEAF, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, rank, neighbour, distance): for every query (all vectors, if none are given) its k nearest others among vectors by Euclidean distance, exactly, ties to the lower id.

    Rows with null id or embedding, or with a null or non-finite entry, or none, are left out of both tables; vectors are compared with those
    of the same length only; a vector of the query's id is no neighbour of it, and of an id's repeated rows one is taken (the lowest vector);
    fewer than k others give fewer rows; an empty table gives an empty result; columns other than vec_id and embedding are not looked at.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    known = _known(vectors)
    some = known.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    total = known.count()
    lists = some.column("embedding").combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    tops = {int(m): Top(_matrix(lists.take(pa.array(np.flatnonzero(lengths == m))), int(m)), max(SAMPLE_LEAF, -(-len(lengths) * shard_rows // max(1, total)))) for m in np.unique(lengths)}
    sent = spark.sparkContext.broadcast(tops)
    types = "dims bigint, leaf bigint, vec_id bigint, embedding array<float>"
    routed = shared_table(known.mapInArrow(lambda it: _route(it, sent.value), types), "vectors")
    asked = (routed if queries is None else _known(queries).mapInArrow(lambda it: _route(it, sent.value), types)).withColumn("shard", F.shiftleft("dims", 42) + F.shiftleft("leaf", 32))
    size = {(r["dims"], r["leaf"]): -(-r["n"] // shard_rows) for r in routed.groupBy("dims", "leaf").agg(F.count("*").alias("n")).collect()}  # a row for each top leaf
    if not size:
        return spark.createDataFrame([], "vec_id bigint, rank int, neighbour bigint, distance double")
    salts = spark.createDataFrame([(*key, n) for key, n in size.items()], "dims bigint, leaf bigint, salts bigint")
    dealt = routed.join(F.broadcast(salts), ["dims", "leaf"]).select((F.shiftleft("dims", 42) + F.shiftleft("leaf", 32) + F.pmod(F.xxhash64("vec_id"), "salts")).alias("shard"), "vec_id", "embedding")
    shards = shared_table(dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(_pack, "shard bigint, ids binary, values binary, low array<float>, high array<float>"), "shards")
    found = "vec_id bigint, dims bigint, leaf bigint, embedding array<float>, near array<bigint>, square array<double>"

    def searched(requests: DataFrame) -> DataFrame:
        both = requests.select("shard", "vec_id", "leaf", "embedding", "kth", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("values")).unionByName(shards.select("shard", "ids", "values"), allowMissingColumns=True)
        return both.repartition("shard").sortWithinPartitions("shard", F.col("vec_id").isNotNull(), "leaf", "vec_id").mapInArrow(lambda it: _search(it, k, leaf), found)

    first = shared_table(searched(asked.withColumn("kth", F.lit(float("inf")))), "nearest-at-home")
    sides = shards.select(F.shiftright("shard", 32).alias("at"), F.posexplode(F.arrays_zip("low", "high")).alias("i", "side")).groupBy("at", "i").agg(F.min("side.low").alias("low"), F.max("side.high").alias("high"))
    box = {r["at"]: (r["low"], r["high"]) for r in sides.groupBy("at").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "low"))), lambda x: x["low"]).alias("low"), F.transform(F.array_sort(F.collect_list(F.struct("i", "high"))), lambda x: x["high"]).alias("high")).collect()}
    boxes = {}
    for m in tops:
        at = sorted(key for key in size if key[0] == m)
        if at:
            boxes[m] = (np.array([x for _, x in at]), *(np.array([box[(m << 10) + x][j] for _, x in at], np.float64) for j in (0, 1)), np.array([size[key] for key in at]))
    bounds = spark.sparkContext.broadcast(boxes)
    more = first.mapInArrow(lambda it: _further(it, k, bounds.value), "shard bigint, vec_id bigint, leaf bigint, embedding array<float>, kth double")
    every = first.select("vec_id", "near", "square").unionByName(searched(more).select("vec_id", "near", "square"))
    every = every.select("vec_id", F.explode(F.arrays_zip("near", "square")).alias("x")).select("vec_id", "x.near", "x.square")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("square", "near"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "rank", F.col("near").alias("neighbour"), F.sqrt("square").alias("distance"))
