"""Mixing sources to target weights, block by block.

Tokens are the words of a text, each with the white space after it, so a block's text is a piece of the source's running text. A
source's documents, in the order of a hash of their id, are laid end to end and cut into blocks of ``LENGTH`` tokens; the last block of a source may be
shorter, and nothing is left out. An output shard has ``SHARD_SLOTS`` slots; how many go to each source is drawn from a multinomial of
the target weights, seeded by the shard's number. The slots of a source, counted through all shards, are mapped to its blocks by a
pseudorandom permutation of the block numbers (a Feistel network that walks until it is in range), another for each pass through the source, so no
block comes again before all have come. Slots and blocks are joined by (source, block number).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgraph.llm import kernels as K
from symgraph.llm.tables import shared_table, small_batches

LENGTH, SHARD_SLOTS, SEED, TEMPER = 1024, 256, 17, 0.5
#: Documents of a source are dealt to parts of about so many characters.
PART_CHARS = 4 << 20
BETWEEN = b"\n\n"


def permute(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The image of i under the permutation of range(n) that key names; all three are arrays."""
    i, n = i.astype(K.U64), n.astype(K.U64)
    bits = np.maximum(2, np.array([int(v).bit_length() for v in np.unique(n)]))[np.searchsorted(np.unique(n), n)]
    half = ((bits + 1) // 2).astype(K.U64)
    mask = (K.U64(1) << half) - K.U64(1)
    out, live = i.copy(), np.arange(len(i))
    while len(live):
        left, right, h, m, k = out[live] >> half[live], out[live] & mask[live], half[live], mask[live], key[live]
        for r in range(4):
            left, right = right, left ^ (K.mix(right + k + K.U64((r + 1) * int(K.BASE) & (1 << 64) - 1)) & m)
        out[live] = left << h | right
        live = live[out[live] >= n[live]]
    return out.astype(np.int64)


def draw(shard: int, slots: int, weights: np.ndarray, seed: int) -> np.ndarray:
    """How many of a shard's slots each source gets."""
    return np.random.Generator(np.random.Philox([seed, shard])).multinomial(slots, weights)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, raw, offsets in K.slices(b.column(2)):
            _, first = K.word_starts(raw, offsets)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(np.diff(first))], names=["source", "part", "words"])


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Batches (source, part, begin, doc_id, text), sorted; rows (source, block, at, n, doc_ids, text) of runs of a block's tokens."""
    now, place = None, 0
    held: dict | None = None  # the run being gathered

    def rows(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x["source"] for x in found], pa.string()), pa.array([x["block"] for x in found], pa.int64()), pa.array([x["at"] for x in found], pa.int32()), pa.array([x["n"] for x in found], pa.int32()),
                pa.array([x["ids"] for x in found], pa.list_(pa.int64())), pa.array([b"".join(x["text"]) for x in found], pa.binary()).cast(pa.string()),
            ],
            names=["source", "block", "at", "n", "doc_ids", "text"],
        )

    for b in batches:
        sources, parts, begins = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
        ids = b.column(3).to_pylist()
        for lo, hi, raw, offsets in K.slices(b.column(4)):
            starts, first = K.word_starts(raw, offsets)
            data, found = raw.tobytes(), []
            for r in range(lo, hi):
                if (sources[r], parts[r]) != now:
                    if held:
                        found.append(held)
                    now, place, held = (sources[r], parts[r]), begins[r], None
                w0, w1 = int(first[r - lo]), int(first[r - lo + 1])
                while w0 < w1:
                    room = length - place % length
                    take = min(room, w1 - w0)
                    if held is None or held["block"] != place // length:
                        held = {"source": sources[r], "block": place // length, "at": place % length, "n": 0, "ids": [], "text": []}
                    s = int(starts[w0])
                    e = int(starts[w0 + take]) if w0 + take < w1 else int(offsets[r - lo + 1])
                    held["text"].append(data[s:e])
                    held["ids"].append(ids[r])
                    held["n"] += take
                    place, w0 = place + take, w0 + take
                    if w0 == w1:
                        held["text"].append(BETWEEN)
                    if place % length == 0:
                        found.append(held)
                        held = None
            if found:
                yield rows(found)
    if held:
        yield rows([held])


def _draws(batches: Iterator[pa.RecordBatch], slots: int, total: int, names: list[str], weights: np.ndarray, seed: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        shards = b.column(0).to_numpy(zero_copy_only=False)
        counts = np.array([draw(int(s), min(slots, total - int(s) * slots), weights, seed) for s in shards]).reshape(len(shards), len(names))
        r, c = np.nonzero(counts)
        first = np.cumsum(counts, 1) - counts
        yield pa.RecordBatch.from_arrays([pa.array(shards[r]), pa.array([names[i] for i in c], pa.string()), pa.array(first[r, c]), pa.array(counts[r, c])], names=["shard", "source", "first", "count"])


def _slots(batches: Iterator[pa.RecordBatch], sizes: dict[str, int], seed: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, source, first, count, before) to one row a slot."""
    for b in batches:
        shard, first, count, before = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 2, 3, 4))
        source = b.column(1).to_pylist()
        row = np.repeat(np.arange(len(shard)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        n = np.array([sizes[s] for s in source], np.int64)[row]
        salt = K.word_hashes(*K.column_bytes(pa.array(["x" + "".join(f"{c:02x}" for c in s.encode()) for s in source], pa.string())))[0][row]
        i = before[row] + nth
        block = permute(i % n, n, K.mix(salt + K.U64(seed)) + (i // n).astype(K.U64) * K.BASE)
        yield pa.RecordBatch.from_arrays([pa.array(shard[row]), pa.array((first[row] + nth).astype(np.int32)), b.column(1).take(pa.array(row)), pa.array(block)], names=["shard", "slot", "source", "block"])


def mixed_blocks(docs: DataFrame, weights: dict[str, float] | None = None, length: int = LENGTH, shard_slots: int = SHARD_SLOTS, slots: int | None = None, seed: int = SEED, temper: float = TEMPER) -> DataFrame:
    """(shard, slot, source, block, n_tokens, doc_ids, text): the blocks in the order in which training reads them.

    weights: target shares by source, brought to a sum of 1 over the sources that have tokens; sources not named have none. Without
    them a source weighs by its number of blocks to the power ``temper``. slots: how many in all, by default as many as there are blocks.
    doc_ids are those of the documents that a block is of, in order. Rows with null id or text are left out, those with a null source are
    of the source ''; texts without words give no tokens; repeated rows are tokens each time; an empty table, or no source with
    a weight, gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    rows = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    chars = rows.groupBy("source").agg(F.sum(F.length("text")).alias("chars")).collect()  # a row for each source
    parts = {r["source"]: max(1, -(-int(r["chars"]) // PART_CHARS)) for r in chars}
    if not parts:
        return _empty(spark)
    n_parts = F.create_map(*[F.lit(x) for s, n in parts.items() for x in (s, n)])[F.col("source")]
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), n_parts)).select("source", "part", "doc_id", "text")
    counts = dealt.select("source", "part", "text").mapInArrow(_word_counts, "source string, part bigint, words bigint").groupBy("source", "part").agg(F.sum("words").alias("words"))
    begins = shared_table(counts.withColumn("begin", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "mixing-begins")
    sizes = {r["source"]: -(-int(r["words"]) // length) for r in begins.groupBy("source").agg(F.sum("words").alias("words")).collect()}
    sizes = {s: n for s, n in sizes.items() if n and (weights is None or weights.get(s, 0) > 0)}
    if not sizes:
        return _empty(spark)
    names = sorted(sizes)
    share = np.array([weights[s] if weights else sizes[s] ** temper for s in names], float)
    share /= share.sum()
    total = sum(sizes.values()) if slots is None else slots
    placed = dealt.hint("shuffle_merge").join(begins.select("source", "part", "begin"), ["source", "part"]).select("source", "part", "begin", "doc_id", "text")
    ordered = placed.sortWithinPartitions("source", "part", "doc_id", F.xxhash64("text"))
    pieces = ordered.mapInArrow(lambda it: _pieces(it, length), "source string, block bigint, at int, n int, doc_ids array<bigint>, text string")
    run = F.sort_array(F.collect_list(F.struct("at", "n", "doc_ids", "text")))
    blocks = pieces.groupBy("source", "block").agg(run.alias("run")).select(
        "source", "block", F.aggregate("run", F.lit(0), lambda a, x: a + x["n"]).alias("n_tokens"), F.array_distinct(F.flatten("run.doc_ids")).alias("doc_ids"), F.array_join("run.text", "").alias("text")
    )
    shards = spark.range(-(-total // shard_slots))
    drawn = shards.mapInArrow(lambda it: _draws(it, shard_slots, total, names, share, seed), "shard bigint, source string, first bigint, count bigint")
    before = F.coalesce(F.sum("count").over(Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    asked = drawn.withColumn("before", before).mapInArrow(lambda it: _slots(it, sizes, seed), "shard bigint, slot int, source string, block bigint")
    joined = asked.hint("shuffle_merge").join(blocks, ["source", "block"])
    return joined.select("shard", "slot", "source", "block", "n_tokens", "doc_ids", "text")


def _empty(spark) -> DataFrame:
    return spark.createDataFrame([], "shard bigint, slot int, source string, block bigint, n_tokens int, doc_ids array<bigint>, text string")


def as_documents(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """Blocks with the columns of docs: doc_id is that of a block's first document, lang null, n_chars counted; any others are null."""
    have = {"doc_id": F.element_at("doc_ids", 1), "text": F.col("text"), "source": F.col("source"), "n_chars": F.length("text")}
    return blocks.select(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in docs.schema])
