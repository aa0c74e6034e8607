"""Exact Jaccard of word n-gram sets for all similar documents, by set-relation skipping.

A document's set holds the 64-bit hashes of its lower-cased word n-grams (the whole text is one gram where it has fewer than n words,
and a text without words has no set). A set is known by its fingerprint, so equal sets are one set, with the documents that have it
as its members: copies, however many, cost one row each. The steps:

1. Grams travel once, packed by bucket, and those that only one set has end there. A similar pair's common grams are all in two sets
   or more, so what is left suffices for exact overlaps. Grams that a great share of all sets have are found first (a list bounded by
   that share, not by the input), and don't travel: no bucket gets a hot gram's list here.
2. A set's grams are ordered by the number of sets that have them (in quarters of its logarithm), and it is indexed under the first n - ceil(t n) + 1 of this order:
   similar sets share one of these, so nothing is lost. Sets whose rare grams fill that prefix are similar to none.
3. An index list is sorted by set size and cut into blocks. Blocks whose sizes rule out the threshold are skipped, and within the
   others pairs by the gram's positions: what precedes and what follows it in both sets bounds the overlap. A list of more than ``LIST`` sets is split into
   cells, each pair of its parts for another task. A pair goes to one of its common grams: the lowest among the ``SKETCH`` lowest indexed
   grams of either set; pairs whose sketches have nothing in common go to each bucket in which they meet.
4. Pairs are counted per list: each set's answers come from those of the most similar set answered before, changed by the grams in
   which the two differ.
5. Near copies of one text would meet in each of its grams, and all with all. So a set has a home, an indexed gram drawn with the weight of its frequency, on which most
   near copies agree. Homes of ``FEW`` sets or more are blocks: pairs between sets of such homes are counted once, by a product of matrices of sets and grams, within a home
   and between two homes that meet in a list. Out of a block come each set's number of links and edges that connect what is similar, a few rows a set, unless all pairs are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm import kernels as K
from symgraph.llm.tables import cut, drop_table, fresh, release, shared_table, texts

N, THRESHOLD, BLOCK, SKETCH = 3, 0.5, 512, 12
#: Sets of an index list that one task takes, sets of a list that are counted together, and bytes of a postings table.
LIST, GROUP, POSTINGS = 4096, 500, 32 << 20
#: Bytes of text in a pack; grams in a bucket, about.
PACK_BYTES, BUCKET_GRAMS = 8 << 20, 2_000_000
#: A gram is hot if at least this share of all sets, and this many, have it: at most (grams of a mean set / share) are.
HOT_SHARE, HOT_LEAST = 0.005, 10_000
#: Sets of a home that is a block, of a home's run in a list that isn't gone through pair by pair; sets and grams of a block's part; homes that are broadcast.
FEW, RUN, CELL, CELL_GRAMS, BROADCAST = 32, 16, 2048, 1 << 20, 250_000


def gram_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' sets one after another, each sorted, as 64-bit hashes; and their sizes."""
    words, _, first = K.word_hashes(raw, offsets)
    counts = np.diff(first)
    rows = K.row_of(first, len(words))
    grams = K.gram_hashes(words, n)
    same = rows[: len(grams)] == rows[n - 1 :][: len(grams)] if len(grams) else np.zeros(0, bool)
    of, value = rows[: len(grams)][same], grams[same]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = [K.mix(np.array([(words[first[r] : first[r + 1]] * K.power_table(n)[: counts[r]]).sum() + K.U64(counts[r])], K.U64))[0] for r in short]
        of, value = np.append(of, short), np.append(value, np.array(whole, K.U64))
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    once = np.ones(len(of), bool)
    once[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
    return value[once], np.bincount(of[once], minlength=len(offsets) - 1)


def fingerprints(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit number for each set."""
    sums = np.append(np.zeros(1, K.U64), np.cumsum(K.mix(grams + K.BASE)))
    ends = np.cumsum(sizes)
    return K.mix(sums[ends] - sums[ends - sizes] + sizes.astype(K.U64)).view(np.int64)


def _packs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, fingerprints, sizes, grams) of about PACK_BYTES of text at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    much = 0
    for b in batches:
        for lo, hi, raw, offsets in K.slices(b.column(1)):
            grams, sizes = gram_sets(raw, offsets, n)
            held.append((b.column(0).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.int64), fingerprints(grams, sizes), sizes, grams))
            much += len(raw)
            if much >= PACK_BYTES:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, much = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _distinct(fingers: np.ndarray, sizes: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each set of a pack once."""
    _, one = np.unique(fingers, return_index=True)
    one = one[sizes[one] > 0]
    mine = np.zeros(len(fingers), bool)
    mine[one] = True
    return fingers[mine], sizes[mine], grams[np.repeat(mine, sizes)]


def _members(batches: Iterator[pa.RecordBatch], n: int, share: float) -> Iterator[pa.RecordBatch]:
    """(hot false, key fingerprint, n size, doc_id) of each row, and (hot true, key gram, n sets) of what is frequent in a pack."""
    for ids, fingers, sizes, grams in _packs(batches, n):
        own, _, every = _distinct(fingers, sizes, grams)
        gram, count = np.unique(every, return_counts=True)
        often = count >= max(2, share / 2 * len(own))
        gram, count = gram[often].view(np.int64), count[often]
        kind = np.arange(len(ids) + len(gram)) >= len(ids)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind), pa.array(np.append(fingers, gram)), pa.array(np.append(sizes, count).astype(np.int64)), pa.array(np.append(ids, np.zeros(len(gram), np.int64)), mask=kind)], names=["hot", "key", "n", "doc_id"]
        )


def packed(buckets: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """A row for each bucket that occurs: its number, and its entries of each column as bytes."""
    order = np.argsort(buckets, kind="stable")
    b = buckets[order]
    heads = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, np.int64)
    counts = np.diff(np.append(heads, len(b)))
    return [pa.array(b[heads].astype(np.int32)), *(K.binaries(c[order], counts) for c in columns)]


def packed_sets(buckets: np.ndarray, fingers: np.ndarray, sizes: np.ndarray, grams: np.ndarray, classes: np.ndarray) -> pa.RecordBatch:
    """Packed (fingerprint, size, grams here) of sets, and (gram, class) of their grams. The rows of a set in a bucket stand together."""
    order = np.argsort(buckets, kind="stable")
    bucket, finger = buckets[order], fingers[order]
    head = np.append(True, (bucket[1:] != bucket[:-1]) | (finger[1:] != finger[:-1])) if len(order) else np.zeros(0, bool)
    at = np.flatnonzero(head)
    here = np.diff(np.append(at, len(order))).astype(np.uint32)
    left = packed(bucket[at], finger[at], sizes[order][at].astype(np.int32), here)
    return pa.RecordBatch.from_arrays([*left, *packed(bucket, grams[order], classes[order])[1:]], names=["part", "finger", "n", "here", "gram", "class"])


def gathered(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """(fingerprint, size, gram, class), an entry a gram, of all packed rows of a partition."""
    parts: list[list[np.ndarray]] = [[] for _ in range(5)]
    for b in batches:
        for k, t in enumerate((np.int64, np.int32, np.uint32, np.uint64, np.uint8)):
            parts[k].append(K.column_bytes(b.column(k + 1))[0].view(t))
    finger, n, here, gram, kind = (np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(parts, (np.int64, np.int32, np.uint32, np.uint64, np.uint8), strict=True))
    return [np.repeat(finger, here), np.repeat(n, here), gram, kind]


def frequency_class(df: np.ndarray) -> np.ndarray:
    """0 for none, else 1 and the quarters of the logarithm: grams are ordered by this, not by the number itself."""
    return np.where(df > 0, 1 + np.floor(4 * np.log2(np.maximum(df, 1)) + 1e-9), 0).astype(np.uint8)


def _by_gram(batches: Iterator[pa.RecordBatch], n: int, parts: int, hot: np.ndarray, hot_n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packed (fingerprint, size, gram, class: 0 where the sets that have it are to be counted)."""
    for _, fingers, sizes, grams in _packs(batches, n):
        fingers, sizes, grams = _distinct(fingers, sizes, grams)
        of = np.repeat(np.arange(len(fingers)), sizes)
        kind = np.zeros(len(grams), np.uint8)
        bucket = grams % K.U64(parts)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
            is_hot = hot[at] == grams
            kind[is_hot] = frequency_class(hot_n)[at[is_hot]]
            bucket[is_hot] = fingers[of[is_hot]].view(K.U64) % K.U64(parts)
        yield packed_sets(bucket, fingers[of], sizes[of], grams, kind)


def _shared(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """What several sets have, with the class of their number, packed by set."""
    finger, n, gram, kind = gathered(batches)
    order = np.lexsort((finger, gram))
    finger, n, gram, kind = finger[order], n[order], gram[order], kind[order]
    once = np.ones(len(gram), bool)
    once[1:] = (gram[1:] != gram[:-1]) | (finger[1:] != finger[:-1])
    finger, n, gram, kind = finger[once], n[once], gram[once], kind[once]
    heads = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
    size = np.diff(np.append(heads, len(gram)))
    keep = (kind > 0) | np.repeat(size > 1, size)
    kind = np.where(kind > 0, kind, np.repeat(frequency_class(size), size))[keep]
    finger, n, gram = finger[keep], n[keep], gram[keep]
    order = np.argsort(finger, kind="stable")
    finger = finger[order]
    yield packed_sets(finger.view(np.uint64) % np.uint64(parts), finger, n[order], gram[order], kind[order])


def prefix_length(n: np.ndarray, threshold: float) -> np.ndarray:
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def homes(gram: np.ndarray, kind: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One of each set's grams (``counts`` of them, one at least), drawn with the weight of its frequency; sets that have a gram draw it alike."""
    if not len(counts):
        return np.zeros(0, np.uint64)
    late = -np.log(((K.mix(gram ^ K.BASE) >> K.U64(11)).astype(np.float64) + 1) / 2.0**53) / 2.0 ** (kind / 4)
    starts = np.cumsum(counts) - counts
    drawn = np.flatnonzero(late == np.repeat(np.minimum.reduceat(late, starts), counts))
    return gram[drawn[np.searchsorted(drawn, starts)]]


def _ordered(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Sets that can have partners: grams that others have too, the rarest first, of which ``q`` are indexed; and the home, one of those."""
    finger, n, gram, kind = gathered(batches)
    order = np.lexsort((gram, kind, finger))
    finger, n, gram, kind = finger[order], n[order], gram[order], kind[order]
    once = np.ones(len(gram), bool)
    once[1:] = (gram[1:] != gram[:-1]) | (finger[1:] != finger[:-1])
    finger, n, gram, kind = finger[once], n[once], gram[once], kind[once]
    heads = np.flatnonzero(np.append(True, finger[1:] != finger[:-1])) if len(gram) else np.zeros(0, np.int64)
    r = np.diff(np.append(heads, len(gram)))
    size = n[heads].astype(np.int64)
    q = prefix_length(size, threshold) - (size - r)
    good = q > 0
    keep = np.repeat(good, r)
    every = K.binaries(gram[keep], r[good])
    first = keep & (np.arange(len(gram)) - np.repeat(heads, r) < np.repeat(q, r))
    indexed = np.minimum(q, r)[good]
    counts = K.binaries(kind[first], indexed)
    home = homes(gram[first], kind[first], indexed).view(np.int64)
    for lo in range(0, int(good.sum()), 2000):
        s = slice(lo, lo + 2000)
        yield pa.RecordBatch.from_arrays([pa.array(finger[heads][good][s]), pa.array(size[good][s]), every.slice(lo, 2000), counts.slice(lo, 2000), pa.array(home[s])], names=["finger", "n", "grams", "classes", "home"])


def _index(batches: Iterator[pa.RecordBatch], parts: int, most: int) -> Iterator[pa.RecordBatch]:
    """Index entries packed by list: sets (fingerprint, size, home, parts of its block or 0, sketch), and entries (set, gram, cell, side, position)."""
    for b in batches:
        if not b.num_rows:
            continue
        finger, n, home, cells = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 4, 5))
        raw, at = K.column_bytes(b.column(2))
        grams, starts = raw.view(np.uint64), at[:-1] // 8
        r = np.diff(at) // 8
        raw, at = K.column_bytes(b.column(3))
        most_sets, q = np.ceil(2.0 ** (raw.astype(np.float64) / 4)), np.diff(at)
        row = np.repeat(np.arange(len(n)), q)
        rank = np.arange(len(row)) - np.repeat(np.cumsum(q) - q, q)
        gram = grams[starts[row] + rank]
        pos = (n - r)[row] + rank
        order = np.lexsort((gram, row))
        low = order[rank < SKETCH]  # rank runs over each row alike, whatever the order within
        sketch = np.full((len(n), SKETCH), np.iinfo(np.uint64).max)
        sketch[row[low], rank[rank < SKETCH]] = gram[low]
        split = np.maximum(1, np.ceil(most_sets / most)).astype(np.int64)
        mine = K.mix(finger[row].view(np.uint64)) % split.astype(np.uint64)
        again = np.repeat(np.arange(len(row)), split)  # once for each part of the list, its own too
        other = np.arange(len(again)) - np.repeat(np.cumsum(split) - split, split)
        own = mine[again].astype(np.int64)
        cell = (np.minimum(own, other) * split[again] + np.maximum(own, other)).astype(np.uint32)
        side = np.where(own == other, 0, np.where(own < other, 1, 2)).astype(np.uint8)
        row, gram, pos = row[again], gram[again], pos[again]
        bucket = (K.mix(gram ^ (cell.astype(np.uint64) * K.BASE)) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((row, bucket))
        row, gram, pos, cell, side, bucket = row[order], gram[order], pos[order], cell[order], side[order], bucket[order]
        head = np.append(True, (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1]))
        sets, of = row[head], bucket[head]
        number = np.cumsum(head) - 1
        number = number - np.searchsorted(of, bucket)
        sketches = [np.ascontiguousarray(sketch[sets, k]) for k in range(SKETCH)]
        left, right = packed(of, finger[sets], n[sets].astype(np.int32), home[sets], cells[sets].astype(np.int32), *sketches), packed(bucket, number.astype(np.int32), gram, cell, side, pos.astype(np.int32))
        yield pa.RecordBatch.from_arrays([*left, *right[1:]], names=["part", "finger", "n", "home", "cells", *(f"s{k}" for k in range(SKETCH)), "number", "gram", "cell", "side", "pos"])


_INDEX = "part int, finger binary, n binary, home binary, cells binary, " + ", ".join(f"s{k} binary" for k in range(SKETCH)) + ", number binary, gram binary, cell binary, side binary, pos binary"


def needed(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """The overlap that sets of a and b grams need."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


class _Lists:
    """The index lists of a bucket, and the pairs of sets in them."""

    def __init__(self, finger: np.ndarray, n: np.ndarray, home: np.ndarray, cells: np.ndarray, sketch: np.ndarray, entries: list[np.ndarray], threshold: float, group: int):
        self.finger, self.n, self.sketch, self.threshold, self.group = finger, n, sketch, threshold, group
        self.homes, at = np.unique(home[cells > 0], return_index=True)
        self.parts = cells[cells > 0][at]
        self.home = np.where(cells > 0, np.searchsorted(self.homes, home), -1)  # -1: no block's
        self.across: list[np.ndarray] = []
        self.crossing = 0
        of, gram, cell, side, pos = entries
        order = np.lexsort((finger[of], n[of], cell, gram))
        of, gram, cell, side, pos = of[order], gram[order], cell[order], side[order], pos[order]
        head = np.append(True, (gram[1:] != gram[:-1]) | (cell[1:] != cell[:-1])) if len(gram) else np.zeros(0, bool)
        begin = np.flatnonzero(head)
        length = np.diff(np.append(begin, len(gram)))
        live = np.repeat(length > 1, length)
        self.of, self.gram, self.cell, self.side, self.pos = of[live], gram[live], cell[live], side[live], pos[live]
        self.length = length[length > 1]
        self.begin = np.cumsum(self.length) - self.length
        self.size = n[self.of]
        self.rank = np.arange(len(self.of)) - np.repeat(self.begin, self.length)
        self.drawn = (sketch[self.of] == self.gram[:, None]).any(1)
        self.found: list[tuple[np.ndarray, ...]] = []
        self.far: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def judge(self, i: np.ndarray, j: np.ndarray) -> None:
        """Entries i and j of a list: what can be similar, and belongs here. Of two blocks' sets only that the blocks meet."""
        a, b = self.home[self.of[i]], self.home[self.of[j]]
        apart = (a < 0) | (a != b)
        i, j = i[apart], j[apart]
        n, pos = self.size, self.pos
        need = needed(n[i], n[j], self.threshold)
        keep = np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need
        keep &= ((self.side[i] != self.side[j]) | (self.side[i] == 0)) & (self.of[i] != self.of[j])
        i, j = i[keep], j[keep]
        a, b = self.of[i], self.of[j]
        blocks = (self.home[a] >= 0) & (self.home[b] >= 0)
        if blocks.any():
            self._meet(a[blocks], self.home[b[blocks]])
            self._meet(b[blocks], self.home[a[blocks]])
            i, j = i[~blocks], j[~blocks]
        both = self.drawn[i] & self.drawn[j]
        for c in range(0, int(both.sum()), 20_000):
            x, y = i[both][c : c + 20_000], j[both][c : c + 20_000]
            a, b = self.sketch[self.of[x]], self.sketch[self.of[y]]
            lower = ((a[:, :, None] == b[:, None, :]).any(2) & (a < self.gram[x][:, None])).any(1)
            self._give(x[~lower], y[~lower])
        i, j = i[~both], j[~both]
        if len(i):
            self.far.append((self.of[i] * len(self.finger) + self.of[j], i, j))
            self.waiting += len(i)
            if self.waiting > 4_000_000:
                self._merge()

    def _meet(self, sets: np.ndarray, home: np.ndarray) -> None:
        self.across.append(np.unique(sets * len(self.homes) + home))
        self.crossing += len(self.across[-1])
        if self.crossing > 4_000_000:
            self.across = [np.unique(np.concatenate(self.across))]
            self.crossing = len(self.across[0]) // 2

    def meetings(self) -> tuple[np.ndarray, ...]:
        """(home, set, other home, parts of the other home): the sets that must be held against another home's."""
        key = np.unique(np.concatenate(self.across)) if self.across else np.zeros(0, np.int64)
        sets, other = np.divmod(key, max(1, len(self.homes)))
        return self.homes[self.home[sets]], self.finger[sets], self.homes[other], self.parts[other]

    def _runs(self, at: np.ndarray) -> np.ndarray:
        """Notes which homes with ``RUN`` entries of a list's or more meet; returns the other entries."""
        home = self.home[self.of[at]]
        found, count = np.unique(home[home >= 0], return_counts=True)
        long = found[count >= RUN]
        if not len(long):
            return at
        runs = [at[home == h] for h in long.tolist()]
        n, pos = self.size, self.pos
        low, high, before, after = (np.array([f(x) for x in runs]) for f in (lambda x: n[x].min(), lambda x: n[x].max(), lambda x: pos[x].max(), lambda x: (n[x] - pos[x]).max()))
        meet = np.minimum.outer(before, before) + np.minimum.outer(after, after) >= needed(low[:, None], low, self.threshold)
        meet &= (high[:, None] >= self.threshold * low - 1e-9) & (high >= self.threshold * low[:, None] - 1e-9)
        np.fill_diagonal(meet, False)
        for k, x in enumerate(runs):
            if meet[k].any():
                others = long[meet[k]]
                self._meet(np.repeat(self.of[x], len(others)), np.tile(others, len(x)))
        return at[~np.isin(home, long)]

    def _between(self, xs: np.ndarray, ys: np.ndarray, same: bool) -> None:
        """Judges entries xs with ys, both in the order of size, whose sizes may do; each pair once where both are the same."""
        n = self.size
        for lo in range(0, len(xs), BLOCK):  # a block of sets, and the sets whose size may still do
            block = xs[lo : lo + BLOCK]
            first = lo if same else int(np.searchsorted(n[ys], self.threshold * n[block[0]] - 1e-9))
            top = int(np.searchsorted(n[ys], n[block[-1]] / self.threshold + 1e-9, "right"))
            for c in range(first, top, 2 * BLOCK):
                x, y = np.meshgrid(block, ys[c : min(c + 2 * BLOCK, top)], indexing="ij")
                near = (n[x] >= self.threshold * n[y] - 1e-9) & (n[y] >= self.threshold * n[x] - 1e-9)
                if same:
                    near &= x < y
                self.judge(x[near], y[near])

    def _merge(self) -> None:
        key, i, j = (np.concatenate(x) for x in zip(*self.far, strict=True))
        _, one = np.unique(key, return_index=True)
        self.far, self.waiting = [(key[one], i[one], j[one])], len(one) // 2

    def _give(self, i: np.ndarray, j: np.ndarray) -> None:
        place = (self.rank[i] // self.group << 24 | self.rank[j] // self.group).astype(np.uint64)
        key = K.mix(self.gram[i] ^ K.mix(place + K.BASE * (self.cell[i].astype(np.uint64) + K.U64(1))))
        a, b = self.finger[self.of[i]], self.finger[self.of[j]]
        self.found.append((key.view(np.int64), np.minimum(a, b), np.maximum(a, b)))

    def pairs(self) -> Iterator[tuple[np.ndarray, ...]]:
        """(key, a, b): key stands for the list, or the part of it, in which the pair is counted."""
        small = self.length <= 32
        for m in np.unique(self.length[small]):
            s = self.begin[small & (self.length == m)]
            x, y = np.triu_indices(int(m), 1)
            step = max(1, 200_000 // len(x))
            for c in range(0, len(s), step):
                self.judge((s[c : c + step, None] + x).ravel(), (s[c : c + step, None] + y).ravel())
            yield from self._out()
        for s, e in zip(self.begin[~small].tolist(), (self.begin + self.length)[~small].tolist(), strict=True):
            every = np.arange(s, e)
            rest = self._runs(every)
            self._between(rest, rest, True)
            if len(rest) < len(every):
                self._between(rest, np.setdiff1d(every, rest, True), False)
            yield from self._out()
        if self.far:
            self._merge()
            _, i, j = self.far.pop()
            for c in range(0, len(i), 20_000):
                x, y = i[c : c + 20_000], j[c : c + 20_000]
                apart = np.ones(len(x), bool)
                a, b = self.sketch[self.of[x]], self.sketch[self.of[y]]
                for k in range(SKETCH):
                    apart &= ~((a[:, k, None] == b) & (b != np.iinfo(np.uint64).max)).any(1)
                self._give(x[apart], y[apart])
        yield from self._out(1)

    def _out(self, least: int = 200_000) -> Iterator[tuple[np.ndarray, ...]]:
        if sum(len(x[0]) for x in self.found) >= least:
            yield tuple(np.concatenate(x) for x in zip(*self.found, strict=True))
            self.found = []


def _candidates(batches: Iterator[pa.RecordBatch], threshold: float, group: int) -> Iterator[pa.RecordBatch]:
    """(key, a, b, 0): a pair and where it is counted; (home, set, other home, parts of the other home): a set to be held against another block."""
    sets: list[list[np.ndarray]] = [[] for _ in range(4 + SKETCH)]
    entries: list[list[np.ndarray]] = [[] for _ in range(5)]
    known = 0
    for b in batches:
        columns = [K.column_bytes(b.column(1 + k)) for k in range(9 + SKETCH)]
        for r in range(b.num_rows):
            part = [raw[o[r] : o[r + 1]] for raw, o in columns]
            for k in range(4 + SKETCH):
                sets[k].append(part[k].view((np.int64, np.int32, np.int64, np.int32)[k] if k < 4 else np.uint64))
            for k, t in enumerate((np.int32, np.uint64, np.uint32, np.uint8, np.int32)):
                x = part[4 + SKETCH + k].view(t)
                entries[k].append(x.astype(np.int64) + known if k == 0 else x)
            known += len(sets[0][-1])
    if not known:
        return
    finger, n, home, cells, *sketch = (np.concatenate(x) for x in sets)
    lists = _Lists(finger, n.astype(np.int64), home, cells, np.stack(sketch, 1), [np.concatenate(x) for x in entries], threshold, group)
    del sets, entries, sketch
    for key, a, b in lists.pairs():
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), pa.array(b), pa.array(np.zeros(len(key), np.int32))], names=["key", "a", "b", "cells"])
    met = lists.meetings()
    for lo in range(0, len(met[0]), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 200_000]) for x in met], names=["key", "a", "b", "cells"])


def overlaps(sets: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """The overlaps of the pairs ``wanted`` (rows of two set numbers). The grams are taken in ranges, whose overlaps add up, so that memory stays bounded."""
    if len(wanted) <= 3:
        return np.array([len(np.intersect1d(sets[i], sets[j], True)) for i, j in wanted], np.int64)
    sizes = np.array([len(s) for s in sets])
    _, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    common = count > 1  # a gram of one set is in no overlap
    keep = common[number]
    number, owner = (np.cumsum(common) - 1)[number[keep]], owner[keep]
    width, out = int(common.sum()), np.zeros(len(wanted), np.int64)
    step = max(1, POSTINGS // len(sets))
    for lo in range(0, width, step):
        mine = (number >= lo) & (number < lo + step)
        out += derived(number[mine] - lo, owner[mine], min(step, width - lo), len(sets), wanted)
    return out


def derived(number: np.ndarray, owner: np.ndarray, width: int, n: int, wanted: np.ndarray) -> np.ndarray:
    """Overlaps over grams 0 to width - 1, each set's answers from those of the set, among the answered ones, from which it differs least.

    Postings say which sets hold a gram. A set's answers are the other's, plus the postings of grams that only this one has, less those of
    grams that only the other has; where that is no less work than its own grams are, they are added up afresh.
    """
    held = np.split(number, np.cumsum(np.bincount(owner, minlength=n))[:-1])
    size = np.array([len(h) for h in held])
    postings = np.zeros((width, n), np.uint8)
    postings[number, owner] = 1
    order = np.argsort(wanted[:, 0], kind="stable")
    asked, begin = np.unique(wanted[order, 0], return_index=True)
    out = np.zeros(len(wanted), np.int64)
    answers: dict[int, np.ndarray] = {}
    differ, like = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    for i, lo, hi in zip(asked.tolist(), begin.tolist(), np.append(begin[1:], len(order)).tolist(), strict=True):
        base = int(like[i])
        if base >= 0 and differ[i] < size[i]:
            has, had = np.zeros(width, bool), np.zeros(width, bool)
            has[held[i]], had[held[base]] = True, True
            mine = answers[base] + postings[has & ~had].sum(0, dtype=np.int64) - postings[had & ~has].sum(0, dtype=np.int64)
        else:
            mine = postings[held[i]].sum(0, dtype=np.int64)
        answers[i] = mine
        out[order[lo:hi]] = mine[wanted[order[lo:hi], 1]]
        away = size[i] + size - 2 * mine
        nearer = away < differ
        differ[nearer], like[nearer] = away[nearer], i
    return out


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key, a key's sets before its pairs; a key has at most two parts of a list, so that all of it fits."""
    now: int | None = None
    held: dict[int, tuple[int, np.ndarray]] = {}
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    found: list[tuple[np.ndarray, ...]] = []
    rows = 0

    def judge() -> None:
        nonlocal rows
        if waiting and held:
            p, q = (np.concatenate(x) for x in zip(*waiting, strict=True))
            ids = np.unique(np.append(p, q))
            x, y = np.searchsorted(ids, p), np.searchsorted(ids, q)
            sizes = np.array([held[i][0] for i in ids.tolist()])
            both = overlaps([held[i][1] for i in ids.tolist()], np.stack([x, y], 1))
            j = both / (sizes[x] + sizes[y] - both)
            ok = j >= threshold - 1e-12
            found.append((p[ok], q[ok], j[ok]))
            rows += int(ok.sum())
        waiting.clear()

    def out() -> pa.RecordBatch:
        nonlocal rows
        p, q, j = (np.concatenate(x) for x in zip(*found, strict=True))
        found.clear()
        rows = 0
        return pa.RecordBatch.from_arrays([pa.array(p), pa.array(q), pa.array(j)], names=["a", "b", "jaccard"])

    for b in batches:
        if not b.num_rows:
            continue
        key, a, n = (b.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
        other = b.column(2).fill_null(0).to_numpy(zero_copy_only=False)
        is_set = np.asarray(b.column(4).is_valid())
        raw, offsets = K.column_bytes(b.column(4))
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        for lo, hi in zip(starts.tolist(), np.append(starts[1:], len(key)).tolist(), strict=True):
            if key[lo] != now:
                judge()
                now, held = int(key[lo]), {}
            k = lo + int(is_set[lo:hi].sum())
            for r in range(lo, k):
                held[int(a[r])] = int(n[r]), np.sort(raw[offsets[r] : offsets[r + 1]].view(np.uint64))
            if k < hi:
                waiting.append((a[k:hi], other[k:hi]))
        if rows >= 20_000:
            yield out()
    judge()
    if found:
        yield out()


def product(gram: np.ndarray, owner: np.ndarray, left: int, right: int) -> np.ndarray:
    """Overlaps of sets 0 to left - 1 with the ``right`` sets after them, or with themselves where right is 0; gram and owner have an entry a gram of a set.

    Grams that a sixteenth of the sets have are columns of a matrix, taken 1,024 at a time; of others the pairs of sets that have them are gone through.
    """
    out = np.zeros((left, right or left), np.float32)
    order = np.lexsort((owner, gram))
    gram, owner = gram[order], owner[order]
    begin = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
    count = np.diff(np.append(begin, len(gram)))
    dense = count >= max(2, (left + right) // 16)
    of = np.repeat(np.where(dense, np.cumsum(dense) - 1, -1), count)
    for lo in range(0, int(dense.sum()), 1024):
        mine = (of >= lo) & (of < lo + 1024)
        x = np.zeros((left + right, 1024), np.float32)
        x[owner[mine], of[mine] - lo] = 1
        out += x[:left] @ (x[left:] if right else x).T
    rest = np.repeat(~dense & (count > 1), count)
    gram, owner = gram[rest], owner[rest]
    for step in range(1, int(count[~dense].max(initial=0))):
        same = gram[step:] == gram[:-step]
        a, b = owner[:-step][same], owner[step:][same]
        if right:
            cross = (a < left) & (b >= left)
            np.add.at(out, (a[cross], b[cross] - left), np.float32(1))
        else:
            np.add.at(out, (a, b), np.float32(1))
            np.add.at(out, (b, a), np.float32(1))
    return out


def connected(similar: np.ndarray, square: bool) -> np.ndarray:
    """(node, node) edges, one less than nodes for each connected group of two nodes or more. Nodes are the rows, and unless ``square`` then the columns."""
    rows, columns = similar.shape
    back = similar if square else np.ascontiguousarray(similar.T)
    new = np.ones(rows if square else rows + columns, bool)
    edges: list[np.ndarray] = []
    for root in range(rows):
        if not new[root]:
            continue
        new[root] = False
        front = np.array([root])
        while len(front):
            if square:
                front = np.flatnonzero(similar[front].any(0) & new)
            else:
                left, right = front[front < rows], front[front >= rows] - rows
                reached = np.append(back[right].any(0), similar[left].any(0))
                front = np.flatnonzero(reached & new)
            new[front] = False
            edges.append(np.stack([np.full(len(front), root), front], 1))
    return np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], threshold: float, whole: bool) -> Iterator[pa.RecordBatch]:
    """Sets of blocks' parts (lo, hi, i, j, side, finger, n, here, grams), a cell's rows together and by side: 0 is one part with itself, 1 and 2 are one against the other.

    Whole: (a, b, jaccard, null) of all similar pairs. Else (a, b, null, null), edges that connect what is similar, and (a, null, null, links to documents).
    """
    now: tuple | None = None
    held: list[tuple[int, int, int, int, np.ndarray]] = []

    def judged() -> Iterator[pa.RecordBatch]:
        side, finger, size, here = (np.array([h[k] for h in held], np.int64) for k in range(4))
        left = int((side < 2).sum())
        right = len(held) - left
        if side[0] == 0 and right or side[0] == 1 and not right or side[0] == 2 or len(held) < 2:
            return  # no other side
        r = np.array([len(h[4]) for h in held])
        both = product(np.concatenate([h[4] for h in held]), np.repeat(np.arange(len(held)), r), left, right)
        columns = slice(left, None) if right else slice(None)
        similar = np.zeros(both.shape, bool)
        there = np.zeros(len(held))
        for lo in range(0, left, 256):
            s = both[lo : lo + 256].astype(np.float64)
            j = s / (size[:left][lo : lo + 256, None] + size[columns] - s)
            ok = j >= threshold - 1e-12
            if not right:
                ok[np.arange(len(ok)), lo + np.arange(len(ok))] = False
            if whole:
                x, y = np.nonzero(ok)
                value = j[x, y]
                x, y = x + lo, y + (left if right else 0)
                once = slice(None) if right else x < y
                a, b = finger[x[once]], finger[y[once]]
                yield rows(np.minimum(a, b), np.maximum(a, b), value[once], None)
                continue
            similar[lo : lo + 256] = ok
            weight = ok.astype(np.float64)
            there[:left][lo : lo + 256] = weight @ here[columns]
            if right:
                there[left:] += here[:left][lo : lo + 256] @ weight
        if not whole:
            edges = connected(similar, not right)
            yield rows(finger[edges[:, 0]], finger[edges[:, 1]], None, None)
            some = there > 0
            yield rows(finger[some], None, None, there[some].astype(np.int64))

    def rows(a: np.ndarray, b: np.ndarray | None, jaccard: np.ndarray | None, links: np.ndarray | None) -> pa.RecordBatch:
        arrays = [pa.nulls(len(a), t) if x is None else pa.array(x, t) for x, t in ((a, pa.int64()), (b, pa.int64()), (jaccard, pa.float64()), (links, pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, names=["a", "b", "jaccard", "links"])

    for b in batches:
        if not b.num_rows:
            continue
        lo, hi, i, j, side, finger, n, here = (b.column(k).to_pylist() for k in range(8))
        raw, offsets = K.column_bytes(b.column(8))
        for r, key in enumerate(zip(lo, hi, i, j, strict=True)):
            if key != now:
                if held:
                    yield from judged()
                now, held = key, []
            held.append((side[r], finger[r], n[r], here[r], raw[offsets[r] : offsets[r + 1]].view(np.uint64)))
    if held:
        yield from judged()


def _cells(blocks: DataFrame) -> DataFrame:
    """Of rows (home, other, mine, others, finger, n, here, grams): a set of a home in ``mine`` parts, once for each cell in which its part meets one of the other home's."""
    part, o = F.pmod(F.xxhash64("finger"), F.col("mine")).cast("int"), F.col("o")
    parts = blocks.withColumn("part", part).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    within, first = F.col("home") == F.col("other"), F.col("home") < F.col("other")
    swap = F.when(within, F.col("part") > o).otherwise(~first)
    side = F.when(within & (F.col("part") == o), 0).when(swap, 2).otherwise(1)
    return parts.select(
        F.least("home", "other").alias("lo"), F.greatest("home", "other").alias("hi"), F.when(swap, o).otherwise(F.col("part")).alias("i"), F.when(swap, F.col("part")).otherwise(o).alias("j"),
        side.alias("side"), "finger", "n", "here", "grams",
    )


def copies(members: DataFrame) -> DataFrame:
    """(finger, here): how many ids have a set."""
    return members.where("n > 0").distinct().groupBy("finger").agg(F.count("*").alias("here"))


def set_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, most: int = LIST, group: int = GROUP, hot_share: float = HOT_SHARE, hot_least: int = HOT_LEAST, few: int = FEW, cell: int = CELL, whole: bool = True, links: bool = True) -> tuple[DataFrame, DataFrame]:
    """Members (finger, n, doc_id), and pairs (a, b, jaccard, links) of different sets whose Jaccard is at least ``threshold``: all of them, a < b, links null.

    Unless ``whole``: pairs of which one is in no block, as above; of blocks, edges that connect what is similar (jaccard null), and for each set how many documents of blocks are similar to it (b null; without ``links`` these numbers mean nothing).
    Members has a row for each row of docs with an id; n is 0 where the text is null or has no words. ``most`` to ``cell`` say how work is cut up; no result depends on them.
    """
    spark = docs.sparkSession
    words = texts(docs, F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    seen = shared_table(words.mapInArrow(lambda it: _members(it, n, hot_share), "hot boolean, key bigint, n bigint, doc_id bigint"), "members")
    members = seen.where("NOT hot").select(F.col("key").alias("finger"), "n", "doc_id")
    total = members.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    often = seen.where("hot").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= max(hot_least, hot_share / 2 * total[0])).collect()  # bounded by the share
    hot = np.array([r["key"] for r in often], np.int64).view(np.uint64)
    by = np.argsort(hot)
    sent = spark.sparkContext.broadcast((hot[by], np.minimum(np.array([r["n"] for r in often], np.int64), 2**31).astype(np.uint32)[by]))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total[1]) // BUCKET_GRAMS))
    packs = "part int, finger binary, n binary, here binary, gram binary, class binary"
    grams = words.where("text <> ''").mapInArrow(lambda it: _by_gram(it, n, parts, *sent.value), packs).repartitionById(parts, "part")
    shared = shared_table(grams.mapInArrow(lambda it: _shared(it, parts), packs), "shared-grams")
    del grams
    release(spark)
    sets = shared_table(shared.repartitionById(parts, "part").mapInArrow(lambda it: _ordered(it, threshold), "finger bigint, n bigint, grams binary, classes binary, home bigint"), "sets")
    drop_table(shared)
    release(spark)
    grown = sets.groupBy("home").agg(F.count("*").alias("k"), F.sum(F.octet_length("grams") / 8).alias("r")).where(F.col("k") >= few)
    grown = cut(grown.select("home", F.ceil(F.greatest(F.col("k") / cell, F.col("r") / CELL_GRAMS)).cast("int").alias("cells")))
    known = grown.count()
    sets = sets.join(F.broadcast(grown) if known <= BROADCAST else grown, "home", "left").select("finger", "n", "grams", "classes", "home", F.coalesce("cells", F.lit(0)).alias("cells"))
    index = sets.mapInArrow(lambda it: _index(it, parts, most), _INDEX).repartitionById(parts, "part")
    met = cut(index.mapInArrow(lambda it: _candidates(it, threshold, group), "key bigint, a bigint, b bigint, cells int"))
    del index
    release(spark)
    candidates = met.where("cells = 0")
    asked = candidates.select("key", F.explode(F.array("a", "b")).alias("finger")).distinct()
    sides = asked.hint("shuffle_merge").join(sets.select("finger", "n", "grams"), "finger").select("key", F.col("finger").alias("a"), F.lit(None).cast("bigint").alias("b"), "n", "grams")
    both = sides.unionByName(candidates.select("key", "a", "b", F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("binary").alias("grams")))
    both = both.repartition("key").sortWithinPartitions("key", F.col("b").asc_nulls_first())
    pairs = both.mapInArrow(lambda it: _verify(it, threshold), "a bigint, b bigint, jaccard double").dropDuplicates(["a", "b"]).withColumn("links", F.lit(None).cast("bigint"))
    if not known:
        return members, pairs
    own = sets.where("cells > 0").select("finger", "n", "grams", "home", F.col("cells").alias("mine"))
    own = own.withColumn("here", F.lit(1)) if whole or not links else own.join(copies(members), "finger")
    across = own.join(met.where("cells > 0").select(F.col("a").alias("finger"), F.col("b").alias("other"), F.col("cells").alias("others")).distinct(), "finger")
    blocks = _cells(own.withColumns({"other": F.col("home"), "others": F.col("mine")}).unionByName(across))
    blocks = blocks.repartition("lo", "hi", "i", "j").sortWithinPartitions("lo", "hi", "i", "j", "side")
    return members, pairs.unionByName(blocks.mapInArrow(lambda it: _blocks(it, threshold, whole), "a bigint, b bigint, jaccard double, links bigint"))


def similar_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, **how: float) -> DataFrame:
    """(doc_a, doc_b, jaccard) with doc_a < doc_b: all pairs of ids whose n-gram sets have a Jaccard of at least ``threshold``, copies with each other too.

    k copies give k (k - 1) / 2 rows, so this is for tables without great groups of copies; ``classes`` says the same in a row a document.
    Rows with null id or text and texts without words have no pairs, however long texts are they count whole, and short ones (under n
    words) are one gram. Repeated rows, and rows that share an id, count under that id and are not paired with themselves; of an id's
    several texts the most similar counts. An empty table gives an empty result; columns other than doc_id and text are not looked at.
    """
    members, pairs = set_pairs(docs, n, threshold, **how)
    of = members.where("n > 0").select("finger", "doc_id").distinct()
    a, b = (of.select(F.col("finger").alias(x), F.col("doc_id").alias(f"doc_{x}")) for x in "ab")
    within = a.join(b, F.col("a") == F.col("b")).where("doc_a < doc_b").select("doc_a", "doc_b", F.lit(1.0).alias("jaccard"))
    across = pairs.join(a, "a").join(b, "b").where("doc_a <> doc_b").select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"), "jaccard")
    return within.unionByName(across).groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def groups(pairs: DataFrame) -> DataFrame:
    """(id, first) for what is in pairs (a, b): the lowest id of the connected group, by large-star and small-star rounds.

    Each round's edges are checkpointed in the shared folder; the number of rounds grows with the logarithm of a group's width.
    """
    edges = cut(pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select(F.least("e.u", "e.v").alias("u"), F.greatest("e.u", "e.v").alias("v")).where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("v").alias("id"), F.col("u").alias("first"))
        state = now


def _classes(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(finger, class_id): the lowest doc_id of the group that a set is in."""
    first = groups(pairs)
    low = members.where("n > 0").groupBy("finger").agg(F.min("doc_id").alias("low"))
    low = low.join(first, F.col("finger") == F.col("id"), "left").select("finger", "low", F.coalesce("first", "finger").alias("of"))
    return low.join(low.groupBy("of").agg(F.min("low").alias("class_id")), "of").select("finger", "class_id")


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, **how: float) -> DataFrame:
    """(doc_id, class_id, links): of each document the lowest doc_id of the group of similar documents that it is in, and how many are similar to it.

    Two documents are similar if the Jaccard of their n-gram sets is at least ``threshold``; a group is what such links connect. Links
    are counted to all documents, copies and others; no link is lost, and none is sampled. Documents without words or with a null text,
    and those like no other, are classes of their own with 0 links; rows with null id are left out; repeated rows give one row; an id
    with several texts gives a row for each of its sets; an empty table gives an empty result; other columns are not looked at.
    """
    members, found = set_pairs(docs, n, threshold, whole=False, **how)
    found = shared_table(found, "pairs")
    members = members.distinct()
    count = copies(members)
    pairs, single = found.where("b IS NOT NULL").select("a", "b"), found.where("jaccard IS NOT NULL")
    both = single.select("a", "b").unionByName(single.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = both.join(count, F.col("b") == F.col("finger")).select("a", "here").unionByName(found.where("links IS NOT NULL").select("a", F.col("links").alias("here")))
    more = more.groupBy("a").agg(F.sum("here").alias("there"))
    of = _classes(members, pairs).join(count, "finger").join(more, F.col("finger") == F.col("a"), "left")
    of = of.select("finger", "class_id", (F.col("here") - 1 + F.coalesce("there", F.lit(0))).alias("links"))
    mine = members.where("n > 0").join(of, "finger").select("doc_id", "class_id", "links")
    return mine.unionByName(members.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("links")))


def keep_first(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, **how: float) -> DataFrame:
    """docs without all but the lowest doc_id of each group of similar documents.

    Rows with null id or text and texts without words stay; all columns of docs stay, whatever their names. Rows that repeat an id stay or go together: they go
    if any of their texts has a group with a lower id. Long texts count whole; an empty table stays empty.
    """
    of = fresh(docs, "_gone")
    members, pairs = set_pairs(docs, n, threshold, whole=False, links=False, **how)
    gone = members.where("n > 0").join(_classes(members, pairs.where("b IS NOT NULL")), "finger").where("class_id < doc_id").select(F.col("doc_id").alias(of)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(of), "left_anti")


__all__ = ["classes", "groups", "keep_first", "overlaps", "set_pairs", "similar_pairs"]
