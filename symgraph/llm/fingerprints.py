"""Document fingerprints from prefix polynomial hashes.

A text's prefix arrays hold, for two prime moduli, the sums of its characters' code points times powers of a base. The difference
of two entries, brought to a common power, is the hash of a span, so equality of any two spans is one comparison; the longest common
extension of two places is found by binary search over their span hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm import kernels as K
from symgraph.llm.tables import texts

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 1299709)
OPENING = 64
_POWERS: list[np.ndarray] = [np.ones(1, K.U64), np.ones(1, K.U64)]


def powers(which: int, n: int) -> np.ndarray:
    """At least n powers of the base, by doubling."""
    p = K.U64(PRIMES[which])
    have = _POWERS[which]
    while len(have) < n:
        have = np.concatenate([have, have * (have[-1] * K.U64(BASES[which]) % p) % p])
    _POWERS[which] = have
    return have


class Prefixes:
    """Prefix arrays of one or more texts laid one after another; a span is given by its first character and its length."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.sums = []
        for k in (0, 1):
            p = K.U64(PRIMES[k])
            term = codes.astype(K.U64) * powers(k, self.n + 1)[: self.n] % p
            total = np.zeros(self.n + 1, K.U64)
            np.cumsum(term, out=total[1:])  # below 2**31 each, so 2**33 characters fit
            self.sums.append(total % p)

    def raised(self, start: np.ndarray, length: np.ndarray, to: np.ndarray, k: int) -> np.ndarray:
        """Hash of each span times the base to the power ``to``, which is counted from the text's first character."""
        p, s = K.U64(PRIMES[k]), self.sums[k]
        return (s[start + length] + p - s[start]) % p * powers(k, int(to.max()) + 1 if len(to) else 1)[to] % p

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the spans from a and from b of the given lengths are equal."""
        return np.logical_and(*(self.raised(a, length, b, k) == self.raised(b, length, a, k) for k in (0, 1)))

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The longest common extensions of places a and b, at most ``most`` long, by binary search."""
        lo, hi = np.zeros(len(a), np.int64), np.asarray(most, np.int64).copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live] + 1) >> 1
            same = self.equal(a[live], b[live], mid)
            lo[live] = np.where(same, mid, lo[live])
            hi[live] = np.where(same, hi[live], mid - 1)
            live = live[lo[live] < hi[live]]
        return lo

    def fingerprint(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """A span's hash by itself, of both moduli, as one number of 62 bits."""
        out = []
        for k in (0, 1):
            p = PRIMES[k]
            back = K.U64(pow(BASES[k], p - 2, p))
            inverse = np.ones(len(start), K.U64)
            e, base = start.astype(np.int64).copy(), back
            while e.any():
                inverse = np.where(e & 1, inverse * base % K.U64(p), inverse)
                e >>= 1
                base = base * base % K.U64(p)
            out.append((self.sums[k][start + length] + K.U64(p) - self.sums[k][start]) % K.U64(p) * inverse % K.U64(p))
        return (out[0] << K.U64(31) | out[1]).view(np.int64)


def _rows(batches: Iterator[pa.RecordBatch], opening: int) -> Iterator[pa.RecordBatch]:
    """Batches of (key, doc_id, text), sorted by key, doc_id and text; a leader's characters are kept until its key ends."""
    leader_key, leader_id, leader = None, 0, np.zeros(0, np.int32)
    for b in batches:
        for lo, hi, raw, offsets in K.slices(b.column(2)):
            keys = b.column(0).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
            ids = b.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.int64)
            codes, at = K.code_points(raw, offsets)
            n = np.diff(at)
            cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            carried = leader_key is not None and keys[0] == leader_key
            # the leader of an earlier slice is laid before this one's texts
            head = leader if carried else np.zeros(0, np.int32)
            every = Prefixes(np.concatenate([head, codes]))
            start = at[:-1] + len(head)
            first = np.repeat(cut, np.diff(np.append(cut, hi - lo)))
            l_start, l_n, l_id = start[first], n[first], ids[first]
            if carried:
                mine = slice(0, cut[1] if len(cut) > 1 else hi - lo)
                l_start[mine], l_n[mine], l_id[mine] = 0, len(head), leader_id
            most = np.minimum(n, l_n)
            common = every.extension(l_start, start, most)
            # keys are hashes of openings: another opening under the same key has no leader
            strange = common < np.minimum(most, opening)
            strange |= (n != l_n) & (most < opening)
            common = np.where(strange, n, common)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(n), pa.array(every.fingerprint(start, n)), pa.array(np.where(strange, ids, l_id)), pa.array(common)],
                names=["doc_id", "n", "fingerprint", "leader", "common"],
            )
            if not (carried and len(cut) == 1):
                i = int(cut[-1])
                leader_key, leader_id, leader = keys[-1], int(ids[i]), codes[at[i] : at[i + 1]].copy()


def fingerprints(docs: DataFrame, opening: int = OPENING) -> DataFrame:
    """(doc_id, n, fingerprint, leader, common) for each row of docs with an id and a text.

    n: characters; fingerprint: the whole text's hash; leader: the lowest doc_id of the texts with the same first ``opening``
    characters (all of them where the text is shorter); common: how many leading characters it has in common with the leader.
    Rows with null id or text are left out; empty texts have the fingerprint 0 and lead one another; repeated rows each have a row;
    of rows that repeat the lowest id the one with the least text leads; an empty table gives an empty result; columns other than
    doc_id and text are not looked at. The texts are shuffled once; a task holds one slice and one leader, however many texts
    share an opening.
    """
    keyed = texts(docs).select(F.xxhash64(F.substring("text", 1, opening)).alias("key"), "doc_id", "text")
    sorted_ = keyed.repartition("key").sortWithinPartitions("key", "doc_id", "text")
    return sorted_.mapInArrow(lambda it: _rows(it, opening), "doc_id bigint, n bigint, fingerprint bigint, leader bigint, common bigint")


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (doc_id, text, spans)."""
    for b in batches:
        for lo, hi, raw, offsets in K.slices(b.column(1)):
            codes, at = K.code_points(raw, offsets)
            lists = b.column(2).slice(lo, hi - lo)
            flat = lists.flatten()
            row = np.repeat(np.arange(hi - lo), lists.value_lengths().to_numpy(zero_copy_only=False))
            start, length = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            inside = (start >= 0) & (length >= 0) & (start + length <= np.diff(at)[row])
            row, start, length = row[inside], start[inside], length[inside]
            found = Prefixes(codes).fingerprint(at[row] + start, length)
            ids = b.column(0).slice(lo, hi - lo).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([ids, pa.array(start), pa.array(length), pa.array(found)], names=["doc_id", "start", "length", "fingerprint"])


def span_fingerprints(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, start, length, fingerprint) of the spans (doc_id, start, length), counted in characters; spans of one length are equal where their fingerprints are, wherever they stand.

    A text's prefix arrays are made once for all its spans. Spans that don't lie within their text, or with a null, or of a document that isn't there or
    has a null text, have no row; of an id's several texts each answers; empty spans have the fingerprint 0; repeated spans are answered
    once for each text; an empty table gives an empty result; other columns are not looked at.
    """
    asked = spans.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.struct(F.col("start").cast("bigint").alias("start"), F.col("length").cast("bigint").alias("length")).alias("s"))
    asked = asked.where("doc_id IS NOT NULL AND s.start IS NOT NULL AND s.length IS NOT NULL").groupBy("doc_id").agg(F.collect_set("s").alias("spans"))
    both = texts(docs).join(asked, "doc_id").select("doc_id", "text", "spans")
    return both.mapInArrow(_span_rows, "doc_id bigint, start bigint, length bigint, fingerprint bigint")
