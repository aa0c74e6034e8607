"""SentencePiece encoding and decoding with a given byte-pair model, in vectorised merge rounds.

Text is cut where no piece of the model can reach across (before a run of spaces, around line ends, if the model's pieces allow
it), and each distinct segment of a slice of the corpus is encoded once. All segments' symbols lie in flat arrays. In a round each
segment's lowest rank among its adjacent pairs is found by a segmented minimum; all its pairs of that rank are merged, from the left where
they overlap; segments without a pair that the model joins leave, and the arrays are compacted. Characters that the model lacks
become byte pieces.
"""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm import kernels as K
from symgraph.llm.tables import texts

NONE = np.int32(2**31 - 1)
_MARK = "▁"


def default_model() -> str:
    """The public model's path: $SYMGRAPH_PIECES, or the installed vocabulary files."""
    found = os.environ.get("SYMGRAPH_PIECES")
    if found:
        return found
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, "piece_bpe_32k.model")


class Pieces:
    """Arrays made of a model's pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        piece = [sp.id_to_piece(i) for i in range(n)]
        usual = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        ids = {p: i for i, p in enumerate(piece) if usual[i]}
        rank = np.empty(n, np.int32)
        rank[np.lexsort((np.arange(n), [-sp.get_score(i) for i in range(n)]))] = np.arange(n)
        self.unknown = sp.unk_id()
        self.of_char = np.full(0x110000, -1, np.int32)
        self.of_byte = np.full(256, self.unknown, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.of_byte[int(piece[i][3:-1], 16)] = i
        keys, merged = [], []
        for p, i in ids.items():
            if len(p) == 1:
                self.of_char[ord(" " if p == _MARK else p)] = i
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(i)
        if self.of_char[ord(" ")] >= 0 and _MARK in ids:
            self.of_char[ord(_MARK)] = ids[_MARK]
        self.rank = rank
        self._hash(np.array(keys, np.int64), np.array(merged, np.int32))
        self.has_bytes = bool((self.of_byte != self.unknown).any())
        inner = [p for p in ids if _MARK in p.lstrip(_MARK)]
        self.cut_spaces, self.cut_lines = not inner, not any("\n" in p for p in ids)
        raw = [b"" if sp.is_control(i) else bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else " ⁇ ".encode() if i == self.unknown else p.replace(_MARK, " ").encode() for i, p in enumerate(piece)]
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.length = np.array([len(r) for r in raw], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def _hash(self, keys: np.ndarray, merged: np.ndarray) -> None:
        """An open-addressed table of pairs."""
        self.bits = max(8, int(len(keys) * 3).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] == -1
            slot, one = np.unique(at[free], return_index=True)
            put = left[free][one]
            self.keys[slot], self.values[slot] = keys[put], merged[put]
            stay = self.keys[at] != keys[left]
            left, at = left[stay], (at[stay] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * K.BASE) >> K.U64(64 - self.bits)).astype(np.int64)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two pieces make, or NONE."""
        keys = a.astype(np.int64) << 32 | b
        at = self._slot(keys)
        out, got = self.values[at], self.keys[at]
        open_ = np.flatnonzero((got != keys) & (got != -1))
        out[got != keys] = NONE
        at = at[open_]
        while len(open_):
            at = (at + 1) & (len(self.keys) - 1)
            got = self.keys[at]
            hit = got == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            on = ~hit & (got != -1)
            open_, at = open_[on], at[on]
        return out

    def segments(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of segments, in every row that isn't empty."""
        new = np.zeros(len(raw), bool)
        new[offsets[:-1][offsets[:-1] < len(raw)]] = True
        if self.cut_spaces:
            space = raw == 32
            new[1:] |= space[1:] & ~space[:-1]
        if self.cut_lines:
            line = raw == 10
            new |= line
            new[1:] |= line[:-1]
        return np.flatnonzero(new)

    def merge(self, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, piece) of what the symbols become; segment: ascending numbers. Negative symbols stay as they are."""
        place = np.arange(len(symbols))
        done_place, done_piece = [], []
        while len(symbols) > 1:
            ok = (segment[1:] == segment[:-1]) & (symbols[1:] >= 0) & (symbols[:-1] >= 0)
            made = np.full(len(symbols), NONE, np.int32)
            at = np.flatnonzero(ok)
            made[at] = self.join(symbols[at], symbols[at + 1])
            rank = np.full(len(symbols), NONE, np.int32)
            at = at[made[at] != NONE]
            rank[at] = self.rank[made[at]]
            heads = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
            lowest = np.minimum.reduceat(rank, heads)
            size = np.diff(np.append(heads, len(symbols)))
            live = np.repeat(lowest != NONE, size)
            if not live.all():
                done_place.append(place[~live])
                done_piece.append(symbols[~live])
                if not live.any():
                    break
            lowest = np.repeat(lowest, size)[live]
            symbols, segment, place, rank, made = symbols[live], segment[live], place[live], rank[live], made[live]
            chosen = np.flatnonzero(rank == lowest)
            run = np.append(True, chosen[1:] != chosen[:-1] + 1)
            nth = np.arange(len(chosen)) - np.maximum.accumulate(np.where(run, np.arange(len(chosen)), 0))
            chosen = chosen[nth % 2 == 0]
            symbols[chosen] = made[chosen]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            symbols, segment, place = symbols[keep], segment[keep], place[keep]
        else:
            done_place.append(place)
            done_piece.append(symbols)
        place, piece = np.concatenate(done_place), np.concatenate(done_piece)
        order = np.argsort(place, kind="stable")
        return place[order], piece[order]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, len(offsets) ends) of rows of UTF-8 bytes that begin with the space put before a text; a row of that space alone is an empty text."""
        starts = self.segments(raw, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        lengths = np.diff(np.append(starts, len(raw)))
        at = np.arange(len(raw)) - np.repeat(starts, lengths)
        hashes = K.mix(np.add.reduceat((raw.astype(K.U64) + K.U64(1)) * K.power_table(int(at.max()) + 1)[at], starts))
        _, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        # the distinct segments' bytes, then characters
        n = lengths[one]
        begin = np.cumsum(n) - n
        data = raw[np.repeat(starts[one] - begin, n) + np.arange(int(n.sum()))]
        number = np.repeat(np.arange(len(one)), n)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        head = data[lead].astype(np.int32)
        width = np.diff(np.append(lead, len(data)))
        code = np.where(width == 1, head, head & (0xFF >> (width + 1)))
        for k in range(1, 4):
            more = np.flatnonzero(width > k)
            code[more] = code[more] << 6 | (data[lead[more] + k] & 0x3F)
        place, piece = self.merge(self.of_char[code], number[lead])
        seg = number[lead][place]
        missing = piece < 0
        if missing.any():
            if self.has_bytes:
                times = np.where(missing, width[place], 1)
                which = np.repeat(np.arange(len(piece)), times)
                nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
                piece = np.where(missing[which], self.of_byte[data[np.minimum(lead[place[which]] + nth, len(data) - 1)]], piece[which])
                seg = seg[which]
            else:
                piece = np.where(missing, self.unknown, piece)
        count = np.bincount(seg, minlength=len(one))
        first = np.cumsum(count) - count
        times = count[back]
        ends = np.append(0, np.cumsum(times))
        out = piece[np.repeat(first[back] - ends[:-1], times) + np.arange(int(ends[-1]))]
        return out.astype(np.int32), ends[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of pieces, and len(ids) + 1 ends."""
        n = self.length[ids]
        ends = np.append(0, np.cumsum(n))
        return self.bytes[np.repeat(self.start[ids] - ends[:-1], n) + np.arange(int(ends[-1]))], ends


_LOADED: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    """The model's arrays, made once in a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def _encode_rows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = load(path)
    for b in batches:
        for lo, hi, raw, offsets in K.slices(b.column(1)):
            empty = np.diff(offsets) == 1
            ids, ends = model.encode(raw, offsets)
            if empty.any():
                keep = np.repeat(~empty, np.diff(ends))
                ids, ends = ids[keep], np.append(0, np.cumsum(np.where(empty, 0, np.diff(ends))))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(np.diff(ends).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), pa.array(_same(model, ids, ends, raw, offsets, empty))],
                names=["doc_id", "n_tokens", "ids", "round_trip"],
            )


def _same(model: Pieces, ids: np.ndarray, ends: np.ndarray, raw: np.ndarray, offsets: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """Whether each row's pieces decode to its bytes."""
    data, at = model.decode(ids)
    mine = at[ends]
    same = (np.diff(mine) == np.diff(offsets)) | empty
    if not empty.any() and same.all():
        wrong = np.flatnonzero(data != raw)
        same[np.searchsorted(offsets, wrong, "right") - 1] = False
        return same
    for r in np.flatnonzero(same & ~empty):
        same[r] = np.array_equal(data[mine[r] : mine[r + 1]], raw[offsets[r] : offsets[r + 1]])
    return same


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) for each row of docs with an id and a text.

    round_trip says whether decoding ids gives the text again. An empty text has no ids; rows with null id or text are left out;
    repeated rows are encoded each; an empty table gives an empty result; columns other than doc_id and text are not looked at.
    model: path of the model, which must be there on all executors.
    """
    path = model or default_model()
    spaced = texts(docs, F.concat(F.lit(" "), F.col("text")))
    return spaced.mapInArrow(lambda it: _encode_rows(it, path), "doc_id bigint, n_tokens int, ids array<int>, round_trip boolean")


def _decode_rows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = load(path)
    for b in batches:
        lists = b.column(1)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        count = np.where(np.asarray(lists.is_valid()), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
        data, at = model.decode(np.where((flat >= 0) & (flat < len(model.length)), flat, model.unknown).astype(np.int64))
        ends = at[np.append(0, np.cumsum(count))]
        raw = data.tobytes()
        out = [raw[s:e].decode("utf-8", "replace") for s, e in zip(ends, ends[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t[1:] if t[:1] == " " else t for t in out], pa.string(), mask=~np.asarray(lists.is_valid()))], names=["doc_id", "text"])


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): null ids give a null text, ids out of range the unknown sign, ill-formed bytes U+FFFD."""
    path = model or default_model()
    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(lambda it: _decode_rows(it, path), "doc_id bigint, text string")
