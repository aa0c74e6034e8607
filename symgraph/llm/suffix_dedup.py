"""Repeated passages, by suffix sorting with prefix polynomial hashes.

A passage is a run of at least ``least`` words (white space aside, to the letter). Every word that lies in a window of ``least``
words which also stands elsewhere, in another document or in the same one, is found:

1. Anchors: of any ``least`` consecutive words, the lowest-hashed run of ``GRAM`` words is an anchor, so equal windows have equal
   anchors. Anchors whose hash is unique end here.
2. The words around the others (as many as a window of which it is the lowest can reach) are brought together by the anchor's hash.
3. There the suffixes that begin at the anchors are sorted by a merge sort. Two suffixes are compared in logarithmic time: binary
   search over their prefix hashes gives the longest common extension, and the next word decides. Extensions of neighbours are
   then verified word by word. Windows with l words before the anchor are equal where the suffixes lie in one run of extensions
   of at least ``least - l`` and the l words before are equal too (again by hash, then verified).
   A passage that very many documents share is not one task's: of an anchor with more than ``HOT`` places the windows travel by their
   hashes, one row each, and are counted by Spark's aggregation, which combines before it shuffles.
4. Of equal windows the one with the lowest (doc_id, position) is the first, the others are copies; overlapping windows of one
   kind make one span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm import kernels as K
from symgraph.llm.tables import fresh, only, shared_table, texts

LEAST, GRAM, HOT = 50, 16, 100_000
#: Undoes a multiplication by the hashes' base.
_UNBASE = K.U64(pow(int(K.BASE), -1, 1 << 64))


def anchors(words: np.ndarray, rows: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words at which anchors start, and the anchors' hashes. rows: the document of each word."""
    if len(words) < least:
        return np.zeros(0, np.int64), np.zeros(0, K.U64)
    grams = K.gram_hashes(words, gram)
    width = least - gram + 1
    lowest = K.sliding(grams, width, np.minimum)
    lowest[rows[: len(lowest)] != rows[least - 1 :]] = 0  # windows that run into the next document
    pad = np.zeros(width - 1, K.U64)
    chosen = np.flatnonzero((K.sliding(np.concatenate([pad, lowest, pad]), width, np.maximum) == grams) & (grams > 0))
    return chosen, grams[chosen]


def _anchor_rows(batches: Iterator[pa.RecordBatch], least: int, gram: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, raw, offsets in K.slices(b.column(1)):
            words, _, first = K.word_hashes(raw, offsets)
            rows = K.row_of(first, len(words))
            at, hashes = anchors(words, rows, least, gram)
            ids, keys = (b.column(i).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.int64)[rows[at]] for i in (0, 2))
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(ids), pa.array(keys), pa.array((at - first[rows[at]]).astype(np.int32))], names=["h", "doc_id", "key", "pos"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose h another row has too. Of the rows before a batch only the last is held, however many have one h."""
    last, sent = None, True
    for b in batches:
        if not b.num_rows:
            continue
        h = b.column(0).to_numpy(zero_copy_only=False)
        twice = np.zeros(len(h), bool)
        twice[1:] = h[1:] == h[:-1]
        twice[:-1] |= twice[1:]
        if last is not None and last.column(0)[0].as_py() == h[0]:
            twice[0] = True
            if not sent:
                yield last
        yield b.filter(pa.array(twice))
        last, sent = b.slice(b.num_rows - 1), bool(twice[-1])


def _contexts(batches: Iterator[pa.RecordBatch], least: int, gram: int) -> Iterator[pa.RecordBatch]:
    left, width = least - gram, 2 * least - gram
    for b in batches:
        at_all = b.column(3)
        for lo, hi, raw, offsets in K.slices(b.column(1)):
            words, _, first = K.word_hashes(raw, offsets)
            lists = at_all.slice(lo, hi - lo)
            flat = lists.flatten()
            row = np.repeat(np.arange(hi - lo), lists.value_lengths().to_numpy(zero_copy_only=False))
            pos, h = flat.field("pos").to_numpy(zero_copy_only=False).astype(np.int64), flat.field("h").to_numpy(zero_copy_only=False)
            counts = np.diff(first)
            fits = pos + gram <= counts[row]
            row, pos, h = row[fits], pos[fits], h[fits]
            start = first[row] + pos
            if len(start):
                grams = K.gram_hashes(words, gram)
                grams = np.concatenate([np.zeros(left, K.U64), grams, np.zeros(left, K.U64)])
            ids, keys = (b.column(i).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 2))
            before, after = np.minimum(pos, left), np.minimum(counts[row] - pos, least)
            for c in range(0, len(start), 8192):  # a window counts where this anchor is its lowest, as it then is in all equal windows
                s = slice(c, c + 8192)
                lower = grams[start[s, None] + np.arange(2 * left + 1)] < h[s].view(K.U64)[:, None]
                on_left, on_right = lower[:, :left][:, ::-1], lower[:, left + 1 :]
                before[s] = np.minimum(before[s], np.where(on_left.any(1), on_left.argmax(1), left))
                after[s] = np.minimum(after[s], gram + np.where(on_right.any(1), on_right.argmax(1), left))
            short = np.concatenate([np.zeros(left, np.uint32), (words >> K.U64(32)).astype(np.uint32), np.zeros(least, np.uint32)])
            for c in range(0, len(start), 8192):
                s = slice(c, c + 8192)
                around = short[start[s, None] + np.arange(width)]
                around[(np.arange(width) < left - before[s, None]) | (np.arange(width) >= left + after[s, None])] = 0  # no window reaches these
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[s]), pa.array(ids[row[s]]), pa.array(keys[row[s]]), pa.array(pos[s].astype(np.int32)), pa.array(before[s].astype(np.int32)), pa.array(after[s].astype(np.int32)), K.binaries(around.reshape(-1), np.full(len(around), width))],
                    names=["h", "doc_id", "key", "pos", "before", "after", "around"],
                )


class Suffixes:
    """Rows of words, compared from their first word on by prefix hashes."""

    def __init__(self, words: np.ndarray):
        self.words = words
        n, self.width = words.shape
        self.prefix = np.zeros((n, self.width + 1), K.U64)
        np.cumsum((words.astype(K.U64) + K.U64(1)) * K.power_table(self.width)[: self.width], axis=1, out=self.prefix[:, 1:])

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common extensions of rows a and b, by binary search over equal prefix hashes."""
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), self.width)
        for _ in range(int(self.width).bit_length()):
            mid = (lo + hi + 1) >> 1
            equal = self.prefix[a, mid] == self.prefix[b, mid]
            lo, hi = np.where(equal, mid, lo), np.where(equal, hi, mid - 1)
        return lo

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        e = self.extension(a, b)
        at = np.minimum(e, self.width - 1)
        return np.where(e == self.width, or_equal, self.words[a, at] < self.words[b, at])

    def sort(self, group: np.ndarray) -> np.ndarray:
        """The order of the rows by words within each group (equal rows keep theirs). group: ascending numbers."""
        n = len(group)
        order = np.arange(n)
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
        begin = np.repeat(starts, np.diff(np.append(starts, n)))
        end = np.repeat(np.append(starts[1:], n)[: len(starts)], np.diff(np.append(starts, n)))
        run = 1
        while True:
            live = np.flatnonzero(end - begin > run)
            if not len(live):
                return order
            b, e = begin[live], end[live]
            mine = (live - b) // run  # the number of the run; even ones are merged with the next
            is_left = mine % 2 == 0
            l0 = b + (mine - mine % 2) * run
            l1 = np.minimum(l0 + run, e)
            r1 = np.minimum(l1 + run, e)
            other0, other1 = np.where(is_left, l1, l0), np.where(is_left, r1, l1)
            lo, hi = other0.copy(), other1.copy()
            me = order[live]
            for _ in range(run.bit_length() + 1):
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                # elements of the other run that come before: strictly less for the left run, less or equal for the right
                before = self.less(order[mid], me[open_], ~is_left[open_])
                lo[open_] = np.where(before, mid + 1, lo[open_])
                hi[open_] = np.where(before, hi[open_], mid)
            place = l0 + (live - np.where(is_left, l0, l1)) + (lo - other0)
            moved = order.copy()
            moved[place] = me
            order = moved
            run *= 2

    def neighbours(self, order: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Extension of each row in the order with the one before it, verified word by word; 0 where a group starts."""
        out = np.zeros(len(order), np.int64)
        if len(order) > 1:
            a, b = order[:-1], order[1:]
            e = self.extension(a, b)
            differ = (self.words[a] != self.words[b]) & (np.arange(self.width) < e[:, None])
            e = np.where(differ.any(1), differ.argmax(1), e)
            out[1:] = np.where(group[a] == group[b], e, 0)
        return out


def window_spans(group: np.ndarray, doc: np.ndarray, key: np.ndarray, pos: np.ndarray, before: np.ndarray, after: np.ndarray, around: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """(doc, key, start, end, copy) of unions of repeated windows that hold each anchor. Rows in the order of (group, doc, key, pos), none twice."""
    left, n = least - gram, len(group)
    suffixes = Suffixes(around[:, left:])
    order = suffixes.sort(group)
    common = suffixes.neighbours(order, group)
    behind = np.zeros((n, left + 1), K.U64)  # hashes of the l words before the anchor
    np.cumsum((around[:, :left][:, ::-1].astype(K.U64) + K.U64(1)) * K.power_table(left)[:left], axis=1, out=behind[:, 1:])
    far, near = np.full((2, n), -1), np.full((2, n), least + 1)
    for l in range(left + 1):
        run = np.empty(n, np.int64)
        run[order] = np.cumsum(common < least - l)
        live = np.flatnonzero((before >= l) & (after >= least - l))
        kind_of = K.mix(run[live].astype(K.U64) * K.BASE ^ behind[live, l])
        by = np.argsort(kind_of, kind="stable")
        live, kind_of = live[by], kind_of[by]
        head = np.append(True, kind_of[1:] != kind_of[:-1]) if len(kind_of) else np.zeros(0, bool)
        first = live[np.maximum.accumulate(np.where(head, np.arange(len(live)), 0))] if len(live) else live
        alone = head & np.append(head[1:], True) if len(head) else head
        live, first, head = live[~alone], first[~alone], head[~alone]
        if l and len(live):
            true = (around[live, left - l : left] == around[first, left - l : left]).all(1)
            live, first, head = live[true], first[true], head[true]
        for kind, rows in ((1, live[~head]), (0, live[head])):
            far[kind, rows] = l
            near[kind, rows] = np.minimum(near[kind, rows], l)
    out = []
    for kind in (0, 1):
        r = np.flatnonzero(far[kind] >= 0)
        out.append((doc[r], key[r], pos[r] - far[kind, r], pos[r] + least - near[kind, r], np.full(len(r), kind == 1)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _windows(batches: Iterator[pa.RecordBatch], least: int, gram: int) -> Iterator[pa.RecordBatch]:
    width = 2 * least - gram
    for b in K.whole_groups(batches, "h", 20_000):
        h, doc, key, pos, before, after = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6))
        around = K.column_bytes(b.column(6))[0].view(np.uint32).reshape(-1, width)
        order = np.lexsort((pos, key, doc, h))
        h, doc, key, pos = h[order], doc[order], key[order], pos[order]
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])
        order = order[once]
        h = h[once]
        group = np.cumsum(np.append(True, h[1:] != h[:-1])) if len(h) else h
        d, k, s, e, copy = window_spans(group, doc[once], key[once], pos[once], before[order], after[order], around[order], least, gram)
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(k), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(copy)], names=["doc_id", "key", "start_word", "end_word", "copy"])


def _window_rows(batches: Iterator[pa.RecordBatch], least: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows of contexts to a row (kind, doc_id, key, pos, l) for each of their windows; kind is the window's hash with that of its anchor and its place in it."""
    left, width = least - gram, 2 * least - gram
    back = K.powers(left + 1, _UNBASE)
    for b in batches:
        for c in range(0, b.num_rows, 4096):
            part = b.slice(c, 4096)
            h, doc, key, pos, before, after = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6))
            around = K.column_bytes(part.column(6))[0].view(np.uint32).reshape(-1, width)
            prefix = np.zeros((len(h), width + 1), K.U64)
            np.cumsum((around.astype(K.U64) + K.U64(1)) * K.power_table(width)[:width], axis=1, out=prefix[:, 1:])
            found = []
            for l in range(left + 1):
                live = np.flatnonzero((before >= l) & (after >= least - l))
                start = left - l
                window = (prefix[live, start + least] - prefix[live, start]) * back[start]
                found.append((K.mix(K.mix(window) ^ h[live].view(K.U64) * K.BASE + K.U64(l)).view(np.int64), doc[live], key[live], pos[live], np.full(len(live), l)))
            kind, doc, key, pos, place = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(doc), pa.array(key), pa.array(pos.astype(np.int32)), pa.array(place.astype(np.int32))], names=["kind", "doc_id", "key", "pos", "l"])


def _hot_spans(around: DataFrame, least: int, gram: int) -> DataFrame:
    """The same as ``_windows`` for anchors with any number of places, by aggregation."""
    each = around.dropDuplicates(["h", "doc_id", "key", "pos"]).mapInArrow(lambda it: _window_rows(it, least, gram), "kind bigint, doc_id bigint, key bigint, pos int, l int")
    me = F.struct("doc_id", "key", "pos")
    first = each.groupBy("kind").agg(F.count("*").alias("_n"), F.min(me).alias("_first")).where("_n > 1").select("kind", "_first")
    both = each.hint("shuffle_merge").join(first, "kind").withColumn("copy", me != F.col("_first"))
    reach = both.groupBy("doc_id", "key", "pos", "copy").agg(F.max("l").alias("_far"), F.min("l").alias("_near"))
    return reach.select("doc_id", "key", (F.col("pos") - F.col("_far")).alias("start_word"), (F.col("pos") + least - F.col("_near")).alias("end_word"), "copy")


def _islands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in K.whole_groups(batches, "doc_id", 20_000):
        doc, key, s, e, copy = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
        order = np.lexsort((s, copy, key, doc))
        doc, key, s, e, copy = doc[order], key[order], s[order], e[order], copy[order]
        part = np.cumsum(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (copy[1:] != copy[:-1])))
        reach = np.maximum.accumulate(e + part * (1 << 40))
        head = np.append(True, s[1:] + part[1:] * (1 << 40) > reach[:-1])
        at = np.flatnonzero(head)
        last = np.append(at[1:], len(doc)) - 1
        yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(key[at]), pa.array(s[at].astype(np.int32)), pa.array((reach[last] - part[last] * (1 << 40)).astype(np.int32)), pa.array(copy[at] == 1)], names=["doc_id", "key", "start_word", "end_word", "copy"])


def _spans(docs: DataFrame, least: int, gram: int, hot: int = HOT) -> DataFrame:
    """(doc_id, key, start_word, end_word, copy); key is the text's hash, so rows that share an id with other texts are told apart."""
    spans_type = "doc_id bigint, key bigint, start_word int, end_word int, copy boolean"
    text = texts(docs).withColumn("key", F.xxhash64("text"))
    found = text.mapInArrow(lambda it: _anchor_rows(it, least, gram), "h bigint, doc_id bigint, key bigint, pos int")
    found = shared_table(found.repartition("h").sortWithinPartitions("h").mapInArrow(_repeated, "h bigint, doc_id bigint, key bigint, pos int"), "anchors")
    many = found.groupBy("h").agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select("h")
    asked = found.groupBy("doc_id", "key").agg(F.collect_list(F.struct("pos", "h")).alias("at"))
    around = text.hint("shuffle_merge").join(asked, ["doc_id", "key"]).select("doc_id", "text", "key", "at")
    around = around.mapInArrow(lambda it: _contexts(it, least, gram), "h bigint, doc_id bigint, key bigint, pos int, before int, after int, around binary")
    if many.isEmpty():
        few, rest = around, None
    else:
        many = shared_table(many, "hot-anchors")
        few, rest = around.join(many, "h", "left_anti"), around.join(many, "h", "left_semi")
    spans = few.repartition("h").sortWithinPartitions("h").mapInArrow(lambda it: _windows(it, least, gram), spans_type)
    spans = spans if rest is None else spans.unionByName(_hot_spans(rest, least, gram))
    return spans.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(_islands, spans_type)


def repeated_spans(docs: DataFrame, least: int = LEAST, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, start_word, end_word, copy): spans of words that lie in repeated windows of ``least`` words.

    copy is false for spans of windows that are the first of their kind (lowest doc_id, then position) and true for the others, so a
    passage may be in a span of either kind. Rows with null id or text, and texts of fewer than ``least`` words, have no spans; rows
    that repeat an id and its text count as one occurrence, and texts that share an id are texts of their own, the order among them that of their hashes;
    long texts count whole; an empty table gives an empty result; other columns are not looked at. ``hot`` says how work is cut up; no result depends on it.
    """
    return _spans(docs, least, gram, hot).drop("key")


def _cut(batches: Iterator[pa.RecordBatch], named: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = b.schema.get_field_index("text")
        keep = np.ones(b.num_rows, bool)
        texts_, spans = b.column(at).to_pylist(), b.column(b.schema.get_field_index(named)).to_pylist()
        for i, (text, cuts) in enumerate(zip(texts_, spans, strict=True)):
            if not cuts or text is None:
                continue
            raw = text.encode()
            starts, _ = K.word_starts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            ends, parts, done = np.append(starts, len(raw)), [], 0
            for c in sorted(cuts, key=lambda c: c["start_word"]):
                if c["start_word"] < len(starts):
                    parts.append(raw[done : ends[c["start_word"]]])
                    done = int(ends[min(c["end_word"], len(starts))])
            left = b"".join([*parts, raw[done:]])
            keep[i] = bool(left.strip(b" \t\n\r\x0b\x0c"))
            texts_[i] = left.decode()
        columns = [pa.array(texts_, pa.string()) if n == at else c for n, c in enumerate(b.columns)]
        yield pa.RecordBatch.from_arrays(columns, schema=b.schema).filter(pa.array(keep))


def without_copies(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """docs with the copies of repeated passages cut out of text; the first of each passage stays.

    A document of which no word is left goes; all others stay, those with null id or text and empty ones as they are. Rows that repeat an id and its text are
    cut alike, and rows that share an id with other texts are each cut by their own spans. n_chars, where docs has it as
    a column, is counted anew for changed texts. All columns of docs stay, in their order; an empty table stays empty.
    """
    names = docs.columns
    at, of, key = fresh(docs, "_spans"), fresh(docs, "_of"), fresh(docs, "_key")
    cuts = _spans(docs, least, gram).where("copy").groupBy(F.col("doc_id").alias(of), F.col("key").alias(key)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(at))
    both = docs.join(cuts, (F.col("doc_id") == F.col(of)) & (F.xxhash64(F.col("text").cast("string")) == F.col(key)), "left").select(*[f"`{n}`" for n in names], at)
    out = both.mapInArrow(lambda it: _cut(it, at), both.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(at).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return only(out, names)
