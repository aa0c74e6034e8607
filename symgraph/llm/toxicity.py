"""Toxic documents, by a support vector machine over a gap-weighted subsequence string kernel with Nyström landmarks.

The kernel of two words is the inner product of their subsequences of three letters, each gap at most ``REACH - 1`` letters, weighed
by ``DECAY`` to the power of the span, over the norms. Marks before and after the word count as letters; accents are folded, and
characters that are neither letters nor digits are dropped, so "i.d.i.o.t" reads as the word; a run of three or more single letters
reads as one word. A letter put into a word only widens the gaps of some subsequences, so the kernel stays high.

Labels are of documents; their sentences' words inherit them in a first step: a beginning of a word that marks toxic documents far
beyond chance marks the words of toxic documents that begin so as positive; words of clean documents are negative. Then landmarks
are chosen among both, and a squared-hinge machine is trained in the landmarks' space; the clean words nearest to the margin join
the negatives in a second round. As the decision is linear in the subsequences, landmarks and weights fold into one table, which
is all that scoring needs. A document's score is that of its most toxic word; toxic means above 0.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm import kernels as K
from symgraph.llm.tables import only, texts

REACH, DECAY, LANDMARKS = 3, 0.6, 256
#: Words are read in windows of so many letters, so many apart.
WIDEST, STEP = 7, 4
#: The training sample: at most so many labelled documents, and so many bytes of each.
MOST_LABELLED = 4000
PAIRS = [(a, b) for a in range(1, REACH + 1) for b in range(1, REACH + 1)]

_DROP, _OTHER, _DIGIT, _INSIDE = 255, 27, 28, 29
_FOLD = {"a": "àáâãäåæ", "c": "ç", "e": "èéêë", "i": "ìíîï", "n": "ñ", "o": "òóôõöø", "u": "ùúûü", "y": "ýÿ", "s": "ß"}
CLASS = np.full(256, _DROP, np.uint8)
for _i in range(26):
    CLASS[65 + _i] = CLASS[97 + _i] = _i + 1
CLASS[48:58] = _DIGIT
#: Of the characters U+00C0 to U+00FF, by the byte that ends them.
_LATIN = np.full(256, _OTHER, np.uint8)
_LATIN[[0x97, 0xB7]] = _DROP  # the signs of multiplication and division
for _base, _letters in _FOLD.items():
    for _c in _letters + _letters.upper():
        if len(_c) == 1 and _c.encode()[0] == 0xC3:
            _LATIN[_c.encode()[1]] = ord(_base) - 96


@dataclass
class Model:
    table: np.ndarray  # the weight of each subsequence, 32 * 32 * 32
    bias: float


def _wide_characters(raw: np.ndarray, classes: np.ndarray) -> None:
    """Classes of characters beyond ASCII, at their last bytes: Latin letters with accents are folded, signs, spaces and pictures are dropped, letters of other scripts are one class of their own."""
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    end = np.append(lead[1:], len(raw)) - 1
    wide = raw[lead] > 127
    lead, end = lead[wide], end[wide]
    one, two = raw[lead], raw[np.minimum(lead + 1, len(raw) - 1)]
    kind = np.where(one == 0xC3, _LATIN[raw[end]], _OTHER)
    sign = (one == 0xC2) | ((one == 0xE2) & (two < 0xB0)) | ((one == 0xE3) & (two == 0x80)) | ((one == 0xF0) & (two == 0x9F))
    classes[end] = np.where(sign, _DROP, kind)


def fold(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all letters, and for each word its start among them and (last entry: end); and each row's first word."""
    starts, first = K.word_starts(raw, offsets)
    classes = CLASS[raw]
    if len(raw) and raw.max() > 127:
        _wide_characters(raw, classes)
    kept = np.append(0, np.cumsum(classes != _DROP))
    begin = np.append(kept[starts], kept[-1])
    return classes[classes != _DROP], begin, first


def units(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, start, length, marks) of the windows of WIDEST letters, STEP apart, that words are scored by; words of under three letters have none.

    marks: 0 where the window is the whole word, 1 where it has only the word's start, 2 only its end, 3 neither.
    """
    word = np.flatnonzero(length >= 3)
    n = length[word]
    count = np.maximum(1, -(-(n - 3) // STEP))
    of = np.repeat(np.arange(len(word)), count)
    at = STEP * (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
    size = np.minimum(WIDEST, n[of] - at)
    return word[of], start[word[of]] + at, size, 2 * (at > 0) + (at + size < n[of])


def _single_runs(length: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, words) of runs of at least three words of one letter each in a row of the table."""
    same = np.zeros(len(length) + 1, bool)
    single = length == 1
    same[1:-1] = single[1:] & single[:-1] & (row[1:] == row[:-1])
    edge = np.flatnonzero(np.diff(same.astype(np.int8)))
    first, n = edge[::2], edge[1::2] - edge[::2] + 1
    return first[n >= 3], n[n >= 3]


def _matrix(classes: np.ndarray, start: np.ndarray, length: int, marks: np.ndarray) -> np.ndarray:
    """Units of one length as rows of classes between marks."""
    out = np.zeros((len(start), length + 2), np.int32)
    out[:, 0] = np.where(marks & 2, _INSIDE, 0)
    out[:, -1] = np.where(marks & 1, _INSIDE, 0)
    out[:, 1:-1] = classes[start[:, None] + np.arange(length)]
    return out


def _subsequences(words: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Numbers of the subsequences with each pair of steps, and their weight."""
    n = words.shape[1]
    for a, b in PAIRS:
        if a + b < n:
            yield (words[:, : n - a - b] << 10) | (words[:, a : n - b] << 5) | words[:, a + b :], DECAY ** (a + b + 1)


def features(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, subsequence, weight), each subsequence of a row once, over the row's norm."""
    found = list(_subsequences(words))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    u = np.concatenate([x.ravel() for x, _ in found]).astype(np.int64)
    row = np.concatenate([np.repeat(np.arange(len(words)), x.shape[1]) for x, _ in found])
    weight = np.concatenate([np.full(x.size, w) for x, w in found])
    key, at = np.unique(row << 15 | u, return_inverse=True)
    total = np.bincount(at, weight)
    row = key >> 15
    return row, key & 32767, total / np.sqrt(np.bincount(row, total**2, minlength=len(words)))[row]


def decide(model: Model, words: np.ndarray) -> np.ndarray:
    """The machine's decision for units of one length.

    The norm is only worked out where the sum of squares, which is never more than the squared norm, leaves a chance of a positive.
    """
    total, square = np.zeros(len(words)), 0.0
    for u, w in _subsequences(words):
        total += w * model.table[u].sum(1)
        square += w * w * u.shape[1]
    got = total / np.sqrt(square) + model.bias
    near = np.flatnonzero(got > 0) if model.bias < 0 else np.arange(len(words))
    if len(near):
        row, u, w = features(words[near])
        got[near] = np.bincount(row, w * model.table[u], minlength=len(near)) + model.bias
    return got


def scores(model: Model, classes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The highest decision among each word's units; words of under three letters get -inf."""
    out = np.full(len(start), -np.inf)
    word, at, size, marks = units(start, length)
    for n in np.unique(size):
        i = np.flatnonzero(size == n)
        np.maximum.at(out, word[i], decide(model, _matrix(classes, at[i], int(n), marks[i])))
    return out


def _fold_text(text: str) -> set[str]:
    """The units of a text as strings of letters and marks."""
    raw = np.frombuffer(text.encode(), np.uint8)
    classes, begin, first = fold(raw, np.array([0, len(raw)]))
    start, length = begin[:-1], np.diff(begin)
    head, n = _single_runs(length, K.row_of(first, len(start)))
    word, at, size, marks = units(np.append(start, start[head]), np.append(length, n))
    letters = (classes + 96).tobytes().decode("latin-1")
    side = "`", chr(96 + _INSIDE)
    return {side[m >> 1] + letters[a : a + k] + side[m & 1] for a, k, m in zip(at.tolist(), size.tolist(), marks.tolist(), strict=True)}


def _evident(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int) -> set[str]:
    """Beginnings of words whose share of toxic documents chance can't explain."""
    prior = n_toxic / (n_toxic + n_clean)
    out = set()
    for p, a in toxic.items():
        share = a / (a + clean[p])
        if a >= 5 and share >= 0.9:
            rest = (1 - share) * np.log((1 - share) / (1 - prior)) if share < 1 else 0
            if (a + clean[p]) * (share * np.log(share / prior) + rest) > 10:
                out.add(p)
    return out


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    length = np.array([len(w) for w in words], np.int64)
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        yield at, np.frombuffer("".join(words[i] for i in at).encode("latin-1"), np.uint8).reshape(-1, n).astype(np.int32) - 96


def decisions(model: Model, words: list[str]) -> np.ndarray:
    out = np.full(len(words), -np.inf)
    for at, matrix in _by_length(words):
        out[at] = decide(model, matrix)
    return out


def _feature_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = []
    for at, matrix in _by_length(words):
        row, u, w = features(matrix)
        parts.append((at[row], u, w))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _against(words: list[str], landmarks: np.ndarray) -> np.ndarray:
    """Kernel of words with landmarks (rows of features)."""
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for c in range(0, len(words), 250):
        row, u, w = _feature_rows(words[c : c + 250])
        order = np.argsort(row, kind="stable")
        row, u, w = row[order], u[order], w[order]
        heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        out[c + row[heads]] = np.add.reduceat(landmarks[:, u].T * w[:, None].astype(np.float32), heads)
    return out


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 10.0) -> np.ndarray:
    """Weights and bias (last) of a squared-hinge machine, by Newton steps."""
    z = np.column_stack([z, np.ones(len(z))]).astype(np.float64)
    w = np.zeros(z.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        live = y * (z @ w) < 1
        zl, c = z[live], penalty * weight[live]
        new = np.linalg.solve(ridge + zl.T @ (zl * c[:, None]), zl.T @ (c * y[live]))
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def _beginnings(unit: str) -> list[str]:
    """The beginnings, of at least four letters, of a unit that starts a word; the whole unit too, so with its end."""
    return [unit[:k] for k in range(5, len(unit))] + [unit] if unit[0] == "`" else []


def _spread(words: list[str], n: int) -> list[str]:
    return sorted(words, key=lambda w: hashlib.md5(w.encode()).digest())[:n]


def _distinct(bags: list[tuple[set[str], int]]) -> list[tuple[set[str], int]]:
    """bags without near copies of earlier ones: else each rare word of a copied toxic document would seem to mark many."""
    kept: list[tuple[set[str], int]] = []
    by: dict[int, list[int]] = {}
    for words, y in bags:
        low = sorted(zlib.crc32(w.encode("latin-1")) for w in words)[:8]
        if any(len(words & kept[i][0]) > 0.4 * min(len(words), len(kept[i][0])) for i in {i for k in low for i in by.get(k, ())}):
            continue
        for k in low:
            by.setdefault(k, []).append(len(kept))
        kept.append((words, y))
    return kept


def fit(rows: list[tuple[str, int]], landmarks: int = LANDMARKS) -> Model:
    """A model from (text, toxic) rows. With too little evidence of either kind it finds nothing toxic."""
    return _fit([(_fold_text(t), y) for t, y in rows if t is not None and y is not None], landmarks)


def _fit(labelled: list[tuple[set[str], int]], landmarks: int = LANDMARKS) -> Model:
    never = Model(np.zeros(32768, np.float32), -1.0)
    bags = _distinct(labelled)
    n_toxic = sum(y == 1 for _, y in bags)
    n_clean = len(bags) - n_toxic
    if not n_toxic or not n_clean:
        return never
    seen = (Counter(), Counter())
    for words, y in bags:
        seen[y == 1].update({p for w in words for p in _beginnings(w)})
    evident = _evident(seen[1], seen[0], n_toxic, n_clean)
    clean = Counter(w for words, y in bags if y != 1 for w in words)
    marked = Counter(w for words, y in bags if y == 1 for w in words if w not in clean and any(p in evident for p in _beginnings(w)))
    if not marked or not clean:
        return never
    positive = [w for w, _ in marked.most_common(4000)]
    padded = {p: n for w, n in marked.most_common(200) if len(w) > 5 for k in (len(w) // 2, len(w) // 2 + 1) for c in "aejqx" if (p := w[:k] + c + w[k:]) not in clean}
    every = list(clean)
    negative = [w for w, _ in clean.most_common(3000)] + _spread(every, 9000)
    near = _spread(every, 40_000)
    model = never
    for again in range(3):
        half = landmarks // 2
        marks = list(dict.fromkeys(positive[: half // 2] + _spread(positive, half - half // 2) + (negative[-half:] if again else _spread(negative, half))))
        row, u, w = _feature_rows(marks)
        phi = np.zeros((len(marks), 32768), np.float32)
        phi[row, u] = w
        values, vectors = np.linalg.eigh((phi @ phi.T).astype(np.float64))
        ok = values > 1e-6
        root = vectors[:, ok] / np.sqrt(values[ok])
        sample = positive + list(padded) + negative
        y = np.array([1.0] * (len(positive) + len(padded)) + [-1.0] * len(negative))
        # Words weigh by the documents that they mark (their number, or its root where they mark none), both kinds alike in all.
        weight = np.array([float(marked[w]) for w in positive] + [0.1 * n for n in padded.values()] + [1.0 + clean[w] ** 0.5 for w in negative])
        weight *= 0.5 * len(y) / np.where(y > 0, weight[y > 0].sum(), weight[y < 0].sum())
        solved = _svm(_against(sample, phi) @ root, y, weight)
        model = Model((phi.T @ (root @ solved[:-1])).astype(np.float32), float(solved[-1]))
        if again < 2:
            pool = every if again else near
            got = decisions(model, pool)
            hard = np.argsort(-got, kind="stable")[:3000]
            negative = list(dict.fromkeys(negative + [pool[i] for i in hard[::-1]]))
    # The threshold lies where documents of the sample are told apart best, in the widest such gap, nearer to the clean side: a
    # letter put into an insult lowers its score.
    known = sorted({w for words, _ in bags for w in words})
    value = dict(zip(known, decisions(model, known).tolist(), strict=True))
    tops = np.array([max((value[w] for w in words), default=-np.inf) for words, _ in bags])
    truth = np.array([y == 1 for _, y in bags])
    order = np.argsort(-tops, kind="stable")
    wrong = n_toxic + np.append(0, np.cumsum(np.where(truth[order], -1, 1)))
    best = np.flatnonzero(wrong == wrong.min())
    best = best[(best > 0) & (best < len(order))]
    if len(best):
        upper, lower = tops[order[best - 1]], tops[order[best]]
        i = int(np.argmax(np.where(np.isfinite(lower), upper - lower, 0)))
        if np.isfinite(lower[i]):
            model.bias -= float(lower[i] + 0.3 * (upper[i] - lower[i]))
    return model


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct units of whole texts."""
    for b in batches:
        units = [sorted(_fold_text(t)) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(units, pa.list_(pa.string())), b.column(2)], names=["doc_id", "units", "toxic"])


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Fit on at most ``most`` labelled documents, chosen by a hash of their id, so the same ones at every run.

    Labels with null id or value, and documents with null id or text, teach nothing; of an id's several labels one counts, and each of its texts; empty texts have no
    words; long ones count whole; with no label of either kind, or an empty table, the model finds nothing toxic.
    """
    wanted = labels.select(F.col("doc_id").cast("bigint").alias("_of"), F.col("toxic").cast("int").alias("toxic")).where("_of IS NOT NULL AND toxic IS NOT NULL")
    wanted = wanted.dropDuplicates(["_of"]).orderBy(F.xxhash64("_of"), "_of").limit(most)
    rows = texts(docs).join(F.broadcast(wanted), F.col("doc_id") == F.col("_of")).select("doc_id", "text", "toxic").mapInArrow(_unit_rows, "doc_id bigint, units array<string>, toxic int").toArrow()
    lists = rows.column("units").combine_chunks()
    flat = lists.flatten().dictionary_encode()
    pool, which, ends = flat.dictionary.to_pylist(), flat.indices.to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))  # each unit's string is held once
    ids, toxic = rows.column("doc_id").to_numpy(), rows.column("toxic").to_pylist()
    bags = [{pool[k] for k in which[ends[i] : ends[i + 1]].tolist()} for i in range(len(ids))]
    del rows, lists, flat, which
    return _fit([(bags[i], toxic[i]) for i in sorted(range(len(ids)), key=lambda i: (ids[i], sorted(bags[i])))])


def _score_rows(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, raw, offsets in K.slices(b.column(1)):
            hashes, _, first = K.word_hashes(raw, offsets)
            classes, begin, _ = fold(raw, offsets)
            start, length = begin[:-1], np.diff(begin)
            row = K.row_of(first, len(start))
            top = np.full(hi - lo, -np.inf)
            _, one, back = np.unique(hashes, return_index=True, return_inverse=True)
            head, n = _single_runs(length, row)
            got = scores(model, classes, np.append(start[one], start[head]), np.append(length[one], n))
            np.maximum.at(top, np.append(row, row[head]), np.append(got[: len(one)][back], got[len(one) :]))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(top, mask=~np.isfinite(top)), pa.array(top > 0)], names=["doc_id", "score", "toxic"])


def toxic_scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, toxic) for each row of docs with an id and a text.

    score is null and toxic false where a text has no word of three letters; rows with null id or text are left out; repeated rows
    are scored each; an empty table gives an empty result; columns other than doc_id and text are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 128 KB, whatever the input
    return texts(docs).mapInArrow(lambda it: _score_rows(it, sent.value), "doc_id bigint, score double, toxic boolean")


def _clean_rows(batches: Iterator[pa.RecordBatch], model: Model, at: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        both = pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), b.column(at)], names=["doc_id", "text"])
        flags = [x.column(2).to_numpy(zero_copy_only=False) for x in _score_rows(iter([both]), model)]
        yield b.filter(pa.array(~np.concatenate(flags))) if flags else b


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without toxic rows; rows with null or empty text, and with a null id, are judged by their text or stay for want of one, repeated rows alike; all columns of docs stay, whatever their names; an empty table stays empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    return only(docs, docs.columns).mapInArrow(lambda it: _clean_rows(it, sent.value, at), docs.schema)
