"""URL filter: logistic regression on hashed character n-grams of host and path.

Host (without a leading ``www.``) and path (with query, without fragment) are lower-cased and framed by marks, and their runs of 3 to
5 bytes are hashed into ``2 ** BITS`` slots, host and path apart. A URL's features are its distinct slots' counts over their norm.
The model is trained on a small labelled table of URLs; a table of seeds comes with the module, for use where there is none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.llm import kernels as K
from symgraph.llm.tables import small_batches

BITS, LOW, HIGH = 16, 3, 5
#: At most so many labelled rows are used to train.
MOST_LABELLED = 20_000
#: The share of unwanted URLs to be expected: what the n-grams say nothing about is then taken for wanted.
PRIOR = 0.1
_HOST, _PATH = K.U64(0x5851F42D4C957F2D), K.U64(0x14057B7EF767814F)


@dataclass
class UrlModel:
    weights: np.ndarray  # one per slot
    bias: float


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The framed host and path of a URL, as expressions."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_extract(bare, r"^(?:[^/?#@]*@)?([^/?#:]*)", 1), r"^www\.", "")
    path = F.regexp_extract(bare, r"^[^/?#]*([^#]*)", 1)
    return F.concat(F.lit("^"), host, F.lit("$")), F.concat(F.lit("^"), path, F.lit("$"))


def grams(raw: np.ndarray, offsets: np.ndarray, salt: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of all runs of LOW to HIGH bytes within rows."""
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    v, rows, slots = raw.astype(K.U64) + K.U64(1), [], []
    block = np.zeros(len(raw), K.U64)
    for n in range(1, HIGH + 1):
        m = len(raw) - n + 1
        if m <= 0:
            break
        block = block[:m] * K.BASE + v[n - 1 :]
        if n >= LOW:
            inside = row_of[:m] == row_of[n - 1 :]
            rows.append(row_of[:m][inside])
            slots.append((K.mix(block[inside] ^ salt) >> K.U64(64 - BITS)).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(slots)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def features(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value), each slot of a row once; a row's values have the norm 1."""
    (r1, s1), (r2, s2) = grams(*K.column_bytes(host), _HOST), grams(*K.column_bytes(path), _PATH)
    key, count = np.unique(np.append(r1, r2) << BITS | np.append(s1, s2), return_counts=True)
    row, value = key >> BITS, np.sqrt(count)
    return row, key & ((1 << BITS) - 1), value / np.sqrt(np.bincount(row, value**2, minlength=len(host)))[row]


def fit(host: pa.Array, path: pa.Array, label: np.ndarray, penalty: float = 1e-4, rounds: int = 400, prior: float = PRIOR) -> UrlModel:
    """Logistic regression with an L2 penalty by accelerated gradient steps; unwanted rows weigh ``prior`` in all, whatever their number.

    With one label only, or none, the model gives 0.5 for every URL.
    """
    y = np.asarray(label, float)
    if not len(y) or y.min() == y.max():
        return UrlModel(np.zeros(1 << BITS, np.float32), 0.0)
    row, slot, value = features(host, path)
    used, at = np.unique(slot, return_inverse=True)
    each = np.where(y > 0, prior / (y > 0).sum(), (1 - prior) / (y <= 0).sum())
    w, ahead, b, ahead_b, t = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0, 1.0
    for _ in range(rounds):
        z = np.bincount(row, value * ahead[at], minlength=len(y)) + ahead_b
        g = each * (1 / (1 + np.exp(-z)) - y)
        new = ahead - 2.0 * (np.bincount(at, value * g[row], minlength=len(used)) + penalty * ahead)
        new_b, t_new = ahead_b - 2.0 * g.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        k = (t - 1) / t_new
        ahead, ahead_b, w, b, t = new + k * (new - w), new_b + k * (new_b - b), new, new_b, t_new
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    return UrlModel(weights, float(b))


def probabilities(model: UrlModel, host: pa.Array, path: pa.Array) -> np.ndarray:
    row, slot, value = features(host, path)
    return 1 / (1 + np.exp(-np.bincount(row, value * model.weights[slot], minlength=len(host)) - model.bias))


def train(labelled: DataFrame, most: int = MOST_LABELLED) -> UrlModel:
    """A model from (url, unwanted 0/1); of more than ``most`` rows those with the lowest hash of the URL are used."""
    host, path = host_and_path(F.col("url"))
    known = labelled.where("url IS NOT NULL AND unwanted IS NOT NULL").select(host.alias("h"), path.alias("p"), F.col("unwanted").cast("int").alias("y"), F.xxhash64("url").alias("k"))
    rows = known.orderBy("k", "h", "p", "y").limit(most).collect()
    return fit(pa.array([r["h"] for r in rows], pa.string()), pa.array([r["p"] for r in rows], pa.string()), np.array([r["y"] for r in rows]))


def seed_model() -> UrlModel:
    """A model from the seeds that come with the module."""
    from symgraph.llm.url_seeds import LABELLED

    split = [u.split("://", 1)[-1].lower() for u, _ in LABELLED]
    hosts = ["^" + u.split("/", 1)[0].removeprefix("www.") + "$" for u in split]
    paths = ["^" + ("/" + u.split("/", 1)[1].split("#")[0] if "/" in u else "") + "$" for u in split]
    return fit(pa.array(hosts), pa.array(paths), np.array([y for _, y in LABELLED]))


def _score(batches: Iterator[pa.RecordBatch], model: UrlModel, threshold: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        p = probabilities(model, b.column(2), b.column(3))
        ok = np.asarray(b.column(1).is_valid())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, mask=~ok), pa.array((p < threshold) | ~ok)], names=["page_id", "url", "unwanted", "keep"])


def url_scores(pages: DataFrame, model: UrlModel, threshold: float = 0.5) -> DataFrame:
    """(page_id, url, unwanted, keep) for every row of pages: the probability that the URL is unwanted, and whether it is below threshold.

    A null URL has a null probability and is kept; an empty one is judged by its frame alone; repeated rows and null ids are scored
    like all others; an empty table gives an empty result; columns other than page_id and url are not looked at (so neither is html).
    """
    sent = pages.sparkSession.sparkContext.broadcast(model)  # 256 KB, whatever the input
    small_batches(pages.sparkSession, 10_000)
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"))
    return rows.mapInArrow(lambda it: _score(it, sent.value, threshold), "page_id bigint, url string, unwanted double, keep boolean")
