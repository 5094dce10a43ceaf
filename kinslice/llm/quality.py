"""Quality scores by supervised subword embeddings.

Each word and each of its character n-grams of 3 and 4, and each pair of neighbouring words (a word
followed by itself counts as one feature of its own), is hashed into 2**BITS learned vectors. A
document is the mean of its vectors; a softmax over it gives the labels' chances. Vectors and softmax
are fitted by stochastic gradient descent in numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, text

BITS = 17
DIM = 8
GRAMS = (3, 4)
FOLDS, HELD_OUT = 4, 2
#: Labelled documents that the model is fitted on at most, of each class.
FIT_ROWS = 2_000
#: Bytes of their features and counts at most, 8 for each feature.
FIT_BYTES = 128 << 20
EPOCHS = 6
THRESHOLD = 0.7


def rows_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of runs, some of which may be empty."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), values.dtype)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.add.reduceat(values, bounds[:-1][some], axis=0)
    return out


class Features:
    """Hashed features of a chunk: those of each distinct word, and those of pairs of words."""

    def __init__(self, t: text.Text, bits: int = BITS):
        shift = np.uint64(64 - bits)
        self.words = words = text.Words(t)
        _, at, self.which = np.unique(words.hash, return_index=True, return_inverse=True)
        start, end = words.start[at], words.end[at]
        points = np.flatnonzero(~text.CONTINUATION[t.buf])
        ends = np.append(points, len(t.buf))
        nth = np.searchsorted(points, start)
        size = np.searchsorted(points, end) - nth
        ids, owner = [words.hash[at] >> shift], [np.arange(len(at))]
        for n in GRAMS:
            count = np.maximum(size - n + 1, 0)
            who = np.repeat(np.arange(len(at)), count)
            k = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
            first = nth[who] + k
            place = (k == 0) * np.uint64(1) + (k == count[who] - 1) * np.uint64(2)
            ids.append(text.mix(t.hashes(ends[first], ends[first + n]) + np.uint64(4 * n) + place) >> shift)
            owner.append(who)
        owner = np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        self.ids = np.concatenate(ids)[order].astype(np.int64)
        self.bounds = np.searchsorted(owner[order], np.arange(len(at) + 1))
        h = words.hash
        pair = np.flatnonzero(words.row[1:] == words.row[:-1]) if len(h) else np.zeros(0, np.int64)
        same = self.which[pair] == self.which[pair + 1]
        mixed = text.mix(h[pair] * np.uint64(0x9E3779B97F4A7C15) + h[pair + 1])
        self.pairs = (np.where(same, np.uint64(1 << 63), mixed) >> shift).astype(np.int64)
        self.pair_first = np.searchsorted(words.row[pair], np.arange(t.rows + 1))

    def sparse(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each row's distinct features and their counts."""
        out = []
        for r in range(len(self.words.count)):
            used, n = np.unique(self.which[self.words.first[r] : self.words.first[r + 1]], return_counts=True)
            ids = [self.ids[self.bounds[u] : self.bounds[u + 1]] for u in used]
            times = np.repeat(n, [len(i) for i in ids])
            pairs = self.pairs[self.pair_first[r] : self.pair_first[r + 1]]
            every = np.concatenate([*ids, pairs]) if ids else pairs
            distinct, back = np.unique(every, return_inverse=True)
            out.append((distinct, np.bincount(back, np.concatenate([times, np.ones(len(pairs))]), len(distinct))))
        return out


@dataclass
class Model:
    vectors: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray

    def scores(self, f: Features) -> np.ndarray:
        """Chance of label 1 by row."""
        by_word = rows_sum(self.vectors[f.ids], f.bounds)
        total = rows_sum(by_word[f.which], f.words.first) + rows_sum(self.vectors[f.pairs], f.pair_first)
        count = rows_sum(np.diff(f.bounds)[f.which], f.words.first) + np.diff(f.pair_first)
        z = (total / np.maximum(count, 1)[:, None]).astype(np.float64) @ self.softmax.T + self.bias
        e = np.exp(z - z.max(1, keepdims=True))
        return e[:, 1] / e.sum(1)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = 0.1, seed: int = 1) -> Model:
    """Stochastic gradient descent (AdaGrad) on the cross entropy of the softmax."""
    rng = np.random.default_rng(seed)
    m = Model(rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32), np.zeros((2, dim)), np.zeros(2))
    if not len(rows):
        return m
    share = np.array([(labels == k).mean() for k in (0, 1)])
    m.bias = np.log(np.maximum(share, 1e-3))
    if share.min() == 0:
        return m
    sums, gw, gb = np.full(1 << bits, 1e-8, np.float32), np.full((2, dim), 1e-6), np.full(2, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 16):
            pick = order[lo : lo + 16]
            ids = np.concatenate([rows[i][0] for i in pick])
            bounds = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in pick])])
            x = np.concatenate([rows[i][1] / rows[i][1].sum() for i in pick]).astype(np.float32)
            h = rows_sum(m.vectors[ids] * x[:, None], bounds)
            z = h @ m.softmax.T + m.bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            dh = (p @ m.softmax).astype(np.float32)
            used, back = np.unique(ids, return_inverse=True)
            each = np.repeat(np.arange(len(pick)), np.diff(bounds))
            d = dh[each] * x[:, None]
            d = np.stack([np.bincount(back, d[:, k], len(used)) for k in range(dim)], 1).astype(np.float32)
            sums[used] += (d**2).mean(1)
            m.vectors[used] -= rate * d / np.sqrt(sums[used])[:, None]
            dw, db = p.T @ h, p.sum(0)
            gw += dw**2
            gb += db**2
            m.softmax -= rate * dw / np.sqrt(gw)
            m.bias -= 0.3 * rate * db / np.sqrt(gb)
    return m


#: What a sample's rows are told apart by.
FIT_COLUMNS = ("doc_id", "y", "h")


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, fit_rows: int, fit_bytes: int, seed: int, features: Callable, columns: str) -> pa.Table:
    """Features of the labelled documents that a model is fitted on, in the order of a hash of their ids.

    ``features`` maps batches of FIT_COLUMNS and text to batches of FIT_COLUMNS and ``columns``, binary ones.
    """
    common.arrow_ready(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & (common.fold("doc_id", folds) != held_out))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    order = [F.xxhash64(F.col("doc_id"), F.lit(seed)), F.col("doc_id")]
    chosen = [known.where(F.col("y") == y).orderBy(*order).limit(fit_rows) for y in (0, 1)]
    chosen = common.cut(chosen[0].unionByName(chosen[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    # at most 2 * fit_rows ids
    made = texts.join(F.broadcast(chosen), "doc_id").mapInArrow(features, f"doc_id long, y int, h long, {columns}")
    names = [c.split()[0] for c in columns.split(", ")]
    made = made.groupBy("doc_id").agg(F.min_by(F.struct("y", *names), "h").alias("row")).select("doc_id", "row.*", order[0].alias("place"))
    made = common.cut(made.withColumn("size", sum(F.octet_length(c) for c in names)))
    # the same share of each class, if not all fit
    sizes = made.select("doc_id", "y", "size").toArrow()
    total = sum(sizes.column("size").to_pylist())
    if total > fit_bytes:
        nth = Window.partitionBy("y").orderBy("place", "doc_id")
        most = F.sum("size").over(Window.partitionBy("y")) * F.lit(fit_bytes / total)
        made = made.withColumn("_upto", F.sum("size").over(nth)).withColumn("_most", most).where("_upto <= _most").drop("_upto", "_most")
    return made.toArrow().sort_by([("place", "ascending"), ("doc_id", "ascending")])


def train(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES, label: str = "quality", seed: int = 2) -> Model:
    """A model fitted on labelled documents outside the held-out fold.

    Of each class the ``fit_rows`` documents with the least hash of their id count, as far as their features
    together have ``fit_bytes``. Null labels and ids are left out, as are ids whose labels contradict each
    other; of several rows with one id the one with the least hash of its text counts. Features, not texts,
    are sent to the driver.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in text.chunks(batches):
            rows = Features(t).sparse()
            ids = [r[0].astype(np.int32).tobytes() for r in rows]
            counts = [r[1].astype(np.uint32).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in FIT_COLUMNS), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], [*FIT_COLUMNS, "ids", "counts"])

    rows = fit_sample(docs, labels, label, FOLDS, HELD_OUT, fit_rows, fit_bytes, seed, features, "ids binary, counts binary")
    ids, counts = rows.column("ids").to_pylist(), rows.column("counts").to_pylist()
    y = rows.column("y").to_numpy()
    del rows
    some = [i for i, x in enumerate(ids) if x]
    return fit([(np.frombuffer(ids[i], np.int32), np.frombuffer(counts[i], np.uint32).astype(np.float32)) for i in some], y[some])


def score(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each document's whole text.

    A text without words, null or empty, gets the softmax of its bias, the labels' prior. A null id
    is not held out. Rows are scored one by one, so repeated ones get equal scores; other columns are
    ignored.
    """
    # 2**BITS * DIM floats, whatever the data
    held = docs.sparkSession.sparkContext.broadcast((model.vectors, model.softmax, model.bias))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*held.value)
        for batch, t in text.chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(m.scores(Features(t)))], ["doc_id", "score"])

    common.arrow_ready(docs.sparkSession)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, score double")
    held_out = F.coalesce(common.fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))
