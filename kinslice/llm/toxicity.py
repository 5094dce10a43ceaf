"""Toxicity scores by a factorization machine over hashed terms.

The terms of a document are its words (runs of letters, digits and non-ASCII characters, in lower
case) and the words' beginnings of 3 to 6 characters, hashed into 2**BITS features that are present
or not. With weights w and factors v, the model scores
``sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>)`` over the features present, so that pairs of terms,
such as an insult with the mention of a group, can weigh more than their sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, text
from .quality import FIT_COLUMNS, fit_sample, rows_sum

BITS = 18
FACTORS = 4
PREFIXES = (3, 4, 5, 6)
FOLDS, HELD_OUT = 3, 1
#: Labelled documents that the model is fitted on at most, of each class.
FIT_ROWS = 6_000
#: Bytes of their features at most, 4 for each.
FIT_BYTES = 128 << 20
EPOCHS = 10
#: Log-likelihood ratio with the label from which a feature counts (10.8 is a chance of one in a thousand),
#: and share of its log odds that its weight starts from.
EVIDENCE, START = 10.0, 0.3
THRESHOLD = 0.7


def terms(t: text.Text, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Features present in each row, ascending, and the bounds of each row's run."""
    low = t.lower_latin()
    start, end = low.bounds(text.TERM[low.buf])
    row = np.repeat(np.arange(t.rows), np.diff(np.searchsorted(start, t.off)))
    points = np.flatnonzero(~text.CONTINUATION[low.buf])
    nth = np.searchsorted(points, start)
    rows, values = [row], [low.hashes(start, end)]
    for k, size in enumerate(PREFIXES):
        stop = points[np.minimum(nth + size, len(points) - 1)] if len(points) else start
        long = np.flatnonzero((nth + size < len(points)) & (stop < end))
        rows.append(row[long])
        values.append(text.mix(low.hashes(start[long], stop[long]) + np.uint64(k + 1)))
    hashed = np.concatenate(values) >> np.uint64(64 - bits)
    return text.unique_in_rows(np.concatenate(rows), hashed.astype(np.int64), t.rows)


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        v = self.factors[features]
        sums = rows_sum(v, bounds)
        pairs = 0.5 * ((sums**2).sum(1) - rows_sum((v**2).sum(1), bounds))
        return self.bias + rows_sum(self.weights[features], bounds) + pairs

    def scores(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(features, bounds), -30, 30).astype(np.float64)))


def evidence(rows: list[np.ndarray], labels: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each feature's log-likelihood ratio with the label, and its smoothed log odds."""
    n1, total = float(labels.sum()), len(labels)
    size = 1 << bits
    d0, d1 = (np.zeros(size, np.int64) for _ in range(2))
    for y, d in ((0, d0), (1, d1)):
        own = [r for r, label in zip(rows, labels, strict=True) if bool(label) == bool(y)]
        for lo in range(0, len(own), 32):  # no second copy of all features
            d += np.bincount(np.concatenate(own[lo : lo + 32]), minlength=size)
    share = n1 / total
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(d > 0, d * np.log(d / ((d1 + d0) * p)), 0.0) for d, p in ((d1, share), (d0, 1 - share))]
    return 2 * (parts[0] + parts[1]), np.log((d1 + 0.5) / (n1 + 1)) - np.log((d0 + 0.5) / (total - n1 + 1))


def fit(rows: list[np.ndarray], labels: np.ndarray, *, bits: int = BITS, factors: int = FACTORS, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 2e-5, least: float = EVIDENCE, start: float = START, seed: int = 1) -> Machine:
    """Stochastic gradient descent (AdaGrad) on the logistic loss.

    Features whose log-likelihood ratio with the label is below ``least`` are noise and left out, however
    often they occur; rare ones that only toxic documents hold stay. Weights start at, and decay towards,
    ``start`` times the feature's log odds. The mean of the later half of the epochs' results counts.
    """
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(1 << bits, np.float32), rng.normal(0, 0.03, (1 << bits, factors)).astype(np.float32))
    if not len(rows) or labels.min() == labels.max():
        m.factors[:] = 0
        m.bias = -30.0 if not len(rows) or not labels.max() else 30.0
        return m
    ratio, odds = evidence(rows, labels, bits)
    seen = ratio >= least
    rows = [r[seen[r]] for r in rows]
    m.factors[~seen] = 0
    first = np.where(seen, start * odds, 0).astype(np.float32)
    m.weights[:] = first
    m.bias = float(np.log(labels.mean() / (1 - labels.mean())))
    gw, gv, gb = np.full(1 << bits, 0.1, np.float32), np.full((1 << bits, factors), 0.1, np.float32), 0.1
    late, total = 0, (0.0, np.float32(0), np.float32(0))
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 32):
            pick = order[lo : lo + 32]
            feats = np.concatenate([rows[i] for i in pick])
            bounds = np.concatenate([[0], np.cumsum([len(rows[i]) for i in pick])])
            v = m.factors[feats]
            sums = rows_sum(v, bounds)
            pairs = 0.5 * ((sums**2).sum(1) - rows_sum((v**2).sum(1), bounds))
            z = m.bias + rows_sum(m.weights[feats], bounds) + pairs
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            g = (p - labels[pick]).astype(np.float32)
            each = np.repeat(np.arange(len(pick)), np.diff(bounds))
            used, back = np.unique(feats, return_inverse=True)
            dw = np.bincount(back, g[each], len(used)).astype(np.float32) + decay * len(pick) * (m.weights[used] - first[used])
            dv = g[each, None] * (sums[each] - v)
            dv = np.stack([np.bincount(back, dv[:, f], len(used)) for f in range(factors)], 1).astype(np.float32) + decay * len(pick) * m.factors[used]
            gw[used] += dw**2
            gv[used] += dv**2
            m.weights[used] -= rate * dw / np.sqrt(gw[used])
            m.factors[used] -= rate * dv / np.sqrt(gv[used])
            db = float(g.sum())
            gb += db**2
            m.bias -= rate * db / gb**0.5
        if epoch >= epochs // 2:
            late, total = late + 1, tuple(a + b for a, b in zip(total, (m.bias, m.weights, m.factors), strict=True))
    return Machine(*(part / late for part in total))


def train(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES, label: str = "toxic", seed: int = 1) -> Machine:
    """A machine fitted on labelled documents outside the held-out fold.

    Of each class the ``fit_rows`` documents with the least hash of their id count, as far as their features
    together have ``fit_bytes``. Null labels and ids are left out, as are ids whose labels contradict each
    other; of several rows with one id the one with the least hash of its text counts. Features, not texts,
    are sent to the driver.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in text.chunks(batches):
            values, bounds = terms(t)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in FIT_COLUMNS), text.binaries(values.astype(np.int32), bounds)], [*FIT_COLUMNS, "features"])

    rows = fit_sample(docs, labels, label, FOLDS, HELD_OUT, fit_rows, fit_bytes, seed, features, "features binary")
    y = rows.column("y").to_numpy()
    found = [np.frombuffer(x.as_buffer(), np.int32) for x in rows.column("features")]  # of the table's own memory
    del rows
    some = [i for i, r in enumerate(found) if len(r)]
    model = fit([found[i] for i in some], y[some].astype(np.float32))
    del found
    common.give_back(docs.sparkSession)
    return model


def score(docs: DataFrame, model: Machine, *, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each document's whole text.

    A text without terms, null or empty, gets the model's prior. A null id is not held out. Rows are
    scored one by one, so repeated ones get equal scores; other columns are ignored.
    """
    # 2**BITS * (FACTORS + 1) floats, whatever the data
    held = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights, model.factors))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*held.value)
        for batch, t in text.chunks(batches):
            s = m.scores(*terms(t))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    common.arrow_ready(docs.sparkSession)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, score double")
    held_out = F.coalesce(common.fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Machine, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text scores below ``threshold``."""
    held = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights, model.factors))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*held.value)
        for batch, t in text.chunks(batches):
            yield batch.filter(pa.array(m.scores(*terms(t)) < threshold))

    common.arrow_ready(docs.sparkSession)
    return docs.mapInArrow(work, docs.schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))
