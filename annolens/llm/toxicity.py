"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The features of a text are its different words, pairs of neighbouring words and
pairs with one word between, hashed to ``BITS`` bits.  FTRL-proximal learns
with a rate for each coordinate and with L1 sparsity, so that only the few
features that tell the classes apart keep a weight.  The weights that are not
zero go to all tasks, and every text is scored whole.

The fit runs in one task on a bounded sample: about ``TRAIN_ROWS`` labelled
rows, picked and ordered by a hash of their ids.  Same rows and labels, same
weights.

Defined results: a null or empty text has no features and gets the score of
the intercept; repeated rows each get their score; labels that are null are
not learned; without labels of both kinds the score is the smoothed share of
label 1.  Labels, ids and other columns are never inputs of a score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolens.llm.common import byte_column, lower_bytes, mix64, row_blocks, word_hashes, word_spans
from annolens.llm.quality import training_rows, within

#: Labelled rows that the fit takes, about; the bound of the sample.
TRAIN_ROWS, TRAIN_BYTES = 12000, 96 << 20
#: Bits of a feature's index.
BITS = 20
#: FTRL-proximal: learning rate, its smoothing, L1 and L2 strength, passes over the rows.
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 8.0, 0.02, 4

_SALT = [np.uint64(x) for x in (0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature index and row of every n-gram and skip-gram, repeats included, in no order."""
    low = lower_bytes(buf)
    starts, ends = word_spans(low, off)
    h = word_hashes(low, starts, ends)
    row = np.searchsorted(off, starts, side="right") - 1
    index, rows = [mix64(h ^ _SALT[0])], [row]
    for gap in (1, 2):
        inside = np.flatnonzero(row[gap:] == row[:-gap]) if len(row) > gap else np.empty(0, np.int64)
        index.append(mix64(mix64(h[inside] + _SALT[gap]) ^ h[inside + gap]))
        rows.append(row[inside])
    return (np.concatenate(index) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(rows)


@dataclass
class Weights:
    index: np.ndarray
    value: np.ndarray
    intercept: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.index] = self.value
        return out


class Ftrl:
    """One example at a time; weights follow from the sums z and n."""

    def __init__(self, intercept: float):
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.start, self.bias_z, self.bias_n = intercept, 0.0, 0.0

    def weights(self, i) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def bias(self) -> float:
        return self.start - self.bias_z * ALPHA / (BETA + np.sqrt(self.bias_n))

    def learn(self, i: np.ndarray, y: float) -> None:
        w = self.weights(i)
        p = 1 / (1 + np.exp(-np.clip(w.sum() + self.bias(), -35, 35)))
        g = p - y
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[i] = n + g * g
        self.bias_z += g
        self.bias_n += g * g


def fit(texts: list[bytes], labels: np.ndarray) -> Weights:
    """Learn from the texts in the order given, ``EPOCHS`` times."""
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    rows: list[np.ndarray] = []
    for lo, hi in row_blocks(off):
        index, row = features(np.frombuffer(b"".join(texts[lo:hi]), np.uint8), off[lo : hi + 1] - off[lo])
        pairs = np.unique((row << BITS) | index)
        own = pairs >> BITS
        rows += np.split((pairs & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(own, np.arange(1, hi - lo)))
    share = labels.mean()
    model = Ftrl(float(np.log(share / (1 - share))))
    for _ in range(EPOCHS):
        for i, y in zip(rows, labels, strict=True):
            model.learn(i, y)
    every = model.weights(slice(None))
    kept = np.flatnonzero(every)
    return Weights(kept.astype(np.int32), every[kept].astype(np.float32), float(model.bias()))


def probabilities(dense: np.ndarray, intercept: float, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Probability of label 1 of each row; a feature counts once in a row."""
    index, row = features(buf, off)
    hit = np.flatnonzero(dense[index])
    pairs = np.unique((row[hit] << BITS) | index[hit])
    total = np.bincount(pairs >> BITS, weights=dense[pairs & ((1 << BITS) - 1)], minlength=len(off) - 1)
    return 1 / (1 + np.exp(-np.clip(total + intercept, -50, 50)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, fold: int = 0, key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> tuple[Weights | None, float]:
    """Fit in one task on the bounded sample; the weights (None without both labels) and the share of label 1."""
    sample = training_rows(docs, labels, label, folds, fold, rows, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        y: list[int] = []
        for b in batches:
            texts += b.column("body").to_pylist()
            y += b.column("y").to_pylist()
        keep = within(texts, TRAIN_BYTES)
        texts, ys = [texts[i] for i in keep.tolist()], (np.array(y, np.float64) > 0).astype(np.float64)[keep]
        model = fit(texts, ys) if 0 < ys.sum() < len(ys) else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model, float(ys.sum() / (len(ys) + 1))))], pa.binary())], names=["model"])

    got = sample.repartition(1).sortWithinPartitions("order", "next").mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else (None, 0.0)


def score(df: DataFrame, model: tuple[Weights | None, float], text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add the probability of label 1 of every whole text."""
    kept = [c for c in (df.columns if keep is None else keep) if c != out]
    sent = df.sparkSession.sparkContext.broadcast(model)
    source = df.select(*dict.fromkeys([*kept, text]))
    schema = T.StructType([df.schema[c] for c in kept]).add(out, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, share = sent.value
        dense = None if weights is None else weights.dense()
        for b in batches:
            buf, off = byte_column(b.column(text))
            for lo, hi in row_blocks(off):
                p = np.full(hi - lo, share) if dense is None else probabilities(dense, weights.intercept, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(p, pa.float64())], names=[*kept, out])

    return source.mapInArrow(run, schema)
