"""Quality classifier: a byte-level convolutional network in numpy.

Bytes get learned vectors; learned filters of ``WIDTH`` bytes run over the
whole text with a stride of two.  The filters' answers are max-pooled over
chunks of ``2 * HOP`` positions that overlap by half and cover the whole text.
A hidden layer turns each chunk's maxima into a logit, and the mean of a
document's chunk logits, scaled on the training rows, is its probability.

The network is fitted in one task on a bounded sample: ``TRAIN_ROWS`` labelled
rows at most, picked by a hash of their ids, and of these as many as have
``TRAIN_BYTES`` together.  Their texts are learned whole: the chunks of a long
text are dealt out over the epochs, and those of one epoch share the weight of
``CHUNK_SHARE`` chunks, so that a text counts alike whatever its length.  The
weights (a few thousand numbers) go to all tasks; every text is then scored
whole.  Same rows and labels, same weights.

Defined results: null and empty texts are scored as a text without bytes;
repeated rows each get their score; labels that are null are not learned;
an id with several labels has the largest; without labels of both kinds the
score is the smoothed share of label 1.  A
null id is never held out.  Labels, ids and other columns are never inputs of
a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolens.llm.common import byte_column, row_blocks

#: Labelled rows, and bytes of their texts, that the fit takes at most; the bounds of the sample.
TRAIN_ROWS, TRAIN_BYTES = 8000, 64 << 20
#: Chunks whose weight a text has in an epoch, at most.
CHUNK_SHARE = 8
#: Width of a byte's vector, bytes of a filter, stride, filters, hidden units.
BYTE_DIM, WIDTH, STRIDE, FILTERS, HIDDEN = 8, 8, 2, 48, 32
#: Positions of half a chunk, and its bytes.
HOP = 32
HOP_BYTES = HOP * STRIDE
#: Hops that go through the network at a time.
SLICE_HOPS = 1024
EPOCHS, BATCH, RATE = 6, 64, 0.004


@dataclass
class Network:
    emb: np.ndarray
    conv: np.ndarray
    conv_bias: np.ndarray
    hid: np.ndarray
    hid_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)

    def params(self) -> list[np.ndarray]:
        return [self.emb, self.conv, self.conv_bias, self.hid, self.hid_bias, self.out, self.out_bias]


def new_network(seed: int) -> Network:
    rnd = np.random.default_rng(seed)
    normal = lambda *shape, by: (rnd.standard_normal(shape) / np.sqrt(by)).astype(np.float32)
    return Network(
        normal(256, BYTE_DIM, by=BYTE_DIM), normal(WIDTH * BYTE_DIM, FILTERS, by=WIDTH), np.zeros(FILTERS, np.float32),
        normal(FILTERS + 1, HIDDEN, by=FILTERS), np.zeros(HIDDEN, np.float32), normal(HIDDEN, by=HIDDEN), np.zeros(1, np.float32),
    )


def layout(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts laid out in whole hops with zeros behind each: bytes, hops of each text, positions of each text."""
    lens = np.diff(off)
    hops = -(-(lens + WIDTH) // HOP_BYTES)
    at = (np.cumsum(hops) - hops) * HOP_BYTES
    room = np.zeros(int(hops.sum()) * HOP_BYTES + WIDTH, np.uint8)
    room[np.repeat(at - off[:-1], lens) + np.arange(len(buf))] = buf
    return room, hops, np.maximum(1, -(-lens // STRIDE))


def _windows(emb: np.ndarray, room: np.ndarray, positions: int) -> np.ndarray:
    x = np.ascontiguousarray(emb[room])
    step = x.strides[0]
    return np.lib.stride_tricks.as_strided(x, (positions, WIDTH * BYTE_DIM), (step * STRIDE, x.itemsize))


def hop_maxima(net: Network, room: np.ndarray, hops: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The greatest answer of each filter in each hop; a hop without positions has -inf."""
    total = int(hops.sum())
    out = np.empty((total, FILTERS), np.float32)
    inside = np.clip(np.repeat(positions, hops) - (np.arange(total) - np.repeat(np.cumsum(hops) - hops, hops)) * HOP, 0, HOP)
    for lo in range(0, total, SLICE_HOPS):
        hi = min(total, lo + SLICE_HOPS)
        z = _windows(net.emb, room[lo * HOP_BYTES : hi * HOP_BYTES + WIDTH], (hi - lo) * HOP) @ net.conv
        z = z.reshape(hi - lo, HOP, FILTERS)
        for k in np.flatnonzero(inside[lo:hi] < HOP):
            z[k, inside[lo + k] :] = -np.inf
        out[lo:hi] = z.max(axis=1)
    return out + net.conv_bias


def chunk_logits(net: Network, pooled: np.ndarray, filled: np.ndarray) -> np.ndarray:
    x = np.concatenate([np.maximum(pooled, 0), filled[:, None]], axis=1).astype(np.float32)
    return np.maximum(x @ net.hid + net.hid_bias, 0) @ net.out + net.out_bias[0]


def text_logits(net: Network, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Mean chunk logit of each text."""
    room, hops, positions = layout(buf, off)
    maxima = hop_maxima(net, room, hops, positions)
    used = -(-positions // HOP)
    chunks = np.maximum(1, used - 1)
    first = np.repeat(np.cumsum(hops) - hops, chunks) + np.arange(int(chunks.sum())) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    second = np.where(np.repeat(used, chunks) > 1, first + 1, first)
    at = np.arange(len(first)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    filled = np.minimum(2 * HOP, np.repeat(positions, chunks) - at * HOP) / (2 * HOP)
    logits = chunk_logits(net, np.maximum(maxima[first], maxima[second]), filled)
    return np.add.reduceat(logits, np.cumsum(chunks) - chunks) / chunks if len(chunks) else np.empty(0)


def _chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All chunks of the texts as padded bytes, their positions, their texts, and their numbers there.

    One short cutting of each text goes with them (number -1): short texts are
    rare among the rows, and a chunk that is filled in part must not look odd for that.
    """
    rows, size, of, number = [], [], [], []
    wide = 2 * HOP_BYTES
    rnd = np.random.default_rng(len(texts))
    for i, t in enumerate(texts):
        for k in range(max(1, -(-len(t) // HOP_BYTES) - 1)):
            rows.append(t[k * HOP_BYTES : k * HOP_BYTES + wide + WIDTH].ljust(wide + WIDTH, b"\0"))
            size.append(min(2 * HOP, max(1, -(-(len(t) - k * HOP_BYTES) // STRIDE))))
            of.append(i)
            number.append(k)
        n = int(rnd.integers(WIDTH, wide))
        at = int(rnd.integers(0, max(1, len(t) - n)))
        part = t[at : at + n]
        rows.append(part.ljust(wide + WIDTH, b"\0"))
        size.append(max(1, -(-len(part) // STRIDE)))
        of.append(i)
        number.append(-1)
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, wide + WIDTH), np.array(size), np.array(of), np.array(number)


def _of_epoch(epoch: int, of: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunks that an epoch learns, and their weights; every chunk has its turn in some epoch."""
    chunks = np.bincount(of[number >= 0])
    turns = np.clip(-(-chunks // CHUNK_SHARE), 1, EPOCHS)
    taken = np.flatnonzero((number < 0) | (number % turns[of] == epoch % turns[of]))
    whole = number[taken] >= 0
    share = CHUNK_SHARE / np.maximum(np.bincount(of[taken[whole]], minlength=len(chunks)), CHUNK_SHARE)
    return taken, np.where(whole, share[of[taken]], 1.0).astype(np.float32)


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 5) -> Network:
    """Train on the chunks of the texts, then scale the mean logits to probabilities."""
    net = new_network(seed)
    data, size, of, number = _chunks(texts)
    y = labels[of].astype(np.float32)
    share = labels.mean()
    weight = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    rnd = np.random.default_rng(seed)
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in net.params()]
    step, wide = 0, 2 * HOP
    for epoch in range(EPOCHS):
        taken, part = _of_epoch(epoch, of, number)
        mixed = rnd.permutation(len(taken))
        order, part = taken[mixed], part[mixed]
        rate = RATE * (1 - epoch / EPOCHS)
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            raw, n = data[pick], len(pick)
            x = net.emb[raw].reshape(n, -1)
            cols = np.lib.stride_tricks.as_strided(x, (n, wide, WIDTH * BYTE_DIM), (x.strides[0], STRIDE * BYTE_DIM * x.itemsize, x.itemsize))
            z = cols @ net.conv
            z[np.arange(wide) >= size[pick][:, None]] = -np.inf
            best = z.argmax(axis=1)
            pooled = np.take_along_axis(z, best[:, None], axis=1)[:, 0] + net.conv_bias
            feat = np.concatenate([np.maximum(pooled, 0), (size[pick] / wide)[:, None]], axis=1).astype(np.float32)
            hidden = np.maximum(feat @ net.hid + net.hid_bias, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.out_bias[0], -30, 30)))
            g = ((p - y[pick]) * weight[pick] * part[lo : lo + BATCH] / n).astype(np.float32)
            d_hidden = g[:, None] * net.out * (hidden > 0)
            d_pool = (d_hidden @ net.hid[:FILTERS].T) * (pooled > 0)
            at = cols[np.arange(n)[:, None], best]  # the winning window of each filter
            d_window = d_pool[:, :, None] * net.conv.T
            where = raw[np.arange(n)[:, None, None], (best * STRIDE)[:, :, None] + np.arange(WIDTH)]
            d_emb = np.zeros_like(net.emb)
            np.add.at(d_emb, where.ravel(), d_window.reshape(-1, BYTE_DIM))
            grads = [d_emb, np.einsum("nf,nfk->kf", d_pool, at), d_pool.sum(0), feat.T @ d_hidden, d_hidden.sum(0), hidden.T @ g, g.sum(keepdims=True)]
            step += 1
            for value, grad, (m, v) in zip(net.params(), grads, moment, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    logits = np.concatenate([text_logits(net, np.frombuffer(b"".join(texts[lo:hi]), np.uint8), off[lo : hi + 1] - off[lo]) for lo, hi in row_blocks(off)])
    net.scale = _scale(logits, labels)
    return net


def _scale(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit to the logits, by Newton's method with a weak pull to slope one."""
    a, b = 1.0, 0.0
    x = np.clip(logits, -30, 30)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - labels) * x).sum() + (a - 1), (p - labels).sum() + 0.1 * b])
        h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        da, db = np.linalg.solve(h, g)
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return float(a), float(b)


def probabilities(net: Network, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    a, b = net.scale
    return 1 / (1 + np.exp(-np.clip(a * text_logits(net, buf, off) + b, -50, 50).astype(np.float64)))


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether the CRC-32 of the id as text leaves ``fold`` on division; false for a null id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int, key: str, text: str) -> DataFrame:
    """At most ``rows`` labelled rows outside the held-out fold, by a hash of their ids: (order, next, body, y)."""
    usable = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where(F.col("y").isNotNull() & F.col("k").isNotNull() & ~held_out(F.col("k"), folds, fold))
    usable = usable.groupBy("k").agg(F.max("y").alias("y"))
    n = usable.count()
    share = min(1.0, rows / max(1, n))
    picked = usable.where((F.pmod(F.xxhash64("k", F.lit(17)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))
    source = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    # ``picked`` is bounded by ``rows``; so is the sample, however many rows an id has
    sample = source.join(F.broadcast(picked), "k").select(F.xxhash64("k", F.lit(23)).alias("order"), F.xxhash64("body").alias("next"), "body", "y")
    return sample.orderBy("order", "next").limit(rows)


def within(texts: list[bytes], most: int) -> np.ndarray:
    """The texts, in their order, that have ``most`` bytes together; one that does not fit any more is left out."""
    taken, used = [], 0
    for i, t in enumerate(texts):
        if used + len(t) <= most:
            taken.append(i)
            used += len(t)
    return np.array(taken, np.int64)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, fold: int = 2, key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> tuple[Network | None, float]:
    """Fit the network in one task on the bounded sample; the network (None without both labels) and the share of label 1."""
    sample = training_rows(docs, labels, label, folds, fold, rows, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        texts: list[bytes] = []
        y: list[int] = []
        for b in batches:
            texts += b.column("body").to_pylist()
            y += b.column("y").to_pylist()
        keep = within(texts, TRAIN_BYTES)
        texts, ys = [texts[i] for i in keep.tolist()], (np.array(y, np.float64) > 0).astype(np.float64)[keep]
        share = float((ys.sum() + 1) / (len(ys) + 1))
        net = fit(texts, ys) if 0 < ys.sum() < len(ys) else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((net, share))], pa.binary())], names=["model"])

    import pickle

    got = sample.repartition(1).sortWithinPartitions("order", "next").mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else (None, 1.0)


def score(df: DataFrame, model: tuple[Network | None, float], text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add the probability of label 1 of every whole text."""
    kept = [c for c in (df.columns if keep is None else keep) if c != out]
    sent = df.sparkSession.sparkContext.broadcast(model)
    source = df.select(*dict.fromkeys([*kept, text]))
    schema = T.StructType([df.schema[c] for c in kept]).add(out, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, share = sent.value
        for b in batches:
            buf, off = byte_column(b.column(text))
            for lo, hi in row_blocks(off):
                p = np.full(hi - lo, share) if net is None else probabilities(net, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(p, pa.float64())], names=[*kept, out])

    return source.mapInArrow(run, schema)
