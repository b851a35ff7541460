"""Quality network: the vectorised pass against a plain one, and held-out accuracy."""

import zlib

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from annolens.llm import quality as Q

SF01 = "/root/testdata/sf0.01"
SF1 = "/root/testdata/sf0.1"


def plain_logit(net, text):
    """Chunk by chunk, filter by filter."""
    n = max(1, -(-len(text) // Q.STRIDE))
    padded = text + b"\0" * (Q.WIDTH + 2)
    answers = [net.emb[list(padded[p * Q.STRIDE : p * Q.STRIDE + Q.WIDTH])].ravel() @ net.conv + net.conv_bias for p in range(n)]
    out = []
    for at in range(0, max(1, -(-n // Q.HOP) - 1) * Q.HOP, Q.HOP):
        part = answers[at : at + 2 * Q.HOP]
        x = np.append(np.maximum(np.max(part, axis=0), 0), len(part) / (2 * Q.HOP))
        out.append(np.maximum(x @ net.hid + net.hid_bias, 0) @ net.out + net.out_bias[0])
    return np.mean(out)


def test_pass_equals_plain_loops():
    rnd = np.random.default_rng(1)
    net = Q.new_network(3)
    texts = [b"", b"a", b"ab" * 30, *(rnd.integers(0, 256, n, np.uint8).tobytes() for n in (7, 56, 57, 63, 64, 65, 120, 128, 129, 500, 5000))]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = Q.text_logits(net, np.frombuffer(b"".join(texts), np.uint8), off)
    assert np.allclose(got, [plain_logit(net, t) for t in texts], atol=1e-3)


def rows():
    docs = pq.read_table(f"{SF1}/documents.parquet").to_pandas().set_index("doc_id")["text"]
    labels = pq.read_table(f"{SF1}/labels.parquet").to_pandas()
    return [(i, docs[i].encode(), q, zlib.crc32(str(i).encode()) % 4 == 2) for i, q in zip(labels.doc_id, labels.quality, strict=True)]


def test_held_out_accuracy():
    data = rows()
    seen, unseen = [r for r in data if not r[3]][:2000], [r for r in data if r[3]]
    net = Q.fit([r[1] for r in seen], np.array([r[2] for r in seen], float))
    off = np.concatenate([[0], np.cumsum([len(r[1]) for r in unseen])])
    p = Q.probabilities(net, np.frombuffer(b"".join(r[1] for r in unseen), np.uint8), off)
    y = np.array([r[2] for r in unseen])
    assert ((p >= 0.7) == y).mean() > 0.97
    assert (p[y == 1] >= 0.7).mean() > 0.98


def test_frames(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").withColumn("score", F.lit("x"))
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    model = Q.train(docs, labels)
    again = Q.train(docs.repartition(3), labels)
    assert all(np.array_equal(a, b) for a, b in zip(model[0].params(), again[0].params(), strict=True))
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "word " * 50000)], "doc_id long, text string")
    got = [r["score"] for r in Q.score(odd, model).collect()]
    assert len(got) == 4 and all(0 <= x <= 1 for x in got) and got[0] == got[1] == got[2]
    assert Q.score(docs, model, out="score").count() == docs.count()
    one = labels.withColumn("quality", F.lit(1))
    net, share = Q.train(docs, one)
    assert net is None and share == 1.0
    assert Q.train(docs, labels.limit(0)) == (None, 1.0)
    assert Q.train(docs.limit(0), labels) == (None, 1.0)
    ids = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").withColumn("h", Q.held_out(F.col("doc_id"), 4, 2)).collect()
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in ids)


def test_every_chunk_is_learned_in_some_epoch():
    texts = [b"x" * n for n in (0, 3, 100, 700, 5000, 60000)]
    data, size, of, number = Q._chunks(texts)
    turns, weights = [], []
    for e in range(Q.EPOCHS):
        taken, part = Q._of_epoch(e, of, number)
        turns.append(taken)
        whole = number[taken] >= 0
        weights.append(np.bincount(of[taken[whole]], part[whole], minlength=len(texts)))
    assert set(np.concatenate(turns).tolist()) == set(range(len(data)))
    assert all((w <= Q.CHUNK_SHARE + 1e-4).all() and (w > 0).all() for w in weights)


def test_the_sample_is_bounded_by_rows_and_bytes(spark):
    docs = spark.createDataFrame([(1, f"text {i % 50}") for i in range(3000)] + [(2, "other " * 10), (3, "long " * 10**6)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    sample = Q.training_rows(docs, labels, "quality", 4, 9, 100, "doc_id", "text")
    assert sample.count() == 100
    assert {r["y"] for r in sample.where("length(body) < 9").collect()} <= {1}  # the larger of two labels
    assert Q.within([b"ab", b"abcdef", b"abc", b""], 5).tolist() == [0, 2, 3]
