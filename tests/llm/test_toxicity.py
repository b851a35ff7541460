"""FTRL toxicity: features and scores against plain loops, held-out accuracy, odd rows."""

import re
import zlib

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from annolens.llm import toxicity as X
from annolens.llm.common import mix64, word_hashes

SF01 = "/root/testdata/sf0.01"
SF1 = "/root/testdata/sf0.1"


def joined(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def plain_features(text):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", text.lower())
    h = [word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)])) for w in words]
    out = {int(mix64(x ^ X._SALT[0])[0]) for x in h}
    for gap in (1, 2):
        out |= {int(mix64(mix64(a + X._SALT[gap]) ^ b)[0]) for a, b in zip(h, h[gap:], strict=False)}
    return {x >> (64 - X.BITS) for x in out}


def test_features_and_scores_equal_plain_loops():
    texts = [b"", b"One", b"one TWO three.four", "Été é a b a b".encode(), b"a " * 50, b"..", b"last words here"]
    index, row = X.features(*joined(texts))
    for i, t in enumerate(texts):
        assert set(index[row == i].tolist()) == plain_features(t)
    dense = np.zeros(1 << X.BITS, np.float32)
    dense[::3] = 0.25
    p = X.probabilities(dense, -0.5, *joined(texts))
    want = [1 / (1 + np.exp(0.5 - sum(dense[f] for f in plain_features(t)))) for t in texts]
    assert np.allclose(p, want)


def test_held_out_accuracy():
    docs = pq.read_table(f"{SF1}/documents.parquet").to_pandas().set_index("doc_id")["text"]
    labels = pq.read_table(f"{SF1}/labels.parquet").to_pandas()
    data = [(docs[i].encode(), t, zlib.crc32(str(i).encode()) % 5 == 0) for i, t in zip(labels.doc_id, labels.toxic, strict=True)]
    seen, unseen = [d for d in data if not d[2]], [d for d in data if d[2]]
    model = X.fit([d[0] for d in seen], np.array([d[1] for d in seen], float))
    assert len(model.index) < 2000  # sparse
    p = X.probabilities(model.dense(), model.intercept, *joined([d[0] for d in unseen]))
    y = np.array([d[1] for d in unseen])
    assert ((p >= 0.5) == y).mean() > 0.97
    assert (p[y == 0] < 0.5).mean() > 0.99


def test_frames(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").withColumn("score", F.lit("x"))
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    model = X.train(docs, labels)
    again = X.train(docs.repartition(3), labels)
    assert np.array_equal(model[0].value, again[0].value) and model[0].intercept == again[0].intercept
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "word " * 50000)], "doc_id long, text string")
    got = [r["score"] for r in X.score(odd, model).collect()]
    assert len(got) == 4 and all(0 <= x <= 1 for x in got) and got[0] == got[1] == got[2]
    assert X.score(docs, model).count() == docs.count()
    assert X.train(docs, labels.limit(0)) == (None, 0.0)
    assert X.train(docs, labels.withColumn("toxic", F.lit(0)))[0] is None
    assert X.train(docs.limit(0), labels) == (None, 0.0)
