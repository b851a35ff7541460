"""Exact top-k against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolens.llm import topk


def brute(rows, every, k, scale=256):
    whole = [(i, np.floor(np.array(v, float) * scale).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for qi, q in whole:
        if qi % every == 0:
            c = sorted((-int(q @ v), i) for i, v in whole if i != qi and len(v) == len(q))[:k]
            out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(c)]
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    rows = [(i, rnd.normal(0, 0.3, 40).tolist()) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 460)]  # a common vector: ties
    rows += [(i, (rnd.normal(0, 0.01, 40) + rows[50][1]).tolist()) for i in range(460, 480)]
    rows += [(480, None), (490, [1.0, None]), (500, [float("nan")] * 40), (510, [float("inf")] * 40), (520, [0.5] * 3), (521, [0.1] * 3), (None, [0.1] * 40), (530, []), (531, [])]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, score double")
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = brute(single, 10, 5)
    query = F.col("id") % 10 == 0
    assert sorted(tuple(r) for r in topk.top_k(df, query).collect()) == want
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    monkeypatch.setattr(topk, "SHARD_ROWS", 60)
    assert sorted(tuple(r) for r in topk.top_k(df, query).collect()) == want


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (0, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("id") == 0).collect())
    assert got == [(0, 1, 1, 256 * 128 + 512 * 128)]  # equal rows of an id are one query; neither is the other's candidate
    assert topk.top_k(df.limit(0), F.col("id") == 0).count() == 0
    assert topk.top_k(df, F.col("id") == 9).count() == 0


def test_repeated_query_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0])] + [(i, [float(i), -float(i)]) for i in range(1, 9)]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 0).collect())
    best = [(0, r + 1, 8 - r, (8 - r) * 65536) for r in range(5)] + [(0, r + 1, r + 1, -(r + 1) * 65536) for r in range(5)]
    assert got == sorted(best)  # each of the two different vectors has its five


def test_scores_beyond_exact_numbers_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 0.5])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="(?i)too large|overflow"):
        topk.top_k(df, F.col("id") == 0).collect()
