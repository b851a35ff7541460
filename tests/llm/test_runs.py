"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annolens.llm import queries, runs
from annolens.llm.common import table
from tests.conftest import SF001


def brute(words, least=6, times=4):
    """All runs by trying every period at every start."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, times * q) and not any(q % p == 0 and all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, found):
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def collected(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    return {r["id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.periodic_runs(df, **how).collect()}


def expected(texts, **how):
    out = {}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = brute(words, **how)
        out[i] = (found, brute_collapsed(words, found))
    return out


def drawn(seed, count):
    rnd = random.Random(seed)
    texts = []
    for _ in range(count):
        words = []
        while len(words) < rnd.randint(0, 90):
            unit = [rnd.choice("abcd") for _ in range(rnd.randint(1, rnd.choice([2, 6, 12])))]
            words += unit * rnd.choice([1, 1, 2, 3, 4, 5, 9]) + unit[: rnd.randint(0, len(unit))]
            if rnd.random() < 0.3:
                words += words[-rnd.randint(1, 30) :] * rnd.randint(1, 4)
        texts.append(" ".join(words))
    return texts


def test_equals_brute_force(spark):
    texts = drawn(1, 400) + ["", None, " \t\n ", "a", "a a a a a", "a a a a a a", " ".join("ab" * 40), "x" * 50, "é é é é é é é", "\x00 \x00 \x00 \x00 \x00 \x00 \x00\x00"]
    assert collected(spark, texts) == expected(texts)


def test_other_parameters(spark):
    texts = drawn(2, 150)
    for how in ({"least": 2, "times": 2}, {"least": 9, "times": 3}, {"least": 30, "times": 2}):
        assert collected(spark, texts, **how) == expected(texts, **how)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4))
def test_any_words(docs):
    import numpy as np

    offsets = np.cumsum([0, *map(len, docs)])
    codes = np.array([x for d in docs for x in d], np.int64)
    doc, start, length, period = runs.block_runs(codes, offsets, 6, 4)
    assert list(zip(doc.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True)) == [(i, *r) for i, d in enumerate(docs) for r in brute(d)]


def test_a_long_text_of_one_word(spark):
    n = 200_000
    got = collected(spark, ["w " * n, " ".join(f"w{i % 1000}" for i in range(n))])
    assert got == {0: ([(0, n, 1)], "w"), 1: ([(0, n, 1000)], " ".join(f"w{i}" for i in range(1000)))}


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_equals_brute_force(spark, tmp_path):
    docs = table(spark, SF001, "documents").select("doc_id", F.expr("substring(text, 1, 900)").alias("text"))
    docs = docs.union(spark.createDataFrame([(-5, None), (7000, ""), (7001, "a a a a a a a"), (-(10**12), "b a b a b a b a")], "doc_id long, text string"))
    docs.union(docs.where("doc_id = 3")).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.QUERIES["op11_runs"](spark, str(tmp_path)).collect())
    want = []
    for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect():
        words = planted(r["doc_id"], re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        found = brute(words)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        shown = hashlib.sha256(brute_collapsed(words, found).encode()).hexdigest()
        want.append((r["doc_id"], len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest, shown))
    assert got == sorted(want)
    assert sum(r[1] > 0 for r in got) > 15


def test_empty_tables_and_clashing_columns(spark):
    schema = "runs string, text string, collapsed int"
    assert runs.periodic_runs(spark.createDataFrame([], schema)).collect() == []
    got = runs.periodic_runs(spark.createDataFrame([("x", "a a a a a a", 1), (None, None, None)], schema)).collect()
    assert sorted((r["text"] or "", len(r["runs"]), r["collapsed"]) for r in got) == [("", 0, ""), ("a a a a a a", 1, "a")]
