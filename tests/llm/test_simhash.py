"""SimHash near-duplicates against brute force."""

import random

import xxhash
from pyspark.sql import functions as F

from annolens.llm import simhash
from annolens.llm.components import components


def brute_fp(text, k=3):
    table = {i: i + 32 for i in range(65, 91)}
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate(table)) if w]
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_fingerprint(spark):
    texts = [None, "", "  \t", "one", "Two Words", "a b c", "ÄÖ Über Écoute le MONDE x\x0by\x1cz", "the the the the", "line\none  two\r\nthree four five"]
    rows = simhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r["key"]: r["fp"] % 2**64 for r in rows.collect()}
    assert got == {i: brute_fp(t) for i, t in enumerate(texts)}
    long = " ".join(random.Random(1).choices(["alpha", "beta", "é", "gamma"], k=30000))
    old, simhash.SLICE = simhash.SLICE, 1000
    try:
        assert simhash.fingerprint(long.encode()) == brute_fp(long)
        assert simhash.fingerprint(b"x" * 5000) == brute_fp("x" * 5000)
        assert simhash.fingerprint(b" " * 5000 + b"a b") == brute_fp("a b")
    finally:
        simhash.SLICE = old


def test_components(spark):
    rnd = random.Random(3)
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(rnd.randint(2000, 3000), rnd.randint(2000, 3000)) for _ in range(400)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = brute_components([p for p in pairs if p[0] != p[1]])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_equal_brute_force(spark):
    rnd = random.Random(7)
    fps = set()
    for center, n in ((rnd.getrandbits(64), 300), (rnd.getrandbits(64), 40), (rnd.getrandbits(64), 5)):
        for _ in range(n):
            x = center
            for _ in range(rnd.randint(0, 4)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps |= {rnd.getrandbits(64) for _ in range(300)}
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    for bits in (0, 1, 2):
        near = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) % 2**64).bit_count() <= bits]
        edges = [(r["a"], r["b"]) for r in simhash.links(frame, bits).collect()]
        assert {frozenset(e) for e in edges} <= {frozenset(e) for e in near}
        assert brute_components(edges) == brute_components(near)


def test_near_duplicates(spark):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for g in range(6):
        base = rnd.choices(words, k=400)
        for _ in range(g * 4 + 1):
            copy = list(base)
            for _ in range(rnd.randint(0, 2)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            docs.append(" ".join(copy))
    docs += [None, "", "short text"] * 3
    rnd.shuffle(docs)
    rows = [(i, t, "x") for i, t in enumerate(docs)] + [(3, docs[3], "y")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id string")).collect()
    fps = [brute_fp(t) for t in docs]
    near = [(i, j) for i in range(len(docs)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want = brute_components(near)
    assert len(out) == len(rows)
    for r in out:
        assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}"
        assert r["component_id"] == want.get(r["doc_id"], r["doc_id"])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    nulls = simhash.near_duplicates(spark.createDataFrame([(None, "a b c d"), (None, "z y x w v")], "doc_id long, text string"))
    assert nulls.where(F.col("component_id").isNull()).count() == 2


def test_exactly_one_row_of_each_group_stays(spark):
    """Rows of one id with two texts, repeated rows, rows without an id, extra columns of awkward names."""
    a, b = "some words that make a text of their own", "quite another text with other words in it"
    rows = [(1, b, "x"), (2, a, "x"), (2, b, "x"), (3, a, "x"), (None, b, "x"), (None, "only here, and without an id", "y"), (4, "c d e f", "z"), (4, "c d e f", "y"), (4, "c d e f", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("text_hash", F.lit(1))
    got = sorted(((r["doc_id"], r["text"], r["fp"]) for r in simhash.one_of_each(df).collect()), key=repr)
    assert got == sorted([(1, b, "x"), (2, a, "x"), (None, "only here, and without an id", "y"), (4, "c d e f", "y")], key=repr)
    assert simhash.one_of_each(df).columns == df.columns
    assert simhash.one_of_each(df.limit(0)).count() == 0
