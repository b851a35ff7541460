"""Decontamination against a brute-force version."""

import hashlib
import random
import re

from annolens.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    for key, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, t in items:
            v = words(t)
            windows = [v[i : i + k] for i in range(len(v) - k + 1)] if len(v) >= k else ([v] if v else [])
            for x in windows:
                for i in range(len(w) - len(x) + 1):
                    if w[i : i + len(x)] == x:
                        hit.update(range(i, i + len(x)))
                        if item is not None:
                            ids.add(str(item))
        shown = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        yield (key, len(w), len(hit), len(ids), shown, bool(hit))


def cases(seed):
    rnd = random.Random(seed)
    vocab = ["a", "b", "Été", "x1", "the", "世界", "zz-top", "q"]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(0, 12)))) for i in range(12)]
    items += [(3, items[5][1]), (None, "null id words"), (40, None), (41, ""), (42, "the the the the the the"), (43, "word"), (44, "Word, WORD")]
    docs = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(0, 40)))) for i in range(60)]
    for i in range(60, 90):
        mid = rnd.choice(items)[1] or ""
        docs.append((i, "pre " + ", ".join(mid.split()).upper() + "\nafter the the"))
    docs += [(90, None), (91, ""), (92, "..."), (93, "the " * 3000), (94, "null id words"), (5, "a word"), (95, "İ ı ſ K")]
    return docs, items


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_equals_brute_force(spark, monkeypatch):
    for seed, k in ((1, 3), (2, 5), (3, 2)):
        docs, items = cases(seed)
        d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, found string")
        b = spark.createDataFrame(items, "item_id long, text string")
        assert rows(decontam.digest(d, b, k)) == sorted(brute(docs, items, k), key=repr)
    # the same in several blocks of the benchmark and small shards
    monkeypatch.setattr(decontam, "BLOCK_MB", 1e-4)
    monkeypatch.setattr(decontam, "SHARD", 200)
    monkeypatch.setattr(decontam, "BLOCK_MB", type("Small", (int,), {"__lshift__": lambda self, n: 100})(1))
    assert rows(decontam.digest(d, b, k)) == sorted(brute(docs, items, k), key=repr)


def test_matches_and_clean(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, f"É, xx {item.title()}!", "k"), (2, "one two three", "k"), (3, None, "k")]
    d = spark.createDataFrame(docs, "doc_id long, text string, found string")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    found = {r["doc_id"]: r["hits"] for r in decontam.find_contamination(d, b, 10, out="hits").collect()}
    assert (found[1]["items"], [tuple(r) for r in found[1]["ranges"]], found[1]["n_hit"]) == (["7"], [(2, 12)], 12)
    (m,) = decontam.locations(d, b, 10).collect()
    assert (m["doc_id"], m["item"], m["item_word"], m["word_start"], m["n_words"]) == (1, "7", 0, 2, 12)
    assert docs[0][1].encode()[m["byte_start"] : m["byte_end"]].decode().lower() == item
    assert decontam.clean(d, b).collect() == d.where("doc_id > 1").collect()
    assert decontam.clean(d.limit(0), b).count() == 0
    assert decontam.clean(d, b.limit(0)).count() == 3


def test_locations_are_all_longest_matches(spark, monkeypatch):
    """Every window of every item, chained: in one group of items and in many."""
    docs, items = cases(4)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    k, want = 3, set()
    for key, text in docs:
        w = words(text)
        for item, t in {x for x in items if x[1] is not None}:
            v = words(t)
            k_ = min(k, len(v))
            starts = {(i, j) for i in range(len(v) - k_ + 1) for j in range(len(w) - k_ + 1) if k_ and w[j : j + k_] == v[i : i + k_]}
            for i, j in starts:
                if (i - 1, j - 1) not in starts:
                    n = 0
                    while (i + n, j + n) in starts:
                        n += 1
                    want.add((key, None if item is None else str(item), i, j, n - 1 + k_))
    for limit in (1 << 20, 3):
        monkeypatch.setattr(decontam, "MATCHES", limit)
        assert {tuple(r)[:5] for r in decontam.locations(d, b, k).collect()} == want


def test_a_phrase_of_many_items_repeated_in_a_document(spark):
    """Places times items would be 4 million pairs; memory follows places plus items."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    phrase = "the question is which of these ten words comes next"
    texts = [f"{phrase} item{i}" for i in range(2000)]
    bench = decontam.Benchmark([str(i) for i in range(2000)], texts, 10)
    batch = pa.RecordBatch.from_arrays([pa.array([f"{phrase} " * 2000])], names=["text"])
    (_, _, rank, doc, *_), = decontam._shards(batch, "text", bench)
    tracemalloc.start()
    cover, pairs = decontam.shard_cover(bench, rank, doc)
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()
    assert cover.all() and np.array_equal(pairs[1], np.arange(2000))
