"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from annolens.llm import queries, variants
from annolens.llm.common import table
from tests.conftest import SF001


def near(a, b):
    """One insertion, deletion or replacement apart, by trying them all."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(n, factor=2):
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    form, out = {}, {}
    for w in n:
        others = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, ()) if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
        out[w] = len(others)
    rows = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return rows


def got(spark, n):
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    rows = [tuple(r) for r in variants.group_variants(df).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def drawn(seed, count, alphabet, lengths):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice(alphabet) for _ in range(rnd.choice(lengths))) for _ in range(count)]
    for w in list(words):
        i = rnd.randrange(len(w) + 1)
        words += [w[:i] + rnd.choice(alphabet) + w[i:], w[: max(i - 1, 0)] + w[i:], w[:i] + rnd.choice(alphabet) + w[i + 1 :]]
    return {w: int(2 ** rnd.uniform(0, 12)) for w in words if len(w) >= min(lengths)}


CASES = {
    "plain": (drawn(1, 150, "abcdefgé", [5, 6, 7, 8, 9]), 32),
    "few letters": (drawn(2, 60, "ab", [5, 6, 7]), 32),
    "all crowded": (drawn(3, 120, "abcÿ", [5, 6, 7, 8]), 0),
    "some crowded": ({"prefix" + w: k for w, k in drawn(4, 80, "abcd", [5, 6]).items()} | {w + "suffix": k for w, k in drawn(5, 60, "abc", [5, 6]).items()}, 3),
    "one letter": ({"a" * k: 3**k for k in range(5, 12)}, 0),
    "one letter, not crowded": ({"a" * k: 3**k for k in range(5, 12)}, 32),
}


@pytest.mark.parametrize("name", CASES)
def test_equals_brute_force(spark, monkeypatch, name):
    n, crowd = CASES[name]
    monkeypatch.setattr(variants, "CROWD", crowd)
    assert got(spark, n) == brute_groups(n)


def test_ties_and_chains(spark):
    n = {"word" + "s" * k: 2**k for k in range(1, 20)} | {"lemon": 1, "lemen": 2, "leman": 2, "zebra": 5}
    rows = {r[0]: r for r in got(spark, n)}
    assert rows["words"][2] == "word" + "s" * 19 and rows["lemon"][1] == "leman" and rows["zebra"] == ("zebra", None, "zebra", 5, 0, None)


def counted(rows):
    words = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{r['doc_id']}:{run}".encode())
            words[run if h % 97 or r["doc_id"] is None else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in words.items() if len(w) >= 5 and k >= 3}


def test_query_equals_brute_force(spark, tmp_path):
    docs = table(spark, SF001, "documents").where("doc_id % 4 = 1").select("doc_id", "text")
    more = spark.createDataFrame([(None, "Straße straße STRASSE Éclair"), (8, None), (9, ""), (9, "Words words WORDS wörds × ÷ ab_cde a1b2")], "doc_id long, text string")
    docs.union(more).union(more).write.parquet(f"{tmp_path}/documents.parquet")
    n = counted(spark.read.parquet(f"{tmp_path}/documents.parquet").collect())
    assert len(n) > 300
    assert {tuple(r) for r in queries.QUERIES["op13_variants"](spark, str(tmp_path)).collect()} == brute_groups(n)


def test_empty_table_and_other_columns(spark):
    assert variants.group_variants(spark.createDataFrame([], "word string, n long, form int")).collect() == []
    rows = variants.group_variants(spark.createDataFrame([("abcde", 1, 7), ("abcdf", 2, None)], "word string, n long, form int")).collect()
    assert {tuple(r) for r in rows} == {("abcde", "abcdf", "abcdf", 1, 1, 2), ("abcdf", None, "abcdf", 2, 1, None)}
