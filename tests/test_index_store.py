"""Keyed index store: only changed texts are embedded, only touched parts are written."""

import os

import numpy as np
from pyspark.sql import functions as F

from annolens.operators.embed import HashEmbedder, PandasEmbedder
from annolens.sources import index_store as IS

ENTRIES = "key string, gene_id long, gene_name string, idx long, type string, text string"


def entries(spark, rows):
    return spark.createDataFrame([(f"G{g}-gt-{i}", g, f"G{g}", i, "ground_truth", t) for g, i, t in rows], ENTRIES)


def counting(folder, name="counting"):
    """An embedder that leaves a file for every text it is given."""
    def load():
        import uuid

        def encode(texts):
            for t in texts:
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                    f.write(t)
            return np.array([[len(t), 1.0] for t in texts], np.float32).reshape(len(texts), 2)
        return encode
    return PandasEmbedder(name, 2, load)


def seen(folder):
    out = []
    for f in os.listdir(folder):
        with open(f"{folder}/{f}") as h:
            out.append(h.read())
        os.remove(f"{folder}/{f}")
    return sorted(out)


def stored(spark, path):
    return {(r["gene_id"], r["idx"]): (r["text"], r["embedding"][0]) for r in IS.read_index_store(spark, path).collect()}


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names}


def test_upsert_embeds_only_what_changed(spark, tmpdir_path):
    calls, path = f"{tmpdir_path}/calls", f"{tmpdir_path}/store"
    os.mkdir(calls)
    rows = [(g, i, f"text {g} {i}") for g in (1, 2, None) for i in range(1, 9)]
    assert IS.upsert_index(entries(spark, rows), path, counting(calls), parts=7) == 24
    assert len(seen(calls)) == 24
    before = files(path)
    assert IS.upsert_index(entries(spark, rows), path, counting(calls)) == 0
    assert seen(calls) == [] and files(path) == before  # a second run writes nothing

    changed = [(g, i, "another text" if (g, i) == (2, 3) else t) for g, i, t in rows if (g, i) != (1, 1)] + [(9, 1, "a new gene")]
    assert IS.upsert_index(entries(spark, changed), path, counting(calls)) == 2
    assert seen(calls) == ["a new gene", "another text"]
    want = {(g, i): (t, float(len(t))) for g, i, t in changed} | {(1, 1): ("text 1 1", 8.0)}  # keys that a release lacks stay
    assert stored(spark, path) == want
    parts = {r["part"] for r in IS.read_index_store(spark, path).where(F.col("text").isin("a new gene", "another text")).collect()}
    touched = {f.split("part=")[1].split("/")[0] for f, t in files(path).items() if "part=" in f and before.get(f) != t}
    assert touched == {str(p) for p in parts}

    assert IS.upsert_index(entries(spark, changed), path, counting(calls, "other model")) == len(changed)


def test_a_large_gene_lies_in_many_parts(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(IS, "BLOCK", 10)
    IS.upsert_index(entries(spark, [(1, i, f"t {i}") for i in range(300)]), tmpdir_path, HashEmbedder(16), parts=8)
    sizes = IS.read_index_store(spark, tmpdir_path).groupBy("part").count().collect()
    assert len(sizes) >= 6 and max(r["count"] for r in sizes) <= 100


def test_absent_part_is_made_again(spark, tmpdir_path):
    rows = [(g, 1, f"text {g}") for g in range(20)]
    IS.upsert_index(entries(spark, rows), tmpdir_path, HashEmbedder(16), parts=4)
    part = f"{tmpdir_path}/rows/part=2"
    for f in os.listdir(part):
        os.remove(f"{part}/{f}")
    os.rmdir(part)
    left = IS.read_index_store(spark, tmpdir_path).count()
    assert 0 < left < 20
    assert IS.upsert_index(entries(spark, rows), tmpdir_path, HashEmbedder(16)) == 20 - left
    assert IS.read_index_store(spark, tmpdir_path).count() == 20


def test_empty_release(spark, tmpdir_path):
    assert IS.upsert_index(entries(spark, [(1, 1, "x")]).limit(0), tmpdir_path, HashEmbedder(16)) == 0
    assert IS.upsert_index(entries(spark, [(1, 1, "x")]), tmpdir_path, HashEmbedder(16)) == 1
