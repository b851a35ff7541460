"""Repeat removal against brute force."""

import hashlib
import random

from annolens.llm import lpf


def brute(docs, length):
    first = {}
    for k, t in docs:
        if k is not None:
            b = (t or "").encode()
            for i in range(len(b) - length + 1):
                s = b[i : i + length]
                first[s] = min(first.get(s, k), k)
    out = []
    for k, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        if k is not None:
            for i in range(len(b) - length + 1):
                if first[b[i : i + length]] < k:
                    gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def documents(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rnd.randint(10, 60)) for _ in range(8)]
    docs = []
    for i in range(150):
        parts = [text(rnd.randint(0, 40))]
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            a = rnd.randint(0, len(s) // 2)
            parts += [s[a : a + rnd.randint(30, 300)], text(rnd.randint(0, 10))]
        docs.append((i, " ".join(parts)))
    docs += [(200 + i, docs[7][1]) for i in range(10)]  # copies
    docs += [(300, "a" * 3000), (301, "b" + "a" * 700), (302, "ab" * 400), (303, "ba" * 90), (304, "x" * 49), (305, "x" * 50), (306, "x" * 50)]
    docs += [(400, None), (401, ""), (402, docs[3][1]), (402, docs[3][1]), (None, docs[3][1]), (None, None), (-5, docs[20][1][:120]), (403, docs[5][1] + docs[6][1])]
    rnd.shuffle(docs)
    return docs


def rows(frame):
    return sorted((tuple(r)[:5] for r in frame.collect()), key=repr)


def test_equals_brute_force(spark, monkeypatch):
    for seed, size in ((1, 16 << 20), (2, 6000)):
        monkeypatch.setattr(lpf, "PART_BYTES", size)
        docs = documents(seed)
        df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, part int")
        assert rows(lpf.remove_repeats(df)) == brute(docs, 50)
    # hot anchors by single windows
    monkeypatch.setattr(lpf, "HOT", 3)
    assert rows(lpf.remove_repeats(df)) == brute(docs, 50)


def test_odd_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lpf.remove_repeats(df).count() == 0
    one = spark.createDataFrame([(1, "short"), (None, "x" * 60), (2, None)], "doc_id long, text string")
    assert rows(lpf.remove_repeats(one)) == brute([(1, "short"), (None, "x" * 60), (2, None)], 50)


def test_passes_and_rows_cut_segments_anywhere(monkeypatch):
    import numpy as np

    rnd = random.Random(4)
    texts = ["".join(rnd.choices("ab ", k=rnd.randint(0, 400))).encode() for _ in range(40)] + [b"z" * 500]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for step in (64, 1000, 1 << 20):
        monkeypatch.setattr(lpf, "STEP", step)
        monkeypatch.setattr(lpf, "_POWERS", [])
        seg = lpf.Segments(buf, off, 50)
        starts = [s for a, n in zip(seg.at, seg.n, strict=True) for s in range(a, a + n)]
        assert sorted(starts) == [off[i] + j for i, t in enumerate(texts) for j in range(len(t) - 49)]
        known = {}
        for a, n, k in zip(seg.at, seg.n, seg.key, strict=True):
            assert known.setdefault(k.tobytes(), buf[a : a + n + 49].tobytes()) == buf[a : a + n + 49].tobytes()
