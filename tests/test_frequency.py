"""Summaries by term frequency (X2) against plain loops."""

import random
import re
from collections import Counter

from annolens.operators import frequency as FQ
from annolens.operators.infer import infer

WORD = re.compile(r"""[^\s.,;:!?()"']+""")


def brute_weights(texts):
    n = Counter(w for t in texts if t for w in WORD.findall(t.lower()))
    total = sum(n.values())
    return {w: int(c / total * 1_000_000_000) for w, c in n.items()}


def brute(text, weights, k):
    pieces = re.findall(r"[^.!?]*[.!?]+", text)
    words = [WORD.findall(p.lower()) for p in pieces]
    w, taken = dict(weights), []
    for _ in range(k):
        left = [(-(sum(w.get(x, 0) for x in ws) // len(ws)), i) for i, ws in enumerate(words) if ws and i not in taken]
        if not left:
            break
        i = min(left)[1]
        taken.append(i)
        for x in set(words[i]):
            w[x] = w.get(x, 0) ** 2 // 1_000_000_000
    return ("".join(pieces[i] for i in sorted(taken)) if taken else text).strip()


def drawn(seed, n):
    rnd = random.Random(seed)
    return [" ".join("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 2))) + rnd.choice(["", "", "", ".", "!", "?..", ","]) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_equals_plain_loops(spark):
    corpus = drawn(1, 60) + [None, ""]
    texts = drawn(2, 60) + ["No end", "...", "One. One. One.", "The same. the SAME! Other words here. the same"]
    terms = FQ.term_weights(spark.createDataFrame([(t,) for t in corpus], "text string"))
    assert {r["word"]: r["weight"] for r in terms.collect()} == brute_weights(corpus)
    df = spark.createDataFrame([(i, "Instruction.\n\n" + t) for i, t in enumerate(texts)], "id int, prompt string")
    for k in (1, 2, 5):
        got = {r["id"]: r["response"] for r in infer(df, "prompt", FQ.FreqBackend(terms, k)).collect()}
        assert got == {i: brute(t, brute_weights(corpus), k) for i, t in enumerate(texts)}


def test_rare_and_frequent_words_are_both_joined(spark, monkeypatch):
    corpus, text = drawn(3, 30), "a b c. ab ba ca. cc cb aa. a a a."
    terms = FQ.term_weights(spark.createDataFrame([(t,) for t in corpus], "text string"))
    df = spark.createDataFrame([("Say.\n\n" + text,)], "prompt string")
    for share in (0.0, 0.05, 2.0):  # all by broadcast, some, none
        monkeypatch.setattr(FQ, "FREQUENT", share)
        assert infer(df, "prompt", FQ.FreqBackend(terms, 2)).first()["response"] == brute(text, brute_weights(corpus), 2)


def test_empty_corpus_and_stored_answers(spark, tmpdir_path):
    terms = FQ.term_weights(spark.createDataFrame([], "text string"))
    df = spark.createDataFrame([("Say.\n\nOne. Two. Three.",), (None,)], "prompt string")
    for _ in range(2):  # the second run reads the table
        rows = infer(df, "prompt", FQ.FreqBackend(terms, 2), responses_path=f"{tmpdir_path}/responses").collect()
        assert sorted((r["response"] or "", r["response_status"]) for r in rows) == [("", "skipped"), ("One. Two.", "ok")]
    assert spark.read.parquet(f"{tmpdir_path}/responses").count() == 1


def test_words_of_texts_are_neither_grouped_nor_sorted_as_rows(spark):
    """A row for every word of a text: the join with the terms streams them, and only the terms are built."""
    terms = FQ.term_weights(spark.createDataFrame([(t,) for t in drawn(3, 30)], "text string"))
    texts = spark.createDataFrame([(str(i), t) for i, t in enumerate(drawn(4, 20))], "prompt_id string, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = FQ.choose_sentences(texts, terms, 2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Window" not in plan
