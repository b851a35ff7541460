"""Token budgets and chunking (O39-O42): fixture rows and properties."""

import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from annolens.functions.text import WORD_TOKEN
from annolens.operators.chunking import budget_for_model, budget_plan, chunk_by_key, chunk_rows


def words(n):
    return " ".join(f"w{i}" for i in range(n))


def test_budget_for_model():
    assert budget_for_model("gpt-4-1106-preview") == (128000, 16000)
    assert budget_for_model("anything-else") == (16000, 16000)


def test_chunk_rows_fixture(spark):
    df = spark.createDataFrame([(1, words(10))], "id int, text string")
    p = chunk_rows(df, "text", 10, 4).collect()
    assert [(r.kind, r.chunk_text) for r in p] == [("pass", words(10))]
    c = chunk_rows(df, "text", 9, 4).orderBy("chunk_idx").collect()
    sizes = [len(re.findall(WORD_TOKEN, r.chunk_text)) for r in c]
    assert sizes == [4, 4, 2] and "".join(r.chunk_text for r in c) == words(10)
    assert {r.kind for r in c} == {"chunk"} and c[0].n_chunks == 3


def naive_chunks(texts, max_tokens, size, sep=" "):
    joined = sep.join(texts)
    toks = re.findall(WORD_TOKEN, joined)
    if len(toks) <= max_tokens:
        return [joined]
    return ["".join(toks[i:i + size]) for i in range(0, len(toks), size)]


text_st = st.lists(st.sampled_from(["alpha", "beta.", "gamma,", "d", "e\tf", "x\ny", "zz  z"]), min_size=1,
                   max_size=8).map(" ".join)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), text_st), min_size=1, max_size=25),
       st.integers(1, 30), st.integers(2, 9), st.integers(1, 5))
def test_distributed_chunker_equals_naive(spark, rows, max_tokens, size, block):
    data = [(k, i, t) for i, (k, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "k int, o bigint, t string")
    got = chunk_by_key(df, ["k"], "o", "t", max_tokens, size, 0, " ", block_rows=block).collect()
    for key in {k for k, _, _ in data}:
        texts = [t for k, _, t in data if k == key]
        exp = naive_chunks(texts, max_tokens, size)
        mine = [r.chunk_text for r in sorted((r for r in got if r.k == key), key=lambda r: r.chunk_idx)]
        assert mine == exp
        assert "".join(mine) == " ".join(texts)
        n = len(re.findall(WORD_TOKEN, " ".join(texts)))
        assert len(mine) == (1 if n <= max_tokens else math.ceil(n / size))
    plan = {r.k: (r.n_tokens, r.kind, r.n_chunks) for r in budget_plan(df, ["k"], "t", max_tokens, size).collect()}
    for r in got:
        assert plan[r.k] == (r.n_tokens, r.kind, r.n_chunks)


def test_leading_white_space_does_not_shift_chunks(spark):
    rows = [(1, 0, "a b."), (1, 1, "  c d."), (1, 2, "\n e.")]
    df = spark.createDataFrame(rows, "k int, o bigint, t string")
    got = [(r.chunk_idx, r.n_tokens, r.chunk_text) for r in chunk_by_key(df, ["k"], "o", "t", 3, 2).orderBy("chunk_idx").collect()]
    assert got == [(0, 5, "a b. "), (1, 5, "c d. "), (2, 5, "e.")]


def test_text_is_cut_into_tokens_once_not_for_every_chunk(spark):
    """The tokens are named outside of the pieces' function, in which a Python tokenizer could not stand at all."""
    from pyspark.sql import functions as F

    from annolens.functions.tokenizers import OffsetTokenizer
    from annolens.operators.chunking import chunk_texts
    tk = OffsetTokenizer("by_word", lambda: lambda text: [m.span() for m in re.finditer(r"\S+\s*|^\s+", text)])
    text = " ".join(f"w{i}" for i in range(50_000))
    df = spark.createDataFrame([(1, text), (2, "a b c"), (3, None)], "id int, text string")
    for tokenizer in (tk, None):
        got = {r["id"]: r["p"] for r in df.select("id", chunk_texts(F.col("text"), 2, tokenizer=tokenizer).alias("p")).collect()}
        assert len(got[1]) == 25_000 and "".join(got[1]) == text
        assert got[2] == ["a b ", "c"] and got[3] is None


def test_only_texts_that_a_cut_goes_through_are_split_into_tokens(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    from annolens.functions.tokenizers import WordTokenizer
    split = spark.sparkContext.accumulator(0)

    class Watched(WordTokenizer):
        def pieces(self, c):
            @F.pandas_udf("array<string>")
            def cut(texts: pd.Series) -> pd.Series:
                split.add(int(texts.notna().sum()))
                return pd.Series([None if t is None else re.findall(WORD_TOKEN, t) for t in texts])
            return cut(c)

    texts = [words(4) for _ in range(60)]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "k int, o long, text string")
    got = chunk_by_key(df, ["k"], "o", "text", 10, 50, tokenizer=Watched()).orderBy("chunk_idx").collect()
    assert [r.chunk_text for r in got] == naive_chunks(texts, 10, 50)
    assert split.value == 2  # cuts at 50, 100, 150, 200: of these the second and the fourth are between two texts
