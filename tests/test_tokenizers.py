"""Injected subword tokenizer (O39): lossless pieces, exact counts, chunking."""

import pytest
from pyspark.sql import functions as F

from annolens.functions.tokenizers import OffsetTokenizer, SubwordTokenizer, WordTokenizer, cut_at_offsets
from annolens.operators.chunking import budget_plan, chunk_by_key, chunk_rows

CORPUS = ["the gene binds the protein and regulates expression.", "Éléphant über naïve test of hypoxia",
          "hello world  spaces\nnew line here", "protein kinase activity in cells"]


@pytest.fixture(scope="module")
def hf_path(tmp_path_factory):
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers, trainers
    tok = Tokenizer(models.BPE(unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    tok.decoder = decoders.ByteLevel()
    tok.train_from_iterator(CORPUS, trainers.BpeTrainer(vocab_size=300, special_tokens=["[UNK]"],
                                                        initial_alphabet=pre_tokenizers.ByteLevel.alphabet()))
    p = str(tmp_path_factory.mktemp("tok") / "tok.json")
    tok.save(p)
    return p


def offsets_of(path):
    def load():
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        return lambda text: tok.encode(text, add_special_tokens=False).offsets
    return OffsetTokenizer("file", load)


def test_cut_at_offsets_is_lossless():
    assert cut_at_offsets("abcdef", [0, 2, 2, 1, 4]) == ["ab", "", "", "cd", "ef"]
    assert "".join(cut_at_offsets("xyz", [0, 5])) == "xyz"


def test_offset_tokenizer_pieces(spark, hf_path):
    from tokenizers import Tokenizer
    ref = Tokenizer.from_file(hf_path)
    tk = offsets_of(hf_path)
    texts = CORPUS + ["Éléphant  ü\nz", "  lead space", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", "t", tk.pieces(F.col("t")).alias("p"), tk.count(F.col("t")).alias("n")).collect()
    for r in rows:
        assert "".join(r.p) == r.t
        assert r.n == len(ref.encode(r.t, add_special_tokens=False).ids)
    assert tk.count_text("the gene") == len(ref.encode("the gene", add_special_tokens=False).ids)


def test_chunking_with_subword_tokens(spark, hf_path):
    tk = offsets_of(hf_path)
    text = " ".join(CORPUS * 3)
    df = spark.createDataFrame([(1, text)], "k int, t string")
    n = tk.count_text(text)
    c = chunk_rows(df, "t", 10, 8, 0, tk).orderBy("chunk_idx").collect()
    assert "".join(r.chunk_text for r in c) == text and len(c) == -(-n // 8) and c[0].n_tokens == n
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(CORPUS)], "k int, o bigint, t string")
    g = chunk_by_key(rows, ["k"], "o", "t", 5, 7, 0, " ", block_rows=2, tokenizer=tk).orderBy("chunk_idx").collect()
    assert "".join(r.chunk_text for r in g) == " ".join(CORPUS)


def test_word_tokenizer_count_matches_pieces(spark):
    tk = WordTokenizer()
    df = spark.createDataFrame([("  a b\tc\n",), ("x",), ("",)], "t string")
    for r in df.select(F.size(tk.pieces(F.col("t"))).alias("a"), tk.count(F.col("t")).alias("b")).collect():
        assert r.a == r.b


VOCABULARY = ["a", "ab", "abcd", "b", "bc", "c", "the", "then", " a", " ab", " the", "\n", " (", "é", "😀x"]


def greedy(text):
    """Longest match, token by token."""
    out = []
    while text:
        n = max((len(t) for t in VOCABULARY if text.startswith(t)), default=1)
        out.append(text[:n])
        text = text[n:]
    return out


def drawn(seed, n):
    import random
    rnd = random.Random(seed)
    parts = [*VOCABULARY, "abc", "thenab", " ", ".", "z", "  ", "the"]
    return ["x" + "".join(rnd.choices(parts, k=rnd.randint(0, 25))) for _ in range(n)]


def test_subword_longest_match(spark):
    tk, texts = SubwordTokenizer(VOCABULARY), [*drawn(1, 60), "", "abcabcd", "thenthe", "a.b(c)", " the(", "😀x😀"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tk.pieces(F.col("t")).alias("p"), tk.count(F.col("t")).alias("n")).collect()
    assert {r.i: r.p for r in rows} == {i: greedy(t) for i, t in enumerate(texts)}
    assert all(r.n == len(r.p) == tk.count_text(texts[r.i]) for r in rows)
    assert SubwordTokenizer([]).count_text("ab\nc") == 4
    for bad in ("a b", "", " a "):
        with pytest.raises(ValueError):
            SubwordTokenizer([bad])


def test_subword_chunks_equal_those_of_the_joined_text(spark):
    tk = SubwordTokenizer(VOCABULARY)
    texts = {(k, o): t for k in ("p", "q", None) for o, t in enumerate(drawn({"p": 1, "q": 2}.get(k, 3), 9))}
    texts["short", 0] = "the"
    df = spark.createDataFrame([(k, o, (" \n" if o % 3 == 1 else "") + t) for (k, o), t in texts.items()], "k string, o int, t string")
    for sep in (" ", "\n\n"):
        for block in (2, 1 << 16):
            got = chunk_by_key(df, ["k"], "o", "t", 20, 7, 0, sep, block_rows=block, tokenizer=tk).collect()
            for key in ("p", "q", None, "short"):
                joined = sep.join(t for (k, _), t in sorted(((ko, t) for ko, t in texts.items() if ko[0] == key), key=lambda x: x[0][1]))
                tokens = greedy(joined)
                chunks = sorted((r.chunk_idx, r.chunk_text, r.n_tokens) for r in got if r.k == key)
                want = [joined] if len(tokens) <= 20 else ["".join(tokens[i:i + 7]) for i in range(0, len(tokens), 7)]
                assert chunks == [(i, c, len(tokens)) for i, c in enumerate(want)]
        plan = {r.k: r.n_tokens for r in budget_plan(df, ["k"], "t", 20, 7, 0, sep, tk, order_col="o").collect()}
        assert plan == {r.k: r.n_tokens for r in got}
    with pytest.raises(ValueError):
        chunk_by_key(df, ["k"], "o", "t", 20, 7, 0, "--", tokenizer=tk)


def test_vocabulary_table_has_a_bound(spark, monkeypatch):
    from annolens.functions import tokenizers as TK
    table = spark.createDataFrame([("a",), ("ab",), ("a",), ("",)], "token string")
    assert SubwordTokenizer.from_table(table).count_text("abab") == 2
    monkeypatch.setattr(TK, "VOCABULARY_TOKENS", 1)
    with pytest.raises(ValueError):
        SubwordTokenizer.from_table(table)
