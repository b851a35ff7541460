"""Token counts of the compiled tokenizer against the library."""

import random

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from annolens.llm import transducer
from annolens.llm.common import table
from tests.conftest import SF001

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return LIBRARY


def expected(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


AWKWARD = [
    "", " ", "a", "'", "''", "'s", "''s", "it's we'll I'd they've he're 'tis 'l 'lo 'r 'v a'lb x'r", "'r", "!'s", "1's 22 '3", "don't'll",
    "<|endoftext|>", "a<|startoftext|>b<|endoftext|", "<|ENDOFTEXT|>", "café ́x", "ΣΑΣ Σ", "İstanbul", "\x1c\x1f\x85a b　c",
    "٣四Ⅷ½²", "a" * 5000, "ab" * 700, "!?" * 900, "Ᲊᲊ Ɤ \U00010d50", "é" * 50, "\x00�", "🙂🚀‍️", "日本語テキスト", " ".join(["word"] * 3000),
]


def test_awkward_texts(library):
    assert transducer.Counter(PATH).counts(AWKWARD).tolist() == expected(library, AWKWARD)


def test_random_pieces(library):
    rnd = random.Random(7)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "etaoin", "aab", "éèêßñ世界日本", " \t\n\r  '", "0123456789", "!?#$%&*()'", "'srvtlemd "]
    texts = ["".join("".join(rnd.choice(k) for _ in range(rnd.randint(1, 12))) for k in rnd.choices(kinds, k=rnd.randint(1, 12))) for _ in range(4000)]
    texts.append("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20000)))
    assert transducer.Counter(PATH).counts(texts).tolist() == expected(library, texts)


def test_every_token_alone_and_in_pairs(library):
    words = [w.removesuffix("</w>") for w in library.get_vocab()]
    names = {c: b for b, c in enumerate(transducer.byte_names())}
    rnd = random.Random(3)
    plain = [bytes(names[c] for c in w).decode(errors="replace") for w in words if all(c in names for c in w)]
    texts = plain + ["".join(rnd.choices(plain, k=3)) for _ in range(20000)]
    assert transducer.Counter(PATH).counts(texts).tolist() == expected(library, texts)


def test_every_character(library):
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0)]
    assert transducer.Counter(PATH).counts(texts).tolist() == expected(library, texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" 'srvetlmdab1!é́<|>"), st.characters(exclude_categories=["Cs"])), max_size=200), max_size=4))
def test_any_text(texts):
    assert transducer.counter(PATH).counts(texts).tolist() == expected(LIBRARY, texts)


def test_bounds_do_not_change_counts(library, monkeypatch):
    """States, pieces and fitting pairs started anew all the time."""
    monkeypatch.setattr(transducer, "STATES", 5)
    monkeypatch.setattr(transducer, "CACHE_BYTES", 300)
    monkeypatch.setattr(transducer, "CHUNK", 3)
    assert transducer.Counter(PATH).counts(AWKWARD).tolist() == expected(library, AWKWARD)


def test_table(spark, library):
    rows = table(spark, SF001, "documents").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in transducer.count_tokens(table(spark, SF001, "documents"), PATH).collect()}
    assert got == {r["doc_id"]: (len(r["text"].encode()), n) for r, n in zip(rows, expected(library, [r["text"] for r in rows]), strict=True)}


def test_nulls_repeats_empty_tables_and_clashing_columns(spark):
    schema = "n_tokens string, doc_id long, text string, n_bytes int"
    rows = [("x", 1, "Two words", 5), ("x", 1, "Two words", 5), (None, None, "one", None), ("y", 2, None, 1), ("y", 3, "", 1)]
    got = transducer.count_tokens(spark.createDataFrame(rows, schema), PATH)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 9, 2), (1, 9, 2), (None, 3, 1), (2, 0, 0), (3, 0, 0)], key=str)
    assert transducer.count_tokens(spark.createDataFrame([], schema), PATH).collect() == []
