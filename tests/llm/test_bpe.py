"""Byte-level BPE against the tiktoken library."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from annolens.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sample() -> list[str]:
    rnd = random.Random(5)
    kinds = ["abcdefghij", "aab", "éèêßñ世界日本", " \t\n\r  ", "0123456789", "!?#$%&*()'", "🙂🚀‍️", "ing the tion er"]
    texts = ["", " ", "a", "it's we'll I'd", "a" * 5000, " " * 300, "ab" * 700, "The end.\n\n  x", "<|endoftext|>", "\x00\x1c\x1f\x85"]
    for _ in range(300):
        texts.append("".join("".join(rnd.choice(k) for _ in range(rnd.randint(1, 12))) for k in rnd.choices(kinds, k=rnd.randint(1, 12))))
    texts.append("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20000)))
    return texts


def test_ids_equal_the_library(library):
    texts = sample()
    ids, n = bpe.Encoder(PATH, P.PATTERN).encode(texts)
    at = 0
    for t, k in zip(texts, n, strict=True):
        own = ids[at : at + k].tolist()
        assert own == library.encode_ordinary(t), repr(t[:80])
        assert bpe.decode_ids(bpe.vocabulary(PATH), ids[at : at + k]).tobytes() == t.encode()
        at += k


def test_white_space_classes_agree(library):
    encoder = bpe.Encoder(PATH, P.PATTERN)
    texts = [f"a{chr(c)}{chr(c)}b{chr(c)}1" for c in [*range(0x3000), *range(0xFE00, 0x10000), *range(0x1F600, 0x1F650)] if not 0xD800 <= c < 0xE000]
    ids, n = encoder.encode(texts)
    at = 0
    for t, k in zip(texts, n, strict=True):
        assert ids[at : at + k].tolist() == library.encode_ordinary(t), repr(t)
        at += k


def test_frames(spark, library):
    texts = [*sample()[:60], None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, "", "x")], "doc_id long, text string, ids string")
    rows = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert r["ids"] == library.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    for r in bpe.round_trip(df, PATH, P.PATTERN).collect():
        want = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    assert bpe.round_trip(df.where(F.lit(False)), PATH, P.PATTERN).count() == 0
