"""Unit rows of FIXTURES.md §2 for the column functions."""

import pytest
from pyspark.sql import functions as F

from annolens.functions import text as TX
from annolens.functions.xml_tree import article_tree

FENCE = "`" * 3


def one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("value,expected", [("12", [12]), ("12,34", [12, 34]), ("", [])])
def test_parse_pmid_list(spark, value, expected):
    assert one(spark, TX.parse_pmid_list, value) == expected


def test_strip_fences(spark):
    assert one(spark, TX.strip_fences, f"{FENCE}json\n{{\"a\":1}}\n{FENCE}") == '{"a":1}'
    assert one(spark, TX.strip_fences, f"keep\nx{FENCE}\nend") == "keep\nend"


@pytest.mark.parametrize("value,expected", [("a", "a."), ("a.", "a."), ("a!", "a!"), ("a. ", "a. ."), ("", ".")])
def test_ensure_terminal_punct(spark, value, expected):
    assert one(spark, TX.ensure_terminal_punct, value) == expected


@pytest.mark.parametrize("value,expected", [
    ("A b. C.", "A b"), ("p is 0.05 here.", "p is 0"), ("no period", "no period"), (" . x", ""), ("...", None)])
def test_first_sentence(spark, value, expected):
    assert one(spark, TX.first_sentence, value) == expected


def test_strip_keeps_inner_whitespace(spark):
    assert one(spark, TX.strip, " \t a b\n") == "a b"
    assert one(spark, TX.strip, "55076\n") == "55076"


@pytest.mark.parametrize("value,expected", [("230", True), ("23a", False), ("", False), (" 1", False)])
def test_numeric_token(spark, value, expected):
    assert one(spark, TX.is_numeric_token, value) is expected


ARTICLES = [
    ("<article><sec><title>T1</title><p>a <i>b</i> tail</p></sec></article>", ["T1", "a"], ["T1", "a"]),
    ("<article><p><b>x</b>tail</p></article>", [], []),
    ("<article><p>c<!--k-->d</p><p><![CDATA[cd]]>e</p></article>", ["cd", "cde"], ["cd", "cde"]),
    ("<article><sec>\n  <p>q &lt; r</p></sec></article>", ["", "q < r"], ["", "q < r"]),
    ("<article><p/>tail</article>", [], []),
    ('<article xmlns="u"><p>q</p></article>', ["q"], []),
]


@pytest.mark.parametrize("doc,lenient,strict", ARTICLES)
def test_article_segments(spark, doc, lenient, strict):
    assert one(spark, TX.article_segments, doc) == lenient
    r = one(spark, lambda _: article_tree("v"), doc)
    assert r["status"] == "ok" and list(r["segments"]) == strict


def test_article_strict_parse_error(spark):
    r = one(spark, lambda _: article_tree("v"), "<a><p>q</a>")
    assert r["status"] == "parse_error" and r["segments"] is None and r["error"]
    assert one(spark, TX.article_segments, "<a><p>q</a>") == ["q"]


def test_word_tokens_are_lossless(spark):
    s = "  lead space\tand  tabs\nnew line "
    toks = one(spark, TX.word_tokens, s)
    assert "".join(toks) == s
    assert one(spark, TX.token_count, s) == len(toks)
