"""Hypothesis properties from the survey's test strategy."""

from xml.sax.saxutils import escape

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annolens.functions import text as TX
from annolens.functions.xml_tree import article_tree
from annolens.operators import resolve

FENCE = "`" * 3
line = st.text(alphabet=st.sampled_from(list("ab .!?`\t")), max_size=8)
doc = st.lists(line, max_size=6).map("\n".join)


def col_values(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.r for r in df.select("i", expr(F.col("v")).alias("r")).orderBy("i").collect()]


@settings(max_examples=10, deadline=None)
@given(st.lists(doc, min_size=1, max_size=20))
def test_fence_strip_and_punct_are_idempotent(spark, docs):
    once = col_values(spark, docs, TX.strip_fences)
    assert col_values(spark, once, TX.strip_fences) == once
    assert all(not any(x.startswith(FENCE) or x.endswith(FENCE) for x in o.split("\n")) for o in once)
    p1 = col_values(spark, docs, TX.ensure_terminal_punct)
    assert col_values(spark, p1, TX.ensure_terminal_punct) == p1
    assert all(p[-1] in ".?!" for p in p1)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 10**9).map(str), st.sampled_from(["ABC", "abc", "nope", " 12 ", ""])),
                min_size=1, max_size=15))
def test_resolver_is_total(spark, tokens):
    al = spark.createDataFrame([("ABC", 1, True), ("abc", 2, False)], "symbol string, gene_id bigint, is_official boolean")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "pos int, token string")
    out = resolve.resolve_tokens(df, "token", al).collect()
    assert sorted(r.pos for r in out) == list(range(len(tokens)))   # one row per token
    for r in out:
        t = r.token.strip()
        if t.isdigit():
            assert r.gene_id == int(t)


TAGS = ["sec", "p", "title", "b", "i", "fig"]
word = st.text(alphabet=st.sampled_from(list("xy <&>\"'\n")), max_size=6)


@st.composite
def element(draw, depth=0):
    tag = draw(st.sampled_from(TAGS))
    text = draw(word)
    kids = draw(st.lists(element(depth + 1), max_size=2)) if depth < 3 else []
    tail = draw(word)
    inner = escape(text) + "".join(kids)
    attr = draw(st.sampled_from(["", ' id="a1"', " class='k'"]))
    return f"<{tag}{attr}>{inner}</{tag}>" + escape(tail)


@settings(max_examples=25, deadline=None)
@given(st.lists(element(), min_size=1, max_size=4))
def test_lenient_equals_strict_on_well_formed(spark, kids):
    docs = ["<article>" + "".join(kids) + "</article>"]
    lenient = col_values(spark, docs, TX.article_segments)[0]
    strict = col_values(spark, docs, lambda _: article_tree("v"))[0]
    assert strict["status"] == "ok"
    assert list(lenient) == list(strict["segments"])


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab .!?\n")), max_size=30), min_size=1, max_size=15),
       st.integers(1, 3))
def test_lead_equals_first_sentence_pieces(spark, bodies, k):
    from annolens.operators.infer import LeadBackend
    df = spark.createDataFrame([(i, "Do it.\n\n" + b) for i, b in enumerate(bodies)], "i int, p string")
    from annolens.functions.prompts import payload_of
    body = payload_of(F.col("p"))
    s = TX.sentences(body)
    expected = TX.strip(F.when(F.size(s) > 0, F.array_join(F.slice(s, 1, k), "")).otherwise(body))
    rows = df.select(LeadBackend(k).native(F.col("p")).alias("a"), expected.alias("b")).collect()
    assert all(r.a == r.b for r in rows)
