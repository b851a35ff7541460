"""Article extraction by a fold over tags against the standard library's parser."""

import random
import xml.etree.ElementTree as ET

import pytest

from annolens.functions.xml_tree import article_tree

TAGS = ("title", "p", "sec")


def parsed(doc):
    if doc is None:
        return None, "missing"
    try:
        root = ET.fromstring(doc.strip(" \t\r\n"))
    except ET.ParseError:
        return None, "parse_error"
    return [e.text.strip() for e in root.iter() if e is not root and e.tag in TAGS and e.text], "ok"


def folded(spark, docs):
    rows = spark.createDataFrame(list(enumerate(docs)), "i int, body string").select("i", article_tree("body").alias("t")).collect()
    return {r["i"]: (r["t"]["segments"], r["t"]["status"], r["t"]["error"]) for r in rows}


DOCS = [
    "<article><sec><title>T1</title><p>a <i>b</i> tail</p></sec></article>", "<article><p><b>x</b>tail</p></article>",
    "<article><p>c<!--k-->d</p><p><![CDATA[cd]]>e</p></article>", "<article><sec>\n  <p>q &lt; r</p></sec></article>", "<article><p/>tail</article>",
    '<article xmlns="u"><p>q</p></article>', "<a><p>q</a>", None, "", "  ", "plain", "<a/>", "<a/><b/>", "<a>x</a>y", "x<a/>", "<p>root is not below itself</p>",
    '<a xmlns:m="u"><m:p>no</m:p><p m:k="1">yes</p></a>', "<a><m:p>unbound</m:p></a>", '<a><p k:x="1">q</p></a>', '<a xmlns="u"><b xmlns=""><p>back</p></b><p>no</p></a>',
    '<a><p xmlns:z="u"><z:b/></p><z:c/></a>', "<a><p xml:lang='en'>q</p></a>", '<a k="1" k="2"/>', "<a k='1' k2=\"'\"><p>q</p></a>", '<a k="a>b"><p>q</p></a>', '<a k="a<b"/>',
    "<a><p>&#65;&#x1F600;&amp;lt;&quot;&apos;&gt;</p></a>", "<a><p>&nbsp;</p></a>", "<a><p>a & b</p></a>", "<a><p>&#0;</p></a>", "<a><p>&#xD800;</p></a>", '<a k="&bad;"/>', '<a k="&amp;"/>',
    "<?xml version='1.0'?><a><p>q</p></a>", "<a><?xml version='1.0'?></a>", "<a><?php x ?><p>q<?php y?>r</p></a>", "<!DOCTYPE a><a><p>q</p></a>", "<a><!DOCTYPE a></a>",
    "<a><!-- x -- y --></a>", "<a><!-- x --->", "<a><p>x]]>y</p></a>", "<![CDATA[x]]><a/>", "<a><![CDATA[x</a>", "<a><p>one\r\ntwo\rthree</p></a>", "<a><p>\x01</p></a>",
    "<a><p >q</p ></a >", "<a><p\n>q</p></a>", "< a/>", "<a><1/></a>", "<a b/>", "<a b=c/>", "</a>", "<a><p>é日本</p><é>x</é></a>", "<a><sec>  <p>x</p> </sec><title> y </title></a>", "<a><p>x</P></a>", "<a", "<a><",
]


def test_equals_the_parser(spark):
    got = folded(spark, DOCS)
    for i, d in enumerate(DOCS):
        assert got[i][:2] == parsed(d), (d, got[i])
        assert (got[i][2] is None) == (got[i][1] != "parse_error")
    assert got[DOCS.index("<a><p>q</a>")][2] == "mismatched tag"


def drawn(seed, n):
    rnd = random.Random(seed)
    bits = ["<p>", "</p>", "<sec>", "</sec>", "<title>", "</title>", "<b>", "</b>", "<br/>", "text", " ", "&amp;", "&x;", "<!-- c -->", "<![CDATA[<p>]]>", '<p xmlns="u">', '<q:p xmlns:q="v">', "</q:p>", "\n", "&#233;"]

    def element(depth):
        name = rnd.choice(["p", "sec", "title", "b"])
        inner = "".join(rnd.choice(["t ", "&lt;", "", " ", "<!--c-->"]) if rnd.random() < 0.5 or depth > 3 else element(depth + 1) for _ in range(rnd.randint(0, 4)))
        return f"<{name}{rnd.choice(['', ' a=\"1\"', ' xmlns=\"u\"', ' xmlns=\"\"'])}>{inner}</{name}>"

    out = [f"<r>{''.join(element(0) for _ in range(rnd.randint(0, 4)))}</r>" for _ in range(n)]
    for d in list(out):  # some broken at one place
        at = rnd.randrange(len(d))
        out.append(d[:at] + rnd.choice(bits) + d[at + rnd.randint(0, 3) :])
    return out


def test_drawn_documents(spark):
    docs = drawn(5, 150)
    got = folded(spark, docs)
    assert {i: g[:2] for i, g in got.items()} == {i: parsed(d) for i, d in enumerate(docs)}
    assert sum(g[1] == "ok" for g in got.values()) > 150 and sum(g[1] == "parse_error" for g in got.values()) > 50


def test_long_document(spark):
    doc = "<a>" + "<sec><p>x</p></sec>" * 2000 + "</a>"
    assert folded(spark, [doc])[0][:2] == (["x"] * 2000, "ok")


@pytest.mark.parametrize("name", ["odd name", "body"])
def test_column_names(spark, name):
    assert spark.createDataFrame([("<a><p>q</p></a>",)], f"`{name}` string").select(article_tree(name).alias("t")).first()["t"]["segments"] == ["q"]
