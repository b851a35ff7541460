"""HTML extraction: page kinds, character references, broken markup, whole table."""

import re
from html import unescape

import pytest

from annolens.llm.html import extract, main_text

LONG = "Some sentence of the article that goes on for a while and then ends."


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("   ", ""), ("<p>", ""), ("<script>x</script>", ""),
    ("plain words", "plain words"),
    ("<p>a &amp; b&nbsp;&lt;c&gt;\n\n d &#233;&eacute;</p>", "a & b <c> d éé"),
    (f"<body><nav><ul><li><a href=x>Home</a></ul></nav><div class='ad'>Buy now please</div><article><h1>Head</h1><p><b>{LONG}<br><p>Two</p></article><footer>&copy; me", f"Head\n{LONG}\nTwo"),
    (f"<header>Site</header><div id=main><h1>T</h1><p>{LONG}</p><p>{LONG}</p><div class=comments><p>{LONG}</p></div></div><aside>{LONG}</aside>", f"T\n{LONG}\n{LONG}"),
    (f"<main><article><header><h1>T</h1></header><section><p>{LONG}</p><p>{LONG}</p></section><section><p>{LONG}</p></section><form>Mail <input></form></article></main>", f"T\n{LONG}\n{LONG}\n{LONG}"),
    (f"<div><p>{LONG}</p><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></div><!-- hidden <p>no</p> -->", f"{LONG}\none\ntwo\nx\ny"),
    (f"<div class=\"cookie-notice\">We use</div><div><p>{LONG}</p><p>{LONG} <a href='u'>with a link</a>.</p></div><script>var t='</p>'", f"{LONG}\n{LONG} with a link."),
    (f"<article><p>{LONG}</p></article><div><a href=a>one</a><a href=b>two</a></div>", LONG),
    (f"<article><p>{LONG}</p><p>cut <b", f"{LONG}\ncut"),
    (f"<article class=ad><p title=\"a>b\" hidden>no</p><p title='a>b'>{LONG}</p></article>", LONG),
    ("<article><p>x&amp", "x&"),
    ("<article><p>x &am", "x &am"),
])
def test_pages(html, text):
    assert main_text(html) == text


def test_density_picks_the_article_without_names():
    links = "".join(f"<li><a href=/{i}>Link number {i}</a></li>" for i in range(30))
    page = f"<div><ul>{links}</ul></div><div><div><p>{LONG}</p><p>{LONG}</p></div><div><p>{LONG}</p></div></div><div>{links}</div>"
    assert main_text(page) == f"{LONG}\n{LONG}\n{LONG}"


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = extract(pages).collect()
    assert len(got) == pages.count()
    for r in got:  # the pages' own template, by plain patterns
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"<(?:/?p|/?h1)>", body)]
        assert r["text"] == "\n".join(x for x in blocks if x)
    odd = spark.createDataFrame([(None, None, "t"), (1, "", "t"), (1, "<p>" + "<div>" * 3000 + "x" * 100000, "t")], "page_id long, html string, text string")
    assert sorted(len(r["text"]) for r in extract(odd, keep=["page_id"]).collect()) == [0, 0, 100000]
