"""HTML extraction where names and article elements must not decide alone."""

import pytest

from annolens.llm.html import main_text

LONG = "Some sentence of the article that goes on for a while and then ends."
PARTS = "".join(f"<p>{LONG}</p>" for _ in range(4))
TEXT = "\n".join([LONG] * 4)
LINKS = "".join(f"<li><a href=/{i}>Link number {i}</a></li>" for i in range(8))


@pytest.mark.parametrize("wrapper", ["class='layout has-sidebar'", "class='no-sidebar'", "class=with-nav", "class=nav-open", "id=page-header-wrap", "class=social-science", "class=no-comments", "class=widget", "class=hiddenGem"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_names_of_wrappers_lose_nothing(wrapper, tag):
    assert main_text(f"<body><div {wrapper}><{tag}>{PARTS}</{tag}></div></body>") == TEXT


def test_a_form_around_the_page_loses_nothing():
    assert main_text(f"<form id=aspnet><article>{PARTS}</article></form>") == TEXT


@pytest.mark.parametrize("name", ["ad", "comments", "cookie-notice", "share"])
def test_small_named_blocks_go(name):
    assert main_text(f"<div><div>{PARTS}<div class='{name} x1'>Some words here.</div></div></div>") == TEXT


def test_link_lists_in_main_are_judged_by_density():
    page = f"<main><ul>{LINKS}</ul><div><h1>Head</h1>{PARTS}</div><div>{LINKS}</div></main>"
    assert main_text(page) == f"Head\n{TEXT}"


def test_sibling_articles_stay():
    page = f"<nav>{LINKS}</nav><div><article><h1>One</h1>{PARTS}</article><article>{PARTS}</article><ul>{LINKS}</ul></div>"
    assert main_text(page) == f"One\n{TEXT}\n{TEXT}"


def test_math_object_and_unclosed_media():
    page = f"<article><p>Let <math><mi>x</mi></math> be <object data=f>a figure</object>.</p><video src=v><svg><p>{LONG}</p><object><p>{LONG}</p></article>"
    assert main_text(page) == f"Let x be a figure.\n{LONG}\n{LONG}"


def test_links_beside_the_core_go_from_inside_a_block():
    many = "".join(f"<a href=/{i}>Other page number {i}</a> " for i in range(20))
    assert main_text(f"<div>{many}<div>{PARTS}</div></div>") == TEXT


NAMES = ["comment-list", "comments-area", "comments-section", "post-comments", "comment-body", "commentlist", "cookie-bar", "site-notice", "ad-container", "related-posts", "share-buttons", "site-footer", "newsletter-box"]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("tag", ["article", "div"])
def test_usual_names_of_boilerplate_go(name, tag):
    block = f"<div class='{name}'><p>Somebody has said a thing or two about it.</p><p>And another one.</p></div>"
    assert main_text(f"<{tag}>{PARTS}{block}</{tag}>") == TEXT


def test_comments_longer_than_the_article_go():
    many = "".join(f"<div class=comment><p>A reader has written number {i} of these comments, at some length.</p></div>" for i in range(40))
    for name in ("comments", "comment-list"):
        assert main_text(f"<div><div><h1>Head</h1>{PARTS}</div><div class={name}>{many}</div></div>") == f"Head\n{TEXT}"


def test_a_named_wrapper_of_the_article_stays_beside_other_text():
    assert main_text(f"<div class=widget><div>{PARTS}</div></div><div>Copyright by me</div>") == TEXT


@pytest.mark.parametrize("tag", ["section", "div"])
def test_a_smaller_sibling_keeps_its_heading_and_paragraphs(tag):
    page = f"<body><{tag}><h2>HEAD1</h2>{PARTS}</{tag}><{tag}><h2>HEAD2</h2><p>BBB</p><p>CCC</p></{tag}></body>"
    assert main_text(page) == f"HEAD1\n{TEXT}\nHEAD2\nBBB\nCCC"


def test_a_header_in_the_core_keeps_its_title():
    assert main_text(f"<header><h1>Site</h1></header><div class=post><header><h1>Title</h1></header>{PARTS}</div>") == f"Title\n{TEXT}"


def plain_density(html_blocks):
    """Characters outside links for each block: an independent, plain measure for pages of flat blocks."""
    return [len(text) * (1 - links) for text, links in html_blocks]


def test_generated_pages_without_article_elements():
    """Flat blocks of drawn sizes around an article: what has long plain paragraphs stays, link lists and named blocks go."""
    import random

    rnd = random.Random(9)
    for _ in range(60):
        menu = "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(rnd.randint(3, 30)))
        paragraphs = [" ".join(rnd.choices(LONG.split(), k=rnd.randint(12, 40))) for _ in range(rnd.randint(3, 9))]
        named = f"<div class='{rnd.choice(NAMES)}'><p>{' '.join(rnd.choices(LONG.split(), k=rnd.randint(3, 12)))}</p></div>"
        blocks = [(f"<p>{p}</p>", 0.0) for p in paragraphs]
        assert min(plain_density(blocks)) > 3 * max(plain_density([(menu, 1.0)]))
        body = "".join(b for b, _ in blocks)
        parts = [f"<ul>{menu}</ul>", f"<div>{body}</div>", named]
        rnd.shuffle(parts)
        assert main_text(f"<body><div>{''.join(parts)}</div></body>") == "\n".join(paragraphs)
