"""Pages written by hand, of layouts that the training pages do not have, and hostile markup."""

import time

import pytest

from junctura.llm import pages

A = "The first paragraph of the article has some twenty words in it, so that it reads like text people write."
B = "The second paragraph goes on in the same way and ends after another twenty words or so, as texts do."
TEXT = f"<p>{A}</p><p>{B}</p>"
AROUND = {
    "alone": "{}",
    "bare": "<nav><a href=/>Home</a> <a href=/b>About</a></nav>{}<footer>&copy; 2020 Some one</footer>",
    "named": "<div class=menu><a href=/>Home</a></div>{}<div class=sidebar><p>Other posts you may like</p></div><div id=comments><p>Nice one, thank you for it all.</p></div>",
    "site": "<header><h1>Site name</h1></header>{}<aside class=related><p>Some other story that you may want to read</p></aside><section id=comments><h2>Comments</h2><article class=comment><p>What a nice text this is, I like it a lot indeed.</p></article></section>",
}
PAGE_STATES = ["has-sidebar", "no-sidebar", "single-post comments-open", "with-ads", "has-cookie-banner", "header-fixed", "single widget-area", "sidebar", "comments", "page-template post-footer"]
ARTICLE_NAMES = ["review", "review-article", "post info", "main widget", "header-article", "related-article-body", "ad-free-article", "page-comments-closed", "page", "article-body", "entry-content", "hentry"]


@pytest.fixture(scope="module")
def field():
    return pages.train()


@pytest.mark.parametrize("around", ["alone", "bare", "named"])
@pytest.mark.parametrize("name", PAGE_STATES)
def test_names_of_the_page_take_no_article_away(field, around, name):
    body = AROUND[around].format(f"<article>{TEXT}</article>")
    for page in (f'<html><body class="{name}">{body}</body></html>', f'<html><body><div class="{name}">{body}</div></body></html>'):
        assert pages.main_text(page, field) == f"{A} {B}"


@pytest.mark.parametrize("around", ["alone", "bare", "site"])
@pytest.mark.parametrize("name", ARTICLE_NAMES)
def test_an_article_may_have_any_name(field, around, name):
    for tag in ("article", "div"):
        assert pages.main_text(f'<html><body>{AROUND[around].format(f"<{tag} class={chr(34)}{name}{chr(34)}>{TEXT}</{tag}>")}</body></html>', field) == f"{A} {B}"


LAYOUTS = {
    "plain divisions": (f"<body><div>{A}</div><div>{B}</div><div><a href=/>Home</a> <a href=/>About</a></div></body>", f"{A} {B}"),
    "a cell": (f"<body><table><tr><td><a href=/>Home</a></td><td><p>{A}</p></td></tr></table></body>", A),
    "cells": (f"<body><table><tr><td><a href=/1>One</a><br><a href=/2>Two</a></td><td><h1>Title here</h1>{TEXT}</td></tr></table></body>", f"Title here {A} {B}"),
    "more comments than article": (f"<body><article><h1>Title</h1><p>{A}</p></article><section id=comments>{f'<div class=comment><p>{B}</p></div>' * 10}</section></body>", f"Title {A}"),
    "publishing system": (
        f"""<body class="post-template-default single single-post postid-5 single-format-standard has-sidebar"><div id="page" class="site">
        <header class="site-header"><div class="site-branding"><p class="site-title"><a href=/>My blog</a></p></div><nav class="main-navigation"><ul><li><a href=/>Home</a></li></ul></nav></header>
        <div id="content" class="site-content"><main class="site-main"><article class="post type-post hentry"><header class="entry-header"><h1 class="entry-title">Title of it</h1></header>
        <div class="entry-content">{TEXT}</div><footer class="entry-footer"><span>Posted in News</span></footer></article>
        <div id="comments" class="comments-area"><h2>2 thoughts</h2><ol class="comment-list"><li class="comment"><article class="comment-body"><p>I like this text very much, thank you for writing it down.</p></article></li></ol></div></main></div>
        <aside class="widget-area"><section class="widget"><h2>Archives</h2><ul><li><a href=/>May</a></li></ul></section></aside><footer class="site-footer">Proudly made by people</footer></div></body>""",
        f"Title of it {A} {B}",
    ),
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layouts(field, name):
    page, text = LAYOUTS[name]
    assert pages.main_text(page, field) == text


@pytest.mark.parametrize("piece", ["<a href=", "<p class='", '<p class="', "<!-", '<a "', "<a '>", "<b x=\"'>", "<!x", "<script>", "<svg><p"])
def test_hostile_markup_takes_linear_time(field, piece):
    def seconds(n):
        began = time.perf_counter()
        pages.main_text(piece * n, field)
        return time.perf_counter() - began

    seconds(1000)
    assert min(seconds(80_000) for _ in range(3)) < 5 * min(seconds(40_000) for _ in range(3)) + 0.05


def test_tags_with_quotes():
    found = [(t, a) for _, _, _, t, a in pages.tokens("""<p title='a > b' id=x>one<a href="a<b">two</a><b c='d>three</b>""")]
    assert found == [("p", " title='a > b' id=x"), ("a", ' href="a<b"'), ("a", ""), ("b", " c='d"), ("b", "")]
