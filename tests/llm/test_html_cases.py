"""Cases of main text: linked paragraphs and items, short pages, long character references."""

import pytest

from harrow.llm import html_text as ht

LONG = "This is a long paragraph about the state of the world and it is written in such a way that there are many of the stop words in it, so it is found."


def test_links_within_an_article_stay():
    page = f"<nav><a href=/>Home</a></nav><article><h1>T</h1><p>{LONG}<p><a href=/s>Read the whole statement of the ministry on its own page</a><p>{LONG}<ul><li><a href=/1>First point</a><li>Second point</ul><pre>x = 1</pre></article><footer>by</footer>"
    assert ht.main_text(page) == "\n\n".join(["T", LONG, "Read the whole statement of the ministry on its own page", LONG, "First point", "Second point", "x = 1"])


def test_lists_of_links_within_an_article_go():
    page = f"<article><h1>T</h1><p>{LONG}</p><ul>" + "".join(f"<li><a href=/{k}>Another story number {k}</a>" for k in range(4)) + "</ul></article>"
    assert ht.main_text(page) == f"T\n\n{LONG}"


@pytest.mark.parametrize("page, text", [("<p>One line.</p>", "One line."), ("<body><p>Two short.</p><p>Paragraphs.</p>", "Two short.\n\nParagraphs."), ("just text", "just text"), ("<h1>A head</h1>", "A head"), ("<p><a href=/>only a link</a>", "")])
def test_short_pages(page, text):
    assert ht.main_text(page) == text


def test_short_text_beside_parts_that_are_out_is_still_ambiguous():
    assert ht.main_text("<nav><a href=/>Home</a></nav><p>Imprint</p><footer>by</footer>") == ""


def test_posts_of_heads_and_code():
    parts = ["Five tricks", "By A. Writer | 6 min read", LONG, "1. Const", "Use as const to create literal types:", "const config = { a: 1 } as const;", "This ensures that it is not changed.", "2. Template", "type E = `on${x}`;"]
    h = "<h1>{}</h1><p class=meta>{}</p><p>{}</p><h2>{}</h2><p>{}</p><pre><code>{}</code></pre><p>{}</p><h2>{}</h2><pre><code>{}</code></pre>".format(*parts)
    page = f"<header><nav><a href=/>Home</a></nav></header><div class=cookie-consent>Accept cookies</div><main><article class=post>{h}</article></main><div class=related-articles><h3>Related</h3><ul><li>Another</ul></div><footer>2024</footer>"
    assert ht.main_text(page) == "\n\n".join(parts)


@pytest.mark.parametrize("n", [5_000, 300_000])
def test_long_character_references(n):
    assert ht.main_text("<p>&#" + "1" * n + ";</p>") == "�" and ht.main_text("<p>" + LONG + " &#" + "0" * n + "65;") == LONG + " A"
    assert ht.main_text(f"<article><p>{LONG}<a href=/>&#" + "1" * n + "</a></article>") == LONG + "�"
    assert ht.main_text("<div class='&#" + "1" * n + f"'><p>{LONG}</div>") == LONG
