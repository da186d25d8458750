from hypothesis import given, settings
from hypothesis import strategies as st

from harrow.markup import feeds, read
from harrow.markup.dom import first, parse, select
from harrow.operators.changes import edit_script


def test_unclosed_elements():
    root = parse("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table><p>x<p>y<div>z")
    assert [n.text() for n in select(root, "li")] == ["a", "b"]
    assert [[c.text() for c in r.elements()] for r in select(root, "tr")] == [["1", "2"], ["3"]]
    assert [n.text() for n in select(root, "p")] == ["x", "y"]


def test_raw_text_and_references():
    root = parse("<script>var t='</p><b>';</script><title>a &lt;b&gt;</title><p title='&quot;q&quot;'>&amp;lt; &copy;")
    assert first(root, "title").text() == "a <b>" and first(root, "b") is None
    assert first(root, "p").text() == "&lt; ©" and first(root, "p").attrs["title"] == '"q"'


def test_selectors():
    root = parse("<div id=a class='x y'><p class=x><b data-k=v1>1</b></p><p>2</p></div><p>3</p>")
    for selector, n in (("p", 3), ("div > p", 2), ("#a p.x b", 1), ("[data-k^='v']", 1), ("[data-k$='2']", 0), ("p:last-child", 2), ("div, b", 2), ("*[class*='x']", 2), ("p + p", 1)):
        assert len(select(root, selector)) == n, selector


def test_markdown():
    html = "<h1>T</h1><p>a <b>b</b> <a href='/u'>c</a></p><ul><li>x<li>y</ul><pre><code class=language-py>k = 1\n</code></pre><table><tr><th>h<tr><td>1|2</table><script>no</script><div class=ad>no</div>"
    assert read.to_markdown(html) == "# T\n\na **b** [c](/u)\n\n-   x\n-   y\n\n```py\nk = 1\n```\n\n| h |\n| --- |\n| 1\\|2 |"


def test_article_and_gate():
    body = "<article><h1>T</h1>" + "<p>Words, words, and more words, in a long paragraph of an article, which goes on for a while, and on, and on, until it is long enough to count as text. " * 5 + "</article>"
    page = f"<body><nav><a href=/>n</a></nav>{body}<div class='comments'><p>A comment, long enough, to be taken for text by some.</div><footer>f</footer>"
    got = read.article(page)
    assert got["title"] == "T" and "Words" in got["content"] and "comment" not in got["content"]
    assert read.article("<body><p>short</body>") is None


def test_json_from_scripts_and_answers():
    assert read.script_json('<script>var a = {"x": "}\\"", "y": [1]}; b()</script>', "a") == '{"x":"}\\"","y":[1]}'
    assert read.script_json("<script>var a = {bad}</script>", "a") is None
    assert read.recovered_json('So: ```json\n[1]\n``` ok') == "[1]" and read.recovered_json("x {\"a\": 1} y }") == '{"a":1}' and read.recovered_json("no") is None


def test_robots():
    robots = "User-agent: a\nUser-agent: b\nDisallow: /x\nAllow: /x/ok\n\nUser-agent: *\nDisallow: /"
    assert feeds.allowed(robots, "/x/ok/1", "b") and not feeds.allowed(robots, "/x/1", "a") and not feeds.allowed(robots, "/y", "c") and feeds.allowed("", "/y")


def test_feed_of_atom_and_bad_xml():
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>t</title><link rel='self' href='s'/><link href='h'/><updated>u</updated><summary>&lt;b&gt;s&lt;/b&gt;</summary></entry></feed>"
    assert feeds.entries(atom)[0] | {"categories": []} == {"title": "t", "link": "h", "published": "u", "creator": None, "summary": "s", "categories": [], "image": None}
    assert feeds.entries("<rss><item>") == [] and feeds.sitemap("<urlset><url><loc>a</loc>") == ["a"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_edit_scripts_rebuild_both_sides(a, b):
    script, added, removed, kept = edit_script(a, b)
    assert [s[2:] for s in script if s[0] != "+"] == a and [s[2:] for s in script if s[0] != "-"] == b
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert kept == table[-1][-1] and added == len(b) - kept and removed == len(a) - kept


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/abp \"'=!-&;", max_size=60))
def test_any_markup_is_read(text):
    parse(text)
    read.to_markdown(text)
    read.patterns(text)


def test_deep_pages():
    from harrow.markup import read

    page = "<div>" * 5000 + "<p>deep <b>text</b></p>" + "</div>" * 5000 + "<p>after</p>"
    assert read.to_markdown(page).split("\n\n") == ["deep text", "after"]
    assert "x" in read.to_markdown("<ul><li>" * 3000 + "x") and "x" in read.to_markdown("<b><i>" * 3000 + "x")


def test_images_of_odd_pages():
    assert read.images("", "https://a.example/") == []
    assert read.images("<img src='http://[bad'><img src=''><style>x{background-image:url(a.png)}</style>", "https://a.example/b/")[0]["url"] == "https://a.example/b/a.png"
    deep = "[" * 50_000 + "]" * 50_000
    assert read.images(f'<script type="application/ld+json">{deep}</script><script type="application/ld+json">{{no</script>', "") == []


def test_paragraphs_of_lists_make_no_article():
    text = "<p>" + "words and " * 60 + "</p>"
    assert read.readable(read.parse(f"<div>{text}</div>")) and not read.readable(read.parse(f"<ul><li>{text}</li></ul>"))
    assert read.readable(read.parse("<div>" + "words and " * 60 + "<br>more</div>"))
