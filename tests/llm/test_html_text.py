import html
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from harrow.llm import html_text as ht

LONG = "This is a long paragraph about the state of the world and it is written in such a way that there are many of the stop words in it, so it is found. "


def test_table(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in ht.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(x for x in blocks if x) and r.n_chars == len(r.text)


def test_rules_without_an_article_element():
    page = (
        "<html><head><title>T</title></head><body><header class='site'><h1>Site</h1></header><div id='cookie-notice'>" + LONG + "</div><ul class='menu'><li><a href=x>Home page of all</a></ul>"
        "<div class='content'><h2>My title</h2><p>" + LONG + "<p>Short one.<p>" + LONG + "&lt;kept&gt; &eacute;<h3>Sub</h3><p>" + LONG + "</div>"
        "<section class='comments'><p>" + LONG + "</section><form><p>" + LONG + "</form><div style='display: none'>" + LONG + "</div><aside>" + LONG + "</aside><p><a href=/a>" + LONG + "</a><footer>" + LONG + "</footer>"
    )
    assert ht.main_text(page) == "\n\n".join(["My title", LONG.strip(), "Short one.", LONG + "<kept> é", "Sub", LONG.strip()])


def test_article_parts():
    page = "<body><nav>n</nav><article class=post><header><h1>Title</h1></header><p>One.<div class='share-buttons'>Share</div><p>Two  <i>words</i><br>more<script>no()</script><div class=comment-list><p>" + LONG + "</div><footer>by</footer></article><p>" + LONG
    assert ht.main_text(page) == "Title\n\nOne.\n\nTwo words more" or ht.main_text(page.replace("<p>" + LONG, "")) == "Title\n\nOne.\n\nTwo words more"


def plain(n):
    return [ht.Block("x", 0, 0, False, 0) for _ in range(n)]


def test_second_pass_takes_the_nearest_decided_neighbour():
    first = [ht.GOOD, ht.OPEN, ht.OPEN, ht.OPEN, ht.BAD]
    assert ht.second_pass(plain(5), first, [False] * 5, False) == [ht.GOOD, ht.GOOD, ht.BAD, ht.BAD, ht.BAD]


def brute_second(found, first, out, contained):
    """The rule by looking at every pair of blocks."""
    inside = [i for i in range(len(found)) if not contained or (found[i].article and not out[i])]
    labels = list(first)
    for k, i in enumerate(inside):
        if first[i] != ht.OPEN or found[i].heading:
            continue
        near = [(abs(j - k), first[x]) for j, x in enumerate(inside) if first[x] != ht.OPEN]
        near += [(k + 1, ht.GOOD), (len(inside) - k, ht.GOOD)] if contained else []
        best = {label for far, label in near if far == min(f for f, _ in near)}
        labels[i] = best.pop() if len(best) == 1 else ht.GOOD if contained and best else ht.BAD
    for i in range(len(found) - 1, -1, -1):
        if not found[i].heading or first[i] != ht.OPEN:
            continue
        end = next((j for j in range(i + 1, len(found)) if found[j].heading and first[j] == ht.OPEN), len(found))
        own = [j for j in range(i + 1, end) if not out[j] and not found[j].heading and (not contained or found[j].article)]
        gone = any(out[j] for j in range(i + 1, end))
        if own:
            labels[i] = ht.GOOD if (contained and found[i].heading == 1) or any(labels[j] == ht.GOOD for j in own) else ht.BAD
        elif contained:
            labels[i] = ht.GOOD if found[i].heading == 1 or not gone else ht.BAD
        else:
            labels[i] = labels[end] if end < len(found) else ht.BAD
    return labels


BLOCKS = st.lists(st.tuples(st.sampled_from([0, 0, 0, 1, 2]), st.sampled_from([ht.GOOD, ht.BAD, ht.OPEN, ht.OPEN]), st.booleans(), st.booleans()), max_size=14)


@settings(max_examples=600, deadline=None)
@given(BLOCKS, st.booleans())
def test_second_pass_equals_brute_force(rows, contained):
    found = [ht.Block("x", 0, heading, False, int(article or not contained)) for heading, _, article, _ in rows]
    out = [gone for *_, gone in rows]
    first = [ht.BAD if gone or (contained and not article) else ht.OPEN if heading else label for heading, label, article, gone in rows]
    assert ht.second_pass(found, first, out, contained) == brute_second(found, first, out, contained)


TEXTS = ("x", "word " * 9, "qwertz " * 12, "the house of the king and the " * 3, "qwertz " * 30, "the king of the hill and the house " * 6, "the qwertz asdf yxcv " * 12)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(TEXTS), st.sampled_from([0.0, 0.0, 0.5]), st.sampled_from([0, 0, 0, 2]), st.booleans(), st.booleans()), max_size=10))
def test_first_pass_equals_the_rules(rows):
    found = [ht.Block(t.strip(), int(len(t.strip()) * link), heading, outside, int(article)) for t, link, heading, outside, article in rows]
    got, out, contained = ht.first_pass(found, [])
    share = [sum(w in ht.STOP_WORDS for w in b.text.split()) / len(b.text.split()) for b in found]
    assert out == [b.outside for b in found]
    runs = [len(b.text) for b, x in zip(found, share, strict=True) if not b.heading and not b.outside and not b.article and b.linked <= 0.4 * len(b.text) and (len(b.text) >= 140 or (len(b.text) >= 70 and x >= 0.3))]
    inside = sum(len(b.text) for b in found if b.article and not b.outside)
    assert contained == (inside > 0 and inside >= sum(runs) / 4)
    wide = [x for b, x in zip(found, share, strict=True) if not b.outside and len(b.text) >= 70]
    for b, x, label in zip(found, share, got, strict=True):
        n = len(b.text)
        if b.outside or (contained and not b.article):
            want = ht.BAD
        elif b.heading:
            want = ht.OPEN
        elif b.linked > 0.4 * n:
            want = ht.BAD
        elif n < 70:
            want = ht.OPEN
        elif contained:
            want = ht.GOOD if x >= 0.12 or n >= 140 else ht.OPEN
        elif wide and max(wide) < 0.12:
            want = ht.GOOD if n >= 140 else ht.OPEN
        else:
            want = ht.GOOD if x >= 0.3 or (x >= 0.12 and n >= 140) else ht.OPEN if x >= 0.12 or n >= 140 else ht.BAD
        assert label == want


def test_names_are_weighed_against_what_the_parts_hold():
    for name in ("content", "has-sidebar", "with-comments", "no-ad", "page-layout-sidebar-right", "post has-sidebar", "sidebar", "widget"):
        assert ht.main_text(f"<body><nav><a href=/>Home</a></nav><div class='{name}'><h1>Title</h1><p>{LONG}<p>{LONG}</div><footer>by</footer>") == "\n\n".join(["Title", LONG.strip(), LONG.strip()]), name
    page = f"<form id=aspnetForm><div class=sidebar><p>{LONG}</div><div id=body><p>{LONG * 4}<p>{LONG * 4}</div></form>"
    assert ht.main_text(page) == "\n\n".join([(LONG * 4).strip()] * 2)
    comments = f"<article><h1>Title</h1><p>{LONG}</article><h2>Comments</h2><ol class=comment-list>" + f"<li class=comment><article class=comment-body><p>{LONG}</article>" * 30
    assert ht.main_text(comments) == "Title\n\n" + LONG.strip()
    assert ht.main_text(f"<article><p>{LONG}<h2>Comments</h2><div class=comments><p>{LONG * 9}</div></article>") == LONG.strip()


def test_what_an_article_keeps():
    page = f"<article><h1><a href=/x>Title</a></h1><div class=share-buttons>Share</div><p class='copyright-law'>Law.<div class='social-policy'>{LONG}</div><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> here <svg><g><text>no</text></g></svg>ends.<ul><li>One<li>Two</ul></article>"
    assert ht.main_text(page) == "\n\n".join(["Title", "Law.", LONG.strip(), "So x=1 here ends.", "One", "Two"])
    assert ht.main_text("<article><h1>T</h1><p>One <span style='display:none'>gone</span>two <button>Press</button>three.</article>") == "T\n\nOne two three."


def test_broken_markup_takes_linear_time():
    began = time.perf_counter()
    for unit in ("<x", "<x ", "<a '>", "<a \">", "<!--", "<![CDATA[", "<title>", "<svg>", "</", "<p><button>", "<a b=\"", "<div>", "</div>", "<td><div>", "<li>", "< ", "<a =  ", "<p class=x", "&", "<select><div>"):
        ht.main_text(unit * ((1 << 20) // len(unit)))
    assert time.perf_counter() - began < 60


def test_edge_cases(spark):
    deep = "<div>" * 3000 + LONG
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p"), (4, "u", "<script>var a = '<p>x</p>'"), (5, "u", deep), (5, "u", deep), (6, "u", "<!-- " + LONG)]
    out = sorted((r.page_id, r.n_chars) for r in ht.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert out[:4] == [(1, 0), (2, 0), (3, 0), (4, 0)] and out[4] == out[5] == (5, len(LONG.strip())) and out[6] == (6, 0)
    clash = spark.createDataFrame([(1, "u", f"<p>{LONG}", "t", 5, "x")], "page_id long, url string, html string, text string, n_chars long, page string")
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in ht.extract(clash).collect()] == [(1, "u", LONG.strip(), len(LONG.strip()))]
    assert ht.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/abpr \"'=!-&;", max_size=80))
def test_any_markup_is_read(text):
    ht.main_text(text)
