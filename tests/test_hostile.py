"""Broken and hostile pages: time in proportion to the page, no crash; the linear patterns equal the plain ones."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from harrow.functions import text as X
from harrow.markup import feeds, read
from harrow.markup.dom import first, parse, select, unescape, without_tags

MB = 1 << 20
PAGES = {
    "open tags": "<x" * (MB // 2), "one end": "<x" * (MB // 2) + ">", "open quotes": "<x \"" * (MB // 4) + ">", "odd quotes": "<a b='" + "<p c=\"d>" * (MB // 8), "less than": "<" * MB, "references": "&#1" * (MB // 3),
    "long reference": "<p title='&#" + "1" * MB + ";'>&#" + "1" * MB + ";", "scripts": "<script>" * (MB // 8), "comments": "<!--" * (MB // 4), "declarations": "<!x" * (MB // 3), "blanks": "<a " + " " * MB + "b>",
    "ends": "</p" * (MB // 3), "equals": "<a " + "b = " * (MB // 4) + ">",
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_trees_take_linear_time(name):
    began = time.perf_counter()
    parse(PAGES[name])
    assert time.perf_counter() - began < 5
    read.to_markdown(PAGES[name][:20_000])


def test_long_references_are_no_characters():
    assert unescape("&#" + "1" * 5000 + ";x") == "�x" and unescape("&#" + "0" * 5000 + "65;&#x41;&amp;&#65") == "AA&A" and unescape("&#") == "&#"
    page = parse("<p title='&#" + "9" * 5000 + "'>&#" + "9" * 5000 + ";</p>")
    assert first(page, "p").text() == "�" and first(page, "p").attrs["title"] == "�"


def test_numbers_that_int_does_not_take():
    assert read.to_markdown('<ol start="²"><li>a</ol>') == "1.  a" and read.to_markdown(f'<ol start="{"9" * 5000}"><li>a</ol>') == "1.  a" and read.to_markdown('<ol start="7"><li>a</ol>') == "7.  a"
    assert [(i["width"], i["height"]) for i in read.images(f"<img src=a.png width=²00 height={'9' * 5000}><img src=b.png width=30 height=٣>", "https://a.example/")] == [(0, 0), (30, 0)]


def test_tags_whose_quotes_do_not_match():
    root = parse("<p title=it's>a</p><p class='x'>b</p>")
    assert [n.text() for n in select(root, "p")] == ["a", "b"] and select(root, "p.x")
    assert first(parse("<p title='a>b'>c</p>"), "p").text() == "c" and parse("a < b <c").text() == "a < b <c"


def test_robots_with_many_stars():
    began = time.perf_counter()
    assert feeds.allowed("User-agent: *\nDisallow: /" + "*a" * 30 + "b", "/" + "a" * 5000)
    assert not feeds.allowed("User-agent: *\nDisallow: /" + "*a" * 30 + "b", "/" + "a" * 5000 + "b")
    assert time.perf_counter() - began < 1


def test_robots_equal_the_pattern():
    r = random.Random(2)
    for _ in range(3000):
        pattern, path = "/" + "".join(r.choice("ab*") for _ in range(r.randrange(6))) + r.choice(["", "$"]), "/" + "".join(r.choice("ab") for _ in range(r.randrange(7)))
        want = re.match(re.escape(pattern.removesuffix("$")).replace(r"\*", ".*") + ("$" if pattern.endswith("$") else ""), path) is not None
        assert feeds.matches(pattern, path) == want, (pattern, path)


def test_tags_in_texts():
    r = random.Random(4)
    for _ in range(2000):
        text = "".join(r.choice(["<", ">", "a", "\n"]) for _ in range(r.randrange(12)))
        assert without_tags(text) == re.sub(r"<[^>]*>", "", text)
    began = time.perf_counter()
    without_tags("<" * MB)
    assert time.perf_counter() - began < 1


BODY = re.compile(r"<body[^>]*>(.*?)</body>", re.I | re.S)


def plain_text(html):
    m = BODY.search(html)
    out = m[1] if m else html
    for p in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"<[^>]*>"):
        out = re.sub(p, "", out)
    return m[1] if m else None, out.strip()


def test_native_text_equals_the_patterns(spark):
    r = random.Random(6)
    parts = ["<body>", "<BODY a='1'>", "</body>", "</Body>", "<script>", "<script x", "</script>", "</SCRIPT>", "<style>", "</style>", "<p>", "</p>", "a", "İ", "b\n", "<", ">", "漢"]
    pages = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(1500)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i long, html string")
    got = df.select("i", X.inner_body(F.col("html")).alias("body"), X.body_text(F.col("html")).alias("text"), X.without_tags(F.col("html")).alias("bare"), X.crude(F.col("html")).alias("spaced"), X.title(F.col("html")).alias("title")).collect()
    for row in got:
        body, text = plain_text(pages[row.i])
        assert row.body == body and row.text == text and row.bare == re.sub(r"<[^>]*>", "", pages[row.i]) and row.spaced == " ".join(re.sub(r"<[^>]*>", " ", pages[row.i]).split()), pages[row.i]


def test_native_text_takes_linear_time(spark):
    pages = ["<script>" * 40_000, "<body " * 40_000, "<body>" * 40_000, "<" * 300_000, "<style" * 40_000 + "</style>", "<title>" * 40_000, "a<script>" * 20_000 + "</script>" + "<script" * 20_000]
    df = spark.createDataFrame([(p,) for p in pages], "html string").repartition(1)
    began = time.perf_counter()
    df.select(F.length(X.body_text(F.col("html"))), F.length(X.sanitize(F.col("html"))), F.length(X.crude(F.col("html"))), X.title(F.col("html"))).collect()
    assert time.perf_counter() - began < 20
