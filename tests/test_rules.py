"""Cases of the rules for trees, feeds, results and JSON, by hand."""

import json

from pyspark.sql import functions as F

from harrow.operators import layout as L
from harrow.operators import sinks as K

TREE = """- banner:
  - heading "Site's name" [level=1]
  - list:
    - listitem:
      - link "Home":
        - /url: /
- main
- text:   Some words
- Plain words, more:
- Button "Send"
no dash here

  - button "Go" [disabled]
- button "Go\""""


def lines(spark, text):
    return [tuple(r) for r in spark.createDataFrame([(text,)], "t string").select(F.inline(L.tree_lines(F.col("t")))).drop("raw").collect()]


def test_lines_of_trees(spark):
    assert lines(spark, TREE) == [
        (0, 0, "banner", "", ""), (1, 2, "heading", "Site's name", "[level=1]"), (2, 2, "list", "", ""), (3, 4, "listitem", "", ""), (4, 6, "link", "Home", ":"), (5, 8, "text", "/url: /", ""), (6, 0, "main", "", ""),
        (7, 0, "text", "Some words", ""), (8, 0, "text", "Plain words, more", ""), (9, 0, "Button", "Send", ""), (12, 2, "button", "Go", "[disabled]"), (13, 0, "button", "Go", ""),
    ]
    assert lines(spark, "") == [] and lines(spark, "-x\n- \n-") == [(1, 0, "text", "", "")]


def test_references_and_compact_trees(spark):
    pages = spark.createDataFrame([(1, TREE)], "p int, t string")
    tree = pages.select("p", F.inline(L.tree_lines(F.col("t"))))
    got = [(r.ref, r.line, r.nth, r.selector) for r in L.references(tree, "p", "line").orderBy("line").collect()]
    assert got == [
        ("e1", 1, None, "getByRole('heading', { name: 'Site\\'s name', exact: true })"), ("e2", 4, None, "getByRole('link', { name: 'Home', exact: true })"),
        ("e3", 12, 0, "getByRole('button', { name: 'Go', exact: true }).nth(0)"), ("e4", 13, 1, "getByRole('button', { name: 'Go', exact: true }).nth(1)"),
    ]
    text = lambda **k: [r.text for r in L.annotated(pages, "p", "t", **k).orderBy("line").collect()]
    assert text() == [
        "  - heading \"Site's name\" [level=1]", "    - listitem:", '      - link "Home" [ref=e1] :', "        - /url: /", "- text:   Some words", "- Plain words, more:", '- Button "Send"', "no dash here",
        '  - button "Go" [ref=e2] [disabled]', '- button "Go" [ref=e3]',
    ]
    assert text(interactive=False, compact=False)[:3] == ["- banner:", "  - heading \"Site's name\" [ref=e1] [level=1]", "  - list:"]


def test_rows_of_results(spark):
    cases = {'{"items": 3, "urls": [1]}': "[1]", '{"b": {"x": 1}, "zz": [2], "aa": [3]}': "[2]", '{"a": "[1]", "c": []}': "[]", '{"a": 1}': None, "[1]": None, "no": None, '{"results": [], "items": [1]}': "[]"}
    got = spark.createDataFrame([(k,) for k in cases], "j string").select("j", K.row_array(F.col("j")).alias("r")).collect()
    assert {r.j: r.r for r in got} == cases


def test_feeds_as_markdown(spark):
    kind = "struct<title:string,link:string,published:string,creator:string,summary:string,categories:array<string>,image:string>"
    entries = [("A", "l", "2024", "me", "words", ["x", "y"], "i.png"), ("(untitled)", "", None, None, "", [], None)]
    df = spark.createDataFrame([("F", "https://f/", entries), (None, "", [])], f"t string, l string, e array<{kind}>")
    got = [r[0] for r in df.select(K.feed_markdown(F.col("t"), F.col("l"), F.col("e"))).collect()]
    assert got[0] == "# F\n\nSource: https://f/\n\n## A\n- Link: l\n- Date: 2024\n- Author: me\n- Categories: x, y\n- Image: i.png\n\nwords\n\n## (untitled)\n- Link: \n" and got[1] == ""


def test_truncated_json(spark):
    cases = {
        "[1,2,3]": ([1, 2], True), "[1,2]": ([1, 2], False), '{"kind":"L","data":{"after":"t","children":[1,2,3]}}': ({"kind": "L", "data": {"after": "t", "children": [1, 2]}}, True),
        '{"data":{"children":[1]}}': ({"data": {"children": [1]}}, False), '{"data":[1,2,3]}': ({"data": [1, 2, 3]}, False), '{"children":[1,2,3]}': ({"children": [1, 2, 3]}, False),
    }
    for r in spark.createDataFrame([(k,) for k in cases], "j string").select("j", K.truncated_json(F.col("j"), 2).alias("x")).collect():
        assert (json.loads(r.x.json), r.x.truncated) == cases[r.j]


def test_markers(spark):
    rows = [r.m for r in spark.range(500).select(K.random_marker().alias("m")).collect()]
    assert len(set(rows)) == 500 and all(len(m) == 16 and int(m, 16) >= 0 for m in rows)
    assert spark.range(1).select(K.wrapped(F.lit("a"), F.lit("m"))).first()[0] == "<boundary:m>\na\n</boundary:m>"
