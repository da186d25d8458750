import hashlib
import re

from pyspark.sql import functions as F

from harrow.llm import decontamination as dc
from tests.llm import common

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        n = min(13, len(x))
        for i in range(len(x) - n + 1 if n else 0):
            for k in range(len(w) - n + 1):
                if w[k : k + n] == x[i : i + n]:
                    hit.update(range(k, k + n))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def rows(df):
    return sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def case(spark):
    items = [(1, "Alpha beta, gamma"), (10, "Alpha beta, gamma"), (2, None), (3, "..."), (4, " ".join(f"t{i}" for i in range(20))), (4, " ".join(f"t{i}" for i in range(20)))]
    docs = [
        (1, "x ALPHA beta -- gamma y alpha"), (2, " ".join(f"t{i}" for i in range(2, 17)) + " z" * 400), (3, None), (4, ""), (5, "alpha\nbeta\ngamma alpha beta gamma"),
        (6, "z " + " ".join(f"T{i}" for i in range(20))), (6, "z " + " ".join(f"T{i}" for i in range(20))), (7, common.LONG),
    ]
    return items, docs, spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")


def test_cases_in_one_slice_and_in_many(spark):
    items, docs, tests, table = case(spark)
    want = sorted((i, *brute(t, items)) for i, t in docs)
    assert rows(dc.report(table, tests)) == want
    assert rows(dc.report(table, tests, slice_bytes=30)) == want


def test_items_without_an_id_and_remembered_windows(spark, monkeypatch):
    monkeypatch.setattr(dc, "VERIFIED", 1)
    items = [(None, "one two three"), (None, "four five"), (2, "four five"), (7, "one two three four five")]
    docs = [(1, "one two three four five one two three"), (2, "four five"), (3, "three")]
    tests, table = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    want = [(i, *brute(t, [("" if x is None else x, y) for x, y in items])) for i, t in docs]
    assert rows(dc.report(table, tests)) == want and rows(dc.report(table, tests, slice_bytes=10)) == want
    assert rows(dc.report(table, tests.where("item_id is null")))[1][3] == 1


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "one two three", 5, "x", "y", [1])], "doc_id long, text string, contamination int, Contamination_ string, `__hits` string, spans array<int>")
    tests = spark.createDataFrame([(1, "nine ten")], "item_id long, text string")
    for out in (dc.drop_contaminated(docs, tests), dc.cut_spans(docs, tests)):
        assert out.columns == docs.columns and out.collect() == docs.collect()


def test_spans_and_dropping(spark):
    _, docs, tests, table = case(spark)
    assert sorted(r.doc_id for r in dc.drop_contaminated(table, tests).collect()) == [2, 3, 4, 7]
    cut = {r.doc_id: r.text for r in dc.cut_spans(table, tests).collect()}
    assert cut[1] == "x  y alpha" and cut[5] == "" and cut[3] is None and cut[4] == "" and cut[7] == common.LONG
    assert cut[6] == "z " and cut[2].startswith(" z")


def test_table(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.length("text") < 4000)
    texts = common.texts(spark, sf)
    every = {tuple(words(t)[i : i + 13]) for _, t in items for i in range(max(1, len(words(t)) - 12))}
    for r in dc.report(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect():
        w = words(texts[r.doc_id])
        hit = any(tuple(w[i : i + 13]) in every for i in range(len(w) - 12))
        assert r.n_words == len(w) and (r.n_hit > 0) == hit
        if hit:
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(texts[r.doc_id], items)


def test_hard_rows_and_empty_tables(spark):
    items, _, tests, _ = case(spark)
    docs = common.hard(spark)
    assert rows(dc.report(docs, tests)) == sorted((i, *brute(t, items)) for i, t, *_ in common.HARD)
    nothing = tests.limit(0)
    assert all(r.n_hit == 0 for r in dc.report(docs, nothing).collect())
    assert dc.report(common.empty(spark), tests).count() == 0
