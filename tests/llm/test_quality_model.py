import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from harrow.llm import quality_model as qm
from tests.llm import common


def brute_model(texts):
    """Interpolated modified Kneser-Ney by dictionaries: a function (context + byte) -> probability."""
    n = qm.ORDER
    top = Counter()
    for t in texts:
        raw = b"\0" * (n - 1) + t.encode()
        top.update(raw[i : i + n] for i in range(len(raw) - n + 1))
    counts = {n: top}
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    tables = {}
    for k in range(1, n + 1):
        of = Counter(counts[k].values())
        d = qm.discounts(of[1], of[2], of[3], of[4])
        total, freed = Counter(), Counter()
        for g, c in counts[k].items():
            total[g[:-1]] += c
            freed[g[:-1]] += d[min(c, 3) - 1]
        tables[k] = (d, total, freed)

    def p(g, k=n):
        if k == 0:
            return 1 / 256
        g = g[-k:]
        d, total, freed = tables[k]
        below = p(g, k - 1)
        if g[:-1] not in total:
            return below
        c = counts[k].get(g, 0)
        return (c - d[min(c, 3) - 1] if c else 0) / total[g[:-1]] + freed[g[:-1]] / total[g[:-1]] * below

    return p


def bits(p, text):
    raw = b"\0" * (qm.ORDER - 1) + text.encode()
    return -sum(math.log2(p(raw[i : i + qm.ORDER])) for i in range(len(raw) - qm.ORDER + 1))


TRUSTED = ["the cat sat on the mat and the dog ran", "a dog and a cat ran to the mat", "the mat was on the floor, the cat on the mat", "dogs and cats and mats é"]


def test_scores_equal_brute_force(spark):
    model = qm.train(spark.createDataFrame([(t,) for t in TRUSTED], "text string").repartition(2))
    p = brute_model(TRUSTED)
    assert abs(sum(p(b"\0the"[-3:] + bytes([b])) for b in range(256)) - 1) < 1e-9
    docs = [(1, "the cat", "en"), (2, "zzz qqq ÿ", "en"), (3, None, None), (4, "", "en"), (5, common.LONG[:5000], "en"), (5, "the dog", "de")]
    got = qm.score(spark.createDataFrame(docs, "doc_id long, text string, lang string"), model)
    seen = sorted(((r.id, r.n_bytes, r.bits) for r in got.collect()), key=str)
    want = sorted(((i, len((t or "").encode()), bits(p, t) if t else None) for i, t, _ in docs), key=str)
    for a, b in zip(seen, want, strict=True):
        assert a[:2] == b[:2] and (a[2] is None if b[2] is None else abs(a[2] - b[2]) < 1e-3 * max(1, b[2]))


def test_small_blocks_change_nothing(spark, monkeypatch):
    model = qm.train(spark.createDataFrame([(t,) for t in TRUSTED], "text string"))
    docs = spark.createDataFrame([(i, t * 3, "en") for i, t in enumerate(TRUSTED * 5)], "doc_id long, text string, lang string")
    one = {r.id: r.bits for r in qm.score(docs, model).collect()}
    many = {r.id: r.bits for r in qm.score(docs.repartition(7), model).collect()}
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-6 for k in one)


def test_clean_documents_stay_and_junk_goes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").union(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100_000))
    labels = spark.read.parquet(f"{sf}/labels.parquet").union(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumn("doc_id", F.col("doc_id") + 100_000))
    clean = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 0, "clean").otherwise("toxic")
    out = qm.classify(docs, labels).join(labels, "doc_id").groupBy(clean.alias("kind")).agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.kind: r.kept for r in out}
    assert kept["clean"] > 0.98 and kept["junk"] < 0.1


def test_hard_rows_without_labels(spark):
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = common.hard(spark)
    out = {r.doc_id: r for r in qm.classify(docs, nothing).collect()}
    assert out[1].kept is False and out[2].kept is False and out[1].perplexity is None
    assert all(r.kept and abs(r.bits_per_byte - 8) < 1e-6 for i, r in out.items() if i > 2)
    assert qm.keep_good(docs, nothing).columns == docs.columns
    assert qm.classify(common.empty(spark), nothing).count() == 0


def test_trust_needs_every_label(spark):
    rows = [(1, 1, 0), (1, 0, 0), (2, 1, 0), (2, 1, None), (3, 1, 1), (4, None, 0)]
    assert [r.doc_id for r in qm.trusted_ids(spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), "doc_id").collect()] == [2]


def test_the_byte_four_places_back_counts(spark):
    model = qm.train(spark.createDataFrame([("abcdX ebcdY " * 20,)], "text string"))
    docs = spark.createDataFrame([(1, "abcdX", "en"), (2, "abcdY", "en")], "doc_id long, text string, lang string")
    bits = {r.id: r.bits for r in qm.score(docs, model).collect()}
    assert bits[2] > bits[1] + 2


def test_requests_come_back_from_their_shards():
    g = np.unique(np.random.default_rng(1).integers(0, 1 << 8 * qm.ORDER, 5000))
    back = [qm.undealt(body, k) for k, body in enumerate(qm.dealt(g))]
    assert np.array_equal(np.sort(np.concatenate(back)), g) and all((x % qm.SHARDS == k).all() for k, x in enumerate(back))


def test_an_outlier_is_no_threshold(spark):
    rows = [("=de", 2.0 + i / 1000) for i in range(99)] + [("=de", 4.0)] + [("=en", 3.0 + i / 5000) for i in range(1000)] + [("=fr", 5.0)]
    at = {r["__lang"]: r["at"] for r in qm.thresholds(spark.createDataFrame(rows, "__lang string, bits_per_byte double"), qm.QUANTILE).collect()}
    assert 2.0 < at["=de"] < 2.3 and abs(at["=en"] - 3.196) < 0.01 and 5.0 <= at["=fr"] < 5.6


def test_nothing_is_left_in_the_catalogue(spark):
    before = {t.name for t in spark.catalog.listTables()}
    docs = spark.createDataFrame([(i, f"some text {i}", "en") for i in range(20)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    assert qm.classify(docs, labels).count() == 20
    assert {t.name for t in spark.catalog.listTables()} == before


def test_ids_are_broadcast_by_their_size(spark, monkeypatch):
    rows = spark.createDataFrame([(f"id{i}", i) for i in range(50)], "doc_id string, n long")
    ids = spark.createDataFrame([("id3",), ("id3",), (None,), ("id7",)], "doc_id string")
    for limit in (0, 1 << 20):
        monkeypatch.setattr(qm, "BROADCAST_BYTES", limit)
        out = qm.semi(rows, ids, "doc_id", "left_semi")
        assert sorted(r.n for r in out.collect()) == [3, 7]
