"""Segments against brute force, the law and the curve, held-out accuracy, hard rows."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from harrow.llm import toxicity as T

from .common import empty, hard


def all_maximal(x):
    """Maximal scoring segments by definition: the best segment (shortest, then leftmost), and the same on either side of it."""

    def within(a, b):
        best = max(((sum(x[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        _, _, _, i, j = best
        return [*within(a, i), (i, j, best[0]), *within(j, b)]

    return within(0, len(x))


@given(st.lists(st.integers(-6, 6), min_size=1, max_size=24))
@settings(max_examples=300, deadline=None)
def test_segments_are_the_maximal_ones(x):
    got = T.segments(np.array(x))
    want = all_maximal(x)
    assert sorted(s for *_, s in got) == sorted(s for *_, s in want)
    assert all(sum(x[a:b]) == s for a, b, s in got) and all(b <= c for (_, b, _), (c, _, _) in zip(got, got[1:], strict=False))


def test_segments_in_linear_time():
    import time

    for x in (np.tile([3, -2], 200_000), np.tile([1, -3], 200_000), np.concatenate([np.tile([1, -2], 100_000), np.tile([2, -1], 200_000)]), np.repeat([-1, 1], 200_000)):
        began = time.perf_counter()
        T.segments(x)
        assert time.perf_counter() - began < 5


def model(**scores):
    keys, toxic, clean = [], [], []
    for w, (t, c) in scores.items():
        words = T.Words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))
        for k in words.keys:
            keys.append(k[0]), toxic.append(t), clean.append(c)
    return T.Model(np.array(keys, dtype=np.uint64), np.array(toxic), np.array(clean), 0.2)


def test_best_scores_of_a_block_equal_the_segments():
    m = model(vile=(50, 0), mild=(2, 20), soso=(9, 20))
    r = random.Random(2)
    texts = [" ".join(r.choice(["vile", "mild", "soso", "other"]) for _ in range(r.randrange(30))) for _ in range(50)] + ["", "..."]
    for _, _, words in T.blocks(pa.array(texts)):
        x = m.token_scores(words)[words.which]
        for i, (n, best, found) in enumerate(m.texts(words)):
            own = x[words.row == i]
            assert n == len(own) == len(texts[i].split()) if texts[i] != "..." else n == 0
            every = all_maximal(own.tolist())
            assert best == max((s for *_, s in every), default=0)
            assert sorted(s for *_, s in found) == sorted(s for *_, s in every if s >= m.least(n))


def test_log_odds():
    """A word takes its stem's odds, a stem those of all; what is left out of its own counts is less."""
    m = model(vile=(50, 0))
    (_, _, words), *_ = T.blocks(pa.array(["vile vileness other"]))
    vile, vileness, other = m.token_scores(words).tolist()
    assert other == round(-T.COST * T.UNIT) and vile > vileness > 0
    assert m.token_scores(words, True)[0] < vile


def test_law_is_found_again():
    r = np.random.default_rng(4)
    n = r.integers(20, 2000, 20_000)
    best = np.maximum(0, (np.log(0.05 * n) + r.gumbel(size=len(n))) / 2.5)
    decay, k = T.fit_law(n, best, np.ones(len(n)))
    assert abs(decay - 2.5) < 0.1 and abs(math.log(k / 0.05)) < 0.15


def test_evidence_grows_with_scores_and_falls_with_length():
    m = model()
    m.decay, m.k = 1.5, 0.1
    one = m.evidence(100, 600, [(0, 1, 600)])
    assert m.evidence(100, 700, [(0, 1, 700)]) > one > m.evidence(1000, 600, [(0, 1, 600)]) > 0 == m.evidence(100, 0, []) == m.evidence(0, 0, [])
    assert m.evidence(1000, 400, [(0, 1, 400)] * 5) > m.evidence(1000, 400, [(0, 1, 400)])


def corpus(spark, n=1500, seed=9):
    r = random.Random(seed)
    plain, vile = [f"wort{i}" for i in range(300)], ["Scumbag", "MORON", "scumbags"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        words = [r.choice(plain) for _ in range(r.randrange(20, 200))]
        if toxic:
            at = r.randrange(len(words))
            words[at:at] = [r.choice(vile) for _ in range(3)]
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), docs


def test_held_out_documents_and_passages(spark):
    docs, labels, texts = corpus(spark)
    rows = T.predict(docs, T.train(docs, labels)).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows) and len(held) > 200
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in held) >= 0.99 * len(held)
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    for r in held:
        if r.doc_id % 6 == 0:
            assert any("scumbag" in texts[r.doc_id][1][p.start : p.end].lower() or "moron" in texts[r.doc_id][1][p.start : p.end].lower() for p in r.passages)


def test_held_out_labels_teach_nothing(spark):
    from pyspark.sql import functions as F

    docs, labels, _ = corpus(spark, 400)
    turned = labels.withColumn("toxic", F.when(T.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in T.predict(docs, T.train(docs, x)).collect()) for x in (labels, turned))
    assert a == b


def test_held_out_accuracy_on_the_tables(spark):
    """Documents of sf0.01 that teach nothing: those labelled toxic score higher than others."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    rows = T.predict(docs, T.train(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert sum((a > b) + (a == b) / 2 for a in bad for b in good) >= 0.8 * len(bad) * len(good)
    assert sum(s >= 0.5 for s in good) <= 0.05 * len(good)


def test_hard_rows(spark):
    docs, labels, _ = corpus(spark, 300)
    m = T.train(docs, labels)
    rows = T.predict(hard(spark), m).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    none = {r.doc_id: r.score for r in rows}
    assert none[1] == none[2] == none[3] and rows[0].passages == []
    assert T.predict(empty(spark), m).collect() == []


def test_without_both_labels(spark):
    docs = hard(spark)
    for rows, want in (([], 0.0), ([(4, 0), (11, 0)], 0.0), ([(4, 1), (11, 1), (6, 1), (7, 1), (8, 1), (9, 1)], 1.0), ([(None, 1), (4, None), (777, 1)], None)):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        got = {r.score for r in T.predict(docs, T.train(docs, labels)).collect()}
        assert len(got) == 1 and (want is None or abs(got.pop() - want) < 1e-9)
    assert len(T.predict(docs, T.train(empty(spark), spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int"))).collect()) == 12
