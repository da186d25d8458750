"""Phrases against a brute force: counts, redundant candidates, cuts, ties, both ways to encode."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from harrow.llm import collocations as C

from .common import HARD, empty, hard

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LETTERS)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        longer, found = defaultdict(set), []
        for q in candidates:
            for i in range(len(q)):
                for j in range(i + 2, len(q) + 1):
                    if j - i < len(q):
                        longer[q[i:j]].add(q)
        for p, a in candidates.items():
            if any(q in candidates and candidates[q] >= a for q in longer[p]):
                continue
            score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def texts(seed=5, rows=300):
    r = random.Random(seed)
    words = ["new", "York", "of", "the", "élan", "漢字", "a#b", "x" * 70, "rare%d"]
    out = []
    for _ in range(rows):
        parts = []
        for _ in range(r.randrange(40)):
            parts.append("The quick\tbrown  fox jumps over" if r.random() < 0.1 else r.choice(words).replace("%d", str(r.randrange(10**6))))
            parts.append(r.choice([" ", " ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b", "! "]))
        out.append((r.choice(["en", "de", None, "und"]), "".join(parts)))
    return [*out, ("en", None), ("en", ""), (None, " \n"), ("xx", "the the the the the the the the the the"), ("en", "New York of the " * 3000)]


@pytest.mark.parametrize("way", [{}, {"dictionary_bytes": 0}, {"dictionary_bytes": 0, "bits": 64}, {"per_range": 500}])
def test_equals_brute_force(spark, way):
    rows = texts()
    got = C.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(5), least=4, top=25, **way)
    assert [x[0] for x in got.dtypes] == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {x[1] for x in got.dtypes if x[0] not in ("lang", "phrase")} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, 25)


def test_many_chunks(spark, monkeypatch):
    """Keys of many chunks and batches add up."""
    rows = texts(7, 400)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = C.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(9), least=3, top=1000, per_range=2000)
        assert sorted(map(tuple, got.collect())) == brute(rows, 3, 1000)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_hard_rows(spark):
    """The long texts repeat words, not phrases: three of "and" with one number each are in both."""
    rows = [(lang, t) for i, t, lang, _ in HARD if i not in (6, 7)]
    short = hard(spark).where("doc_id not in (6, 7)")
    assert sorted(map(tuple, C.collocations(short, least=2, top=50).collect())) == brute(rows, 2, 50)
    long = C.collocations(hard(spark), least=20, top=50).collect()
    f = Counter()
    for t in [t for _, t, lang, _ in HARD if lang == "en" and t]:
        f.update(t.lower().split())
    assert all(r.l == f[r.phrase.split()[0]] for r in long if len(r.phrase.split()) == 2) and all(r.a >= 20 for r in long)
    assert C.collocations(empty(spark), least=2).collect() == []


def test_no_frequent_word(spark):
    assert C.collocations(spark.createDataFrame([("en", "each word once")], "lang string, text string")).collect() == []


def test_products_beyond_64_bits():
    assert 1000 * 10**13 * 10**13 > 2**63


def test_radix_order():
    r = np.random.default_rng(1)
    for kind in (np.uint16, np.uint32, np.uint64):
        columns = [r.integers(0, np.iinfo(kind).max if j else 5, 2000, dtype=kind) for j in range(3)]
        order = C.radix_order(columns)
        assert [tuple(c[i] for c in columns) for i in order] == sorted(zip(*columns, strict=True))


def test_ranges_keep_the_order_of_keys(spark):
    import pyarrow as pa

    words = pa.table({"lang": ["a"] * 40 + ["b"] * 30, "word": [f"w{i:02}" for i in range(40)] + [f"w{i:02}" for i in range(30)], "n": list(range(100, 170))})
    own = C.Dictionary(words)
    r = random.Random(3)
    keys = sorted(tuple(r.randrange(40) for _ in range(3)) for _ in range(5000))
    to = own.ranges([np.array(c, dtype=own.kind) for c in zip(*keys, strict=True)], 64)
    assert (np.diff(to) >= 0).all() and to.min() >= 0 and to.max() < 64
    assert max(np.bincount(to, minlength=64)[:30]) < 5 * 5000 / 64
