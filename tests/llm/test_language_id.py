import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from harrow.llm import language_id as li
from tests.llm import common


def brute_bits(train, text):
    """Code length by dictionaries."""
    follow = defaultdict(Counter)
    for t in train:
        raw = b"\0" * li.ORDER + t.encode()
        for i in range(li.ORDER, len(raw)):
            for k in range(li.ORDER + 1):
                follow[raw[i - k : i]][raw[i]] += 1
    total, raw = 0.0, b"\0" * li.ORDER + text.encode()
    for i in range(li.ORDER, len(raw)):
        for k in range(li.ORDER, -1, -1):
            seen = follow.get(raw[i - k : i])
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if raw[i] in seen:
                total -= math.log2(seen[raw[i]] / (n + d))
                break
            total -= math.log2(d / (n + d))
        else:
            total += 8
    return total


def model_of(texts):
    data, offs = li.A.buffers(pa.array(texts))
    pack, n = np.unique(li.packs(data, offs), return_counts=True)
    return pack, n.astype(float)


def test_code_lengths_equal_brute_force(monkeypatch):
    train = {"en": ["the cat sat on the mat", "the dog"], "de": ["der Hund und die Katze", "über die Straße"]}
    texts = ["the mat", "die Straße", "zzz", "", "x" * 300, "über"]
    want = [[brute_bits(train[x], t) for x in sorted(train)] for t in texts]
    coder = li.Coder({x: model_of(t) for x, t in train.items()})
    assert np.allclose(coder.code_lengths(pa.array(texts)), want)
    monkeypatch.setattr(li, "KNOWN", 3)
    assert np.allclose(li.Coder({x: model_of(t) for x, t in train.items()}).code_lengths(pa.array(texts)), want)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = li.predict(docs, li.train(docs)).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 150 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_hard_rows_and_no_training(spark):
    docs = common.hard(spark)
    out = {r.doc_id: r for r in li.predict(docs, li.train(docs)).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (1, 2, 3)) and out[6].lang_pred == "en"
    none = {r.doc_id: r.lang_pred for r in li.predict(docs, {}).collect()}
    assert set(none.values()) == {"und"}
    assert li.train(common.empty(spark)) == {} and li.predict(common.empty(spark), {}).count() == 0


def test_only_letters_count(spark):
    rows = [(i, "the cat sat on the mat", "en") for i in range(20)]
    model = li.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = ["\u00bd \u00b2", "\u2167", "12_3", "\u0663", "a", "\u6f22", "\u00aa"]
    out = {r.doc_id: r.lang_pred for r in li.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [out[i] for i in range(len(texts))] == ["und", "und", "und", "und", "en", "en", "en"]


def test_no_language_is_lost(spark):
    rows = [(i, "the cat sat on the mat " * 20, "en") for i in range(40)] + [(1000 + i, "le chat est sur la table et il dort " * 3000, "fr") for i in range(1)]
    model = li.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=2000)
    assert set(model) == {"en", "fr"} and 1000 < model["fr"][1].sum() <= 2000 and model["en"][1].sum() < 6000


def test_many_languages(spark, monkeypatch):
    rnd = random.Random(4)
    words = {f"l{k:02}": ["".join(rnd.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(30)] for k in range(64)}
    text = lambda lang: " ".join(rnd.choice(words[lang]) for _ in range(60))
    rows = [(64 * i + k, text(lang), lang) for i in range(8) for k, lang in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.train(docs, in_all=64 * 1500)
    assert set(model) == set(words)
    for known in (1 << 22, 64 * 50):  # remembered, and one language after another
        monkeypatch.setattr(li, "KNOWN", known)
        coder = li.Coder(model)
        best = coder.code_lengths(pa.array([t for _, t, _ in rows])).argmin(axis=1)
        assert sum(coder.languages[k] == lang for k, (*_, lang) in zip(best, rows, strict=True)) > 0.98 * len(rows)
        assert coder.bits.size <= max(known, 0)


def test_the_sample_is_bounded(spark):
    rows = [(i, "word " * 200, "en") for i in range(400)]
    got = li.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=20_000)
    assert 5_000 < got["en"][1].sum() < 40_000
