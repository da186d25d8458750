import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from harrow.llm import quality_rules as qr
from tests.llm import common

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, least=10):
    w = WORD.findall(text or "")
    three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for k in range(3)}
    long = Counter(tuple(w[i : i + least]) for i in range(len(w) - least + 1))
    over = {i + k for i in range(len(w) - least + 1) if long[tuple(w[i : i + least])] > 1 for k in range(least)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), sum(len(w[i]) for i in over)


def measured(texts, least=10):
    x = qr.measure(pa.array(texts, pa.string()), least)
    return list(zip(*(x[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_chars")), strict=True))


def test_table(sf, spark):
    texts = [t for t in common.texts(spark, sf).values()]
    assert measured(texts) == [brute(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n|", max_size=60), min_size=1, max_size=5))
def test_any_texts(texts):
    assert measured(texts, 4) == [brute(t, 4) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([1, 2, 3]), max_size=24))
def test_suffix_array_and_repeats(words):
    h = np.array(words, dtype=np.uint64) * np.uint64(7919)
    sa, common_ = qr.suffix_array(h, np.zeros(len(h), np.int64))
    assert sorted(sa.tolist()) == list(range(len(h)))
    for a, b, n in zip(sa[:-1].tolist(), sa[1:].tolist(), common_[1:].tolist(), strict=True):
        k = 0
        while max(a, b) + k < len(words) and words[a + k] == words[b + k]:
            k += 1
        assert k == n
    for least in (1, 3):
        found = set(zip(*(x.tolist() for x in qr.maximal_spans(sa, common_, h, np.zeros(len(h), np.int64), least)), strict=True))
        maximal, union, longest = set(), set(), 0
        for i in range(len(words)):
            for j in range(i + least, len(words) + 1):
                starts = [k for k in range(len(words)) if words[k : k + j - i] == words[i:j]]
                right = {words[k + j - i] if k + j - i < len(words) else ("end", k) for k in starts}
                left = {words[k - 1] if k else None for k in starts}
                if len(starts) > 1:
                    union |= set(range(i, j))
                    longest = max(longest, j - i)
                    if len(right) > 1 and (len(left) > 1 or None in left):
                        maximal.add((i, j - i))
        assert found <= maximal and {i + k for i, n in found for k in range(n)} == union
        assert max((n for _, n in found), default=0) == longest


def test_verdicts_and_hard_rows(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, " ".join(f"w{i}" for i in range(60))), (2, "a b c " * 40), (3, "few words"), (4, passage + " " + " ".join(f"x{i}" for i in range(200)) + " " + passage), (5, " ".join(f"z{i}" for i in range(100)) + "y" * 200)]
    out = {r.doc_id: r for r in qr.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(out[i].base_failed, out[i].kept) for i in range(1, 6)] == [(False, True), (True, False), (True, False), (False, False), (False, False)]
    loose = {r.doc_id: r.kept for r in qr.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), max_covered=40, max_repeat=60).collect()}
    assert loose[4] is True and loose[5] is True and loose[1] is True
    hard = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in qr.quality_rules(common.hard(spark)).collect())
    assert hard == sorted((i, *brute(t)[:5]) for i, t, *_ in common.HARD)
    assert qr.quality_rules(common.empty(spark)).count() == 0


def test_long_repeats_fail_texts_that_pass_the_base(spark):
    again = lambda n, m: " ".join([*(f"p{i}" for i in range(n)), *(f"x{i}" for i in range(m)), *(f"p{i}" for i in range(n))])
    docs = spark.createDataFrame([(1, again(100, 800)), (2, again(50, 120))], "doc_id long, text string")
    assert [(r.base_failed, r.kept) for r in qr.quality_rules(docs).orderBy("doc_id").collect()] == [(False, False), (False, False)]


def test_the_method_rejects_texts_that_pass_the_base(spark):
    """A twelfth of a text in a repeat of 10 words stays, a sixth goes, and so does a repeat of more than 40 words in a long text."""
    again = lambda n, m: " ".join([*(f"p{i}" for i in range(n)), *(f"x{i:04}" for i in range(m)), *(f"p{i}" for i in range(n))])
    docs = spark.createDataFrame([(1, again(10, 400)), (2, again(10, 60)), (3, again(41, 3000)), (4, again(40, 3000))], "doc_id long, text string")
    assert [(r.base_failed, r.kept) for r in qr.quality_rules(docs).orderBy("doc_id").collect()] == [(False, True), (False, False), (False, False), (False, True)]


def test_the_method_decides_on_the_table(spark):
    rows = qr.quality_rules(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("not base_failed").select("kept").collect()
    assert 0 < sum(not r.kept for r in rows) < 0.01 * len(rows)
