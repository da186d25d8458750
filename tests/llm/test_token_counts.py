import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from harrow.llm import token_counts as tc
from tests.llm import common

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def reference(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_matches_the_library_on_the_table(spark, sf):
    docs = common.texts(spark, sf)
    for r in tc.token_counts(spark.read.parquet(f"{sf}/documents.parquet"), PATH).collect():
        text = docs[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), reference(text), reference(text) > 2048)


def test_hard_rows(spark):
    got = sorted((r.doc_id, r.n_tokens) for r in tc.token_counts(common.hard(spark), PATH).collect())
    assert got == sorted((i, reference(t)) for i, t, *_ in common.HARD)


def test_empty_table(spark):
    assert tc.token_counts(common.empty(spark), PATH).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_matches_the_library_on_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert tc.counter(PATH).count(text) == reference(text)


def test_small_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(tc, "WORDS", 3)
    monkeypatch.setattr(tc, "PIECES", 2)
    counter = tc.WordCounter(PATH)
    text = "many different words, and many more words again"
    assert counter.count(text) == reference(text)
