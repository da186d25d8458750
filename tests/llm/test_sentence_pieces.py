import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from harrow.llm import sentence_pieces as sp
from tests.llm import common

PATH = public_tokenizers.path("piece_bpe_32k.model")
CODEC = sp.codec(PATH)
PIECES = {p: (s, i) for i, (p, s, k) in enumerate(CODEC.pieces) if k == sp.NORMAL}
LONGEST = max(map(len, PIECES))


def brute(text):
    """Viterbi over the characters of the whole text, with a dictionary of pieces; ties to the earlier start."""
    if not text:
        return []
    t = (" " + text).replace(" ", sp.MARK)
    best, back = [0.0] + [float("-inf")] * len(t), [None] * (len(t) + 1)
    for i in range(len(t)):
        for j in range(i + 1, min(len(t), i + LONGEST) + 1):
            got = PIECES.get(t[i:j])
            score = got[0] if got else CODEC.unknown_score if j == i + 1 else None
            if score is not None and best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, [got[1]] if got else [CODEC.byte_id[b] for b in t[i:j].encode()])
    out, j = [], len(t)
    while j:
        i, ids = back[j]
        out = ids + out
        j = i
    return out


def test_trie_holds_the_pieces():
    trie = CODEC.trie
    for p, (_, i) in list(PIECES.items())[::7]:
        s = 0
        for c in p.encode():
            t = trie.base[s] + c
            assert trie.check[t] == s
            s = t
        assert trie.value[s] == i


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40) | st.lists(st.sampled_from(["the", " ", "  ", "\n", "é", "🎉", "ing", "漢", "\t", "x▁", "word"]), max_size=15).map("".join))
def test_encoding_equals_brute_force(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = brute(text)
    assert CODEC.encode(text) == ids
    assert sp.array("I", next(CODEC.encode_all([text]))).tolist() == ids
    if sp.MARK not in text:
        assert CODEC.decode(ids) == text


def test_parts_that_are_forgotten_change_nothing(spark, sf, monkeypatch):
    texts = [t or "" for t in common.texts(spark, sf).values()]
    want = [CODEC.encode(t) for t in texts]
    monkeypatch.setattr(sp, "PARTS", 300)
    monkeypatch.setattr(sp, "TOGETHER", 5000)
    fresh = sp.Codec(PATH)
    assert [sp.array("I", x).tolist() for x in fresh.encode_all(texts)] == want


def test_table_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = common.texts(spark, sf)
    for r in sp.encode(docs, PATH).collect()[:20]:
        assert r.token_ids == CODEC.encode(texts[r.doc_id]) and r.n_tokens == len(r.token_ids)
    assert all(r.round_trip for r in sp.round_trip(docs, PATH).collect())
    back = sp.decode(sp.encode(docs, PATH), PATH)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in texts.items()}


def test_hard_rows(spark):
    docs = common.hard(spark)
    got = sorted((r.doc_id, r.token_ids) for r in sp.encode(docs, PATH).collect())
    assert got == sorted((i, CODEC.encode(t or "")) for i, t, *_ in common.HARD)
    assert all(r.round_trip for r in sp.round_trip(docs, PATH).collect())
    assert sp.encode(common.empty(spark), PATH).count() == 0


def test_decoding_of_broken_bytes():
    assert CODEC.decode([CODEC.byte_id[0xFF], CODEC.byte_id[0x41]]) == "�A" and CODEC.decode([0]) == "⁇ "
