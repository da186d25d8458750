"""Token counts: byte-pair merging with a heap and a linked list, without making identifiers.

A piece of text starts as one symbol per byte (the last one carrying the end-of-word mark). The adjacent pair
of lowest rank is popped from a heap, its two nodes become one in a doubly linked list, and the pairs on
either side are pushed. The count of a piece is its initial symbols minus its merges.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows give repeated results; an
empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from harrow.session import ship

WORDS, PIECES = 900_000, 300_000  # distinct words and pieces remembered by a Python worker
ODD = regex.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PieceCounter(dict):
    """Piece -> tokens, for the vocabulary of a ``tokenizers`` file with an end-of-word suffix. Fills itself."""

    def __init__(self, model: dict):
        super().__init__()
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + suffix] for s in symbols]
        #: (left << 20 | right) -> (rank << 20 | merged symbol): the lowest value is the lowest rank
        self.pairs: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault((vocab[a] << 20) | vocab[b], (rank << 20) | vocab[a + b])

    def __missing__(self, piece: str) -> int:
        if len(self) >= PIECES:
            self.clear()
        raw = piece.encode()
        out = self[piece] = len(raw) - self.merges(raw)
        return out

    def merges(self, raw: bytes) -> int:
        """How many merges the piece undergoes."""
        n, pairs = len(raw), self.pairs.get
        sym = list(map(self.inner.__getitem__, raw))
        sym[-1] = self.final[raw[-1]]
        heap, a = [], sym[0]
        for i in range(1, n):
            b = sym[i]
            if (got := pairs(a << 20 | b)) is not None:
                heap.append(got << 32 | i - 1)
            a = b
        if not heap:
            return 0
        heapify(heap)
        after, before, done = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            if j >= n or (a := sym[i]) < 0 or pairs(a << 20 | sym[j]) != top >> 32:
                continue  # a neighbour has changed since this pair was pushed
            sym[i] = a = top >> 32 & 0xFFFFF
            sym[j] = -1
            done += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (got := pairs(a << 20 | sym[k])) is not None:
                    heappush(heap, got << 32 | i)
            h = before[i]
            if h >= 0 and (got := pairs(sym[h] << 20 | a)) is not None:
                heappush(heap, got << 32 | h)
        return done


class WordCounter(dict):
    """Word between white space -> tokens: no piece crosses white space. Fills itself from the pieces."""

    def __init__(self, path: str):
        super().__init__()
        spec = json.load(open(path, encoding="utf-8"))
        self.tokens = PieceCounter(spec["model"]).__getitem__
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split).findall

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS:
            self.clear()
        out = self[word] = sum(map(self.tokens, self.pieces(word)))
        return out

    def of_plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case is taken a character at a time
        if ODD.search(text):  # str.split() cuts at these, the vocabulary's pattern does not
            return sum(map(self.tokens, self.pieces(text.lower())))
        return sum(map(self.__getitem__, text.lower().split()))

    def count(self, text: str) -> int:
        if self.special is None or "<|" not in text:
            return self.of_plain(text)
        at, total = 0, 0
        for m in self.special.finditer(text):
            total += self.of_plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self.of_plain(text[at:])


_counters: dict[str, WordCounter] = {}


def counter(path: str) -> WordCounter:
    """One per worker process and file: its memory of pieces outlives a task."""
    if path not in _counters:
        _counters[path] = WordCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text. One pass, no shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
