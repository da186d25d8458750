"""Language identification: prediction by partial matching over bytes, with frozen statistics.

Per language a context tree of up to ``ORDER`` bytes holds how often each byte followed each context in the training
texts. The probability of a byte in its longest known context is count / (n + d); where the byte was not seen there,
the escape d / (n + d) leads to the next shorter context (n: occurrences, d: distinct bytes; method C, without
exclusions), down to 1 / 256. The exact code length of a text is the sum over its bytes; the language of the
shortest code wins, and the score is its share of the probabilities under equal priors.

The trees are learned from a bounded sample: at most about ``per_language`` bytes of training text for each language
and ``in_all`` bytes for all, taken by a hash of the document id; a language always has the document of the smallest
hash, and of each document the first ``per_language`` bytes (or its share of ``in_all``) at most are learned, so that no
language is lost and no long text exceeds the bound. The trees are broadcast (a sample's contexts cannot be more than
its bytes). Statistics do not change while texts are scored, so a code length depends only on the text.

A task remembers ``KNOWN`` code lengths, whatever the number of languages; a block of texts with more distinct contexts
than that is scored one language after another.

Defined results: null texts and texts without letters (Unicode category L) give ``und`` and score 0; a tie goes to the
language first in sort order; without any training text everything is ``und``; repeated rows repeat; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm import arrays as A
from harrow.session import durable, ship

ORDER = 3
PER_LANGUAGE, IN_ALL = 4 << 20, 32 << 20
BROADCAST_ROWS = 100_000  # languages, a few numbers each, that may be broadcast; beyond that the join shuffles
LATIN = re.compile("[A-Za-z]")
KNOWN = 1 << 22  # code lengths that a task remembers, 8 bytes each
SAMPLE = 1 << 20  # steps of a share


def has_letter(text: str | None) -> bool:
    return bool(text) and (LATIN.search(text) is not None or any(map(str.isalpha, text)))


def packs(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each byte, itself and the ORDER bytes before it (zeros before the start of a text) as one number."""
    out = data.astype(np.uint32)
    place = np.arange(len(data)) - np.repeat(offs[:-1], np.diff(offs))
    for k in range(1, ORDER + 1):
        before = np.zeros(len(data), dtype=np.uint32)
        before[k:] = data[:-k] if len(data) > k else 0
        out |= np.where(place >= k, before, 0).astype(np.uint32) << np.uint32(8 * k)
    return out


class Trees:
    """The context trees of one language as sorted arrays."""

    def __init__(self, pack: np.ndarray, count: np.ndarray):
        self.levels = []
        for k in range(ORDER, -1, -1):
            node, inverse = np.unique(pack & np.uint32((1 << 8 * (k + 1)) - 1 if k < 3 else 0xFFFFFFFF), return_inverse=True)
            c = np.bincount(inverse, weights=count)
            context, at, d = np.unique(node >> np.uint32(8), return_inverse=True, return_counts=True)
            n = np.bincount(at, weights=c)
            self.levels.append((node, -np.log2(c / (n + d)[at]), context, -np.log2(d / (n + d))))

    def bits(self, pack: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each pack after the bytes before it."""
        out, todo = np.zeros(len(pack)), np.arange(len(pack))
        for k, (node, bits, context, escape) in zip(range(ORDER, -1, -1), self.levels, strict=True):
            own = pack[todo] & np.uint32((1 << 8 * (k + 1)) - 1 if k < 3 else 0xFFFFFFFF)
            at = np.minimum(np.searchsorted(node, own), len(node) - 1)
            seen = node[at] == own
            out[todo[seen]] += bits[at[seen]]
            todo, own = todo[~seen], own[~seen] >> np.uint32(8)
            at = np.minimum(np.searchsorted(context, own), len(context) - 1)
            known = context[at] == own
            out[todo[known]] += escape[at[known]]
        out[todo] += 8.0
        return out


class Coder:
    def __init__(self, model: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(model)
        self.trees = [Trees(*model[x]) for x in self.languages]
        self.known, self.bits = np.zeros(0, dtype=np.uint32), np.zeros((0, len(self.trees)))

    def columns(self, pack: np.ndarray) -> Iterator[np.ndarray]:
        """Code lengths of distinct packs, one language after another."""
        room = KNOWN // len(self.trees)
        if len(pack) > room:
            yield from (t.bits(pack) for t in self.trees)
            return
        at = np.minimum(np.searchsorted(self.known, pack), max(0, len(self.known) - 1))
        new = pack if not len(self.known) else pack[self.known[at] != pack]
        if len(new):
            if len(self.known) + len(new) > room:
                self.known, self.bits, new = self.known[:0], self.bits[:0], pack
            new = np.sort(new)
            at = np.searchsorted(self.known, new)
            self.bits = np.insert(self.bits, at, np.stack([t.bits(new) for t in self.trees], axis=1), axis=0)
            self.known = np.insert(self.known, at, new)
            at = np.searchsorted(self.known, pack)
        yield from (self.bits[at, k] for k in range(len(self.trees)))

    def code_lengths(self, column: pa.Array) -> np.ndarray:
        """Bits of each text under each language."""
        data, offs = A.buffers(column)
        out = np.zeros((len(offs) - 1, len(self.languages)))
        for a, b in A.blocks(offs):
            own = offs[a : b + 1] - offs[a]
            which, distinct = pd.factorize(packs(data[offs[a] : offs[b]], own))
            row = np.repeat(np.arange(b - a), np.diff(own))
            for k, bits in enumerate(self.columns(np.asarray(distinct))):
                out[a:b, k] = np.bincount(row, weights=bits[which], minlength=b - a)
        return out


def in_training(id_col: str) -> Column:
    """Documents whose crc32 of the id as text leaves something else than 2 by 4; the others are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 != 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, in_all: int = IN_ALL) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Counts of packs for each language, from a bounded sample of the training documents."""
    ship(docs.sparkSession)
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    given = given.where(in_training("id") & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    at = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(SAMPLE))
    totals = durable(given.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.min(F.xxhash64(F.lit("sample"), "id")).alias("first")))
    languages = totals.count()
    if not languages:
        return {}
    bound = max(1, min(per_language, in_all // languages))
    shares = totals.select("lang", F.greatest(F.lit(1), F.least(F.lit(SAMPLE), F.floor(F.lit(float(bound) * SAMPLE) / F.col("bytes")))).alias("share"), "first")
    sample = given.join(F.broadcast(shares) if languages <= BROADCAST_ROWS else shares, "lang")
    sample = sample.where((at < F.col("share")) | (F.xxhash64(F.lit("sample"), "id") == F.col("first")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for lang in table.column("lang").unique().to_pylist():
                chosen = table.filter(pa.compute.equal(table.column("lang"), lang)).column("text")
                data, offs = A.buffers(chosen)
                for a, b in A.blocks(offs, 8 << 20):
                    part, own = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                    learned = np.arange(len(part)) - np.repeat(own[:-1], np.diff(own)) < bound
                    pack, n = np.unique(packs(part, own)[learned], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(pack), pa.string()), pa.array(pack.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "pack", "n"])

    counted = sample.select("lang", "text").mapInArrow(A.tidied(count), "lang string, pack long, n long").groupBy("lang", "pack").agg(F.sum("n").alias("n"))
    found = counted.toArrow()
    out = {}
    for lang in found.column("lang").unique().to_pylist():
        own = found.filter(pa.compute.equal(found.column("lang"), lang))
        out[lang] = (own.column("pack").to_numpy().astype(np.uint32), own.column("n").to_numpy().astype(np.float64))
    return out


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) of every whole text. One pass, no shuffle."""
    ship(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(given.value)
        for batch in batches:
            texts = batch.column(1)
            letters = np.array([has_letter(t) for t in texts.to_pylist()], dtype=bool)
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            if coder.languages and len(texts):
                bits = coder.code_lengths(texts)
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.clip(bits.min(axis=1, keepdims=True) - bits, -1000, 0)).sum(axis=1)
                pred = [coder.languages[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                score = np.where(letters, share, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False)).alias("held_out")
    return docs.select(id_col, text_col, held).mapInArrow(A.tidied(run), f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")
