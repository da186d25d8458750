"""Toxicity: maximum-scoring segments over token log-odds, aggregated by extreme-value statistics.

Tokens are maximal runs of a-z, digits and non-ASCII bytes of the lower-cased text. Training counts, for each word and
for its first ``STEM`` characters, in how many toxic and in how many other documents of the sample it occurs. Log-odds
have Dirichlet priors: a stem's share of toxic documents is drawn to the share of all tokens by ``MASS`` pseudo-counts,
a word's to that of its stem. So a word never seen has the odds of its stem, and one of an unknown stem has none.

A token's score is its log-odds less ``COST``. A scan in linear time finds every maximal scoring segment of a text (each
word run that neither a longer nor a shorter neighbour improves). The best segment of texts that are not toxic follows an
extreme-value law, P(best >= x) = 1 - exp(-K n exp(-lambda x)) for n words, whose two parameters are fitted by maximum
likelihood on the sample's clean documents, texts without a positive token as censored ones. Segments beyond ``EXPECTED``
by chance are passages; the evidence of a document is the sum statistic of its best segments, and a logistic curve over
its logarithm, fitted on the sample, turns evidence into a probability. In fitting law and curve a document's own
counts are left out of its scores.

The sample: labelled documents by a hash of their id, at most about ``IDS`` of either label and, of these, about
``BYTES`` of text for either label; texts beyond ``LONGEST`` bytes are scored, not learned from; equal texts of one label
count once. Words and stems of fewer than ``LEAST`` documents take the odds below them. So the model that is broadcast
has at most 2 * 2 * BYTES / (2 * LEAST) entries of 16 bytes, whatever the input.

Defined results: null and empty texts have no words and the score of no evidence; labels that are null and labels of
unknown or null ids are ignored; a document labelled both ways is toxic; with one label only (or none) every score is
the share of toxic documents among the labelled ones (0 without labels); rows without an id are scored and not learned
from; repeated rows repeat; an empty table gives an empty result; very long texts are scored whole, in time in proportion
to their length; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm import arrays as A
from harrow.session import durable, ship

STEM = 4
MASS, COST = 10.0, 0.4
LEAST = 3
IDS, BYTES, LONGEST = 200_000, 24 << 20, 1 << 20
EXPECTED = 0.05
UNIT = 64  # steps of a score; scores are whole numbers, so sums are exact
BINS = 32  # steps of the logarithm of evidence
SHARES = 1 << 30


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


class Words:
    """The tokens of a block of texts: places, rows, and which distinct token each is."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.rows, self.text_starts = data, len(offs) - 1, offs[:-1]
        self.starts, self.ends, self.row = A.words(data, offs, A.ALNUM)
        which, _ = pd.factorize(A.word_hashes(data, self.starts, self.ends))
        self.which = np.asarray(which, dtype=np.int64)
        first = np.zeros(int(self.which.max(initial=-1)) + 1, dtype=np.int64)
        first[self.which[::-1]] = np.arange(len(self.which))[::-1]
        starts, ends = self.starts[first], self.ends[first]
        chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        stem = np.minimum(chars[np.minimum(np.searchsorted(chars, starts) + STEM, len(chars) - 1)], ends)
        #: keys of the distinct tokens: stems with the last bit clear, words with it set.
        self.keys = [A.word_hashes(data, starts, stem) & A.U(0xFFFFFFFFFFFFFFFE), A.word_hashes(data, starts, ends) | A.U(1)]


def blocks(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    data, offs = A.buffers(pc.utf8_lower(column))
    for a, b in A.blocks(offs):
        yield a, b, Words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])


class Model:
    """Counts of documents by token, the law of the best segment and the curve from evidence to a probability."""

    def __init__(self, keys: np.ndarray, toxic: np.ndarray, clean: np.ndarray, base: float):
        order = np.argsort(keys)
        self.keys, self.toxic, self.clean, self.base = keys[order], toxic[order].astype(np.float32), clean[order].astype(np.float32), base
        self.decay, self.k = 1.0, 1.0
        self.at, self.slope = 0.0, 0.0

    def token_scores(self, words: Words, own: bool | None = None) -> np.ndarray:
        """The score of each distinct token; ``own``: without the counts of a document of that label."""
        p = np.full(len(words.keys[0]), self.base)
        for keys in words.keys:
            at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
            known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)
            t, c = np.where(known, self.toxic[at], 0.0) if len(self.keys) else np.zeros(len(keys)), np.where(known, self.clean[at], 0.0) if len(self.keys) else np.zeros(len(keys))
            if own is not None:
                t, c = np.maximum(t - own, 0), np.maximum(c - (not own), 0)
            p = (t + MASS * p) / (t + c + MASS)
        p = np.clip(p, 1e-9, 1 - 1e-9)
        odds = np.log(p / (1 - p)) - math.log(self.base / (1 - self.base))
        return np.rint((odds - COST) * UNIT).astype(np.int64)

    def evidence(self, n: int, best: int, segments: list[tuple[int, int, int]]) -> float:
        """Minus the logarithm of the chance that clean text of ``n`` words has segments as good."""
        if n == 0 or best <= 0:
            return 0.0
        room = math.log(self.k * n)
        expected = math.exp(min(50.0, room - self.decay * best / UNIT))
        found = -math.log(-math.expm1(-expected)) if expected > 1e-12 else self.decay * best / UNIT - room
        total = 0.0
        for r, s in enumerate(sorted((x[2] for x in segments), reverse=True), 1):
            total += self.decay * s / UNIT - room
            if r > 1 and total > r:
                found = max(found, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2))
        return max(0.0, found)

    def texts(self, words: Words, own: bool | None = None) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(words, best score, segments expected once or less by chance) of each text of a block."""
        x = self.token_scores(words, own)[words.which]
        n = np.bincount(words.row, minlength=words.rows)
        ends = np.cumsum(n)
        # the best segment of every text at once: the running sum less its least value so far, from text to text anew
        total = np.zeros(len(x) + words.rows, dtype=np.int64)
        at = np.arange(len(x)) + words.row + 1
        total[at] = x
        total = np.cumsum(total)
        row = np.repeat(np.arange(words.rows), n + 1)
        lowered = total - (row << 41)
        rise = lowered - np.minimum.accumulate(lowered)
        best = np.maximum.reduceat(rise, np.cumsum(n + 1) - (n + 1)) if words.rows else np.zeros(0, np.int64)
        for i, (k, m) in enumerate(zip(n.tolist(), best.tolist(), strict=True)):
            least = self.least(k)
            yield k, m, [s for s in segments(x[ends[i] - k : ends[i]]) if s[2] >= least] if k and m >= least else []

    def least(self, n: int, expected: float = 1.0) -> float:
        """The score that segments of ``n`` clean words reach ``expected`` times."""
        return max(1.0, UNIT * math.log(self.k * max(n, 1) / expected) / self.decay)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.at + self.slope * math.log1p(evidence)))))


def segments(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, score) of all maximal scoring segments of a text's token scores, in order and in linear time.

    Each run of positive scores is a candidate. One is joined to the nearest candidate on its left that begins lower,
    when that one ends lower too; candidates in between begin no lower, and each remembers the one it stopped at.
    """
    up = x > 0
    turns = np.flatnonzero(up[1:] != up[:-1]) + 1
    begins = np.concatenate(([0], turns))
    sums = np.add.reduceat(x, begins)
    stops = np.append(turns, len(x))
    left: list[int] = []  # sums before and after each candidate, its first and last token, and the place it points to
    right: list[int] = []
    first: list[int] = []
    last: list[int] = []
    lower: list[int] = []
    so_far = 0
    for a, b, s, positive in zip(begins.tolist(), stops.tolist(), sums.tolist(), up[begins].tolist(), strict=True):
        low, high, begin, so_far = so_far, so_far + s, a, so_far + s
        if not positive:
            continue
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= low:
                j = lower[j]
            if j < 0 or right[j] >= high:
                break
            low, begin = left[j], first[j]
            for column in (left, right, first, last, lower):
                del column[j:]
        left.append(low)
        right.append(high)
        first.append(begin)
        last.append(b)
        lower.append(j)
    return [(a, b, h - lo) for a, b, h, lo in zip(first, last, right, left, strict=True)]


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame | None, dict[bool, float]]:
    """(id, text, toxic) of the sample, and how many labelled documents of the training part one of the sample stands for."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("__id")).agg((F.max(label_col) >= 1).alias("__toxic"))
    known = durable(known)
    place = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("__id").cast("string")), F.lit(SHARES))
    counts = {r["__toxic"]: r["n"] for r in known.groupBy("__toxic").agg(F.count(F.lit(1)).alias("n")).collect()}

    def chosen(bounds: dict[bool, float]) -> Column:
        return F.when(F.col("__toxic"), place < int(bounds.get(True, 0) * SHARES)).otherwise(place < int(bounds.get(False, 0) * SHARES))

    shares = {k: min(1.0, IDS / n) for k, n in counts.items()}
    given = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).where(F.col("__id").isNotNull() & (F.octet_length("text") <= LONGEST))
    sizes = given.join(F.broadcast(known.where(chosen(shares))), "__id").groupBy("__toxic").agg(F.sum(F.octet_length("text")).alias("bytes"))
    sizes = {r["__toxic"]: r["bytes"] or 0 for r in sizes.collect()}
    shares = {k: shares[k] * min(1.0, BYTES / max(1, sizes.get(k, 0))) for k in counts}
    if not counts:
        return None, {}
    sample = given.join(F.broadcast(known.where(chosen(shares))), "__id").dropDuplicates(["__toxic", "text"])
    return durable(sample.select("__id", "text", F.col("__toxic").alias("toxic"))), {k: 1 / max(shares[k], 1e-9) for k in counts} | {"toxic": counts.get(True, 0), "all": sum(counts.values())}  # type: ignore[dict-item]


def count_tokens(sample: DataFrame) -> DataFrame:
    """(key, toxic, clean): in how many documents of either label each stem and word occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.asarray(batch.column(1).to_pylist(), dtype=bool)
            for a, b, words in blocks(batch.column(0)):
                for keys in words.keys:
                    key = keys[words.which]
                    _, at = np.unique(A.splitmix(key + A.splitmix(words.row + 1)), return_index=True)  # one for each document that has it
                    code, distinct = pd.factorize(key[at])
                    toxic = np.bincount(code, weights=label[a:b][words.row[at]], minlength=len(distinct)).astype(np.int64)
                    every = np.bincount(code, minlength=len(distinct))
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(distinct).view(np.int64)), pa.array(toxic), pa.array(every - toxic)], names=["key", "toxic", "clean"])

    out = sample.select("text", "toxic").mapInArrow(A.tidied(run), "key long, toxic long, clean long")
    return out.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit_law(n: np.ndarray, best: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(lambda, K) of largest likelihood for best scores (in nats) of clean texts of ``n`` words; a best score of 0 is censored."""
    seen = float(weight[best > 0].sum())
    if seen == 0:
        return 1.0, 1.0
    total = float((weight * best).sum())

    def slope(decay: float) -> float:
        w = weight * n * np.exp(-decay * best)
        return seen / decay - total + seen * float((w * best).sum()) / float(w.sum())

    low, high = 1.0, 20.0  # of exact log-odds it is 1, and the cost raises it
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if slope(mid) > 0 else (low, mid)
    return low, seen / float((weight * n * np.exp(-low * best)).sum())


def fit_curve(z: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of the logistic curve over ``z`` for weighted counts of either label."""
    beta = np.zeros(2)
    x = np.stack([np.ones(len(z)), z], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (toxic - (toxic + clean) * p) - 1e-2 * beta
        step = np.linalg.solve((x.T * ((toxic + clean) * p * (1 - p))) @ x + 1e-2 * np.eye(2), gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(0.0, beta[1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model of a bounded sample of labelled documents that are not held out."""
    spark = docs.sparkSession
    ship(spark)
    sample, weights = labelled(docs, labels, id_col, text_col, label_col)
    base = weights["toxic"] / weights["all"] if weights else 0.0  # type: ignore[index]
    none = Model(np.zeros(0, dtype=A.U), np.zeros(0), np.zeros(0), 0.5)
    none.at = -700.0 if base == 0 else 700.0 if base == 1 else math.log(base / (1 - base))
    if sample is None or base in (0.0, 1.0):
        return none
    counted = durable(count_tokens(sample))
    sums = counted.where("key & 1 = 1").agg(F.sum("toxic"), F.sum("clean")).first()
    if not sums[0] or not sums[1]:
        return none
    kept = counted.where(F.col("toxic") + F.col("clean") >= LEAST).toArrow()
    model = Model(kept.column("key").to_numpy().view(A.U), kept.column("toxic").to_numpy(), kept.column("clean").to_numpy(), sums[0] / (sums[0] + sums[1]))
    given = spark.sparkContext.broadcast(model)

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given.value
        for batch in batches:
            label = np.asarray(batch.column(1).to_pylist(), dtype=bool)
            for own in (False, True):
                rows = []
                for _, _, words in blocks(batch.column(0).filter(pa.array(label == own))):
                    rows += [(n, m) for n, m, _ in model.texts(words, own)]
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(rows), pa.bool_()), pa.array([max(1, n) for n, _ in rows], pa.int64()), pa.array([m for _, m in rows], pa.int64())], names=["toxic", "n", "best"])

    # lengths by sixteenths of a power of two, scores by their steps: the table that comes to the driver has a bound
    found = sample.select("text", "toxic").mapInArrow(A.tidied(stats), "toxic boolean, n long, best long").where("not toxic")
    table = found.groupBy(F.round(F.log2("n") * 16).cast("int").alias("n"), F.least(F.col("best"), F.lit(64 * UNIT)).alias("best")).count().toArrow()
    model.decay, model.k = fit_law(np.exp2(table.column("n").to_numpy() / 16), table.column("best").to_numpy() / UNIT, table.column("count").to_numpy().astype(float))
    given = spark.sparkContext.broadcast(model)

    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given.value
        for batch in batches:
            label = np.asarray(batch.column(1).to_pylist(), dtype=bool)
            for own in (False, True):
                z = [round(BINS * math.log1p(model.evidence(*x))) for _, _, words in blocks(batch.column(0).filter(pa.array(label == own))) for x in model.texts(words, own)]
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(z), pa.bool_()), pa.array(z, pa.int64())], names=["toxic", "z"])

    table = sample.select("text", "toxic").mapInArrow(A.tidied(proofs), "toxic boolean, z long").groupBy("z").agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c")).toArrow()
    model.at, model.slope = fit_curve(table.column("z").to_numpy() / BINS, table.column("t").to_numpy() * weights[True], table.column("c").to_numpy() * weights[False])
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted, passages) of every whole text; passages are code point offsets and scores in nats. One pass, no shuffle."""
    ship(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(model)
    shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given.value
        for batch in batches:
            score, passages = [], []
            for _, _, words in blocks(batch.column(1)):
                at, chars = 0, None
                for n, best, found in model.texts(words):
                    score.append(model.probability(model.evidence(n, best, found)))
                    least, own = model.least(n, EXPECTED), []
                    for a, b, s in found:
                        if s >= least:
                            chars = A.char_index(words.data) if chars is None else chars
                            begin = chars[words.text_starts[words.row[at]]]
                            own.append({"start": int(chars[words.starts[at + a]] - begin), "end": int(chars[words.ends[at + b - 1]] - begin), "score": s / UNIT})
                    passages.append(own)
                    at += n
            flag = [int(s >= 0.5) for s in score]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score, pa.float64()), pa.array(flag, pa.int32()), pa.array(passages, shape)], names=[id_col, "held_out", "score", "predicted", "passages"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col, held_out(id_col).alias("held_out"))
    return out.mapInArrow(A.tidied(run), f"`{id_col}` {kind}, held_out boolean, score double, predicted int, passages array<struct<start:long,end:long,score:double>>")
