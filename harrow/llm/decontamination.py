"""Benchmark decontamination: a broadcast set of normalised test windows, scanned over training token windows.

Both sides are lower-cased (A-Z) and cut into words of digits, letters and non-ASCII characters. Every ``size``
consecutive words of a test item are a window; an item of fewer words is one window. A training window whose
hash is in the set is verified on its bytes; the words inside verified windows are hit.

The broadcast has a checked size: the test items are dealt into slices of about ``slice_bytes`` of text (an item is not
split), and the documents pass the slices one after another, each adding its hits to those that the row carries along.
One slice is the usual case; more change nothing in the result and shuffle nothing. A worker holds some 50 bytes for
each word of a slice, no text of a window.

Defined results: null and empty texts have no words and no hits; an empty test set hits nothing; repeated documents
give repeated results, repeated items count once; an item without words has no window; items without an id count as
one item whose id is the empty text; a column of any name in ``docs`` stays as it is.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.llm import arrays as A
from harrow.session import ship

SIZE, SLICE_BYTES = 13, 8 << 20
VERIFIED = 100_000  # distinct window texts whose items a worker remembers
STATE = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.LongType())),
])


class Windows:
    """The windows of one slice of test items, by length: sorted hashes with the places of their words."""

    def __init__(self, items: list[tuple], size: int):
        self.names = ["" if item is None else str(item) for item, _ in items]
        data, offs = A.buffers(pa.array([t or "" for _, t in items], pa.large_string()))
        data = A.LOWER[data]
        self.raw = data.tobytes()
        s, e, row = A.words(data, offs, A.ALNUM)
        h = A.word_hashes(data, s, e)
        self.starts, self.ends, self.row = s, e, row
        counts = np.bincount(row, minlength=len(items))
        first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(items) else np.zeros(0, np.int64)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({min(size, int(c)) for c in np.unique(counts)} - {0}):
            at = first[counts == n]
            if n == size:
                at = np.arange(max(0, len(h) - size + 1))
                at = at[row[at] == row[at + size - 1]]
            win = A.window_hashes(h, n)[at]
            order = np.argsort(win, kind="stable")
            bits = np.zeros(1 << min(24, max(16, (8 * len(win)).bit_length())), dtype=bool)
            bits[(win & A.U(len(bits) - 1)).astype(np.int64)] = True
            self.by_length[n] = (win[order], at[order], bits)
        self.verified: dict[bytes, frozenset[str]] = {}

    def candidates(self, h: np.ndarray, row: np.ndarray, n: int) -> list[tuple[int, int]]:
        """(place in the words, place among the sorted hashes) of the windows whose hash is known."""
        known, _, bits = self.by_length[n]
        win = A.window_hashes(h, n)
        at = np.flatnonzero(bits[(win & A.U(len(bits) - 1)).astype(np.int64)])
        at = at[row[at] == row[at + n - 1]]
        place = np.minimum(np.searchsorted(known, win[at]), len(known) - 1)
        hit = known[place] == win[at]
        return list(zip(at[hit].tolist(), place[hit].tolist(), strict=True))

    def items(self, key: bytes, n: int, place: int) -> frozenset[str]:
        """The items that hold the window of this text; ``place``: the first of its hash."""
        if (got := self.verified.get(key)) is not None:
            return got
        known, at, _ = self.by_length[n]
        out, k = set(), place
        while k < len(known) and known[k] == known[place]:
            i = int(at[k])
            if b" ".join([self.raw[x:y] for x, y in zip(self.starts[i : i + n].tolist(), self.ends[i : i + n].tolist(), strict=True)]) == key:
                out.add(self.names[int(self.row[i])])
            k += 1
        if len(self.verified) >= VERIFIED:
            self.verified.clear()
        got = self.verified[key] = frozenset(out)
        return got


def runs(mark: np.ndarray) -> list[int]:
    """[start, end, start, end, ...] of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mark, [False]]).astype(np.int8)))
    return edge.tolist()


def scan(windows: Windows, column: pa.Array, before: list | None) -> tuple[list, list, list, list]:
    """For each text: words, hit word ranges, items and hit character ranges; ``before`` holds earlier slices' hits."""
    data, offs = A.buffers(column)
    counts, hits, items, spans = [], [], [], []
    for a, b in A.blocks(offs):
        part, own = A.LOWER[data[offs[a] : offs[b]]], offs[a : b + 1] - offs[a]
        s, e, row = A.words(part, own, A.ALNUM)
        first = np.searchsorted(row, np.arange(b - a + 1))
        mark = np.zeros(len(s), dtype=bool)
        found: dict[int, set[str]] = defaultdict(set)
        h = A.word_hashes(part, s, e)
        raw = None
        for n in windows.by_length:
            if len(h) < n:
                continue
            for i, place in windows.candidates(h, row, n):
                raw = raw or part.tobytes()
                key = b" ".join([raw[x:y] for x, y in zip(s[i : i + n].tolist(), e[i : i + n].tolist(), strict=True)])
                if items_of := windows.items(key, n, place):
                    mark[i : i + n] = True
                    found[int(row[i])] |= items_of
        for r in range(b - a):
            lo, hi = int(first[r]), int(first[r + 1])
            old = before[a + r] if before else None
            if old and (pairs := old[0]):
                for x, y in zip(pairs[::2], pairs[1::2], strict=True):
                    mark[lo + x : lo + y] = True
            counts.append(hi - lo)
            known = sorted(found.get(r, set()) | set((old[1] if old else None) or ()))
            items.append(known)
            if not known:
                hits.append([])
                spans.append([])
                continue
            ranges = runs(mark[lo:hi])
            hits.append(ranges)
            chars = A.char_index(part[own[r] : own[r + 1]])
            spans.append([int(chars[(s[lo + x] if k % 2 == 0 else e[lo + x - 1]) - own[r]]) for k, x in enumerate(ranges)])
    return counts, hits, items, spans


def test_slices(tests: DataFrame, item_col: str, text_col: str, slice_bytes: int) -> list[list[tuple]]:
    """The test items in slices of bounded size; only one slice is brought to the driver at a time."""
    tests = tests.select(item_col, text_col).where(F.col(text_col).isNotNull())
    total = tests.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(1, -(-int(total) // slice_bytes))
    at = F.pmod(F.xxhash64(item_col, text_col), F.lit(n))
    for k in range(n):
        yield [tuple(r) for r in tests.where(at == k).collect()]


def find_hits(
    docs: DataFrame, tests: DataFrame, text_col: str = "text", item_col: str = "item_id", test_text_col: str = "text",
    size: int = SIZE, slice_bytes: int = SLICE_BYTES, out_col: str = "contamination",
) -> DataFrame:
    """``docs`` with a column ``out_col``, a struct of the words, hit word ranges, items and hit character ranges."""
    if out_col in docs.columns:
        raise ValueError(f"there is a column {out_col} already")
    ship(docs.sparkSession)
    out = docs
    for items in test_slices(tests, item_col, test_text_col, slice_bytes):
        given = docs.sparkSession.sparkContext.broadcast(items)
        schema = T.StructType([*docs.schema.fields, T.StructField(out_col, STATE)])
        at, width, first = docs.columns.index(text_col), len(docs.columns), out is docs

        def run(batches: Iterator[pa.RecordBatch], given=given, first=first) -> Iterator[pa.RecordBatch]:
            windows = Windows(given.value, size)
            for batch in batches:
                before = None if first else [(x["hits"], x["items"]) for x in batch.column(width).to_pylist()]
                counts, hits, found, spans = scan(windows, batch.column(at), before)
                new = [pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))]
                state = pa.StructArray.from_arrays(new, names=STATE.names)
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], state], names=[f.name for f in schema.fields])

        out = out.mapInArrow(A.tidied(run), schema)
    return out


def free_name(df: DataFrame) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    name, taken = "contamination", {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def hit_words(state: str = "contamination") -> F.Column:
    hits = f"`{state}`.hits"
    return F.expr(f"aggregate(sequence(0, cast(size({hits}) / 2 as int) - 1), 0L, (acc, i) -> if(i < 0 or size({hits}) = 0, acc, acc + {hits}[2 * i + 1] - {hits}[2 * i]))")


def contaminated(state: str = "contamination", share: int = 20) -> F.Column:
    """At least one hit word in ``share``."""
    n = hit_words(state)
    return (n > 0) & (F.lit(share) * n >= F.col(f"`{state}`.n_words"))


def drop_contaminated(docs: DataFrame, tests: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    state = free_name(docs)
    return find_hits(docs, tests, out_col=state, **options).where(~contaminated(state)).drop(state)


def cut_spans(docs: DataFrame, tests: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All documents, the hit character ranges cut out of their texts."""
    state = free_name(docs)
    spans = f"`{state}`.spans"
    cut = F.expr(
        f"if(size({spans}) = 0, `{text_col}`, aggregate(sequence(0, cast(size({spans}) / 2 as int) - 1), "
        f"substring(`{text_col}`, 1, cast({spans}[0] as int)), (acc, i) -> concat(acc, substring(`{text_col}`, cast({spans}[2 * i + 1] + 1 as int), "
        f"cast(coalesce(try_element_at({spans}, 2 * i + 3), cast(length(`{text_col}`) as long)) - {spans}[2 * i + 1] as int)))))"
    )
    return find_hits(docs, tests, text_col=text_col, out_col=state, **options).withColumn(text_col, cut).drop(state)


def report(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    own = docs.select(id_col, text_col)
    state = free_name(own)
    x = lambda name: F.col(f"`{state}`.{name}")
    return find_hits(own, tests, text_col=text_col, out_col=state, **options).select(
        F.col(id_col), x("n_words").alias("n_words"), hit_words(state).alias("n_hit"), F.size(x("items")).cast("long").alias("n_items"),
        F.sha2(F.array_join(x("items"), ","), 256).alias("items_sha256"), contaminated(state).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The same rows as ``report`` in DuckDB.
SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT item_id, w, least(13, len(w)) AS n FROM (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
t AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win FROM b),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM t) WHERE len(w) >= n),
h AS (SELECT p.doc_id, p.i, p.n, t.item_id FROM p JOIN t ON t.n = p.n AND t.win = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
d AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id AS item FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated FROM w LEFT JOIN c USING (doc_id) LEFT JOIN d USING (doc_id)
"""
