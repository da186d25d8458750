"""Phrase collocation mining: dictionary-encoded n-grams, range-partitioned, radix-sorted and run-length counted.

Texts are lower-cased (A-Z), broken into pieces at ``[.,;:!?`` and line ends ``]`` and into words at spaces and tabs;
everything is counted for each language. Words of at least ``least`` occurrences get codes; pieces break at all others,
as no phrase with one of them can be frequent. Every two consecutive codes are a fixed-width binary key. A task takes
about ``CHUNK`` bytes of text at once, radix-sorts the keys (16 bits a pass, last word first), counts equal runs, and
sends what is left as compressed columns, one row for each range of keys; so a key that a third of all places hold is
one key of each chunk. A range is one task's: it sorts again, adds up the runs and keeps frequent keys. A second pass
does the same for 3 to 5 codes, with pieces broken between words that are no frequent pair as well (for the same reason;
the pairs are a bitmap of ``BITS``, whose false positives only add keys that are not frequent).

Ranges divide the unit interval as an arithmetic coder does: a key lies at its first word's cumulative share, plus that
word's share times the place of the next word in its language, and so on. So no sampling pass is needed, and a frequent
first word (or pair) is divided among many ranges. Their number follows the occurrences of frequent words.

Codes are places in the dictionary (sorted by language and word), found by hash and verified on bytes, when the
dictionary has at most ``DICTIONARY`` bytes; it is broadcast then. A larger one is never broadcast: the code is a 64-bit
hash of language and word, words are tested against a bitmap of fixed size (``BITS``; a false positive only adds keys
that are not frequent), ranges divide a hash, and codes become words by a join.

Cuts look up their two parts by joins on code arrays. A longer phrase that makes a candidate redundant has its exact
count, and so has one word more already; so candidates of one word more suffice. Products use decimals of 38 digits.

Defined results: null and empty texts have no words; a null language is ``und``; without an id column nothing depends on
ids, and repeated rows count each; ties are broken by the phrase in UTF-8 byte order; an empty table gives an empty
result; a very long text is a chunk of its own; other columns are not read. Different words of one 64-bit hash within a
chunk are taken for one (for 10**6 words a chance of 10**-8).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm import arrays as A
from harrow.session import ship, written

LEAST, TOP, LONGEST = 100, 2000, 5
CHUNK = 8 << 20
DICTIONARY = 64 << 20
BITS = 1 << 27
RANGE = 4 << 20  # keys that a range has at most when no chunk holds a key twice and words are independent
DECIMAL = "decimal(19,0)"
BREAK = A.table_of((0x0A, 0x0D)) | A.table_of(*((ord(x), ord(x)) for x in ".,;:!?"))
INSIDE = ~(BREAK | A.table_of((0x20, 0x20), (0x09, 0x09)))


class Chunk:
    """The words of texts of one language: which distinct word each is, and how many follow it in its piece."""

    def __init__(self, column: pa.Array):
        raw, offs = A.buffers(column)
        self.data = A.LOWER[raw]
        self.starts, self.ends, row = A.words(self.data, offs, INSIDE)
        self.which, self.hashes = pd.factorize(A.word_hashes(self.data, self.starts, self.ends))
        self.first = np.zeros(len(self.hashes), dtype=np.int64)
        self.first[self.which[::-1]] = np.arange(len(self.which))[::-1]
        passed = np.zeros(len(raw) + 1, dtype=np.int32)
        np.cumsum(BREAK[raw], out=passed[1:])
        self.new = np.ones(len(self.starts), dtype=bool)  # begins a piece
        self.new[1:] = (row[1:] != row[:-1]) | (passed[self.starts[1:]] != passed[self.ends[:-1]])

    def distinct(self) -> pa.Array:
        return strings(self.data, self.starts[self.first], self.ends[self.first])

    def grams(self, codes: np.ndarray, frequent: np.ndarray, pairs: Bitmap | None) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """Columns of the distinct n-grams of frequent words within pieces, sorted, and their counts: pairs, or given those that may be frequent, longer ones of them."""
        word, use = codes[self.which], frequent[self.which]
        edge = self.new | ~use
        edge[1:] |= ~use[:-1]
        if pairs is not None and len(edge) > 1:
            at = np.flatnonzero(~edge[1:])
            edge[1 + at] = ~pairs.has(mixed([word[at], word[at + 1]]))
        begins = np.append(np.flatnonzero(edge), len(edge))
        left = np.where(use, np.repeat(begins[1:], np.diff(begins)) - np.arange(len(edge)), 0) if len(edge) else np.zeros(0, np.int64)
        for k in (2,) if pairs is None else range(3, LONGEST + 1):
            at = np.flatnonzero(left >= k)
            yield counted([word[at + j] for j in range(k)], np.ones(len(at), dtype=np.int64))


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of bytes as an Arrow string column."""
    offs = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offs[1:])
    own = data[np.arange(offs[-1]) + np.repeat(starts - offs[:-1], ends - starts)]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offs.tobytes()), pa.py_buffer(own.tobytes()))


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of keys by their columns, 16 bits a pass from the last."""
    order = np.arange(len(columns[0]))
    for c in reversed(columns):
        for shift in range(0, 8 * c.itemsize, 16):
            digit = (c >> c.dtype.type(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def counted(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts: radix sort and run lengths."""
    order = radix_order(columns)
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.add.reduceat(n[order], at) if len(at) else n[:0]


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of each key."""
    out = A.splitmix(columns[0])
    for c in columns[1:]:
        out = A.splitmix(out + c.astype(A.U))
    return out


class Bitmap:
    """A set of hashes within a fixed number of bits; it may take a hash for one of the set that is not."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes % A.U(8 * len(self.bits))
        return (self.bits[place >> A.U(3)] >> (place & A.U(7)).astype(np.uint8)) & 1 == 1


def bitmap(df: DataFrame, bits: int, hashes) -> Bitmap:
    """The bitmap of ``hashes(batch)`` of all rows; at most a row for each of its bytes comes to the driver."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = hashes(batch) % A.U(bits)
            byte, at = np.unique(place >> A.U(3), return_inverse=True)
            value = np.zeros(len(byte), dtype=np.uint8)
            np.bitwise_or.at(value, at, (1 << (place & A.U(7)).astype(np.uint8)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array(byte.astype(np.int64)), pa.array(value.astype(np.int32))], names=["byte", "value"])

    found = df.mapInArrow(marked, "byte long, value int").groupBy("byte").agg(F.bit_or("value").alias("value")).toArrow()
    table = np.zeros(bits >> 3, dtype=np.uint8)
    table[found.column("byte").to_numpy()] = found.column("value").to_numpy().astype(np.uint8)
    return Bitmap(table)


def planes(columns: list[np.ndarray]) -> bytes:
    """Whole numbers byte by byte: of sorted keys most planes are runs."""
    return b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)


def from_planes(data: bytes, k: int, size: int, kind) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(k, wide, size).transpose(0, 2, 1)).view(kind).reshape(k, size)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Chunk]]:
    """Chunks of one language each from rows (lang, text), some batches at once."""

    def parted(held: list[pa.RecordBatch]) -> Iterator[tuple[str, Chunk]]:
        table = pa.Table.from_batches(held)
        for lang in table.column(0).unique().to_pylist():
            own = table.filter(pa.compute.equal(table.column(0), lang)).column(1)
            yield lang, Chunk(own.cast(pa.large_string()).combine_chunks())

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK:
            yield from parted(held)
            held, size = [], 0
    if held:
        yield from parted(held)


def parts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.where(F.octet_length(text_col) > 0).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))


def count_words(docs: DataFrame, least: int, text_col: str, lang_col: str) -> DataFrame:
    """(lang, word, n) of frequent words, and of all words of a language together with a null word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, chunk in chunks(batches):
            n = np.bincount(chunk.which, minlength=len(chunk.hashes))
            words = pa.concat_arrays([chunk.distinct().cast(pa.string()), pa.nulls(1, pa.string())])
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(words), np.int32))), words, pa.array(np.append(n, n.sum()).astype(np.int64))], names=["lang", "word", "n"])

    found = parts(docs, text_col, lang_col).mapInArrow(A.tidied(run), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return written(found.where((F.col("n") >= least) | F.col("word").isNull()), "words")


def hashed(words: pa.Array) -> np.ndarray:
    data, offs = A.buffers(words)
    return A.word_hashes(data, offs[:-1], offs[1:])


def of_language(lang: str) -> np.uint64:
    return hashed(pa.array([lang]))[0]


class Dictionary:
    """Codes of frequent words as places in the sorted dictionary, in memory; and the place of a key in the unit interval."""

    def __init__(self, words: pa.Table):
        words = words.sort_by([("lang", "ascending"), ("word", "ascending")])
        self.words = words.column("word").cast(pa.large_string()).combine_chunks()
        self.data, self.offs = A.buffers(self.words)
        n = words.column("n").to_numpy().astype(float)
        lang = pd.Series(words.column("lang").to_pandas())
        self.lang = lang.to_numpy()
        self.kind = np.uint16 if len(n) < 1 << 16 else np.uint32
        hashes, self.by = A.word_hashes(self.data, self.offs[:-1], self.offs[1:]), {}
        for x, own in lang.groupby(lang).indices.items():
            own = own[np.argsort(hashes[own], kind="stable")]
            self.by[x] = (hashes[own], own)
        self.share = n / n.sum() if len(n) else n
        self.before = np.cumsum(self.share) - self.share
        total = pd.Series(n).groupby(lang).transform("sum").to_numpy()
        self.own_share = n / total
        self.own_before = (pd.Series(n).groupby(lang).cumsum().to_numpy() - n) / total

    def codes(self, lang: str, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(code, frequent) of the distinct words of a chunk."""
        code, known = np.zeros(len(chunk.hashes), dtype=self.kind), np.zeros(len(chunk.hashes), dtype=bool)
        if lang not in self.by or not len(chunk.hashes):
            return code, known
        hashes, place = self.by[lang]
        at = np.minimum(np.searchsorted(hashes, chunk.hashes), len(hashes) - 1)
        hit = np.flatnonzero(hashes[at] == chunk.hashes)
        to = place[at[hit]]
        a, size = chunk.starts[chunk.first[hit]], self.offs[to + 1] - self.offs[to]
        same = chunk.ends[chunk.first[hit]] - a == size
        hit, to, a, size = hit[same], to[same], a[same], size[same]
        if len(hit):
            offs = np.cumsum(size) - size
            step = np.arange(size.sum()) - np.repeat(offs, size)
            equal = np.logical_and.reduceat(chunk.data[np.repeat(a, size) + step] == self.data[np.repeat(self.offs[to], size) + step], offs)
            code[hit[equal]], known[hit[equal]] = to[equal], True
        return code, known

    def ranges(self, columns: list[np.ndarray], n: int) -> np.ndarray:
        at = np.zeros(len(columns[0]))
        for c in reversed(columns[1:]):
            at = self.own_before[c] + self.own_share[c] * at
        at = self.before[columns[0]] + self.share[columns[0]] * at
        return np.clip((at * n).astype(np.int64), 0, n - 1)


class Hashes:
    """Codes of words as hashes, and a bitmap of fixed size with all frequent ones."""

    kind = np.uint64

    def __init__(self, words: Bitmap):
        self.words = words

    def codes(self, lang: str, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        code = word_codes(np.asarray(chunk.hashes, dtype=A.U), lang)
        return code, self.words.has(code)

    def ranges(self, columns: list[np.ndarray], n: int) -> np.ndarray:
        return ((mixed(columns) >> A.U(32)) * A.U(n) >> A.U(32)).astype(np.int64)


def word_codes(hashes: np.ndarray, lang: str) -> np.ndarray:
    return A.splitmix(hashes ^ A.splitmix(np.array([of_language(lang)], dtype=A.U))[0])


def coder(words: DataFrame, dictionary_bytes: int, bits: int) -> tuple[Dictionary | Hashes, DataFrame]:
    """What encodes words in tasks, and (code, lang, word, n)."""
    spark = words.sparkSession
    size = words.agg(F.sum(F.octet_length("word") + 32)).first()[0] or 0
    if size <= dictionary_bytes:
        own = Dictionary(words.toArrow())
        rows = pa.table({"code": pa.array(np.arange(len(own.lang), dtype=np.int64)), "lang": pa.array(own.lang, pa.string()), "word": own.words.cast(pa.string())})
        return own, words.join(spark.createDataFrame(rows), ["lang", "word"]).select("code", "lang", "word", "n") if len(own.lang) else words.select(F.lit(0).cast("long").alias("code"), "lang", "word", "n")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = pd.Series(batch.column(0).to_pandas())
            hashes, code = hashed(batch.column(1)), np.zeros(len(batch), dtype=A.U)
            for x, own in lang.groupby(lang).indices.items():
                code[own] = word_codes(hashes[own], x)
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), *batch.columns], names=["code", "lang", "word", "n"])

    codes = words.mapInArrow(coded, "code long, lang string, word string, n long")

    return Hashes(bitmap(codes, bits, lambda batch: batch.column(0).to_numpy().view(A.U))), codes


def count_grams(docs: DataFrame, own: Dictionary | Hashes, pairs: Bitmap | None, ranges: int, least: int, text_col: str, lang_col: str) -> DataFrame:
    """(codes, a): pairs of frequent words with at least ``least`` occurrences; given those, n-grams of 3 to LONGEST words."""
    given = docs.sparkSession.sparkContext.broadcast((own, pairs))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (own, pairs), pack = given.value, zstandard.ZstdCompressor(level=1).compress
        for lang, chunk in chunks(batches):
            codes, frequent = own.codes(lang, chunk)
            for columns, n in chunk.grams(codes, frequent, pairs):
                if not len(n):
                    continue
                to = own.ranges(columns, ranges)
                order = np.argsort(to, kind="stable")
                columns, n, to = [c[order] for c in columns], n[order].astype(np.uint32), to[order]
                cut = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to)).tolist()
                rows = [(int(to[a]), b - a, pack(planes([c[a:b] for c in columns])), pack(planes([n[a:b]]))) for a, b in zip(cut, cut[1:], strict=False)]
                to_, size, keys, counts = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(to_, pa.int32()), pa.array([len(columns)] * len(rows), pa.int32()), pa.array(size, pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["range", "k", "size", "keys", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, unpack = given.value[0].kind, zstandard.ZstdDecompressor().decompress
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for r, k, size, keys, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault((r, k), []).append((size, keys, n))
        for r, k in sorted(held):
            every = [(from_planes(unpack(keys), k, size, kind), from_planes(unpack(n), 1, size, np.uint32)[0]) for size, keys, n in held.pop((r, k))]
            columns, n = counted([np.concatenate([x[0][j] for x in every]) for j in range(k)], np.concatenate([x[1] for x in every]).astype(np.int64))
            keep = np.flatnonzero(n >= least)
            codes = np.stack([c[keep] for c in columns], axis=1).astype(A.U).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(keep) + 1, k, dtype=np.int32)), pa.array(codes)), pa.array(n[keep])], names=["codes", "a"])

    sent = parts(docs, text_col, lang_col).mapInArrow(A.tidied(encode), "range int, k int, size long, keys binary, counts binary")
    return written(sent.repartitionById(ranges, "range").mapInArrow(A.tidied(count), "codes array<long>, a long"), "phrases")


def pair_hashes(kind):
    return lambda batch: mixed(list(batch.column(0).flatten().to_numpy().view(A.U).astype(kind).reshape(-1, 2).T))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang", dictionary_bytes: int = DICTIONARY, bits: int = BITS, per_range: int = RANGE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first ``top`` phrases of each language."""
    ship(docs.sparkSession)
    every = count_words(docs, least, text_col, lang_col)
    words, totals = every.where("word is not null and n >= %d" % least), every.where("word is null").select("lang", F.col("n").alias("n"))
    own, codes = coder(words, dictionary_bytes, bits)
    occurrences = words.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, math.ceil(occurrences / per_range))
    two = count_grams(docs, own, None, ranges, least, text_col, lang_col)
    more = count_grams(docs, own, bitmap(two, bits, pair_hashes(own.kind)), 3 * ranges, least, text_col, lang_col)
    phrases = two.unionByName(more)

    inner = phrases.where("size(codes) > 2").select(F.explode(F.array(F.expr("slice(codes, 1, size(codes) - 1)"), F.expr("slice(codes, 2, size(codes) - 1)"))).alias("codes"), "a")
    kept = phrases.join(inner, ["codes", "a"], "left_anti")
    f = phrases.unionByName(codes.select(F.array("code").alias("codes"), F.col("n").alias("a")))
    cuts = kept.select("codes", "a", F.explode(F.expr("sequence(1, size(codes) - 1)")).alias("cut"))
    cuts = cuts.withColumns({"head": F.expr("slice(codes, 1, cut)"), "rest": F.expr("slice(codes, cut + 1, size(codes) - cut)")})
    cuts = cuts.join(f.select(F.col("codes").alias("head"), F.col("a").alias("l")), "head").join(f.select(F.col("codes").alias("rest"), F.col("a").alias("r")), "rest")
    cuts = cuts.withColumn("code", F.col("codes")[0]).join(codes.join(totals.withColumnRenamed("n", "all"), "lang").select("code", "lang", "all"), "code")
    cuts = cuts.withColumn("score", F.expr(f"cast(a * 1000 as {DECIMAL}) * cast(`all` as {DECIMAL}) div (cast(l as {DECIMAL}) * cast(r as {DECIMAL}))"))
    best = cuts.groupBy("codes", "a", "lang", F.col("all").alias("n")).agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    spelt = kept.select("codes", F.posexplode("codes").alias("place", "code")).join(codes.select("code", "word"), "code").groupBy("codes").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"))
    found = best.join(spelt, "codes").select("lang", F.array_join("w.word", " ").alias("phrase"), "a", "m.l", "m.r", "n", "m.score")
    found = written(found, "collocations")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    groups = max(1, math.isqrt(found.count() // top))  # the first of each group first, so that a language's last sort is a small part of its phrases
    some = found.withColumn("__group", F.pmod(F.xxhash64("phrase"), F.lit(groups)))
    some = some.withColumn("__rank", F.row_number().over(Window.partitionBy("lang", "__group").orderBy(*order))).where(F.col("__rank") <= top).drop("__group", "__rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: For DuckDB.
SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM
  (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
f AS (SELECT lang, w[i:i + k - 1] AS p, k, count(*) AS a FROM places, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT * FROM f WHERE k >= 2),
inner_ AS (SELECT DISTINCT c.lang, c.p[s.i:s.i + s.k - 1] AS p, c.a FROM candidates c, (SELECT i, k FROM (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(range(2, 5)) AS k)) s WHERE s.k < c.k AND s.i + s.k - 1 <= c.k),
kept AS (SELECT c.* FROM candidates c ANTI JOIN inner_ x ON c.lang = x.lang AND c.p = x.p AND c.a <= x.a),
cuts AS (SELECT c.lang, c.p, c.a, u.j, l.a AS l, r.a AS r, t.n, (CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(l.a AS HUGEINT) * r.a) AS score
  FROM kept c JOIN (SELECT unnest(range(1, 5)) AS j) u ON u.j < c.k JOIN f l ON l.lang = c.lang AND l.p = c.p[1:u.j] JOIN f r ON r.lang = c.lang AND r.p = c.p[u.j + 1:c.k] JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
ranked AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""
