"""N-gram Jaccard join with a token-group matrix.

A document is the set of its distinct word shingles; two documents link when the Jaccard similarity of their sets is
at least ``percent`` / 100. The result is exact: every link between different texts counts towards its component.

1. Equal sets collapse into classes (a 64-bit digest; with 10^9 classes two differ and collide with a chance of 3 %).
2. Similar classes are put into groups: classes that share a min-hash are checked against one leader of theirs (the
   one made most of frequent shingles, as the original of many copies is), and what links forms a group. This
   needs no completeness; it keeps large families of near copies from meeting as pairs.
3. Token-group matrix: shingles are ordered, frequent ones last, and only the first 15 % of a set (which two similar
   sets must share a member of) are entered, once for each group (blocks of at most ``BLOCK_SIZE`` classes). Most
   shingles are one group's alone: a bitmap of fixed size tells which hash buckets hold several groups, and the
   others are not entered. A class is a query to the groups that share such a shingle and that position and sizes leave
   within reach.
4. A group's token union bounds the overlap that any member can have with the query; only groups that qualify are
   opened, and members compared. One link to a group is enough, as its members are connected already.
5. Components of all links give each class its smallest document.
6. Numbers of links: an opened block counts for each query, and each member, the documents of the classes that link
   with it. Within a group every class is written as its difference from one reference member (``|A & B|`` follows from
   the sizes and from what two differences share), packed in panels of at most ``PANEL`` classes; a panel meets the
   other panels of its group one after another and returns one number a class, so pairs are compared but never rows.

The order of shingles comes from counts over all documents (of those that a task meets twice among CHUNK shingles):
the MOST_FREQUENT of them with LEAST_LIMIT or more occurrences, 8 bytes each, are broadcast and come last. Any
order gives the same result. No task holds more than a block of classes and a block of queries, or two panels. The
bitmap's shards grow in number with the shingles entered (``SHARD_ENTRIES`` each), its size does not: with many more
entries than bits it lets more shingles through, which costs shuffling and changes nothing in the result.

Defined results: null, empty and wordless texts have no shingles and link with nothing; texts of fewer words than a
shingle are one shingle; repeated rows give repeated results, and each counts as a link of the others; rows without an
id have the component of an equal text that has one, no number of links, and are no one's link; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm import arrays as A
from harrow.llm.components import components
from harrow.session import durable, ship, written

SHINGLE, PERCENT = 4, 85
MOST_FREQUENT, LEAST_LIMIT = 1 << 22, 8
KEYS, BUCKETS, AGREE = 8, 4, 5  # min-hashes kept, those that make buckets, those that must agree with the leader's
BLOCK_SIZE = 256
BROADCAST_ROWS = 1_000_000  # rows of a few numbers that may be broadcast; beyond that a join shuffles
PANEL = 1024
BITS = 28  # the bitmap of crowded buckets: 2**28 bits, 32 MB
SHARD_ENTRIES = 1 << 22  # prefix shingles that a shard of the bitmap is made from, on average
DENSE = 1 << 13  # pairs that a token may bring one by one; beyond that it is a column of a matrix
CHUNK = 1 << 20  # shingles counted at once by a task


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, the sorted distinct shingles of each row) for blocks of rows."""
    data, offs = A.buffers(column)
    for a, b in A.blocks(offs):
        part, own = A.LOWER[data[offs[a] : offs[b]]], offs[a : b + 1] - offs[a]
        s, e, row = A.words(part, own, A.SPACED)
        h = A.word_hashes(part, s, e)
        full = A.window_hashes(h, size)
        first = np.searchsorted(row, np.arange(b - a + 1))
        out = []
        for r in range(b - a):
            lo, hi = int(first[r]), int(first[r + 1])
            if hi - lo >= size:
                out.append(np.unique(full[lo : hi - size + 1]))
            elif hi > lo:
                out.append(A.window_hashes(h[lo:hi], hi - lo))
            else:
                out.append(np.zeros(0, dtype=A.U))
        yield a, out


def digest(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        both = A.splitmix(tokens ^ A.U(0xA5A5A5A55A5A5A5A)).sum(dtype=A.U) * A.U(A.BASE) + A.U(len(tokens))
    return int(A.splitmix(np.array([both], dtype=A.U)).astype(np.int64)[0])


SEEDS = A.splitmix(np.arange(1, KEYS + 1, dtype=A.U) * A.U(0xD1342543DE82EF95))


def min_hashes(tokens: np.ndarray) -> list[int]:
    return [int(A.splitmix(tokens ^ s).min().astype(np.int64)) for s in SEEDS]


def prefix_length(n: int, percent: int) -> int:
    """Two sets that similar share one of the first so many tokens of either, in any order common to both."""
    return n - (percent * n + 99) // 100 + 1


def frequent_shingles(docs: DataFrame, id_col: str, text_col: str, size: int) -> np.ndarray:
    """Shingles that occur in many documents, sorted; at most MOST_FREQUENT."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= 2
            return pa.RecordBatch.from_arrays([pa.array(tokens[often].astype(np.int64)), pa.array(n[often].astype(np.int64))], names=["token", "n"])

        held, total = [], 0
        for batch in batches:
            for _, sets in shingle_sets(batch.column(0), size):
                held += sets
                total += sum(map(len, sets))
                if total >= CHUNK:
                    yield flush(held)
                    held, total = [], 0
        if total:
            yield flush(held)

    counted = docs.select(text_col).mapInArrow(A.tidied(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counted = durable(counted.where(F.col("n") >= LEAST_LIMIT))
    held, limit = counted.count(), LEAST_LIMIT
    if held > MOST_FREQUENT:
        limit = 1 + counted.agg(F.percentile_approx("n", 1 - MOST_FREQUENT / held * 0.99, 10000)).first()[0]
    found = counted.where(F.col("n") >= limit).select("token").toArrow()
    return np.sort(found.column(0).to_numpy().astype(A.U))


def sketches(docs: DataFrame, frequent: np.ndarray, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """(id, n, cid, heavy, keys, prefix); the last three are null where the same task saw an equal set with an id before, and without an id."""
    given = docs.sparkSession.sparkContext.broadcast(frequent)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = given.value, set()
        for batch in batches:
            for a, sets in shingle_sets(batch.column(1), size):
                n, cid, heavy, keys, prefix = [], [], [], [], []
                for r, tokens in enumerate(sets, a):
                    n.append(len(tokens))
                    c = digest(tokens) if len(tokens) else None
                    cid.append(c)
                    if c is None or c in seen or not batch.column(0)[r].is_valid:
                        heavy.append(None), keys.append(None), prefix.append(None)
                        continue
                    seen.add(c)
                    if len(often):
                        hot = often[np.minimum(np.searchsorted(often, tokens), len(often) - 1)] == tokens
                    else:
                        hot = np.zeros(len(tokens), dtype=bool)
                    heavy.append(float(hot.mean()))
                    keys.append(min_hashes(tokens))
                    ordered = np.concatenate([tokens[~hot], tokens[hot]])
                    prefix.append(ordered[: prefix_length(len(tokens), percent)].astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, len(sets)), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(heavy, pa.float64()),
                        pa.array(keys, pa.list_(pa.int64())), pa.array(prefix, pa.list_(pa.int64())),
                    ],
                    names=["id", "n", "cid", "heavy", "keys", "prefix"],
                )

    return docs.select(id_col, text_col).mapInArrow(A.tidied(run), f"id {id_type}, n long, cid long, heavy double, keys array<long>, prefix array<long>")


def packed(texts: DataFrame) -> DataFrame:
    """(id, body): the texts compressed, for the one shuffle that they take part in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            body = pa.array([press((t or "").encode()) for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), body], names=["id", "body"])

    return texts.select("id", "text").mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, body binary")


def unpacked(body: bytes) -> str:
    return zstandard.decompress(body).decode()


def with_bodies(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """``wanted`` (with id) joined to the packed texts of its ids, in place of the ids; ``wanted`` must be durable."""
    few = wanted.count() <= BROADCAST_ROWS
    small = F.broadcast if few else lambda df: df
    rows = packed(texts.join(small(wanted.select("id").distinct()), "id", "left_semi"))
    return rows.join(small(wanted), "id").drop("id")


def open_groups(queries: DataFrame, members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v, w): links between queries (g, b, cid, id, copies) and members (same) of the blocks (g, b) they name.

    A block's members and at most BLOCK_SIZE of its queries are one group of rows; the members' token union bounds each
    query first. Of the members of a block that link with a query ``u`` the first is ``v``; ``w`` counts the documents
    of all of them. A member has a row as ``u`` too, without ``v``, with the documents of the queries that link with it.
    """
    loads = queries.groupBy("g", "b").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SIZE).alias("parts"))
    asked = queries.join(loads, ["g", "b"]).select("g", "b", F.pmod(F.xxhash64("cid"), "parts").alias("part"), F.lit(1).alias("kind"), "cid", "id", "copies")
    held = members.join(loads, ["g", "b"]).select("g", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "cid", "id", "copies")
    rows = with_bodies(durable(asked.unionByName(held)), texts).select("g", "b", "part", "kind", "cid", "copies", "body")
    rows = rows.repartition("g", "b", "part").sortWithinPartitions("g", "b", "part", "kind")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None
        owners: dict[int, int] = {}
        copies: list[int] = []
        sets: list[np.ndarray] = []
        done: set[int] = set()
        union = where = starts = sizes = weight = gained = None
        out: tuple[list, list, list] = ([], [], [])

        def put(u: int, v: int | None, w: int) -> None:
            for column, x in zip(out, (u, v, w), strict=True):
                column.append(x)

        def end() -> None:
            if gained is not None:
                for c, w in zip(owners, gained.tolist(), strict=True):
                    if w:
                        put(c, None, w)

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["u", "v", "w"])
            for column in out:
                column.clear()
            return made

        for batch in batches:
            key = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            kinds, cids, n_copies = (batch.column(k).to_pylist() for k in (3, 4, 5))
            for a, found in shingle_sets(pa.array(map(unpacked, batch.column(6).to_pylist()), pa.large_string()), size):
                for r, tokens in enumerate(found, a):
                    if digest(tokens) != cids[r]:
                        continue  # another text under the same id
                    if key[r] != group:
                        end()
                        group, owners, copies, sets, done, union, gained = key[r], {}, [], [], set(), None, None
                    if kinds[r] == 0:
                        if cids[r] not in owners:
                            owners[cids[r]] = len(sets)
                            copies.append(n_copies[r])
                            sets.append(tokens)
                        continue
                    if not sets or cids[r] in done:
                        continue
                    done.add(cids[r])
                    if union is None:
                        every, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                        order = np.argsort(every, kind="stable")
                        every, where = every[order], who[order]
                        union, starts = np.unique(every, return_index=True)
                        starts = np.append(starts, len(every))
                        sizes = np.array([len(x) for x in sets])
                        weight, gained = np.array(copies, dtype=np.int64), np.zeros(len(sets), dtype=np.int64)
                        names = list(owners)
                    at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
                    at = at[union[at] == tokens]
                    if 100 * len(at) < percent * len(tokens):
                        continue  # the union's overlap bounds every member's
                    if len(sets) == 1:
                        shared = np.array([len(at)])
                    else:
                        count = starts[at + 1] - starts[at]
                        place = np.repeat(starts[at] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
                        shared = np.bincount(where[place], minlength=len(sets))
                    hit = 100 * shared >= percent * (len(tokens) + sizes - shared)
                    if cids[r] in owners:
                        hit[owners[cids[r]]] = False
                    if hit.any():
                        put(cids[r], names[int(hit.argmax())], int(weight[hit].sum()))
                        gained[hit] += n_copies[r]
            yield flush()
        end()
        yield flush()

    return rows.mapInArrow(A.tidied(compare), "u long, v long, w long")


def leader_links(classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """Links of classes to a leader that shares a min-hash with them."""
    own = classes.select("cid", "id", "n", "heavy", "keys")
    entries = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))).alias("r")).withColumn("key", F.get("keys", F.col("r")))
    leaders = entries.groupBy("r", "key").agg(F.max(F.struct("heavy", "cid", "id", "n", "keys")).alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    agree = F.expr(f"aggregate(sequence(0, {KEYS - 1}), 0, (acc, i) -> acc + if(keys[i] = lead.keys[i], 1, 0))")
    near = f"cid <> lead.cid and 100 * least(n, lead.n) >= {percent} * greatest(n, lead.n)"
    pairs = entries.join(leaders.select("r", "key", "lead"), ["r", "key"]).where(near).where(agree >= AGREE)
    pairs = durable(pairs.select("cid", "id", F.col("lead.cid").alias("g"), F.col("lead.id").alias("lid")).distinct())
    block, one = F.lit(0).cast("long").alias("b"), F.lit(1).cast("long").alias("copies")
    queries = pairs.select("g", block, "cid", "id", one)
    members = pairs.select("g", block, F.col("g").alias("cid"), F.col("lid").alias("id"), one).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return open_groups(queries, members, texts, size, percent).where("v is not null").select("u", "v")


def shard_bits(entries: int) -> int:
    """log2 of the shards of the bitmap, for so many prefix shingles."""
    return min(20, max(8, (entries // SHARD_ENTRIES).bit_length()))


def crowded_buckets(entries: DataFrame, split: int) -> np.ndarray:
    """A bitmap of the hash buckets (2**BITS) whose prefix shingles belong to more than one group.

    ``entries``: prefix, g. A task's entries travel as sorted arrays of (bucket, 32 bits of the group), one row for
    each of the 2**split shards of buckets; two groups of the same 32 bits are told apart by nothing here, so those
    bits come from a hash of the group that differs for each bucket, and a pair is missed only where its every shared
    shingle is.
    """
    shards, width = 1 << split, BITS - split  # a shard has 2**width buckets

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column(0)
            lengths = np.diff(np.asarray(prefix.offsets))
            tokens = prefix.flatten().to_numpy(zero_copy_only=False).astype(A.U)
            if not len(tokens):
                continue
            owner = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(A.U), lengths)
            bucket = tokens & A.U((1 << BITS) - 1)
            value = np.sort((bucket << A.U(32)) | (A.splitmix(owner ^ A.splitmix(bucket)) >> A.U(32)))
            shard = (value >> A.U(32 + width)).astype(np.int64)
            which, cut = np.unique(shard, return_index=True)
            ends = [*cut[1:].tolist(), len(value)]
            press = zstandard.ZstdCompressor(level=1).compress
            low, own = [], []
            for k, x, y in zip(which.tolist(), cut.tolist(), ends, strict=True):
                low.append(press(np.diff((value[x:y] >> A.U(32)).astype(np.int64), prepend=k << width).astype("<u4").tobytes()))
                own.append((value[x:y] & A.U(0xFFFFFFFF)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(low, pa.binary()), pa.array(own, pa.binary())], names=["shard", "low", "own"])

    def merge(rows: pa.Table) -> pa.Table:
        values = []
        for low, own in zip(rows.column("low").to_pylist(), rows.column("own").to_pylist(), strict=True):
            place = np.cumsum(np.frombuffer(zstandard.decompress(low), "<u4"), dtype=np.uint64)
            values.append((place << A.U(32)) | np.frombuffer(own, "<u4"))
        value = np.unique(np.concatenate(values))
        bucket = value >> A.U(32)
        bits = np.zeros(1 << width, dtype=bool)
        bits[bucket[1:][bucket[1:] == bucket[:-1]].astype(np.int64)] = True  # counted from the first of the shard
        return pa.table({"shard": rows.column("shard").slice(0, 1).combine_chunks(), "bits": pa.array([zstandard.compress(np.packbits(bits).tobytes(), 1)], pa.binary())})

    dealt = entries.select("prefix", "g").mapInArrow(A.tidied(deal), "shard int, low binary, own binary")
    found = dealt.groupBy("shard").applyInArrow(merge, "shard int, bits binary").toArrow()
    bits = np.zeros((shards, 1 << (width - 3)), dtype=np.uint8)
    for k, raw in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
        bits[k] = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return bits.reshape(-1)


def matrix_entries(entries: DataFrame, bits: np.ndarray, percent: int) -> DataFrame:
    """(token, cid, n, g, size, reach) of the prefix shingles in crowded buckets.

    ``reach``: what stands at a shingle's place or later must hold the whole overlap, so a set of ``m`` shingles can be
    similar by this first common shingle only where reach >= percent * m, on either side.
    """
    given = entries.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column(0)
            offs = np.asarray(prefix.offsets).astype(np.int64)
            lengths = np.diff(offs)
            tokens = prefix.flatten().to_numpy(zero_copy_only=False)
            bucket = tokens & ((1 << BITS) - 1)
            on = np.flatnonzero((given.value[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1)
            row = np.repeat(np.arange(len(lengths)), lengths)[on]
            place = on - (offs[:-1] - offs[0])[row]
            own = [batch.column(k).take(pa.array(row)) for k in range(1, 5)]
            reach = 100 * own[1].to_numpy(zero_copy_only=False) - (100 + percent) * place
            yield pa.RecordBatch.from_arrays([pa.array(tokens[on]), *own, pa.array(reach.astype(np.int64))], names=["token", "cid", "n", "g", "size", "reach"])

    return entries.select("prefix", "cid", "n", "g", "size").mapInArrow(A.tidied(run), "token long, cid long, n long, g long, size long, reach long")


def block_of() -> F.Column:
    """A class's block of its group, from cid and size."""
    return F.pmod(F.xxhash64("cid"), F.ceil(F.col("size") / BLOCK_SIZE))


def matrix_links(entries: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, split: int) -> DataFrame:
    """Links (u, v, w) between classes of different groups, by the token-group matrix.

    ``entries``: cid, n, prefix, g, size (a class may have several rows); ``classes``: cid, id, copies, g, size, one row each.
    What is entered is shuffled once, by token: the matrix and its queries are made from the same rows.
    """
    shared = matrix_entries(entries, crowded_buckets(entries, split), percent).repartition("token")
    matrix = shared.groupBy("token", "g", "size", block_of().alias("b")).agg(F.min("n").alias("least"), F.max("reach").alias("most"))
    q, m = shared.select("token", "cid", "n", "g", "size", "reach").alias("q"), matrix.alias("m")
    within = f"q.g <> m.g and (m.size > q.size or (m.size = q.size and m.g > q.g)) and q.reach >= {percent} * m.least and m.most >= {percent} * q.n"
    queries = q.join(m, F.col("q.token") == F.col("m.token")).where(within).select(F.col("m.g").alias("g"), F.col("m.b").alias("b"), F.col("q.cid").alias("cid"))
    queries = durable(queries.distinct())
    asked = queries.join(classes.select("cid", "id", "copies"), "cid").select("g", "b", "cid", "id", "copies")
    members = classes.select("g", block_of().alias("b"), "cid", "id", "copies").join(queries.select("g", "b").distinct(), ["g", "b"], "left_semi")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return open_groups(asked, members, texts, size, percent)


class Panel:
    """Classes of one group: cid, copies, size, shingles of the reference that each lacks, and differences by token."""

    def __init__(self, body: bytes):
        rows = pa.ipc.open_stream(body).read_all().combine_chunks()
        self.cid, self.copies, self.n, self.lacks = (rows.column(k).to_numpy() for k in range(4))
        delta = rows.column(4).combine_chunks()
        token = delta.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(self.cid)), np.diff(np.asarray(delta.offsets)))
        order = np.argsort(token, kind="stable")
        self.row = row[order]
        self.token, self.start = np.unique(token[order], return_index=True)
        self.count = np.diff(np.append(self.start, len(token)))

    @staticmethod
    def packed(cid: list[int], copies: list[int], n: list[int], lacks: list[int], delta: list[np.ndarray]) -> bytes:
        columns = [pa.array(x, pa.int64()) for x in (cid, copies, n, lacks)]
        columns.append(pa.array([x.astype(np.int64) for x in delta], pa.list_(pa.int64())))
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays(columns, names=["cid", "copies", "n", "lacks", "delta"])
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], ..., starts[0] + counts[0] - 1, starts[1], ..."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(int(counts.sum()))


def shared_counts(a: Panel, b: Panel) -> np.ndarray:
    """For every class of ``a`` and of ``b``, how many tokens their differences share."""
    na, nb = len(a.cid), len(b.cid)
    out = np.zeros(na * nb, dtype=np.int64)
    _, i, j = np.intersect1d(a.token, b.token, assume_unique=True, return_indices=True)
    pairs = a.count[i] * b.count[j]
    few = pairs < DENSE
    x, y, size = i[few], j[few], pairs[few]
    done = np.concatenate([[0], np.cumsum(size)])
    lo = 0
    while lo < len(x):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + (1 << 22), "right")) - 1)
        k = np.repeat(np.arange(lo, hi), size[lo:hi])
        nth = np.arange(len(k)) - (done[k] - done[lo])
        first, second = a.row[a.start[x[k]] + nth // b.count[y[k]]], b.row[b.start[y[k]] + nth % b.count[y[k]]]
        out += np.bincount(first * nb + second, minlength=na * nb)
        lo = hi
    out = out.reshape(na, nb)
    i, j = i[~few], j[~few]
    for lo in range(0, len(i), 1024):
        sides = []
        for p, at in ((a, i[lo : lo + 1024]), (b, j[lo : lo + 1024])):
            m = np.zeros((len(p.cid), len(at)), dtype=np.float32)
            m[p.row[_ranges(p.start[at], p.count[at])], np.repeat(np.arange(len(at)), p.count[at])] = 1
            sides.append(m)
        out += np.rint(sides[0] @ sides[1].T).astype(np.int64)
    return out


def linked_copies(a: Panel, b: Panel, reference: int, percent: int) -> np.ndarray:
    """For every class of ``a``, the documents of the classes of ``b`` that link with it; ``reference``: the reference's size."""
    both = a.n[:, None] + b.n[None, :]
    sure = reference - a.lacks[:, None] - b.lacks[None, :]
    common = sure if (100 * sure >= percent * (both - sure)).all() else sure + shared_counts(a, b)
    hit = (100 * common >= percent * (both - common)) & (a.cid[:, None] != b.cid[None, :])
    return hit @ b.copies


def family_counts(classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """(cid, w): the documents of the other classes of a class's group that link with it. ``classes``: cid, id, copies, heavy, g, size."""
    own = classes.where("size > 1").withColumn("panels", F.ceil(F.col("size") / PANEL))
    members = own.select("g", "panels", F.pmod(F.xxhash64("cid"), "panels").alias("p"), F.lit(1).alias("kind"), "cid", "id", "copies")
    first = own.groupBy("g").agg(F.max_by(F.struct("cid", "id", "panels"), F.struct("heavy", "cid")).alias("ref"))
    refs = first.select(
        "g", "ref.panels", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ref.panels") - 1)).alias("p"), F.lit(0).alias("kind"), "ref.cid", "ref.id", F.lit(0).cast("long").alias("copies")
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = with_bodies(durable(members.unionByName(refs)), texts).select("g", "p", "kind", "panels", "cid", "copies", "body")
    rows = rows.repartition("g", "p").sortWithinPartitions("g", "p", "kind")

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ref, held, known = None, None, None, set()

        def made() -> Iterator[pa.RecordBatch]:
            if held and held[0]:
                g, p, panels = group
                columns = [pa.array([x], pa.int64()) for x in (g, p, panels, len(ref))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([Panel.packed(*held)], pa.binary())], names=["g", "p", "panels", "reference", "body"])

        for batch in batches:
            key = list(zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True))
            kinds, cids, copies = (batch.column(k).to_pylist() for k in (2, 4, 5))
            for a, found in shingle_sets(pa.array(map(unpacked, batch.column(6).to_pylist()), pa.large_string()), size):
                for r, tokens in enumerate(found, a):
                    if digest(tokens) != cids[r]:
                        continue  # another text under the same id
                    if key[r] != group:
                        yield from made()
                        group, ref, held, known = key[r], None, ([], [], [], [], []), set()
                    if kinds[r] == 0:
                        ref = tokens
                    elif cids[r] not in known:
                        known.add(cids[r])
                        delta = np.setxor1d(ref, tokens, assume_unique=True)
                        lacks = (len(delta) + len(ref) - len(tokens)) // 2
                        for column, x in zip(held, (cids[r], copies[r], len(tokens), lacks, delta), strict=True):
                            column.append(x)
        yield from made()

    panels = rows.mapInArrow(A.tidied(differences), "g long, p long, panels long, reference long, body binary")
    aimed = panels.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("panels") - 1)).alias("aim"), "p", "reference", "body")
    aimed = aimed.select("g", "aim", (F.col("aim") != F.col("p")).alias("other"), "reference", "body").repartition("g", "aim").sortWithinPartitions("g", "aim", "other")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own, total = None, None, None

        def made() -> Iterator[pa.RecordBatch]:
            if own is not None:
                yield pa.RecordBatch.from_arrays([pa.array(own.cid), pa.array(total)], names=["cid", "w"])

        for batch in batches:
            for k in range(len(batch)):
                key = (batch.column(0)[k].as_py(), batch.column(1)[k].as_py())
                panel, reference = Panel(batch.column(4)[k].as_py()), batch.column(3)[k].as_py()
                if key != group:
                    yield from made()
                    group, own, total = key, panel, np.zeros(len(panel.cid), dtype=np.int64)
                total += linked_copies(own, panel, reference, percent)
        yield from made()

    return aimed.mapInArrow(A.tidied(count), "cid long, w long")


def similarity_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", counted: bool = True) -> DataFrame:
    """(id, n_shingles, component_id, n_links) of every document; ``counted``: with the last, the other documents that link with it."""
    ship(docs.sparkSession)
    frequent = frequent_shingles(docs, id_col, text_col, size)
    base = written(sketches(docs, frequent, id_col, text_col, size, percent), "sketches")
    known = base.where(F.col("cid").isNotNull() & F.col("id").isNotNull())
    classes = known.groupBy("cid").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.max(F.struct("heavy", "keys")).alias("own"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.select("cid", "id", "n", "own.heavy", "own.keys", "copies"), "classes")
    near = durable(leader_links(classes, docs, id_col, text_col, size, percent))
    groups = components(near, "u", "v")
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    groups = durable(groups.join(sizes, "root").select(F.col("node").alias("cid"), "root", "size"))
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    grouped = [F.coalesce("root", "cid").alias("g"), F.coalesce("size", F.lit(1)).alias("size")]
    entries = base.where(F.col("prefix").isNotNull() & F.col("id").isNotNull()).join(groups, "cid", "left").select("cid", "n", "prefix", *grouped)
    placed = classes.join(groups, "cid", "left").select("cid", "id", "copies", "heavy", *grouped)
    entered = (classes.agg(F.sum("n")).first()[0] or 0) * (100 - percent) // 100
    across = matrix_links(entries, placed, docs, id_col, text_col, size, percent, shard_bits(entered))
    if counted:
        across = durable(across)
        within = family_counts(placed, docs, id_col, text_col, size, percent)
        counts = across.select(F.col("u").alias("cid"), "w").unionByName(within).groupBy("cid").agg(F.sum("w").alias("w"))
    whole = components(near.unionByName(across.where("v is not null").select("u", "v")), "u", "v")
    smallest = classes.select("cid", "id", "copies").join(whole.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    roots = smallest.groupBy("root").agg(F.min("id").alias("component_id"))
    by_class = smallest.select("cid", "root", "copies").join(roots, "root").select("cid", "component_id", "copies")
    if counted:
        by_class = by_class.join(counts, "cid", "left").select("cid", "component_id", (F.col("copies") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"))
    out = base.select("id", "n", "cid").join(by_class, "cid", "left")
    own = F.when(F.col("cid").isNull() | F.col("component_id").isNull(), F.col("id")).otherwise(F.col("component_id"))
    links = [F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).alias("n_links")] if counted else []
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), *links)


def keep_first(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One document of each component (the smallest id), with all its columns; rows without an id stay."""
    found = similarity_components(docs, id_col=id_col, counted=False, **options)
    dropped = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__drop")).distinct()
    return docs.join(dropped, docs[id_col] == dropped["__drop"], "left_anti")


#: The same rows in DuckDB.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w
),
t AS (SELECT doc_id, unnest(s) AS tok FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM t a JOIN t b ON a.tok = b.tok AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = s.doc_id), s.doc_id)) AS component_id,
  coalesce((SELECT count(*) FROM e WHERE e.a = s.doc_id), 0) AS n_links FROM s
"""
