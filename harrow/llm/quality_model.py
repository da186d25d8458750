"""Quality classifier: interpolated modified Kneser-Ney over bytes, trained on trusted text, scored by sharded joins.

Training counts every n-gram of ``ORDER`` bytes of all trusted documents but a fold held out (no sample). Lower orders
hold continuation counts; each order has three discounts from its counts of counts. Probabilities of an order are made
by joining its counts to the totals of their contexts and to the next lower order, all keyed by n-gram.

Scoring never broadcasts the model. Documents are packed into blocks of about ``BLOCK`` bytes; a block asks for its
distinct n-grams only, the requests of all blocks are joined to the model order by order (probability, or back-off
weight times that of the next shorter suffix), and the code lengths go back to the block, whose texts are then scored. Requests
and answers travel as compressed arrays, one for each block and shard (n-gram modulo ``SHARDS``). The blocks are a
table bucketed by block, so texts are not shuffled; it is dropped when the texts are scored. A block is a row and
nearly every block a file: with larger blocks (``BLOCK``) a big cluster writes fewer.

A document's bits per byte (log2 of its perplexity) is held against a quantile of its language's held-out trusted
documents. Where fewer than ``TAIL`` of them lie beyond the quantile it is an outlier's place, and the threshold is the
language's median times the quantile of all held-out documents' ratios to their own language's median; a language
without such documents takes the quantile of all. Beyond ``slack`` times the threshold the document is rejected.

Defined results: null and empty texts have no perplexity (null) and are rejected; a null language is a language of its
own; without trusted text every n-gram costs 8 bits and nothing with text is rejected; repeated rows repeat;
label rows of unknown documents are ignored, one document labelled both ways is not trusted; an empty table gives
an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm import arrays as A
from harrow.session import durable, forget, passing, removed, shared_dir, ship, written

ORDER = 5
BLOCK = 16 << 20
HELD = 1 << 20  # distinct n-grams that a counting task holds before it passes them on
QUANTILE, SLACK = 0.99, 1.0
TAIL = 10  # held-out documents beyond the quantile that make it a language's own
BROADCAST_BYTES = 64 << 20  # of ids that may be broadcast; beyond that the join shuffles
SHARDS = 251


def grams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each byte, itself (lowest) and the ORDER - 1 bytes before it, zeros before the start of its text."""
    out = data.astype(np.int64)
    place = np.arange(len(data)) - np.repeat(offs[:-1], np.diff(offs))
    for k in range(1, ORDER):
        before = np.zeros(len(data), dtype=np.int64)
        before[k:] = data[:-k] if len(data) > k else 0
        before[place < k] = 0
        out |= before << (8 * k)
    return out


def semi(df: DataFrame, ids: DataFrame, id_col: str, kind: str) -> DataFrame:
    """``df`` joined (left_semi, left_anti) to distinct ids, which are broadcast when there are few enough."""
    ids = durable(ids.select(F.col(id_col).alias("__id")).where("__id is not null").distinct())
    size = ids.agg(F.sum(F.octet_length(F.col("__id").cast("string")) + 16)).first()[0] or 0
    small = F.broadcast(ids) if size <= BROADCAST_BYTES else ids
    return df.join(small, df[id_col] == small["__id"], kind)


def trusted_ids(labels: DataFrame, id_col: str) -> DataFrame:
    """Documents labelled of good quality and not toxic, by all their labels."""
    good = labels.groupBy(id_col).agg(F.min("quality").alias("__q"), F.max(F.coalesce(F.col("toxic"), F.lit(0))).alias("__t"))
    return good.where("__q >= 1 and __t = 0").select(id_col)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 0, F.lit(False))


def count_grams(texts: DataFrame) -> DataFrame:
    """(g, c) of all texts (one column)."""

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        g, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        return g, np.bincount(at, weights=np.concatenate([x[1] for x in held])).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            data, offs = A.buffers(batch.column(0))
            for a, b in A.blocks(offs):
                held.append(np.unique(grams(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]), return_counts=True))
                if len(held) > 16:
                    held = [merged(held)]
                    if len(held[0][0]) > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["g", "c"])
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(held)], names=["g", "c"])

    return texts.mapInArrow(A.tidied(run), "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of n-grams seen once, twice and more, from the counts of counts."""
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(raw))  # type: ignore[return-value]


def mask(k: int) -> int:
    return (1 << 8 * k) - 1


class Model:
    """Per order, the probabilities (g, p) of its n-grams and the weights (ctx, weight) of the order below; all in the shared folder."""

    def __init__(self) -> None:
        self.probabilities: dict[int, DataFrame] = {}
        self.weights: dict[int, DataFrame] = {}
        self.floor = 1 / 256  # the probability of a byte that was never seen
        self.tables: list[DataFrame] = []

    def kept(self, df: DataFrame) -> DataFrame:
        self.tables.append(written(df, "grams"))
        return self.tables[-1]

    def forget(self) -> None:
        for df in self.tables:
            forget(df)


def train(texts: DataFrame) -> Model:
    """The model of all orders from texts (one column)."""
    model = Model()
    counts = {ORDER: model.kept(count_grams(texts))}
    for k in range(ORDER - 1, 0, -1):
        counts[k] = model.kept(counts[k + 1].groupBy(F.col("g").bitwiseAND(F.lit(mask(k))).alias("g")).agg(F.count(F.lit(1)).alias("c")))
    for k in range(1, ORDER + 1):
        own = counts[k]
        of = own.agg(*[F.count_if(F.col("c") == i) for i in range(1, 5)]).first()
        d1, d2, d3 = discounts(*of)
        discount = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        context = F.shiftright("g", 8) if k > 1 else F.lit(0).cast("long")
        stats = own.groupBy(context.alias("ctx")).agg(F.sum("c").alias("total"), F.sum(discount).alias("freed"))
        stats = model.kept(stats.select("ctx", "total", (F.col("freed") / F.col("total")).alias("weight")))
        rows = own.withColumn("ctx", context).join(stats, "ctx")
        if k == 1:
            first = stats.select("weight").first()
            model.floor = first[0] / 256 if first else 1 / 256
            probability = (F.col("c") - discount) / F.col("total") + F.col("weight") / 256
        else:
            lower = model.probabilities[k - 1].select(F.col("g").alias("sub"), F.col("p").alias("below"))
            rows = rows.withColumn("sub", F.col("g").bitwiseAND(F.lit(mask(k - 1)))).join(lower, "sub")
            probability = (F.col("c") - discount) / F.col("total") + F.col("weight") * F.col("below")
        model.probabilities[k] = model.kept(rows.select("g", probability.alias("p")))
        model.weights[k] = stats.select("ctx", "weight")
    return model


def squeezed(x: np.ndarray) -> bytes:
    """Numbers as compressed bytes, those of equal weight beside each other."""
    return zstandard.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 3)


def restored(body: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(np.frombuffer(zstandard.decompress(body), np.uint8).reshape(width, -1).T.tobytes(), kind)


def dealt(g: np.ndarray) -> list[bytes]:
    """Sorted distinct n-grams as one compressed array for each shard."""
    shard = g % SHARDS
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(SHARDS + 1))
    whole = g[order] // SHARDS
    return [squeezed(np.diff(whole[a:b], prepend=0)) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def undealt(body: bytes, shard: int) -> np.ndarray:
    return np.cumsum(restored(body, np.int64)) * SHARDS + shard


def pack_blocks(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> str:
    """The table (block, body, grams): a block's documents (Arrow, compressed) and its distinct n-grams by shard; bucketed by block."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = stream = writer = None
        wanted, total = np.zeros(0, np.int64), 0

        def flush() -> pa.RecordBatch:
            writer.close()
            stream.close()
            body = sink.getvalue().to_pybytes()
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([body], pa.binary()), pa.array([dealt(wanted)], pa.list_(pa.binary()))], names=["block", "body", "grams"])

        for batch in batches:
            data, offs = A.buffers(batch.column(1))
            for a, b in A.blocks(offs):
                part = pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns], names=["id", "text", "lang"])
                if writer is None:
                    sink = pa.BufferOutputStream()
                    stream = pa.CompressedOutputStream(sink, "zstd")
                    writer = pa.ipc.new_stream(stream, part.schema)
                writer.write_batch(part)
                wanted = np.union1d(wanted, grams(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]))
                total += int(offs[b] - offs[a])
                if total >= BLOCK:
                    yield flush()
                    writer, wanted, total = None, np.zeros(0, np.int64), 0
        if writer is not None:
            yield flush()

    rows = docs.select(F.col(id_col), F.col(text_col), F.col(lang_col)).mapInArrow(A.tidied(run), "block string, body binary, grams array<binary>")
    name = f"harrow_blocks_{uuid.uuid4().hex}"
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.write.bucketBy(buckets, "block").option("path", passing(spark, f"{shared_dir(spark)}/{name}")).saveAsTable(name)
    return name


def code_lengths(wanted: DataFrame, model: Model) -> DataFrame:
    """(g, bits) of the n-grams ``wanted`` (g): the longest known suffix, weighted for each longer context that is known.

    The suffixes of each length are looked up once each, from the shortest to the n-grams themselves; most n-grams share
    their suffixes with others, so the joins grow from order to order.
    """
    asked = {ORDER: wanted.distinct()}
    for k in range(ORDER - 1, 0, -1):
        asked[k] = asked[k + 1].select(F.col("g").bitwiseAND(F.lit(mask(k))).alias("g")).distinct()
    found = asked[1].join(model.probabilities[1], "g", "left").select("g", F.coalesce("p", F.lit(model.floor)).alias("p"))
    for k in range(2, ORDER + 1):
        lower = found.select(F.col("g").alias("sub"), F.col("p").alias("below"))
        rows = asked[k].select("g", F.col("g").bitwiseAND(F.lit(mask(k - 1))).alias("sub"), F.shiftright("g", 8).alias("ctx")).join(lower, "sub")
        rows = rows.join(model.weights[k], "ctx", "left").join(model.probabilities[k], "g", "left")
        found = rows.select("g", F.coalesce("p", F.coalesce("weight", F.lit(1.0)) * F.col("below")).alias("p"))
    return found.select("g", (-F.log2("p")).cast("float").alias("bits"))


def answered(wanted: DataFrame, bits: DataFrame) -> DataFrame:
    """(block, shard, bits) of the requests ``wanted`` (block, shard, body): the code lengths in the order of the n-grams.

    A shard's code lengths come before its requests, which are answered one by one.
    """
    known = bits.select(F.pmod("g", F.lit(SHARDS)).cast("int").alias("shard"), F.lit(0).alias("kind"), "g", "bits", F.lit(None).cast("string").alias("block"), F.lit(None).cast("binary").alias("body"))
    asked = wanted.select("shard", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("g"), F.lit(None).cast("float").alias("bits"), "block", "body")
    rows = known.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind", "g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held_g, held_bits, g, cost = None, [], [], None, None
        for batch in batches:
            shards, kinds = (batch.column(k).to_numpy() for k in (0, 1))
            edge = np.flatnonzero(np.concatenate([[True], (shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1]), [True]])) if len(batch) else []
            out: tuple[list, list, list] = ([], [], [])
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if shards[a] != of:
                    of, held_g, held_bits, g = int(shards[a]), [], [], None
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    held_g.append(part.column(2).to_numpy())
                    held_bits.append(part.column(3).to_numpy())
                    continue
                if g is None:
                    g, cost = np.concatenate(held_g), np.concatenate(held_bits)
                for block, body in zip(part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True):
                    out[0].append(block)
                    out[1].append(of)
                    out[2].append(squeezed(cost[np.searchsorted(g, undealt(body, of))]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], names=["block", "shard", "bits"])

    return rows.select("shard", "kind", "g", "bits", "block", "body").mapInArrow(A.tidied(run), "block string, shard int, bits binary")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, n_bytes, bits) of every document; bits is null for texts without bytes."""
    spark = docs.sparkSession
    name = pack_blocks(docs, id_col, text_col, lang_col)
    blocks = spark.table(name)
    none = squeezed(np.zeros(0, np.int64))
    wanted = blocks.select("block", F.posexplode("grams").alias("shard", "body")).where(F.col("body") != F.lit(none))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(undealt(body, shard))], names=["g"])

    bits = code_lengths(wanted.select("shard", "body").mapInArrow(A.tidied(spread), "g long"), model)
    answers = answered(wanted, bits).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("shard", "bits"))).alias("found"))
    id_type, lang_type = docs.schema[id_col].dataType.simpleString(), docs.schema[lang_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                pieces, found = batch.column(1)[r].as_py(), batch.column(2)[r].as_py() or []
                known = np.concatenate([np.zeros(0, np.int64), *(undealt(pieces[x["shard"]], x["shard"]) for x in found)])
                cost = np.concatenate([np.zeros(0, np.float32), *(restored(x["bits"], np.float32) for x in found)])
                order = np.argsort(known)
                known, cost = known[order], cost[order]
                body = pa.CompressedInputStream(pa.BufferReader(batch.column(0)[r].as_buffer()), "zstd")
                for part in pa.ipc.open_stream(body):
                    data, offs = A.buffers(part.column(1))
                    if len(known):
                        per_byte = cost[np.searchsorted(known, grams(data, offs))].astype(np.float64)
                    else:
                        per_byte = np.zeros(0)
                    n = np.diff(offs)
                    total = np.bincount(np.repeat(np.arange(len(n)), n), weights=per_byte, minlength=len(n))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(total, pa.float64(), mask=n == 0)], names=["id", "lang", "n_bytes", "bits"]
                    )

    both = blocks.join(answers, "block", "left").select("body", "grams", "found")
    out = durable(both.mapInArrow(A.tidied(run), f"id {id_type}, lang {lang_type}, n_bytes long, bits double"))
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    removed(spark, f"{shared_dir(spark)}/{name}")
    return out


def thresholds(fold: DataFrame, quantile: float) -> DataFrame:
    """(__lang, at) from a fold (__lang, bits_per_byte): the language's quantile, or its median times the common spread."""
    own = [F.percentile_approx("bits_per_byte", q, 10000).alias(name) for q, name in ((quantile, "__own"), (0.5, "__mid"))]
    by_lang = durable(fold.groupBy("__lang").agg(*own, F.count(F.lit(1)).alias("__n")))
    ratio = F.col("bits_per_byte") / F.nullif(F.col("__mid"), F.lit(0.0))
    spread = fold.join(by_lang, "__lang").agg(F.percentile_approx(ratio, quantile, 10000)).first()[0]
    enough = F.col("__n") * (1 - quantile) >= TAIL
    return by_lang.select("__lang", F.when(enough, F.col("__own")).otherwise(F.coalesce(F.col("__mid") * F.lit(spread).cast("double"), "__own")).alias("at"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, n_bytes, bits_per_byte, perplexity, threshold, kept) of every document."""
    ship(docs.sparkSession)
    trusted = durable(trusted_ids(labels, id_col))
    own = docs.select(id_col, text_col)
    texts = semi(own.where(~held_out(id_col) & (F.octet_length(text_col) > 0)), trusted, id_col, "left_semi").select(text_col)
    model = train(texts)
    scored = score(docs, model, id_col, text_col, lang_col)
    model.forget()
    scored = scored.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), "n_bytes", (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"))
    fold = semi(scored.where(held_out(id_col) & F.col("bits_per_byte").isNotNull()), trusted, id_col, "left_semi")
    tag = F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit("")).alias("__lang")
    out = scored.select("*", tag).join(thresholds(fold.select(tag, "bits_per_byte"), quantile), "__lang", "left")
    overall = fold.agg(F.percentile_approx("bits_per_byte", quantile, 10000)).first()[0]
    threshold = F.coalesce(F.col("at"), F.lit(overall).cast("double")) * slack
    return out.select(
        id_col, lang_col, "n_bytes", "bits_per_byte", F.pow(F.lit(2.0), "bits_per_byte").alias("perplexity"), threshold.alias("threshold"),
        F.coalesce(F.col("bits_per_byte").isNotNull() & (threshold.isNull() | (F.col("bits_per_byte") <= threshold)), F.lit(False)).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that are not rejected, with all their columns; rows without an id are judged by nothing and stay."""
    verdicts = classify(docs, labels, id_col=id_col, **options)
    kept = verdicts.where("kept").select(id_col)
    rejected = verdicts.where("not kept").select(id_col).join(kept, id_col, "left_anti")
    return semi(docs, rejected, id_col, "left_anti").select(*[docs[f"`{c}`"] for c in docs.columns])
