"""Caches as of any time: what a store of bounded size and age holds, and which lookups it answers.

A store that drops its least recently refreshed entry holds, at any time, the ``capacity`` distinct keys refreshed last. So
a chunk of a group's rows is summarised by its last ``capacity`` distinct keys, summaries compose (the later one's keys
come first), and each chunk is replayed from the state that the chunks before leave, in a task of its own.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.operators.scans import PER_CHUNK, chunked
from harrow.session import durable, ship


def contents(rows: DataFrame, group: str, key: str, order: list[str], capacity: int) -> DataFrame:
    """(group, key, order...): what the store of each group holds after its rows, all of which refresh their key."""
    last = rows.groupBy(group, key).agg(F.max(F.struct(*order)).alias("__last"))
    w = Window.partitionBy(group).orderBy(F.desc("__last"), F.desc(key))
    return last.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= capacity).select(group, key, "__last.*")


def states(rows: DataFrame, group: str, key: str, order: list[str], capacity: int) -> DataFrame:
    """(group, __chunk, key, __last): the store at the beginning of each chunk but the first, by doubling spans of chunks."""
    last = rows.groupBy(group, "__chunk", key).agg(F.max(F.struct(*order)).alias("__last"))
    w = Window.partitionBy(group, "__chunk").orderBy(F.desc("__last"), F.desc(key))
    best = lambda df: df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= capacity).drop("__rank")
    most = rows.agg(F.max("__chunk")).first()[0] or 0
    span, held = 1, durable(best(last).withColumn("__chunk", F.col("__chunk") + 1))
    while span < most:  # held: of the ``span`` chunks before each
        both = held.unionByName(held.withColumn("__chunk", F.col("__chunk") + span).where(F.col("__chunk") <= most))
        held = durable(best(both.groupBy(group, "__chunk", key).agg(F.max("__last").alias("__last"))))
        span *= 2
    return held.where(F.col("__chunk") <= most)


def lookups(rows: DataFrame, group: str, key: str, order: list[str], at: str, capacity: int, ttl: float | None = None, refreshes: str | None = None, per_chunk: int = PER_CHUNK) -> DataFrame:
    """``rows`` with ``hit`` (the key is held just before the row, and was refreshed at most ``ttl`` ago).

    Every row refreshes its key, or those that the column ``refreshes`` names. ``at``: seconds; ``order`` puts rows of one
    instant in order and begins with ``at``. Groups with many rows are cut in chunks of about ``per_chunk``.
    """
    ship(rows.sparkSession)
    writes = F.lit(True) if refreshes is None else F.coalesce(F.col(refreshes), F.lit(False))
    c = chunked(rows.withColumn("__write", writes), group, at, per_chunk)
    c = c.withColumn("__at", F.col(at).cast("double")).withColumn("__order", F.struct(*order))
    start = states(c.where("__write"), group, key, order, capacity)
    seeds = start.select(group, "__chunk", key, F.col(f"__last.{order[0]}").cast("double").alias("__at"), F.col("__last").alias("__order"), F.lit(True).alias("__write"), F.lit(None).cast("long").alias("__row"))
    numbered = c.withColumn("__row", F.monotonically_increasing_id())
    numbered = durable(numbered)  # so that numbers stay when a task is run again
    # a chunk's rows in order, the store's entries before them
    entry = F.struct(F.col("__row").isNotNull().alias("own"), F.col("__order").alias("o"), F.col(key).alias("k"), F.col("__at").alias("t"), F.col("__write").alias("w"), F.col("__row").alias("r"))
    both = numbered.select(group, "__chunk", key, "__at", "__order", "__write", "__row").unionByName(seeds).groupBy(group, "__chunk").agg(F.array_sort(F.collect_list(entry)).alias("seq"))
    replay = both.select(F.col("seq.own").alias("own"), F.col("seq.k").alias("k"), F.col("seq.t").alias("t"), F.col("seq.w").alias("w"), F.col("seq.r").alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, keys, times, writes, numbers in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                held: OrderedDict = OrderedDict()
                ids, hits = [], []
                for o, k, t, w, r in zip(own, keys, times, writes, numbers, strict=True):
                    if o:
                        ids.append(r)
                        hits.append(k in held and (ttl is None or t - held[k] <= ttl))
                    if w:
                        held[k] = t
                        held.move_to_end(k)
                        if len(held) > capacity:
                            held.popitem(last=False)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hits, pa.bool_())], names=["__row", "hit"])

    found = replay.mapInArrow(run, "__row long, hit boolean")
    return numbered.join(found, "__row").select(*rows.columns, "hit")
