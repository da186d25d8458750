"""Change detection over snapshots: hashes, watch states, line differences, digests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions import text as X
from harrow.session import ship


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def watch(snapshots: DataFrame, key: str, order: list[str], signature: str) -> DataFrame:
    """Every snapshot with its watch state: the hash before, first run, changed, counters so far, place of the last change."""
    by = Window.partitionBy(key).orderBy(*order)
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    out = snapshots.withColumn("hash", content_hash(F.col(signature)))
    out = out.withColumn("previous_hash", F.lag("hash").over(by)).withColumn("first_run", F.col("previous_hash").isNull())
    out = out.withColumn("changed", ~F.col("first_run") & (F.col("previous_hash") != F.col("hash")))
    out = out.withColumn("checks", F.count(F.lit(1)).over(so_far)).withColumn("changes", F.sum(F.col("changed").cast("long")).over(so_far))
    return out.withColumn("last_changed", F.last(F.when(F.col("changed"), F.struct(*order, "checks")), ignorenulls=True).over(so_far))


def change_payloads(watched: DataFrame, key: str, at: str, diff: Column | None = None) -> DataFrame:
    """(key, payload): the JSON that tells a subscriber of every change. Sending it is the caller's, in ``foreachBatch`` for a stream."""
    body = F.struct(
        F.lit("watch.change").alias("event"), F.col(key).alias("url"), "previous_hash", F.col("hash").alias("current_hash"),
        F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("detected_at"), (F.lit(None).cast("string") if diff is None else diff).alias("diff"),
    )
    return watched.where("changed").select(key, F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


def line_sets(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, removed, added, n_before, n_after) of pairs of texts: the lines of each side that the other lacks, in order, repeated ones kept.

    ``key`` names a pair. Lines are grouped by pair and line, so that the work grows with their number; null is an empty text.
    """
    sides = F.array(*[F.struct(F.lit(n).alias("side"), X.line_array(F.coalesce(F.col(c), F.lit(""))).alias("lines")) for n, c in enumerate((before, after))])
    lines = pairs.select(key, F.inline(sides)).select(key, "side", F.posexplode("lines").alias("place", "line"))
    # one side's places of a line in a pair; those of a line that both sides have are dropped before they meet again
    own = lines.groupBy(key, "line").agg(F.min("side").alias("side"), F.max("side").alias("most"), F.collect_list("place").alias("places"))
    own = own.where("side = most").select(key, "side", "line", F.explode("places").alias("place"))
    kept = lambda n: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == n, F.struct("place", "line")))), lambda x: x["line"])
    found = own.groupBy(key).agg(kept(0).alias("removed"), kept(1).alias("added"))
    size = lambda c: F.size(X.line_array(F.coalesce(F.col(c), F.lit(""))))
    none = F.array().cast("array<string>")
    all_pairs = pairs.select(key, size(before).alias("n_before"), size(after).alias("n_after"), (F.coalesce(F.col(before), F.lit("")) == "").alias("was_empty"))
    out = all_pairs.join(found, key, "left")
    return out.select(key, F.coalesce("removed", none).alias("removed"), F.coalesce("added", none).alias("added"), "n_before", "n_after", "was_empty")


def unified(removed: Column, added: Column, most: int = 200) -> Column:
    """The two lists of ``line_sets`` as one text of at most ``most`` lines."""
    lines = F.concat(F.transform(removed, lambda x: F.concat(F.lit("- "), x)), F.transform(added, lambda x: F.concat(F.lit("+ "), x)))
    more = F.size(lines) - most
    shown = F.array_join(F.slice(lines, 1, most), "\n")
    return F.when(more > 0, F.concat(shown, F.lit("\n... "), more.cast("string"), F.lit(" more"))).otherwise(shown)


def change_percent() -> Column:
    """Of a row of ``line_sets``."""
    lines = F.greatest("n_before", "n_after", F.lit(1))
    return F.when(F.col("was_empty"), 100.0).otherwise((F.size("removed") + F.size("added")) / (2.0 * lines) * 100)


def digest(changes: DataFrame, topics: DataFrame, threshold: float) -> DataFrame:
    """Per topic: URLs checked, meaningful changes (the topic's own threshold, else the common one). ``changes``: url, changed, pct."""
    joined = topics.join(changes, "url", "left").withColumn("least", F.coalesce("min_change_pct", F.lit(threshold)))
    hit = F.coalesce(F.col("changed") & (F.col("pct") >= F.col("least")), F.lit(False))
    return joined.groupBy("topic").agg(F.count(F.lit(1)).alias("urls_checked"), F.count_if(hit).alias("meaningful"))


def digest_markdown(changes: DataFrame, topics: DataFrame, threshold: float) -> DataFrame:
    joined = topics.join(changes, "url").withColumn("least", F.coalesce("min_change_pct", F.lit(threshold)))
    joined = joined.where(F.col("changed") & (F.col("pct") >= F.col("least")))
    line = F.concat(F.lit("- "), F.col("url"), F.lit(" ("), X.fixed(F.col("pct"), 1), F.lit("%)"))
    return joined.groupBy("topic").agg(F.array_join(F.concat(F.array(F.concat(F.lit("## "), F.first("topic"))), F.array_sort(F.collect_list(line))), "\n").alias("markdown"))


def _row(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``b`` and every prefix of ``a``, 64 places of ``a`` at a time.

    Bit i of ``v`` is 0 where the length grows from the prefix of i places to that of i + 1.
    """
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    every = v = (1 << len(a)) - 1
    for y in b:
        u = v & at.get(y, 0)
        v = ((v + u) | (v - u)) & every
    grows = np.unpackbits(np.frombuffer((every & ~v).to_bytes(len(a) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(a)]
    return np.concatenate(([0], np.cumsum(grows, dtype=np.int64)))


def common_lines(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, in order, in memory that grows with the lines and not with their product.

    The second list is halved where it is; the first is cut where the lengths of both halves' subsequences add up to most.
    """
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, l = todo.pop()
        while i < j and k < l and a[i] == b[k]:
            found.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < l and a[j - 1] == b[l - 1]:
            j, l = j - 1, l - 1
            found.append((j, l))
        if i == j or k == l:
            continue
        if l - k == 1:
            if b[k] in a[i:j]:
                found.append((a.index(b[k], i, j), k))
            continue
        mid = (k + l) // 2
        total = _row(a[i:j], b[k:mid]) + _row(a[i:j][::-1], b[mid:l][::-1])[::-1]
        cut = i + int(total.argmax())
        todo += [(cut, j, mid, l), (i, cut, k, mid)]
    return sorted(found)


def edit_script(a: list[str], b: list[str]) -> tuple[list[str], int, int, int]:
    """Shortest line edit script: (script, added, removed, kept); removed lines come before added ones.

    Common ends are kept at once, and lines that one side lacks cannot be; the rest is ``common_lines``.
    """
    code: dict[str, int] = {}
    x, y = ([code.setdefault(s, len(code)) for s in lines] for lines in (a, b))
    left, right = set(x), set(y)
    ia, ib = [i for i, s in enumerate(x) if s in right], [i for i, s in enumerate(y) if s in left]
    kept = [(ia[i], ib[k]) for i, k in common_lines([x[i] for i in ia], [y[i] for i in ib])]
    out, at, to = [], 0, 0
    for i, k in [*kept, (len(a), len(b))]:
        out += ["- " + s for s in a[at:i]] + ["+ " + s for s in b[to:k]]
        if i < len(a):
            out.append("  " + a[i])
        at, to = i + 1, k + 1
    return out, len(b) - len(kept), len(a) - len(kept), len(kept)


def line_diff(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, diff, additions, deletions, unchanged) of each pair of texts. One pass, no shuffle."""
    ship(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [edit_script((a or "").split("\n"), (b or "").split("\n")) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(["\n".join(x[0]) for x in made], pa.string()), *(pa.array([x[k] for x in made], pa.int64()) for k in (1, 2, 3))],
                names=[key, "diff", "additions", "deletions", "unchanged"],
            )

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(key, before, after).mapInArrow(run, f"{key} {kind}, diff string, additions long, deletions long, unchanged long")


def pixel_diff(pixels: DataFrame, key: str) -> DataFrame:
    """Per image pair, from pixels (key, r1, g1, b1, r2, g2, b2): share of pixels more than 30 apart, and whether they match (1 %)."""
    far = F.sqrt(sum((F.col(f"{c}1") - F.col(f"{c}2")) * (F.col(f"{c}1") - F.col(f"{c}2")) for c in "rgb")) > 30
    out = pixels.groupBy(key).agg(F.count(F.lit(1)).alias("pixels"), F.count_if(far).alias("different"))
    share = F.col("different") / F.col("pixels") * 100
    return out.select(key, "pixels", "different", share.alias("mismatch_pct"), (share <= 1).alias("match"))
