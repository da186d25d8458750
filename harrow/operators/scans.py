"""Ordered scans of a key's events by chunks, so that a key with a large share of all rows is many tasks' work.

``chunked`` cuts the events of busy keys at instants; what a chunk does is summarised, summaries are scanned in order, and
where rows are wanted each chunk is given what it starts from.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.session import ship

PER_CHUNK = 10_000


def chunked(events: DataFrame, key: str, at: str, per_chunk: int = PER_CHUNK) -> DataFrame:
    """``events`` with ``__chunk``: 0 for keys of at most ``per_chunk`` events, else equal parts of the key's time, about
    ``per_chunk`` events each where they are spread evenly. Chunks are in the order of ``at``; equal instants share one.
    """
    n = F.count(F.lit(1))
    busy = events.groupBy(key).agg(n.alias("__n"), F.min(at).alias("__from"), F.max(at).alias("__to")).where(F.col("__n") > per_chunk)
    share = F.try_divide(F.col(at) - F.col("__from"), F.col("__to") - F.col("__from")) * F.ceil(F.col("__n") / per_chunk)
    return events.join(busy, key, "left").withColumn("__chunk", F.coalesce(F.floor(share), F.lit(0)).cast("long")).drop("__n", "__from", "__to")


def queue_pairs(events: DataFrame, key: str, at: str, order: list[str], asks: str, per_chunk: int = PER_CHUNK) -> DataFrame:
    """``events`` with ``__k``: the number of a request in its key, or of the request that a response answers; null for a
    response when nothing is outstanding.

    First in, first out: with +1 for a request and -1 for a response, the queue's length is the running sum held at 0
    from below. Within a chunk that needs the sum and the least sum so far, and what was outstanding when it began; that
    is, over the chunks before, the sum of all plus the greatest (own sum less least sum, less the sums up to it).
    """
    c = chunked(events, key, at, per_chunk).withColumn("__x", F.when(F.col(asks), 1).otherwise(-1).cast("long"))
    inside = Window.partitionBy(key, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumns({"__sum": F.sum("__x").over(inside), "__asked": F.count_if(F.col(asks)).over(inside), "__answers": F.count_if(~F.col(asks)).over(inside)})
    c = c.withColumn("__least", F.least(F.lit(0), F.min("__sum").over(inside)))
    parts = c.groupBy(key, "__chunk").agg(F.sum("__x").alias("s"), F.min("__least").alias("m"), F.count_if(F.col(asks)).alias("r"))
    before = Window.partitionBy(key).orderBy("__chunk")
    parts = parts.withColumn("upto", F.sum("s").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("s").over(earlier) + F.greatest(F.lit(0), F.max(F.col("s") - F.col("m") - F.col("upto")).over(earlier)), F.lit(0))
    parts = parts.select(key, "__chunk", start.alias("__start"), F.coalesce(F.sum("r").over(earlier), F.lit(0)).alias("__before"))
    c = c.join(parts, [key, "__chunk"])
    lost = F.greatest(F.lit(0), -(F.col("__start") + F.col("__least")))  # responses of this chunk so far that found nothing
    was_least = F.coalesce(F.lag("__least").over(Window.partitionBy(key, "__chunk").orderBy(*order)), F.lit(0))
    answered = F.col("__before") - F.col("__start") + F.col("__answers") - lost
    found = F.when(F.col("__start") + F.col("__least") >= 0, True).otherwise(F.col("__least") == was_least)
    k = F.when(F.col(asks), F.col("__before") + F.col("__asked")).when(found, answered)
    return c.withColumn("__k", k).drop("__x", "__sum", "__asked", "__answers", "__least", "__start", "__before", "__chunk")


OPEN, CLOSED, HALF = "open", "closed", "half-open"


def breaker_table(times: list[float], oks: list[bool], fails: int, wait: float, probes: int) -> list[tuple]:
    """What a chunk of events makes of a breaker, for every state that it can begin in.

    Rows: (state, place, after, until, to, place, since, rel, bad, opened). ``place``: failures (at most ``fails``), or
    successful probes where half open. An open breaker's end depends on the instant it opened at: a row holds if its wait
    was not over at ``after`` (where given) and was at ``until`` (where given). ``since`` null: as at the beginning.
    Failures are ``bad``, or ``bad`` more than before where ``rel``. States that have met are followed once.
    """
    # control state -> [what was done since its members met: (rel, bad, opened), members]
    # control states: (closed, failures), (half-open, probes), (open, failures, since or None for the first instant)
    def one(state: str, place: int) -> list:
        return [(True, 0, 0), [[state, place, None, None, True, 0, 0]]]

    groups: dict[tuple, list] = {(CLOSED, b): one(CLOSED, b) for b in range(fails)}
    groups |= {(HALF, p): one(HALF, p) for p in range(probes)}
    groups |= {(OPEN, b, None): one(OPEN, b) for b in range(fails + 1)}
    last: float | None = None

    def settled(done: tuple, members: list) -> list:
        rel, bad, opened = done
        return [[*m[:4], m[4] and rel, m[5] + bad if rel else bad, m[6] + opened] for m in members]

    def put(to: dict, key: tuple, done: tuple, members: list) -> None:
        if key not in to:
            to[key] = [done, members]
            return
        old = to[key]
        to[key] = [(True, 0, 0), [*settled(*old), *settled(done, members)]]

    for t, ok in zip(times, oks, strict=True):
        to: dict[tuple, list] = {}
        for key, (done, members) in groups.items():
            rel, bad, opened = done
            ways: list[tuple[tuple, tuple, list]] = [(key, done, members)]
            if key[0] == OPEN:
                if key[2] is None:  # those whose wait is over by now leave
                    ways = [((HALF, 0), done, [[m[0], m[1], last, t, *m[4:]] for m in members]), (key, done, members)]
                elif t - key[2] >= wait:
                    ways = [((HALF, 0), done, members)]
            for at, _, who in ways:
                if at[0] == HALF:
                    if not ok:
                        put(to, (OPEN, fails, t), (False, fails, opened + 1), who)
                    elif at[1] + 1 >= probes:
                        put(to, (CLOSED, 0), (False, 0, opened), who)
                    else:
                        put(to, (HALF, at[1] + 1), done, who)
                elif ok:
                    put(to, (at[0], 0, *at[2:]), (False, 0, opened), who)
                else:
                    b, more = min(at[1] + 1, fails), (rel, bad + 1, opened)
                    if b < fails:
                        put(to, (at[0], b, *at[2:]), more, who)
                    else:
                        if at[0] == OPEN and at[2] is None:  # of those, whose wait was not over
                            who = [[*m[:2], t, *m[3:]] for m in who]
                        put(to, (OPEN, b, t), (rel, bad + 1, opened + (at[0] == CLOSED)), who)
        groups, last = to, t
    rows = []
    for key, (done, members) in groups.items():
        for state, place, after, until, rel, bad, opened in settled(done, members):
            if key[0] == OPEN and key[2] is None:
                after = last
            rows.append((state, place, after, until, key[0], key[1], key[2] if key[0] == OPEN else None, rel, bad, opened))
    return rows


def busy_breakers(events: DataFrame, key: str, order: list[str], at: str, ok: str, fails: int, wait: float, probes: int, per_chunk: int = PER_CHUNK) -> DataFrame:
    """(key, state, failures, opened) of breakers whose events are many: chunks become transition tables, tables are composed in order."""
    ship(events.sparkSession)
    kind = events.schema[key].dataType.simpleString()
    c = chunked(events, key, at, per_chunk)
    own = c.groupBy(key, "__chunk").agg(F.array_sort(F.collect_list(F.struct(*order, F.col(at).cast("double").alias("__at"), F.col(ok).alias("__ok")))).alias("seq"))
    own = own.select(F.col(key).alias("k"), F.col("__chunk").alias("c"), F.col("seq.__at").alias("t"), F.col("seq.__ok").alias("ok"))
    columns = "state string, place int, after double, until double, to string, to_place int, since double, rel boolean, bad long, opened long"

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, chunk, t, good in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                rows = breaker_table(t, [bool(x) for x in good], fails, wait, probes)
                types = [pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.int32(), pa.float64(), pa.bool_(), pa.int64(), pa.int64()]
                same = pa.array([0] * len(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k.as_py()], batch.column(0).type).take(same), pa.array([chunk.as_py()], pa.int64()).take(same), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True))],
                    names=["k", "c", *(x.split()[0] for x in columns.split(", "))],
                )

    made = own.mapInArrow(tables, f"k {kind}, c long, {columns}")
    names = ["state", "place", "after", "until", "to", "to_place", "since", "rel", "bad", "opened"]
    each = made.groupBy("k", "c").agg(F.collect_list(F.struct(*names)).alias("rows")).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("c", "rows"))).alias("parts"))
    start = F.struct(F.lit(CLOSED).alias("state"), F.lit(0).alias("place"), F.lit(None).cast("double").alias("since"), F.lit(0).cast("long").alias("bad"), F.lit(0).cast("long").alias("opened"))

    def step(acc, part):
        over = lambda t: t - acc["since"] >= wait
        fits = lambda r: (r["state"] == acc["state"]) & (r["place"] == acc["place"]) & (r["after"].isNull() | ~over(r["after"])) & (r["until"].isNull() | over(r["until"]))
        # only an open breaker has an instant; other rows name none
        r = F.get(F.filter(part["rows"], lambda r: F.coalesce(fits(r), F.lit(False))), F.lit(0))
        since = F.when(r["to"] == OPEN, F.coalesce(r["since"], acc["since"]))
        return F.struct(r["to"].alias("state"), r["to_place"].alias("place"), since.alias("since"), F.when(r["rel"], acc["bad"] + r["bad"]).otherwise(r["bad"]).alias("bad"), (acc["opened"] + r["opened"]).alias("opened"))

    out = each.select(F.col("k").alias(key), F.aggregate("parts", start, step).alias("s"))
    return out.select(key, "s.state", F.col("s.bad").cast("int").alias("failures"), F.col("s.opened").cast("int").alias("opened"))
