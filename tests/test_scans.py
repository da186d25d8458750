"""Scans by chunks against plain queues and folds."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from harrow.operators import knowledge as K
from harrow.operators import network as N
from harrow.operators.scans import breaker_table


def queue(rows):
    """(url, request, response, duration) of rows (url, id, t, asks) by a queue for each URL."""
    waiting, out = defaultdict(deque), {}
    for url, i, t, asks in sorted(rows, key=lambda r: (r[2], not r[3], r[1])):
        if asks:
            waiting[url].append((i, t))
            out[url, i] = (None, None)
        elif waiting[url]:
            k, t0 = waiting[url].popleft()
            out[url, k] = (i, t - t0)
    return sorted((u, k, *v) for (u, k), v in out.items())


@pytest.mark.parametrize("per_chunk", [1, 7, 50, 10_000])
def test_pairs_equal_a_queue(spark, per_chunk):
    r = random.Random(per_chunk)
    rows = [(r.choice(["a", "a", "a", "b", "c"]), i, float(r.choice([r.randrange(60), r.randrange(2000)])), r.random() < 0.5) for i in range(600)]
    rows += [("late", 900, 5.0, False), ("late", 901, 6.0, True), ("none", 902, 1.0, False), ("one", 903, 2.0, True), ("one", 904, 2.0, False)]
    log = spark.createDataFrame(rows, "url string, id long, t double, asks boolean")
    got = sorted(map(tuple, N.pair_requests(log.where("asks"), log.where("not asks"), "url", "t", per_chunk).collect()), key=lambda r: r[:2])
    assert got == queue(rows)
    assert all(d is None or d >= 0 for *_, d in got)


def fold(events, fails, wait, probes):
    """The breaker, one event after another."""
    state, bad, tried, since, opened = "closed", 0, 0, 0.0, 0
    for t, ok in events:
        if state == "open" and t - since >= wait:
            state, tried = "half-open", 0
        if ok:
            if state == "half-open":
                tried += 1
                if tried >= probes:
                    state, bad = "closed", 0
            else:
                bad = 0
        elif state == "half-open":
            state, bad, since, opened = "open", fails, t, opened + 1
        else:
            bad += 1
            if bad >= fails:
                opened += state != "open"
                state, since = "open", t
    return state, bad, opened


def compose(chunks, fails, wait, probes):
    state, place, since, bad, opened = "closed", 0, None, 0, 0
    for chunk in chunks:
        rows = [r for r in breaker_table([t for t, _ in chunk], [ok for _, ok in chunk], fails, wait, probes) if r[:2] == (state, place)]
        rows = [r for r in rows if (r[2] is None or not r[2] - since >= wait) and (r[3] is None or r[3] - since >= wait)]
        assert len(rows) == 1
        _, _, _, _, state, place, at, rel, n, more = rows[0]
        since = (since if at is None else at) if state == "open" else None
        bad, opened = bad + n if rel else n, opened + more
    return state, bad, opened


def test_tables_compose_to_the_fold():
    for seed in range(400):
        r = random.Random(seed)
        fails, probes, wait, bias = r.choice([1, 2, 5]), r.choice([1, 3]), r.choice([3.0, 10.0, 60.0]), r.choice([0.2, 0.5, 0.8])
        t, events = 0.0, []
        for _ in range(r.randrange(1, 120)):
            t += r.choice([0.0, 0.5, 1.0, r.random() * wait * 1.5])
            events.append((t, r.random() < bias))
        chunks, at = [], 0
        while at < len(events):
            step = r.randrange(1, 20)
            chunks.append(events[at : at + step])
            at += step
        assert compose(chunks, fails, wait, probes) == fold(events, fails, wait, probes), seed


def test_states_meet():
    """A table's size follows the instants of a wait, not the chunk."""
    r = random.Random(1)
    times = [i * 1.0 for i in range(50_000)]
    assert len(breaker_table(times, [r.random() < 0.5 for _ in times], 5, 60.0, 3)) < 600


@pytest.mark.parametrize("per_chunk", [3, 40])
def test_breakers_equal_the_fold(spark, per_chunk):
    r = random.Random(per_chunk)
    rows = [(r.choice("aaab") if i % 50 else f"k{i}", float(int(r.random() * 4000)), i, r.random() < 0.4) for i in range(800)]
    e = spark.createDataFrame(rows, "key string, t double, id long, ok boolean").withColumn("at", F.col("t"))
    got = {x.key: (x.state, x.failures, x.opened) for x in K.breakers(e, "key", ["t", "id"], "at", "ok", per_chunk=per_chunk).collect()}
    keys = {x[0] for x in rows}
    assert got == {k: fold([(t, ok) for key, t, i, ok in sorted(rows, key=lambda x: x[1:3]) if key == k], 5, 60.0, 3) for k in keys}


def test_one_key_of_a_million_events(spark):
    e = spark.range(1_000_000).select(F.lit("k").alias("key"), (F.col("id") * 0.7).alias("t"), "id", (F.xxhash64("id") % 3 != 0).alias("ok")).withColumn("at", F.col("t"))
    got = K.breakers(e, "key", ["t", "id"], "at", "ok").first()
    rows = e.select("t", "ok").orderBy("id").toPandas()
    assert (got.state, got.failures, got.opened) == fold(zip(rows.t.tolist(), rows.ok.tolist(), strict=True), 5, 60.0, 3)
