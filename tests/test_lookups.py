"""Caches, joins as of a time, joins of rules, the crawl's queue, against plain loops."""

import bisect
import random
import re
import time
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from harrow.operators import caches, lookups
from harrow.operators import graph as G


@pytest.mark.parametrize("per_chunk, capacity, ttl", [(10, 3, None), (25, 5, 40.0), (10_000, 4, 30.0), (7, 1, None)])
def test_lookups_equal_a_store(spark, per_chunk, capacity, ttl):
    r = random.Random(per_chunk)
    rows = [(i, r.choice("aaab"), f"k{min(r.randrange(12), r.randrange(12))}", float(r.randrange(400)), r.random() < 0.7) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, k string, t double, w boolean")
    for refreshes in (None, "w"):
        got = {x.id: x.hit for x in caches.lookups(df, "g", "k", ["t", "id"], "t", capacity, ttl, refreshes, per_chunk).collect()}
        want, stores = {}, {}
        for i, g, k, t, w in sorted(rows, key=lambda x: (x[3], x[0])):
            held = stores.setdefault(g, OrderedDict())
            want[i] = k in held and (ttl is None or t - held[k] <= ttl)
            if w or refreshes is None:
                held[k] = t
                held.move_to_end(k)
                while len(held) > capacity:
                    held.popitem(last=False)
        assert got == want
        now = sorted((x.g, x.k) for x in caches.contents(df.where("w") if refreshes else df, "g", "k", ["t", "id"], capacity).collect())
        assert now == sorted((g, k) for g, held in stores.items() for k in held)


@pytest.mark.parametrize("per_chunk", [5, 10_000])
def test_as_of(spark, per_chunk):
    r = random.Random(8)
    left = [(i, r.choice(["a", "a", "b", "c", None]), float(r.randrange(300))) for i in range(200)]
    right = [(i, r.choice(["a", "a", "b"]), float(r.randrange(300)), None if r.random() < 0.1 else f"v{i}") for i in range(150)]
    a, b = spark.createDataFrame(left, "id long, k string, t double"), spark.createDataFrame(right, "n long, k string, t double, v string")
    for tolerance in (None, 10.0, 0.0):
        got = {x.id: (x.n, x.v) for x in lookups.as_of(a, b, "k", "t", ["n", "v"], ["n"], tolerance, per_chunk).collect()}
        want = {}
        for i, k, t in left:
            own = [(t2, n, v) for n, k2, t2, v in right if k2 == k and t2 <= t and (tolerance is None or True)]
            best = max(own, default=None)
            want[i] = best[1:] if best and (tolerance is None or t - best[0] <= tolerance) else (None, None)
        assert got == want


def test_hosts_under_rules(spark):
    rules = ["*.Example.com", "example.com", "a.b.example.com", "*.b.example.com", "other.org", "*.x", None]
    hosts = ["example.com", "EXAMPLE.com", "a.example.com", "a.b.example.com", "c.b.example.com", "b.example.com", "notexample.com", "other.org", "www.other.org", "x", "y.x", None, ""]
    got = {x.h: (x.allowed, x.rule) for x in lookups.allowed_by(spark.createDataFrame([(h,) for h in hosts], "h string"), "h", spark.createDataFrame([(p,) for p in rules], "pattern string")).collect()}
    for h in hosts:
        low = (h or "").lower()
        fits = [p for p in (x.lower() for x in rules if x) if h and (p == low or (p.startswith("*.") and (low == p[2:] or low.endswith(p[1:]))))]
        assert got[h][0] == bool(fits) and (got[h][1] in fits or not fits)
    assert got["a.b.example.com"][1] == "a.b.example.com" and got["c.b.example.com"][1] == "*.b.example.com" and got["example.com"][1] == "example.com"


def test_a_hundred_thousand_rules_without_a_nested_loop(spark):
    rules = spark.range(100_000).select(F.concat(F.when(F.col("id") % 2 == 0, "*.").otherwise(""), F.lit("h"), F.col("id").cast("string"), F.lit(".example.com")).alias("pattern"))
    hosts = spark.range(2000).select(F.concat(F.lit("w.h"), F.col("id").cast("string"), F.lit(".example.com")).alias("h"), "id")
    out = lookups.allowed_by(hosts, "h", rules)
    assert out.where("allowed").count() == 1000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_paths_under_rules(spark):
    r = random.Random(9)
    rules = [(r.choice(["h", "g"]), "/" + "".join(r.choice(["a", "b", "/", "*", ".", "\\E"]) for _ in range(r.randrange(5))) + r.choice(["", "", "$"]), r.random() < 0.5) for _ in range(40)] + [("h", "", False), ("h", None, True)]
    paths = [(r.choice(["h", "g", "n"]), "/" + "".join(r.choice(["a", "b", "/", ".", "\\E"]) for _ in range(r.randrange(6)))) for _ in range(150)]
    df = spark.createDataFrame(sorted(set(paths)), "host string, path string")
    got = {(x.host, x.path): x.allowed for x in lookups.path_rules(df, "host", "path", spark.createDataFrame(rules, "host string, path string, allow boolean")).collect()}
    for (h, p), allowed in got.items():
        fits = [(len(q), allow) for host, q, allow in rules if host == h and q and re.match(re.escape(q.removesuffix("$")).replace(r"\*", ".*") + (r"\Z" if q.endswith("$") else ""), p, re.S)]
        assert allowed == (max(fits)[1] if fits else True), (h, p)
    assert len(got) == len(set(paths))


def queue(edges, start, max_pages, max_depth, batch, points):
    """The crawl by a sorted list: waves of (url, depth)."""
    visited, line, waves = set(), [(200, start, 0)], []
    while line and sum(map(len, waves)) < max_pages:
        wave = []
        while line and len(wave) < min(batch, max_pages - sum(map(len, waves))):
            s, url, depth = line.pop(0)
            if url not in visited:
                visited.add(url)
                wave.append((url, depth))
        if not wave:
            break
        for url, depth in wave:
            for pos, dst in edges.get(url, []) if depth < max_depth else []:
                if dst not in visited:
                    s = points[dst, depth + 1]
                    line.insert(bisect.bisect_left([-x[0] for x in line], -s), (s, dst, depth + 1))
        waves.append(wave)
    return waves


@pytest.mark.parametrize("batch, pages, depth", [(3, 30, 4), (7, 60, 2), (1, 12, 5)])
def test_waves_equal_a_queue(spark, batch, pages, depth):
    r = random.Random(batch)
    urls = ["https://x.example/" + "/".join(r.choice(["blog", "tag", "a", "b", "docs"]) for _ in range(r.randrange(1, 6))) + f"/{i}" for i in range(80)]
    edges = {u: list(enumerate(r.sample(urls, 4))) for u in urls}
    table = spark.createDataFrame([(u, v, "", pos) for u, own in edges.items() for pos, v in own] + [(urls[0], "https://other.example/", "", 9)], "src string, dst string, anchor string, pos int")
    scored = spark.createDataFrame([(u, d) for u in urls for d in range(1, depth + 1)], "u string, d int").select("u", "d", G.score(F.col("u"), F.col("d"), F.lit("")).alias("s")).collect()
    got = G.crawl(table, table, spark.createDataFrame([(urls[0],)], "url string"), pages, depth, batch, edge_parts=4).collect()
    want = queue(edges, urls[0], pages, depth, batch, {(x.u, x.d): x.s for x in scored})
    assert [[(x.url, x.depth) for x in sorted(got, key=lambda x: (x.wave, x.place)) if x.wave == k] for k in range(len(want))] == want
    assert len(got) == sum(map(len, want))


def test_a_wave_writes_its_own(spark, monkeypatch):
    """What a wave writes does not grow with the queue."""
    sizes, taken = [], G.Frontier.take

    def take(self, *a):
        before = self.written
        out = taken(self, *a)
        sizes.append((self.written - before, sum(n for _, n in self.parts.values())))
        return out

    monkeypatch.setattr(G.Frontier, "take", take)
    edges = spark.range(3000).select(F.concat(F.lit("https://x.example/n/"), F.col("id").cast("string")).alias("src"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("pos")).withColumn("anchor", F.lit(""))
    edges = edges.withColumn("dst", F.concat(F.lit("https://x.example/n/"), (F.substring_index("src", "/", -1).cast("long") * 20 + F.col("pos")).cast("string")))
    began = time.perf_counter()
    G.crawl(edges, edges, spark.createDataFrame([("https://x.example/n/0",)], "url string"), 50, 9, 5).count()
    assert time.perf_counter() - began < 120
    assert sizes[-1][1] > 500 and max(left for left, _ in sizes[3:]) <= 100
