"""Data sources, table functions, state commits, sketches and keyed state, beyond their queries."""

import json
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from harrow.functions import tables as T
from harrow.operators import commits as V
from harrow.operators import graph as G
from harrow.sources import logs as Q
from harrow.streaming import streams as S


def test_logs_in_batch(spark, tmp_path):
    Q.register(spark)
    (tmp_path / "a.jsonl").write_text('{"url": "u", "method": "GET", "status": 200, "ts": 1}\nno json\n\n{"url": "v", "method": "PUT", "status": "x", "ts": 2.5}')
    (tmp_path / "b.jsonl").write_text('{"url": "w", "method": "GET", "status": 404, "ts": 3}\n[1]\n')
    (tmp_path / "c.other").write_text("{}")
    (tmp_path / "_hidden.jsonl").write_text('{"url": "h"}')
    df = spark.read.format("request_log").load(str(tmp_path))
    rows = sorted((r.file.rsplit("/", 1)[-1], r.line, r.url, r.method, r.status, r.ts) for r in df.collect())
    assert rows == [("a.jsonl", 0, "u", "GET", 200, 1.0), ("a.jsonl", 1, None, None, None, None), ("a.jsonl", 3, "v", "PUT", None, 2.5), ("b.jsonl", 0, "w", "GET", 404, 3.0), ("b.jsonl", 1, None, None, None, None)]
    got = df.where("method = 'GET' and status > 300")
    assert [r.url for r in got.collect()] == ["w"] and [r.url for r in df.where(F.col("method").isin("PUT", "DELETE")).collect()] == ["v"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "method" not in plan.split("Filter")[1].split("\n")[0].replace("method#", "") or "PushedFilters" in plan or "EqualTo" in plan


def test_a_stream_reads_each_file_once_across_restarts(spark, tmp_path):
    Q.register(spark)
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def run():
        q = spark.readStream.format("url_list").load(str(folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()

    (folder / "a.txt").write_text("https://a/\n# no\n\n https://b/ ")
    run()
    (folder / "b.txt").write_text("https://c/\n")
    run()
    run()
    got = sorted(r.url for r in spark.read.schema("url string, file string, line long").parquet(out).collect())
    assert got == ["https://a/", "https://b/", "https://c/"] == sorted(r.url for r in spark.read.format("url_list").load(str(folder)).collect())


def test_tables_from_sql_and_lateral_joins(spark):
    T.register(spark)
    rows = [(1, 1, "a  b"), (1, 2, "c  d"), (1, 3, "x"), (1, 4, "e\tf\tg"), (1, 5, None), (1, 6, "h  i"), (2, 1, "a  b"), (2, 2, "c  d  e"), (2, 3, "f  g  h"), (2, 4, "i  j  k")]
    spark.createDataFrame(rows, "page long, line long, text string").createOrReplaceTempView("the_lines")
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM text_tables(TABLE(the_lines) PARTITION BY page ORDER BY line)").collect())
    assert got == [(1, 1, 1, ["a", "b"]), (1, 1, 2, ["c", "d"]), (2, 2, 2, ["c", "d", "e"]), (2, 2, 3, ["f", "g", "h"]), (2, 2, 4, ["i", "j", "k"])]
    n = spark.sql("SELECT t.page, count(*) AS n FROM text_tables(TABLE(the_lines) PARTITION BY page ORDER BY line) t GROUP BY t.page").collect()
    assert {r.page: r.n for r in n} == {1: 2, 2: 3}


def test_two_writers_lose_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/state"
    V.commit(spark.createDataFrame([("start", 0)], "who string, n int"), root, 0)
    failed = []

    def write(who):
        try:
            for n in range(3):
                V.update(spark, root, lambda old, n=n: old.unionByName(spark.createDataFrame([(who, n)], "who string, n int")).coalesce(1), tries=50)
        except Exception as e:
            failed.append(e)

    writers = [threading.Thread(target=write, args=(w,)) for w in "ab"]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not failed and sorted((r.who, r.n) for r in V.read(spark, root).collect()) == [*(("a", n) for n in range(3)), *(("b", n) for n in range(3)), ("start", 0)]
    assert V.versions(spark, root) == list(range(1, 8))
    with pytest.raises(V.Conflict):
        V.commit(spark.createDataFrame([("late", 1)], "who string, n int"), root, 3)
    assert V.read(spark, root).where("who = 'late'").count() == 0
    with V.pinned(spark, root, 2) as old:
        assert V.retain(spark, root, 2) == [1, 3, 4, 5] and old.count() == 2
    assert V.retain(spark, root, 2) == [2] and V.read(spark, root, 6).count() == 6
    with pytest.raises(FileNotFoundError):
        V.read(spark, root, 2)


def test_state_with_odd_names(spark, tmp_path):
    root = f"file://{tmp_path}/state"
    V.commit(spark.createDataFrame([(1, [("x", 2)])], "`a b` int, c array<struct<d: string, e: int>>"), root, 0)
    assert V.read(spark, root).first()["a b"] == 1 and V.read(spark, root).first().c[0].d == "x"


def test_sketches_are_within_their_error(spark):
    rows = spark.range(400_000).select((F.col("id") % 7).alias("day"), (F.xxhash64("id") % 150_000).alias("user"))
    found = {r.day: (r.n, r.distinct) for r in G.rollup_sketches(G.sketches(rows, ["day"], "user"), ["day"]).collect()}
    exact = {r.day: r.d for r in rows.groupBy("day").agg(F.count_distinct("user").alias("d")).collect()}
    exact[None] = rows.select("user").distinct().count()
    for day, d in exact.items():
        assert abs(found[day][1] - d) <= 0.03 * d, (day, found[day], d)
    assert found[None][0] == 400_000


def test_state_is_carried_from_batch_to_batch(spark, tmp_path):
    """A store's and a capture's state outlive the query: what a second run gives goes on after the first."""
    folder, kind = tmp_path / "in", "user_id long, event_id long, t double, stored boolean, direction string"
    folder.mkdir()

    def run(rows, name, made):
        (folder / f"{uuid.uuid4().hex}.json").write_text("\n".join(json.dumps(dict(zip(("user_id", "event_id", "t", "stored", "direction"), r, strict=True))) for r in rows))
        out = str(tmp_path / name)
        stream = made(spark.readStream.schema(kind).json(str(folder)))
        with S.without_idle_batches(spark):
            q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(tuple(r)[1:] for r in spark.read.schema(stream.schema).parquet(out).collect())

    first = [(1, 1, 1.0, True, "sent"), (1, 2, 5.0, False, "received")]
    assert run(first, "store", lambda s: S.stored(s, 100.0)) == [(1, False), (2, True)]
    assert run([(1, 3, 90.0, False, "sent"), (1, 4, 200.0, False, "sent")], "store", lambda s: S.stored(s, 100.0)) == [(1, False), (2, True), (3, True), (4, False)]
    assert run([(1, 5, 300.0, False, "received")], "cap", lambda s: S.capped(s, 4)) == [(1, 1, 0), (2, 1, 1), (3, 2, 1), (4, 3, 1)]
    assert run([(1, 6, 400.0, False, "received")], "cap", lambda s: S.capped(s, 4)) == [(1, 1, 0), (2, 1, 1), (3, 2, 1), (4, 3, 1)]
