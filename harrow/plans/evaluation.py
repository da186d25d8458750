"""Scores of evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.plans.registry import query
from harrow.session import table

# Weights of the composite score and of difficulties.
COMPOSITE = {"fixtures": 0.30, "live": 0.25, "workflows": 0.15, "perf": 0.10, "tests": 0.10, "docs": 0.10}
DIFFICULTY = {"easy": 0.5, "medium": 1.0, "hard": 2.0, "nightmare": 3.0}


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", *[((F.col("p_size") + k) % 11 / 10.0).alias(n) for k, n in enumerate(COMPOSITE)], (F.col("p_partkey") % 9 != 0).alias("gate"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 0.0 ELSE " + " + ".join(f"(p_size + {k}) % 11 / 10.0 * {w}" for k, w in enumerate(COMPOSITE.values())) + " END AS score FROM part")
def e01_composite(spark: SparkSession, d: str) -> DataFrame:
    total = sum(F.col(n) * w for n, w in COMPOSITE.items())
    return parts(spark, d).select("p_partkey", F.when(F.col("gate"), total).otherwise(0.0).alias("score"))


@query("SELECT event_type AS suite, avg(CAST(event_id % 5 <> 0 AS INT)) AS ratio FROM events GROUP BY event_type")
def e02_pass_ratio(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("suite")).agg(F.avg((F.col("event_id") % 5 != 0).cast("int")).alias("ratio"))


@query("""WITH r AS (SELECT user_id, event_id, [0.5, 1.0, 2.0, 3.0][event_id % 4 + 1] AS w, CASE WHEN event_id % 5 = 0 THEN 0.0 WHEN event_id % 5 = 1 THEN 0.5 ELSE 1.0 END AS now, CASE WHEN event_id % 3 = 0 THEN (event_id % 10) / 10.0 END AS h FROM events WHERE event_id % 7 <> 0)
SELECT user_id, sum(CASE WHEN h IS NULL THEN now ELSE 0.3 * now + 0.7 * h END * w) / sum(w) AS score FROM r GROUP BY user_id""")
def e03_live_score(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    w = F.element_at(F.array(*[F.lit(x) for x in DIFFICULTY.values()]), (k % 4 + 1).cast("int"))
    e = table(spark, d, "events").where("event_id % 7 <> 0")
    history = e.where("event_id % 3 = 0").select("event_id", ((k % 10) / 10.0).alias("h"))
    now = F.when(k % 5 == 0, 0.0).when(k % 5 == 1, 0.5).otherwise(1.0)
    r = e.select("user_id", "event_id", w.alias("w"), now.alias("now")).join(history, "event_id", "left")
    s = F.when(F.col("h").isNull(), F.col("now")).otherwise(0.3 * F.col("now") + 0.7 * F.col("h"))
    return r.groupBy("user_id").agg((F.sum(s * F.col("w")) / F.sum("w")).alias("score"))


@query("SELECT p_partkey, least(100.0 / (p_size + 50), 1.0) AS ratio FROM part")
def e04_capped_ratio(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.least(F.lit(100.0) / (F.col("p_size") + 50), F.lit(1.0)).alias("ratio"))


def hash31(text):
    """The 32-bit hash h = 31 h + code over the characters, with wrap-around."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    wrap = lambda x: F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    return F.aggregate(codes, F.lit(0).cast("long"), lambda acc, c: wrap(acc * 31 + c))


@query("""SELECT n_name AS id, list_reduce(list_concat([0::BIGINT], list_transform(string_split(n_name || '7', ''), lambda c: ascii(c)::BIGINT)), lambda acc, c: ((acc * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS hash
FROM nation ORDER BY hash, id LIMIT 10""")
def e05_subset(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_name").alias("id"), hash31(F.concat("n_name", F.lit("7"))).alias("hash")).orderBy("hash", "id").limit(10)


@query("SELECT lang, avg(CAST(contains(lower(text), 'the') OR contains(lower(text), 'der') AS INT)) AS coverage FROM documents GROUP BY lang")
def e06_coverage(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower("text")
    return table(spark, d, "documents").groupBy("lang").agg(F.avg((t.contains("the") | t.contains("der")).cast("int")).alias("coverage"))
