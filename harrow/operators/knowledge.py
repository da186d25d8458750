"""Knowledge per domain folded from fetch outcomes, and the rules drawn from it.

Order matters in an average that decays, so such folds run over each domain's outcomes in order, as an expression over a
sorted array; what does not depend on order is a plain grouped aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.operators.scans import PER_CHUNK, busy_breakers

ALPHA = 0.3
NEVER, LONG_AGO = 2000, 30


def rounded(x: Column) -> Column:
    """Halves up, as whole doubles."""
    return F.floor(x + 0.5).cast("double")


def fold(outcomes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, success_count, fail_count, avg_response_time_ms, safe_rate_limit, antibot_system, captcha_type, needs_proxy, last_updated) of
    outcomes with success, response_ms, http_status, antibot_system, captcha_type, blocked, proxy_used and ``order`` columns.

    A proxy is needed where the first outcome succeeded through one, or an outcome was blocked without one after more
    failures than successes.
    """
    entry = F.struct(*order, "success", "response_ms", "http_status", "antibot_system", "captcha_type", "blocked", "proxy_used")
    rows = outcomes.groupBy(key).agg(
        F.array_sort(F.collect_list(entry)).alias("seq"), F.count_if("success").alias("success_count"), F.count_if(~F.col("success")).alias("fail_count"), F.max(order[0]).alias("last_updated")
    )
    start = F.struct(F.lit(-1.0).alias("avg"), F.lit(60).cast("int").alias("rate"), F.lit(True).alias("first"), F.lit(None).cast("string").alias("antibot"), F.lit(None).cast("string").alias("captcha"), F.lit(False).alias("proxy"), F.lit(0).alias("lead"))

    def step(acc: Column, x: Column) -> Column:
        mixed = rounded(acc["avg"] * (1 - ALPHA) + x["response_ms"] * ALPHA)
        avg = F.when(acc["first"], x["response_ms"]).when(acc["avg"] == 0, rounded(x["response_ms"])).otherwise(mixed)
        slower = F.greatest(F.lit(10), F.floor(acc["rate"] * 0.7).cast("int"))
        rate = F.when(x["http_status"] != 429, acc["rate"]).when(acc["first"], F.lit(30)).otherwise(slower)
        proxy = F.when(acc["first"], x["proxy_used"] & x["success"]).otherwise(acc["proxy"] | (x["blocked"] & ~x["proxy_used"] & (acc["lead"] < 0)))
        lead = (acc["lead"] + F.when(x["success"], 1).otherwise(-1)).cast("int")  # successes beyond failures
        return F.struct(avg.alias("avg"), rate.cast("int").alias("rate"), F.lit(False).alias("first"), F.coalesce(x["antibot_system"], acc["antibot"]).alias("antibot"), F.coalesce(x["captcha_type"], acc["captcha"]).alias("captcha"), F.coalesce(proxy, F.lit(False)).alias("proxy"), lead.alias("lead"))

    done = rows.select(key, "success_count", "fail_count", "last_updated", F.aggregate("seq", start, step).alias("s"))
    return done.select(
        key, "success_count", "fail_count", F.col("s.avg").alias("avg_response_time_ms"), F.col("s.rate").alias("safe_rate_limit"),
        F.col("s.antibot").alias("antibot_system"), F.col("s.captcha").alias("captcha_type"), F.col("s.proxy").alias("needs_proxy"), "last_updated",
    )


def level_stats(outcomes: DataFrame, key: str) -> DataFrame:
    """(key, level, success, fail)."""
    return outcomes.groupBy(key, "level").agg(F.count_if("success").alias("success"), F.count_if(~F.col("success")).alias("fail"))


def best_level(stats: DataFrame, key: str) -> DataFrame:
    """(key, level, rate): the level of the greatest success rate, the lower one of equals."""
    rate = F.col("success") / (F.col("success") + F.col("fail"))
    return stats.groupBy(key).agg(F.max_by(F.struct("level", rate.alias("rate")), F.struct(rate, -F.col("level"))).alias("b")).select(key, "b.level", "b.rate")


def decay(last_updated: Column, now: Column) -> Column:
    return F.when(now.cast("timestamp").cast("double") - last_updated.cast("timestamp").cast("double") > 7 * 86400, 0.5).otherwise(1.0)


def predict(known: DataFrame, now: Column) -> DataFrame:
    """``known`` (success_count, fail_count, last_updated, level, rate, needs_proxy, antibot_system, avg_response_time_ms) with a prediction."""
    w = decay(F.col("last_updated"), now)
    good, bad = F.col("success_count") * w, F.col("fail_count") * w
    total = good + bad
    rate = good / total
    confidence = F.when((good >= 3) & (rate >= 0.8), F.least(0.5 + rate * 0.5, F.lit(1.0))).when(total >= 3, 0.3 + rate * 0.3).otherwise(0.1 + total / 3 * 0.2)
    reason = F.concat_ws(", ", "antibot_system", F.concat(F.lit("L"), F.col("level").cast("string")), F.concat(F.floor(rate * 100 + 0.5).cast("string"), F.lit("% success")))
    enough = total >= 1
    return (
        known.withColumn("start_level", F.when(enough, F.col("level")).otherwise(1))
        .withColumn("confidence", F.when(enough, F.floor(confidence * 100 + 0.5) / 100).otherwise(0.0))
        .withColumn("proxy", F.when(enough, F.col("needs_proxy") | (bad > good)).otherwise(False))
        .withColumn("expected_ms", F.when(enough, F.col("avg_response_time_ms")).otherwise(0.0))
        .withColumn("reason", F.when(enough, reason).otherwise("no data"))
    )


def with_parent(asked: DataFrame, known: DataFrame, parent: Column) -> DataFrame:
    """``asked`` (domain) with a prediction (domain, start_level, confidence): its own, else its parent's at half the confidence."""
    k = known.select(F.col("domain").alias("d"), "start_level", "confidence")
    own = asked.withColumn("parent", parent).join(k, F.col("domain") == F.col("d"), "left").drop("d")
    up = k.select(F.col("d").alias("pd"), F.col("start_level").alias("p_level"), (F.floor(F.col("confidence") * 50 + 0.5) / 100).alias("p_confidence"))
    joined = own.join(up, F.col("parent") == F.col("pd"), "left")
    return joined.select("domain", F.coalesce("start_level", "p_level").alias("start_level"), F.coalesce("confidence", "p_confidence").alias("confidence"), (F.col("confidence").isNull() & F.col("p_confidence").isNotNull()).alias("inherited"))


def prune(known: DataFrame, key: str, now: Column, most: int = NEVER, days: int = LONG_AGO) -> DataFrame:
    """Only beyond ``most`` rows: older than ``days`` go, then the oldest beyond ``most``.

    The newest ``most`` are found by a bounded top-k, so no single task sorts all rows.
    """
    total = known.count()
    if total <= most:
        return known
    fresh = known.where(now.cast("timestamp").cast("double") - F.col("last_updated").cast("timestamp").cast("double") <= days * 86400)
    return fresh.orderBy(F.col("last_updated").desc(), key).limit(most)


def breakers(events: DataFrame, key: str, order: list[str], at: str, ok: str, fails: int = 5, wait: float = 60.0, probes: int = 3, per_chunk: int = PER_CHUNK) -> DataFrame:
    """As ``circuit``, with the events of keys that have more than ``per_chunk`` of them in chunks of many tasks."""
    n = events.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > per_chunk).select(key)
    rest = circuit(events.join(n, key, "left_anti"), key, order, at, ok, fails, wait, probes)
    return rest.unionByName(busy_breakers(events.join(n, key, "left_semi"), key, order, at, ok, fails, wait, probes, per_chunk))


def circuit(events: DataFrame, key: str, order: list[str], at: str, ok: str, fails: int = 5, wait: float = 60.0, probes: int = 3) -> DataFrame:
    """(key, state, failures, opened) of each key's breaker after its events, as a fold in order. ``at``: seconds.

    A failed probe opens it again with the failures at the limit; failures while it is open push its opening on, a
    success while it is open clears them. ``opened`` counts how often it went open.
    """
    seq = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(at).alias("__at"), F.col(ok).alias("__ok")))).alias("seq"))
    start = F.struct(F.lit("closed").alias("state"), F.lit(0).alias("bad"), F.lit(0).alias("probes"), F.lit(0.0).alias("since"), F.lit(0).alias("opened"))

    def step(acc: Column, x: Column) -> Column:
        state = F.when((acc["state"] == "open") & (x["__at"] - acc["since"] >= wait), "half-open").otherwise(acc["state"])
        tried = F.when((acc["state"] == "open") & (state == "half-open"), 0).otherwise(acc["probes"])
        trips = ~x["__ok"] & ((state == "half-open") | (acc["bad"] + 1 >= fails))
        heals = x["__ok"] & (state == "half-open") & (tried + 1 >= probes)
        return F.struct(
            F.when(trips, "open").when(heals, "closed").otherwise(state).alias("state"),
            F.when(x["__ok"], F.when((state != "half-open") | heals, 0).otherwise(acc["bad"])).when(state == "half-open", fails).otherwise(acc["bad"] + 1).cast("int").alias("bad"),
            F.when(x["__ok"] & (state == "half-open"), tried + 1).otherwise(F.when(trips, 0).otherwise(tried)).cast("int").alias("probes"),
            F.when(trips, x["__at"]).otherwise(acc["since"]).alias("since"),
            (acc["opened"] + F.when(trips & (state != "open"), 1).otherwise(0)).cast("int").alias("opened"),
        )

    return seq.select(key, F.aggregate("seq", start, step).alias("s")).select(key, "s.state", F.col("s.bad").alias("failures"), "s.opened")


def adaptive_timeout(avg: Column, default: float = 30_000.0) -> Column:
    return F.when(avg > 0, F.least(F.greatest(avg * 3, F.lit(30_000.0)), F.lit(300_000.0))).otherwise(default)


def throttle(requests: DataFrame, key: str, order: list[str], at: str, rate: Column) -> DataFrame:
    """Every request with its delay (60 s over the rate) and how long it would still have to wait after the one before."""
    delay = F.floor(F.lit(60000.0) / rate + 0.5)
    gap = (F.col(at) - F.lag(at).over(Window.partitionBy(key).orderBy(*order))) * 1000
    return requests.withColumn("delay_ms", delay).withColumn("wait_ms", F.greatest(F.lit(0.0), F.coalesce(delay - gap, F.lit(0.0))))


def backoff_bounds(attempt: Column, status: Column, base: float = 1000.0, cap: float = 30_000.0) -> tuple[Column, Column]:
    """Least and greatest delay: full jitter up to a doubling cap; 5 to 15 s more after a 429."""
    top = F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt))
    more = lambda n: F.when(status == 429, n).otherwise(0.0)
    return more(5000.0), top + more(15000.0)


def retry_level(attempt: Column, antibot: Column, base: Column) -> Column:
    """The caller's level (1 where there is none), one more at the second attempt, then 3; 3 at once against a known system."""
    own = F.when(base > 0, base).otherwise(1)
    return F.when(antibot.isNotNull() | (attempt >= 2), 3).when(attempt == 1, F.least(own + 1, F.lit(3))).otherwise(own)
