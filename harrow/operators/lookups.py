"""Joins that are not on equal keys, as joins that are: as of a time, by host suffix, by path prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.operators.scans import PER_CHUNK, chunked


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str], ties: list[str], tolerance: float | None = None, per_chunk: int = PER_CHUNK) -> DataFrame:
    """``left`` with ``values`` of the latest row of ``right`` of its key at or before it, null where there is none or it is more than ``tolerance`` older.

    ``at``: a number of seconds on both sides. Of right rows at one instant the last by ``ties`` counts. Both sides are one
    sequence for each key; within a chunk of it the last right row is carried on by a window, between chunks by another.
    """
    row = F.struct(*[F.col(c).alias(f"_{k}") for k, c in enumerate(left.columns)])
    known = F.struct(F.col(at).alias("at"), F.struct(*values).alias("v"))
    none = lambda df, c: F.lit(None).cast(df.select(c).schema[0].dataType)
    a = left.select(F.col(key).alias("k"), F.col(at).cast("double").alias("t"), row.alias("row"), none(right, known).alias("known"), none(right, F.struct(*ties)).alias("tie"))
    b = right.where(F.col(at).isNotNull()).select(F.col(key).alias("k"), F.col(at).cast("double").alias("t"), none(left, row).alias("row"), known.alias("known"), F.struct(*ties).alias("tie"))
    both = chunked(a.unionByName(b), "k", "t", per_chunk)
    order = ["t", F.col("row").isNotNull(), "tie"]
    inside = Window.partitionBy("k", "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("own", F.last("known", ignorenulls=True).over(inside))
    lasts = both.where("known is not null").groupBy("k", "__chunk").agg(F.max_by("known", F.struct("t", "tie")).alias("last"))
    chunks = both.select("k", "__chunk").distinct().join(lasts, ["k", "__chunk"], "left")
    before = Window.partitionBy("k").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.withColumn("carried", F.last("last", ignorenulls=True).over(before)).where("carried is not null").select("k", "__chunk", "carried")
    out = both.where("row is not null").join(carried, ["k", "__chunk"], "left").withColumn("found", F.coalesce("own", "carried"))
    near = F.lit(True) if tolerance is None else F.col("t") - F.col("found.at") <= tolerance
    return out.select(*[F.col("row")[f"_{k}"].alias(c) for k, c in enumerate(left.columns)], *[F.when(near, F.col("found.v")[v]).alias(v) for v in values])


def host_suffixes(host: Column) -> Column:
    """``host`` and every parent of it, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def allowed_by(rows: DataFrame, host: str, rules: DataFrame, pattern: str = "pattern") -> DataFrame:
    """``rows`` with ``allowed`` and ``rule``: the pattern that names the host, or the longest ``*.`` pattern that it lies under (or is the suffix of); any case."""
    r = rules.select(F.lower(pattern).alias("__p")).where("__p is not null").distinct()
    r = r.select("__p", F.col("__p").startswith("*.").alias("__wild"), F.when(F.col("__p").startswith("*."), F.substring("__p", 3, 1 << 20)).otherwise(F.col("__p")).alias("__suffix"))
    hosts = rows.select(F.lower(host).alias("__host")).where("__host is not null").distinct()
    each = hosts.select("__host", F.explode(host_suffixes(F.col("__host"))).alias("__suffix"))
    hit = each.join(r, "__suffix").where(F.col("__wild") | (F.col("__host") == F.col("__suffix")))
    best = hit.groupBy("__host").agg(F.max_by("__p", F.struct(~F.col("__wild"), F.length("__suffix"))).alias("rule"))
    out = rows.withColumn("__host", F.lower(host)).join(best, "__host", "left").drop("__host")
    return out.withColumn("allowed", F.col("rule").isNotNull())


def path_rules(rows: DataFrame, host: str, path: str, rules: DataFrame) -> DataFrame:
    """``rows`` with ``allowed`` and ``rule`` by rules (host, path, allow): the longest path that is a prefix decides, an allowing one among equals; without one a path is allowed.

    Paths are joined on host and prefix, for the lengths of rules that occur on the host. Paths with stars or a ``$`` at the
    end are patterns: the text before their first star is the prefix to join on, and the whole is held against the path.
    """
    body = F.regexp_replace(F.regexp_replace(F.col("path"), r"\$$", ""), r"\*+", "*")
    quoted = F.array_join(F.transform(F.split(body, r"\*"), lambda x: F.concat(F.lit(r"\Q"), F.replace(x, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))), ".*")
    r = rules.where("path is not null and path <> ''").select(
        F.col("host").alias("__host"), F.col("path").alias("rule"), "allow", F.substring_index(body, "*", 1).alias("__prefix"), (F.col("path").contains("*") | F.col("path").endswith("$")).alias("__odd"),
        F.concat(F.lit("(?s)^"), quoted, F.when(F.col("path").endswith("$"), F.lit(r"\z")).otherwise(F.lit(""))).alias("__pattern"),
    )
    lengths = r.select("__host", F.length("__prefix").alias("__n")).distinct()
    asked = rows.select(F.col(host).alias("__host"), F.col(path).alias("__path")).distinct()
    each = asked.join(lengths, "__host").where(F.length("__path") >= F.col("__n")).withColumn("__prefix", F.expr("left(__path, __n)"))
    hit = each.join(r, ["__host", "__prefix"]).where(~F.col("__odd") | F.expr("rlike(__path, __pattern)"))
    best = hit.groupBy("__host", "__path").agg(F.max_by(F.struct("allow", "rule"), F.struct(F.length("rule"), "allow")).alias("b"))
    out = rows.join(best, (rows[host] == best["__host"]) & (rows[path] == best["__path"]), "left")
    return out.select(*rows.columns, F.coalesce("b.allow", F.lit(True)).alias("allowed"), F.col("b.rule").alias("rule"))
