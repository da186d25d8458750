"""Filter interaction audit: the orders of a set of filters as a trie, walked depth first over persisted survivors.

Every order of the filters is a path from the root; the documents that survive a prefix do not depend on its order, so
prefixes of the same filters are one state (for n filters 2**n states in place of n! paths). A state's survivors are
those of the state above it without the ones that fail one filter more; they are persisted while the walk is below the
state, so at most n + 1 are held at once. At each state one aggregation over its survivors counts, for every filter not
yet applied, what that edge actually removes. The counts of all states are rows in the shared folder; orders are joined
to them at the end.

The documents are read once: their flags (a few bytes each) are written, and the walk reads nothing else. Duplicates are
found by the SHA-256 of the text: the least id of each text is joined back on (text, id), so a text that a third of all
rows share is spread by id.

Defined results: null texts are empty (and equal to empty ones); a null id is a document that no smaller id precedes and
that has no labels; repeated rows count each, and rows of one id and text are no duplicates of each other; a null part is
the empty string; a document with several labels has each that any of its labels gives; an empty table gives an empty
result; very long texts are read whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Mapping

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.session import passing, shared_dir, written

WORD = r"[^\x20\x09-\x0D]+"


def quality_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of a text (not null): few words, repeated words, capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def with_duplicates(docs: DataFrame, name: str = "E") -> DataFrame:
    """(__id, __sha, ...) with a flag: another row of a smaller id has the same text."""
    first = docs.where("__id is not null").groupBy("__sha").agg(F.min("__id").alias("__id")).select("__sha", "__id", F.lit(True).alias("__first"))
    return docs.join(first, ["__sha", "__id"], "left").withColumn(name, F.col("__id").isNotNull() & F.col("__first").isNull()).drop("__first")


def flagged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) of every document."""
    given = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    rules = quality_filters(F.col("__text"))
    own = given.select("__id", F.unhex(F.sha2("__text", 256)).alias("__sha"), "part", *(F.coalesce(c, F.lit(False)).alias(k) for k, c in rules.items()))
    own = with_duplicates(own).drop("__sha")
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    none = F.lit(False)
    return own.join(known, "__id", "left").select("part", *rules, "E", F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))


def walk(flags: DataFrame, names: tuple[str, ...], at: str) -> None:
    """Write the counts of every edge of every state to folders of ``at``: (state, filter, part, kept, removed, ...)."""
    seen: set[frozenset[str]] = set()

    def count(survivors: DataFrame, state: frozenset[str]) -> None:
        rest = [x for x in names if x not in state]
        edges = [
            F.struct(
                F.lit(sum(1 << names.index(y) for y in state)).alias("state"), F.lit(x).alias("filter"), F.count_if(~F.col(x)).alias("kept"), F.count_if(F.col(x)).alias("removed"),
                F.count_if(F.col(x) & ~F.greatest(F.lit(False), F.lit(False), *(F.col(y) for y in names if y != x))).alias("unique_fails"),
                F.count_if(F.col(x) & F.col("good")).alias("good_lost"), F.count_if(F.col(x) & F.col("toxic")).alias("toxic_lost"),
            )
            for x in rest
        ]
        found = survivors.groupBy("part").agg(F.array(*edges).alias("edges"))
        found.select("part", F.inline("edges")).write.mode("append").parquet(at)

    def visit(survivors: DataFrame, state: frozenset[str]) -> None:
        seen.add(state)
        if len(state) == len(names):
            return
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        count(survivors, state)
        for x in names:
            if x not in state and state | {x} not in seen:
                visit(survivors.where(~F.col(x)), state | {x})
        survivors.unpersist()

    visit(flags, frozenset())


def audit(flags: DataFrame, names: tuple[str, ...], part_col: str = "part") -> DataFrame:
    """(part, filter_order, step, counts) of all orders of ``names``, which are boolean columns beside ``good`` and ``toxic``.

    ``flags`` is a table of the shared folder; it is read again for each state whose survivors were lost with an executor.
    """
    spark = flags.sparkSession
    at = passing(spark, f"{shared_dir(spark)}/audit-{uuid.uuid4().hex}")
    walk(flags, names, at)
    edges = spark.read.parquet(at)
    plan: list[Mapping] = []
    for order in itertools.permutations(names):
        for step, x in enumerate(order, 1):
            plan.append({"filter_order": "".join(order), "step": step, "filter": x, "state": sum(1 << names.index(y) for y in order[: step - 1])})
    steps = F.broadcast(spark.createDataFrame([tuple(p.values()) for p in plan], "filter_order string, step int, filter string, state int"))
    # every part has the root's edges, which name its filters; a state that no document of the part survives has no rows
    root = edges.where("state = 0").select(part_col, "filter", F.col("removed").alias("__all"), F.col("unique_fails").alias("__unique"))
    own = edges.select("state", "filter", part_col, "kept", "removed", "good_lost", "toxic_lost")
    rows = root.join(steps, "filter").join(own, ["state", "filter", part_col], "left").na.fill(0, ["kept", "removed", "good_lost", "toxic_lost"])
    shares = rows.groupBy(part_col, "filter").agg(F.sum("removed").alias("shapley"))
    out = rows.join(shares, [part_col, "filter"])
    return out.select(part_col, "filter_order", "step", "kept", "removed", (F.col("__all") - F.col("removed")).alias("redundant"), F.col("__unique").alias("unique_fails"), "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five quality filters over whole documents."""
    flags = written(flagged(docs, labels), "flags")
    return audit(flags, ("A", "B", "C", "D", "E"))


#: For DuckDB.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
      regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > first, false)] AS bad, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
five AS (SELECT unnest(range(1, 6)) AS i),
orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM five a, five b, five c, five d, five e
  WHERE a.i <> b.i AND a.i <> c.i AND a.i <> d.i AND a.i <> e.i AND b.i <> c.i AND b.i <> d.i AND b.i <> e.i AND c.i <> d.i AND c.i <> e.i AND d.i <> e.i),
steps AS (SELECT array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, s.i AS step, o[s.i] AS x, list_sort(o[1:s.i - 1]) AS before FROM orders, five s),
classes AS (SELECT part, bad, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
counted AS (SELECT part, filter_order, step, x,
  sum(CASE WHEN alive AND NOT bad[x] THEN n ELSE 0 END) AS kept, sum(CASE WHEN alive AND bad[x] THEN n ELSE 0 END) AS removed, sum(CASE WHEN NOT alive AND bad[x] THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN bad[x] AND len(list_filter(bad, lambda y: y)) = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN alive AND bad[x] THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN alive AND bad[x] THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT *, len(list_filter(before, lambda y: bad[y])) = 0 AS alive FROM classes, steps) GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM counted
"""
