"""Chat formatting: cumulative snapshots collapse, maximal conversations are rendered. DataFrame functions only.

A log often holds every state of a growing conversation. Each turn gets a 128-bit hash of its role and text,
tagged with its place; the running exclusive-or over a conversation's turns identifies each of its prefixes.
A conversation whose whole hash is a proper prefix of another's is dropped by an anti-join; of equal conversations
the one with the smallest id stays. What stays is rendered turn by turn.

A conversation is handled in segments of ``segment`` turn numbers: places and hashes are found within segments and
carried over from a table of segments, and rendering gives one row per segment, so no task has to hold (or order) a
whole conversation, however long. A conversation of up to ``segment`` turns, numbered from 0, is one row. Turns without
a number are dealt into 65,536 segments of their own by the first 16 bits of their hash.

Defined results: null roles and texts count as empty; rows without a conversation id form one conversation whose id is
null; rows without a turn number come first, ordered by hash; rows repeated in all columns count once; rows that share
a turn number are ordered by hash; an empty table gives an empty result; other columns are ignored. Turn markers within texts
are broken up by a space, so that no text can end its own turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 256
START, END = "<|im_start|>", "<|im_end|>"


def _hashes(role: Column, text: Column) -> list[Column]:
    return [F.xxhash64(role, text).alias("__h1"), F.xxhash64(F.lit("second"), text, F.length(text), role).alias("__h2")]


def turns(log: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, segment: int) -> DataFrame:
    """Distinct turns: key, id, segment, turn, hashes, role, text."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashes = _hashes(role, text)
    unnumbered = F.shiftright(F.xxhash64(role, text), 48) + F.lit(32768 - (1 << 63))
    rows = log.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("")).alias("__key"),
        F.col(conv_col).alias("__conv"),
        F.coalesce(F.floor(F.col(turn_col) / segment), unnumbered).alias("__seg"),
        F.col(turn_col).alias("__turn"), *hashes, role.alias("__role"), text.alias("__text"),
    )
    return rows


def prefixes(log: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", segment: int = SEGMENT) -> DataFrame:
    """For each distinct turn: key, id, place (from 1), running hashes up to it, and whether it is the last."""
    rows = turns(log, conv_col, turn_col, role_col, text_col, segment)
    keys = ["__key", "__conv", "__seg", "__turn", "__h1", "__h2"]
    rows = rows.select(*keys).groupBy(*keys).agg(F.lit(1).alias("__one"))
    within = Window.partitionBy("__key", "__seg").orderBy("__turn", "__h1", "__h2")
    by_seg = Window.partitionBy("__key").orderBy("__seg")
    sizes = rows.groupBy("__key", "__seg").agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.select(
        "__key", "__seg", F.coalesce(F.sum("__n").over(by_seg.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"),
        F.lead("__seg").over(by_seg).isNull().alias("__final"),
    )
    placed = rows.join(sizes, ["__key", "__seg"]).withColumn("__place", F.col("__offset") + F.row_number().over(within))
    placed = placed.withColumn("__t1", F.xxhash64("__place", "__h1", "__h2")).withColumn("__t2", F.xxhash64("__h2", "__place", "__h1", F.lit("tag")))
    marks = placed.groupBy("__key", "__seg").agg(F.expr("bit_xor(__t1)").alias("__s1"), F.expr("bit_xor(__t2)").alias("__s2"))
    marks = marks.select(
        "__key", "__seg",
        *[F.coalesce(F.expr(f"bit_xor(__s{k})").over(by_seg.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"__b{k}") for k in (1, 2)],
    )
    run = within.rowsBetween(Window.unboundedPreceding, 0)
    whole = placed.join(marks, ["__key", "__seg"])
    return whole.select(
        "__key", "__conv", "__place",
        *[F.col(f"__b{k}").bitwiseXOR(F.expr(f"bit_xor(__t{k})").over(run)).alias(f"__p{k}") for k in (1, 2)],
        (F.col("__final") & F.lead("__turn").over(within).isNull() & (F.row_number().over(within) == F.count(F.lit(1)).over(Window.partitionBy("__key", "__seg")))).alias("__last"),
    )


def maximal(log: DataFrame, **columns) -> DataFrame:
    """(key, n_turns, n_copies) of the conversations that are no proper prefix of another; one of each set of equals."""
    marked = prefixes(log, **columns)
    same = ["__place", "__p1", "__p2"]
    whole = marked.where("__last").groupBy(*same).agg(F.min_by("__key", F.struct("__conv", "__key")).alias("__key"), F.count(F.lit(1)).alias("n_copies"))
    inner = marked.where("not __last").select(*same).distinct()
    return whole.join(inner, same, "left_anti").select("__key", F.col("__place").alias("n_turns"), "n_copies")


def render(
    log: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT,
    start: str = START, end: str = END,
) -> DataFrame:
    """(id, part, n_turns, n_copies, text): the maximal conversations rendered, one row per segment of turns, ``part`` in order.

    ``n_turns`` is the whole conversation's; joining a conversation's texts by part gives its rendering.
    """
    columns = {"conv_col": conv_col, "turn_col": turn_col, "role_col": role_col, "text_col": text_col, "segment": segment}
    kept = maximal(log, **columns)
    rows = turns(log, **columns).join(kept, "__key")
    keys = ["__key", "__seg", "__turn", "__h1", "__h2"]
    rows = rows.groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("__conv", "__role", "__text", "n_turns", "n_copies")])

    def safe(c: Column) -> Column:
        for mark in (start, end):
            c = F.replace(c, F.lit(mark), F.lit(mark[:2] + " " + mark[2:]))
        return c

    ordered = F.array_sort(F.collect_list(F.struct("__turn", "__h1", "__h2", "__role", "__text")))
    shown = F.transform(ordered, lambda x: F.concat(F.lit(start), safe(x["__role"]), F.lit("\n"), safe(x["__text"]), F.lit(end + "\n")))
    out = rows.groupBy("__key", "__seg").agg(
        F.first("__conv").alias(conv_col), F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.array_join(shown, "").alias("text")
    )
    return out.select(F.col(conv_col), F.col("__seg").alias("part"), "n_turns", "n_copies", "text")


#: The same rows in DuckDB, for logs whose turns have numbers of their own (ties are ordered by a hash that DuckDB lacks).
SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn) AS l, count(*) AS n FROM t GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, l, n, count(*) AS n_copies FROM c GROUP BY l, n),
kept AS (
  SELECT * FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.l[1] = a.l[1] AND b.n > a.n AND b.l[1:a.n] = a.l)
)
SELECT kept.conv_id, CAST(floor(turn / 256) AS BIGINT) AS part, max(n) AS n_turns, max(n_copies) AS n_copies,
  string_agg('<|im_start|>' || replace(replace(role, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || chr(10)
    || replace(replace(text, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text
FROM kept JOIN t ON t.conv_id = kept.conv_id GROUP BY kept.conv_id, CAST(floor(turn / 256) AS BIGINT)
"""
