"""Rows as text: JSON lines, CSV with minimal quotes, Markdown; and commits by new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_KEYS = ("results", "items", "pages", "urls", "links", "skills", "images", "videos", "apis", "endpoints", "messages")


def csv_cell(c: Column, kind: T.DataType | None = None) -> Column:
    """Quoted only where it holds a comma, a quote or a line end; nested values as JSON; null as nothing."""
    text = F.to_json(c) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else c.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[,"\n]'), quoted).otherwise(text), F.lit(""))


def csv_lines(df: DataFrame) -> DataFrame:
    """One column of lines, without the header (which is ``csv_header``)."""
    return df.select(F.concat_ws(",", *[csv_cell(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]).alias("line"))


def csv_header(df: DataFrame) -> str:
    return ",".join(f'"{c}"' if any(x in c for x in ',"\n') else c for c in df.columns)


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("line"))


def pretty_json(df: DataFrame) -> DataFrame:
    """One column of objects over several lines, two spaces a level; arrays of plain values stay on one line."""
    text = F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"})
    return df.select(F.regexp_replace(text, r'(?m)^(\s*"(?:[^"\\]|\\.)*") : ', "$1: ").alias("text"))


def row_array(json: Column) -> Column:
    """The JSON array of rows in a result: under the first known key that holds one, else under the first key that does."""
    v = F.try_parse_json(json)
    found = [F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")).startswith("ARRAY"), F.get_json_object(json, f"$.{k}")) for k in ROW_KEYS]
    fields = v.try_cast("map<string,variant>")
    first = F.get(F.filter(F.json_object_keys(json), lambda k: F.coalesce(F.schema_of_variant(F.try_element_at(fields, k)).startswith("ARRAY"), F.lit(False))), F.lit(0))
    return F.coalesce(*found, F.to_json(F.try_element_at(fields, first)))


def truncated_json(json: Column, most: int) -> Column:
    """(json, truncated): a top-level array, or else the array ``data.children``, cut to ``most`` items."""
    v = F.try_parse_json(json)
    top, outer = v.try_cast("array<variant>"), v.try_cast("map<string,variant>")
    inner = F.try_element_at(outer, F.lit("data")).try_cast("map<string,variant>")
    kids = F.try_element_at(inner, F.lit("children")).try_cast("array<variant>")
    put = lambda fields, key, value: F.map_concat(F.map_filter(fields, lambda k, _: k != key), F.create_map(F.lit(key), value))
    cut = F.to_variant_object(F.slice(kids, 1, most))
    nested = put(outer, "data", F.to_variant_object(put(inner, "children", cut)))
    is_array = F.schema_of_variant(v).startswith("ARRAY")
    return F.when(is_array & (F.size(top) > most), F.struct(F.to_json(F.slice(top, 1, most)).alias("json"), F.lit(True).alias("truncated"))).when(
        F.size(kids) > most, F.struct(F.to_json(nested).alias("json"), F.lit(True).alias("truncated"))
    ).otherwise(F.struct(json.alias("json"), F.lit(False).alias("truncated")))


def feed_markdown(title: Column, link: Column, entries: Column) -> Column:
    """A feed as Markdown: its title and source, then a section for each entry with what is known of it."""
    filled = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    line = lambda name, c: F.concat(F.lit(f"- {name}: "), filled(c))

    def section(e: Column) -> Column:
        known = [F.concat(F.lit("## "), e["title"]), F.concat(F.lit("- Link: "), e["link"]), line("Date", e["published"]), line("Author", e["creator"]), line("Categories", F.array_join(e["categories"], ", ")), line("Image", e["image"])]
        return F.concat_ws("\n", *known, F.concat(F.lit("\n"), filled(e["summary"])), F.lit(""))

    return F.concat_ws("\n", F.concat(F.lit("# "), filled(title), F.lit("\n")), F.concat(F.lit("Source: "), filled(link), F.lit("\n")), F.transform(entries, section))


def wrapped(text: Column, marker: Column) -> Column:
    """``text`` between lines that carry a marker which no text can know before."""
    return F.concat(F.lit("<boundary:"), marker, F.lit(">\n"), text, F.lit("\n</boundary:"), marker, F.lit(">"))


def random_marker() -> Column:
    """16 hexadecimal digits, others for each row and run."""
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 16)


def write_snapshot(df: DataFrame, root: str, version: int) -> str:
    """A new directory of its own; readers see it once its success mark is there."""
    path = f"{root.rstrip('/')}/v={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The newest snapshot that was written whole; one without its success mark is not there yet."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = files.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top, "v=*/_SUCCESS")) or []
    versions = [int(f.getPath().getParent().getName()[2:]) for f in whole]
    if not versions:
        raise FileNotFoundError(f"no snapshot below {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/v={max(versions)}")
