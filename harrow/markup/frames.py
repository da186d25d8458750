"""Document-tree readers over DataFrames: Arrow batches, each page parsed once for all that is read from it."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.markup import feeds, read
from harrow.session import ship


def each(df: DataFrame, columns: list[str], kind: str | T.DataType, f: Callable, out: str, drop: Sequence[str] = ()) -> DataFrame:
    """``df`` without ``drop``, with a column made from the values of ``columns`` in each row."""
    return _made(df, columns, kind, lambda *lists: [f(*row) for row in zip(*lists, strict=True)], out, drop)


def each_batch(df: DataFrame, column: str, kind: str | T.DataType, f: Callable, out: str) -> DataFrame:
    """``df`` with a column that ``f`` makes from a batch's list of values of ``column``."""
    return _made(df, [column], kind, f, out)


def _made(df: DataFrame, columns: list[str], kind: str | T.DataType, f: Callable, out: str, drop: Sequence[str] = ()) -> DataFrame:
    ship(df.sparkSession)
    made = T._parse_datatype_string(kind) if isinstance(kind, str) else kind
    kept = [i for i, c in enumerate(df.columns) if c not in drop]
    schema = T.StructType([*(df.schema.fields[i] for i in kept), T.StructField(out, made)])
    at = [df.columns.index(c) for c in columns]
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = f(*(batch.column(i).to_pylist() for i in at))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(values, arrow)], names=[x.name for x in schema.fields])

    return df.mapInArrow(run, schema)


def _guard(f: Callable) -> Callable:
    return lambda x, *rest: None if x is None else f(x, *rest)


def with_markdown(df: DataFrame, html: str = "html", out: str = "markdown") -> DataFrame:
    return each(df, [html], "string", _guard(read.to_markdown), out)


def with_signature(df: DataFrame, mode: str = "readability", html: str = "html", out: str = "signature") -> DataFrame:
    """What a watch compares of a page: its html ("content"), its Markdown ("markdown"), or its article's text, the Markdown where it has none."""
    if mode == "content":
        return df.withColumn(out, F.col(html))

    def made(x: str) -> str:
        if mode != "markdown" and (found := read.article(x, False)) and (text := (found["content"] or "").strip()):
            return text
        return read.to_markdown(x)

    return each(df, [html], "string", _guard(made), out)


STRUCTURED = {
    "json_ld": "array<string>", "open_graph": "map<string,string>", "twitter_cards": "map<string,string>", "microdata": "array<string>",
    "meta": "struct<title:string,description:string,canonical:string,language:string,author:string>",
}


def with_structured(df: DataFrame, html: str = "html", out: str = "data", parts: Sequence[str] = tuple(STRUCTURED), keep: bool = True) -> DataFrame:
    """A struct of ``parts``: only those are read from the tree. Without ``keep`` the pages do not leave the reader again."""
    maps = [k for k in parts if STRUCTURED[k].startswith("map")]

    def made(x: str):
        got = read.structured(x, parts)
        return got | {k: list(got[k].items()) for k in maps}

    return each(df, [html], "struct<" + ",".join(f"{k}:{STRUCTURED[k]}" for k in parts) + ">", _guard(made), out, () if keep else (html,))


def with_items(df: DataFrame, selector: str, fields: dict[str, str], html: str = "html", out: str = "items") -> DataFrame:
    """A column of arrays of structs, one field for each name."""
    kind = "array<struct<" + ",".join(f"`{k}`:string" for k in fields) + ">>"
    return each(df, [html], kind, _guard(lambda x: read.items(x, selector, fields)), out)


def with_single(df: DataFrame, fields: dict[str, str], html: str = "html", out: str = "item") -> DataFrame:
    return each(df, [html], "struct<" + ",".join(f"`{k}`:string" for k in fields) + ">", _guard(lambda x: read.single(x, fields)), out)


def with_page(df: DataFrame, selector: str, fields: dict[str, str], own: dict[str, str], html: str = "html", out: str = "read") -> DataFrame:
    """A struct of items, as of ``with_items``, and item, as of ``with_single``."""
    kind = "struct<items:array<struct<" + ",".join(f"`{k}`:string" for k in fields) + ">>,item:struct<" + ",".join(f"`{k}`:string" for k in own) + ">>"
    return each(df, [html], kind, _guard(lambda x: read.page(x, selector, fields, own)), out)


def with_patterns(df: DataFrame, html: str = "html", out: str = "patterns") -> DataFrame:
    made = _guard(lambda x: [p | {"fields": json.dumps(p["fields"], sort_keys=True)} for p in read.patterns(x)])
    return each(df, [html], "array<struct<selector:string,fields:string,count:int,score:int>>", made, out)


def listing_patterns(pages: DataFrame, keys: list[str], page: str, html: str = "html", least: int = 3, out: str = "patterns") -> DataFrame:
    """(keys, patterns): those of ``with_patterns`` over all pages of a listing as if they were one, without one task holding it."""
    kind = "array<struct<selector:string,mark:string,n:int,place:int,turn:int,fields:string,points:int>>"
    parts = each(pages.select(*keys, F.col(page).alias("__page"), html), [html], kind, _guard(read.pattern_parts), "__part")
    parts = parts.select(*keys, "__page", F.inline("__part"))
    marks = parts.groupBy(*keys, "selector", "mark").agg(F.sum("n").alias("n"), F.min(F.struct("__page", "place", "turn", "fields", "points")).alias("at"))
    first = F.min(F.struct("at.__page", "at.place", "at.turn", "at.fields", "at.points", "n")).alias("first")
    found = marks.groupBy(*keys, "selector").agg(F.sum("n").cast("int").alias("count"), first)
    found = found.where((F.col("count") >= least) & (F.col("first.n") * 2 >= F.col("count")) & F.col("first.fields").isNotNull())
    found = found.withColumn("score", (F.col("count") + F.col("first.points")).cast("int"))
    row = F.struct((-F.col("score")).alias("less"), "first.__page", "first.place", F.struct("selector", F.col("first.fields").alias("fields"), "count", "score").alias("p"))
    return found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["p"]).alias(out))


def with_article(df: DataFrame, html: str = "html", gate: bool = True, out: str = "article") -> DataFrame:
    return each(df, [html], "struct<title:string,byline:string,published:string,site_name:string,content:string>", _guard(lambda x: read.article(x, gate)), out)


def with_media(df: DataFrame, html: str = "html", base: str = "url", out: str = "media") -> DataFrame:
    return each(df, [html, base], "array<struct<kind:string,url:string>>", _guard(lambda x, b: [{"kind": k, "url": u} for k, u in read.media(x, b or "")]), out)


def with_images(df: DataFrame, html: str = "html", base: str = "url", out: str = "images") -> DataFrame:
    kind = "array<struct<url:string,alt:string,width:int,height:int,selector:string,source:string>>"
    return each(df, [html, base], kind, _guard(lambda x, b: read.images(x, b or "")), out)


def with_script_json(df: DataFrame, name: str, html: str = "html", out: str = "json") -> DataFrame:
    return each(df, [html], "string", _guard(lambda x: read.script_json(x, name)), out)


def with_recovered_json(df: DataFrame, text: str, out: str = "json") -> DataFrame:
    return each(df, [text], "string", _guard(read.recovered_json), out)


def with_pager(df: DataFrame, html: str = "html", out: str = "pager") -> DataFrame:
    return each(df, [html], "string", _guard(read.pager), out)


def with_sitemap(df: DataFrame, xml: str = "xml", out: str = "locs") -> DataFrame:
    return each(df, [xml], "array<string>", _guard(feeds.sitemap), out)


def with_feed(df: DataFrame, xml: str = "xml", out: str = "entries") -> DataFrame:
    return each(df, [xml], "array<struct<title:string,link:string,published:string,creator:string,summary:string,categories:array<string>,image:string>>", _guard(feeds.entries), out)


def with_robots(df: DataFrame, robots: str, path: str, agent: str = "*", out: str = "allowed") -> DataFrame:
    return each(df, [robots, path], "boolean", lambda r, p: feeds.allowed(r or "", p or "/", agent), out)


def filter_images(images: DataFrame, alt: str | None = None, least_width: int = 0, most_width: int | None = None) -> DataFrame:
    keep: Column = F.col("width") >= least_width
    if most_width is not None:
        keep = keep & (F.col("width") <= most_width)
    return images.where(keep & F.col("alt").rlike(f"(?i){alt}") if alt else keep)
