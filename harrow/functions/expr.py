"""The small languages of stored recipes, compiled to Columns: paths, conditions, references, templates, parameters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = r"\{\{(env|input|computed):([^}]+)\}\}"


def json_path(path: str) -> str:
    """``a.b[0]`` as a JSON path."""
    parts = [p for p in re.split(r"\.|(\[\d+\])", path) if p]
    return "$" + "".join(p if p.startswith("[") else f".{p}" for p in parts)


def at_path(json: Column, path: str) -> Column:
    """The value at a path of a JSON text as a string, null where any step is missing."""
    return F.get_json_object(json, json_path(path))


TOKEN = re.compile(r"""\$([\w.\[\]]+)|"([^"]*)"|'([^']*)'|(-?\d+(?:\.\d+)?)|\b(true|false|null)\b|(===|!==|==|!=|>=|<=|>|<|&&|\|\|)""")


def _typed(variables: Column, path: str) -> Column:
    """The value at a path with its kind: undefined, null, boolean, number, string or object."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(variables), json_path(path), "variant"))
    text = at_path(variables, path)
    name = (
        F.when(kind.isNull(), "undefined").when(kind == "VOID", "null").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string")
        .when(kind.rlike("^(OBJECT|ARRAY)"), "object").otherwise("number")
    )
    number = (
        F.when(name == "number", text.try_cast("double")).when(name == "boolean", (text == "true").cast("double")).when(name == "null", 0.0)
        .when((name == "string") & (F.trim(text) == ""), 0.0).when(name == "string", F.trim(text).try_cast("double"))
    )
    return F.struct(name.alias("kind"), number.alias("number"), text.alias("text"))


def _literal(kind: str, v: str | None) -> Column:
    number = {"number": float(v) if kind == "number" else 0.0, "boolean": float(v == "true"), "null": 0.0}.get(kind)
    if kind == "string":
        shown = (v or "").strip()
        number = 0.0 if not shown else float(shown) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", shown) else None
    return F.struct(F.lit(kind).alias("kind"), F.lit(number).cast("double").alias("number"), F.lit(v).cast("string").alias("text"))


def _truth(x: Column) -> Column:
    """Numbers but 0, texts but the empty one, and all objects are true."""
    return F.coalesce((x["kind"] == "object") | ((x["kind"] == "string") & (x["text"] != "")) | (x["kind"].isin("number", "boolean") & (x["number"] != 0)), F.lit(False))


def _compared(x: Column, op: str, y: Column) -> Column:
    """Equality of kind and value (===), with conversion to numbers (==), and order: texts by text, all else by number."""
    both = lambda kind: (x["kind"] == kind) & (y["kind"] == kind)
    no = F.lit(False)
    if op in ("===", "!=="):
        same = (x["kind"] == y["kind"]) & (
            x["kind"].isin("undefined", "null") | (both("string") & (x["text"] == y["text"])) | (x["kind"].isin("number", "boolean") & (x["number"] == y["number"]))
        )
        return F.coalesce(same, no) if op == "===" else ~F.coalesce(same, no)
    if op in ("==", "!="):
        nothing = [v["kind"].isin("undefined", "null") for v in (x, y)]
        same = F.when(nothing[0] | nothing[1], nothing[0] & nothing[1]).when(both("string"), x["text"] == y["text"]).when((x["kind"] == "object") | (y["kind"] == "object"), no).otherwise(x["number"] == y["number"])
        return F.coalesce(same, no) if op == "==" else ~F.coalesce(same, no)
    order = {">": lambda p, q: p > q, "<": lambda p, q: p < q, ">=": lambda p, q: p >= q, "<=": lambda p, q: p <= q}[op]
    return F.coalesce(F.when(both("string"), order(x["text"], y["text"])).otherwise(order(x["number"], y["number"])), no)


def condition(text: str, variables: Column) -> Column:
    """A condition over a JSON text of variables. Terms are joined strictly from left to right, without precedence; a term
    is a comparison of two values or the truth of its first value; no term is false."""
    groups: list[list[tuple[str, str | None]]] = [[]]
    joins = []
    for m in TOKEN.finditer(text):
        ref, double, single, number, word, op = m.groups()
        if op in ("&&", "||"):
            joins.append(op)
            groups.append([])
        elif op:
            groups[-1].append(("op", op))
        elif ref is not None:
            groups[-1].append(("ref", ref))
        elif number is not None:
            groups[-1].append(("number", number))
        elif word is not None:
            groups[-1].append(("null", None) if word == "null" else ("boolean", word))
        else:
            groups[-1].append(("string", double if double is not None else single))
    if not joins and not groups[0]:
        return F.lit(False)

    def value(token: tuple[str, str | None]) -> Column:
        return _typed(variables, token[1] or "") if token[0] == "ref" else _literal("null", None) if token[0] == "op" else _literal(*token)

    terms = []
    for g in groups:
        if len(g) == 3 and g[1][0] == "op":
            terms.append(_compared(value(g[0]), g[1][1] or "", value(g[2])))
        else:
            terms.append(_truth(value(g[0])) if g else F.lit(False))
    out = terms[0]
    for op, t in zip(joins, terms[1:], strict=True):
        out = (out & t) if op == "&&" else (out | t)
    return out


def interpolate(text: str, variables: Column) -> Column:
    """``$a.b`` references in ``text`` replaced by their values, missing ones by nothing."""
    parts, at = [], 0
    for m in re.finditer(r"\$([\w.\[\]]+)", text):
        parts += [F.lit(text[at : m.start()]), F.coalesce(at_path(variables, m[1]), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(text[at:]))


def computed_values(at: Column) -> Column:
    """The values that templates may compute, by name, at a time ``at`` (a timestamp, read in UTC)."""
    utc = F.to_utc_timestamp(at, F.current_timezone())
    day = lambda n: F.date_format(F.date_sub(utc.cast("date"), n), "yyyy-MM-dd")
    # The names.
    made = {
        "date_today": day(0), "date_yesterday": day(1), "date_7_days_ago": day(7), "date_30_days_ago": day(30), "timestamp": F.unix_millis(at).cast("string"),
        "timestamp_iso": F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "random_string": F.lower(F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8)),
        "year": F.date_format(utc, "yyyy"), "month": F.date_format(utc, "MM"), "day": F.date_format(utc, "dd"),
    }
    return F.create_map(*[x for k, v in made.items() for x in (F.lit(k), v)])


def template(text: Column, values: Column, defaults: Column | None = None, computed: Column | None = None) -> Column:
    """``{{input:name}}`` replaced from a map, or from one of defaults; ``{{computed:name}}`` from a map of computed values.

    What the maps lack stays as it is, and so does ``{{env:name}}``: an engine's environment is not its data's to read.
    """
    none = F.create_map().cast("map<string,string>")
    known = F.struct(values.alias("input"), (none if defaults is None else defaults).alias("default"), (none if computed is None else computed).alias("computed"))
    whole = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\{\{(?:input|computed):[^}]+\}\})"), F.lit(1)))

    def put(k: Column, acc: Column, x: Column) -> Column:
        name = F.trim(F.regexp_extract(x, PLACEHOLDER, 2))
        value = F.when(x.startswith("{{computed"), F.try_element_at(k["computed"], name)).otherwise(F.coalesce(F.try_element_at(k["input"], name), F.try_element_at(k["default"], name)))
        return F.coalesce(F.replace(acc, x, value), acc)

    return F.aggregate(whole, text, lambda acc, x: put(known, acc, x))


def unresolved(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\{\{[^}]+\}\})"), F.lit(1))


# What the selectors of passwords, of user names and of searches look like.
PASSWORD, USERNAME, SEARCH = "(?i)password|passwd|pwd|secret", "(?i)username|user|email|login|userid", "(?i)search|query|keyword|term|filter|q=|case|number|id"


def parameter_kind(selector: Column, text: Column) -> Column:
    """Which parameter the text typed into an element is likely to be; templates are none already."""
    kind = F.when(selector.rlike(PASSWORD) | text.rlike(PASSWORD), "password").when(selector.rlike(USERNAME), "username").when(selector.rlike(SEARCH) & (F.length(text) > 0), "query")
    return F.when(~text.contains("{{"), kind)


def merged(a: Column, b: Column) -> Column:
    """Two maps, the second's values winning."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)
