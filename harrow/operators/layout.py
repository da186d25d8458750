"""Text layout: lines from positioned items, tables from aligned text, confidence, accessibility trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions import text as X


def lines(items: DataFrame, page: str, order: str, text: str, y: str, ends: str, jump: float = 2.0) -> DataFrame:
    """(page, line, text): a new line after an item that ends one, or where y moves by more than ``jump``."""
    w = Window.partitionBy(page).orderBy(order)
    fresh = F.coalesce(F.lag(ends).over(w) | (F.abs(F.col(y) - F.lag(y).over(w)) > jump), F.lit(False))
    placed = items.withColumn("line", F.sum(fresh.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ")
    return placed.groupBy(page, "line").agg(F.trim(F.regexp_replace(whole, r"\s+", " ")).alias("text"))


def tables(rows: DataFrame, page: str, order: str, text: str) -> DataFrame:
    """(page, table, order, cells): runs of two or more lines with the same number (two or more) of cells, cut at wide gaps."""
    cells = F.filter(F.split(F.trim(F.col(text)), r"\s{2,}|\t+"), lambda x: x != "")
    c = rows.select(page, order, cells.alias("cells")).withColumn("n", F.size("cells"))
    w = Window.partitionBy(page).orderBy(order)
    change = (F.col("n") < 2) | F.coalesce(F.lag("n").over(w) != F.col("n"), F.lit(True))
    c = c.withColumn("run", F.sum(change.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("n >= 2")
    c = c.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(page, "run"))).where("size >= 2")
    return c.select(page, F.col("run").alias("table"), order, "cells")


#: white space at the ends of a text, and what is not printable: no printable ASCII, letter, number, punctuation or space.
SPACE = r"\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
ENDS, ODD, WIDE = f"^[{SPACE}]+|[{SPACE}]+$", rf"[^\x20-\x7E\p{{L}}\p{{N}}\p{{P}}{SPACE}]", r"[^\x{10000}-\x{10FFFF}]"


def confidence(text: Column) -> Column:
    """Share of printable characters of the trimmed text, less for texts under 50; a character beyond U+FFFF counts as two in its length."""
    t = F.regexp_replace(text, ENDS, "")
    n = F.length(t) + F.length(F.regexp_replace(t, WIDE, ""))
    printable = F.length(F.regexp_replace(t, ODD, ""))
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), printable / n * F.least(F.lit(1.0), n / 50.0)))


# Roles that always get a reference, those that get one unless only interactive ones are asked for, and those that only group.
INTERACTIVE = ("button", "link", "textbox", "checkbox", "radio", "combobox", "listbox", "menuitem", "option", "searchbox", "slider", "spinbutton", "switch", "tab", "treeitem")
CONTENT = ("heading", "cell", "article", "region", "navigation", "img", "figure", "blockquote", "code")


STRUCTURAL = ("generic", "group", "list", "table", "row", "rowgroup", "columnheader", "rowheader", "presentation", "none", "separator", "toolbar", "banner", "contentinfo", "main", "complementary", "form")


def tree_lines(text: Column) -> Column:
    """An array of (line, indent, role, name, attributes, raw) of an accessibility tree's lines.

    A line is ``- role "name" attributes``, ``- role:``, ``- text: content`` or ``- content``, the last two of role text; lines
    without the dash are left out.
    """
    named, bare = r'^(\w+)\s+"([^"]*)"(.*)$', r"^(\w+):?\s*$"

    def parts(raw: Column, n: Column) -> Column:
        rest = F.regexp_replace(raw, r"^\s+", "")
        x = F.substr(rest, F.lit(3))
        whole, alone = x.rlike(named), x.rlike(bare)
        plain = F.when(x.startswith("text:"), F.substr(x, F.lit(6))).otherwise(F.regexp_replace(x, ":$", ""))
        return F.when(
            rest.startswith("- "),
            F.struct(
                n.alias("line"), (F.length(raw) - F.length(rest)).alias("indent"), F.when(whole, F.regexp_extract(x, named, 1)).when(alone, F.regexp_extract(x, bare, 1)).otherwise("text").alias("role"),
                F.when(whole, F.regexp_extract(x, named, 2)).when(alone, "").otherwise(X.trim(plain)).alias("name"), F.when(whole, X.trim(F.regexp_extract(x, named, 3))).otherwise("").alias("attributes"), raw.alias("raw"),
            ),
        )

    return F.filter(F.transform(F.split(text, "\n"), parts), lambda x: x.isNotNull())


def selector(role: Column, name: Column, nth: Column) -> Column:
    """How a page's script finds an element of a role and name, the ``nth`` of equal ones."""
    given = F.when(name != "", F.concat(F.lit(", { name: '"), F.replace(name, F.lit("'"), F.lit("\\'")), F.lit("', exact: true }"))).otherwise("")
    return F.concat(F.lit("getByRole('"), role, F.lit("'"), given, F.lit(")"), F.when(nth.isNotNull(), F.concat(F.lit(".nth("), nth.cast("string"), F.lit(")"))).otherwise(""))


def references(tree: DataFrame, page: str, line: str, interactive: bool = False) -> DataFrame:
    """Lines that get a reference (e1, e2, ...), numbered in order, with a selector; ``nth`` only where role and name repeat."""
    roles = INTERACTIVE if interactive else (*INTERACTIVE, *CONTENT)
    kept = tree.where(F.col("role").isin(*roles))
    same = Window.partitionBy(page, "role", "name")
    kept = kept.select(
        page, line, "role", "name", F.concat(F.lit("e"), F.row_number().over(Window.partitionBy(page).orderBy(line)).cast("string")).alias("ref"),
        F.when(F.count(F.lit(1)).over(same) > 1, F.row_number().over(same.orderBy(line)) - 1).alias("nth"),
    )
    return kept.withColumn("selector", selector(F.col("role"), F.col("name"), F.col("nth")))


def annotated(pages: DataFrame, page: str, text: str, interactive: bool = True, compact: bool = True) -> DataFrame:
    """(page, line, text): a tree's lines with references put in; ``compact`` leaves out structural lines without children."""
    raw = pages.select(page, F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    parsed = pages.select(page, F.inline(tree_lines(F.col(text)))).drop("raw")
    refs = references(parsed, page, "line", interactive).select(page, "line", "ref")
    x = raw.join(parsed, [page, "line"], "left").join(refs, [page, "line"], "left")
    marked = F.concat(F.repeat(F.lit(" "), F.col("indent")), F.lit("- "), "role", F.when(F.col("name") != "", F.concat(F.lit(' "'), "name", F.lit('"'))).otherwise(""), F.lit(" [ref="), "ref", F.lit("]"), F.when(F.col("attributes") != "", F.concat(F.lit(" "), "attributes")).otherwise(""))
    kept = F.col("ref").isNotNull() | F.when(F.col("role").isNull(), X.trim(F.col("raw")) != "").otherwise(F.lit(not compact) | ~F.col("role").isin(*STRUCTURAL))
    return x.where(kept).select(page, "line", F.coalesce(marked, F.col("raw")).alias("text"))
