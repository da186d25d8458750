"""Table functions for SQL: tables found in the lines of a page, in one pass over the page's rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from harrow.session import ship

GAP = re.compile(r"\s{2,}|\t+", re.A)


def cells_of(text: str | None) -> list[str]:
    return [] if text is None else [x for x in GAP.split(text.strip(" ")) if x]


class TextTables:
    """Runs of two or more rows with the same number (two or more) of cells, of rows (line, text) in order.

    One partition is a page: ``SELECT * FROM text_tables(TABLE(rows) PARTITION BY page ORDER BY line)``. Only the current run's
    first row is held back. Runs are numbered as a window would: every row that begins one, or is no row of a table, counts.
    """

    def __init__(self) -> None:
        self.run, self.before, self.held = 0, None, None

    def eval(self, row: Row) -> Iterator[tuple]:
        line, text = row["line"], row["text"]
        cells = cells_of(text)
        if len(cells) < 2 or len(cells) != self.before:
            self.run, self.held = self.run + 1, (line, cells) if len(cells) >= 2 else None
        else:
            if self.held is not None:
                yield row["page"], self.run, *self.held
                self.held = None
            yield row["page"], self.run, line, cells
        self.before = len(cells)


def register(spark: SparkSession) -> None:
    """Make ``text_tables`` known to SQL and to ``lateralJoin``; its argument has the columns page, line and text."""
    ship(spark)
    spark.udtf.register("text_tables", udtf(TextTables, returnType="page long, table long, line long, cells array<string>"))
