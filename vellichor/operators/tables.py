"""Tables of cells: cleaning and rendering as Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellichor.functions import text as X


def clean_cells(rows: str | Column) -> Column:
    """Cells collapsed and padded to one width; empty rows and columns dropped."""
    r = F.transform(X.col(rows), lambda row: F.transform(row, lambda c: X.collapse(F.coalesce(c, F.lit("")))))
    r = F.filter(r, lambda row: F.exists(row, lambda c: c != ""))
    width = F.coalesce(F.array_max(F.transform(r, F.size)), F.lit(0))
    padded = F.transform(r, lambda row: F.concat(row, F.array_repeat(F.lit(""), width - F.size(row))))
    used = F.filter(F.when(width > 0, F.sequence(F.lit(1), width)).otherwise(F.array().cast("array<int>")), lambda k: F.exists(padded, lambda row: F.element_at(row, k) != ""))
    return F.transform(padded, lambda row: F.transform(used, lambda k: F.element_at(row, k)))


def merge_continuations(rows: Column) -> Column:
    """Rows whose first cell is empty are continuations: their cells join the row above with ``; ``."""
    return F.aggregate(
        rows,
        F.array().cast("array<array<string>>"),
        lambda acc, row: F.when(
            (F.size(acc) > 1) & (F.element_at(row, 1) == "") & F.exists(row, lambda c: c != ""),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.zip_with(F.element_at(acc, -1), row, lambda a, b: F.when(b == "", a).when(a == "", b).otherwise(F.concat_ws("; ", a, b))))),
        ).otherwise(F.concat(acc, F.array(row))),
    )


def render(rows: Column) -> Column:
    """A pipe table with columns as wide as their widest cell, three at least; null without rows."""
    n = F.size(F.element_at(rows, 1))
    widths = F.transform(F.sequence(F.lit(1), n), lambda k: F.greatest(F.lit(3), F.array_max(F.transform(rows, lambda r: F.length(F.element_at(r, k))))))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.zip_with(cells, widths, lambda c, w: F.rpad(c, w, " ")), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(widths, lambda w: F.repeat(F.lit("-"), w)), " | "), F.lit(" |"))
    body = F.transform(F.slice(rows, 2, 1_000_000), line)
    return F.when((F.size(rows) > 0) & (n > 0), F.array_join(F.concat(F.array(line(F.element_at(rows, 1)), rule), body), "\n"))
