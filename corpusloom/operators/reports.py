"""Fixed-width text reports of small result frames, as frames of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell(c: str, kind: str, width: int, digits: int = 4) -> Column:
    """A value in ``width`` characters: text to the left, numbers to the right, fractions with ``digits``; null as '-'."""
    if kind in ("double", "float"):
        shown = F.format_string(f"%.{digits}f", F.col(c).cast("double"))
    else:
        shown = F.col(c).cast("string")
    shown = F.coalesce(F.when(F.col(c).isNotNull(), shown), F.lit("-"))
    return F.rpad(shown, width, " ") if kind in ("string", "boolean") else F.lpad(shown, width, " ")


def lines(rows: DataFrame, widths: dict[str, int], order: list[str], digits: int = 4) -> DataFrame:
    """(n, line): a head, a rule and a line per row, in ``order``; values over their column's width are cut.

    Reports are of a few rows (metrics, checks): the numbering puts all rows in one task.
    """
    kinds = dict(rows.dtypes)
    left = lambda c: kinds[c] in ("string", "boolean")
    head = "  ".join(c[:w].ljust(w) if left(c) else c[:w].rjust(w) for c, w in widths.items())
    body = rows.select(F.row_number().over(Window.orderBy(*order)).alias("n"), F.concat_ws("  ", *(cell(c, kinds[c], w, digits) for c, w in widths.items())).alias("line"))
    top = rows.sparkSession.createDataFrame([(-1, head), (0, "-" * len(head))], "n int, line string")
    return top.unionByName(body)
