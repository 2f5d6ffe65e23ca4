"""Small column expressions shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def div(num: Column, den: Column) -> Column:
    """Division that gives NULL for a zero denominator (ANSI mode raises otherwise)."""
    return num / F.nullif(den, F.lit(0.0))


def zero_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(0.0))


def nan_to_null(col: Column) -> Column:
    """Panels keep missing cells as NULL; NaN would sort above every number."""
    return F.when(~F.isnan(col), col)


def rounded(col: Column, digits: int = 6) -> Column:
    """Rounding for reports; adding 0.0 folds a negative zero into zero."""
    return F.round(col, digits) + F.lit(0.0)


def significant(col: Column) -> Column:
    """Nine significant digits, for reports whose values differ much in size."""
    return F.when(col.isNotNull(), F.format_string("%.8e", col).cast("double") + F.lit(0.0))


def by_ticker(*extra: str, order: str = "pos") -> WindowSpec:
    return Window.partitionBy(*extra, "ticker").orderBy(order)


def trailing(rows: int, *extra: str, order: str = "pos") -> WindowSpec:
    """The current row and the ``rows - 1`` calendar rows before it."""
    return by_ticker(*extra, order=order).rowsBetween(-(rows - 1), 0)


def full_window(col: Column, rows: int, agg: Column, *extra: str) -> Column:
    """``agg`` only where all ``rows`` cells of the trailing frame are present."""
    frame = trailing(rows, *extra)
    return F.when(F.count(col).over(frame) == rows, agg.over(frame))
