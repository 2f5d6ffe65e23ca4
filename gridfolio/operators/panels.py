"""Operators on long panels: filling, filtering, normalising."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridfolio.functions.expr import by_ticker, div, full_window
from gridfolio.operators.calendar import per_day


def forward_fill(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Last present value per ticker along the calendar, without a limit."""
    frame = by_ticker(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(frame) for c in cols})


def in_years(df: DataFrame, years: Sequence[int], col: str = "date") -> DataFrame:
    return df.where(F.year(col).isin(list(years)))


def drop_empty_dates(df: DataFrame, value: str, col: str = "date") -> DataFrame:
    """Drop dates without any value: one aggregated row per date, joined back."""
    kept = df.where(F.col(value).isNotNull()).select(col).distinct()
    return df.join(per_day(kept, col), col, "left_semi")


def zscore_on_years(df: DataFrame, value: str, years: Sequence[int] | None, out: str, by: Sequence[str] = ("ticker",)) -> DataFrame:
    """Per-ticker z-score with moments from the given years only, None for all; zero deviation -> NULL."""
    whole = Window.partitionBy(*by)
    seen = F.col(value) if years is None else F.when(F.year("date").isin(list(years)), F.col(value))
    return df.withColumn(out, div(F.col(value) - F.avg(seen).over(whole), F.stddev_pop(seen).over(whole)))


def rolling_sums(df: DataFrame, value: str, windows: Sequence[int]) -> DataFrame:
    """One long table of full-window sums; the first ``w - 1`` dates of each window are cut."""
    sizes = sorted(set(windows))
    if not sizes or sizes[0] <= 0:
        raise ValueError("rolling windows must be positive")
    cells = df.select(
        "ticker",
        "date",
        "pos",
        F.array(
            *[
                F.struct(
                    F.lit(w).alias("window_rows"),
                    full_window(F.col(value), w, F.sum(value)).alias("value"),
                )
                for w in sizes
            ]
        ).alias("w"),
    )
    return (
        cells.select("ticker", "date", "pos", F.explode("w").alias("w"))
        .select("w.window_rows", "ticker", "date", "pos", "w.value")
        .where(F.col("pos") >= F.col("window_rows"))
    )
