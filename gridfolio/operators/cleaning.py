"""Cleaning steps on long string panels ``(date, ticker, value)``.

Each step is a function ``DataFrame -> DataFrame`` (or returns one), so a chain is
``df.transform(a).transform(b)``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridfolio.operators.calendar import per_day
from gridfolio.operators.ranking import ordered_rank

Step = Callable[[DataFrame], DataFrame]
C = F.col

INVALID_MARKER = "#INVALID OPTION"

#: status label -> flag (fixed values)
STATUS_LABELS = {"정상": "1", "거래정지": "0"}

#: sector label -> English name (fixed values)
SECTOR_LABELS = {
    "IT": "Information Technology",
    "건강관리": "Health Care",
    "경기관련소비재": "Consumer Discretionary",
    "금융": "Financials",
    "산업재": "Industrials",
    "소재": "Materials",
    "에너지": "Energy",
    "유틸리티": "Utilities",
    "커뮤니케이션서비스": "Communication Services",
    "필수소비재": "Consumer Staples",
}

#: vendor item name -> field (fixed values)
ITEM_FIELDS = {
    "수정시가": "open",
    "수정고가": "high",
    "수정저가": "low",
    "수정주가": "close",
    "시가": "open",
    "고가": "high",
    "저가": "low",
    "종가": "close",
    "거래량": "volume",
}
ADJUSTED_ITEMS = ["수정시가", "수정고가", "수정저가", "수정주가"]
FIELDS = ["open", "high", "low", "close", "volume"]


def metric_cells(sheet: DataFrame, header_row: int) -> DataFrame:
    """(row_no, date, ticker, value) of a metric sheet's cells: tickers stand in the header row, dates in the first column.

    Cells of rows without a date and of columns without a ticker are left out. A column has one ticker and a row one
    date, so the joins add to each cell and bring nothing together.
    """
    tickers = sheet.where((C("row_no") == header_row) & (C("col_no") > 0)).select("col_no", C("cell").alias("ticker"))
    body = sheet.where(C("row_no") > header_row)
    dates = body.where(C("col_no") == 0).select("row_no", C("cell").alias("date"))
    cells = body.where(C("col_no") > 0).select("row_no", "col_no", C("cell").alias("value"))
    return cells.join(tickers, "col_no").join(dates, "row_no").select("row_no", "date", "ticker", "value")


def skip_rows(first: int) -> Step:
    return lambda df: df.where(C("row_no") >= first)


def zero_marked_tickers(marker: str = INVALID_MARKER) -> Step:
    """A ticker with the marker anywhere becomes 0 everywhere.

    The marked tickers are found by one aggregate and joined back.
    """

    def step(df: DataFrame) -> DataFrame:
        marked = df.where(C("value").contains(marker)).select("ticker").distinct().withColumn("_m", F.lit(True))
        joined = df.join(marked, "ticker", "left")
        return joined.withColumn("value", F.when(C("_m"), F.lit("0")).otherwise(C("value"))).select(*df.columns)

    return step


def coerce_dates(df: DataFrame) -> DataFrame:
    parsed = F.to_date(F.try_to_timestamp(C("date"), F.lit("yyyy-MM-dd")))
    return df.withColumn("date", parsed).where(C("date").isNotNull())


def coerce_numbers(df: DataFrame) -> DataFrame:
    return df.withColumn("value", C("value").try_cast("double"))


def drop_empty_tickers(df: DataFrame) -> DataFrame:
    kept = df.where(C("value").isNotNull()).select("ticker").distinct()
    return df.join(kept, "ticker", "left_semi")


def lower_names(df: DataFrame, col: str = "ticker") -> DataFrame:
    return df.withColumn(col, F.lower(col))


def recode(mapping: Mapping[str, str], col: str = "value") -> Step:
    """Trim, then map known labels; other labels stay."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    trimmed = F.trim(C(col))
    return lambda df: df.withColumn(col, F.coalesce(F.try_element_at(pairs, trimmed), trimmed))


def status_flags(normal: int = 1, halted: int = 0) -> Step:
    labels = list(STATUS_LABELS)
    return recode({labels[0]: str(normal), labels[1]: str(halted)})


def sector_names(mapping: Mapping[str, str] | None = None) -> Step:
    return recode(mapping or SECTOR_LABELS)


def normalise_panel(df: DataFrame, source_order: str) -> DataFrame:
    """First of duplicate (date, ticker) cells by source order; all-null dates are dropped."""
    firsts = df.groupBy("date", "ticker").agg(F.min_by("value", source_order).alias("value"))
    kept = df.groupBy("date").agg(F.count("value").alias("n")).where(C("n") > 0).select("date")
    return firsts.join(per_day(kept, "date"), "date", "left_semi")


def chain(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df


# ------------------------------------------------------------------ vendor sheets


def sheet_columns(sheet: DataFrame, ticker_row: int = 7, item_row: int = 13) -> DataFrame:
    """Column number, ticker and trimmed item name from the two header rows."""
    heads = sheet.where(C("row_no").isin(ticker_row, item_row) & (C("col_no") > 0))
    return heads.groupBy("col_no").agg(
        F.max(F.when(C("row_no") == ticker_row, C("cell"))).alias("ticker"),
        F.max(F.when(C("row_no") == item_row, F.trim("cell"))).alias("item"),
    )


def sheet_cells(sheet: DataFrame, first_row: int = 14) -> DataFrame:
    """Body cells with their date; rows whose date does not parse are dropped."""
    body = sheet.where(C("row_no") >= first_row)
    dates = body.where(C("col_no") == 0).select("row_no", C("cell").alias("date")).transform(coerce_dates)
    cells = body.where(C("col_no") > 0)
    return cells.join(sheet_columns(sheet), "col_no").join(dates, "row_no")


def project_items(cells: DataFrame) -> DataFrame:
    """Item names to the five fields; for one ticker and field the later column wins."""
    pairs = F.create_map(*[F.lit(x) for kv in ITEM_FIELDS.items() for x in kv])
    named = cells.withColumn("field", F.try_element_at(pairs, C("item"))).where(C("field").isNotNull())
    value = C("cell").try_cast("double")
    return named.groupBy("date", "ticker").agg(
        *[
            F.max_by(F.when(C("field") == f, value), F.when(C("field") == f, C("col_no"))).alias(f)
            for f in FIELDS
        ]
    )


def invalid_tickers(cells: DataFrame, marker: str = INVALID_MARKER) -> DataFrame:
    """Tickers with the marker in an adjusted price column."""
    return (
        cells.where(C("item").isin(ADJUSTED_ITEMS) & C("cell").contains(marker)).select("ticker").distinct()
    )


def vendor_bars(sheet: DataFrame) -> DataFrame:
    cells = sheet_cells(sheet)
    return project_items(cells).join(invalid_tickers(cells), "ticker", "left_anti")


# ------------------------------------------------------------------ splits and filters


def first_share_by_date(df: DataFrame, calendar: DataFrame, ratio: float) -> DataFrame:
    """Add ``part``: train for the first ``ratio`` of the distinct dates."""
    cut = F.floor(F.lit(ratio) * C("n_dates"))
    part = F.when(C("pos") <= cut, F.lit("train")).otherwise(F.lit("valid"))
    return df.join(per_day(calendar.select("date", part.alias("part")), "date"), "date")


def split_by_year(df: DataFrame, train_years: Sequence[int]) -> DataFrame:
    return df.withColumn("part", F.when(F.year("date").isin(list(train_years)), F.lit("train")).otherwise(F.lit("valid")))


def split_stratified(df: DataFrame, label: str, key: Sequence[str], ratio: float, seed: int = 42) -> DataFrame:
    """Random split inside each label, repeatable from the key and the seed."""
    mark = F.md5(F.concat_ws("|", *[C(k).cast("string") for k in key], F.lit(str(seed))))
    ranked = ordered_rank(df.withColumn("_mark", mark), [label], "_mark", "_mark")
    part = F.when(C("rank") <= F.floor(F.lit(ratio) * C("n")), F.lit("train")).otherwise(F.lit("valid"))
    return ranked.withColumn("part", part).drop("_mark", "rank", "n")


def split_by_row_order(df: DataFrame, ratio: float) -> DataFrame:
    """The first ``ratio`` of the rows in (date, ticker) order is the training part."""
    ranked = ordered_rank(df, [], "date", "ticker")
    part = F.when(C("rank") <= F.floor(F.lit(ratio) * C("n")), F.lit("train")).otherwise(F.lit("valid"))
    return ranked.withColumn("part", part).drop("rank", "n")


def without_symbol(scores: DataFrame, prices: DataFrame, symbol: str | None) -> DataFrame:
    """Scores whose ticker has prices, minus the benchmark symbol."""
    known = prices.select("ticker").distinct()
    kept = scores.join(known, "ticker", "left_semi")
    return kept.where(C("ticker") != symbol) if symbol else kept


def dense_index(df: DataFrame, by: Sequence[str], order: str, tie: str, out: str) -> DataFrame:
    """0-based index without gaps inside each group."""
    ranked = ordered_rank(df, by, order, tie)
    return ranked.withColumn(out, C("rank") - 1).drop("rank", "n")


def largest_date(df: DataFrame) -> DataFrame:
    return df.agg(F.date_format(F.max("date"), "yyyyMMdd").alias("latest"))


def top_and_bottom(df: DataFrame, value: str, top_n: int, bottom_n: int, by: str = "date") -> DataFrame:
    """First and last rows of each date in a stable ascending sort.

    ``row_number() <= n`` is cut to n rows per task before the shuffle, so no task
    receives a whole date.
    """
    low = Window.partitionBy(by).orderBy(C(value).asc(), C("ticker").asc())
    high = Window.partitionBy(by).orderBy(C(value).desc(), C("ticker").desc())
    present = df.where(C(value).isNotNull())
    bottom = present.withColumn("n", F.row_number().over(low)).where(C("n") <= bottom_n).withColumn("side", F.lit("bottom"))
    top = present.withColumn("n", F.row_number().over(high)).where(C("n") <= top_n).withColumn("side", F.lit("top"))
    return bottom.unionByName(top)
