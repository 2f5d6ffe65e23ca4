"""Panels derived from the star-schema and event tables.

Line items are dealt by supplier and period and reduced to bars where they arrive: a
scan task keeps no table of the bars it has seen, whose size would follow the size of
the split, and a supplier that owns a third of all rows is spread over its periods.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridfolio.functions.expr import by_ticker, div, trailing
from gridfolio.operators.calendar import PERIOD_UNITS, calendar_of, dense_grid, in_parts, per_day, period_start
from gridfolio.operators.ranking import ordered_rank

C = F.col
OHLCV = ["open", "high", "low", "close", "volume"]
EXTRA = ["amount", "flow"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: most days of a period (fixed values)
LONGEST = {"day": 1, "week": 7, "month": 31, "quarter": 92, "year": 366}


def _within(value, digits: int) -> Column:
    """A number as a long; one of more digits, or below zero, ends the job."""
    number = (C(value) if isinstance(value, str) else value).cast("long")
    wrong = F.raise_error(F.format_string(f"%d has no place in {digits} digits", number)).cast("long")
    return F.when(number.between(0, 10**digits - 1), number).when(number.isNotNull(), wrong)


def _line_rows(spark: SparkSession, sf_dir: str, freq: str, days: tuple[str, str] | None = None, tickers: Sequence[int] | None = None) -> DataFrame:
    """Line items with their period, price and a key that orders them inside a period, dealt by supplier and period.

    The key packs (day, order, line, price in cents, quantity) into one decimal of
    3, 14, 4, 11 and 6 digits; a larger number ends the job and is never cut. A decimal
    is a fixed-width buffer, so first and last price stay in the hash aggregate; a
    struct would force a sort of all raw rows. Both halves are packed as longs, and one
    decimal product puts them together.
    """
    # order and line, then price and quantity: 18 and 17 digits
    high = _within("l_orderkey", 14) * 10**4 + _within("l_linenumber", 4)
    low = _within(F.round(C("l_extendedprice") * 100), 11) * 10**6 + _within("l_quantity", 6)
    whole = high.cast("decimal(18,0)") * F.lit(10**17).cast("decimal(18,0)") + low.cast("decimal(17,0)")
    # the day goes to the front: its product with 10^35 is looked up, a period has few days
    steps = F.array(*[F.lit(Decimal(d) * 10**35).cast("decimal(38,0)") for d in range(LONGEST[PERIOD_UNITS[freq.upper()]] + 3)])  # and a weekend
    key = F.get(steps, "days_in") + whole.cast("decimal(38,0)")
    raw = table(spark, sf_dir, "lineitem")
    if days:
        kind = raw.schema["l_shipdate"].dataType
        last = dt.date.fromisoformat(days[1]) + dt.timedelta(LONGEST[PERIOD_UNITS[freq.upper()]])
        raw = raw.where((C("l_shipdate") >= F.lit(days[0]).cast(kind)) & (C("l_shipdate") < F.lit(last.isoformat()).cast(kind)))
    if tickers:
        raw = raw.where(C("l_suppkey").isin(list(tickers)))
    day = F.to_date("l_shipdate")
    start = period_start(day, freq)
    # raw numbers are sent, and put together where they arrive
    sent = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"]
    dealt = in_parts(raw.select("l_suppkey", start.alias("date"), F.date_diff(day, start).cast("short").alias("days_in"), *sent), "l_suppkey", "date")
    return dealt.select(
        "l_suppkey",
        "date",
        div(C("l_extendedprice"), C("l_quantity")).alias("price"),
        key.cast("decimal(38,0)").alias("seq"),
        C("l_quantity").alias("qty"),
        C("l_extendedprice").alias("amount"),
        (C("l_discount") * C("l_extendedprice")).alias("flow"),
    )


def bars(spark: SparkSession, sf_dir: str, freq: str = "W", days: tuple[str, str] | None = None, tickers: Sequence[int] | None = None) -> DataFrame:
    """Supplier bars: one row per (ticker, period) that has line items.

    ``days`` bounds the starts of the periods and ``tickers`` names suppliers; both reach the scan as filters on the
    raw columns, and the bars of the periods inside are whole.
    """
    rows = _line_rows(spark, sf_dir, freq, days, tickers)
    if days:
        rows = rows.where(C("date").between(F.lit(days[0]).cast("date"), F.lit(days[1]).cast("date")))
    named = (
        rows
        .groupBy("l_suppkey", "date")
        .agg(
            F.min_by("price", "seq").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "seq").alias("close"),
            F.sum("qty").alias("volume"),
            F.sum("amount").alias("amount"),
            F.sum("flow").alias("flow"),
        )
    )
    return named.select(C("l_suppkey").cast("string").alias("ticker"), *[c for c in named.columns if c != "l_suppkey"])


def bar_calendar(spark: SparkSession, sf_dir: str, freq: str = "W") -> DataFrame:
    """Read from one column of the raw table, without building the bars."""
    day = F.to_date("l_shipdate")
    return calendar_of(table(spark, sf_dir, "lineitem").select(period_start(day, freq).alias("date")))


def day_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User bars per day from the event stream table."""
    return (
        table(spark, sf_dir, "events")
        .select(F.col("user_id").cast("string").alias("ticker"), F.to_date("ts").alias("date"), "event_id", "value")
        .groupBy("ticker", "date")
        .agg(
            F.min_by("value", "event_id").alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", "event_id").alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
    )


def day_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar_of(table(spark, sf_dir, "events").select(F.to_date("ts").alias("date")))


def grid(spark: SparkSession, sf_dir: str, freq: str = "W", values: list[str] | None = None) -> DataFrame:
    cols = values or OHLCV + EXTRA
    return dense_grid(bars(spark, sf_dir, freq), bar_calendar(spark, sf_dir, freq), cols)


def day_grid(spark: SparkSession, sf_dir: str, values: list[str] | None = None) -> DataFrame:
    return dense_grid(day_bars(spark, sf_dir), day_calendar(spark, sf_dir), values or OHLCV)


def quarter_dates(spark: SparkSession, sf_dir: str, calendar: DataFrame | None = None) -> DataFrame:
    """First week of every quarter with its 1-based number."""
    first = (bar_calendar(spark, sf_dir) if calendar is None else calendar).groupBy(F.trunc("date", "quarter").alias("quarter")).agg(F.min("date").alias("date"))
    return first.select("date", F.row_number().over(Window.orderBy("date")).alias("q"))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier region per quarter; every tenth supplier moves on every seventh quarter."""
    region = table(spark, sf_dir, "region")
    dates = quarter_dates(spark, sf_dir).agg(F.array_sort(F.collect_list(F.struct("q", "date"))).alias("dates"))
    home = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    moved = (F.col("s_suppkey") % 10 == 0) & (F.col("d.q") % 7 == 0)
    key = F.when(moved, (F.col("n_regionkey") + 1) % 5).otherwise(F.col("n_regionkey"))
    return (
        home.select("s_suppkey", "n_regionkey", F.explode(dates.scalar()).alias("d"))
        .select(F.col("s_suppkey").cast("string").alias("ticker"), F.col("d.date").alias("date"), key.alias("r_regionkey"))
        .join(region.select("r_regionkey", F.col("r_name").alias("sector")), "r_regionkey")
        .select("date", "ticker", "sector")
    )


def market_caps(spark: SparkSession, sf_dir: str, cells: DataFrame | None = None) -> DataFrame:
    """Traded amount of the last 52 weeks on the dense grid (``cells``, where it is at hand)."""
    cells = grid(spark, sf_dir, values=["amount"]) if cells is None else cells
    return cells.select(
        "ticker", "pos", "date", F.sum("amount").over(trailing(52)).alias("cap")
    )


def universe(spark: SparkSession, sf_dir: str, cells: DataFrame | None = None, calendar: DataFrame | None = None) -> DataFrame:
    """Quarterly membership: the top 80 percent by market cap."""
    caps = market_caps(spark, sf_dir, cells).join(per_day(quarter_dates(spark, sf_dir, calendar).select("date"), "date"), "date")
    ranked = ordered_rank(caps.where(F.col("cap").isNotNull()).select("date", "ticker", "cap"), ["date"], "cap")
    return ranked.select("date", "ticker", F.when(F.col("rank") * 5 > F.col("n"), 1.0).otherwise(0.0).alias("member"))


def index_level(spark: SparkSession, sf_dir: str, cells: DataFrame | None = None) -> DataFrame:
    """Average close per week under the symbol ``ALL`` (of ``cells``, where the grid is at hand)."""
    cells = bars(spark, sf_dir) if cells is None else cells
    return cells.groupBy("date").agg(F.avg("close").alias("value")).select(
        "date", F.lit("ALL").alias("symbol"), "value"
    )


#: model name -> look-back of its momentum score in weeks (fixed values)
SCORE_LAGS = {"a": 1, "b": 4, "c": 13}


def with_scores(df: DataFrame, models: list[str]) -> DataFrame:
    """Add one momentum score column per model to a grid with closes."""
    for m in models:
        df = df.withColumn(f"score_{m}", div(F.col("close"), F.lag("close", SCORE_LAGS[m]).over(by_ticker())) - 1.0)
    return df


def scores(spark: SparkSession, sf_dir: str, models: list[str], cells: DataFrame | None = None) -> DataFrame:
    """Long scores, present cells only: (model, ticker, pos, date, score); of ``cells``, where the grid is at hand."""
    wide = with_scores(grid(spark, sf_dir, values=["close"]) if cells is None else cells.select("ticker", "pos", "date", "close"), models)
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"score_{m}").alias("score")) for m in models]))
    return wide.select("ticker", "pos", "date", pairs.alias("s")).select(
        "s.model", "ticker", "pos", "date", "s.score"
    ).where(F.col("score").isNotNull())


def results(spark: SparkSession, sf_dir: str, models: list[str]) -> DataFrame:
    """Model results: probability from the score, label from the next week's return."""
    wide = with_scores(grid(spark, sf_dir, values=["close"]), models)
    nxt = F.lead("close").over(by_ticker())
    wide = wide.withColumn("ret", div(nxt, F.col("close")) - 1.0)
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"score_{m}").alias("score")) for m in models]))
    up = 1.0 / (1.0 + F.exp(-F.col("s.score")))
    return (
        wide.where(F.col("ret").isNotNull())
        .select("ticker", "date", "ret", pairs.alias("s"))
        .where(F.col("s.score").isNotNull())
        .select(
            "s.model",
            "ticker",
            "date",
            (F.col("ret") > 0).cast("int").alias("label"),
            (up > 0.5).cast("int").alias("prediction"),
            (1.0 - up).alias("prob_down"),
            up.alias("prob_up"),
        )
    )
