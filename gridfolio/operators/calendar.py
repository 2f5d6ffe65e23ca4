"""Trading calendar, dense grid, rebalance schedule and windows.

Tables keyed by a DATE column hold at most one row per calendar day, whatever
the size of the facts (a century of days is under 40,000 rows), so they are the
one kind of table this library broadcasts without looking at it first.
``per_day`` is the gate: it refuses any key that is not a DATE or a position in
the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfolio.sources.store import input_bytes

#: pandas-style frequency -> Spark ``trunc`` unit (fixed values)
PERIOD_UNITS = {
    "D": "day",
    "B": "day",
    "W": "week",
    "M": "month",
    "ME": "month",
    "MS": "month",
    "BM": "month",
    "BME": "month",
    "BMS": "month",
    "Q": "quarter",
    "QE": "quarter",
    "QS": "quarter",
    "Y": "year",
}


def per_day(df: DataFrame, key: str) -> DataFrame:
    """Broadcast a table that holds one row per day, or per window of a schedule; none that has a row per group of a day."""
    several = {"run", "group_id", "ticker", "sector", "model"} & set(df.columns)
    if several:
        raise TypeError(f"rows per {sorted(several)}: let the optimiser choose the join")
    kind = df.schema[key].dataType
    if not isinstance(kind, (T.DateType, T.IntegerType)):
        raise TypeError(f"{key} must be a DATE or a calendar position, not {kind.simpleString()}")
    return F.broadcast(df)


def calendar_of(dates: DataFrame, col: str = "date") -> DataFrame:
    """Distinct dates with their 1-based position and the calendar length."""
    days = dates.select(F.col(col).cast("date").alias("date")).where(F.col("date").isNotNull()).distinct()
    order = Window.orderBy("date")  # the calendar only: one short row per trading day
    whole = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return days.select(
        "date",
        F.row_number().over(order).alias("pos"),
        F.count(F.lit(1)).over(whole).cast("int").alias("n_dates"),
    )


#: bytes of input files for one part of dealt rows (fixed value); sorting them takes a task about 100 MB
PART_BYTES = 8 * 2**20


def usual_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def parts_of(*read: DataFrame) -> int:
    """As many parts as the session's shuffles have; more where the files that one of the tables reads ask for more.

    A fixed number of parts would let the memory of a task grow with the table until it sorts and aggregates on disk.
    """
    return max(usual_parts(read[0]), *(-(-input_bytes(df) // PART_BYTES) for df in read))


def in_parts(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """The rows dealt by ``keys`` into ``parts``, else as many as ``parts_of`` counts.

    Left to itself the optimiser joins parts until each is large as it is sent, before gaps are filled and windows add
    their columns, so that the memory of one task would grow with the table.
    """
    return df.repartition(parts or parts_of(df), *keys)


def in_more_parts(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """Dealt like ``in_parts``, but left to the optimiser where the session's shuffles have parts enough."""
    parts = parts or parts_of(df)
    return df.repartition(parts, *keys) if parts > usual_parts(df) else df


def dealt_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join of two large tables, both dealt by its keys where their files ask for more parts than shuffles have."""
    parts = parts_of(left, right)
    return in_more_parts(left, *keys, parts=parts).join(in_more_parts(right, *keys, parts=parts), list(keys), how)


def dense_grid(
    facts: DataFrame, calendar: DataFrame, values: Sequence[str], keys: Sequence[str] = ("ticker",)
) -> DataFrame:
    """Every (ticker, calendar date) cell; missing cells are NULL.

    Rolling frames count calendar rows, so the holes have to exist as rows. Each
    fact emits itself and the empty days up to the next fact of its ticker, which
    needs one shuffle by ticker and neither a cross join nor a second join; the
    windows that follow reuse that partitioning.
    """
    order = Window.partitionBy(*keys).orderBy("src")
    placed = facts.join(per_day(calendar, "date"), "date").select(
        *keys, F.col("pos").alias("src"), "n_dates", *values
    )
    spans = in_parts(placed, *keys).select(
        *keys,
        "src",
        *values,
        F.when(F.row_number().over(order) == 1, F.lit(1)).otherwise(F.col("src")).alias("lo"),
        F.coalesce(F.lead("src").over(order) - 1, F.col("n_dates")).alias("hi"),
    )
    cells = spans.select(*keys, "src", *values, F.explode(F.sequence("lo", "hi")).alias("pos"))
    here = F.col("pos") == F.col("src")
    return cells.join(per_day(calendar.select("pos", "date"), "pos"), "pos").select(
        *keys, "pos", "date", *[F.when(here, F.col(v)).alias(v) for v in values]
    )


def period_start(col: Column | str, freq: str) -> Column:
    """The first day of the period of a date.

    Business periods differ on weekends only: a weekend joins the Friday before it (B), the month that follows if
    it comes after the last business day (BM), or the month before if it comes before the first one (BMS).
    """
    freq = freq.upper()
    unit = PERIOD_UNITS[freq]
    date = F.col(col) if isinstance(col, str) else col

    def past_friday(day: Column) -> Column:
        return F.greatest(F.weekday(day) - 4, F.lit(0))

    if freq == "B":
        return F.date_sub(date, past_friday(date))
    if freq in ("BM", "BME"):
        end = F.last_day(date)
        date = F.when(date > F.date_sub(end, past_friday(end)), F.date_add(end, 1)).otherwise(date)
    elif freq == "BMS":
        begin = F.trunc(date, "month")
        wait = F.when(F.weekday(begin) >= 5, 7 - F.weekday(begin)).otherwise(0)
        date = F.when(date < F.date_add(begin, wait), F.date_sub(begin, 1)).otherwise(date)
    return date if unit == "day" else F.trunc(date, unit)


def rebalance_schedule(calendar: DataFrame, freq: str) -> DataFrame:
    """Last trading date of every period, and the last date of the data."""
    last = calendar.groupBy(period_start("date", freq).alias("period")).agg(F.max("date").alias("date"))
    return last.select("date").unionByName(calendar.agg(F.max("date").alias("date"))).where(
        F.col("date").isNotNull()
    ).distinct()


def rebalance_windows(calendar: DataFrame, freq: str, lag: int = 0) -> DataFrame:
    """Consecutive schedule dates as (signal, entry, exit); entry >= exit is dropped."""
    if lag < 0:
        raise ValueError("the entry lag must not be negative")
    order = Window.orderBy("signal_date")  # the schedule only
    pairs = rebalance_schedule(calendar, freq).select(
        F.col("date").alias("signal_date"),
        F.lead("date").over(Window.orderBy("date")).alias("exit_date"),
    ).where(F.col("exit_date").isNotNull())
    cal = calendar.select("date", "pos")
    signal = cal.select(F.col("date").alias("signal_date"), (F.col("pos") + lag).alias("entry_pos"))
    entry = cal.select(F.col("date").alias("entry_date"), F.col("pos").alias("entry_pos"))
    leave = cal.select(F.col("date").alias("exit_date"), F.col("pos").alias("exit_pos"))
    return (
        pairs.join(per_day(signal, "signal_date"), "signal_date")
        .join(per_day(entry, "entry_pos"), "entry_pos")
        .join(per_day(leave, "exit_date"), "exit_date")
        .where(F.col("entry_date") < F.col("exit_date"))
        .select(
            F.row_number().over(order).alias("window_id"),
            "signal_date",
            "entry_date",
            "exit_date",
            "entry_pos",
            "exit_pos",
        )
    )


def as_of_date(targets: DataFrame, target: str, known: DataFrame, known_col: str, out: str) -> DataFrame:
    """For each target date the latest known date on or before it (NULL when none).

    Both sides are date tables. A union with a running maximum replaces the
    inequality join.
    """
    marks = known.select(F.col(known_col).alias("d"), F.col(known_col).alias("k"), F.lit(False).alias("t"))
    asks = targets.select(
        F.col(target).alias("d"), F.lit(None).cast("date").alias("k"), F.lit(True).alias("t")
    ).distinct()
    order = Window.orderBy("d", "t").rowsBetween(Window.unboundedPreceding, 0)  # dates only
    found = marks.distinct().unionByName(asks).withColumn("k", F.max("k").over(order)).where("t")
    return found.select(F.col("d").alias(target), F.col("k").alias(out))
