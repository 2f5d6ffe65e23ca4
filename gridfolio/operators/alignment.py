"""Alignment of panels to a calendar and as-of lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridfolio.operators.calendar import as_of_date, dense_grid, per_day
from gridfolio.operators.panels import forward_fill

C = F.col


def align_fields(first: DataFrame, others: Sequence[DataFrame], excluded: DataFrame | None = None) -> DataFrame:
    """Fields reindexed to the (date, ticker) cells of the first one, as doubles."""
    out = first if excluded is None else first.join(excluded.select("ticker"), "ticker", "left_anti")
    for other in others:
        out = out.join(other, ["date", "ticker"], "left")
    values = [c for c in out.columns if c not in ("date", "ticker")]
    return out.select("date", "ticker", *[C(v).cast("double").alias(v) for v in values])


def align_to_calendar(panel: DataFrame, calendar: DataFrame, values: Sequence[str] = ("value",)) -> DataFrame:
    """Reindex to the calendar and forward fill per ticker, cell by cell.

    Dates of the panel that are not in the calendar are lost before the fill.
    """
    return forward_fill(dense_grid(panel, calendar, list(values)), list(values))


def align_scores(scores: DataFrame, calendar: DataFrame, prices: DataFrame, symbol: str | None = None) -> DataFrame:
    """Scores on the price calendar: common tickers, filled, from the first date with any score."""
    known = prices.select("ticker").distinct()
    common = scores.join(known, "ticker", "left_semi")
    if symbol:
        common = common.where(C("ticker") != symbol)
    if common.isEmpty():
        raise ValueError("no ticker has both scores and prices")
    if calendar.limit(2).count() < 2:
        raise ValueError("an evaluation needs two dates or more")
    filled = align_to_calendar(common, calendar, ["score"])
    start = common.join(per_day(calendar.select("date"), "date"), "date", "left_semi").agg(F.min("date")).scalar()
    return filled.where(C("date") >= start)


def align_optional(panel: DataFrame, calendar: DataFrame, target: DataFrame, value: str) -> DataFrame:
    """A second panel on the cells of ``target``; NULL outside."""
    return target.join(align_to_calendar(panel, calendar, [value]).drop("date"), ["ticker", "pos"], "left")


def membership_mask(universe: DataFrame, calendar: DataFrame) -> DataFrame:
    """Filled membership per cell, NULL -> 0, for tickers that are a member at least once."""
    ever = universe.where(C("member") > 0).select("ticker").distinct()
    if ever.isEmpty():
        raise ValueError("no ticker is ever a member of the universe")
    filled = align_to_calendar(universe.join(ever, "ticker", "left_semi"), calendar, ["member"])
    return filled.select("ticker", "pos", F.coalesce("member", F.lit(0.0)).alias("member"))


def apply_mask(panel: DataFrame, mask: DataFrame, masked: Sequence[str]) -> DataFrame:
    """Masked columns become NULL outside the universe; other columns (closes) stay.

    Tickers that are never a member are dropped by the inner join.
    """
    joined = panel.join(mask, ["ticker", "pos"])
    keep = [c for c in panel.columns if c not in masked]
    return joined.select(*keep, *[F.when(C("member") > 0, C(c)).alias(c) for c in masked])


def as_of_rows(panel: DataFrame, targets: DataFrame, target: str = "target") -> DataFrame:
    """The whole latest panel row (all tickers of one date) on or before each target date."""
    found = as_of_date(targets, target, panel.select("date").distinct(), "date", "as_of")
    rows = panel.join(per_day(found.where(C("as_of").isNotNull()).withColumnRenamed("as_of", "date"), "date"), "date")
    return rows.withColumnRenamed("date", "as_of")


def missing_rows(panel: DataFrame, targets: DataFrame, target: str = "target") -> DataFrame:
    """Target dates without an exact panel row (an error for entry prices)."""
    return targets.join(panel.select(C("date").alias(target)).distinct(), target, "left_anti")


def as_of_position(targets: DataFrame, calendar: DataFrame, lag: int, target: str = "target") -> DataFrame:
    """Calendar date ``lag`` positions after the last one on or before the target."""
    found = as_of_date(targets, target, calendar, "date", "as_of")
    at = found.join(per_day(calendar.select(C("date").alias("as_of"), C("pos").alias("p")), "as_of"), "as_of", "left")
    ahead = calendar.select(C("date").alias("entry_date"), (C("pos") - lag).alias("p"))
    return at.join(per_day(ahead, "p"), "p", "left").select(target, "as_of", "entry_date")


def fresh_bars(valid: DataFrame, target: str, max_age_days: int, rows_needed: int) -> DataFrame:
    """Per ticker the last valid bar on or before the target date, unless older than the limit
    or preceded by too few valid rows."""
    day = F.lit(target).cast("date")
    last = valid.where(C("date") <= day).groupBy("ticker").agg(
        F.max("date").alias("date"), F.count(F.lit(1)).alias("n_rows")
    )
    age = F.date_diff(day, C("date"))
    return last.where((age <= max_age_days) & (C("n_rows") >= rows_needed)).withColumn("age", age)


def as_of_many(
    facts: DataFrame, targets: DataFrame, carry: Sequence[str] = (), *, max_age_days: int | None = None, rows_needed: int = 1
) -> DataFrame:
    """Per ticker and target date the last fact on or before it: (target, ticker, date, age, n_rows, carried columns).

    ``facts`` has a row per (ticker, date), ``targets`` a column ``target``; any number of dates is one job. A fact
    answers for the targets from its date to the day before the next fact of its ticker, or to the age limit if that
    is sooner, so rows arise only for answers: neither an inequality join nor a row per ticker and target is
    made. Facts preceded by too few rows, themselves included, answer nothing.
    """
    numbered = targets.select(C("target").cast("date").alias("target")).where("target is not null").distinct()
    numbered = numbered.withColumn("no", F.row_number().over(Window.orderBy("target")))  # dates only
    line = Window.partitionBy("ticker").orderBy("date")
    placed = facts.select("ticker", "date", *carry, F.row_number().over(line).alias("n_rows"), F.lead("date").over(line).alias("next"))
    until = F.date_sub(C("next"), 1)
    if max_age_days is not None:
        limit = F.date_add(C("date"), max_age_days)
        until = F.coalesce(F.least(until, limit), limit)
    placed = placed.where(C("n_rows") >= rows_needed).withColumn("until", until)
    # how many targets lie before a date, for all dates of the calendar from the first target to the last
    span = numbered.agg(F.min("target").alias("a"), F.max("target").alias("b")).where("a is not null")
    every = span.select(F.explode(F.sequence("a", "b")).alias("day"), "b").join(per_day(numbered, "target"), C("day") == C("target"), "left")
    upto = every.select("day", F.max("no").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), C("no").isNotNull().alias("hit"))
    first, last = span.select("a").scalar(), span.select("b").scalar()
    begin, end = F.greatest(C("date"), first), F.least(F.coalesce("until", last), last)
    inside = placed.withColumns({"begin": begin, "end": end}).where("begin <= end")
    lows = upto.select(C("day").alias("begin"), (C("upto") + 1 - C("hit").cast("int")).alias("lo"))
    highs = upto.select(C("day").alias("end"), C("upto").alias("hi"))
    found = inside.join(per_day(lows, "begin"), "begin").join(per_day(highs, "end"), "end").where("lo <= hi")
    answers = found.withColumn("no", F.explode(F.sequence("lo", "hi"))).join(per_day(numbered, "no"), "no")
    return answers.select("target", "ticker", "date", F.date_diff("target", "date").alias("age"), "n_rows", *carry)


def join_on_cells(parts: Sequence[DataFrame]) -> DataFrame:
    """Inner join of sample tables on (date, ticker)."""
    return reduce(lambda left, right: left.join(right, ["date", "ticker"]), parts)


def cells_of_all(rows: DataFrame, key: str, values: dict[str, object], value: str) -> DataFrame:
    """One column per entry of ``values``: ``value`` of the row whose ``key`` it names, for cells that have them all.

    The inner join of one table per key, written as one aggregate of one pass. A cell has one row per key.
    """
    mine = {out: C(key) == F.lit(v) for out, v in values.items()}
    wide = rows.where(C(key).isin(list(values.values()))).groupBy("date", "ticker").agg(
        *[F.max(F.when(m, C(value))).alias(out) for out, m in mine.items()], *[F.count(F.when(m, 1)).alias(f"_{out}") for out, m in mine.items()]
    )
    return wide.where(reduce(lambda a, b: a & b, [C(f"_{out}") > 0 for out in mine])).select("date", "ticker", *mine)


def common_tickers(flows: Sequence[DataFrame], metric: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """Tickers with flow data in any window (of the given years) that the metric panel has too."""

    def seen(df: DataFrame, value: str | None) -> DataFrame:
        kept = df if years is None else df.where(F.year("date").isin(list(years)))
        return (kept if value is None else kept.where(C(value).isNotNull())).select("ticker").distinct()

    union = reduce(lambda a, b: a.unionByName(b), [seen(f, "value") for f in flows]).distinct()
    return union.join(metric.select("ticker").distinct(), "ticker", "left_semi")


def scale_to_capital(index: DataFrame, calendar: DataFrame, capital: float) -> DataFrame:
    """An index on the calendar: forward filled, leading gap dropped, first value = capital."""
    line = index.select(F.lit("index").alias("ticker"), "date", "value")
    filled = align_to_calendar(line, calendar).where(C("value").isNotNull())
    whole = Window.partitionBy("ticker").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return filled.withColumn("first", F.first("value").over(whole)).where(C("first") != 0).select(
        "date", "pos", (C("value") / C("first") * capital).alias("equity")
    )


def value_as_of(curve: DataFrame, targets: DataFrame, value: str = "equity", target: str = "target") -> DataFrame:
    """Value at the date, else the last before it, else the first (date tables only)."""
    found = as_of_date(targets, target, curve, "date", "as_of")
    at = found.join(per_day(curve.select(C("date").alias("as_of"), C(value).alias("at")), "as_of"), "as_of", "left")
    first = curve.agg(F.min_by(value, "date").alias("f")).scalar()
    return at.select(target, F.coalesce("at", first).alias(value))
