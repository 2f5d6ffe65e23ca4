"""Statistics and reports on equity curves, trades and positions.

Curves, trades and their reports are small: groups x trading days. Only positions,
closes and sector cells grow with the number of tickers; they are aggregated by
mergeable aggregates before anything is joined to them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfolio.functions.expr import div
from gridfolio.operators.calendar import dealt_join, in_more_parts, per_day

C = F.col
KEY = ["run", "group_id"]
STATS = ["total_return", "cagr", "volatility", "sharpe", "max_drawdown", "final_equity", "pnl", "avg_period_return", "win_rate"]

#: rebalance frequency -> periods per year (fixed values)
PERIODS_PER_YEAR = {"D": 252, "B": 252, "W": 52, "M": 12, "MS": 12, "BM": 12, "BMS": 12, "Q": 4, "QS": 4}


def _line(order: str = "date") -> Window:
    return Window.partitionBy(*KEY).orderBy(order)


def returns(equity: DataFrame) -> DataFrame:
    return equity.withColumn("ret", div(C("equity"), F.lag("equity").over(_line())) - 1.0)


def daily_pnl(equity: DataFrame) -> DataFrame:
    return equity.withColumn("pnl", F.coalesce(C("equity") - F.lag("equity").over(_line()), F.lit(0.0)))


def drawdowns(equity: DataFrame) -> DataFrame:
    peak = F.max("equity").over(_line().rowsBetween(Window.unboundedPreceding, 0))
    return equity.withColumn("drawdown", div(C("equity"), peak) - 1.0)


def normalised(equity: DataFrame) -> DataFrame:
    first = F.first("equity", ignorenulls=True).over(_line().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    scaled = equity.withColumn("index", div(C("equity"), first))
    return scaled.withColumn("cumulative", C("index") - 1.0)


def periods_per_year(n: Column, span_days: Column, freq: str) -> Column:
    usual = float(PERIODS_PER_YEAR.get(freq.upper(), 12))
    gap = div(span_days.cast("double"), (n - 1).cast("double"))
    return (
        F.when(gap.isNull() | (gap <= 0), F.lit(usual))
        .when(gap <= 3, F.lit(252.0))
        .otherwise(F.greatest(F.lit(usual), 365.25 / gap))
    )


def statistics(equity: DataFrame, period_returns: DataFrame, freq: str) -> DataFrame:
    """One row of performance statistics per (run, group).

    ``period_returns`` has (run, group_id, period_return); a group without a curve
    has no row here.
    """
    daily = drawdowns(returns(equity))
    sums = daily.groupBy(*KEY).agg(
        F.min_by("equity", "date").alias("s"),
        F.max_by("equity", "date").alias("e"),
        F.count(F.lit(1)).alias("points"),
        F.date_diff(F.max("date"), F.min("date")).alias("span"),
        F.count("ret").alias("k"),
        F.avg("ret").alias("m"),
        F.stddev_pop("ret").alias("sd"),
        F.min("drawdown").alias("dd"),
        F.avg((C("ret") > 0).cast("double")).alias("win"),
    )
    ppy = periods_per_year(C("points"), C("span"), freq)
    means = period_returns.groupBy(*KEY).agg(F.avg("period_return").alias("pm"))
    full = sums.withColumn("ppy", ppy).join(means, KEY, "left")
    years = C("k") / C("ppy")
    vol = F.coalesce(C("sd") * F.sqrt("ppy"), F.lit(0.0))
    cagr = F.when((years > 0) & (C("s") > 0), F.pow(C("e") / F.nullif(C("s"), F.lit(0.0)), 1.0 / F.nullif(years, F.lit(0.0))) - 1.0)
    zero = F.lit(0.0)
    return full.select(
        *KEY,
        F.coalesce(div(C("e"), C("s")) - 1.0, zero).alias("total_return"),
        F.coalesce(cagr, zero).alias("cagr"),
        vol.alias("volatility"),
        F.coalesce(div(C("m") * C("ppy"), vol), zero).alias("sharpe"),
        F.coalesce("dd", zero).alias("max_drawdown"),
        C("e").alias("final_equity"),
        (C("e") - C("s")).alias("pnl"),
        F.coalesce("pm", zero).alias("avg_period_return"),
        F.coalesce("win", zero).alias("win_rate"),
    )


def net_period_returns(equity: DataFrame) -> DataFrame:
    """Daily returns of the net curve with a leading 0."""
    net = returns(equity.where(C("group_id") == "net"))
    return net.select(*KEY, F.coalesce("ret", F.lit(0.0)).alias("period_return"))


def month_closes(equity: DataFrame) -> DataFrame:
    """Last value per calendar month; the date is the calendar month end."""
    return equity.groupBy(*KEY, F.last_day("date").alias("date")).agg(F.max_by("equity", "date").alias("equity"))


def monthly_returns(equity: DataFrame) -> DataFrame:
    """Long monthly returns: previous month end, month end, return."""
    closes = month_closes(equity)
    line = _line()
    out = closes.select(
        *KEY, F.lag("date").over(line).alias("entry_date"), C("date").alias("exit_date"),
        (div(C("equity"), F.lag("equity").over(line)) - 1.0).alias("monthly_return"),
    )
    return out.where(C("monthly_return").isNotNull())


def last_months(monthly: DataFrame, n: int) -> DataFrame:
    line = Window.partitionBy(*KEY).orderBy(C("exit_date").desc())
    return monthly.withColumn("_n", F.row_number().over(line)).where(C("_n") <= n).drop("_n")


def month_matrix(monthly: DataFrame) -> DataFrame:
    """year x month with all twelve columns ``m1`` ... ``m12``."""
    month = F.concat(F.lit("m"), F.month("exit_date").cast("string"))
    named = monthly.select(*KEY, F.year("exit_date").alias("year"), month.alias("month"), "monthly_return")
    return named.groupBy(*KEY, "year").pivot("month", [f"m{i}" for i in range(1, 13)]).agg(F.max("monthly_return"))


def monthly_summary(monthly: DataFrame) -> DataFrame:
    return monthly.groupBy(*KEY).agg(
        F.avg("monthly_return").alias("monthly_avg_return"),
        F.avg((C("monthly_return") > 0).cast("double")).alias("monthly_win_rate"),
    )


def excess(monthly: DataFrame, bench_monthly: DataFrame) -> DataFrame:
    """Group minus benchmark for every month that either has; a missing side counts as 0.

    The benchmark's months, a row each, are laid out for every group and added up with the group's own.
    """
    months = bench_monthly.agg(F.collect_list(F.struct("exit_date", (-C("monthly_return")).alias("excess")))).scalar()
    bench = monthly.select(*KEY).distinct().select(*KEY, F.explode(months).alias("m")).select(*KEY, "m.*")
    own = monthly.select(*KEY, "exit_date", C("monthly_return").alias("excess"))
    return own.unionByName(bench).groupBy(*KEY, "exit_date").agg(F.coalesce(F.sum("excess"), F.lit(0.0)).alias("excess"))


def histogram(values: DataFrame, value: str, bins: Column | None = None) -> DataFrame:
    """Counts per equal-width bin of [min, max]; the last bin is closed.

    The number of bins is n/10, kept between 15 and 40. Moments come from one
    aggregate per key.
    """
    lo_hi = values.groupBy(*KEY).agg(
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")
    )
    k = F.greatest(F.lit(15), F.least(F.lit(40), F.floor(C("n") / 10))) if bins is None else bins
    flat = C("lo") == C("hi")
    lo_hi = lo_hi.select(
        *KEY,
        F.when(flat, C("lo") - 0.5).otherwise(C("lo")).alias("lo"),
        F.when(flat, C("hi") + 0.5).otherwise(C("hi")).alias("hi"),
        k.cast("int").alias("bins"),
    )
    return _bin(values.join(lo_hi, KEY), value, KEY)


def _bin(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    at = F.floor((C(value) - C("lo")) / ((C("hi") - C("lo")) / C("bins")))
    binned = df.where(C(value).isNotNull()).withColumn("bin", F.least(at, C("bins") - 1).cast("int"))
    return binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def shared_histogram(values: DataFrame, value: str, edges: int = 50) -> DataFrame:
    """Counts of each curve of a run over bins that the curves of the run share."""
    span = values.groupBy("run").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    flat = C("lo") == C("hi")
    span = span.select("run", F.when(flat, C("lo") - 0.1).otherwise(C("lo")).alias("lo"), F.when(flat, C("hi") + 0.1).otherwise(C("hi")).alias("hi"))
    pad = (C("hi") - C("lo")) * 0.05
    span = span.select("run", (C("lo") - pad).alias("lo"), (C("hi") + pad).alias("hi"), F.lit(edges - 1).alias("bins"))
    return _bin(values.join(span, "run"), value, KEY)


def headline(stats: DataFrame) -> DataFrame:
    """Best group by pnl, sharpe and win rate, and the primary one (net, else best pnl).

    A tie goes to the first group; the net curve comes last.
    """
    place = [(C("group_id") == "net").alias("n"), F.length("group_id").alias("l"), C("group_id").alias("g")]
    best = stats.groupBy("run").agg(
        *[F.min(F.struct((-C(m)).alias("m"), *place))["g"].alias(f"best_{m}") for m in ("pnl", "sharpe", "win_rate")],
        F.max(C("group_id") == "net").alias("has_net"),
    )
    return best.withColumn("primary", F.when(C("has_net"), "net").otherwise(C("best_pnl"))).drop("has_net")


def paired_returns(left: DataFrame, right: DataFrame) -> DataFrame:
    """Returns of two curves on their shared dates."""
    a = returns(left).where(C("ret").isNotNull()).select("date", C("ret").alias("left_ret"))
    b = returns(right).where(C("ret").isNotNull()).select("date", C("ret").alias("right_ret"))
    return a.join(per_day(b, "date"), "date")


def tracking(pairs: DataFrame, threshold: float = 0.99) -> DataFrame:
    """Correlation of the paired returns (NULL for a flat curve) and whether it passes."""
    spread = F.stddev_pop("left_ret") * F.stddev_pop("right_ret")
    corr = pairs.agg(div(F.covar_pop("left_ret", "right_ret"), spread).alias("correlation"))
    return corr.withColumn("passed", F.coalesce(C("correlation") > threshold, F.lit(False)).cast("int"))


# ------------------------------------------------------------------ positions


def with_sector(positions: DataFrame, sector_cells: DataFrame) -> DataFrame:
    """Sector of each position on its entry date."""
    dates = positions.select("entry_date").distinct()
    cells = sector_cells.select("ticker", C("date").alias("entry_date"), "sector")
    cells = cells.join(per_day(dates, "entry_date"), "entry_date", "left_semi")
    return dealt_join(positions, cells, ["ticker", "entry_date"], "left")


def sector_weights(positions: DataFrame, value: str = "entry_value") -> DataFrame:
    """Share of each sector per entry date, 0 where a date lacks a sector."""
    sums = positions.where(C("sector").isNotNull()).groupBy(*KEY, "entry_date", "sector").agg(F.sum(value).alias("v"))
    total = F.sum("v").over(Window.partitionBy(*KEY, "entry_date"))
    shares = sums.select(*KEY, "entry_date", "sector", (C("v") / total).alias("weight"))
    dates, names = shares.select(*KEY, "entry_date").distinct(), shares.select(*KEY, "sector").distinct()
    dense = dates.join(names, KEY)
    return dense.join(shares, [*KEY, "entry_date", "sector"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def sector_attribution(positions: DataFrame, capital: float) -> DataFrame:
    """Gain per (exit date, sector) over the initial capital, and its running sum."""
    gains = positions.where(C("sector").isNotNull()).groupBy("run", "exit_date", "sector").agg(
        F.sum(C("exit_value") - C("entry_value")).alias("pnl")
    )
    dense = gains.select("run", "exit_date").distinct().join(gains.select("run", "sector").distinct(), "run")
    full = dense.join(gains, ["run", "exit_date", "sector"], "left")
    share = F.coalesce("pnl", F.lit(0.0)) / capital
    line = Window.partitionBy("run", "sector").orderBy("exit_date").rowsBetween(Window.unboundedPreceding, 0)
    return full.select("run", "exit_date", "sector", share.alias("contribution")).withColumn(
        "cumulative", F.sum("contribution").over(line)
    )


def sector_picks(cands: DataFrame) -> DataFrame:
    """Per window and sector the tickers with the highest and lowest realised return."""
    ret = div(C("exit"), C("entry")) - 1.0
    known = cands.withColumn("ret", ret).where(C("ret").isNotNull() & C("sector").isNotNull())
    picks = known.groupBy("window_id", "sector").agg(
        F.min(F.struct((-C("ret")).alias("r"), "ticker")).alias("b"), F.min(F.struct(C("ret").alias("r"), "ticker")).alias("w")
    )
    return picks.select(
        "window_id", "sector", C("b.ticker").alias("long_ticker"), (-C("b.r")).alias("long_return"),
        C("w.ticker").alias("short_ticker"), C("w.r").alias("short_return"),
    )


def stability(holdings: DataFrame) -> DataFrame:
    """Mean Jaccard similarity of consecutive holdings per (leg, sector).

    ``holdings``: leg, sector, entry_date, ticker. A name is in both sets when its
    own previous date is the previous date of its sector, so there is no self join.
    """
    held = in_more_parts(holdings, "leg", "sector", "ticker").distinct()
    sizes = held.groupBy("leg", "sector", "entry_date").agg(F.count(F.lit(1)).alias("n"))
    line = Window.partitionBy("leg", "sector").orderBy("entry_date")  # dates only
    steps = sizes.withColumn("prev_date", F.lag("entry_date").over(line)).withColumn("prev_n", F.lag("n").over(line))
    own = Window.partitionBy("leg", "sector", "ticker").orderBy("entry_date")
    stays = held.withColumn("own_prev", F.lag("entry_date").over(own)).where(C("own_prev").isNotNull())
    kept = stays.groupBy("leg", "sector", "entry_date", "own_prev").agg(F.count(F.lit(1)).alias("both"))
    kept = kept.withColumnRenamed("own_prev", "prev_date")
    joined = steps.where(C("prev_date").isNotNull()).join(kept, ["leg", "sector", "entry_date", "prev_date"], "left")
    both = F.coalesce("both", F.lit(0))
    return joined.groupBy("leg", "sector").agg(F.avg(both / (C("n") + C("prev_n") - both)).alias("jaccard"))


def price_audit(positions: DataFrame, closes: DataFrame, tolerance: float) -> DataFrame:
    """Trade prices that differ from the close panel."""
    price = closes.select("ticker", "date", C("close").alias("market_price"))
    sides = F.explode(
        F.array(
            F.struct(C("entry_date").alias("date"), F.lit("ENTRY").alias("type"), C("entry_price").alias("trade_price")),
            F.struct(C("exit_date").alias("date"), F.lit("EXIT").alias("type"), C("exit_price").alias("trade_price")),
        )
    )
    long = positions.select(*KEY, "ticker", sides.alias("s")).select(*KEY, "ticker", "s.*")
    price = price.join(per_day(long.select("date").distinct(), "date"), "date", "left_semi")
    joined = long.join(price, ["ticker", "date"]).withColumn("diff", F.abs(C("trade_price") - C("market_price")))
    return joined.where(C("diff") > tolerance)


def latest_holdings(positions: DataFrame) -> DataFrame:
    """Positions of the last trade of each group with their weights."""
    last = positions.groupBy(*KEY).agg(F.max("entry_date").alias("entry_date"))
    kept = positions.join(last, [*KEY, "entry_date"], "left_semi")
    return kept.withColumn("weight", F.coalesce(div(C("entry_value"), C("capital_in")), F.lit(0.0)))


def window_net_returns(legs: DataFrame, net: DataFrame, trades: DataFrame) -> DataFrame:
    """Gross of the legs and the net curve at the ends of every window."""
    spans = trades.select("run", "entry_date", "exit_date").distinct()
    gross = legs.groupBy("run", C("date").alias("entry_date")).agg(F.sum("equity").alias("gross"))
    curve = net.select("run", "date", "equity")
    opened = curve.select("run", C("date").alias("entry_date"), C("equity").alias("entry_equity"))
    closed = curve.select("run", C("date").alias("exit_date"), C("equity").alias("exit_equity"))
    joined = spans.join(gross, ["run", "entry_date"]).join(opened, ["run", "entry_date"]).join(closed, ["run", "exit_date"])
    return joined.withColumn("net_return", F.coalesce(div(C("exit_equity"), C("entry_equity")) - 1.0, F.lit(0.0)))
