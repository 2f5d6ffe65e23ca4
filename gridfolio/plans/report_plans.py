"""Registered queries: statistics, reports, sector evaluations, scenario sweeps."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfolio.functions.expr import rounded, significant
from gridfolio.operators import alignment as al
from gridfolio.operators import portfolio as pf
from gridfolio.operators import reports as rp
from gridfolio.operators.calendar import dealt_join, per_day, rebalance_windows
from gridfolio.plans import portfolio_plans as pp
from gridfolio.plans.portfolio_plans import BASE, BPS, CAP, COSTS, DN, IDX, run
from gridfolio.plans.portfolio_sql import portfolio_views
from gridfolio.plans.registry import query
from gridfolio.plans.views_sql import r, sig, view
from gridfolio.sources import tables
from gridfolio.sources.store import new_path, stored

C = F.col
L = "(partition by run, gid order by date)"
LP = "(partition by run, gid order by date rows between unbounded preceding and current row)"


def curve_views(t: str) -> None:
    """Returns, drawdowns, month closes and statistics of one evaluation's curves."""
    view(
        f"{t}_ret",
        f"""select *, eq / nullif(lag(eq) over {L}, 0) - 1 as r, eq - lag(eq) over {L} as d,
            eq / nullif(max(eq) over {LP}, 0) - 1 as dd, eq / nullif(first_value(eq) over {L}, 0) as ix from {t}_eq""",
    )
    view(
        f"{t}_mon",
        f"""select run, gid, lag(date) over {L} as entry_date, date as exit_date, eq / nullif(lag(eq) over {L}, 0) - 1 as mr
            from (select run, gid, last_day(date) as date, arg_max(eq, date) as eq from {t}_eq group by 1, 2, last_day(date))
            qualify mr is not null""",
    )
    view(
        f"{t}_pr",
        f"select run, gid, pr from {t}_trd union all select run, gid, coalesce(r, 0) from {t}_ret where gid = 'net'",
    )
    stats_view(t, f"{t}_ret", f"(select run, gid, avg(pr) as pm from {t}_pr group by 1, 2)")


def stats_view(t: str, ret: str, means: str, usual: int = 12) -> None:
    view(
        f"{t}_st",
        f"""select run, gid, coalesce(e / nullif(s, 0) - 1, 0) as total_return,
            case when k > 0 and s > 0 then pow(e / s, ppy / k) - 1 else 0 end as cagr,
            coalesce(sd * sqrt(ppy), 0) as volatility, coalesce(m * ppy / nullif(sd * sqrt(ppy), 0), 0) as sharpe,
            coalesce(dd, 0) as max_drawdown, e as final_equity, e - s as pnl, coalesce(pm, 0) as avg_period_return, coalesce(win, 0) as win_rate
        from (select *, case when gap is null or gap <= 0 then {usual} when gap <= 3 then 252.0::double else greatest({usual}, 365.25::double / gap) end as ppy
          from (select q.*, p.pm, span / nullif(points - 1, 0)::double as gap
            from (select run, gid, arg_min(eq, date) as s, arg_max(eq, date) as e, count(*) as points,
                datediff('day', min(date), max(date))::double as span, count(r) as k, avg(r) as m, stddev_pop(r) as sd, min(dd) as dd,
                avg(case when r > 0 then 1.0 when r is not null then 0.0 end) as win from {ret} group by 1, 2) q
            left join {means} p on p.run = q.run and p.gid = q.gid))""",
    )


for _t in ("pb", "dn", "cp"):
    curve_views(_t)
STAT_SQL = ", ".join(f"{sig(s)} as {s}" for s in rp.STATS)


def stat_cols(df: DataFrame, *keys) -> DataFrame:
    return df.select(*keys, *[significant(C(s)).alias(s) for s in rp.STATS])


def period_returns(bt: pf.Evaluation) -> DataFrame:
    legs = bt.trades.select("run", "group_id", "period_return")
    return legs.unionByName(rp.net_period_returns(bt.equity)) if bt.rules.netted else legs


def base(spark, sf):
    return run(spark, sf, BASE)


# ------------------------------------------------------------------ curves


@query("wn13_daily_pnl", f"select gid as group_id, date, {sig('coalesce(d, 0)')} as pnl from pb_ret")
def wn13(spark, sf):
    return rp.daily_pnl(base(spark, sf).equity).select("group_id", "date", significant(C("pnl")).alias("pnl"))


@query("wn14_drawdown", f"select gid as group_id, date, {r('dd')} as drawdown from pb_ret")
def wn14(spark, sf):
    return rp.drawdowns(base(spark, sf).equity).select("group_id", "date", rounded(C("drawdown")).alias("drawdown"))


@query("wn15_normalised", f"select gid as group_id, date, {sig('ix')} as index, {sig('ix - 1')} as cumulative from pb_ret")
def wn15(spark, sf):
    out = rp.normalised(base(spark, sf).equity)
    return out.select("group_id", "date", significant(C("index")).alias("index"), significant(C("cumulative")).alias("cumulative"))


@query("agg14_statistics", f"select gid as group_id, {STAT_SQL} from pb_st")
def agg14(spark, sf):
    bt = base(spark, sf)
    return stat_cols(rp.statistics(bt.equity, period_returns(bt), "M"), "group_id")


@query(
    "agg15_periods_per_year",
    f"""select gid as group_id, freq, {r('case when gap <= 3 then 252 else greatest(usual, 365.25::double / gap) end')} as periods from (
        select gid, datediff('day', min(date), max(date)) / (count(*) - 1)::double as gap from pb_eq group by gid),
        (select unnest(['D', 'W', 'M', 'Q', 'X']) as freq, unnest([252, 52, 12, 4, 12]) as usual)""",
)
def agg15(spark, sf):
    spans = base(spark, sf).equity.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n"), F.date_diff(F.max("date"), F.min("date")).alias("span")
    )
    rows = F.explode(
        F.array(*[F.struct(F.lit(f).alias("freq"), rp.periods_per_year(C("n"), C("span"), f).alias("p")) for f in "DWMQX"])
    )
    return spans.select("group_id", rows.alias("r")).select("group_id", "r.freq", rounded(C("r.p")).alias("periods"))


# ------------------------------------------------------------------ benchmark

view(
    "bench_eq",
    """select 'all' as run, 'benchmark' as gid, date, value / first_value(value) over (order by date) * 1000000.0 as eq from (
        select c.date, last_value(b.value ignore nulls) over (order by c.pos) as value from cal_w c left join benchmark_w b on b.date = c.date
        where c.date >= (select min(date) from wide_scores where score_b is not null)) where value is not null""",
)
view(
    "bench_ret",
    f"select *, eq / nullif(lag(eq) over {L}, 0) - 1 as r, eq / nullif(max(eq) over {LP}, 0) - 1 as dd from bench_eq",
)
stats_view("bench", "bench_ret", "(select run, gid, avg(r) as pm from bench_ret group by 1, 2)")
view(
    "bench_mon",
    f"""select run, gid, date as exit_date, eq / nullif(lag(eq) over {L}, 0) - 1 as mr
        from (select run, gid, last_day(date) as date, arg_max(eq, date) as eq from bench_eq group by 1, 2, last_day(date)) qualify mr is not null""",
)


def benchmark(spark, sf, bt: pf.Evaluation) -> DataFrame:
    """Index curve on the dates of the evaluation, scaled to the initial capital."""
    panel = pp.shared_panel(spark, sf)
    first = panel.where(C("score_b").isNotNull()).agg(F.min("date")).scalar()
    kept = tables.index_level(spark, sf, panel).where(C("date") >= first)
    curve = al.scale_to_capital(kept, tables.bar_calendar(spark, sf), bt.rules.capital)
    return curve.select(F.lit("all").alias("run"), F.lit("benchmark").alias("group_id"), "pos", "date", "equity")


def bench_stats(bench: DataFrame) -> DataFrame:
    own = rp.returns(bench).where(C("ret").isNotNull()).select("run", "group_id", C("ret").alias("period_return"))
    return rp.statistics(bench, own, "M")


@query(
    "agg16_benchmark_statistics",
    f"""select {STAT_SQL}, {r('(select avg(mr) from bench_mon)')} as monthly_avg_return,
        {r('(select avg(cast(mr > 0 as integer)) from bench_mon)')} as monthly_win_rate from bench_st""",
)
def agg16(spark, sf):
    bench = benchmark(spark, sf, base(spark, sf))
    monthly = rp.monthly_summary(rp.monthly_returns(bench))
    joined = bench_stats(bench).join(monthly, ["run", "group_id"])
    return stat_cols(joined, rounded(C("monthly_avg_return")).alias("monthly_avg_return"), rounded(C("monthly_win_rate")).alias("monthly_win_rate"))


SUMMARY_SQL = f"select gid as portfolio, {STAT_SQL} from (select * from pb_st union all select * from bench_st)"


def summary(spark, sf) -> DataFrame:
    bt = base(spark, sf)
    groups = rp.statistics(bt.equity, period_returns(bt), "M")
    return groups.unionByName(bench_stats(benchmark(spark, sf, bt)))


@query("agg17_summary_table", SUMMARY_SQL)
def agg17(spark, sf):
    return stat_cols(summary(spark, sf), C("group_id").alias("portfolio"))


@query("top7_sorted_summary", SUMMARY_SQL + " order by total_return desc")
def top7(spark, sf):
    return stat_cols(summary(spark, sf).orderBy(C("total_return").desc()), C("group_id").alias("portfolio"))


@query("jn21_common_date_pairs", f"select a.date, {r('a.r')} as strategy, {r('b.r')} as bench from pb_ret a join bench_ret b on b.date = a.date where a.gid = 'q5' and a.r is not null and b.r is not null")
def jn21(spark, sf):
    bt = base(spark, sf)
    pairs = rp.paired_returns(bt.equity.where(C("group_id") == "q5"), benchmark(spark, sf, bt))
    return pairs.select("date", rounded(C("left_ret")).alias("strategy"), rounded(C("right_ret")).alias("bench"))


view("ix_ret", f"select *, eq / nullif(lag(eq) over {L}, 0) - 1 as r from ix_eqg")
view("bench_all", "select date, value / nullif(lag(value) over (order by date), 0) - 1 as r from benchmark_w")


@query(
    "agg18_return_correlation",
    f"""select {r('c')} as correlation, cast(coalesce(c > 0.99, false) as integer) as passed from (
        select covar_pop(a.r, b.r) / nullif(stddev_pop(a.r) * stddev_pop(b.r), 0) as c
        from ix_ret a join bench_all b on b.date = a.date where a.r is not null and b.r is not null)""",
)
def agg18(spark, sf):
    bt = run(spark, sf, IDX, {"all": "cap"})
    curve = al.scale_to_capital(tables.index_level(spark, sf), tables.bar_calendar(spark, sf), 1.0)
    bench = curve.select(F.lit("all").alias("run"), F.lit("b").alias("group_id"), "date", "equity")
    pairs = rp.paired_returns(bt.equity, bench)
    return rp.tracking(pairs).withColumn("correlation", rounded(C("correlation")))


@query("pf29_index_tracking", pp.equity_sql("ix", "gid <> 'net'"))
def pf29(spark, sf):
    return pp.equity_of(run(spark, sf, IDX, {"all": "cap"}))


@query(
    "agg20_return_histogram",
    """select gid as group_id, cast(least(floor((v - lo) / ((hi - lo) / bins)), bins - 1) as integer) as bin, count(*) as n from (
        select *, min(v) over g - case when min(v) over g = max(v) over g then 0.5 else 0 end as lo,
            max(v) over g + case when min(v) over g = max(v) over g then 0.5 else 0 end as hi, cast(greatest(15, least(40, floor(count(v) over g / 10))) as integer) as bins
        from (select gid, pr * 100 as v from pb_pr) window g as (partition by gid)) group by 1, 2""",
)
def agg20(spark, sf):
    values = period_returns(base(spark, sf)).withColumn("v", C("period_return") * 100.0)
    return rp.histogram(values, "v").select("group_id", "bin", "n")


@query(
    "agg21_headline_picks",
    "select "
    + ", ".join(
        f"(select gid from pb_st order by {m} desc, gid = 'net', length(gid), gid limit 1) as best_{m}" for m in ("pnl", "sharpe", "win_rate")
    )
    + """, 'net' as "primary\"""",
)
def agg21(spark, sf):
    bt = base(spark, sf)
    return rp.headline(rp.statistics(bt.equity, period_returns(bt), "M")).drop("run")


# ------------------------------------------------------------------ monthly reports


@query("rep1_equity_return_frames", "select date, " + ", ".join(f"{sig(f"max(case when gid = 'q{i}' then eq end)")} as q{i}" for i in range(1, 6)) + f", {sig("max(case when gid = 'net' then eq end)")} as net from pb_eq group by date")
def rep1(spark, sf):
    names = [*(f"q{i}" for i in range(1, 6)), "net"]
    wide = base(spark, sf).equity.groupBy("date").pivot("group_id", names).agg(F.max("equity"))
    return wide.select("date", *[significant(C(n)).alias(n) for n in names])


MONTH_SQL = ", ".join(f"{r(f'max(case when month(exit_date) = {i} then mr end)')} as m{i}" for i in range(1, 13))


@query("rep2_monthly_matrix", f"select gid as group_id, year(exit_date) as year, {MONTH_SQL} from pb_mon group by 1, 2")
def rep2(spark, sf):
    out = rp.month_matrix(rp.monthly_returns(base(spark, sf).equity))
    return out.select("group_id", "year", *[rounded(C(f"m{i}")).alias(f"m{i}") for i in range(1, 13)])


LAST_SQL = "select * from pb_mon qualify row_number() over (partition by run, gid order by exit_date desc) <= 12"


@query("top5_last_months", f"select gid as group_id, exit_date, {r('mr')} as monthly_return from ({LAST_SQL})")
def top5(spark, sf):
    out = rp.last_months(rp.monthly_returns(base(spark, sf).equity), 12)
    return out.select("group_id", "exit_date", rounded(C("monthly_return")).alias("monthly_return"))


@query("rep4_monthly_summary", f"select gid as group_id, {r('avg(mr)')} as monthly_avg_return, {r('avg(cast(mr > 0 as integer))')} as monthly_win_rate from pb_mon group by 1")
def rep4(spark, sf):
    out = rp.monthly_summary(rp.monthly_returns(base(spark, sf).equity))
    return out.select("group_id", rounded(C("monthly_avg_return")).alias("monthly_avg_return"), rounded(C("monthly_win_rate")).alias("monthly_win_rate"))


BENCH_LAST = "select exit_date, mr from bench_mon qualify row_number() over (order by exit_date desc) <= 12"


@query(
    "rep5_excess_matrix",
    f"""select c.gid as group_id, c.exit_date, {r('coalesce(p.mr, 0) - coalesce(b.mr, 0)')} as excess
        from (select gid, exit_date from ({LAST_SQL}) union select g.gid, b.exit_date from (select distinct gid from pb_mon) g cross join ({BENCH_LAST}) b) c
        left join ({LAST_SQL}) p on p.gid = c.gid and p.exit_date = c.exit_date left join ({BENCH_LAST}) b on b.exit_date = c.exit_date""",
)
def rep5(spark, sf):
    bt = base(spark, sf)
    recent = rp.last_months(rp.monthly_returns(bt.equity), 12)
    out = rp.excess(recent, rp.last_months(rp.monthly_returns(benchmark(spark, sf, bt)), 12))
    return out.select("group_id", "exit_date", rounded(C("excess")).alias("excess"))


# ------------------------------------------------------------------ positions

view(
    "sector_cells",
    """select t.ticker, c.pos, c.date, last_value(s.sector ignore nulls) over (partition by t.ticker order by c.pos) as sector
       from (select distinct ticker from sector_w) t cross join cal_w c left join sector_w s on s.ticker = t.ticker and s.date = c.date""",
)


def sector_cells(spark, sf) -> DataFrame:
    return al.align_to_calendar(tables.sectors(spark, sf), tables.bar_calendar(spark, sf), ["sector"])


def held(spark, sf, rules: pf.Rules) -> DataFrame:
    return rp.with_sector(pf.position_table(run(spark, sf, rules)), sector_cells(spark, sf))


def tab(t: str) -> str:
    return f"(select p.* exclude (sector), s.sector from {t}_tab p left join sector_cells s on s.ticker = p.ticker and s.date = p.entry_date)"


@query("jn18_position_metadata", f"select gid as group_id, entry_date, exit_date, ticker, {sig('ev')} as entry_value, {r('score')} as score, sector from {tab('pb')} where ticker in ('1', '10', '20', '33')")
def jn18(spark, sf):
    rows = held(spark, sf, BASE).where(C("ticker").isin("1", "10", "20", "33"))
    return rows.orderBy("entry_date", "exit_date", "ticker").select(
        "group_id", "entry_date", "exit_date", "ticker", significant(C("entry_value")).alias("entry_value"), rounded(C("score")).alias("score"), "sector"
    )


@query("rep6_trade_price_audit", f"""select gid as group_id, date, type, ticker, trade_price, market_price from (
        select p.gid, p.entry_date as date, 'ENTRY' as type, p.ticker, p.entry as trade_price, g.close as market_price from cp_tab p join grid_w g on g.ticker = p.ticker and g.date = p.entry_date
        union all select p.gid, p.exit_date, 'EXIT', p.ticker, p.xu, g.close from cp_tab p join grid_w g on g.ticker = p.ticker and g.date = p.exit_date)
        where abs(trade_price - market_price) > 1e-6""")
def rep6(spark, sf):
    closes = pp.shared_panel(spark, sf).select("ticker", "date", "close")
    out = rp.price_audit(pf.position_table(run(spark, sf, CAP)), closes, 1e-6)
    return out.select("group_id", "date", "type", "ticker", "trade_price", "market_price")


LATEST_SQL = "(select *, ev / nullif(cin, 0) as weight from pb_tab where (gid, entry_date) in (select gid, max(entry_date) from pb_tab group by gid))"


@query("top3_latest_holdings", f"select gid as group_id, ticker, {sig('qty')} as quantity, {r('weight')} as weight from {LATEST_SQL}")
def top3(spark, sf):
    out = rp.latest_holdings(pf.position_table(base(spark, sf))).orderBy("group_id", C("weight").desc(), "ticker")
    return out.select("group_id", "ticker", significant(C("quantity")).alias("quantity"), rounded(C("weight")).alias("weight"))


@query("top4_tickers_above_weight", f"select gid as group_id, ticker from {LATEST_SQL} where weight >= 0.08")
def top4(spark, sf):
    return rp.latest_holdings(pf.position_table(base(spark, sf))).where(C("weight") >= 0.08).select("group_id", "ticker")


@query(
    "agg10_sector_weights",
    f"""with v as (select gid, entry_date, sector, sum(ev) as v from {tab('pb')} where sector is not null group by 1, 2, 3)
        select d.gid as group_id, d.entry_date, n.sector, {r('coalesce(v.v / t.t, 0)')} as weight from (select distinct gid, entry_date from v) d
        join (select distinct gid, sector from v) n on n.gid = d.gid join (select gid, entry_date, sum(v) as t from v group by 1, 2) t
        on t.gid = d.gid and t.entry_date = d.entry_date left join v on v.gid = d.gid and v.entry_date = d.entry_date and v.sector = n.sector""",
)
def agg10(spark, sf):
    out = rp.sector_weights(held(spark, sf, BASE))
    return out.select("group_id", "entry_date", "sector", rounded(C("weight")).alias("weight"))


@query(
    "agg11_sector_attribution",
    f"""with v as (select exit_date, sector, sum(xv - ev) as v from {tab('dn')} where sector is not null group by 1, 2)
        select d.exit_date, n.sector, {sig('coalesce(v.v, 0) / 1000000')} as contribution,
            {sig('sum(coalesce(v.v, 0) / 1000000) over (partition by n.sector order by d.exit_date)')} as cumulative
        from (select distinct exit_date from v) d cross join (select distinct sector from v) n
        left join v on v.exit_date = d.exit_date and v.sector = n.sector""",
)
def agg11(spark, sf):
    out = rp.sector_attribution(held(spark, sf, DN), DN.capital)
    return out.select("exit_date", "sector", significant(C("contribution")).alias("contribution"), significant(C("cumulative")).alias("cumulative"))


PICK_SQL = f"""select w.signal_date, w.entry_date, w.exit_date, k.sector, long_ticker, {r('long_return')} as long_return, short_ticker,
        {r('short_return')} as short_return from (
        select wid, sector, max(case when up = 1 then ticker end) as long_ticker, max(ret) as long_return,
            max(case when dn = 1 then ticker end) as short_ticker, min(ret) as short_return from (
            select *, row_number() over (partition by wid, sector order by ret desc, ticker) as up,
                row_number() over (partition by wid, sector order by ret, ticker) as dn from (
                select c.wid, c.ticker, s.sector, c.exit / nullif(c.entry, 0) - 1 as ret from pb_cand c
                join sector_cells s on s.ticker = c.ticker and s.date = c.entry_date)
            where ret is not null and sector is not null) group by 1, 2) k join pb_win w on w.wid = k.wid"""


def picks(spark, sf) -> DataFrame:
    bt = base(spark, sf)
    dates = bt.windows.select("window_id", "signal_date", "entry_date", "exit_date")
    cells = sector_cells(spark, sf).select("ticker", C("date").alias("entry_date"), "sector")
    cells = cells.join(per_day(dates.select("entry_date"), "entry_date"), "entry_date", "left_semi")
    cands = dealt_join(bt.candidates.join(per_day(dates, "window_id"), "window_id"), cells, ["ticker", "entry_date"])
    out = rp.sector_picks(cands).join(per_day(dates, "window_id"), "window_id")
    return out.select(
        "signal_date", "entry_date", "exit_date", "sector", "long_ticker", rounded(C("long_return")).alias("long_return"),
        "short_ticker", rounded(C("short_return")).alias("short_return"),
    )


@query("agg12_sector_picks", PICK_SQL)
def agg12(spark, sf):
    return picks(spark, sf)


@query("agg13_one_sector_picks", f"select * from ({PICK_SQL}) where sector = 'ASIA'")
def agg13(spark, sf):
    return picks(spark, sf).where(C("sector") == "ASIA").orderBy("entry_date")


STAB = f"""
    with h as (select distinct case when gid = 'q1' then 'short' else 'long' end as leg, sector, entry_date, ticker from {tab('dn')} where sector is not null
        union select 'all', sector, entry_date, ticker from {tab('dn')} where sector is not null),
    d as (select leg, sector, entry_date, count(*) as n, lag(entry_date) over (partition by leg, sector order by entry_date) as pd,
            lag(count(*)) over (partition by leg, sector order by entry_date) as pn from h group by 1, 2, 3),
    i as (select a.leg, a.sector, a.entry_date, count(b.ticker) as both from h a join d on d.leg = a.leg and d.sector = a.sector and d.entry_date = a.entry_date
            left join h b on b.leg = a.leg and b.sector = a.sector and b.ticker = a.ticker and b.entry_date = d.pd where d.pd is not null group by 1, 2, 3)
    select d.leg, d.sector, avg(i.both / (d.n + d.pn - i.both)::double) as j from d
    join i on i.leg = d.leg and i.sector = d.sector and i.entry_date = d.entry_date group by 1, 2"""
view("stab", STAB)


def holdings(spark, sf) -> DataFrame:
    rows = held(spark, sf, DN).where(C("sector").isNotNull())
    leg = F.when(C("group_id").isin(sorted(DN.short_ids)), "short").otherwise("long")
    return rows.select(F.explode(F.array(leg, F.lit("all"))).alias("leg"), "sector", "entry_date", "ticker")


@query("agg19_selection_stability", f"select leg, sector, {r('j', 9)} as jaccard from stab")
def agg19(spark, sf):
    return rp.stability(holdings(spark, sf)).select("leg", "sector", rounded(C("jaccard"), 9).alias("jaccard"))


# ------------------------------------------------------------------ one evaluation per sector

SEC = pf.Rules(quantiles=3, min_assets=6, enabled=(0, 2), costs=COSTS, dollar_neutral=True)
SEC_OPTS = dict(bps=BPS, quantiles=3, groups=(1, 3), min_assets=6, sector_runs=True)
portfolio_views("sd", dollar_neutral=True, **SEC_OPTS)
portfolio_views("sl", **SEC_OPTS)
curve_views("sd")


def sector_candidates(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Windows and candidates with the sector as the run key: all sectors in one job."""
    key = (spark.sparkContext.applicationId, sf, "sector candidates")
    if key not in pp._PANELS:
        panel = pp.shared_panel(spark, sf)
        one = pf.run_windows(rebalance_windows(tables.bar_calendar(spark, sf), "M"), panel, {"all": "score_b"})
        names = tables.table(spark, sf, "region").agg(F.array_sort(F.collect_set("r_name"))).scalar()
        windows = one.drop("run").withColumn("run", F.explode(names))
        cells = sector_cells(spark, sf).select("ticker", C("date").alias("entry_date"), C("sector").alias("run"))
        cands = pf.candidates(panel, one, {"all": "score_b"}).drop("run")
        dates = one.select("window_id", "entry_date")
        cells = cells.join(per_day(dates.select("entry_date"), "entry_date"), "entry_date", "left_semi")
        placed = dealt_join(cands.join(per_day(dates, "window_id"), "window_id"), cells, ["ticker", "entry_date"])
        placed = placed.where(C("run").isNotNull()).select("run", "window_id", "ticker", "score", "cap", "entry", "exit")
        pp._PANELS[key] = (stored(windows, "sector-windows"), stored(placed, "sector-candidates"))
    return pp._PANELS[key]


def sector_run(spark, sf, rules: pf.Rules) -> pf.Evaluation:
    key = (spark.sparkContext.applicationId, sf, repr(rules), "sector")
    if key not in pp._EVALUATIONS:
        windows, cands = sector_candidates(spark, sf)
        cal = tables.bar_calendar(spark, sf)
        pp._EVALUATIONS[key] = pf.Evaluation(
            pp.shared_panel(spark, sf), cal, windows, {}, rules, cands=cands, windows=windows
        )
    return pp._EVALUATIONS[key]


PLAIN = pf.without_dollar_neutral(SEC)


@query(
    "pf24_sector_runs",
    f"""select run as sector, 'net' as curve, date, {sig('eq')} as equity from sd_eq where gid = 'net'
        union all select run, case when gid = 'q1' then 'short' else 'long' end, date, {sig('eq')} from sl_eqg""",
)
def pf24(spark, sf):
    net = sector_run(spark, sf, SEC).equity.where(C("group_id") == "net")
    legs = rp_legs(spark, sf)
    both = net.select("run", "group_id", "date", "equity").unionByName(legs.select("run", "group_id", "date", "equity"))
    return both.select(C("run").alias("sector"), C("group_id").alias("curve"), "date", significant(C("equity")).alias("equity"))


def rp_legs(spark, sf) -> DataFrame:
    return pf.leg_equity(sector_run(spark, sf, PLAIN).equity, PLAIN)


DN_COLS = "d.ev as dn_ev, d.xv as dn_xv, d.cin as dn_cin, d.cout as dn_cout, d.pr as dn_pr"
view(
    "sd_net",
    """select w.run, w.entry_date, w.exit_date, g.gross, a.eq as e0, b.eq as e1, coalesce(b.eq / nullif(a.eq, 0) - 1, 0) as nr
       from (select distinct run, entry_date, exit_date from sd_trd) w
       join (select run, date, sum(eq) as gross from sd_eqg group by 1, 2) g on g.run = w.run and g.date = w.entry_date
       join sd_eq a on a.run = w.run and a.gid = 'net' and a.date = w.entry_date join sd_eq b on b.run = w.run and b.gid = 'net' and b.date = w.exit_date""",
)


@query(
    "jn20_two_run_positions",
    f"""select p.run as sector, p.gid as group_id, p.entry_date, p.ticker, {sig('p.ev')} as entry_value, {sig('p.xv')} as exit_value,
        {sig('d.ev')} as dn_entry_value, {sig('d.xv')} as dn_exit_value, {sig('n.e0')} as dn_net_equity_entry, {r('n.nr')} as dn_net_return
        from sl_tab p left join sd_tab d on d.run = p.run and d.gid = p.gid and d.wid = p.wid and d.ticker = p.ticker
        left join sd_net n on n.run = p.run and n.entry_date = p.entry_date and n.exit_date = p.exit_date""",
)
def jn20(spark, sf):
    """Every position of the first run; what the second run does not hold is NULL beside it."""
    return compared(spark, sf).select(
        C("run").alias("sector"), "group_id", "entry_date", "ticker", *[significant(C(c)).alias(c) for c in ("entry_value", "exit_value", "dn_entry_value", "dn_exit_value", "dn_net_equity_entry")],
        rounded(C("dn_net_return")).alias("dn_net_return"),
    )


def compared(spark, sf) -> DataFrame:
    """Plain positions beside the dollar-neutral ones and the net of their window."""
    plain = pf.position_table(sector_run(spark, sf, PLAIN))
    twin = pf.position_table(sector_run(spark, sf, SEC))
    keys = ["run", "window_id", "group_id", "ticker"]
    other = twin.select(*keys, C("entry_value").alias("dn_entry_value"), C("exit_value").alias("dn_exit_value"), C("trade_return").alias("dn_trade_return"))
    bt = sector_run(spark, sf, SEC)
    net = rp.window_net_returns(bt.equity.where(C("group_id") != "net"), bt.equity.where(C("group_id") == "net"), bt.trades)
    net = net.select("run", "entry_date", "exit_date", C("gross").alias("dn_net_gross"), C("entry_equity").alias("dn_net_equity_entry"), C("exit_equity").alias("dn_net_equity_exit"), C("net_return").alias("dn_net_return"))
    return plain.join(other, keys, "left").join(net, ["run", "entry_date", "exit_date"], "left")


@query(
    "pf25_sector_holdings",
    f"""select p.entry_date, p.exit_date, case when p.gid = 'q1' then 'short' else 'long' end as side, p.ticker, p.entry as entry_price, p.xu as exit_price,
        {r('p.xv / nullif(p.ev, 0) - 1')} as position_return, {r('d.pr')} as dn_trade_return from sl_tab p
        left join sd_tab d on d.run = p.run and d.gid = p.gid and d.wid = p.wid and d.ticker = p.ticker where p.run = 'EUROPE'""",
)
def pf25(spark, sf):
    rows = compared(spark, sf).where(C("run") == "EUROPE")
    side = F.when(C("group_id").isin(sorted(SEC.short_ids)), "short").otherwise("long")
    back = F.coalesce(C("exit_value") / F.nullif(C("entry_value"), F.lit(0.0)) - 1.0, F.lit(0.0))
    return rows.select(
        "entry_date", "exit_date", side.alias("side"), "ticker", "entry_price", "exit_price", rounded(back).alias("position_return"), rounded(C("dn_trade_return")).alias("dn_trade_return")
    )


@query("rep8_window_net_returns", f"select run as sector, entry_date, exit_date, {sig('gross')} as gross, {sig('e0')} as entry_equity, {sig('e1')} as exit_equity, {r('nr')} as net_return from sd_net")
def rep8(spark, sf):
    bt = sector_run(spark, sf, SEC)
    out = rp.window_net_returns(bt.equity.where(C("group_id") != "net"), bt.equity.where(C("group_id") == "net"), bt.trades)
    return out.select(C("run").alias("sector"), "entry_date", "exit_date", *[significant(C(c)).alias(c) for c in ("gross", "entry_equity", "exit_equity")], rounded(C("net_return")).alias("net_return"))


@query("rep3_sector_monthly", f"select run as sector, entry_date, exit_date, {r('mr')} as monthly_return from sd_mon where gid = 'net'")
def rep3(spark, sf):
    net = sector_run(spark, sf, SEC).equity.where(C("group_id") == "net")
    return rp.monthly_returns(net).select(C("run").alias("sector"), "entry_date", "exit_date", rounded(C("monthly_return")).alias("monthly_return"))


@query(
    "rep7_sector_report",
    f"""select s.run as sector, {', '.join(f'{sig(f"s.{c}")} as {c}' for c in rp.STATS)}, {r('coalesce(m.a, 0)')} as monthly_avg_return, {r('coalesce(m.w, 0)')} as monthly_win_rate,
        {r('j.comp', 9)} as comp_j, {r('j.lj', 9)} as long_j, {r('j.sj', 9)} as short_j from sd_st s
        left join (select run, avg(mr) as a, avg(cast(mr > 0 as integer)) as w from sd_mon where gid = 'net' group by run) m on m.run = s.run
        left join (select sector, max(case when leg = 'all' then j end) as comp, max(case when leg = 'long' then j end) as lj, max(case when leg = 'short' then j end) as sj
            from stab group by 1) j on j.sector = s.run where s.gid = 'net'""",
)
def rep7(spark, sf):
    bt = sector_run(spark, sf, SEC)
    net = bt.equity.where(C("group_id") == "net")
    stats = rp.statistics(net, rp.net_period_returns(net), "M")
    monthly = rp.monthly_summary(rp.monthly_returns(net))
    legs = rp.stability(holdings(spark, sf)).groupBy(C("sector").alias("run")).pivot("leg", ["all", "long", "short"]).agg(F.max("jaccard"))
    out = stats.join(monthly, ["run", "group_id"], "left").join(legs, "run", "left")
    return stat_cols(
        out, C("run").alias("sector"), rounded(F.coalesce("monthly_avg_return", F.lit(0.0))).alias("monthly_avg_return"),
        rounded(F.coalesce("monthly_win_rate", F.lit(0.0))).alias("monthly_win_rate"), rounded(C("all"), 9).alias("comp_j"),
        rounded(C("long"), 9).alias("long_j"), rounded(C("short"), 9).alias("short_j"),
    )


view("sec_leg", "select run, 'net' as gid, date, eq from sd_eq where gid = 'net' union all select run, case when gid = 'q1' then 'short' else 'long' end, date, eq from sl_eqg")


@query(
    "agg20_sector_histogram",
    f"""select run as sector, gid as leg, cast(least(floor((v - lo) / ((hi - lo) / 49)), 48) as integer) as bin, count(*) as n from (
        select run, gid, v, a - (b - a) * 0.05::double as lo, b + (b - a) * 0.05::double as hi from (
        select *, min(v) over p - case when min(v) over p = max(v) over p then 0.1 else 0 end as a,
            max(v) over p + case when min(v) over p = max(v) over p then 0.1 else 0 end as b from (
        select run, gid, (eq / nullif(lag(eq) over {L}, 0) - 1) * 100 as v from sec_leg) window p as (partition by run))) where v is not null group by 1, 2, 3""",
)
def agg20_sector(spark, sf):
    net = sector_run(spark, sf, SEC).equity.where(C("group_id") == "net").select("run", "group_id", "date", "equity")
    curves = net.unionByName(rp_legs(spark, sf).select("run", "group_id", "date", "equity"))
    values = rp.returns(curves).withColumn("v", C("ret") * 100.0)
    return rp.shared_histogram(values, "v").select(C("run").alias("sector"), C("group_id").alias("leg"), "bin", "n")


# ------------------------------------------------------------------ several runs

portfolio_views("wa", bps=BPS, score="score_a")
portfolio_views("wc", bps=BPS, score="score_c")
MODELS = {"a": "score_a", "b": "score_b", "c": "score_c"}
SWEEP_SQL = " union all ".join(f"select '{n}' as run, gid as group_id, entry_date, exit_date, {r('f', 9)} as factor from {t}_f" for n, t in (("a", "wa"), ("b", "pb"), ("c", "wc"), ("b_cap", "cp")))


def sweep(spark, sf) -> DataFrame:
    """Three score models in one evaluation, and one more option set, as rows of one table."""
    trio = run(spark, sf, BASE, MODELS).growth
    caps = run(spark, sf, CAP).growth.withColumn("run", F.lit("b_cap"))
    cols = ["run", "group_id", "entry_date", "exit_date", "factor"]
    return trio.select(*cols).unionByName(caps.select(*cols))


@query("pf28_scenario_sweep", SWEEP_SQL)
def pf28(spark, sf):
    return sweep(spark, sf).withColumn("factor", rounded(C("factor"), 9))


@query("set2_union_of_runs", " union all ".join(f"select '{n}:q5' as portfolio, date, {sig('eq')} as equity from {t}_eqg where gid = 'q5'" for n, t in (("a", "wa"), ("b", "pb"), ("c", "wc"))))
def set2(spark, sf):
    curves = run(spark, sf, BASE, MODELS).equity.where(C("group_id") == "q5")
    return curves.select(F.concat_ws(":", "run", "group_id").alias("portfolio"), "date", significant(C("equity")).alias("equity"))


@query("snk5_report_tables", SUMMARY_SQL)
def snk5(spark, sf):
    path = new_path(spark, "report")
    stat_cols(summary(spark, sf), C("group_id").alias("portfolio")).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    rows = spark.read.schema("portfolio string, " + ", ".join(f"{s} double" for s in rp.STATS)).option("header", True).csv(f"{path}/csv")
    rows.write.mode("overwrite").json(f"{path}/json")
    return spark.read.schema(rows.schema).json(f"{path}/json")


def flagship(spark, sf, min_assets: int = 5) -> DataFrame:
    """Quintile portfolios compounded over monthly windows, with their statistics."""
    bt = run(spark, sf, replace(BASE, min_assets=min_assets))
    return stat_cols(rp.statistics(bt.equity, period_returns(bt), "M"), "group_id")
