"""Registered queries: portfolio formation, returns, equity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfolio.functions.expr import rounded, significant, trailing
from gridfolio.operators import evaluation as ev
from gridfolio.operators import portfolio as pf
from gridfolio.operators.calendar import dense_grid, rebalance_schedule, rebalance_windows
from gridfolio.operators.panels import forward_fill
from gridfolio.plans.portfolio_sql import portfolio_views
from gridfolio.plans.registry import query
from gridfolio.plans.views_sql import r, sig
from gridfolio.sources import tables
from gridfolio.sources.store import stored

C = F.col
COSTS = pf.Costs(2.0, 2.0, 15.0)
BPS = (2.0, 2.0, 15.0)


def panel(spark, sf, models: list[str]) -> DataFrame:
    """Grid with closes, forward-filled opens, scores and caps."""
    cells = tables.with_scores(tables.grid(spark, sf, values=["open", "close", "amount"]), models)
    cells = cells.withColumn("cap", F.sum("amount").over(trailing(52))).drop("amount")
    return forward_fill(cells, ["open", "cap", *[f"score_{m}" for m in models]])


_EVALUATIONS: dict[tuple, pf.Evaluation] = {}
_PANELS: dict[tuple, DataFrame] = {}


def forget() -> None:
    """Drop what queries of one session share; ``store.release`` deletes the tables themselves."""
    _EVALUATIONS.clear()
    _PANELS.clear()


def shared_panel(spark, sf) -> DataFrame:
    """The stored panel of one session; every evaluation of the session reads it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _PANELS:
        _PANELS[key] = stored(panel(spark, sf, ["a", "b", "c"]), "panel")
    return _PANELS[key]


def run(spark, sf, rules: pf.Rules, models=None, freq: str = "M", lag: int = 0) -> pf.Evaluation:
    """The evaluation of these rules; queries of one session that ask for the same one share it."""
    models = models or {"all": "score_b"}
    key = (spark.sparkContext.applicationId, sf, repr(rules), tuple(models.items()), freq, lag)
    if key not in _EVALUATIONS:
        cal = tables.bar_calendar(spark, sf)
        sector = tables.sectors(spark, sf) if rules.sector_neutral else None
        _EVALUATIONS[key] = pf.Evaluation(
            shared_panel(spark, sf), cal, rebalance_windows(cal, freq, lag), models, rules, sector
        )
    return _EVALUATIONS[key]


BASE = pf.Rules(costs=COSTS)
DN = pf.Rules(costs=COSTS, enabled=(0, 4), dollar_neutral=True)
CAP = pf.Rules(costs=COSTS, weighting="cap", entry_price="open")
FIX = pf.Rules(top_n=10, bottom_n=10, min_assets=20, costs=COSTS)
SN = pf.Rules(quantiles=4, min_assets=8, sector_neutral=True, sector_unit=True, weighting="cap", costs=COSTS)
IDX = pf.Rules(quantiles=1, min_assets=20, weighting="cap", long_short="off")
MINS = pf.Rules(min_score=0.1, min_assets=40, costs=COSTS)

portfolio_views("pb", bps=BPS)
portfolio_views("dn", bps=BPS, groups=(1, 5), dollar_neutral=True)
portfolio_views("cp", bps=BPS, weighting="cap", entry="open")
portfolio_views("fx", bps=BPS, top_n=10, bottom_n=10, groups=(1, 5), lag=1)
portfolio_views("sn", bps=BPS, quantiles=4, groups=(1, 2, 3, 4), min_assets=8, sector_neutral=True, sector_unit=True, weighting="cap")
portfolio_views("ix", score="cap", quantiles=1, groups=(1,), shorts=(), weighting="cap")
portfolio_views("ms", bps=BPS, min_score=0.1, min_assets=40)
portfolio_views("mk", bps=BPS, masked=True)


def masked(spark, sf) -> pf.Evaluation:
    """The base rules over panels as a user has them: long tables, masked by the members of the universe."""
    key = (spark.sparkContext.applicationId, sf, "masked")
    if key in _EVALUATIONS:
        return _EVALUATIONS[key]
    # each is read several times below
    bars = stored(tables.bars(spark, sf).select("ticker", "date", "open", "close", "amount"), "bars")
    cal = stored(tables.bar_calendar(spark, sf), "calendar")
    cells = dense_grid(bars, cal, ["close", "amount"])
    scores = stored(tables.scores(spark, sf, ["b"], cells).select("date", "ticker", "score"), "scores")
    caps = tables.market_caps(spark, sf, cells).where(C("cap").isNotNull()).select("date", "ticker", C("cap").alias("value"))
    members = stored(tables.universe(spark, sf, cells, cal), "universe")
    close, opens = (bars.select("date", "ticker", C(c).alias("value")) for c in ("close", "open"))
    _EVALUATIONS[key] = ev.evaluate(ev.build_panel({"all": scores}, close, opens=opens, caps=caps, universe=members), BASE)
    return _EVALUATIONS[key]


@query("pf30_masked_groups", "select entry_date, gid as group_id, ticker from mk_mem")
def pf30(spark, sf):
    bt = masked(spark, sf)
    return member_cols(bt.members, bt.windows).select("entry_date", "group_id", "ticker")


@query("pf31_masked_growth", f"select gid as group_id, entry_date, exit_date, {r('f', 9)} as factor from mk_f")
def pf31(spark, sf):
    return masked(spark, sf).growth.select("group_id", "entry_date", "exit_date", rounded(C("factor"), 9).alias("factor"))


def base(spark, sf) -> pf.Evaluation:
    return run(spark, sf, BASE)


def member_cols(df: DataFrame, windows: DataFrame) -> DataFrame:
    dates = windows.select("window_id", "entry_date").distinct()
    return df.join(dates, "window_id")


@query("pf1_quantile_groups", "select entry_date, gid as group_id, ticker from pb_mem")
def pf1(spark, sf):
    bt = base(spark, sf)
    return member_cols(bt.members, bt.windows).select("entry_date", "group_id", "ticker")


@query("pf2_fixed_count_groups", "select entry_date, gid as group_id, ticker from fx_mem")
def pf2(spark, sf):
    bt = run(spark, sf, FIX, lag=1)
    return member_cols(bt.members, bt.windows).select("entry_date", "group_id", "ticker")


@query(
    "pf3_explicit_groups",
    """select entry_date, unnest(list_filter([case when score > m + s then 'hot' end, case when score < m - s then 'cold' end,
            case when score > 0 then 'up' end], lambda x: x is not null)) as group_id, ticker
       from (select *, avg(score) over (partition by wid) as m, stddev_samp(score) over (partition by wid) as s
             from pb_cand where score is not null)""",
)
def pf3(spark, sf):
    chosen = {
        "hot": C("score") > C("mean_score") + C("std_score"),
        "cold": C("score") < C("mean_score") - C("std_score"),
        "up": C("score") > 0,
    }
    bt = run(spark, sf, pf.Rules(selectors=chosen))
    return member_cols(bt.members, bt.windows).select("entry_date", "group_id", "ticker")


@query("pf4_sector_neutral_groups", "select entry_date, sector, gid as group_id, ticker from sn_mem")
def pf4(spark, sf):
    bt = run(spark, sf, SN)
    return member_cols(bt.members, bt.windows).select("entry_date", "sector", "group_id", "ticker")


@query(
    "pf5_skip_notes",
    """select w.entry_date, coalesce(c.n, 0) as n_scores, case when coalesce(c.a, 0) = 0 then 'No assets had valid scores.'
        when coalesce(c.n, 0) = 0 then 'No assets met minimum score >= 0.1.'
        when c.n < 5 then 'Not enough assets to form quantiles.'
        when c.n < 40 then 'Asset count ' || c.n || ' fell below minimum 40.' end as note
       from ms_win w left join (select wid, count(score) as a, count(case when score >= 0.1 then 1 end) as n
                                from ms_cand group by wid) c on c.wid = w.wid""",
)
def pf5(spark, sf):
    return run(spark, sf, MINS).notes.select("entry_date", C("n").alias("n_scores"), "note")


@query(
    "pf6_rebalance_schedule",
    " union all ".join(
        f"select '{f}' as freq, date from (select max(date) as date from cal_w group by {g} union select max(date) from cal_w)"
        for f, g in (("M", "date_trunc('month', date)"), ("Q", "date_trunc('quarter', date)"), ("Y", "date_trunc('year', date)"), ("W", "date"))
    ),
)
def pf6(spark, sf):
    cal = tables.bar_calendar(spark, sf)
    out = None
    for f in ("M", "Q", "Y", "W"):
        part = rebalance_schedule(cal, f).select(F.lit(f).alias("freq"), "date")
        out = part if out is None else out.unionByName(part)
    return out


@query("pf7_rebalance_windows", "select signal_date, entry_date, exit_date from fx_win")
def pf7(spark, sf):
    return run(spark, sf, FIX, lag=1).windows.select("signal_date", "entry_date", "exit_date")


@query("pf8_window_payload", f"select entry_date, ticker, {r('score')} as score, {r('cap', 2)} as cap, entry as entry_price, exit as exit_price from cp_cand")
def pf8(spark, sf):
    bt = run(spark, sf, CAP)
    return member_cols(bt.candidates, bt.windows).select(
        "entry_date", "ticker", rounded(C("score")).alias("score"), rounded(C("cap"), 2).alias("cap"),
        C("entry").alias("entry_price"), C("exit").alias("exit_price"),
    )


def weights_of(bt: pf.Evaluation) -> DataFrame:
    return member_cols(bt.positions.where(C("share") > 0), bt.windows).select(
        "entry_date", "group_id", "ticker", rounded(C("share"), 9).alias("weight")
    )


def weights_sql(t: str) -> str:
    return f"select entry_date, gid as group_id, ticker, {r('share', 9)} as weight from {t}_pos where share > 0"


@query("pf9_cap_weights", weights_sql("cp"))
def pf9(spark, sf):
    return weights_of(run(spark, sf, CAP))


@query("pf9_equal_weights", weights_sql("pb"))
def pf9_equal(spark, sf):
    return weights_of(base(spark, sf))


@query("pf10_sector_unit_weights", weights_sql("sn"))
def pf10(spark, sf):
    return weights_of(run(spark, sf, SN))


@query(
    "pf11_valid_prices",
    f"""select entry_date, gid as group_id, ticker, {r('x')} as price_ratio, cast(kept as integer) as kept,
        cast(halted as integer) as halted from pb_prc""",
)
def pf11(spark, sf):
    bt = base(spark, sf)
    return member_cols(bt.positions, bt.windows).select(
        "entry_date", "group_id", "ticker", rounded(C("x")).alias("price_ratio"),
        C("kept").cast("int").alias("kept"), C("halted").cast("int").alias("halted"),
    )


@query(
    "pf12_trading_costs",
    f"""select entry_date, gid as group_id, n_halted, {r('frac')} as tradable, {r('gross')} as gross,
        {r('f')} as factor from pb_f where n_pos is not null""",
)
def pf12(spark, sf):
    g = base(spark, sf).growth.where(C("n_positions").isNotNull())
    return g.select(
        "entry_date", "group_id", "n_halted", rounded(C("tradable")).alias("tradable"),
        rounded(C("gross")).alias("gross"), rounded(C("factor")).alias("factor"),
    )


@query(
    "pf13_position_table",
    f"""select entry_date, exit_date, gid as group_id, ticker, {sig('qty')} as quantity, entry as entry_price,
        xu as exit_price, {sig('ev')} as entry_value, {sig('xv')} as exit_value from pb_tab""",
)
def pf13(spark, sf):
    t = pf.position_table(base(spark, sf))
    return t.select(
        "entry_date", "exit_date", "group_id", "ticker", significant(C("quantity")).alias("quantity"),
        "entry_price", "exit_price",
        significant(C("entry_value")).alias("entry_value"), significant(C("exit_value")).alias("exit_value"),
    )


def growth_sql(t: str) -> str:
    return f"select entry_date, exit_date, gid as group_id, {r('f', 9)} as factor from {t}_f"


def growth_of(bt: pf.Evaluation) -> DataFrame:
    return bt.growth.select("entry_date", "exit_date", "group_id", rounded(C("factor"), 9).alias("factor"))


@query("pf14_window_growth", growth_sql("pb"))
def pf14(spark, sf):
    return growth_of(base(spark, sf))


@query("pf14_window_growth_cap_open", growth_sql("cp"))
def pf14_cap(spark, sf):
    return growth_of(run(spark, sf, CAP))


@query("pf14_window_growth_sector_unit", growth_sql("sn"))
def pf14_sn(spark, sf):
    return growth_of(run(spark, sf, SN))


@query(
    "pf15_daily_path",
    f"select w.entry_date, p.gid as group_id, p.pos, {r('p.v', 9)} as value from pb_path p join pb_win w on w.wid = p.wid",
)
def pf15(spark, sf):
    bt = base(spark, sf)
    return member_cols(bt.paths, bt.windows).select(
        "entry_date", "group_id", "pos", rounded(C("value"), 9).alias("value")
    )


@query(
    "pf16_equity_floor",
    f"""select w.entry_date, p.gid as group_id, {r('min(p.v)', 9)} as low, cast(min(p.v) <= 0 as integer) as floored
        from pb_path p join pb_win w on w.wid = p.wid group by 1, 2""",
)
def pf16(spark, sf):
    bt = base(spark, sf)
    lows = bt.paths.groupBy("window_id", "group_id").agg(F.min("value").alias("low"))
    return member_cols(lows, bt.windows).select(
        "entry_date", "group_id", rounded(C("low"), 9).alias("low"), (C("low") <= 0).cast("int").alias("floored")
    )


@query("pf17_carry_forward", f"select entry_date, gid as group_id, {r('f')} as factor, {r('pr')} as period_return from ms_trd where n_pos is null")
def pf17(spark, sf):
    t = run(spark, sf, MINS).trades.where(C("n_positions").isNull())
    return t.select("entry_date", "group_id", rounded(C("factor")).alias("factor"), rounded(C("period_return")).alias("period_return"))


@query(
    "pf18_trades",
    f"""select t.entry_date, t.exit_date, gid as group_id, {sig('cin')} as capital_in, {sig('cout')} as capital_out,
        {r('pr')} as period_return, case when n_pos is null or cin <= 0 then coalesce(s.note, 'No eligible tickers for this portfolio group.')
            when n_halted > 0 then 'Held positions for ' || n_halted || ' halted tickers.' end as note
        from ms_trd t left join (select w.wid, case when coalesce(c.n, 0) = 0 then 'No assets met minimum score >= 0.1.'
            when c.n < 5 then 'Not enough assets to form quantiles.'
            when c.n < 40 then 'Asset count ' || c.n || ' fell below minimum 40.' end as note
            from ms_win w left join (select wid, count(case when score >= 0.1 then 1 end) as n from ms_cand group by wid) c
            on c.wid = w.wid) s on s.wid = t.wid""",
)
def pf18(spark, sf):
    bt = run(spark, sf, MINS)
    return pf.trade_notes(bt.trades, bt.notes).select(
        "entry_date", "exit_date", "group_id", significant(C("capital_in")).alias("capital_in"),
        significant(C("capital_out")).alias("capital_out"), rounded(C("period_return")).alias("period_return"), "note",
    )


@query("pf18_halted_names", "select entry_date, gid as group_id, ticker from pb_prc where halted")
def pf18_names(spark, sf):
    """The names a trade note counts, those dropped for a wild price included."""
    return pf.halted_names(base(spark, sf)).select("entry_date", "group_id", "ticker")


def equity_sql(t: str, where: str = "true") -> str:
    return f"select gid as group_id, date, {sig('eq')} as equity from {t}_eq where {where}"


def equity_of(bt: pf.Evaluation) -> DataFrame:
    return bt.equity.select("group_id", "date", significant(C("equity")).alias("equity"))


@query("pf19_equity", equity_sql("pb", "gid <> 'net'"))
def pf19(spark, sf):
    return equity_of(base(spark, sf)).where(C("group_id") != "net")


@query("pf19_equity_fixed_lagged", equity_sql("fx"))
def pf19_fix(spark, sf):
    return equity_of(run(spark, sf, FIX, lag=1))


@query("pf20_dollar_neutral", f"select entry_date, gid as group_id, {sig('cin')} as capital_in, {sig('cout')} as capital_out from dn_trd")
def pf20(spark, sf):
    t = run(spark, sf, DN).trades
    return t.select("entry_date", "group_id", significant(C("capital_in")).alias("capital_in"), significant(C("capital_out")).alias("capital_out"))


@query("pf21_net_curve", equity_sql("dn", "gid = 'net'"))
def pf21(spark, sf):
    return equity_of(run(spark, sf, DN)).where(C("group_id") == "net")


portfolio_views("pl", bps=BPS, groups=(1, 5))


@query("pf22_leg_display", equity_sql("dn", "gid = 'net'") + " union all " + equity_sql("pl", "gid <> 'net'"))
def pf22(spark, sf):
    net = equity_of(run(spark, sf, DN)).where(C("group_id") == "net")
    legs = equity_of(run(spark, sf, pf.without_dollar_neutral(DN)))
    return net.unionByName(legs)


portfolio_views("lo", bps=BPS, groups=(1, 5), shorts=())


@query("pf23_sides_off", growth_sql("lo"))
def pf23(spark, sf):
    return growth_of(run(spark, sf, pf.Rules(costs=COSTS, enabled=(0, 4), long_short="off")))


@query(
    "pf26_leg_equity",
    f"""select case when gid = 'q1' then 'short' else 'long' end as leg, date, {sig('sum(eq)')} as equity
        from pb_eqg group by 1, 2""",
)
def pf26(spark, sf):
    legs = pf.leg_equity(base(spark, sf).equity, BASE)
    return legs.select(C("group_id").alias("leg"), "date", significant(C("equity")).alias("equity"))


@query(
    "pf27_weight_matrix",
    f"""select gid as group_id, entry_date, ticker, {r('ev / cin * case when qty < 0 then -1 else 1 end', 9)} as weight from pb_tab""",
)
def pf27(spark, sf):
    w = pf.weight_table(pf.position_table(base(spark, sf)))
    return w.select("group_id", "entry_date", "ticker", rounded(C("weight"), 9).alias("weight"))
