"""Registered queries: many option sets, long histories and many dates, each in one job; a user's own strategy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfolio.functions.expr import full_window, rounded, significant
from gridfolio.operators import alignment as al
from gridfolio.operators import blocks as bl
from gridfolio.operators import cleaning as cl
from gridfolio.operators import portfolio as pf
from gridfolio.operators import samples as sm
from gridfolio.operators import scoring as sc
from gridfolio.operators.calendar import per_day, period_start
from gridfolio.operators.evaluation import Data
from gridfolio.operators.scenarios import Scenarios
from gridfolio.operators.strategies import ChosenGroups
from gridfolio.plans import portfolio_plans as pp
from gridfolio.plans.feature_plans import EWM_SQL, FEATURE_SQL, fr
from gridfolio.plans.portfolio_plans import BPS, COSTS, member_cols
from gridfolio.plans.portfolio_sql import portfolio_views
from gridfolio.plans.registry import CHECKS, query
from gridfolio.plans.report_plans import MODELS
from gridfolio.plans.sample_plans import HEIGHT, LOOK, N, chart_base
from gridfolio.plans.sample_plans import _win_sql as win_sql
from gridfolio.plans.sample_plans import _windows as training
from gridfolio.plans.scoring_plans import res
from gridfolio.plans.source_plans import vendor_sheet
from gridfolio.plans.views_sql import r, sig, view
from gridfolio.sources import sheets, tables, wide
from gridfolio.sources.store import let_tasks_import, new_path

C = F.col

# ------------------------------------------------------------------ option sets as rows

DEAR = pf.Costs(10.0, 10.0, 30.0)
#: name -> options of one evaluation, and the SQL views that check each of its runs
OPTION_SETS: dict[str, tuple[dict, dict[str, str]]] = {
    "base": (dict(costs=COSTS, models=["a", "b", "c"]), {"a": "wa", "b": "pb", "c": "wc"}),
    "neutral": (dict(costs=COSTS, enabled=(0, 4), dollar_neutral=True, models=["b"]), {"b": "dn"}),
    "caps": (dict(costs=COSTS, weighting="cap", entry_price="open", models=["b"]), {"b": "cp"}),
    "ends": (dict(top_n=10, bottom_n=10, min_assets=20, costs=COSTS, lag=1, models=["b"]), {"b": "fx"}),
    "sectors": (dict(quantiles=4, min_assets=8, sector_neutral=True, sector_unit=True, weighting="cap", costs=COSTS, models=["b"]), {"b": "sn"}),
    "minimum": (dict(min_score=0.1, min_assets=40, costs=COSTS, models=["b"]), {"b": "ms"}),
    "legs": (dict(costs=COSTS, enabled=(0, 4), long_short="legs", models=["b"]), {"b": "pl"}),
    "longs": (dict(costs=COSTS, enabled=(0, 4), long_short="off", models=["b"]), {"b": "lo"}),
    "index": (dict(quantiles=1, min_assets=20, weighting="cap", long_short="off", models=["cap"]), {"cap": "ix"}),
    "thirds": (dict(quantiles=3, min_assets=9, models=["a"]), {"a": "o3"}),
    "tenths": (dict(quantiles=10, min_assets=10, costs=COSTS, models=["b"]), {"b": "o10"}),
    "quarterly": (dict(freq="Q", costs=COSTS, models=["b"]), {"b": "oq"}),
    "late": (dict(lag=2, costs=COSTS, models=["a"]), {"a": "ol"}),
    "dear": (dict(costs=DEAR, models=["b"]), {"b": "od"}),
    "few": (dict(top_n=3, bottom_n=3, min_assets=6, costs=COSTS, models=["c"]), {"c": "ow"}),
    "positive": (dict(min_score=0.0, min_assets=5, models=["c"]), {"c": "op"}),
    "inside": (dict(quantiles=2, min_assets=4, sector_neutral=True, costs=COSTS, models=["a"]), {"a": "oi"}),
    "caps_c": (dict(weighting="cap", costs=COSTS, models=["c"]), {"c": "oc"}),
    "halves": (dict(quantiles=2, min_assets=2, dollar_neutral=True, models=["a"]), {"a": "oh"}),
    "rich": (dict(quantiles=4, capital=5e7, costs=COSTS, models=["a"]), {"a": "or4"}),
}
portfolio_views("o3", score="score_a", quantiles=3, groups=(1, 2, 3), min_assets=9)
portfolio_views("o10", bps=BPS, quantiles=10, groups=tuple(range(1, 11)), min_assets=10)
portfolio_views("oq", bps=BPS, unit="quarter")
portfolio_views("ol", score="score_a", bps=BPS, lag=2)
portfolio_views("od", bps=(10.0, 10.0, 30.0))
portfolio_views("ow", score="score_c", bps=BPS, top_n=3, bottom_n=3, groups=(1, 5), min_assets=6)
portfolio_views("op", score="score_c", min_score=0.0, min_assets=5)
portfolio_views("oi", score="score_a", bps=BPS, quantiles=2, groups=(1, 2), min_assets=4, sector_neutral=True)
portfolio_views("oc", score="score_c", bps=BPS, weighting="cap")
portfolio_views("oh", score="score_a", quantiles=2, groups=(1, 2), min_assets=2, dollar_neutral=True)
portfolio_views("or4", score="score_a", bps=BPS, quantiles=4, groups=(1, 2, 3, 4), capital=5e7)

VIEWS_OF = {f"{name}:{model}": t for name, (_, checked) in OPTION_SETS.items() for model, t in checked.items()}


def scenarios(spark, sf) -> Scenarios:
    """All option sets over the session's panel; queries of one session share the tables."""
    key = (spark.sparkContext.applicationId, sf, "option sets")
    if key not in pp._EVALUATIONS:
        data = Data(pp.shared_panel(spark, sf), tables.bar_calendar(spark, sf), {**MODELS, "cap": "cap"}, sectors=tables.sectors(spark, sf))
        pp._EVALUATIONS[key] = Scenarios(data, {name: options for name, (options, _) in OPTION_SETS.items()})
    return pp._EVALUATIONS[key]


@query(
    "pf28_option_sets",
    " union all ".join(f"select '{run}' as run, gid as group_id, entry_date, exit_date, {r('f', 9)} as factor, {sig('cin')} as capital_in from {t}_trd" for run, t in VIEWS_OF.items()),
)
def pf28_option_sets(spark, sf):
    t = scenarios(spark, sf).trades
    return t.select("run", "group_id", "entry_date", "exit_date", rounded(C("factor"), 9).alias("factor"), significant(C("capital_in")).alias("capital_in"))


@query(
    "pf28_option_curves",
    " union all ".join(f"select '{run}' as run, date, {sig('eq')} as equity from {VIEWS_OF[run]}_eq where gid = 'net'" for run in ("neutral:b", "halves:a", "ends:b")),
)
def pf28_option_curves(spark, sf):
    """Net curves of some runs of the same job."""
    curves = scenarios(spark, sf).equity.where((C("group_id") == "net") & C("run").isin("neutral:b", "halves:a", "ends:b"))
    return curves.select("run", "date", significant(C("equity")).alias("equity"))


# ------------------------------------------------------------------ a user's strategy


def core_and_tails(scores: pd.Series):
    """Ten names around the median, and three at each end; nothing where fewer than 30 are scored."""
    if len(scores) < 30:
        return {}, f"Only {len(scores)} names."
    ordered = scores.sort_values(kind="mergesort").index
    middle = len(ordered) // 2
    return {"core": ordered[middle - 5 : middle + 5], "tails": [*ordered[:3], *ordered[-3:]]}


CHOSEN = pf.Rules(strategy=ChosenGroups(core_and_tails, ("core", "tails"), max_rows=100_000), costs=COSTS)
view(
    "chosen_rank",
    "select *, row_number() over (partition by wid order by score, ticker) as k, count(*) over (partition by wid) as names from pb_cand where score is not null",
)


@query(
    "pf3_chosen_groups",
    """select entry_date, 'core' as group_id, ticker from chosen_rank where names >= 30 and k > names // 2 - 5 and k <= names // 2 + 5
       union all select entry_date, 'tails', ticker from chosen_rank where names >= 30 and (k <= 3 or k > names - 3)""",
)
def pf3_chosen(spark, sf):
    let_tasks_import(spark)
    bt = pp.run(spark, sf, CHOSEN)
    return member_cols(bt.members, bt.windows).select("entry_date", "group_id", "ticker")


@query(
    "pf3_chosen_notes",
    """select w.entry_date, coalesce(c.n, 0) as n_scores, case when coalesce(c.n, 0) = 0 then 'No assets had valid scores.' when c.n < 30 then 'Only ' || c.n || ' names.' end as note
       from pb_win w left join (select wid, count(score) as n from pb_cand group by wid) c on c.wid = w.wid""",
)
def pf3_notes(spark, sf):
    let_tasks_import(spark)
    return pp.run(spark, sf, CHOSEN).notes.select("entry_date", C("n").alias("n_scores"), "note")


# ------------------------------------------------------------------ long histories

#: rows of a block here, so that the histories of the given tables are several blocks
ROWS = 64
LOCAL = {name: (feature, params, sql) for name, (feature, params, sql) in FEATURE_SQL.items()}
LOCAL["ft14_ulcer"] = ("ulcer", {"window": 20}, f"sqrt(avg(under * under) over {fr(20)})")
LOCAL["ft15_stoch"] = ("stoch", {"window": 14, "smooth_k": 3, "smooth_d": 3}, f"coalesce(avg(ks) over {fr(3)}, 0) - 0.5")
view(
    "views_deep",
    f"""select *, avg(k) over {fr(3)} as ks from (select *, close / nullif(max(close) over {fr(20)}, 0) - 1 as under,
        (close - min(low) over {fr(14)}) / nullif(max(high) over {fr(14)} - min(low) over {fr(14)}, 0) as k from views_w)""",
)


def long_grid(spark, sf, values) -> DataFrame:
    return bl.blocked_grid(tables.bars(spark, sf).select("ticker", "date", *values), tables.bar_calendar(spark, sf), values, ROWS)


@query("ft16_blocked_features", "select ticker, date, " + ", ".join(f"{r(sql)} as {feature}" for feature, _, sql in LOCAL.values()) + " from views_deep")
def ft16_blocked(spark, sf):
    """Every rolling indicator from blocks with one halo."""
    cells, names = bl.add_features(long_grid(spark, sf, tables.OHLCV), [(f, p) for f, p, _ in LOCAL.values()], rows=ROWS)
    return cells.select("ticker", "date", *[rounded(C(n)).alias(n.split("_", 1)[1]) for n in names])


@query("ft17_blocked_means", EWM_SQL + f"select ticker, date, {r('y')} as ewm, {r('(close - y) / nullif(y, 0)')} as ema from walk")
def ft17_blocked(spark, sf):
    cells = bl.blocked_ema(bl.blocked_ewm(long_grid(spark, sf, ["close"]), "close", 20, "ewm", ROWS), window=20, rows=ROWS)
    return cells.select("ticker", "date", rounded(C("ewm")).alias("ewm"), rounded(C("ema")).alias("ema"))


@query("ft8_blocked_macd")
def ft8_blocked(spark, sf):
    cells = bl.blocked_macd(long_grid(spark, sf, ["close"]), "value", 12, 26, 9, ROWS)
    return cells.select("ticker", "date", rounded(C("value")).alias("value"))


CHECKS["ft8_blocked_macd"] = CHECKS["ft8_macd"]


@query("wn1_blocked_sums")
def wn1_blocked(spark, sf):
    out = bl.blocked_rolling(long_grid(spark, sf, ["flow"]), "flow", [5, 20, 60, 20], ROWS)
    return out.select("window_rows", "ticker", "date", rounded(C("value"), 4).alias("value"))


CHECKS["wn1_blocked_sums"] = CHECKS["wn1_rolling_sum"]


@query("wn2_blocked_means")
def wn2_blocked(spark, sf):
    cells = long_grid(spark, sf, ["close"])
    means = bl.blocked_rolling(cells, "close", [5], ROWS, mean=True).select("ticker", "pos", rounded(C("value")).alias("ma"))
    return cells.select("ticker", "pos", "date").join(means, ["ticker", "pos"], "left").select("ticker", "date", "ma")


CHECKS["wn2_blocked_means"] = CHECKS["wn2_chart_moving_average"]

# ------------------------------------------------------------------ many dates

view("year_days", "select cast(unnest(generate_series(timestamp '1996-01-01', timestamp '1996-12-31', interval 1 day)) as date) as target")
view(
    "valid_w",
    f"""select ticker, date, close, row_number() over (partition by ticker order by date) as n_rows
        from (select *, count(close) over {fr(5)} as held, pos from grid_w) where held = 5 and pos >= 5""",
)


def year_days(spark) -> DataFrame:
    return spark.sql("select explode(sequence(date '1996-01-01', date '1996-12-31')) as target")


@query(
    "jn16_many_dates",
    """select t.target, k.ticker, v.date, datediff('day', v.date, t.target) as age, v.n_rows, v.close
       from (select distinct ticker from valid_w) k cross join year_days t asof join valid_w v on v.ticker = k.ticker and t.target >= v.date
       where datediff('day', v.date, t.target) <= 10 and v.n_rows >= 8""",
)
def jn16_many(spark, sf):
    """The last valid bar of every ticker for every day of a year, unless it is older than ten days or has too few before it."""
    cells = tables.grid(spark, sf, values=["close"])
    valid = cells.withColumn("ma", full_window(C("close"), 5, F.avg("close"))).where(C("ma").isNotNull())
    return al.as_of_many(valid, year_days(spark), ["close"], max_age_days=10, rows_needed=8)


@query(
    "set3_daily_scores",
    f"""select t.target, k.ticker, v.date, datediff('day', v.date, t.target) as age, {r('v.prob_up')} as prob_up
       from (select distinct ticker from ensemble_day) k cross join year_days t asof join ensemble_day v on v.ticker = k.ticker and t.target >= v.date
       where datediff('day', v.date, t.target) <= 6""",
)
def set3_daily(spark, sf):
    """Ensemble scores for every day of a year, none older than six days."""
    cells = sc.ensemble_cells(res(spark, sf), 3).select("date", "ticker", "prob_up")
    out = al.as_of_many(cells, year_days(spark), ["prob_up"], max_age_days=6)
    return out.select("target", "ticker", "date", "age", rounded(C("prob_up")).alias("prob_up"))


# ------------------------------------------------------------------ business schedules

_WEEKEND = "greatest(isodow(date) - 5, 0)"
_END, _BEGIN = "last_day(date)", "cast(date_trunc('month', date) as date)"
PERIOD_SQL = {
    "MS": "date_trunc('month', date)",
    "QS": "date_trunc('quarter', date)",
    "B": f"date - cast({_WEEKEND} as integer)",
    "BM": f"date_trunc('month', case when date > {_END} - cast(greatest(isodow({_END}) - 5, 0) as integer) then {_END} + 1 else date end)",
    "BMS": f"date_trunc('month', case when date < {_BEGIN} + case isodow({_BEGIN}) when 6 then 2 when 7 then 1 else 0 end then {_BEGIN} - 1 else date end)",
}


@query("pf6_business_periods", " union all ".join(f"select '{f}' as freq, max(cast(l_shipdate as date)) as date from (select *, cast(l_shipdate as date) as date from lineitem) group by {g}" for f, g in PERIOD_SQL.items()))
def pf6_business(spark, sf):
    """The last date of every business period, on the calendar of all shipping days, weekends included."""
    days = tables.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    lasts = None
    for f in PERIOD_SQL:
        part = days.groupBy(period_start("date", f).alias("period")).agg(F.max("date").alias("date")).select(F.lit(f).alias("freq"), "date")
        lasts = part if lasts is None else lasts.unionByName(part)
    return lasts


# ------------------------------------------------------------------ sheets, wide panels, charts, models


def noted_sheet(spark, sf) -> DataFrame:
    """The vendor sheet with a note above it: a quoted cell of three lines, with commas and quotes."""
    note = 'Prices, "as delivered"\nsecond line,\n"third" line'
    return vendor_sheet(spark, sf).unionByName(spark.createDataFrame([(2, 1, note), (4, 0, "Source: vendor")], "row_no int, col_no long, cell string"))


@query("src3_sheet_files")
def src3_files(spark, sf):
    """Bars from a sheet that went through CSV files."""
    path = new_path(spark, "sheet")
    sheets.write_sheet(noted_sheet(spark, sf), path)
    return cl.vendor_bars(sheets.read_sheet(spark, path))


CHECKS["src3_sheet_files"] = CHECKS["src3_vendor_sheet_bars"]


view(
    "metric_sheet_w",
    """select c.pos + 13 as row_no, case when c.pos % 13 = 0 then 'n/a' else cast(b.date as varchar) end as date, 'T' || b.ticker as ticker,
        case when cast(b.ticker as bigint) % 17 = 3 and c.pos % 9 = 0 then 'x #INVALID OPTION' when b.volume % 7 = 0 then 'missing'
             else cast(cast(round(b.close * 100) as bigint) as varchar) end as value
       from bars_w b join cal_w c on c.date = b.date""",
)
MARKED = "ticker in (select ticker from metric_sheet_w where row_no >= 20 and value like '%#INVALID OPTION%')"


def metric_sheet(spark, sf) -> DataFrame:
    """A metric sheet as (row_no, col_no, cell): tickers in row 6, dates in column 0 from row 14 on."""
    bars, cal = tables.bars(spark, sf).select("ticker", "date", "close", "volume"), tables.bar_calendar(spark, sf)
    number = C("ticker").cast("long")
    heads = bars.select("ticker").distinct().select(F.lit(6).alias("row_no"), (number + 1).alias("col_no"), F.concat(F.lit("T"), "ticker").alias("cell"))
    dates = cal.select((C("pos") + 13).alias("row_no"), F.lit(0).cast("long").alias("col_no"), F.when(C("pos") % 13 == 0, F.lit("n/a")).otherwise(C("date").cast("string")).alias("cell"))
    bad = (number % 17 == 3) & (C("pos") % 9 == 0)
    price = F.when(bad, F.lit("x #INVALID OPTION")).when(C("volume") % 7 == 0, F.lit("missing")).otherwise(F.round(C("close") * 100).cast("long").cast("string"))
    body = bars.join(per_day(cal, "date"), "date").select((C("pos") + 13).alias("row_no"), (number + 1).alias("col_no"), price.alias("cell"))
    return heads.unionByName(dates).unionByName(body)


@query(
    "src4_sheet_files",
    f"""select try_cast(date as date) as date, ticker, case when {MARKED} then 0.0 else try_cast(value as double) end as value
        from metric_sheet_w where row_no >= 20 and try_cast(date as date) is not null
        and ticker in (select ticker from metric_sheet_w where row_no >= 20 and try_cast(date as date) is not null
            and (try_cast(value as double) is not null or {MARKED}))""",
)
def src4_files(spark, sf):
    """A metric sheet through CSV files, its chain of steps, and a panel."""
    path = new_path(spark, "metric-sheet")
    sheets.write_sheet(metric_sheet(spark, sf), path)
    steps = [cl.skip_rows(20), cl.zero_marked_tickers(), cl.coerce_dates, cl.coerce_numbers, cl.drop_empty_tickers]
    cells = cl.metric_cells(sheets.read_sheet(spark, path), 6)
    return cl.chain(cells, steps).select("date", "ticker", "value")


@query(
    "snk1_wide_panels",
    f"select ticker, date, {r('score', 9)} as score from scores_long where model = 'a'",
)
def snk1_wide(spark, sf):
    """Scores exported in blocks of columns and read back."""
    path = new_path(spark, "wide-scores")
    wide.write_wide(tables.scores(spark, sf, ["a"]), path, value="score", columns=40)
    return wide.read_wide(spark, path).select("ticker", "date", rounded(C("value"), 9).alias("score"))


@query("rep1_wide_curves", f"select gid as portfolio, date, {sig('eq')} as equity from pb_eq")
def rep1_wide(spark, sf):
    """Equity curves side by side, as a report exports them, and read back."""
    path = new_path(spark, "wide-curves")
    wide.write_wide(pp.base(spark, sf).equity, path, name="group_id", value="equity", columns=4)
    return wide.read_wide(spark, path).select(C("ticker").alias("portfolio"), "date", significant(C("value")).alias("equity"))


view(
    "pixels_d",
    f"""select ticker, end_date, px, py from ({CHECKS["wn8_pixel_table"]})""",
)


@query(
    "wn8_packed_charts",
    f"""select ticker, end_date, string_agg(printf('%02X', coalesce(v, 0)), '' order by i) as raster from (
        select w.ticker, w.end_date, i, v from (select distinct ticker, end_date from pixels_d) w cross join (select unnest(range(0, {2 * HEIGHT})) as i) b
        left join (select ticker, end_date, py * 2 + px // 8 as byte, cast(sum(1 << (7 - px % 8)) as integer) as v from pixels_d group by 1, 2, 3) p
          on p.ticker = w.ticker and p.end_date = w.end_date and p.byte = b.i) group by 1, 2""",
)
def wn8_packed(spark, sf):
    rows, names = chart_base(spark, sf)
    points = sm.pixels(sm.scaled_bars(rows, N, names, HEIGHT), N, names, HEIGHT)
    return sm.packed_charts(points, ["ticker", "start_date", "end_date"], 3 * N, HEIGHT).select("ticker", "end_date", F.hex("raster").alias("raster"))


def member_models():
    """Three stand-in models, as a factory that a worker calls once."""

    def member(feature: int):
        def predict(x: pd.Series) -> pd.DataFrame:
            logit = np.array([np.mean([step[feature] for step in window], dtype=np.float64) for window in x])
            up = 1.0 / (1.0 + np.exp(-logit))
            return pd.DataFrame({"prediction": (up > 0.5).astype(np.int32), "prob_up": up, "prob_down": 1.0 - up})

        return predict

    return {"m0": member(0), "m3": member(3)}


@query(
    "scr1_member_models",
    win_sql(f"date, ticker, {r(f'(1 / (1 + exp(-x0 / {LOOK})) + 1 / (1 + exp(-x3 / {LOOK}))) / 2', 5)} as prob_up"),
)
def scr1_members(spark, sf):
    """Every window scored by all members in one pass, and their ensemble."""
    let_tasks_import(spark)
    scored = sm.score_with_models(training(spark, sf), member_models, "prediction int, prob_up double, prob_down double")
    return sc.ensemble_cells(scored, 2).select("date", "ticker", rounded(C("prob_up"), 5).alias("prob_up"))
