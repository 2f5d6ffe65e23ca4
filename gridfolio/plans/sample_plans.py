"""Registered queries: alignment joins, as-of lookups, chart and training windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridfolio.functions import features as feat
from gridfolio.functions.expr import full_window, rounded
from gridfolio.operators import alignment as al
from gridfolio.operators import cleaning as cl
from gridfolio.operators import samples as sm
from gridfolio.operators.calendar import calendar_of, dense_grid
from gridfolio.operators.panels import rolling_sums, zscore_on_years
from gridfolio.plans.feature_plans import feature_set, fr
from gridfolio.plans.registry import query
from gridfolio.plans.views_sql import r, view
from gridfolio.sources import panels, tables
from gridfolio.sources.store import new_path, stored

C = F.col


# ------------------------------------------------------------------ calendar alignment


@query(
    "jn1_field_alignment",
    """select o.date, o.ticker, o.open, c.close, v.volume from bars_w o
       left join (select date, ticker, close from bars_w where volume > 20) c on c.date = o.date and c.ticker = o.ticker
       left join (select date, ticker, volume from bars_w where close > 1500) v on v.date = o.date and v.ticker = o.ticker
       where o.ticker not in (select ticker from bars_w where volume > 200)""",
)
def jn1(spark, sf):
    bars = tables.bars(spark, sf)
    closes = bars.where(C("volume") > 20).select("date", "ticker", "close")
    volumes = bars.where(C("close") > 1500).select("date", "ticker", "volume")
    excluded = bars.where(C("volume") > 200).select("ticker").distinct()
    return al.align_fields(bars.select("date", "ticker", "open"), [closes, volumes], excluded)


view(
    "sparse_scores",
    """select ticker, case when pos % 5 = 0 then date + 3 else date end as date, score
       from (select * from scores_long where model = 'b' and pos % 3 <> 1 and ticker <> '9')""",
)
view(
    "aligned_scores",
    """select ticker, pos, date, last_value(score ignore nulls) over (partition by ticker order by pos) as score from (
        select t.ticker, c.pos, c.date, s.score from (select distinct s.ticker from sparse_scores s join cal_w c on c.date = s.date) t
        cross join cal_w c left join sparse_scores s on s.ticker = t.ticker and s.date = c.date)
       qualify date >= (select min(s.date) from sparse_scores s join cal_w c on c.date = s.date)""",
)


def sparse_scores(cells):
    """Momentum scores with missing weeks and dates that are not in the calendar."""
    scored = tables.with_scores(cells, ["b"]).withColumnRenamed("score_b", "score").where(C("score").isNotNull())
    kept = scored.where((C("pos") % 3 != 1) & (C("ticker") != "9"))
    moved = F.when(C("pos") % 5 == 0, F.date_add("date", 3)).otherwise(C("date"))
    return kept.select("ticker", moved.alias("date"), "score")


def aligned(spark, sf):
    """The raw rows are read once, for the bars; what the checks of the inputs look at is stored."""
    bars = stored(tables.bars(spark, sf).select("ticker", "date", "close"), "bars")
    calendar = calendar_of(bars)
    scores = stored(sparse_scores(dense_grid(bars, calendar, ["close"])), "sparse-scores")
    return al.align_scores(scores, calendar, bars.select("ticker"))


@query("jn2_score_calendar_alignment", f"select ticker, date, {r('score')} as score from aligned_scores")
def jn2(spark, sf):
    return aligned(spark, sf).select("ticker", "date", rounded(C("score")).alias("score"))


@query(
    "jn3_optional_alignment",
    f"""select a.ticker, a.date, {r('a.score')} as score, {r('c.cap', 2)} as cap from aligned_scores a left join (
        select t.ticker, c.pos, last_value(m.cap ignore nulls) over (partition by t.ticker order by c.pos) as cap
        from (select distinct ticker from mktcap_w) t cross join cal_w c
        left join (select * from mktcap_w where pos % 4 = 0) m on m.ticker = t.ticker and m.pos = c.pos) c
        on c.ticker = a.ticker and c.pos = a.pos""",
)
def jn3(spark, sf):
    caps = tables.market_caps(spark, sf).where((C("pos") % 4 == 0) & C("cap").isNotNull()).select("ticker", "date", "cap")
    out = al.align_optional(caps, tables.bar_calendar(spark, sf), aligned(spark, sf), "cap")
    return out.select("ticker", "date", rounded(C("score")).alias("score"), rounded(C("cap"), 2).alias("cap"))


@query(
    "jn4_membership_mask",
    f"""select g.ticker, g.date, g.close, {r('case when m.member > 0 then s.score_b end')} as score,
        case when m.member > 0 then g.open end as open
        from grid_w g join mask_w m on m.ticker = g.ticker and m.pos = g.pos and m.ever
        join wide_scores s on s.ticker = g.ticker and s.pos = g.pos""",
)
def jn4(spark, sf):
    bars = stored(tables.bars(spark, sf).select("ticker", "date", "open", "close", "amount"), "bars")
    calendar = calendar_of(bars)
    grid = dense_grid(bars, calendar, ["open", "close", "amount"])
    members = stored(tables.universe(spark, sf, grid.select("ticker", "pos", "date", "amount"), calendar), "universe")
    cells = tables.with_scores(grid.drop("amount"), ["b"]).withColumnRenamed("score_b", "score")
    out = al.apply_mask(cells, al.membership_mask(members, calendar), ["score", "open"])
    return out.select("ticker", "date", "close", rounded(C("score")).alias("score"), "open")


view("month_ends", "select distinct last_day(date) as target from cal_w")


def month_ends(spark, sf):
    return tables.bar_calendar(spark, sf).select(F.last_day("date").alias("target")).distinct()


@query(
    "jn5_as_of_sector_row",
    "select target, s.date as as_of, s.ticker, s.sector from month_ends asof join quarters_w q on target >= q.date join sector_w s on s.date = q.date",
)
def jn5(spark, sf):
    return al.as_of_rows(tables.sectors(spark, sf), month_ends(spark, sf)).select("target", "as_of", "ticker", "sector")


@query(
    "jn6_sector_cell_fill",
    """select ticker, date, last_value(sector ignore nulls) over (partition by ticker order by pos) as sector from (
        select t.ticker, c.pos, c.date, s.sector from (select distinct ticker from sector_w) t cross join cal_w c
        left join (select * from sector_w where cast(ticker as bigint) % 4 <> month(date) % 4) s on s.ticker = t.ticker and s.date = c.date)""",
)
def jn6(spark, sf):
    holed = tables.sectors(spark, sf).where(C("ticker").cast("long") % 4 != F.month("date") % 4)
    return al.align_to_calendar(holed, tables.bar_calendar(spark, sf), ["sector"]).select("ticker", "date", "sector")


@query(
    "jn7_as_of_row_fallback",
    f"""select target, d.date as as_of, s.ticker, {r('s.score')} as score from month_ends
        asof join (select distinct date from scores_long where model = 'c') d on target >= d.date
        join scores_long s on s.date = d.date and s.model = 'c'""",
)
def jn7(spark, sf):
    rows = tables.scores(spark, sf, ["c"]).select("date", "ticker", "score")
    out = al.as_of_rows(rows, month_ends(spark, sf))
    return out.select("target", "as_of", "ticker", rounded(C("score")).alias("score"))


@query("jn7_missing_entry_rows", "select target from month_ends where target not in (select date from bars_w)")
def jn7_missing(spark, sf):
    return al.missing_rows(tables.bar_calendar(spark, sf), month_ends(spark, sf))


@query(
    "jn8_as_of_position_lag",
    "select target, c.date as as_of, e.date as entry_date from month_ends asof left join cal_w c on target >= c.date left join cal_w e on e.pos = c.pos + 2",
)
def jn8(spark, sf):
    return al.as_of_position(month_ends(spark, sf), tables.bar_calendar(spark, sf), 2)


N, HEIGHT = 5, 32
VOL_H, PRICE_H, OFFSET = sm.chart_heights(HEIGHT)

view(
    "grid_ma",
    f"""select *, sum(case when open is null or high is null or low is null or close is null or ma5 is null then 1 else 0 end)
            over (partition by ticker order by pos) as holes
        from (select *, case when count(close) over {fr(N)} = {N} then avg(close) over {fr(N)} end as ma5 from grid_d)""",
)
TARGET = "2024-01-25"


@query(
    "jn16_staleness_limit",
    f"""select ticker, date, n_rows, datediff('day', date, date '{TARGET}') as age from (
        select ticker, max(date) as date, count(*) as n_rows from grid_ma where ma5 is not null and date <= date '{TARGET}' group by ticker)
        where datediff('day', date, date '{TARGET}') <= 1 and n_rows >= 5""",
)
def jn16(spark, sf):
    cells = tables.day_grid(spark, sf, ["close"])
    valid = cells.withColumn("ma", full_window(C("close"), 5, F.avg("close"))).where(C("ma").isNotNull())
    return al.fresh_bars(valid, TARGET, 1, 5).select("ticker", "date", "n_rows", "age")


view(
    "index_scaled",
    """select date, pos, value / first_value(value) over (order by pos) * 1000000.0 as equity from (
        select c.date, c.pos, last_value(b.value ignore nulls) over (order by c.pos) as value from cal_w c
        left join (select * from benchmark_w where week(date) % 3 > 0) b on b.date = c.date) where value is not null""",
)


def scaled_index(spark, sf):
    index = tables.index_level(spark, sf).where(F.weekofyear("date") % 3 > 0)
    return al.scale_to_capital(index, tables.bar_calendar(spark, sf), 1_000_000.0)


@query("jn19_benchmark_alignment", f"select date, {r('equity', 4)} as equity from index_scaled")
def jn19(spark, sf):
    return scaled_index(spark, sf).select("date", rounded(C("equity"), 4).alias("equity"))


@query(
    "jn17_as_of_equity",
    f"""select target, {r('coalesce(e.equity, (select arg_min(equity, date) from index_scaled))', 4)} as equity
        from (select target - 40 as target from month_ends) asof left join index_scaled e on target >= e.date""",
)
def jn17(spark, sf):
    targets = month_ends(spark, sf).select(F.date_sub("target", 40).alias("target"))
    return al.value_as_of(scaled_index(spark, sf), targets).select("target", rounded(C("equity"), 4).alias("equity"))


# ------------------------------------------------------------------ chart windows

view("chart_valid", f"select *, row_number() over (partition by ticker order by pos) as i, count(*) over (partition by ticker) as len from grid_ma where pos >= {N} and ma5 is not null")
view(
    "chart_set",
    f"""select a.ticker, a.date as start_date, b.date as end_date, c.date as estimation_start, d.date as estimation_end,
            case when d.close / nullif(c.close, 0) > 1 then 1 else 0 end as label, a.pos as start_pos, b.pos as end_pos, a.close as base
        from chart_valid a join chart_valid b on b.ticker = a.ticker and b.i = a.i + {N - 1}
        join chart_valid c on c.ticker = a.ticker and c.i = a.i + {N} join chart_valid d on d.ticker = a.ticker and d.i = a.i + {2 * N}
        where a.i - 1 < a.len - {2 * N} - 1 and b.holes = a.holes and a.close <> 0""",
)


def chart_base(spark, sf):
    return sm.chart_rows(tables.day_grid(spark, sf), N)


@query("wn3_valid_start_dates", "select ticker, date from chart_valid")
def wn3(spark, sf):
    rows, names = chart_base(spark, sf)
    return sm.valid_starts(rows, N, names).select("ticker", "date")


@query("wn4_chart_windows", "select ticker, start_date, end_date, estimation_start, estimation_end from chart_set")
def wn4(spark, sf):
    rows, names = chart_base(spark, sf)
    return sm.chart_windows(rows, N, names).select("ticker", "start_date", "end_date", "estimation_start", "estimation_end")


@query("wn5_chart_label", "select ticker, end_date, label from chart_set")
def wn5(spark, sf):
    rows, names = chart_base(spark, sf)
    return sm.chart_windows(rows, N, names).select("ticker", "end_date", "label")


def _y(field: str) -> str:
    return f"cast(trunc(({field} / base - lo) / (hi - lo) * {PRICE_H - 1} + {OFFSET}) as integer)"


view(
    "chart_bars",
    f"""select ticker, start_date, end_date, i, {_y('open')} as open, {_y('high')} as high, {_y('low')} as low, {_y('close')} as close,
            {_y('ma5')} as ma5, cast(trunc(coalesce(volume / case when mv > 0 then mv end * {VOL_H - 1}, 0)) as integer) as volume
        from (select s.ticker, s.start_date, s.end_date, g.pos - s.start_pos as i, s.base, g.open, g.high, g.low, g.close, g.ma5, g.volume,
                min(least(g.open, g.high, g.low, g.close, g.ma5)) over w / s.base as lo,
                max(greatest(g.open, g.high, g.low, g.close, g.ma5)) over w / s.base as hi, max(g.volume) over w as mv
              from chart_set s join grid_ma g on g.ticker = s.ticker and g.pos between s.start_pos and s.end_pos
              window w as (partition by s.ticker, s.start_pos))""",
)


@query("wn6_chart_price_scaling", "select ticker, end_date, i, open, high, low, close, ma5 from chart_bars")
def wn6(spark, sf):
    rows, names = chart_base(spark, sf)
    return sm.scaled_bars(rows, N, names, HEIGHT).select("ticker", "end_date", "i", "open", "high", "low", "close", "ma5")


@query("wn7_chart_volume_scaling", "select ticker, end_date, i, volume from chart_bars")
def wn7(spark, sf):
    rows, names = chart_base(spark, sf)
    return sm.scaled_bars(rows, N, names, HEIGHT).select("ticker", "end_date", "i", "volume")


@query(
    "wn8_pixel_table",
    f"""select distinct ticker, end_date, cast(px as integer) as px, cast({HEIGHT - 1} - py as integer) as py from (
        select ticker, end_date, i * 3 as px, open as py from chart_bars
        union all select ticker, end_date, i * 3 + 2, close from chart_bars
        union all select ticker, end_date, i * 3 + 1, unnest(range(low, high + 1)) from chart_bars
        union all select ticker, end_date, i * 3 + 1, unnest(range(0, volume + 1)) from chart_bars
        union all select ticker, end_date, i * 3 + floor(3.0::double * k / n + 0.5::double), y0 + floor((y1 - y0) * k::double / n + 0.5::double) from (
            select *, unnest(range(0, n + 1)) as k from (select *, greatest(abs(y1 - y0), 3) as n from (
                select ticker, end_date, i, ma5 as y0, lead(ma5) over (partition by ticker, end_date order by i) as y1 from chart_bars)
            where y1 is not null)))
        where py between 0 and {HEIGHT - 1} and px between 0 and {3 * N - 1}""",
)
def wn8(spark, sf):
    rows, names = chart_base(spark, sf)
    return sm.pixels(sm.scaled_bars(rows, N, names, HEIGHT), N, names, HEIGHT).select("ticker", "end_date", "px", "py")


@query(
    "snk3_sample_metadata",
    """select ticker, strftime(start_date, '%Y%m%d') as start_date, strftime(end_date, '%Y%m%d') as end_date, label,
        row_number() over (order by ticker, start_date) - 1 as image_idx from chart_set where ticker in ('1', '3', '12', '40')""",
)
def snk3(spark, sf):
    rows, names = chart_base(spark, sf)
    meta = sm.chart_windows(rows, N, names).select(
        F.lit(N).alias("interval"), "ticker", F.date_format("start_date", "yyyyMMdd").alias("start_date"),
        F.date_format("end_date", "yyyyMMdd").alias("end_date"), "label",
    )
    path = new_path(spark, "samples")
    panels.save_partitioned(meta, path, ["interval"])
    back = spark.read.schema("ticker string, start_date string, end_date string, label int, interval int").parquet(path)
    kept = back.where((C("interval") == N) & C("ticker").isin("1", "3", "12", "40"))
    return cl.dense_index(kept, ["interval"], "ticker", "start_date", "image_idx").drop("interval")


# ------------------------------------------------------------------ training windows

LOOK, HOR = 8, 4


def _windows(spark, sf, **options):
    cells, names = feature_set(spark, sf)
    cells = feat.validity(cells, names)
    total = tables.bar_calendar(spark, sf).agg(F.max("pos")).scalar()
    return sm.training_windows(cells, names, total, lookback=LOOK, horizon=HOR, min_valid=0.7, **options)


view(
    "train_cells",
    f"""select *, case when f0 is not null and f1 is not null and f2 is not null and f3 is not null then 1 else 0 end as ok from feature_set""",
)
view(
    "train_base",
    f"""select c.*, sum(ok) over {fr(LOOK)} as n_valid, sum(cast(coalesce(f0, 0) as float)) over {fr(LOOK)} as x0,
            sum(cast(coalesce(f3, 0) as float)) over {fr(LOOK)} as x3,
            count(close) over (partition by ticker order by pos rows between current row and {HOR} following) as n_ahead,
            lead(close, {HOR}) over (partition by ticker order by pos) / nullif(close, 0) - 1 as ret
        from train_cells c""",
)
view(
    "train_dd",
    f"""select ticker, pos, max((peak - rel) / (peak + 1e-8)) as dd from (
            select a.ticker, a.pos, b.close / a.close as rel,
                max(b.close / a.close) over (partition by a.ticker, a.pos order by b.pos) as peak
            from train_cells a join train_cells b on b.ticker = a.ticker and b.pos between a.pos and a.pos + {HOR}
            where a.close is not null and b.close is not null)
        group by 1, 2""",
)


def _win_sql(select: str, stride: int = 1, assets: int = 1) -> str:
    return f"""select {select} from (select b.*, d.dd, count(*) over (partition by b.pos) as n_assets
        from train_base b join train_dd d on d.ticker = b.ticker and d.pos = b.pos
        where b.pos >= {LOOK} and (b.pos - {LOOK}) % {stride} = 0 and b.pos + {HOR} <= (select max(pos) from cal_w)
        and n_valid >= ceil({LOOK} * 0.7) and n_ahead = {HOR + 1} and ret is not null) where n_assets >= {assets}"""


def _sum_of(k: int):
    return F.aggregate("x", F.lit(0.0), lambda acc, row: acc + F.get(row, F.lit(k)).cast("double"))


@query(
    "wn9_training_windows",
    _win_sql(f"date, ticker, {LOOK} as n_steps, {r('x0', 4)} as sum_f0, {r('x3', 4)} as sum_f3, {r('ret')} as target, {r('dd')} as drawdown", 2, 20),
)
def wn9(spark, sf):
    w = _windows(spark, sf, stride=2, min_assets=20)
    return w.select(
        "date", "ticker", F.size("x").alias("n_steps"), rounded(_sum_of(0), 4).alias("sum_f0"), rounded(_sum_of(3), 4).alias("sum_f3"),
        rounded(C("target_cls")).alias("target"), rounded(C("target_dd")).alias("drawdown"),
    )


@query("wn10_forward_return_label", f"select ticker, date, {r('ret')} as ret, cast(ret > 0.02::double as integer) as label from train_base where ret is not null")
def wn10(spark, sf):
    cells = tables.grid(spark, sf, values=["close"]).withColumn("ret", sm.forward_return(HOR)).where(C("ret").isNotNull())
    return cells.select("ticker", "date", rounded(C("ret")).alias("ret"), (C("ret") > 0.02).cast("int").alias("label"))


@query("wn11_forward_drawdown", _win_sql(f"date, ticker, {r('dd')} as drawdown"))
def wn11(spark, sf):
    return _windows(spark, sf).select("date", "ticker", rounded(C("target_dd")).alias("drawdown"))


@query("snk4_window_cache", _win_sql(f"date, ticker, cast(ret > 0 as integer) as label, {r('dd')} as drawdown"))
def snk4(spark, sf):
    params = {"lookback": LOOK, "horizon": HOR, "features": ["logreturn", "magap", "stoch", "volumez"], "min_valid": 0.7, "threshold": 0.0, "source": sf}
    cache, files = panels.SampleCache(spark, "windows"), [f"{sf}/lineitem.parquet"]
    cache.get(params, lambda: _windows(spark, sf, threshold=0.0), files)
    return cache.load(params, files).select("date", "ticker", C("target_cls").cast("int").alias("label"), rounded(C("target_dd")).alias("drawdown"))


def mean_model(x: pd.Series) -> pd.DataFrame:
    """A stand-in batch model: the logit is the mean of the first feature."""
    logit = np.array([np.mean([step[0] for step in window], dtype=np.float64) for window in x])
    up = 1.0 / (1.0 + np.exp(-logit))
    return pd.DataFrame({"prediction": (up > 0.5).astype(np.int32), "prob_up": up})


@query(
    "scr1_score_windows",
    _win_sql(f"date, ticker, {r(f'1 / (1 + exp(-x0 / {LOOK}))', 5)} as prob_up"),
)
def scr1(spark, sf):
    scored = sm.score_windows(_windows(spark, sf), mean_model, "prediction int, prob_up double")
    return scored.select("date", "ticker", rounded(C("prob_up"), 5).alias("prob_up"))


# ------------------------------------------------------------------ sample joins

view("flow_roll", " union all ".join(f"select {w} as w, ticker, date, case when count(flow) over {fr(w)} = {w} then sum(flow) over {fr(w)} end as value from grid_w" for w in (5, 20)))
view(
    "flow_z",
    """select w, f.ticker, f.date, (f.value / nullif(cap, 0) - avg(f.value / nullif(cap, 0)) over p) / nullif(stddev_pop(f.value / nullif(cap, 0)) over p, 0) as z
       from flow_roll f join mktcap_w m on m.ticker = f.ticker and m.date = f.date window p as (partition by f.w, f.ticker)""",
)


def flow_features(spark, sf, windows=(5, 20)):
    """Z-scored flow ratios, one row per rolling window: (window_rows, date, ticker, z); moments of all years."""
    cells = tables.grid(spark, sf, values=["flow", "amount"])
    caps = cells.select("ticker", "pos", "date", F.sum("amount").over(sm.trailing(52)).alias("cap"))
    rolled = rolling_sums(cells, "flow", list(windows))
    ratio = rolled.join(caps.select("ticker", "date", "cap"), ["ticker", "date"])
    ratio = ratio.withColumn("ratio", sm.div(C("value"), C("cap")))
    z = zscore_on_years(ratio, "ratio", None, "z", by=["window_rows", "ticker"])
    return z.where(C("z").isNotNull()).select("window_rows", "date", "ticker", "z")


@query(
    "jn22_multi_window_merge",
    f"""select date, ticker, {r('max(case when w = 5 then z end)')} as flow_5, {r('max(case when w = 20 then z end)')} as flow_20 from flow_z
        where z is not null group by date, ticker having count(case when w = 5 then 1 end) > 0 and count(case when w = 20 then 1 end) > 0""",
)
def jn22(spark, sf):
    out = al.cells_of_all(flow_features(spark, sf), "window_rows", {"flow_5": 5, "flow_20": 20}, "z")
    return out.select("date", "ticker", rounded(C("flow_5")).alias("flow_5"), rounded(C("flow_20")).alias("flow_20"))


@query(
    "jn9_samples_flow_features",
    f"""select r.date, r.ticker, r.label, {r('z.z')} as flow_5 from results_long r join flow_z z on z.ticker = r.ticker and z.date = r.date and z.w = 5
        where r.model = 'a' and z.z is not null""",
)
def jn9(spark, sf):
    samples = tables.results(spark, sf, ["a"]).select("date", "ticker", "label")
    flow = flow_features(spark, sf, (5,)).select("date", "ticker", C("z").alias("flow_5"))
    return al.join_on_cells([samples, flow]).select("date", "ticker", "label", rounded(C("flow_5")).alias("flow_5"))


@query(
    "jn10_windows_chart_samples",
    f"""select w.date, w.ticker, r.label, cast(dd >= 0.5 as integer) as crash from ({_win_sql('*')}) w
        join results_long r on r.model = 'c' and r.ticker = w.ticker and r.date = w.date""",
)
def jn10(spark, sf):
    charts = tables.results(spark, sf, ["c"]).select("date", "ticker", "label")
    seq = _windows(spark, sf).select("date", "ticker", "target_dd")
    return sm.with_crash_label(al.join_on_cells([charts, seq]), 0.5).select("date", "ticker", "label", "crash")


@query(
    "jn11_windows_n_intervals",
    f"select date, ticker, {', '.join(f"max(case when model = '{m}' then label end) as label_{m}" for m in 'abc')} from results_long"
    f" group by date, ticker having {' and '.join(f"count(case when model = '{m}' then 1 end) > 0" for m in 'abc')}",
)
def jn11(spark, sf):
    rows = tables.results(spark, sf, ["a", "b", "c"])
    return al.cells_of_all(rows, "model", {f"label_{m}": m for m in ("a", "b", "c")}, "label")


@query(
    "jn15_common_tickers",
    """select ticker from (select distinct ticker from flow_roll where value is not null and year(date) in (1996, 1997)
        union select distinct ticker from bars_m where volume > 150 and year(date) in (1996, 1997))
       where ticker in (select ticker from mktcap_w where cap is not null)""",
)
def jn15(spark, sf):
    rolled = rolling_sums(tables.grid(spark, sf, values=["flow"]), "flow", [5, 20])
    heavy = tables.bars(spark, sf, "M").where(C("volume") > 150).select("date", "ticker", C("volume").alias("value"))
    caps = tables.market_caps(spark, sf).where(C("cap").isNotNull())
    return al.common_tickers([rolled.select("date", "ticker", "value"), heavy], caps, (1996, 1997))
