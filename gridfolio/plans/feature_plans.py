"""Registered queries: window features, normalisation, validity."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridfolio.functions import features as feat
from gridfolio.functions.ewm import with_ewm
from gridfolio.functions.expr import by_ticker, div, full_window, rounded, trailing
from gridfolio.operators import panels
from gridfolio.plans.registry import query
from gridfolio.plans.views_sql import r, view
from gridfolio.sources import tables

W = "window t as (partition by ticker order by pos)"


def fr(n: int) -> str:
    return f"(partition by ticker order by pos rows between {n - 1} preceding and current row)"


view(
    "views_w",
    """select ticker, pos, date, open, high, low, close, volume,
        case when nullif(close, 0) / nullif(lag(nullif(close, 0)) over t, 0) > 0
             then ln(nullif(close, 0) / nullif(lag(nullif(close, 0)) over t, 0)) end as lr,
        lag(close) over t as prev, close - lag(close) over t as diff,
        (high + low + close) / 3 as tp,
        (high + low + close) / 3 - lag((high + low + close) / 3) over t as dtp
       from grid_w window t as (partition by ticker order by pos)""",
)

FEATURE_SQL = {
    "ft1_logreturn": ("logreturn", {}, "lr"),
    "ft2_hlspread": ("hlspread", {}, "(high - low) / nullif(close, 0)"),
    "ft3_ocgap": ("ocgap", {}, "(open - nullif(prev, 0)) / nullif(prev, 0)"),
    "ft4_volumez": ("volumez", {"vol_win": 20}, f"volume / nullif(avg(volume) over {fr(20)}, 0) - 1"),
    "ft5_magap": ("magap", {"window": 20}, f"close / nullif(avg(close) over {fr(20)}, 0) - 1"),
    "ft6_rollingvol": ("rollingvol", {"window": 20}, f"stddev_samp(lr) over {fr(20)}"),
    "ft7_rsi": (
        "rsi",
        {"window": 14},
        f"""(100 - 100 / (1 + avg(case when diff > 0 then diff else 0 end) over {fr(14)}
            / nullif(avg(case when diff < 0 then -diff else 0 end) over {fr(14)}, 0))) / 100 - 0.5""",
    ),
    "ft9_ma": ("ma", {"window": 20}, f"(close - avg(close) over {fr(20)}) / nullif(avg(close) over {fr(20)}, 0)"),
    "ft11_bb": (
        "bb",
        {"window": 20, "num_std": 2.0},
        f"""(close - (avg(close) over {fr(20)} - 2 * stddev_samp(close) over {fr(20)}))
            / nullif(4 * stddev_samp(close) over {fr(20)}, 0) - 0.5""",
    ),
    "ft12_atr": (
        "atr",
        {"window": 14},
        f"""avg(case when high is not null and low is not null and prev is not null
            then greatest(high - low, abs(high - prev), abs(low - prev)) end) over {fr(14)} / nullif(close, 0)""",
    ),
    "ft13_downsidevol": (
        "downsidevol",
        {"window": 20},
        f"sqrt(avg(case when lr < 0 then lr * lr else 0 end) over {fr(20)})",
    ),
    "ft16_mfi": (
        "mfi",
        {"window": 14},
        f"""(100 - 100 / (1 + sum(case when dtp > 0 then tp * volume else 0 end) over {fr(14)}
            / nullif(sum(case when dtp < 0 then tp * volume else 0 end) over {fr(14)}, 0))) / 100 - 0.5""",
    ),
}


def _feature(name: str, params: dict):
    def run(spark, sf):
        cells = feat.REGISTRY[name](tables.grid(spark, sf, values=tables.OHLCV), out="value", **params)
        return cells.select("ticker", "date", rounded(F.col("value")).alias("value"))

    return run


for _key, (_name, _params, _sql) in FEATURE_SQL.items():
    query(_key, f"select ticker, date, {r(_sql)} as value from views_w")(_feature(_name, _params))

query(
    "ft14_ulcer",
    f"""select ticker, date, {r(f"sqrt(avg(dd * dd) over {fr(20)})")} as value from (
        select *, close / nullif(max(close) over {fr(20)}, 0) - 1 as dd from views_w)""",
)(_feature("ulcer", {"window": 20}))
query(
    "ft15_stoch",
    f"""select ticker, date, {r(f"coalesce(avg(ks) over {fr(3)}, 0) - 0.5")} as value from (
        select *, avg(k) over {fr(3)} as ks from (
        select *, (close - min(low) over {fr(14)}) / nullif(max(high) over {fr(14)} - min(low) over {fr(14)}, 0) as k
        from views_w))""",
)(_feature("stoch", {"window": 14, "smooth_k": 3, "smooth_d": 3}))


def ewm_step(value: str, span: float, state: str, gap: str) -> str:
    """One recursive step: the new state from the old one, the value and the gap in rows."""
    a = 2.0 / (span + 1.0)
    q = 1.0 - a
    return f"""case when {value} is null then {state} when {state} is null then {value}
        else (pow({q!r}, {gap}) * {state} + {a!r} * {value}) / (pow({q!r}, {gap}) + {a!r}) end"""


EWM_SQL = f"""
with recursive walk as (
    select ticker, pos, date, close, close as y, case when close is not null then pos end as seen
    from grid_w where pos = 1
    union all
    select g.ticker, g.pos, g.date, g.close, {ewm_step("g.close", 20, "w.y", "(g.pos - w.seen)")},
        case when g.close is not null then g.pos else w.seen end
    from walk w join grid_w g on g.ticker = w.ticker and g.pos = w.pos + 1)
"""


@query("ft17_ewm", EWM_SQL + f"select ticker, date, {r('y')} as value from walk")
def ft17(spark, sf):
    return with_ewm(tables.grid(spark, sf, values=["close"]), "close", 20, "value").select(
        "ticker", "date", rounded(F.col("value")).alias("value")
    )


query("ft10_ema", EWM_SQL + f"select ticker, date, {r('(close - y) / nullif(y, 0)')} as value from walk")(
    _feature("ema", {"window": 20})
)

query(
    "ft8_macd",
    f"""
with recursive walk as (
    select ticker, pos, date, close, close as f, close as s, case when close is not null then 0.0::double end as sig,
        case when close is not null then pos end as seen
    from grid_w where pos = 1
    union all
    select ticker, pos, date, close, f, s, {ewm_step("(f - s)", 9, "sig0", "1")}, seen from (
        select g.ticker, g.pos, g.date, g.close, {ewm_step("g.close", 12, "w.f", "(g.pos - w.seen)")} as f,
            {ewm_step("g.close", 26, "w.s", "(g.pos - w.seen)")} as s, w.sig as sig0,
            case when g.close is not null then g.pos else w.seen end as seen
        from walk w join grid_w g on g.ticker = w.ticker and g.pos = w.pos + 1))
select ticker, date, {r("(f - s - sig) / nullif(close, 0)")} as value from walk""",
)(_feature("macd", {"fast": 12, "slow": 26, "signal": 9}))

SPECS = ["logreturn", ("magap", {"window": 10}), {"name": "stoch", "window": 14}, "volumez"]
view(
    "feature_set",
    f"""select ticker, pos, date, close, lr as f0, close / nullif(avg(close) over {fr(10)}, 0) - 1 as f1,
        coalesce(avg(ks) over {fr(3)}, 0) - 0.5 as f2, volume / nullif(avg(volume) over {fr(20)}, 0) - 1 as f3
        from (select *, avg(k) over {fr(3)} as ks from (
            select *, (close - min(low) over {fr(14)}) / nullif(max(high) over {fr(14)} - min(low) over {fr(14)}, 0) as k
            from views_w))""",
)


def feature_set(spark, sf):
    return feat.add_features(tables.grid(spark, sf, values=tables.OHLCV), SPECS, vol_win=20)


@query(
    "ft18_feature_resolver",
    f"select ticker, date, {r('f0')} as f0_logreturn, {r('f1')} as f1_magap, {r('f2')} as f2_stoch, "
    f"{r('f3')} as f3_volumez from feature_set",
)
def ft18(spark, sf):
    cells, names = feature_set(spark, sf)
    return cells.select("ticker", "date", *[rounded(F.col(n)).alias(n) for n in names])


@query(
    "ft19_validity_mask",
    f"""select ticker, date, cast(f0 is not null and f1 is not null and f2 is not null and f3 is not null
            and (f0 <> 0 or f1 <> 0 or f2 <> 0 or f3 <> 0) as integer) as valid,
        {r('coalesce(f0, 0)')} as f0_logreturn, {r('coalesce(f3, 0)')} as f3_volumez from feature_set""",
)
def ft19(spark, sf):
    cells, names = feature_set(spark, sf)
    out = feat.validity(cells, names, zero_invalid=True)
    return out.select(
        "ticker",
        "date",
        F.col("valid").cast("int").alias("valid"),
        rounded(F.col("f0_logreturn")).alias("f0_logreturn"),
        rounded(F.col("f3_volumez")).alias("f3_volumez"),
    )


def _norm_sql(part: str) -> str:
    def z(c: str) -> str:
        sd = f"stddev_pop({c}) over (partition by {part})"
        return r(f"({c} - avg({c}) over (partition by {part})) / case when {sd} = 0 then 1 else {sd} end")

    return f"""select ticker, date, {z('f0')} as f0_logreturn, {z('f1')} as f1_magap, {z('f3')} as f3_volumez
        from feature_set"""


def _norm_out(cells):
    return cells.select(
        "ticker", "date", *[rounded(F.col(n)).alias(n) for n in ("f0_logreturn", "f1_magap", "f3_volumez")]
    )


@query("agg22_asset_normalisation", _norm_sql("ticker"))
def agg22(spark, sf):
    return _norm_out(feat.normalise_asset(*feature_set(spark, sf)))


@query("agg23_cross_normalisation", _norm_sql("pos"))
def agg23(spark, sf):
    return _norm_out(feat.normalise_cross(*feature_set(spark, sf)))


FLOW_SQL = """
    select g.ticker, g.pos, g.date, g.flow / nullif(m.cap, 0) as ratio
    from grid_w g join mktcap_w m on m.ticker = g.ticker and m.pos = g.pos"""
NORM_YEARS = (1995, 1996, 1997, 1998)


def _flow_ratio(spark, sf):
    cells = tables.grid(spark, sf, values=["flow", "amount"])
    cells = cells.withColumn("cap", F.sum("amount").over(trailing(52)))
    return cells.select("ticker", "pos", "date", div(F.col("flow"), F.col("cap")).alias("ratio"))


_Z = """(ratio - avg(case when year(date) in (1995, 1996, 1997, 1998) then ratio end) over (partition by ticker))
    / nullif(stddev_pop(case when year(date) in (1995, 1996, 1997, 1998) then ratio end)
             over (partition by ticker), 0)"""


@query("agg24_train_year_zscore", f"select ticker, date, {r(_Z)} as z from ({FLOW_SQL})")
def agg24(spark, sf):
    z = panels.zscore_on_years(_flow_ratio(spark, sf), "ratio", NORM_YEARS, "z")
    return z.select("ticker", "date", rounded(F.col("z")).alias("z"))


@query(
    "agg25_flow_ratio",
    f"""select ticker, date, {r('z')} as z from (
        select *, count(z) over (partition by date) as n from (select *, {_Z} as z from ({FLOW_SQL})))
        where n > 0 and year(date) in (1996, 1997)""",
)
def agg25(spark, sf):
    z = panels.zscore_on_years(_flow_ratio(spark, sf), "ratio", NORM_YEARS, "z")
    z = panels.drop_empty_dates(panels.in_years(z, (1996, 1997)), "z")
    return z.select("ticker", "date", rounded(F.col("z")).alias("z"))


def _wn1_sql() -> str:
    parts = []
    for w in (5, 20, 60):
        parts.append(
            f"""select {w} as window_rows, ticker, date, {r(f"case when count(flow) over {fr(w)} = {w} then sum(flow) over {fr(w)} end", 4)}
                as value, pos from grid_w"""
        )
    return f"select window_rows, ticker, date, value from ({' union all '.join(parts)}) where pos >= window_rows"


@query("wn1_rolling_sum", _wn1_sql())
def wn1(spark, sf):
    cells = tables.grid(spark, sf, values=["flow"])
    out = panels.rolling_sums(cells, "flow", [5, 20, 60, 20])
    return out.select("window_rows", "ticker", "date", rounded(F.col("value"), 4).alias("value"))


@query(
    "wn2_chart_moving_average",
    f"select ticker, date, {r(f'case when count(close) over {fr(5)} = 5 then avg(close) over {fr(5)} end')} as ma from grid_w",
)
def wn2(spark, sf):
    cells = tables.grid(spark, sf, values=["close"])
    return cells.select("ticker", "date", rounded(full_window(F.col("close"), 5, F.avg("close"))).alias("ma"))


@query(
    "wn16_forward_fill",
    f"select ticker, date, last_value(close ignore nulls) over {fr(100000)} as close from grid_w",
)
def wn16(spark, sf):
    return panels.forward_fill(tables.grid(spark, sf, values=["close"]), ["close"]).select("ticker", "date", "close")


@query("wn12_percent_change", f"select ticker, date, {r('close / nullif(lag(close) over t, 0) - 1')} as ret from grid_w {W}")
def wn12(spark, sf):
    cells = tables.grid(spark, sf, values=["close"])
    return cells.select(
        "ticker", "date", rounded(div(F.col("close"), F.lag("close").over(by_ticker())) - 1.0).alias("ret")
    )
