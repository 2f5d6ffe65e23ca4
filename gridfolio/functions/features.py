"""Technical indicators as builders ``DataFrame -> DataFrame`` on the dense grid.

Every builder adds one column. All frames are ``partition by ticker order by
pos``, so a set of indicators shares one shuffle and one sort. Conventions kept on
purpose because results depend on them: ``volumez`` is a ratio, ``rsi`` is NULL in
windows without a loss, ``stoch`` reads -0.5 where it is undefined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfolio.functions.ewm import with_ewm, with_ewms
from gridfolio.functions.expr import by_ticker, div, trailing, zero_to_null
from gridfolio.operators.calendar import per_day

Builder = Callable[..., DataFrame]

C = F.col


def _safe_close() -> Column:
    return zero_to_null(C("close"))


def _log_return() -> Column:
    ratio = div(_safe_close(), F.lag(_safe_close()).over(by_ticker()))
    return F.when(ratio > 0, F.ln(ratio))


def _move(col: Column) -> Column:
    return col - F.lag(col).over(by_ticker())


def _signed(move: Column, amount: Column, up: bool) -> Column:
    """``amount`` where the move has the wanted sign, else 0 (also for an undefined move)."""
    return F.when((move > 0) if up else (move < 0), amount).otherwise(0.0)


def logreturn(df: DataFrame, out: str = "logreturn") -> DataFrame:
    return df.withColumn(out, _log_return())


def hlspread(df: DataFrame, out: str = "hlspread") -> DataFrame:
    return df.withColumn(out, div(C("high") - C("low"), C("close")))


def ocgap(df: DataFrame, out: str = "ocgap") -> DataFrame:
    prev = F.lag(_safe_close()).over(by_ticker())
    return df.withColumn(out, div(C("open") - prev, prev))


def volumez(df: DataFrame, out: str = "volumez", vol_win: int = 20) -> DataFrame:
    return df.withColumn(out, div(C("volume"), F.avg("volume").over(trailing(vol_win))) - 1.0)


def magap(df: DataFrame, out: str = "magap", window: int = 20) -> DataFrame:
    return df.withColumn(out, div(C("close"), F.avg("close").over(trailing(window))) - 1.0)


def ma(df: DataFrame, out: str = "ma", window: int = 20) -> DataFrame:
    mean = F.avg("close").over(trailing(window))
    return df.withColumn(out, div(C("close") - mean, mean))


def rollingvol(df: DataFrame, out: str = "rollingvol", window: int = 20) -> DataFrame:
    step = df.withColumn("_r", _log_return())
    return step.withColumn(out, F.stddev_samp("_r").over(trailing(window))).drop("_r")


def _ratio_index(pos: Column, neg: Column) -> Column:
    """100 - 100 / (1 + pos/neg), scaled from [0, 100] to [-0.5, 0.5]."""
    return (100.0 - 100.0 / (1.0 + div(pos, neg))) / 100.0 - 0.5


def rsi(df: DataFrame, out: str = "rsi", window: int = 14) -> DataFrame:
    step = df.withColumn("_m", _move(C("close")))
    step = step.withColumn("_up", _signed(C("_m"), C("_m"), True)).withColumn("_dn", _signed(C("_m"), -C("_m"), False))
    frame = trailing(window)
    return step.withColumn(out, _ratio_index(F.avg("_up").over(frame), F.avg("_dn").over(frame))).drop("_m", "_up", "_dn")


def mfi(df: DataFrame, out: str = "mfi", window: int = 14) -> DataFrame:
    typical = (C("high") + C("low") + C("close")) / 3.0
    step = df.withColumn("_tp", typical).withColumn("_m", _move(C("_tp")))
    money = C("_tp") * C("volume")
    step = step.withColumn("_up", _signed(C("_m"), money, True)).withColumn("_dn", _signed(C("_m"), money, False))
    frame = trailing(window)
    return step.withColumn(out, _ratio_index(F.sum("_up").over(frame), F.sum("_dn").over(frame))).drop(
        "_tp", "_m", "_up", "_dn"
    )


def macd(df: DataFrame, out: str = "macd", fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    step = with_ewms(df, "close", {"_f": fast, "_s": slow})
    step = with_ewm(step.withColumn("_line", C("_f") - C("_s")), "_line", signal, "_sig")
    return step.withColumn(out, div(C("_line") - C("_sig"), C("close"))).drop("_f", "_s", "_line", "_sig")


def ema(df: DataFrame, out: str = "ema", window: int = 20) -> DataFrame:
    return with_ewm(df, "close", window, "_e").withColumn(out, div(C("close") - C("_e"), C("_e"))).drop("_e")


def bb(df: DataFrame, out: str = "bb", window: int = 20, num_std: float = 2.0) -> DataFrame:
    frame = trailing(window)
    mean, half = F.avg("close").over(frame), F.stddev_samp("close").over(frame) * num_std
    lower, upper = mean - half, mean + half
    return df.withColumn(out, div(C("close") - lower, upper - lower) - 0.5)


def atr(df: DataFrame, out: str = "atr", window: int = 14) -> DataFrame:
    step = df.withColumn("_p", F.lag("close").over(by_ticker()))
    parts = [C("high") - C("low"), F.abs(C("high") - C("_p")), F.abs(C("low") - C("_p"))]
    known = C("high").isNotNull() & C("low").isNotNull() & C("_p").isNotNull()
    step = step.withColumn("_tr", F.when(known, F.greatest(*parts)))
    return step.withColumn(out, div(F.avg("_tr").over(trailing(window)), C("close"))).drop("_p", "_tr")


def downsidevol(df: DataFrame, out: str = "downsidevol", window: int = 20) -> DataFrame:
    step = df.withColumn("_r", _log_return())
    step = step.withColumn("_n", F.when(C("_r") < 0, C("_r") * C("_r")).otherwise(0.0))
    return step.withColumn(out, F.sqrt(F.avg("_n").over(trailing(window)))).drop("_r", "_n")


def ulcer(df: DataFrame, out: str = "ulcer", window: int = 20) -> DataFrame:
    step = df.withColumn("_d", div(C("close"), F.max("close").over(trailing(window))) - 1.0)
    return step.withColumn(out, F.sqrt(F.avg(C("_d") * C("_d")).over(trailing(window)))).drop("_d")


def stoch(df: DataFrame, out: str = "stoch", window: int = 14, smooth_k: int = 3, smooth_d: int = 3) -> DataFrame:
    frame = trailing(window)
    low, high = F.min("low").over(frame), F.max("high").over(frame)
    step = df.withColumn("_k", div(C("close") - low, high - low))
    step = step.withColumn("_ks", F.avg("_k").over(trailing(smooth_k)))
    return step.withColumn(out, F.coalesce(F.avg("_ks").over(trailing(smooth_d)), F.lit(0.0)) - 0.5).drop("_k", "_ks")


REGISTRY: dict[str, Builder] = {
    f.__name__: f
    for f in (
        logreturn, hlspread, ocgap, volumez, magap, rollingvol, rsi, macd,
        ma, ema, bb, atr, downsidevol, ulcer, stoch, mfi,
    )
}

Spec = str | tuple[str, Mapping[str, object]] | Mapping[str, object]


def resolve(spec: Spec) -> tuple[str, dict[str, object]]:
    """A feature given as name, (name, parameters) or mapping; the input is not consumed."""
    if isinstance(spec, str):
        name, params = spec, {}
    elif isinstance(spec, Mapping):
        name, params = str(spec["name"]), {k: v for k, v in spec.items() if k != "name"}
    else:
        name, params = spec[0], dict(spec[1])
    if name not in REGISTRY:
        raise KeyError(f"Unknown feature: {name}")
    return name, params


def add_features(df: DataFrame, specs: Iterable[Spec], vol_win: int = 20) -> tuple[DataFrame, list[str]]:
    """Add one column per spec, named ``f0_<name>``, ``f1_<name>``, ... in list order."""
    names: list[str] = []
    for i, spec in enumerate(specs):
        name, params = resolve(spec)
        if name == "volumez":
            params.setdefault("vol_win", vol_win)
        out = f"f{i}_{name}"
        df = REGISTRY[name](df, out=out, **params)
        names.append(out)
    return df, names


def normalise_asset(df: DataFrame, names: list[str]) -> DataFrame:
    """Per ticker: subtract the full-sample mean, divide by the population deviation (0 -> 1)."""
    whole = Window.partitionBy("ticker")
    for n in names:
        sd = F.stddev_pop(n).over(whole)
        df = df.withColumn(f"_{n}", (C(n) - F.avg(n).over(whole)) / F.when(sd == 0, 1.0).otherwise(sd))
    return df.drop(*names).withColumnsRenamed({f"_{n}": n for n in names})


def normalise_cross(df: DataFrame, names: list[str]) -> DataFrame:
    """Per date. A date holds every ticker, so the moments are aggregated and joined back."""
    moments = df.groupBy("pos").agg(
        *[F.avg(n).alias(f"_m{i}") for i, n in enumerate(names)],
        *[F.stddev_pop(n).alias(f"_s{i}") for i, n in enumerate(names)],
    )
    keep = [c for c in df.columns if c not in names]
    scaled = [
        ((C(n) - C(f"_m{i}")) / F.when(C(f"_s{i}") == 0, 1.0).otherwise(C(f"_s{i}"))).alias(n)
        for i, n in enumerate(names)
    ]
    return df.join(per_day(moments, "pos"), "pos").select(*keep, *scaled)


def validity(df: DataFrame, names: list[str], zero_invalid: bool = False) -> DataFrame:
    """Add ``valid`` (every feature present, optionally any non-zero), then NULL -> 0."""
    ok = C(names[0]).isNotNull()
    for n in names[1:]:
        ok = ok & C(n).isNotNull()
    if zero_invalid:
        some = F.coalesce(C(names[0]) != 0, F.lit(True))
        for n in names[1:]:
            some = some | F.coalesce(C(n) != 0, F.lit(True))
        ok = ok & some
    return df.withColumn("valid", ok).withColumns({n: F.coalesce(C(n), F.lit(0.0)) for n in names})
