"""Chart windows and training windows."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfolio.functions.expr import by_ticker, div, full_window, trailing
from gridfolio.operators.calendar import per_day
from gridfolio.sources.store import stored

C = F.col
POINTS = "array<struct<px:int,py:int>>"


# ------------------------------------------------------------------ chart windows


def chart_rows(grid: DataFrame, intervals: int, ma_windows: Sequence[int] = ()) -> tuple[DataFrame, list[str]]:
    """Grid with moving averages and a running count of cells that cannot be drawn."""
    sizes = list(dict.fromkeys(ma_windows)) or [intervals]
    if any(w <= 0 for w in sizes):
        raise ValueError("moving-average windows must be positive")
    names = [f"ma{w}" for w in sizes]
    out = grid.withColumns({n: full_window(C("close"), w, F.avg("close")) for n, w in zip(names, sizes)})
    hole = F.lit(False)
    for c in ("open", "high", "low", "close", *names):
        hole = hole | C(c).isNull()
    line = by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("holes", F.sum(hole.cast("int")).over(line)), names


def valid_starts(rows: DataFrame, intervals: int, names: Sequence[str]) -> DataFrame:
    """Rows late enough in the calendar with every moving average present."""
    ok = C("pos") >= intervals
    for n in names:
        ok = ok & C(n).isNotNull()
    return rows.where(ok)


def chart_windows(
    rows: DataFrame, intervals: int, names: Sequence[str], extra: Mapping[str, Column] | None = None
) -> DataFrame:
    """Start, end and estimation dates over the valid rows of each ticker, with label.

    A window is kept when its calendar span holds no gap; the label compares the
    closes at the two estimation dates. ``extra`` columns are aggregates over the
    rows of the window.
    """
    n, line = intervals, by_ticker()
    price = F.array("open", "high", "low", "close", *names)
    ahead = by_ticker().rowsBetween(0, n - 1)
    steps = valid_starts(rows, n, names).select(
        "ticker",
        C("pos").alias("pos"),
        C("date").alias("start_date"),
        C("close").alias("first_close"),
        C("holes").alias("holes_0"),
        F.min(F.array_min(price)).over(ahead).alias("low_price"),
        F.max(F.array_max(price)).over(ahead).alias("high_price"),
        F.lead("pos", n - 1).over(line).alias("end_pos"),
        F.lead("date", n - 1).over(line).alias("end_date"),
        F.lead("holes", n - 1).over(line).alias("holes_n"),
        F.lead("date", n).over(line).alias("estimation_start"),
        F.lead("close", n).over(line).alias("c0"),
        F.lead("date", 2 * n).over(line).alias("estimation_end"),
        F.lead("close", 2 * n).over(line).alias("c1"),
        F.lead("pos", 2 * n + 1).over(line).alias("beyond"),
        *[col.over(ahead).alias(name) for name, col in (extra or {}).items()],
    )
    drawn = steps.where(
        C("beyond").isNotNull()
        & (C("holes_n") == C("holes_0"))
        & (C("first_close") != 0)
        & (C("low_price") < C("high_price"))
    )
    up = F.coalesce((div(C("c1"), C("c0")) > 1).cast("int"), F.lit(0))
    return drawn.select(
        "ticker", "start_date", "end_date", "estimation_start", "estimation_end", up.alias("label"),
        C("pos").alias("start_pos"), "end_pos", "first_close", "low_price", "high_price", *(extra or {}),
    )


def chart_heights(height: int, gap: int = 1) -> tuple[int, int, int]:
    """Volume height, price height, price offset."""
    volume = height // 5
    return volume, height - volume - gap, volume + gap


def scaled_bars(rows: DataFrame, intervals: int, names: Sequence[str], height: int) -> DataFrame:
    """One row per (window, bar) with integer pixel heights of prices, averages and volume.

    A gap-free window is a run of consecutive rows, so each window carries its rows
    as a short array of ``intervals`` entries.
    """
    vol_h, price_h, offset = chart_heights(height)
    fields = ["open", "high", "low", "close", *names]
    extra = {"cells": F.collect_list(F.struct(*fields, "volume")), "max_volume": F.max("volume")}
    joined = chart_windows(rows, intervals, names, extra)
    bars = joined.select("*", F.posexplode("cells").alias("i", "c"))
    base = C("first_close")
    low, high = C("low_price") / base, C("high_price") / base

    def y(field: str) -> Column:
        return ((C(f"c.{field}") / base - low) / (high - low) * (price_h - 1) + offset).cast("int").alias(field)

    bar = F.coalesce(div(C("c.volume"), F.when(C("max_volume") > 0, C("max_volume"))) * (vol_h - 1), F.lit(0.0))
    return bars.select("ticker", "start_date", "end_date", "i", *[y(f) for f in fields], bar.cast("int").alias("volume"))


def pixels(bars: DataFrame, intervals: int, names: Sequence[str], height: int) -> DataFrame:
    """Sparse drawn pixels (px, py) per window, row 0 at the top.

    Each bar lists its own points: open and close ticks, the low-high line, the
    volume line, and the average's segment to the next bar. All of it stays in the
    partitioning by ticker.
    """
    key = ["ticker", "start_date", "end_date"]
    line = Window.partitionBy(*key).orderBy("i")
    x = C("i") * 3

    def point(px: Column, py: Column) -> Column:
        return F.struct(px.cast("int").alias("px"), py.cast("int").alias("py"))

    def upright(lo: Column, hi: Column) -> Column:
        return F.transform(F.sequence(lo, hi), lambda y: point(x + 1, y))

    def segment(y0: Column, y1: Column) -> Column:
        steps = F.greatest(F.abs(y1 - y0), F.lit(3))
        walked = F.transform(
            F.sequence(F.lit(0), steps),
            lambda k: point(x + F.floor(3.0 * k / steps + 0.5), y0 + F.floor((y1 - y0) * k / steps + 0.5)),
        )
        return F.coalesce(walked, F.array().cast(POINTS))

    ahead = bars.select("*", *[F.lead(n).over(line).alias(f"{n}_next") for n in names])
    points = F.concat(
        F.array(point(x, C("open")), point(x + 2, C("close"))),
        upright(F.least("low", "high"), F.greatest("low", "high")),
        upright(F.lit(0), C("volume")),
        *[segment(C(n), C(f"{n}_next")) for n in names],
    )
    drawn = ahead.select(*key, F.explode(points).alias("p")).select(*key, "p.px", "p.py")
    inside = drawn.where(C("py").between(0, height - 1) & C("px").between(0, 3 * intervals - 1))
    return inside.select(*key, "px", (height - 1 - C("py")).alias("py")).distinct()


def packed_charts(points: DataFrame, keys: Sequence[str], width: int, height: int) -> DataFrame:
    """(keys, raster): one binary image per window, a bit per pixel.

    Rows run from the top, each padded to whole bytes, the leftmost pixel in the highest bit. The bits of 32 neighbouring
    pixels meet in one ``bit_or``, so a window is brought together as a few dozen numbers and never as its points.
    """
    row_bytes = (width + 7) // 8
    words = (row_bytes * height + 3) // 4
    inside = points.where(C("px").between(0, width - 1) & C("py").between(0, height - 1))
    bit = C("py").cast("long") * (8 * row_bytes) + C("px")
    one = F.expr(f"shiftleft(1L, cast(31 - pmod(cast(py as bigint) * {8 * row_bytes} + px, 32) as int))")
    some = inside.groupBy(*keys, F.floor(bit / 32).cast("int").alias("word")).agg(F.bit_or(one).alias("bits"))
    lists = some.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("some"))
    # words without a pixel are the zeros between two that have one
    def with_gap(w: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get("some", i - 1)["word"])
        return F.concat(F.repeat(F.lit("00000000"), w["word"] - before - 1), F.lpad(F.hex(w["bits"]), 8, "0"))

    text = F.rpad(F.array_join(F.transform("some", with_gap), ""), 8 * words, "0")
    return lists.select(*keys, F.unhex(F.substring(text, 1, 2 * row_bytes * height)).alias("raster"))


def unpacked_charts(rasters: DataFrame, keys: Sequence[str], width: int, height: int) -> DataFrame:
    """The sparse (px, py) points of ``packed_charts``."""
    row_bytes = (width + 7) // 8
    at = rasters.select(*keys, "raster", F.explode(F.sequence(F.lit(0), F.lit(row_bytes * height - 1))).alias("byte"))
    value = F.conv(F.hex(F.expr("substring(raster, byte + 1, 1)")), 16, 10).cast("int")
    bits = at.withColumn("value", value).where("value <> 0").select(*keys, "byte", "value", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("b"))
    lit = bits.where(F.expr("value & shiftright(128, b)") != 0)
    return lit.select(*keys, (C("byte") % row_bytes * 8 + C("b")).alias("px"), F.floor(C("byte") / row_bytes).cast("int").alias("py"))


# ------------------------------------------------------------------ training windows


def forward_return(horizon: int) -> Column:
    return div(F.lead("close", horizon).over(by_ticker()), C("close")) - 1.0


def forward_drawdown(horizon: int) -> Column:
    """Largest fall from a running peak over the next ``horizon`` rows, step by step over an array; for short horizons."""
    ahead = F.collect_list("close").over(by_ticker().rowsBetween(0, horizon))
    rel = F.transform(ahead, lambda p: div(p, F.get(ahead, F.lit(0))))
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("fall"))

    def step(acc: Column, v: Column) -> Column:
        peak = F.greatest(acc["peak"], v)
        return F.struct(peak.alias("peak"), F.greatest(acc["fall"], (peak - v) / (peak + 1e-8)).alias("fall"))

    return F.aggregate(rel, start, step, lambda acc: acc["fall"])


def with_forward_drawdown(df: DataFrame, horizon: int, out: str, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Add the largest fall from a running peak over the next ``horizon`` rows.

    A run of rows is summed up by its peak, its trough and its deepest fall (from which price to which), and two
    neighbouring runs by those of both and the fall from the first one's peak to the second one's trough. Runs of
    1, 2, 4, ... rows are put together, so a row reads about 2 log2(horizon) others and holds no array. Missing prices
    are passed over; a row without a positive price of its own has no fall. The deepest fall is chosen by the ratio of
    its prices and then measured with the constant that keeps the denominator from zero, which differs by less than that.
    """
    if horizon < 0:
        raise ValueError("the horizon must not be negative")
    line, width = Window.partitionBy(*keys).orderBy("pos"), horizon + 1

    def fall(top: Column, low: Column) -> Column:
        return F.when((top > 0) & low.isNotNull(), F.struct((1.0 - low / top).alias("depth"), top.alias("top"), low.alias("low")))

    def state(peak: Column, trough: Column, deepest: Column) -> Column:
        return F.struct(peak.alias("peak"), trough.alias("trough"), deepest.alias("fall"))

    def joined(a: Column, b: Column) -> Column:
        across = fall(a["peak"], b["trough"])
        deepest = F.greatest(a["fall"], b["fall"], across)
        return state(F.greatest(a["peak"], b["peak"]), F.least(a["trough"], b["trough"]), deepest)

    def ahead(name: str, n: int) -> Column:
        """The run that begins ``n`` rows on; beyond the last row an empty one."""
        return F.coalesce(F.lead(name, n).over(line), F.lit(None).cast(_RUN))

    price = C("close").cast("double")
    step = df.withColumn("_run", state(price, price, fall(price, price)))
    covered = 0
    for k in range(width.bit_length()):
        if width >> k & 1:
            step = step.withColumn("_all", C("_run") if not covered else joined(C("_all"), ahead("_run", covered)))
            covered += 1 << k
        if width >> (k + 1):
            step = step.withColumn("_run", joined(C("_run"), ahead("_run", 1 << k)))
    deepest = C("_all.fall")
    measured = (deepest["top"] - deepest["low"]) / (deepest["top"] + 1e-8 * C("close"))
    return step.withColumn(out, F.when(C("close") > 0, measured)).drop("_run", "_all")


_RUN = "struct<peak:double,trough:double,fall:struct<depth:double,top:double,low:double>>"


def training_windows(
    cells: DataFrame,
    names: Sequence[str],
    n_dates: int | Column,
    *,
    lookback: int,
    horizon: int,
    min_valid: float = 0.8,
    min_assets: int = 1,
    stride: int = 1,
    threshold: float | None = None,
) -> DataFrame:
    """Windows that end at (date, ticker): features, forward return (or class) and drawdown.

    ``cells`` is a dense grid with ``valid`` and the feature columns. Which rows end a window is settled first; then the
    rows of a ticker are brought together in lines of a few hundred, with the rows before them that their windows reach
    back to, and only the windows that are kept are cut out of the lines.
    """
    need = math.ceil(lookback * min_valid)
    total = n_dates if isinstance(n_dates, Column) else F.lit(n_dates)
    ahead = by_ticker().rowsBetween(0, horizon)
    steps = with_forward_drawdown(cells, horizon, "target_dd").select(
        "ticker",
        "pos",
        "date",
        F.array(*[C(n).cast("float") for n in names]).alias("f"),
        F.sum(C("valid").cast("int")).over(trailing(lookback)).alias("n_valid"),
        F.count("close").over(ahead).alias("n_ahead"),
        forward_return(horizon).alias("target_ret"),
        "target_dd",
    )
    ends = (
        (C("pos") >= lookback)
        & ((C("pos") - lookback) % stride == 0)
        & (C("pos") + horizon <= total)
        & (C("n_valid") >= need)
        & (C("n_ahead") == horizon + 1)
        & C("target_ret").isNotNull()
    )
    rows = steps.select("ticker", "pos", "date", "f", "target_ret", "target_dd", F.coalesce(ends, F.lit(False)).alias("ends"))
    if min_assets > 1:
        rows = stored(rows, "steps")
        full = rows.where("ends").groupBy("pos").agg(F.count(F.lit(1)).alias("n")).where(C("n") >= min_assets).select("pos", F.lit(True).alias("full"))
        rows = rows.join(per_day(full, "pos"), "pos", "left").withColumn("ends", C("ends") & C("full").isNotNull())
    long = max(256, 4 * lookback)
    first, last = (F.floor((C("pos") - 1 + back) / long).cast("int") for back in (0, lookback - 1))
    spread = rows.select("*", F.explode(F.sequence(first, last)).alias("line_no"))
    own = C("ends") & (C("line_no") == first)
    cell = F.struct("pos", "f", own.alias("ends"), "date", "target_ret", "target_dd")
    lines = spread.groupBy("ticker", "line_no").agg(F.array_sort(F.collect_list(cell)).alias("line"))

    def window(end: Column) -> Column:
        start = end["pos"] - F.get("line", F.lit(0))["pos"] - lookback + 2
        x = F.transform(F.slice("line", start, F.lit(lookback)), lambda r: r["f"])
        return F.struct(end["date"].alias("date"), x.alias("x"), end["target_ret"].alias("ret"), end["target_dd"].alias("target_dd"))

    kept = lines.select("ticker", F.explode(F.transform(F.filter("line", lambda r: r["ends"]), window)).alias("w"))
    target = C("w.ret") if threshold is None else (C("w.ret") > threshold).cast("double")
    return kept.select("w.date", "ticker", "w.x", target.alias("target_cls"), "w.target_dd")


def score_windows(
    windows: DataFrame, predict: Callable[[pd.Series], pd.DataFrame], schema: str, keys: Sequence[str] = ("date", "ticker")
) -> DataFrame:
    """Run a user's batch model over windows: ``predict`` maps a series of arrays to columns."""
    cols = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = predict(pdf["x"]).reset_index(drop=True)
            yield pd.concat([pdf[cols].reset_index(drop=True), out], axis=1)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in windows.schema if f.name in cols)
    return windows.select(*cols, "x").mapInPandas(run, f"{kinds}, {schema}")


#: models of this Python worker, by the name that the driver gave to their factory
_MODELS: dict[str, Mapping[str, Callable[[pd.Series], pd.DataFrame]]] = {}


def models_of(name: str, factory: Callable[[], Mapping[str, Callable[[pd.Series], pd.DataFrame]]]):
    """What the factory has loaded in this worker; a worker runs many tasks and calls the factory once."""
    if name not in _MODELS:
        _MODELS[name] = factory()
    return _MODELS[name]


def score_with_models(
    windows: DataFrame, factory: Callable[[], Mapping[str, Callable[[pd.Series], pd.DataFrame]]], schema: str, keys: Sequence[str] = ("date", "ticker")
) -> DataFrame:
    """(keys, model, columns of ``schema``): every window scored by every model, the windows read once.

    ``factory`` loads the models, a mapping from name to batch function, and runs once per Python worker. The result
    is what the ensembles take. Workers must be able to import this package.
    """
    cols, name = list(keys), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from gridfolio.operators.samples import models_of

        for pdf in batches:
            for model, predict in models_of(name, factory).items():
                yield pd.concat([pdf[cols].reset_index(drop=True).assign(model=model), predict(pdf["x"]).reset_index(drop=True)], axis=1)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in windows.schema if f.name in cols)
    return windows.select(*cols, "x").mapInPandas(run, f"{kinds}, model string, {schema}")


def with_crash_label(samples: DataFrame, threshold: float) -> DataFrame:
    return samples.withColumn("crash", (C("target_dd") >= threshold).cast("int"))
