"""Rolling and recursive columns over histories that are too long for one task.

``partition by ticker`` puts a ticker into one task. Here a ticker's calendar positions are cut into blocks of a fixed
number of rows, and rows are keyed by (ticker, block), so one ticker is as many tasks as its history asks for:

- the dense grid is filled block by block, from a mark at the start of each block;
- a rolling column gets, besides its own rows, a halo: the rows before the block that its frames reach back to;
- an exponentially weighted mean is an affine map of its start, so each block is walked from its own first value, the
  blocks' maps are composed in order, one small row each, and the difference at the start is carried into the rows.

All results are those of the plain window functions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfolio.functions import features as feat
from gridfolio.functions.ewm import with_ewm
from gridfolio.functions.expr import div
from gridfolio.operators.calendar import in_parts, per_day
from gridfolio.sources.store import stored

C = F.col

#: rows of a block; a halo should be much smaller
BLOCK_ROWS = 50_000
LINE = ("ticker", "block")


def block_of(pos: Column, rows: int) -> Column:
    """Number of the block of a 1-based position."""
    return F.floor((pos - 1) / rows).cast("int")


def blocked_grid(facts: DataFrame, calendar: DataFrame, values: Sequence[str], rows: int = BLOCK_ROWS) -> DataFrame:
    """``dense_grid`` with the block of each cell; neither a ticker nor a gap of any length is one task's work."""
    placed = facts.join(per_day(calendar, "date"), "date").select("ticker", C("pos").alias("src"), "n_dates", *values)
    placed = placed.withColumn("block", block_of(C("src"), rows))
    every = F.explode(F.sequence(F.lit(0), block_of(C("n_dates"), rows))).alias("block")
    marks = placed.groupBy("ticker").agg(F.max("n_dates").alias("n_dates")).select("ticker", "n_dates", every)
    marks = marks.withColumn("src", C("block") * rows)  # just before the first position of the block
    kinds = dict(placed.dtypes)
    marks = marks.select("ticker", "src", "n_dates", *[F.lit(None).cast(kinds[v]).alias(v) for v in values], "block")
    order = Window.partitionBy(*LINE).orderBy("src")
    last = F.least((C("block") + 1) * rows, C("n_dates"))
    spans = in_parts(placed.unionByName(marks), *LINE).select(
        *LINE, "src", *values,
        F.greatest(C("src"), C("block") * rows + 1).alias("lo"),
        F.coalesce(F.lead("src").over(order) - 1, last).alias("hi"),
    )
    cells = spans.where("hi >= lo").select(*LINE, "src", *values, F.explode(F.sequence("lo", "hi")).alias("pos"))
    here = C("pos") == C("src")
    dated = cells.join(per_day(calendar.select("pos", "date"), "pos"), "pos")
    return dated.select(*LINE, "pos", "date", *[F.when(here, C(v)).alias(v) for v in values])


def over_blocks(cells: DataFrame, reach: int, build: Callable[[DataFrame], DataFrame], rows: int = BLOCK_ROWS) -> DataFrame:
    """``build`` on every block with its halo: its columns may look back ``reach`` rows and no further.

    ``build`` is written for ``partition by ticker order by pos``; the ticker it sees is the (ticker, block) pair.
    """
    first, last = block_of(C("pos"), rows), block_of(C("pos") + reach, rows)
    plain = cells.drop("block")
    spread = plain.withColumn("block", F.explode(F.sequence(first, last)))
    pair, back = _line_name(cells.schema["ticker"].dataType)
    built = build(in_parts(spread.withColumn("ticker", pair), "ticker"))
    own = built.where(C("block") == block_of(C("pos"), rows))
    return own.withColumn("ticker", back)


def _line_name(kind: T.DataType) -> tuple[Column, Column]:
    """A name of the (ticker, block) pair and the ticker of that name; one string where it can be, which sorts fast."""
    if not isinstance(kind, T.StringType):
        return F.struct("ticker", "block"), C("ticker.ticker")
    number = C("block").cast("string")
    pair = F.when(C("ticker").isNotNull(), F.concat(number, F.lit("|"), C("ticker"))).otherwise(number)
    at = F.instr(C("ticker"), "|")
    return pair, F.when(at > 0, F.substr(C("ticker"), at + 1))


# ---------------------------------------------------------------- indicators

#: rows before a row that an indicator reads, from its parameters
REACH: dict[str, Callable[..., int]] = {
    "logreturn": lambda: 1,
    "hlspread": lambda: 0,
    "ocgap": lambda: 1,
    "volumez": lambda vol_win=20: vol_win - 1,
    "magap": lambda window=20: window - 1,
    "ma": lambda window=20: window - 1,
    "rollingvol": lambda window=20: window,
    "rsi": lambda window=14: window,
    "mfi": lambda window=14: window,
    "bb": lambda window=20, num_std=2.0: window - 1,
    "atr": lambda window=14: window,
    "downsidevol": lambda window=20: window,
    "ulcer": lambda window=20: 2 * (window - 1),
    "stoch": lambda window=14, smooth_k=3, smooth_d=3: window + smooth_k + smooth_d - 3,
}
#: indicators whose every value depends on the whole history
RECURSIVE = {"ema", "macd"}


def add_features(cells: DataFrame, specs: Sequence[feat.Spec], vol_win: int = 20, rows: int = BLOCK_ROWS) -> tuple[DataFrame, list[str]]:
    """``features.add_features`` over blocks; the recursive ones come from composed blocks, all others from one halo."""
    names, reach, local, recursive = [], 0, [], []
    for i, spec in enumerate(specs):
        name, params = feat.resolve(spec)
        if name == "volumez":
            params.setdefault("vol_win", vol_win)
        out = f"f{i}_{name}"
        names.append(out)
        if name in RECURSIVE:
            recursive.append((name, out, params))
        else:
            local.append((name, out, params))
            reach = max(reach, REACH[name](**params))

    def build(df: DataFrame) -> DataFrame:
        for name, out, params in local:
            df = feat.REGISTRY[name](df, out=out, **params)
        return df

    done = over_blocks(cells, reach, build, rows)
    for name, out, params in recursive:
        done = {"ema": blocked_ema, "macd": blocked_macd}[name](done, out=out, rows=rows, **params)
    return done, names


# ---------------------------------------------------------------- exponentially weighted means


def blocked_ewm(cells: DataFrame, value: str, span: float, out: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``out``, the exponentially weighted mean of ``value`` along ``pos``, as ``with_ewm`` defines it.

    From its first value on, a block's mean is ``local + decay * (start - first)``: ``local`` starts from that value, ``decay``
    is the product of the weights since then, and ``start`` is what the mean really is there. ``start`` needs the end
    of the block before, so it comes from a fold over one row per block.
    """
    alpha = 2.0 / (span + 1.0)
    q = max(1.0 - alpha, 0.0)
    x = C(value)
    line = Window.partitionBy(*LINE).orderBy("pos")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    cols = [c for c in cells.columns if c != "block"]
    keyed = in_parts(cells.withColumn("block", block_of(C("pos"), rows)), *LINE)
    local = with_ewm(keyed, value, span, "_local", keys=LINE)
    before = F.last(F.when(x.isNotNull(), C("pos")), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    local = local.withColumn("_gap", C("pos") - before)
    weight = F.pow(F.lit(q), C("_gap"))
    step = F.when(x.isNull() | C("_gap").isNull(), F.lit(1.0)).otherwise(weight / (weight + alpha))
    # the product of the weights, as a running sum of logarithms; a weight of nothing ends all memory
    fall = F.when(step > 0, F.ln(step))
    local = local.withColumn("_fall", fall).withColumn("_none", (C("_fall").isNull()).cast("int"))
    decay = F.when(F.max("_none").over(so_far) > 0, 0.0).otherwise(F.exp(F.sum("_fall").over(so_far)))
    local = stored(local.withColumn("_decay", decay).drop("_gap", "_fall", "_none"), "ewm-blocks")

    known = local.where(x.isNotNull()).groupBy(*LINE).agg(
        F.min("pos").alias("first_pos"), F.min_by(value, "pos").alias("first"), F.max("pos").alias("last_pos"),
        F.max_by("_local", "pos").alias("end"), F.max_by("_decay", "pos").alias("decay"),
    )
    block = F.struct("block", "first_pos", "first", "last_pos", "end", "decay")
    lines = known.groupBy("ticker").agg(F.array_sort(F.collect_list(block)).alias("blocks"))  # one entry per block
    empty = F.struct(F.lit(None).cast("double").alias("mean"), F.lit(None).cast("int").alias("pos"), F.array().cast("array<struct<block:int,delta:double,mean:double>>").alias("done"))

    def enter(state: Column, b: Column) -> Column:
        w = F.pow(F.lit(q), b["first_pos"] - state["pos"])
        start = F.when(state["mean"].isNull(), b["first"]).otherwise((w * state["mean"] + alpha * b["first"]) / (w + alpha))
        delta = start - b["first"]
        end = b["end"] + b["decay"] * delta
        done = F.struct(b["block"].alias("block"), delta.alias("delta"), end.alias("mean"))
        return F.struct(end.alias("mean"), b["last_pos"].alias("pos"), F.concat(state["done"], F.array(done)).alias("done"))

    folded = lines.select("ticker", F.explode(F.aggregate("blocks", empty, enter)["done"]).alias("d")).select("ticker", "d.block", "d.delta", "d.mean")
    # what a block is entered with: the mean at the end of the last block before it that has a value
    blocks = local.groupBy(*LINE).agg(F.count(F.lit(1)).alias("n")).join(folded, list(LINE), "left")
    earlier = Window.partitionBy("ticker").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(C("ticker").alias("_ticker"), C("block").alias("_block"), "delta", F.last("mean", ignorenulls=True).over(earlier).alias("carried"))
    joined = local.join(blocks.hint("merge"), (C("ticker") == C("_ticker")) & (C("block") == C("_block")))
    mean = F.when(C("_local").isNotNull(), C("_local") + C("_decay") * C("delta")).otherwise(C("carried"))
    return joined.select(*cols, mean.alias(out))


def blocked_ema(cells: DataFrame, out: str = "ema", window: int = 20, rows: int = BLOCK_ROWS) -> DataFrame:
    return blocked_ewm(cells, "close", window, "_e", rows).withColumn(out, div(C("close") - C("_e"), C("_e"))).drop("_e")


def blocked_macd(cells: DataFrame, out: str = "macd", fast: int = 12, slow: int = 26, signal: int = 9, rows: int = BLOCK_ROWS) -> DataFrame:
    step = blocked_ewm(blocked_ewm(cells, "close", fast, "_f", rows), "close", slow, "_s", rows)
    step = blocked_ewm(step.withColumn("_line", C("_f") - C("_s")), "_line", signal, "_sig", rows)
    return step.withColumn(out, div(C("_line") - C("_sig"), C("close"))).drop("_f", "_s", "_line", "_sig")


# ---------------------------------------------------------------- rolling sums and means


def blocked_rolling(cells: DataFrame, value: str, windows: Sequence[int], rows: int = BLOCK_ROWS, mean: bool = False) -> DataFrame:
    """(window_rows, ticker, pos, date, value): sums or means of whole trailing frames, NULL where a cell is missing."""
    sizes = list(dict.fromkeys(windows))

    def build(df: DataFrame) -> DataFrame:
        def whole(w: int) -> Column:
            frame = Window.partitionBy("ticker").orderBy("pos").rowsBetween(-(w - 1), 0)
            total = F.avg(value) if mean else F.sum(value)
            return F.when(F.count(value).over(frame) == w, total.over(frame))

        cells_of = F.array(*[F.struct(F.lit(w).alias("window_rows"), whole(w).alias("value")) for w in sizes])
        return df.select("ticker", "block", "pos", "date", cells_of.alias("w"))

    done = over_blocks(cells.select("ticker", "pos", "date", value), max(sizes) - 1, build, rows)
    rolled = done.select("ticker", "pos", "date", F.explode("w").alias("w"))
    return rolled.select("w.window_rows", "ticker", "pos", "date", "w.value").where(C("pos") >= C("window_rows"))
