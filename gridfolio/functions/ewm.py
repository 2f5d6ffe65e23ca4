"""Exponentially weighted mean in window functions only.

The recursive mean (first value seeds, empty rows repeat the last mean and make
the next weight decay once per row) is the affine step ``y = m * y_prev + b`` with

    m = q^g / (q^g + a),   b = a * x / (q^g + a),   a = 2 / (span + 1), q = 1 - a

where g is the number of rows since the last value. A chain of such steps is
``y_t = sum(b_i * exp(S_i - S_t))`` with S the running sum of ``-ln(m)``, i.e. a
running sum. To keep the exponentials in range the history is cut into blocks of
20 decades of decay; a block starts from the end of the block before it, and what
lies further back weighs less than 1e-20.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DECADES = 20.0


def with_ewm(
    df: DataFrame, value: str, span: float, out: str, *, keys: Sequence[str] = ("ticker",), order: str = "pos"
) -> DataFrame:
    """Add ``out``, the exponentially weighted mean of ``value`` along ``order``."""
    return with_ewms(df, value, {out: span}, keys=keys, order=order)


def with_ewms(
    df: DataFrame, value: str, spans: Mapping[str, float], *, keys: Sequence[str] = ("ticker",), order: str = "pos"
) -> DataFrame:
    """Add one exponentially weighted mean of ``value`` per entry of ``spans``; what does not depend on the span is computed once."""
    line = Window.partitionBy(*keys).orderBy(order)
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    x, cols = F.col(value), df.columns
    alphas = {out: 2.0 / (span + 1.0) for out, span in spans.items()}
    plain = {out: F.last(x, ignorenulls=True).over(so_far).alias(out) for out, a in alphas.items() if a >= 1.0}
    fading = {out: a for out, a in alphas.items() if a < 1.0}
    before = F.last(F.when(x.isNotNull(), F.col(order)), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    step = df.select(*cols, (F.col(order) - before).alias("_g"), F.count(x).over(so_far).alias("_seen"), *plain.values())
    weights = {out: F.pow(F.lit(1.0 - a), F.col("_g")) for out, a in fading.items()}
    for i, (out, a) in enumerate(fading.items()):
        w, decay = weights[out], -math.log10(1.0 - a)
        step = step.withColumns(
            {
                f"_d{i}": F.when(x.isNull() | F.col("_g").isNull(), F.lit(0.0)).otherwise(F.col("_g") * F.lit(decay) + F.log10(w + F.lit(a))),
                f"_b{i}": F.when(x.isNull(), F.lit(0.0)).when(F.col("_g").isNull(), x).otherwise(x * F.lit(a) / (w + F.lit(a))),
            }
        )
    numbers = range(len(fading))
    summed = step.withColumns({f"_s{i}": F.sum(f"_d{i}").over(so_far) for i in numbers})
    summed = summed.withColumns({f"_k{i}": F.floor(F.col(f"_s{i}") / DECADES) for i in numbers})
    blocks = {i: Window.partitionBy(*keys, f"_k{i}").orderBy(order).rowsBetween(Window.unboundedPreceding, 0) for i in numbers}
    local = summed
    for i in numbers:
        offset = F.col(f"_s{i}") - F.col(f"_k{i}") * DECADES
        scaled = F.sum(F.col(f"_b{i}") * F.pow(F.lit(10.0), offset)).over(blocks[i]) * F.pow(F.lit(10.0), -offset)
        local = local.withColumn(f"_l{i}", scaled)
    local = local.withColumns({f"_pl{i}": F.lag(f"_l{i}").over(line) for i in numbers} | {f"_ps{i}": F.lag(f"_s{i}").over(line) for i in numbers})

    def mean(i: int) -> Column:
        tail = F.first(f"_pl{i}").over(blocks[i]) * F.pow(F.lit(10.0), F.first(f"_ps{i}").over(blocks[i]) - F.col(f"_s{i}"))
        return F.when(F.col("_seen") > 0, F.col(f"_l{i}") + F.coalesce(tail, F.lit(0.0)))

    made = {out: mean(i).alias(out) for i, out in enumerate(fading)}
    return local.select(*cols, *[made[out] if out in made else F.col(out) for out in spans])
