"""Exact ranks inside very large groups.

``row_number() over (partition by date)`` sends a whole date to one task. A date
holds every ticker, so that task grows with the data. ``ordered_rank`` range-partitions
the rows by (group, order, tie) instead, so a large group is cut into as many ranges as
its size asks for and ties are cut as well:

1. the rows are written in that order with their number inside their range;
2. one aggregate counts the rows of each (group, range), at most one row per group and
   one more per range;
3. a rank is the number inside the range, from where the group begins there, plus the
   counts of the group's earlier ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridfolio.operators.calendar import parts_of, usual_parts
from gridfolio.sources.store import stored

C = F.col


def in_ranges(df: DataFrame, keys: Sequence[str], order: str, tie: str | Sequence[str]) -> DataFrame:
    """The rows range-partitioned and sorted by (keys, order, tie), with ``range_no`` and ``row_no`` of their place."""
    sort_by = [C(c).asc_nulls_first() for c in dict.fromkeys([*keys, order, *([tie] if isinstance(tie, str) else tie)])]
    parts = parts_of(df)
    dealt = df.repartitionByRange(parts, *sort_by) if parts > usual_parts(df) else df.repartitionByRange(*sort_by)
    placed = dealt.sortWithinPartitions(*sort_by)
    return stored(placed.withColumns({"range_no": F.spark_partition_id(), "row_no": F.monotonically_increasing_id()}), "ranges")


def ordered_rank(
    df: DataFrame, by: Sequence[str], order: str, tie: str | Sequence[str] = "ticker", *, rank: str = "rank", total: str = "n"
) -> DataFrame:
    """Add the 1-based ascending rank by (order, tie) inside each group and the group size; an empty ``by`` is one group."""
    keys = list(by)
    placed = in_ranges(df, keys, order, tie)
    counts = placed.groupBy(*keys, "range_no").agg(F.count(F.lit(1)).alias("c"), F.min("row_no").alias("first"))
    # one row per group and range; without a group, one row per range
    inside = Window.partitionBy(*keys)
    earlier = inside.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("c").over(earlier), F.lit(0))
    starts = counts.select(*[C(k).alias(f"_{k}") for k in keys], C("range_no").alias("_range"), "first", before.alias("before"), F.sum("c").over(inside).alias(total))
    starts = stored(starts, "starts")  # its size is known then, and the rows are not shuffled to meet a few
    same = placed["range_no"] == starts["_range"]
    for k in keys:
        same = same & placed[k].eqNullSafe(starts[f"_{k}"])
    return placed.join(starts, same).select(*df.columns, (C("row_no") - C("first") + 1 + C("before")).alias(rank), C(total))
