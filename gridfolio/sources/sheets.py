"""CSV sheets of any size, read and written by many tasks.

A quoted cell may hold line breaks, so a reader that is let loose in the middle of a file does not know whether it stands
inside quotes. It can be found out without reading in order: whether a line begins inside quotes depends on the number of
quotes before it being odd. Each split of a file counts its quotes and lines where it lies; one row per split is
summed over the splits before it; then every line knows where it belongs, and only the lines of records
that span several are brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

C = F.col
SPLIT = ["file", "start"]
#: a cell after its comma: quoted with doubled quotes inside, or plain
CELL = r',("[^"]*+(?:""[^"]*+)*+"|[^,]*+)'


def _before(df: DataFrame, by: list[str], amounts: dict[str, Column]) -> DataFrame:
    """One row per split with the sums over all splits before it; a split's own rows are counted where they lie."""
    sums = df.groupBy(*by).agg(*[F.sum(c).alias(f"_{n}") for n, c in amounts.items()])
    earlier = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    return sums.select(*[C(k).alias(f"_{k}") for k in by], *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"{n}_before") for n in amounts])


def _with_before(df: DataFrame, by: list[str], amounts: dict[str, Column]) -> DataFrame:
    sums = _before(df, by, amounts)
    same = C(by[0]) == C(f"_{by[0]}")
    for k in by[1:]:
        same = same & (C(k) == C(f"_{k}"))
    return df.join(F.broadcast(sums), same).drop(*[f"_{k}" for k in by])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, record) of a UTF-8 CSV file, or of a folder of files in the order of their names; rows count from 0.

    A blank line is a row. Quotes are doubled inside quoted cells. The splits are broadcast as one row each: a petabyte
    in splits of 128 MB is eight million rows of 50 bytes at most, and far fewer for a sheet.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.monotonically_increasing_id().alias("at"), C("_metadata.file_path").alias("file"), C("_metadata.file_block_start").alias("start"), C("value").alias("line"))
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    lines = lines.withColumn("quotes", quotes)
    inside_split = Window.partitionBy(*SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    counted = _with_before(lines, SPLIT, {"quotes": C("quotes")})
    odd = (C("quotes_before") + F.coalesce(F.sum("quotes").over(inside_split), F.lit(0))) % 2 == 1
    marked = counted.withColumn("inside", odd).drop("quotes_before")
    upto = Window.partitionBy(*SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    begins = (~C("inside")).cast("int")
    placed = _with_before(marked, SPLIT, {"records": begins})
    placed = placed.withColumn("row_no", C("records_before") + F.sum(begins).over(upto) - 1)
    whole = ~C("inside") & (C("quotes") % 2 == 0)
    alone = placed.where(whole).select("row_no", C("line").alias("record"))
    pieces = placed.where(~whole).groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct(*SPLIT, "at", "line"))).alias("lines"))
    joined = pieces.select("row_no", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("record"))
    clean = F.regexp_replace(F.regexp_replace("record", "^﻿", ""), "\r$", "")
    return alone.unionByName(joined).select(C("row_no").cast("int").alias("row_no"), clean.alias("record"))


def split_cells(records: DataFrame) -> DataFrame:
    """(row_no, col_no, cell) of CSV records, both counted from 0; empty cells are left out."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), C("record")), F.lit(CELL), F.lit(1))
    exploded = records.select("row_no", F.posexplode(cells).alias("col_no", "raw"))
    quoted = C("raw").startswith('"')
    inner = F.replace(F.expr("substring(raw, 2, length(raw) - 2)"), F.lit('""'), F.lit('"'))
    return exploded.select("row_no", "col_no", F.when(quoted, inner).otherwise(C("raw")).alias("cell")).where(F.length("cell") > 0)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A headerless CSV sheet as (row_no, col_no, cell)."""
    return split_cells(read_records(spark, path))


def write_sheet(cells: DataFrame, path: str) -> None:
    """Write (row_no, col_no, cell) as a folder of CSV files whose names are in the order of the rows.

    Rows without cells are blank lines, up to the last row with any. A row is one line and so is built in one task.
    """
    text = C("cell").cast("string")
    special = text.rlike('[",\r\n]')
    safe = F.when(special, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
    known = cells.where(C("cell").isNotNull()).select(C("row_no").cast("long").alias("row_no"), C("col_no").cast("int").alias("col_no"), safe.alias("cell"))
    rows = known.groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", "cell"))).alias("c"))
    last = rows.agg(F.max("row_no").alias("last")).where("last is not null")
    blank = last.select(F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("row_no"))
    rows = blank.join(rows, "row_no", "left")

    def spaced(cell: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(0)).otherwise(F.get("c", i - 1)["col_no"])
        return F.concat(F.repeat(F.lit(","), cell["col_no"] - before), cell["cell"])

    line = F.coalesce(F.array_join(F.transform("c", spaced), ""), F.lit(""))
    rows.select("row_no", line.alias("value")).repartitionByRange("row_no").sortWithinPartitions("row_no").select("value").write.text(path, lineSep="\n")
