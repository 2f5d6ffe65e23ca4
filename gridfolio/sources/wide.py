"""Wide panels: one column per ticker, in blocks of a bounded number of columns.

All blocks are written in one job and read in one job, whatever their number: Spark pivots the rows by the place of a
ticker inside its block, and a task writes the blocks that it got, each with the names of its own tickers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfolio.sources.panels import DATE_COLUMNS, _named, to_long, with_date
from gridfolio.sources.store import file_system, let_tasks_import, stored

C = F.col

#: columns of one block, and of a panel: the names of the columns are the one thing that the driver has to know
BLOCK_COLUMNS = 500
MOST_COLUMNS = 2_000_000


#: cells that a task sends on at once
BATCH_CELLS = 100_000
#: types that a task reads as Spark does
PLAIN = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.BooleanType, T.StringType, T.DateType)


def write_wide(long: DataFrame, path: str, *, name: str = "ticker", value: str = "value", columns: int = BLOCK_COLUMNS) -> list[list[str]]:
    """Write (date, ticker, value) as wide blocks ``path/columns=0000``, ...; returns the tickers of each block.

    Every block has all dates in a column ``Date``, so blocks lie side by side. One plan pivots the rows of all blocks
    by their place among the ``columns`` of a block; a block is written by one task, under one name, so that a second
    attempt replaces what a lost one has left. More than ``MOST_COLUMNS`` tickers end the call.
    """
    long = stored(long.select("date", name, value), "cells")  # read for the names, the rows and the dates
    names = [r[0] for r in long.where(C(name).isNotNull()).select(name).distinct().orderBy(name).limit(MOST_COLUMNS + 1).collect()]
    if len(names) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns")
    blocks = [names[i : i + columns] for i in range(0, len(names), columns)]
    if not blocks:
        raise ValueError("a wide panel needs a ticker")
    spark = long.sparkSession
    let_tasks_import(spark)
    folder = qualified(spark, path)
    table = spark.createDataFrame(pa.table({"_name": names, "_block": [i // columns for i in range(len(names))], "_place": [i % columns for i in range(len(names))]}))
    rows = long.select("date", C(name).alias("_name"), C(value).alias("_value")).join(table, "_name").select("_block", "date", "_place", "_value")
    dates = stored(long.select("date").distinct(), "dates")
    every = spark.range(len(blocks)).select(C("id").alias("_block")).crossJoin(F.broadcast(dates))  # a row per date and block, as in the files
    empty = every.select("_block", "date", F.lit(None).cast("long").alias("_place"), F.lit(None).cast(rows.schema["_value"].dataType).alias("_value"))
    places = list(range(min(columns, len(names))))
    pivoted = rows.unionByName(empty).groupBy("_block", C("date").alias("Date")).pivot("_place", places).agg(F.max("_value"))
    parts = min(len(blocks), max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    placed = pivoted.repartition(parts, "_block").sortWithinPartitions("_block", "Date")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        def files() -> Iterator[int]:
            at, writer, stream = None, None, None
            for batch in batches:
                numbers = batch.column(0).to_pylist()
                start = 0
                while start < len(numbers):
                    block, end = numbers[start], start + 1
                    while end < len(numbers) and numbers[end] == block:
                        end += 1
                    own = blocks[block]
                    part = pa.Table.from_arrays([c.slice(start, end - start) for c in batch.columns[1 : 2 + len(own)]], ["Date", *own])
                    if block != at:
                        if writer:
                            writer.close()
                            stream.close()
                            yield at
                        system, place = file_system(f"{folder}/columns={block:04d}")
                        system.create_dir(place, recursive=True)
                        stream = system.open_output_stream(f"{place}/part-00000.parquet")
                        at, writer = block, pq.ParquetWriter(stream, part.schema)
                    writer.write_table(part)
                    start = end
            if writer:
                writer.close()
                stream.close()
                yield at

        for block in files():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64())], ["block"])

    written = placed.mapInArrow(write, "block long").count()
    if written != len(blocks):
        raise RuntimeError(f"{written} of {len(blocks)} blocks were written")
    return blocks


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the file system that Spark would use."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()


def blocks_of(spark: SparkSession, path: str) -> list[str]:
    """The blocks of a wide panel in order; only their names are listed."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    listed = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    found = sorted((f.getPath().getName() for f in listed if f.getPath().getName().startswith("columns=")), key=lambda n: (len(n), n))
    return [f"{path.rstrip('/')}/{name}" for name in found]


def read_wide(spark: SparkSession, path: str, keep_empty: bool = False) -> DataFrame:
    """The cells of all blocks as (date, ticker, value).

    One job, in which a task reads whole blocks, some rows at a time. Blocks of types that Arrow and Spark read
    differently, or of several types, are one plan each.
    """
    blocks = blocks_of(spark, path)
    if not blocks:
        raise ValueError(f"no blocks of columns in {path}")
    first = spark.read.parquet(blocks[0]).schema
    dated = next((c for c in DATE_COLUMNS if c in first.names), None)
    kinds = {f.dataType for f in first.fields if f.name != dated}
    if dated is None or len(kinds) != 1 or not isinstance(next(iter(kinds)), PLAIN) or not isinstance(first[dated].dataType, (T.DateType, T.StringType)):
        return reduce(lambda a, b: a.unionByName(b), [to_long(spark.read.parquet(b), keep_empty) for b in blocks])
    let_tasks_import(spark)
    kind, when, root = next(iter(kinds)), first[dated].dataType, qualified(spark, path)
    tasks = min(len(blocks), max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    folders = spark.createDataFrame([(f"{root}/{b.rpartition('/')[2]}",) for b in blocks], "folder string").repartition(tasks)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        from pyspark.sql.pandas.types import to_arrow_type

        value_type, date_type = to_arrow_type(kind), to_arrow_type(when)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                system, place = file_system(folder)
                panel = ds.dataset(place, filesystem=system, format="parquet")
                index = next(c for c in DATE_COLUMNS if c in panel.schema.names)
                names = [c for c in panel.schema.names if c != index]
                for rows in panel.to_batches(batch_size=max(BATCH_CELLS // max(len(names), 1), 1)):
                    dates = rows.column(panel.schema.names.index(index)).cast(date_type)
                    for n in names:
                        value = rows.column(panel.schema.names.index(n)).cast(value_type)
                        part = pa.RecordBatch.from_arrays([dates, pa.array([n] * len(dates), pa.string()), value], ["Date", "ticker", "value"])
                        yield part if keep_empty else part.filter(value.is_valid())

    schema = T.StructType([T.StructField("Date", when), T.StructField("ticker", T.StringType()), T.StructField("value", kind)])
    return with_date(folders.mapInArrow(cells, schema)).select("date", "ticker", "value")


def read_columns(spark: SparkSession, path: str, tickers: list[str]) -> DataFrame:
    """``Date`` and some columns, wide; only the blocks that hold them are read, and of these only the columns."""
    found, left = None, list(dict.fromkeys(tickers))
    for block in blocks_of(spark, path):
        frame = spark.read.parquet(block)
        mine = [t for t in left if t in frame.columns]
        if mine:
            part = frame.select("Date", *[_named(t) for t in mine])
            found = part if found is None else found.join(part, "Date")
            left = [t for t in left if t not in mine]
    if left or found is None:
        raise KeyError(f"no columns {left}")
    return found.select("Date", *[_named(t) for t in dict.fromkeys(tickers)])
