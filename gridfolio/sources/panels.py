"""Reading and writing panels, named datasets and sample tables."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfolio.sources import sheets
from gridfolio.sources.store import shared_dir

#: candidate names of the date column, in order of preference (fixed values)
DATE_COLUMNS = ["Date", "__index_level_0__"]


def _named(column: str):
    """A column of any name, dots and back quotes included."""
    return F.col("`" + column.replace("`", "``") + "`")


def with_date(wide: DataFrame) -> DataFrame:
    """The ``Date`` column, else the unnamed index, as ``date``."""
    for name in DATE_COLUMNS:
        if name in wide.columns:
            rest = [_named(c) for c in wide.columns if c != name]
            return wide.select(F.to_date(name).alias("date"), *rest)
    raise ValueError(f"no date column among {DATE_COLUMNS}")


def to_long(wide: DataFrame, keep_empty: bool = True) -> DataFrame:
    dated = with_date(wide)
    tickers = [c for c in dated.columns if c != "date"]
    long = dated.unpivot(["date"], [_named(t) for t in tickers], "ticker", "value")
    return long if keep_empty else long.where(F.col("value").isNotNull())


def read_wide_panel(spark: SparkSession, path: str, keep_empty: bool = True) -> DataFrame:
    """A parquet file with one column per ticker as (date, ticker, value)."""
    return to_long(spark.read.parquet(path), keep_empty)


class Datasets:
    """Every ``*.parquet`` of one folder by its stem."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def available(self) -> DataFrame:
        """Files and folders that Spark wrote; only the names inside the folder are listed, nothing is opened."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        listed = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        names = [f.getPath().getName() for f in listed]
        return self.spark.createDataFrame([(n.removesuffix(".parquet"),) for n in sorted(names) if n.endswith(".parquet")], "name string")

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def write_tickers(df: DataFrame, path: str) -> None:
    """One JSON object per ticker, so that a long list is never one document."""
    df.select("ticker").write.mode("overwrite").json(path)


def read_tickers(spark: SparkSession, path: str) -> DataFrame:
    """Tickers of a JSON array of strings, or of one JSON object per line."""
    lines = spark.read.text(path).withColumn("value", F.trim("value"))
    objects = lines.where(F.col("value").startswith("{")).select(F.get_json_object("value", "$.ticker").alias("ticker"))
    whole = spark.read.text(path, wholetext=True).withColumn("value", F.trim("value")).where(F.col("value").startswith("["))
    listed = whole.select(F.explode(F.from_json("value", "array<string>")).alias("ticker"))
    return objects.unionByName(listed)


def read_sheet(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A headerless CSV sheet as (row_no, col_no, cell), both counted from 0; empty cells are left out.

    Sheets in UTF-8 are read by many tasks. In another encoding a line break cannot be found from the middle of a file,
    so such a sheet is read by one task, in order, and its blank lines are not counted.
    """
    if encoding.upper().replace("_", "-") in ("UTF-8", "UTF8"):
        return sheets.read_sheet(spark, path)
    rows = spark.read.csv(path, header=False, encoding=encoding, multiLine=True)
    numbered = rows.withColumn("row_no", F.monotonically_increasing_id().cast("int"))  # before the cells are taken apart
    cells = F.array(*[F.struct(F.lit(i).alias("col_no"), F.col(c).alias("cell")) for i, c in enumerate(rows.columns)])
    return numbered.select("row_no", F.explode(cells).alias("c")).select("row_no", "c.*").where(F.col("cell").isNotNull())


def save_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def parameter_key(params: Mapping[str, object]) -> str:
    """Name of a cache entry: a hash over every parameter."""
    text = json.dumps(params, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:24]


class SampleCache:
    """Sample tables, each named by all the parameters and the source files that made it, in published versions.

    A version is written to a folder of its own and becomes visible by a small manifest that is written last. Manifests are
    numbered and created exclusively, so of two writers one gets the number and the other the next; readers follow the
    highest complete one. No folder that a reader may have open is ever written to; ``prune`` deletes old versions.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}"

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def key(self, params: Mapping[str, object], sources: Sequence[str] = ()) -> str:
        """A hash over every parameter and over path, size and time of change of every source file."""
        return parameter_key({"params": dict(params), "sources": {s: self.state(s) for s in sorted(sources)}})

    def state(self, source: str) -> list[tuple[str, int, int]]:
        """The files of a source; a folder is listed with all that lies in it."""
        where, system = self._fs(source)
        found, files = [], system.listFiles(where, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return sorted(found)

    def path(self, params: Mapping[str, object], sources: Sequence[str] = ()) -> str:
        return f"{self.root}/{self.key(params, sources)}"

    def _versions(self, folder: str) -> list[tuple[int, str]]:
        """(number, folder) of the published versions, oldest first."""
        where, system = self._fs(folder)
        if not system.exists(where):
            return []
        found = []
        for f in system.listStatus(where):
            name = f.getPath().getName()
            if name.startswith("manifest-"):
                with_end = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(system.open(f.getPath()))).decode()
                if with_end.endswith("\n"):  # else its writer is still at it, or was lost
                    found.append((int(name.removeprefix("manifest-")), f"{folder}/{with_end.strip()}"))
        return sorted(found)

    def publish(self, df: DataFrame, folder: str) -> str:
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{folder}/{version}")
        number = self._versions(folder)[-1][0] + 1 if self._versions(folder) else 1
        while True:
            where, system = self._fs(f"{folder}/manifest-{number:09d}")
            try:
                out = system.create(where, False)
            except Py4JJavaError:
                if not system.exists(where):
                    raise
                number += 1
                continue
            out.write(bytearray(f"{version}\n", "utf-8"))
            out.close()
            return f"{folder}/{version}"

    def save(self, df: DataFrame, params: Mapping[str, object], sources: Sequence[str] = ()) -> None:
        self.publish(df, self.path(params, sources))

    def holds(self, params: Mapping[str, object], sources: Sequence[str] = ()) -> bool:
        """Whether a version is published under the key."""
        return bool(self._versions(self.path(params, sources)))

    def load(self, params: Mapping[str, object], sources: Sequence[str] = ()) -> DataFrame:
        versions = self._versions(self.path(params, sources))
        if not versions:
            raise KeyError(f"nothing is cached for {dict(params)}")
        return self.spark.read.parquet(versions[-1][1])

    def get(self, params: Mapping[str, object], build: Callable[[], DataFrame], sources: Sequence[str] = ()) -> DataFrame:
        """The table of the key; built and published only if there is none."""
        folder = self.path(params, sources)  # the state of the sources before anything is read
        versions = self._versions(folder)
        return self.spark.read.parquet(versions[-1][1] if versions else self.publish(build(), folder))

    def prune(self, params: Mapping[str, object], sources: Sequence[str] = (), keep: int = 1) -> int:
        """Delete all but the newest ``keep`` versions of a key, manifests first; returns how many. Call it when no reader is at work."""
        old = self._versions(self.path(params, sources))[: -keep or None]
        for number, folder in old:
            for path in (f"{folder.rpartition('/')[0]}/manifest-{number:09d}", folder):
                where, system = self._fs(path)
                system.delete(where, True)
        return len(old)
