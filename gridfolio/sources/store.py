"""Intermediate and output tables in the folder that all executors share.

A table that several later steps read is written once and read back: that cuts
the lineage, keeps plans small, and survives the loss of executors. A session knows
what it has written; ``release`` deletes it, and a local session's own folder goes with it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}
_LENGTHS: dict[str, int] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="gridfolio-")
        atexit.register(shutil.rmtree, _LOCAL_ROOTS[app], ignore_errors=True)
    return _LOCAL_ROOTS[app]


def let_tasks_import(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it, unless the cluster already installs it."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def file_system(uri: str):
    """The pyarrow file system and path of a URI; works inside tasks, for any shared store that pyarrow knows."""
    from pyarrow import fs

    uri = uri.replace("s3a://", "s3://", 1)
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def input_bytes(df: DataFrame) -> int:
    """Size of the files that ``df`` reads, each counted once; a folder is listed when one of its files is first seen."""
    spark, names = df.sparkSession, df.inputFiles()
    for folder in {n.rpartition("/")[0] for n in names if n not in _LENGTHS}:
        where = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f"{folder}/"))
        for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where):
            _LENGTHS[f"{folder}/{f.getPath().toUri().getRawPath().rpartition('/')[2]}"] = f.getLen()
    return sum(_LENGTHS.get(n, 0) for n in set(names))


def release(spark: SparkSession) -> int:
    """Delete every table and file that this session has put into the shared folder; returns how many.

    DataFrames that read them can no longer be run, so call it when their results are written elsewhere.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
