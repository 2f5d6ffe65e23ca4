"""Helpers that several operators share: files, global order, word hashes, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridfolio.sources.store import new_path, stored

#: Odd multipliers and a seed of the hashes below; any odd 64-bit numbers do.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0xD1342543DE82EF95
_BYTE_CODES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)


def let_tasks_import(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it, unless the cluster already installs it."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Files -----------------------------------------------------------------------


def file_system(uri: str):
    """The pyarrow file system and path of a URI; works inside tasks, for any shared store that pyarrow knows."""
    from pyarrow import fs

    uri = uri.replace("s3a://", "s3://", 1)
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


@contextmanager
def new_file(folder: str, stem: str):
    """Open a file of a name that no other task attempt uses; yields (uri, stream).

    Readers go by the stored manifest of finished tasks, so what a lost attempt leaves is never read.
    """
    uri = f"{folder}/{stem}-{uuid.uuid4().hex}"
    system, path = file_system(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as stream:
        yield uri, stream


# Order over the whole table ----------------------------------------------------


def in_order(df: DataFrame, keys: list[str], partition: str) -> DataFrame:
    """Rows range-partitioned and sorted by ``keys`` (nulls first); ``partition`` numbers the ranges in order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(k).asc_nulls_first() for k in keys]
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(partition, F.spark_partition_id())


def running_totals(df: DataFrame, partition: str, amounts: dict[str, str]) -> DataFrame:
    """One row per partition with, for each ``{total: column}``, the sum over all partitions before it.

    The window holds one row per partition, which does not grow with the rows of a partition.
    """
    sums = df.groupBy(partition).agg(*[F.sum(c).alias(f"_{t}") for t, c in amounts.items()])
    before = Window.orderBy(partition).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(partition, *[F.coalesce(F.sum(f"_{t}").over(before), F.lit(0)).cast("long").alias(t) for t in amounts])


# Hashes ------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as the longest text so far needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte buffer in which every word ends with one space."""
    ends = np.flatnonzero(buf == 32)
    starts = np.empty_like(ends)
    if len(ends):
        starts[0] = 0
        starts[1:] = ends[:-1] + 1
    return starts, ends


def word_hashes(words: bytes) -> np.ndarray:
    """A 64-bit hash per word of a buffer in which every word ends with one space (vectorised polynomial hash)."""
    buf = np.frombuffer(words, np.uint8)
    if not len(buf):
        return np.empty(0, np.uint64)
    up, down = _POWERS.get(len(buf) + 1)
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_CODES[buf] * up[: len(buf)], dtype=np.uint64, out=sums[1:])
    starts, ends = word_spans(buf)
    return mix((sums[ends] - sums[starts]) * down[starts])


def normal_words(text: str | None) -> str:
    """Lower case, words separated by one space: what counts as a text's words everywhere in this subpackage."""
    return " ".join(text.lower().split()) if text else ""


def chunks(texts: list[str], size: int = 1 << 20) -> Iterator[list[int]]:
    """Positions of the texts in groups of about ``size`` characters; a longer text is a group of its own."""
    group: list[int] = []
    total = 0
    for i, t in enumerate(texts):
        if group and total + len(t) > size:
            yield group
            group, total = [], 0
        group.append(i)
        total += len(t)
    if group:
        yield group


def pieces(batch: pa.RecordBatch, text: int, size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about ``size`` bytes of text; a longer text is a slice of its own.

    A task that takes a batch apart this way never has all its texts as Python strings, whose memory a worker keeps.
    """
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < batch.num_rows:
        end = max(int(np.searchsorted(sizes, done + size, "right")), at + 1)
        yield batch.slice(at, end - at)
        at, done = end, int(sizes[end - 1])


def shingle_hashes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of normalised texts, and the position of the text of each.

    A text of fewer words has one run, of all its words; a text without words has none.
    """
    counts = np.array([t.count(" ") + 1 if t else 0 for t in texts], np.int64)
    words = word_hashes("".join(t + " " for t in texts if t).encode("utf-8", "surrogatepass"))
    padded = np.zeros(len(words) + width, np.uint64)
    padded[: len(words)] = words
    owner = np.repeat(np.arange(len(texts)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(words))  # words from here to the end of the text
    total = np.zeros(len(words), np.uint64)
    for k in range(width):
        word = np.where(left > k, padded[k : k + len(words)], np.uint64(0))
        total = mix(total * GOLDEN + word)
    whole = (left >= width) | ((left == counts[owner]) & (left < width))
    return total[whole], owner[whole]


# Groups inside tasks -------------------------------------------------------------


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by integer ``keys``, cut so that no group is split, and where each group begins and ends.

    The last group of a batch waits for the next batch, so a task holds one batch and one group.
    """

    def cut() -> Iterator[pa.Table]:
        rest: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([rest, now]) if rest is not None else now
            names = np.stack([now[k].to_numpy() for k in keys])
            others = np.flatnonzero((names != names[:, -1:]).any(axis=0))
            n = int(others[-1]) + 1 if len(others) else 0
            if n:
                yield now.slice(0, n)
            rest = now.slice(n)
        if rest is not None and rest.num_rows:
            yield rest

    for part in cut():
        batch = part.combine_chunks().to_batches()[0]
        names = np.stack([batch.column(k).to_numpy() for k in keys])
        turns = np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1
        yield batch, np.concatenate([[0], turns, [batch.num_rows]])


def smallest_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one reachable over the links i - j."""
    low = np.arange(n)
    while True:
        before = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        low = low[low]
        if (low == before).all():
            return low


def tile_pairs(places: DataFrame, group: str, row: str, tile: int) -> DataFrame:
    """(group, row, tile, lo, hi): rows of groups of two or more, dealt into tiles, once for each pair of tiles with their own.

    Every two rows of a group meet in a (group, lo, hi), which holds about two tiles at most whatever the group's size.
    """
    sizes = places.groupBy(group).agg(F.count("*").alias("n")).where("n > 1").select(group, F.ceil(F.col("n") / tile).alias("tiles"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    dealt = places.select(group, row).join(sizes, group).select(group, row, F.pmod(F.xxhash64(row), F.col("tiles")).alias("tile"), other.alias("other"))
    return dealt.select(group, row, "tile", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"))


# Connected components ------------------------------------------------------------


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) of every node of ``edges(a, b)``; a component is named by its smallest node.

    Large-star and small-star steps: each is one aggregate and one join, a hub is never gathered into a task,
    and the edges after each step are written to the shared folder. Null ends are ignored.
    """
    now = stored(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(lows, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        smallest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(smallest, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        now = stored(small.where("a <> b").distinct(), label)
        # done when every node is either the root of its edges or points once, at a root
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty():
            break
    # every node now points at the root of its star
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
