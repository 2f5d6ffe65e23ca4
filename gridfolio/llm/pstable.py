"""Links between embeddings of one label by p-stable hashing, each checked by its exact cosine.

Normalised vectors are projected on random Gaussian directions, shifted and cut into cells; ``HASHES`` cells form a
bucket of one of ``TABLES`` tables. Vectors of a bucket are compared in double precision. Buckets of more than one
vector are dealt into tiles of about ``TILE`` vectors, and pairs of tiles are compared as one matrix product, so a
bucket of any size is spread over tasks and a task sends counts and one edge per vector, never pairs. A pair that
shares several buckets is counted in the first table in which it does.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors of a null label
link with nothing; vectors of different lengths are not compared; rows that share a vec_id are separate vectors that
fall into one component. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfolio.llm.common import GOLDEN, components, mix, smallest_reachable, stored, tile_pairs, whole_groups

THRESHOLD = 0.93
#: At the threshold two unit vectors are 0.374 apart and share a cell of width 2.24 with probability 0.87, a bucket
#: with 0.10, and miss all tables with 0.006; at cosine 0.95 with 1e-4. Unrelated vectors share a bucket with 4e-5.
TABLES, HASHES, WIDTH = 48, 16, 2.24
TILE = 512
SEED = 7


def bucket_codes(vectors: np.ndarray, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH) -> np.ndarray:
    """(rows, tables) 32-bit bucket codes of unit vectors."""
    random = np.random.default_rng([SEED, vectors.shape[1]])
    directions, shifts = random.standard_normal((vectors.shape[1], tables * hashes)), random.uniform(0, width, tables * hashes)
    cells = np.floor((vectors @ directions + shifts) / width).astype(np.int64).view(np.uint64).reshape(len(vectors), tables, hashes)
    total = np.broadcast_to(np.arange(1, tables + 1, dtype=np.uint64) * GOLDEN, cells.shape[:2]).copy()
    for h in range(hashes):
        total = mix(total * GOLDEN + cells[:, :, h])
    return (total >> np.uint64(32)).astype(np.uint32).view(np.int32)


def coded(embeddings: DataFrame) -> DataFrame:
    """Stored (row, vec_id, label, vector, codes); codes is null for vectors that link with nothing. ``row`` names a row."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                codes: list = [None] * batch.num_rows
                by_length: dict[int, list] = {}
                for i, (label, v) in enumerate(zip(batch.column("label").to_pylist(), batch.column("vector").to_pylist(), strict=True)):
                    if label is not None and v and None not in v:
                        by_length.setdefault(len(v), []).append((i, v))
                for rows in by_length.values():
                    x = np.array([v for _, v in rows], np.float64)
                    with np.errstate(all="ignore"):
                        x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    good = np.flatnonzero(np.isfinite(x).all(axis=1))
                    for (i, _), c in zip([rows[g] for g in good], bucket_codes(x[good]) if len(good) else [], strict=True):
                        codes[i] = c
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.list_(pa.int32()))], [*batch.schema.names, "codes"])

    rows = embeddings.select("vec_id", "label", F.col("embedding").alias("vector")).withColumn("row", F.monotonically_increasing_id())
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in rows.columns)
    return stored(rows.mapInArrow(code, f"{schema}, codes array<int>"), "coded")


def _linked(x: np.ndarray, label: np.ndarray, codes: np.ndarray, table: int, side: np.ndarray | None, threshold: float):
    """Pairs (i, j), i < j, with cosine at the threshold or above; and which of them first share a bucket in this table."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.triu(unit @ unit.T >= threshold, 1) & (label[:, None] == label[None, :])
    if side is not None:  # two tiles: pairs inside one are compared elsewhere
        near &= side[:, None] != side[None, :]
    i, j = np.nonzero(near)
    first = np.array([not (codes[a, :table] == codes[b, :table]).any() for a, b in zip(i, j, strict=True)], bool) if len(i) < 64 else np.concatenate([~(codes[i[k : k + 4096], :table] == codes[j[k : k + 4096], :table]).any(axis=1) for k in range(0, len(i), 4096)])
    return i, j, first


def links(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row, n, to) sums: ``n`` links of a row counted in one tile pair, and a linked row ``to`` that joins components."""
    usable = vectors.where("codes is not null").select("row", "label", "vector", "codes")
    bucket = F.shiftleft(F.col("t").cast("long"), 32).bitwiseOR(F.col("code").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    places = usable.select("row", F.posexplode("codes").alias("t", "code")).select("row", bucket.alias("bucket"))
    dealt = tile_pairs(places, "bucket", "row", TILE)
    spread = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = dealt.join(usable, "row").select("bucket", "lo", "hi", "tile", "row", "label", "vector", "codes")
    keys = ["bucket", "lo", "hi"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for many, edges in whole_groups(batches, keys):
            names = np.stack([many.column(k).to_numpy() for k in keys])
            row, tile, label = (many.column(k).to_numpy() for k in ("row", "tile", "label"))
            lists, codes = many.column("vector"), many.column("codes")
            offset, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            codes = codes.flatten().to_numpy().reshape(len(row), -1)
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for s, e in zip(edges, edges[1:], strict=False):
                if e - s < 2:
                    continue
                length = np.diff(offset[s : e + 1])
                for d in np.unique(length):
                    at = s + np.flatnonzero(length == d)
                    x = values[offset[at][:, None] + np.arange(d)].astype(np.float64)
                    lo, hi = names[1, s], names[2, s]
                    i, j, first = _linked(x, label[at], codes[at], int(names[0, s] >> 32), tile[at] if lo != hi else None, threshold)
                    if len(i):
                        low = smallest_reachable(len(at), i, j)
                        n = np.bincount(i[first], minlength=len(at)) + np.bincount(j[first], minlength=len(at))
                        some = (n > 0) | (low != np.arange(len(at)))
                        found.append((row[at][some], n[some], row[at][low][some]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], ["row", "n", "to"])

    return full.repartition(spread, *keys).sortWithinPartitions(*keys).mapInArrow(compare, "row long, n long, to long")


def linked_vectors(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``embeddings(vec_id, embedding, label)``."""
    vectors = coded(embeddings)
    found = stored(links(vectors, threshold), "links")
    counts = found.groupBy("row").agg(F.sum("n").alias("n"))
    rows = vectors.select("row", "vec_id")
    ends = found.select("row", "to").distinct().join(rows, "row").select(F.col("vec_id").alias("a"), "to").join(rows.withColumnRenamed("row", "to"), "to")
    nodes = components(ends.select("a", F.col("vec_id").alias("b")))
    out = rows.join(counts, "row", "left").join(nodes, rows["vec_id"] == nodes["node"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
