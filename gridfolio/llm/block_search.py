"""Nearest neighbours by inner product: a block matrix join of 8-bit products, exact where the bounds cannot decide.

Queries and candidates are dealt into a grid of tiles, so that every query meets every candidate in one tile. A tile
holds its queries and streams its candidates. Vectors are rounded to 8-bit codes with a scale of their own; a product of code
matrices, exact in whole numbers, gives every inner product up to the rounding errors of both sides, which the
Cauchy-Schwarz inequality bounds by ``|q'| |x - x'| + |q - q'| |x|`` (dashes mark decoded vectors). Pairs whose upper
bound is below what a query already has are left out; all others are recomputed in double precision, summed from the
first component to the last, and kept in a bounded heap per query. The heaps of a query's tiles are merged at the end.
The result is exact: nothing is sampled, probed or capped.

The work is (queries x candidates), by the method. The grid is the one that copies the fewest vectors for the number
of tiles: about ``sqrt(tiles / 20)`` copies of a candidate when one row in twenty is a query.

Defined cases: rows whose vec_id is null and vectors that are null, empty, zero or hold null or non-finite components
take no part; vectors of different lengths are not compared; equal scores go to the smaller vec_id. A repeated row is
another candidate, and as a query has neighbours of its own, so it is listed once more. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 20
EVERY = 20
#: bytes of the queries that one task holds, and the pairs that make a tile worth a task
QUERY_BYTES = 64 << 20
TILE_PAIRS = 1 << 24
QUERY_STEP, CANDIDATE_STEP, EXACT_STEP = 256, 1024, 1 << 15
#: so many products of two codes are summed exactly in single precision
EXACT_WIDTH = 1024
OWN, OTHER, EMPTY = 0, 1, 2


def usable(vector: Column) -> Column:
    """Whether a vector takes part: finite components, not all of them zero."""
    return (F.size(vector) > 0) & F.forall(vector, lambda x: F.abs(x) < float("inf")) & F.exists(vector, lambda x: x != 0)


class Coded:
    """Vectors with their 8-bit codes (held as single precision), scales, and the norms that the bounds need."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        self.scale = np.abs(x).max(axis=1) / 127.0
        codes = np.rint(np.divide(x, self.scale[:, None], out=np.zeros_like(x), where=self.scale[:, None] > 0))
        decoded = codes * self.scale[:, None]
        self.codes = codes.astype(np.int8).astype(np.float32)
        self.norm, self.decoded, self.rest = (np.sqrt((v * v).sum(axis=1)) for v in (x, decoded, x - decoded))

    def products(self, other: Coded, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of the decoded vectors, and how far the true ones can lie from them."""
        whole = sum((self.codes[rows, a : a + EXACT_WIDTH] @ other.codes[:, a : a + EXACT_WIDTH].T).astype(np.float64) for a in range(0, self.x.shape[1], EXACT_WIDTH))
        near = whole * (self.scale[rows, None] * other.scale[None, :])
        error = np.outer(self.decoded[rows] * (1 + 1e-9), other.rest) + np.outer(self.rest[rows] + 1e-9 * self.norm[rows], other.norm)
        return near, error


class Tile:
    """The queries of one tile and, for each of them, the best ``keep`` candidates so far."""

    def __init__(self, keep: int) -> None:
        self.keep = keep
        self.given: list[pa.RecordBatch] = []
        self.queries: Coded | None = None

    def add(self, rows: pa.RecordBatch) -> None:
        self.given.append(rows.select(["vec_id", "k1", "k2", "times", "vector"]))

    def _settle(self) -> None:
        table = pa.Table.from_batches(self.given)
        self.names = table.drop_columns(["vector"])
        self.ids = table["vec_id"].to_numpy()
        self.queries = Coded(_matrix(table["vector"].combine_chunks(), len(self.ids)))
        shape = (len(self.ids), self.keep)
        self.score, self.id, self.kind = np.full(shape, -np.inf), np.full(shape, np.iinfo(np.int64).max), np.full(shape, EMPTY, np.int8)

    def offer(self, rows: pa.RecordBatch) -> None:
        if not self.given:
            return
        if self.queries is None:
            self._settle()
        for at in range(0, rows.num_rows, CANDIDATE_STEP):
            part = rows.slice(at, CANDIDATE_STEP)
            ids, x = part.column("vec_id").to_numpy(), _matrix(part.column("vector"), part.num_rows)
            some = _first_of_equals(x, ids, self.keep)
            self._compare(ids[some], Coded(x[some]))

    def _compare(self, ids: np.ndarray, other: Coded) -> None:
        for q0 in range(0, len(self.ids), QUERY_STEP):
            rows = slice(q0, q0 + QUERY_STEP)
            with np.errstate(all="ignore"):  # products beyond double precision are recomputed like all undecided ones
                near, error = self.queries.products(other, rows)
                least = self.score[rows, -1]
                if len(ids) >= self.keep and np.isneginf(least).any():
                    least = np.fmax(least, np.partition(near - error, len(ids) - self.keep, axis=1)[:, len(ids) - self.keep])
                i, j = np.nonzero(~(near + error < least[:, None]))
            for a in range(0, len(i), EXACT_STEP):
                self._keep(i[a : a + EXACT_STEP] + q0, j[a : a + EXACT_STEP], ids, other.x)

    def _keep(self, i: np.ndarray, j: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            score = np.cumsum(self.queries.x[i] * x[j], axis=1)[:, -1]
        better = ~(score < self.score[i, -1])
        i, j, score = i[better], j[better], score[better]
        kind = np.full(len(i), OTHER, np.int8)
        same = np.flatnonzero(ids[j] == self.ids[i])
        kind[same[(self.queries.x[i[same]] == x[j[same]]).all(axis=1)]] = OWN
        who = np.unique(i)
        all_i = np.concatenate([np.repeat(who, self.keep), i])
        columns = [np.concatenate([old[who].ravel(), new]) for old, new in ((self.score, score), (self.id, ids[j]), (self.kind, kind))]
        order = np.lexsort((columns[2], columns[1], -columns[0], all_i))
        sorted_i = all_i[order]
        best = order[np.arange(len(order)) - np.searchsorted(sorted_i, sorted_i) < self.keep]
        for heap, values in zip((self.score, self.id, self.kind), columns, strict=True):
            heap[who] = values[best].reshape(len(who), self.keep)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.queries is None:
            return
        for a in range(0, len(self.ids), 4096):
            q, place = np.nonzero(self.kind[a : a + 4096] != EMPTY)
            q += a
            names = self.names.take(q).combine_chunks()
            found = [self.id[q, place], self.score[q, place], self.kind[q, place] == OWN]
            yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in names.columns), *map(pa.array, found)], ["query_id", "k1", "k2", "times", "vec_id", "score", "own"])


def _matrix(lists: pa.Array, n: int) -> np.ndarray:
    return lists.flatten().to_numpy().astype(np.float64).reshape(n, -1)


def _first_of_equals(x: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Rows without those for which ``keep`` equal vectors of smaller or equal ids are at hand: they can be nobody's best."""
    names = np.unique(np.ascontiguousarray(x + 0.0).view(f"V{x.shape[1] * 8}").ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((ids, names))
    return np.sort(order[np.arange(len(order)) - np.searchsorted(names[order], names[order]) < keep])


def _upto(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def grid(n: int, n_queries: int, width: int, tasks: int) -> tuple[int, int]:
    """Blocks of queries and of candidates: tiles for the tasks at hand, as few copies of vectors as that allows."""
    tiles = max(1, min(tasks, math.ceil(n * n_queries / TILE_PAIRS)))
    blocks = max(1, math.ceil(n_queries * width * 8 / QUERY_BYTES), round(math.sqrt(tiles * n_queries / max(n, 1))))
    return blocks, math.ceil(tiles / blocks)


def nearest(embeddings: DataFrame, is_query: Column, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest inner product with each row that ``is_query`` names."""
    vectors = embeddings.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    asked = F.coalesce(is_query, F.lit(False))
    n, n_queries, width = vectors.agg(F.count("*"), F.count_if(asked), F.max(F.size("embedding"))).first()
    tasks = int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    across, down = grid(n, n_queries, width or 0, tasks)

    # equal rows ask once and are listed as often as they occur; two hashes tell apart other vectors of one id
    queries = vectors.where(asked).groupBy("vec_id", F.col("embedding").alias("vector")).agg(F.count("*").alias("times"))
    names = [F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit(1), "vector").alias("k2")]
    block = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(across))
    queries = queries.select(F.lit(0).alias("side"), block.alias("i"), _upto(down).alias("j"), "vec_id", *names, "times", "vector")
    nothing = F.lit(0).cast("long")
    candidates = vectors.select(
        F.lit(1).alias("side"), _upto(across).alias("i"), F.pmod(F.monotonically_increasing_id(), F.lit(down)).alias("j"),
        "vec_id", nothing.alias("k1"), nothing.alias("k2"), nothing.alias("times"), F.col("embedding").alias("vector"),
    )
    keys = ["d", "i", "j"]
    dealt = queries.unionByName(candidates).withColumn("d", F.size("vector").cast("long"))
    dealt = dealt.repartitionById(across * down, (F.col("i") * down + F.col("j")).cast("int")).sortWithinPartitions(*keys, "side")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, tile = None, Tile(k + 1)
        for batch in batches:
            places = np.stack([batch.column(c).to_numpy() for c in (*keys, "side")])
            turns = np.flatnonzero((places[:, 1:] != places[:, :-1]).any(axis=0)) + 1
            edges = [0, *turns.tolist(), batch.num_rows] if batch.num_rows else []
            for s, e in zip(edges, edges[1:], strict=False):
                if tuple(places[:3, s]) != name:
                    yield from tile.rows()
                    name, tile = tuple(places[:3, s]), Tile(k + 1)
                (tile.offer if places[3, s] else tile.add)(batch.slice(s, e - s))
        yield from tile.rows()

    heaps = dealt.mapInArrow(search, "query_id long, k1 long, k2 long, times long, vec_id long, score double, own boolean")
    best = Window.partitionBy("query_id", "k1", "k2").orderBy(F.desc("score"), "vec_id", F.desc("own"))
    own = F.sum(F.col("own").cast("int")).over(best.rowsBetween(Window.unboundedPreceding, 0))  # the first own row is the query itself
    ranked = heaps.withColumns({"place": F.row_number().over(best), "owns": own}).where(~(F.col("own") & (F.col("owns") == 1)))
    ranked = ranked.withColumn("rank", F.col("place") - (F.col("owns") > 0).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("time")).drop("time")


def neighbours(embeddings: DataFrame, every: int = EVERY, k: int = TOP) -> DataFrame:
    """The ``k`` nearest of every row whose vec_id is divisible by ``every``, among all other rows."""
    return nearest(embeddings, F.col("vec_id") % every == 0, k)
