"""Near copies of documents by DartMinHash signatures of weighted word shingles.

A text is a weighted set: its runs of five words, weighted by how often they occur. Darts are thrown at the region
[0, weight) x [0, infinity) of every element: a Poisson process of rate 1 per unit of weight, drawn from hashes of
(element, unit, number of the throw), so equal regions of different texts receive equal darts. A dart also hashes
to one of ``K`` coordinates, and each coordinate keeps its earliest dart. Two texts agree in a coordinate with
probability equal to their weighted Jaccard similarity. Only darts earlier than about (ln K + 2) K / total weight
are drawn, so a long text throws hardly more darts than a short one.

Bands of ``ROWS`` coordinates give buckets. Texts are linked where the exact weighted similarity is at least the
threshold. First the smallest document of each bucket is compared with the others. Buckets whose documents are then
still in more than one component are dealt into tiles; all pairs of two tiles are compared in one task, as a product
of matrices, and a document sends one edge to the smallest it reaches. So nothing is capped, no group emits its
pairs, and no link that would join two classes is left out.

Defined cases: null and wordless texts are copies of nothing; shorter texts have one shingle of all their words;
rows that share a doc_id are one document, whose texts are all compared; a null doc_id belongs to no class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfolio.llm.common import GOLDEN, chunks, components, mix, normal_words, pieces, shingle_hashes, smallest_reachable, stored, tile_pairs, uniform, whole_groups

SHINGLE = 5
THRESHOLD = 0.8
#: 32 bands of 6: a pair of similarity 0.8 shares no bucket with probability 6e-5, one of 0.85 with 3e-7.
BANDS, ROWS = 32, 6
K = BANDS * ROWS
TILE = 512


def weighted_elements(texts: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, weight, position of the text): the distinct shingles of normalised texts and their counts, in order."""
    hashes, owner = shingle_hashes(texts, width)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(new)
    return hashes[starts], np.diff(np.append(starts, len(hashes))).astype(float), owner[starts]


def unit_regions(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Regions one unit of weight wide, (name, width, owner); the last of an element with a fractional weight is narrower."""
    n = np.ceil(weights).astype(np.int64)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    width = np.minimum(np.repeat(weights, n) - number, 1.0)
    return mix(np.repeat(elements, n) + GOLDEN * (number.astype(np.uint64) + np.uint64(1))), width, np.repeat(owner, n)


def dart_signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n_texts: int, k: int = K) -> np.ndarray:
    """(n_texts, k) names of the earliest dart per coordinate; zeros for texts of no weight."""
    names, width, owner = unit_regions(elements, weights, owner)
    total = np.bincount(owner, width, n_texts)
    best = np.full(n_texts * k, np.inf)
    ids = np.zeros(n_texts * k, np.uint64)
    until = k * (np.log(k) + 2) / np.maximum(total, 1e-12)
    todo = total > 0
    while todo.any():
        at = np.flatnonzero(todo[owner])
        rank, throw = np.zeros(len(at)), 0
        keys, ranks, darts = [], [], []
        while len(at):
            throw += 1
            h = mix(names[at] ^ mix(np.full(1, throw, np.uint64) * GOLDEN))
            rank = rank - np.log(uniform(h))
            early = rank < until[owner[at]]
            at, rank, h = at[early], rank[early], h[early]
            place = mix(h + GOLDEN)
            hit = uniform(mix(place + GOLDEN)) <= width[at]  # below the weight of a narrower region
            keys.append(owner[at[hit]] * k + (place[hit] % np.uint64(k)).astype(np.int64))
            ranks.append(rank[hit])
            darts.append(h[hit])
        key, rank, dart = np.concatenate(keys), np.concatenate(ranks), np.concatenate(darts)
        np.minimum.at(best, key, rank)
        won = rank == best[key]
        ids[key[won]] = dart[won]
        todo &= ~np.isfinite(best.reshape(n_texts, k)).all(axis=1)  # a coordinate without a dart: look further
        until = until * 2
    return ids.reshape(n_texts, k)


def band_hashes(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(texts, bands) bucket names; the number of the band is part of the name."""
    total = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN), (len(signatures), bands)).copy()
    for r in range(rows):
        total = mix(total * GOLDEN + signatures[:, r::rows][:, :bands])
    return total.view(np.int64)


def signed(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, content, bands) of every row with words; ``content`` names the sequence of words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for batch in batches for p in pieces(batch, 1)):
            named = [(i, normal_words(t)) for i, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True) if i is not None]
            ids, some = [i for i, t in named if t], [t for _, t in named if t]
            if not some:
                continue
            bands = band_hashes(dart_signatures(*weighted_elements(some), len(some)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
            content = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in some]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(content, pa.binary()), lists], ["id", "content", "bands"])

    return documents.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(sign, "id long, content binary, bands array<long>")


def _regions(texts: list[str]) -> list[np.ndarray]:
    """The sorted names of the unit regions of each normalised text."""
    names, _, owner = unit_regions(*weighted_elements(texts))
    names = names[np.lexsort((names, owner))]
    return np.split(names, np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two texts from the sorted names of their unit regions."""
    both = np.intersect1d(a, b, assume_unique=True).size
    return both / max(a.size + b.size - both, 1)


def similar_pairs(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The ``pairs(a, b)`` of which the ``texts(id, text)`` are at least so similar, compared exactly."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = (batch.column(i) for i in range(4))
            left, right = left.dictionary_encode(), right.dictionary_encode()
            keep, known = [], {}
            for group in chunks([x.as_py() for x in right.dictionary], 1 << 19):
                words = [normal_words(right.dictionary[i].as_py()) for i in group]
                known |= dict(zip(group, _regions(words), strict=True))
            firsts: dict[int, np.ndarray] = {}
            for row, (i, j) in enumerate(zip(left.indices.to_pylist(), right.indices.to_pylist(), strict=True)):
                if i not in firsts:
                    firsts[i] = _regions([normal_words(left.dictionary[i].as_py())])[0]
                if similarity(firsts[i], known[j]) >= threshold:
                    keep.append(row)
            yield pa.RecordBatch.from_arrays([a.take(pa.array(keep, pa.int64())), b.take(pa.array(keep, pa.int64()))], ["a", "b"])

    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("right")), "b")
    with_a = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("left")), "a")
    return with_a.select("a", "b", "left", "right").mapInArrow(compare, "a long, b long")


def overlaps(regions: list[np.ndarray]) -> np.ndarray:
    """Number of common unit regions of every two texts, as products of 0/1 matrices over blocks of regions."""
    sizes = [len(r) for r in regions]
    names, where, often = np.unique(np.concatenate(regions), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(regions)), sizes)
    shared = often > 1
    column = np.cumsum(shared) - 1
    owner, where = owner[shared[where]], column[where[shared[where]]]
    order = np.argsort(where, kind="stable")
    owner, where = owner[order], where[order]
    out = np.zeros((len(regions), len(regions)), np.float32)
    for at in range(0, int(shared.sum()), 2048):
        a, b = np.searchsorted(where, [at, at + 2048])
        block = np.zeros((len(regions), 2048), np.float32)
        block[owner[a:b], where[a:b] - at] = 1
        out += block @ block.T
    return out


def across(places: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) that join what is linked inside the buckets ``places(bucket, id)``: all pairs are compared."""
    keys = ["bucket", "lo", "hi"]
    rows = tile_pairs(places, "bucket", "id", TILE).join(texts, "id").select(*keys, "id", "text")
    spread = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in whole_groups(batches, keys):
            ids, found = batch.column("id").to_numpy(), []
            known: dict[str, np.ndarray] = {}  # by text: an id may have several
            for s, e in zip(edges, edges[1:], strict=False):
                texts_here = [batch.column("text")[i].as_py() for i in range(s, e)]
                new = list(dict.fromkeys(t for t in texts_here if t not in known))
                known |= dict(zip(new, _regions([normal_words(t) for t in new]) if new else [], strict=True))
                rows, regions = range(s, e), [known[t] for t in texts_here]
                size = np.array([len(r) for r in regions], np.float32)
                both = overlaps(regions)
                i, j = np.nonzero(np.triu(both >= np.float32(threshold) * (size[:, None] + size[None, :] - both) - 1e-3, 1))
                exact = both[i, j].astype(np.float64) / (size[i] + size[j] - both[i, j]).astype(np.float64) >= threshold
                low = smallest_reachable(len(rows), i[exact], j[exact])
                moved = np.flatnonzero(low != np.arange(len(rows)))
                found.append((ids[s:e][moved], ids[s:e][low[moved]]))
                if sum(map(len, known.values())) > 4_000_000:
                    known.clear()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return rows.repartition(spread, *keys).sortWithinPartitions(*keys, "id").mapInArrow(compare, "a long, b long")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id) of every document with an id; class_id is the smallest id of its class of near copies."""
    rows = stored(signed(documents, id_col, text_col), "signed")
    # exact copies: one row per task and content reaches the aggregate
    firsts = rows.groupBy("content").agg(F.min("id").alias("rep"))
    members = stored(rows.select("id", "content").join(firsts, "content").select("id", "rep").distinct(), "members")
    reps = rows.join(firsts.select("content", F.col("rep").alias("id")), ["content", "id"])
    band_rows = reps.select("id", F.explode("bands").alias("bucket"))
    shared = band_rows.groupBy("bucket").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last").select("bucket", "pivot")
    buckets = stored(band_rows.join(shared, "bucket").distinct(), "buckets")

    pairs = stored(buckets.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    needed = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    # the ids grow with the corpus, so the join is stated: the same plan at every size
    texts = stored(texts.join(needed.hint("merge"), "id", "left_semi").distinct(), "texts")

    copies = members.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    links = stored(similar_pairs(pairs, texts, threshold).unionByName(copies), "links")
    nodes = stored(components(links), "nodes")
    placed = buckets.join(nodes, buckets["id"] == nodes["node"], "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    spread = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    mixed = stored(placed.join(spread, "bucket").select("bucket", "id"), "mixed")
    more = across(mixed, texts, threshold)
    roots = nodes.select(F.col("node").alias("a"), F.col("component").alias("b"))
    nodes = components(roots.unionByName(more))
    ids = documents.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    return ids.join(nodes, ids["id"] == nodes["node"], "left").select("id", F.coalesce("component", "id").alias("class_id"))
