"""SimHash fingerprints of whole texts, and all fingerprints within a Hamming radius. DataFrame functions only.

A text's terms are its runs of three words; a term's weight is how often it occurs. Each occurrence votes with the
128 bits of two hashes, and a bit is set where more than half of the votes are. The votes of 128 bits are 64 sums
of long columns, two 32-bit counters in each, so they stay in generated code and combine before any shuffle.

Defined cases: a null text is empty; a text without words has the fingerprint of 128 zero bits; a text of one or
two words has one term, of all its words; ties of a vote give 0. Rows that repeat both id and text get equal
results; texts that share an id are ordered by their hash. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfolio.llm.common import in_order, stored

BITS = 128
SEEDS = (1, 2)
#: Differing bits of 128 up to which texts are searched, and blocks of the search's tables. A text of which 1 % of the
#: words are replaced keeps a cosine of about 0.97, which is 10 bits; five blocks find up to 9 with one bit flipped.
RADIUS, BLOCKS = 9, 5
QUERY_EVERY = 50  # the stated query set of the search
LANES = 0x0000000100000001  # two counters of 32 bits in a long


def word_codes(text: Column) -> Column:
    """Hashes of the words of a text, in order; the terms are runs of three of them."""
    return F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _votes() -> list[Column]:
    """64 sums over exploded terms ``w0, w1, w2``; sum j of a hash counts its bits j and j + 32."""
    out = []
    for s in SEEDS:
        h = F.xxhash64(F.lit(s), "w0", "w1", "w2")
        out += [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(LANES))).alias(f"v{s}_{j}") for j in range(32)]
    return out


def _bits(seed: int) -> Column:
    """The 64 bits that the votes of one hash decide."""
    bits = []
    for j in range(32):
        both = F.col(f"v{seed}_{j}")
        bits += [F.when(both.bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("n_terms"), F.lit(1 << j)).otherwise(F.lit(0)), F.when(F.shiftrightunsigned(both, 32) * 2 > F.col("n_terms"), F.shiftleft(F.lit(1).cast("long"), j + 32)).otherwise(F.lit(0))]
    total = bits[0].cast("long")
    for b in bits[1:]:
        total = total.bitwiseOR(b.cast("long"))
    return total


def fingerprints(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, high, low) for every row of ``texts(keys..., text)`` that has words; keys must name a row."""
    hashed = texts.select(*keys, word_codes(F.col(text)).alias("hashes")).where(F.size("hashes") > 0)
    ahead = lambda k: F.slice("hashes", k + 1, F.greatest(F.size("hashes") - k, F.lit(0)))
    # element i of the zipped array is a run of three words; runs that pass the end are kept only for short texts
    zipped = F.arrays_zip(F.col("hashes").alias("w0"), ahead(1).alias("w1"), ahead(2).alias("w2"))
    runs = F.slice(zipped, 1, F.greatest(F.size("hashes") - 2, F.lit(1)))
    terms = hashed.select(*keys, F.explode(runs).alias("t")).select(*keys, "t.*")
    votes = terms.groupBy(*keys).agg(F.count("*").alias("n_terms"), *_votes())
    return votes.select(*keys, _bits(1).alias("high"), _bits(2).alias("low"))


def as_text(high: Column, low: Column) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(F.coalesce(x, F.lit(0))), 16, "0") for x in (high, low)]))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Number of bits in which two fingerprints differ."""
    zero = F.lit(0).cast("long")
    return sum((F.bit_count(F.coalesce(x, zero).bitwiseXOR(F.coalesce(y, zero))) for x, y in zip(a, b, strict=True)), F.lit(0))


def likeness(bits: Column) -> Column:
    """The cosine of term weights that so many differing bits estimate, 0 where it is negative."""
    return F.greatest(F.lit(0.0), F.cos(bits * F.lit(math.pi / BITS)))


def with_next(ids: DataFrame, order: list[str], keys: list[str]) -> DataFrame:
    """``ids`` with ``next_<key>`` of the row that follows in ``order``; the first follows the last.

    Rows are numbered inside ranges; only one row per range is compared with other ranges.
    """
    parts = stored(in_order(ids, order, "part"), "order")
    inside = Window.partitionBy("part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    me = F.struct(*keys)
    led = parts.withColumns({"next": F.lead(me).over(inside), "n": F.row_number().over(inside)})
    firsts = led.where("n = 1").select("part", me.alias("first"))
    across, everywhere = Window.orderBy("part"), Window.partitionBy()
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(across), F.min_by("first", "part").over(everywhere)).alias("across"))
    # one row per range: as small as the number of shuffle partitions
    out = led.join(F.broadcast(firsts), "part").withColumn("next", F.coalesce("next", "across"))
    return out.select(*ids.columns, *[F.col(f"next.{k}").alias(f"next_{k}") for k in keys])


def fingerprints_with_edits(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Fingerprints of ``documents(doc_id, text)`` and of edited texts: the last quarter gives way to the start of the next text.

    Rows whose id is divisible by ``QUERY_EVERY`` are searched among all rows: ``n_within_radius`` is the number of
    other rows at most ``radius`` bits away, null for rows that are not searched.

    Whole texts are shuffled once, by row key; the start of the next text is cut off where it lies and sent on.
    """
    text = F.coalesce("text", F.lit(""))
    # k and h name a row: hashes of (id, text) and of the text, never null
    docs = documents.select("doc_id", text.alias("text")).select(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text").alias("k"), F.xxhash64("text").alias("h"), "doc_id", "text")
    ids = docs.select("doc_id", "k", "h", F.length("text").cast("long").alias("n_chars")).distinct()
    order = stored(with_next(ids, ["doc_id", "h", "k"], ["k", "h"]), "next")
    asked = order.select(F.col("next_k").alias("k"), F.col("next_h").alias("h"), F.col("k").alias("for_k"), F.col("h").alias("for_h"), F.expr("cast(floor(n_chars / 4) as int)").alias("take"))
    tails = docs.select("k", "h", "text").dropDuplicates(["k", "h"]).join(asked, ["k", "h"]).select(F.col("for_k").alias("k"), F.col("for_h").alias("h"), F.expr("substring(text, 1, take)").alias("tail"))
    both = docs.select("k", "h", "text").dropDuplicates(["k", "h"]).join(tails, ["k", "h"])
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), "tail")
    both = both.select("k", "h", "text", edited.alias("edited"))
    versions = both.select("k", "h", F.explode(F.array(F.struct(F.lit(0).alias("version"), F.col("text").alias("t")), F.struct(F.lit(1).alias("version"), F.col("edited").alias("t")))).alias("v")).select("k", "h", "v.version", F.col("v.t").alias("t"))
    prints = fingerprints(versions, ["k", "h", "version"], "t")
    pick = lambda c, v: F.max(F.when(F.col("version") == v, F.col(c)))
    prints = prints.groupBy("k", "h").agg(pick("high", 0).alias("high"), pick("low", 0).alias("low"), pick("high", 1).alias("edited_high"), pick("low", 1).alias("edited_low"))
    sums = both.select("k", "h", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))
    kept = stored(sums.join(prints, ["k", "h"], "left"), "fingerprints")
    after = kept.select(F.col("k").alias("next_k"), F.col("h").alias("next_h"), F.col("high").alias("next_high"), F.col("low").alias("next_low"))
    mine, edit, nxt = ((F.col(f"{x}high"), F.col(f"{x}low")) for x in ("", "edited_", "next_"))
    rows = docs.select("k", "h").groupBy("k", "h").agg(F.count("*").alias("times"))  # repeated rows come back as often as they were
    searched = kept.join(order.select("k", "h", "doc_id"), ["k", "h"]).where(F.col("doc_id") % QUERY_EVERY == 0)
    zero = F.lit(0).cast("long")
    full = kept.join(rows, ["k", "h"]).select(F.coalesce("high", zero).alias("high"), F.coalesce("low", zero).alias("low"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_"))
    asked_for = searched.select(F.struct("k", "h").alias("query"), F.coalesce("high", zero).alias("high"), F.coalesce("low", zero).alias("low"))
    near = count_within_radius(asked_for, full, radius).select("query.k", "query.h", (F.col("n") - 1).alias("n_within_radius"))
    out = order.join(kept, ["k", "h"]).join(after, ["next_k", "next_h"]).join(rows, ["k", "h"]).join(near, ["k", "h"], "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_text(*mine).alias("fingerprint"), as_text(*edit).alias("edited_fingerprint"),
        likeness(distance(mine, edit)).alias("near_edited"), likeness(distance(mine, nxt)).alias("near_next"), "n_within_radius", F.expr("explode(sequence(1, cast(times as int)))").alias("_"),
    ).drop("_")


def close_prints(queries: DataFrame, prints: DataFrame, radius: int) -> DataFrame:
    """(high, low, high2, low2, bits) of all different fingerprints of both tables at most ``radius`` bits apart.

    The bits are dealt into ``BLOCKS`` blocks, radius + 1 if those are fewer; two fingerprints within the radius differ
    in at most radius / blocks bits of one of them. Table t is keyed by block t; queries ask for their own key and for
    all keys so few bits away, so prints are written once per block and keys stay long. A pair is kept in the first
    table in which it is that near, so no pair is found twice and none is lost.
    """
    blocks = min(radius + 1, BLOCKS)
    flips = radius // blocks
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    spans = [(a + 1, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    binary = lambda high, low: F.concat(*[F.lpad(F.bin(x), 64, "0") for x in (high, low)])

    def keys(df: DataFrame) -> DataFrame:
        bits = binary(F.col("high"), F.col("low"))
        parts = F.array(*[F.conv(F.substring(bits, *x), 2, 10).cast("long") for x in spans])
        return df.select("high", "low").where("high is not null and low is not null").distinct().select("high", "low", F.posexplode(parts).alias("t", "key"))

    widest = max(n for _, n in spans)
    masks = F.array(*[F.lit(sum(1 << i for i in c)).cast("long") for k in range(flips + 1) for c in combinations(range(widest), k)])
    # a bit above a narrower block makes a key that no print has
    ask = keys(queries).select("high", "low", "t", F.explode(F.transform(masks, lambda m: F.col("key").bitwiseXOR(m))).alias("key"))
    give = keys(prints).select(F.col("high").alias("high2"), F.col("low").alias("low2"), "t", "key")
    # stated: the optimiser takes the keys asked for to be as few as their queries and would gather all of them on the driver
    close = ask.hint("merge").join(give, ["t", "key"]).withColumn("bits", distance((F.col("high"), F.col("low")), (F.col("high2"), F.col("low2"))))
    other = binary(F.col("high").bitwiseXOR(F.col("high2")), F.col("low").bitwiseXOR(F.col("low2")))
    near = F.array(*[F.length(F.replace(F.substring(other, *x), F.lit("0"), F.lit(""))) <= flips for x in spans])
    return close.where(F.col("bits") <= radius).where(F.array_position(near, True) - 1 == F.col("t")).select("high", "low", "high2", "low2", "bits")


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(query, id, bits) for all ``prints(id, high, low)`` at most ``radius`` bits from ``queries(query, high, low)``."""
    named = close_prints(queries, prints, radius).join(queries.select("query", "high", "low"), ["high", "low"]).select("query", "high2", "low2", "bits")
    return named.join(prints.select("id", F.col("high").alias("high2"), F.col("low").alias("low2")), ["high2", "low2"]).select("query", "id", "bits")


def count_within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(query, n) with the number of rows of ``prints`` within the radius; equal fingerprints are counted and not listed."""
    often = prints.groupBy(F.col("high").alias("high2"), F.col("low").alias("low2")).agg(F.count("*").alias("n"))
    sums = close_prints(queries, prints, radius).join(often, ["high2", "low2"]).groupBy("high", "low").agg(F.sum("n").alias("n"))
    return queries.select("query", "high", "low").distinct().join(sums, ["high", "low"]).select("query", "n")
