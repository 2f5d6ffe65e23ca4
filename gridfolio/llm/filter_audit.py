"""How filters on texts interact: one pass over the bytes of every text, then all orders of the filters from its counts.

A table-driven transducer with two states (between words, inside a word) reads the UTF-8 bytes of a text once. A byte's class
and the state name an entry of the output table: does a word begin or end here, a code point, a capital, a symbol?
The state after a byte depends on its class alone, so the state before it is looked up from its neighbour, and a
block of bytes is one vectorised look-up. Word spans go into a hash table with linear probing: all words of a block are
inserted together, those that find their slot held by another word move on, and words count as equal only where their
bytes agree. Long texts pass in blocks that end between words.

What follows is Spark: copies are found by digest, failures become sets of letters, and since a document's fate in
any order depends on its set alone, one row per (part, set) is all that the 120 orders are computed from. Copies
and parts of any size meet in aggregates with one row per task.

Defined cases: a null text is empty; a null part is the empty string; of rows with equal texts, those whose doc_id
exceeds the smallest are copies; rows of a null doc_id are neither copies nor originals and have no labels; a document is
good (toxic) if any of its label rows says so. Repeated rows count each. Other columns are ignored; an empty table has
no parts and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfolio.llm.common import GOLDEN, mix

BLOCK = 1 << 20
#: words of more bytes are compared as byte strings
LONG = 256

# The transducer -----------------------------------------------------------------

PLAIN, SPACE, CAPITAL, SYMBOL, INNER = range(5)
#: the class of every byte; bytes 0x80-0xBF continue a code point
CLASSES = np.full(256, PLAIN, np.uint8)
CLASSES[[0x20, *range(0x09, 0x0E)]] = SPACE
CLASSES[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = CAPITAL
CLASSES[list(b"#$%&*|")] = SYMBOL
CLASSES[0x80:0xC0] = INNER
BETWEEN, INSIDE = 0, 1
#: the next state, and what is put out, by state and class
NEXT = np.array([[INSIDE, BETWEEN, INSIDE, INSIDE, INSIDE]] * 2, np.uint8)
BEGIN, END, POINT, IS_CAPITAL, IS_SYMBOL = 1, 2, 4, 8, 16
OUTPUT = np.array(
    [
        [BEGIN | POINT, POINT, BEGIN | POINT | IS_CAPITAL, BEGIN | POINT | IS_SYMBOL, BEGIN],
        [POINT, END | POINT, POINT | IS_CAPITAL, POINT | IS_SYMBOL, 0],
    ],
    np.uint8,
)
#: the same by byte: state after it, and output in both states
_AFTER, _OUT = NEXT[0][CLASSES], OUTPUT[:, CLASSES]
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def transduce(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The output of every byte; texts begin at ``starts``, between words."""
    state = np.empty(len(data), np.uint8)
    state[:1] = BETWEEN
    state[1:] = _AFTER[data[:-1]]
    state[starts[starts < len(data)]] = BETWEEN
    return np.where(state == BETWEEN, _OUT[BETWEEN][data], _OUT[INSIDE][data])


def _per_text(flags: np.ndarray, bit: int, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(flags & bit), bounds))


# The hash table of words -----------------------------------------------------------


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as numbers; ``data`` ends with eight bytes of padding."""
    return np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))


def distinct_words(data: np.ndarray, start: np.ndarray, length: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Positions of one word for each distinct (owner, bytes) among words of at most ``LONG`` bytes, verified byte by byte."""
    n = len(start)
    if not n:
        return np.empty(0, np.int64)
    eights = _eights(data)
    first = eights[start] & _MASKS[np.minimum(length, 8)]
    key = mix(first + owner.astype(np.uint64) * GOLDEN + length.astype(np.uint64))
    more: list[tuple[np.ndarray, np.ndarray]] = []  # the words that go on, and their next eight bytes
    rest = np.flatnonzero(length > 8)
    at = 8
    tails = np.full(n, -1, np.int64)
    tails[rest] = np.arange(len(rest))
    while len(rest):
        eight = eights[start[rest] + at] & _MASKS[np.minimum(length[rest] - at, 8)]
        key[rest] = mix(key[rest] * GOLDEN + eight)
        whole = np.zeros(len(more[0][0]) if more else len(rest), np.uint64)
        whole[tails[rest]] = eight
        more.append((rest, whole))
        at += 8
        rest = rest[length[rest] > at]

    def equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        same = (first[a] == first[b]) & (length[a] == length[b]) & (owner[a] == owner[b])
        going = np.flatnonzero(same & (length[a] > 8))
        for k, (_, whole) in enumerate(more):
            going = going[length[a[going]] > 8 * (k + 1)]
            if not len(going):
                break
            bad = whole[tails[a[going]]] != whole[tails[b[going]]]
            same[going[bad]] = False
            going = going[~bad]
        return same

    size = 1 << max(4, int(2 * n - 1).bit_length())
    table = np.full(size, -1, np.int64)
    pending = np.arange(n)
    slot = (key & np.uint64(size - 1)).astype(np.int64)
    while len(pending):
        free = table[slot] < 0
        table[slot[free]] = pending[free]
        other = ~equal(pending, table[slot])  # equal words share key and slot, so they stay together
        pending, slot = pending[other], (slot[other] + 1) & (size - 1)
    return table[table >= 0]


def _block(data: np.ndarray, bounds: np.ndarray) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Counts of the texts between ``bounds``, and the (start, length, text) of their words."""
    flags = transduce(data, bounds[:-1])
    begins = np.flatnonzero(flags & BEGIN)
    filled = bounds[1:][bounds[1:] > bounds[:-1]]
    open_ends = filled[_AFTER[data[filled - 1]] == INSIDE]
    ends = np.sort(np.concatenate([np.flatnonzero(flags & END), open_ends]), kind="stable")
    places = np.searchsorted(begins, bounds)
    counts = {"words": np.diff(places), "code_points": _per_text(flags, POINT, bounds), "capitals": _per_text(flags, IS_CAPITAL, bounds), "symbols": _per_text(flags, IS_SYMBOL, bounds)}
    return counts, (begins, ends - begins, np.repeat(np.arange(len(bounds) - 1), counts["words"]))


def _distinct(data: np.ndarray, spans: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, set[tuple[int, bytes]]]:
    """Positions of distinct short words among the spans, and the distinct long ones."""
    start, length, owner = spans
    short = np.flatnonzero(length <= LONG)
    long = {(int(owner[i]), data[start[i] : start[i] + length[i]].tobytes()) for i in np.flatnonzero(length > LONG)}
    return short[distinct_words(data, start[short], length[short], owner[short])], long


def _padded(buf: np.ndarray, a: int, b: int) -> np.ndarray:
    out = np.zeros(b - a + 8, np.uint8)
    out[:-8] = buf[a:b]
    return out


def _short_texts(buf: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    data = _padded(buf, bounds[0], bounds[-1])
    here = bounds - bounds[0]
    counts, spans = _block(data[:-8], here)
    kept, long = _distinct(data, spans)
    n = np.bincount(spans[2][kept], minlength=len(here) - 1)
    for text, _ in long:
        n[text] += 1
    return counts | {"distinct_words": n}


def _long_text(buf: np.ndarray, begin: int, end: int) -> dict[str, int]:
    """One text block by block. Distinct words of finished blocks are kept as one copy of their bytes."""
    total = dict.fromkeys(("words", "code_points", "capitals", "symbols"), 0)
    seen, long = np.zeros(8, np.uint8), set()
    seen_spans = [np.empty(0, np.int64)] * 3
    while begin < end:
        stop = min(begin + BLOCK, end)
        while stop < end:  # go on to the end of the word that the block would cut
            gap = np.flatnonzero(_AFTER[buf[stop : stop + BLOCK]] == BETWEEN)
            stop = min(stop + (int(gap[0]) + 1 if len(gap) else BLOCK), end)
            if len(gap) or stop == end:
                break
        data = _padded(buf, begin, stop)
        counts, spans = _block(data[:-8], np.array([0, stop - begin]))
        for name in total:
            total[name] += int(counts[name][0])
        kept, more = _distinct(data, spans)
        long |= more
        # earlier words and this block's together, once more through the table
        both = np.concatenate([seen[:-8], data])
        shift = len(seen) - 8
        merged = [np.concatenate([seen_spans[0], spans[0][kept] + shift]), np.concatenate([seen_spans[1], spans[1][kept]]), np.concatenate([seen_spans[2], spans[2][kept]])]
        which = distinct_words(both, *merged)
        start, length = merged[0][which], merged[1][which]
        at = np.cumsum(length) - length
        index = np.repeat(start - at, length) + np.arange(int(length.sum()))
        seen = np.concatenate([both[index], np.zeros(8, np.uint8)])
        seen_spans = [at, length, np.zeros(len(at), np.int64)]
        begin = stop
    return total | {"distinct_words": len(seen_spans[0]) + len(long)}


COUNTS = ("words", "distinct_words", "capitals", "code_points", "symbols")


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """``COUNTS`` of every text of a string array."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    out = {c: np.zeros(len(texts), np.int64) for c in COUNTS}
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
        if offsets[j] - offsets[i] > BLOCK:
            counts: dict = _long_text(buf, int(offsets[i]), int(offsets[j]))
        else:
            counts = _short_texts(buf, offsets[i : j + 1])
        for c in COUNTS:
            out[c][i:j] = counts[c]
        i = j
    return out


def profiles(docs: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """The columns ``keep``, ``COUNTS`` and the SHA-256 ``digest`` of every whole text."""
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], F.coalesce(docs["text"], F.lit("")).alias("text"))
    names = list(keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            counts = text_counts(texts)
            digests = [hashlib.sha256(t.as_buffer()).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(counts[c]) for c in COUNTS), pa.array(digests, pa.binary())], [*names, *COUNTS, "digest"])

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{n}` {kinds[n]}" for n in names), *(f"{c} long" for c in COUNTS), "digest binary"])
    return rows.mapInArrow(count, schema)


# The audit ------------------------------------------------------------------------

#: the failure condition of every filter but the one for copies, which is the last letter
FILTERS = {
    "A": "words < 100",
    "B": "100 * distinct_words < 80 * words",
    "C": "100 * capitals > 10 * code_points",
    "D": "symbols > 0",
}
COPIES = "E"


def failures(docs: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """(part, failed, good, toxic, n): how many documents of a part fail just the filters named by ``failed``."""
    counted = profiles(docs, {"doc_id": docs["doc_id"], "part": F.coalesce(part, F.lit(""))})
    failed = F.concat(*[F.when(F.expr(condition), F.lit(letter)).otherwise(F.lit("")) for letter, condition in FILTERS.items()])
    keys = ["digest", "part", "failed"]
    rows = counted.select("doc_id", "digest", "part", failed.alias("failed")).groupBy("doc_id", *keys).agg(F.count("*").alias("n"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(n) for n, c in (("good", "quality"), ("toxic", "toxic"))])
    rows = rows.join(known.hint("merge"), F.col("doc_id") == F.col("id"), "left")
    marks = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    rows = rows.select("doc_id", *keys, "n", *marks)
    # copies meet in an aggregate; a digest has few (part, marks), however many copies
    nameless = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    alike = rows.groupBy(*keys, "good", "toxic").agg(F.sum("n").alias("n"), nameless.alias("nameless"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"))
    firsts = alike.groupBy(F.col("digest").alias("of")).agg(F.min("first").alias("smallest"))
    alike = alike.join(firsts.hint("merge"), F.col("digest") == F.col("of"))
    originals = F.col("nameless") + F.when(F.col("first") == F.col("smallest"), F.col("n_first")).otherwise(0)
    both = F.array(F.struct(F.col("failed").alias("failed"), originals.alias("n")), F.struct(F.concat("failed", F.lit(COPIES)).alias("failed"), (F.col("n") - originals).alias("n")))
    split = alike.select("part", "good", "toxic", F.explode(both).alias("s")).select("part", "good", "toxic", "s.failed", "s.n")
    return split.where("n > 0").groupBy("part", "failed", "good", "toxic").agg(F.sum("n").alias("n"))


def all_orders(cells: DataFrame, letters: str = "".join(FILTERS) + COPIES) -> DataFrame:
    """One row per part, order of the filters and step, from ``failures``."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    sums = {"n": F.sum("n"), "n_good": F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)), "n_toxic": F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0))}
    sets = cells.groupBy("part", "failed").agg(*[c.alias(n) for n, c in sums.items()])
    steps = sets.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    earlier = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    fails = F.contains(F.col("failed"), letter)
    survived = reduce(lambda a, b: a & b, [~(F.contains(F.col("failed"), F.lit(x)) & F.contains(earlier, F.lit(x))) for x in letters])
    # of all orders, those in which the letter is the first of its set: one in as many as the set has letters
    share = F.expr(f"n * {_factorial(len(letters))}L div greatest(length(failed), 1)")

    def total(when: Column, what: Column | str = "n") -> Column:
        return F.sum(F.when(when, F.col(what) if isinstance(what, str) else what).otherwise(0)).cast("long")

    return steps.groupBy("part", "filter_order", "step").agg(
        total(survived & ~fails).alias("kept"),
        total(survived & fails).alias("removed"),
        total(~survived & fails).alias("redundant"),
        total(F.col("failed") == letter).alias("unique_fails"),
        total(survived & fails, "n_good").alias("good_lost"),
        total(survived & fails, "n_toxic").alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )


def _factorial(n: int) -> int:
    return reduce(lambda a, b: a * b, range(1, n + 1), 1)


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of all documents, by language."""
    return all_orders(failures(docs, labels, docs["lang"]))
