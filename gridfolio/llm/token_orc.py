"""Token ids of whole texts in ORC files, read back by stripes.

Texts are range-partitioned and sorted by doc_id and then encoded, so a text is shuffled and never its ids; each task
streams its documents into one file. ORC stores the ids with integer run-length encoding in stripes, with a row index
per ``ROW_INDEX`` documents and a Bloom filter on doc_id: readers take stripes in parallel, and a filter on doc_id
skips files, stripes and row groups by their metadata.

Encoding cuts a text before each run of white space that follows another character, and between letters and marks. No
token of the byte-level vocabulary crosses such a cut, so the pieces are encoded apart, each distinct one once
(``piece_table``).

Defined cases: a null text is empty and has the end id only; a null doc_id comes first; equal doc_ids stay in one
range, in any order among themselves, with their starts in that order. Other columns are ignored. The name of a special
token inside a text, such as <|endoftext|>, is that token's single id, as the library gives by default.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridfolio.llm.chunk_ids import ChunkEncoder
from gridfolio.llm.common import in_order, new_path, running_totals, stored
from gridfolio.llm.piece_table import BLOCK, PieceTable, padded, texts_of

END_ID = 2
REMEMBERED = 1_000_000  # distinct pieces a worker remembers; some 200 MB, which changes no result
TABLE_PIECES = 800_000  # the same of the table of pieces; some 100 MB
STRIPE_BYTES, ROW_INDEX, BLOOM_FPP = 64 << 20, 1000, 0.01
pieces = re.compile(r"\s*\S+|\s+\Z").findall


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def byte_bpe(path: str, spell_special: bool = True) -> ChunkEncoder:
    """An encoder of a byte-level vocabulary of the tokenizers library; ids as the library gives them for whole texts.

    With ``spell_special`` names of special tokens are ordinary text; without, a text is cut at the vocabulary's added
    tokens as the library cuts it, and what lies between is cut into pieces. A Python worker loads the vocabulary once and keeps the encoder, with what it remembers, for its later tasks.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    added = {} if spell_special else {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    vocabulary = tokenizer.get_vocab()
    width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each token: a character of its name stands for one
    for token, i in vocabulary.items():
        width[i] = len(token)
    assert set("".join(vocabulary)) >= set(ByteLevel.alphabet())

    def encode(names: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(names), 20_000):  # many pieces in one call; the bytes of the tokens tell them apart
            some = names[at : at + 20_000]
            ids = np.array(tokenizer.encode_batch_fast([some], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            ends = np.searchsorted(np.cumsum(width[ids]), np.cumsum([len(s.encode()) for s in some])) + 1
            data = ids.tobytes()
            out += [data[4 * a : 4 * b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
        return out

    if not added:
        return ChunkEncoder(pieces, encode, REMEMBERED, 4 << 20)

    plain = all(not (t.lstrip or t.rstrip or t.single_word) for t in tokenizer.get_added_tokens_decoder().values())
    assert plain, "added tokens that take in their surroundings are not cut out"
    cuts = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def split(text: str) -> list[str]:
        if not any(n in text for n in added):
            return pieces(text)
        return [x for part in cuts.split(text) for x in ([part] if part in added else pieces(part))]

    def encode_some(names: list[str]) -> list[bytes]:
        ids = encode([n for n in names if n not in added])
        of = iter(ids)
        return [np.array([added[n]], "<u4").tobytes() if n in added else next(of) for n in names]

    return ChunkEncoder(split, encode_some, REMEMBERED, 4 << 20)


@lru_cache(maxsize=2)
def piece_table(path: str, end_id: int) -> tuple[PieceTable, tuple[bytes, ...]]:
    """The worker's table of pieces, and the names of the vocabulary's added tokens; kept for the worker's later tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = tuple(t.content.encode() for t in tokenizer.get_added_tokens_decoder().values())
    tokenizer.encode_special_tokens = True
    vocabulary = tokenizer.get_vocab()
    width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each token: a character of its name stands for one
    for token, i in vocabulary.items():
        width[i] = len(token)

    def encode(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, ends, total = [np.empty(0, np.int32)], [np.empty(0, np.int64)], 0
        for at in range(0, len(names), 20_000):  # many pieces in one call; the bytes of the tokens tell them apart
            some = names[at : at + 20_000]
            got = np.array(tokenizer.encode_batch_fast([some], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int32)
            ends.append(np.searchsorted(np.cumsum(width[got]), np.cumsum([len(n.encode()) for n in some])) + 1 + total)
            ids.append(got)
            total += len(got)
        return np.concatenate(ids), np.concatenate(ends)

    return PieceTable(encode, end_id, TABLE_PIECES), added


def encode_columns(batches: Iterator[pa.RecordBatch], path: str, end_id: int, spell_special: bool = False) -> Iterator[pa.RecordBatch]:
    """(the other columns, ids) for batches whose last column is the text, ``end_id`` after each document.

    Texts go through the worker's table of pieces as bytes. A text with the name of an added token in it is cut there,
    as the library does, and its parts are encoded apart; with ``spell_special`` such names are ordinary text.
    """
    table, added = piece_table(path, end_id)
    added = () if spell_special else added
    for whole in batches:
        buf, offsets = texts_of(whole.column(whole.num_columns - 1))
        at = 0
        while at < whole.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
            bounds = offsets[at : to + 1] - offsets[at]
            data = padded(buf, offsets[at], offsets[to])
            ids, n = table.encoded(data, bounds)
            if any(name in memoryview(data).tobytes() for name in added):
                ids, n = _with_added(data, bounds, ids, n, path, end_id)
            ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(c.slice(at, to - at) for c in whole.columns[:-1]), pa.ListArray.from_arrays(ends, pa.array(ids))], [*whole.schema.names[:-1], "ids"])
            at = to


def _with_added(data: np.ndarray, bounds: np.ndarray, ids: np.ndarray, n: np.ndarray, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids, but of texts that name added tokens as the encoder that cuts at these gives them."""
    encoder, added = byte_bpe(path, False), piece_table(path, end_id)[1]
    starts = np.concatenate([[0], np.cumsum(n)])
    parts, n = [], n.copy()
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        text = data[a:b].tobytes()
        if any(name in text for name in added):
            parts.append(np.append(np.frombuffer(encoder([text.decode("utf-8")])[0], "<i4"), np.int32(end_id)))
            n[i] = len(parts[-1])
        else:
            parts.append(ids[starts[i] : starts[i + 1]])
    return np.concatenate(parts), n


def write_orc(documents: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Files of (doc_id, ids) in ascending order of doc_id: their names sort in that order."""
    kind = dict(documents.dtypes)["doc_id"]
    ordered = in_order(documents.select("doc_id", "text"), ["doc_id"], "part").select("doc_id", "text")
    ids = ordered.mapInArrow(partial(encode_columns, path=tokenizer or default_tokenizer(), end_id=end_id), f"doc_id {kind}, ids array<int>")
    options = {"orc.stripe.size": STRIPE_BYTES, "orc.row.index.stride": ROW_INDEX, "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": BLOOM_FPP, "orc.compress": "ZSTD"}
    ids.write.options(**{k: str(v) for k, v in options.items()}).orc(folder)


def read_orc(spark: SparkSession, folder: str, ids: list | None = None, between: tuple | None = None) -> DataFrame:
    """(doc_id, ids, file, at): the documents with the file they lie in and an order inside it.

    Documents of some ids, or of a range of ids with both ends, are asked for here: the condition is put below the order
    column, so it reaches the files, and files, stripes and row groups are skipped by their indexes and Bloom filters.
    """
    rows = spark.read.orc(folder)
    if ids is not None:
        rows = rows.where(F.col("doc_id").isin(list(ids)))
    if between is not None:
        rows = rows.where(F.col("doc_id").between(*between))
    return rows.select("doc_id", "ids", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"))


def document_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files.

    ``start`` adds the ids of earlier files, from one row per file, to those before it in its file. Ids are read in
    place, a batch of a stripe at a time.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            ends, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crcs = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("file"), batch.column("at"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "file", "at", "n_tokens", "ids_crc32"])

    files = read_orc(spark, folder)
    kind = dict(files.dtypes)["doc_id"]
    rows = stored(files.mapInArrow(sums, f"doc_id {kind}, file string, at long, n_tokens long, ids_crc32 long"), "tokens")
    before = running_totals(rows, "file", {"before": "n_tokens"})
    inside = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "at").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return starts.join(before, "file").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def tokens_through_orc(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    folder = new_path(documents.sparkSession, "token-orc")
    write_orc(documents, folder, tokenizer)
    return document_tokens(documents.sparkSession, folder)
