"""Document boundaries in flat files of token ids that have no index.

A file is nothing but little-endian ids of 16 bits (32 where the vocabulary has more ids), a separator after each
document. Documents are written where they lie, so nothing is shuffled; a narrow table keeps which document was the
how-manieth of which file, and no lengths. A file is read in blocks by byte ranges: a task finds the separators of a
block in one vectorised comparison and sends the ends it found. Boundaries are stitched by a prefix scan over blocks:
where the last separator before a block lies, and how many there were. The scan runs inside files and over one row
per file, so neither a file nor the whole table passes through one task.

Numbers and starts of documents in the order of doc_id, which do not depend on where a document was written, come from
the counts alone: a narrow table is range-partitioned by doc_id, and one row per range is summed.

Defined cases: ids after the last separator of a file are a document of their own, with ``ended`` false; two
separators in a row bound an empty document; files of no bytes hold no document. Documents never cross files.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridfolio.llm.common import file_system, in_order, new_file, new_path, running_totals, stored
from gridfolio.llm.token_orc import default_tokenizer, encode_columns

SEPARATOR = 50256
BLOCK_IDS = 1 << 20
WIDTH = 2  # bytes of an id of a vocabulary with at most 65,536


@lru_cache
def width_of(tokenizer: str, separator: int = SEPARATOR) -> int:
    """Bytes of an id: two where all ids of the vocabulary, and the separator, fit."""
    from tokenizers import Tokenizer

    largest = max(Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values())
    return 2 if max(largest, separator) < 1 << 16 else 4


def write_flat(documents: DataFrame, folder: str, tokenizer: str | None = None, separator: int = SEPARATOR, width: int = WIDTH) -> DataFrame:
    """Write the ids of the documents, one file per partition. Returns the stored (file, path, place, doc_id): who lies where.

    The vocabulary's own end-of-text id is the separator; special tokens are ordinary text, so no document holds it.
    """
    kind = dict(documents.dtypes)["doc_id"]
    placed = documents.select(F.spark_partition_id().alias("file"), "doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        place = 0
        with new_file(folder, f"ids-{first.column('file')[0].as_py():06d}") as (path, stream):
            for batch in encode_columns(chain([first], batches), tokenizer or default_tokenizer(), separator, spell_special=True):
                ids = batch.column("ids").values.to_numpy()
                if len(ids) and ids.max() >> (8 * width):
                    raise ValueError(f"id {ids.max()} has no place in {width} bytes")
                stream.write(ids.astype(f"<u{width}").tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array([path] * n), pa.array(np.arange(place, place + n)), batch.column("doc_id")], ["file", "path", "place", "doc_id"])
                place += n

    return stored(placed.mapInArrow(write, f"file int, path string, place long, doc_id {kind}"), "places")


def sized(files: DataFrame, width: int = WIDTH) -> DataFrame:
    """(file, path, n_ids) of ``files(file, path)``, by the size of each file."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            places = [file_system(p) for p in b["path"]]
            yield b.assign(n_ids=[system.get_file_info(path).size // width for system, path in places])

    return stored(files.select("file", "path").distinct().mapInPandas(look, "file int, path string, n_ids long"), "files")


def scan(files: DataFrame, separator: int = SEPARATOR, block_ids: int = BLOCK_IDS, width: int = WIDTH) -> DataFrame:
    """(file, place, number, start, n_tokens, ended) per document of ``files(file, path, n_ids)``.

    ``place`` counts the documents of a file, ``number`` those of all files in the order of ``file``; ``start`` is the
    ids of all files before a document; ``n_tokens`` includes the separator.
    """
    step = F.lit(block_ids)
    blocks = files.where("n_ids > 0").select("file", "path", "n_ids", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n_ids") / step) - 1)).alias("block"))
    spread = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                at, n = r.block * block_ids, min(block_ids, r.n_ids - r.block * block_ids)
                system, path = file_system(r.path)
                with system.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(width * n, width * at), f"<u{width}")
                ends = np.flatnonzero(ids == separator) + at + 1
                last = r.n_ids == at + n and (not len(ends) or ends[-1] != r.n_ids)  # a tail without separator
                yield pd.DataFrame({"file": [r.file], "block": [r.block], "ends": [np.append(ends, r.n_ids) if last else ends], "ended": [not last]})

    found = stored(blocks.repartition(spread, "file", "block").mapInPandas(search, "file int, block long, ends array<long>, ended boolean"), "ends")
    sums = found.select("file", "block", F.size("ends").cast("long").alias("n"), F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1).alias("last"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"), F.coalesce(F.max("last").over(earlier), F.lit(0)).alias("from"))
    before = running_totals(sums.groupBy("file").agg(F.sum("n").alias("n")).join(files.select("file", "n_ids"), "file"), "file", {"documents": "n", "ids": "n_ids"})
    docs = found.join(carried, ["file", "block"]).join(before, "file").select("file", "ids", "documents", "n_before", "from", "ends", "ended", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("from")).otherwise(F.element_at("ends", F.greatest(F.col("i"), F.lit(1))))
    tail = ~F.col("ended") & (F.col("i") == F.size("ends") - 1)
    place = F.col("n_before") + F.col("i")
    return docs.select("file", place.alias("place"), (F.col("documents") + place).alias("number"), (F.col("ids") + start).alias("start"), (F.col("end") - start).alias("n_tokens"), (~tail).alias("ended"))


def counted_documents(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, number, start, n_tokens) of every document, from the flat files and not from the encoder's own counts.

    ``number`` and ``start`` count the documents and their ids before it in ascending order of doc_id. A null text is
    empty; a null doc_id comes first; documents of equal doc_ids follow each other by their lengths.
    """
    width = width_of(tokenizer or default_tokenizer())
    places = write_flat(documents, new_path(documents.sparkSession, "flat-ids"), tokenizer, width=width)
    found = scan(sized(places, width), width=width)
    counted = stored(found.join(places.select("file", "place", "doc_id"), ["file", "place"]).select("doc_id", "n_tokens", "file", "place"), "counted")
    keys = ["doc_id", "n_tokens", "file", "place"]
    ordered = stored(in_order(counted, keys, "part").withColumn("one", F.lit(1)), "in-order")
    before = running_totals(ordered, "part", {"documents": "one", "ids": "n_tokens"})
    inside = Window.partitionBy("part").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = ordered.withColumns({"at": F.row_number().over(inside) - 1, "inside": F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))})
    return rows.join(before, "part").select("doc_id", (F.col("documents") + F.col("at")).alias("number"), (F.col("ids") + F.col("inside")).alias("start"), "n_tokens")
