"""Pieces cut and looked up as arrays: ids of whole texts as the library gives them, forgetting, metadata pruning."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridfolio.llm import piece_table, separator_scan, token_orc
from gridfolio.llm.common import new_path

PATH = token_orc.default_tokenizer()
ODD = ["a", "B", "'s", "'ll", "'", "''", '"', " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x00", "\u0085", " ", " ", " ", " ", " ", " ", " ", "　", "​", "é", "漢", "😀", "ß", "²", "́", "1", "23", ".", ",", "!?", "…", "“", "_", "-", "don't", "<|", "<|endoftext|>", "word" * 30]


def library(texts):
    return [e.ids + [2] for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def ours(texts, kind=None):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, kind or pa.string())], ["doc_id", "text"])
    return [ids for part in token_orc.encode_columns(iter([batch.slice(1)]), PATH, 2) for ids in part.column("ids").to_pylist()]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_odd_texts(kind):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(14))) for _ in range(20_000)]
    plain = [t.replace("<|endoftext|>", "") for t in texts]
    assert ours(["skipped", *plain], kind) == library(plain)
    assert ours(["skipped", *texts], kind) == library(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_any_texts(texts):
    assert ours(["", *texts]) == library(texts)


def test_nulls_and_long_pieces():
    texts = [None, "", "x" * 5000, "y" * 64 + "." * 200, "z" * 65 + " end", "é" * 100]
    assert ours([None, *texts]) == library([t or "" for t in texts])


def test_blocks_and_forgetting(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(400)}," for _ in range(rng.randrange(60))) for _ in range(300)]
    want = library(texts)
    monkeypatch.setattr(token_orc, "BLOCK", 500)
    table = token_orc.piece_table(PATH, 2)[0]
    table.clear()
    monkeypatch.setattr(table, "remembered", 50)
    assert ours(["", *texts]) == want and table.n < 800


def test_pieces_of_one_key_are_told_apart(monkeypatch):
    monkeypatch.setattr(piece_table, "mix", lambda x: x & np.uint64(7))
    table = token_orc.piece_table(PATH, 2)[0]
    table.clear()
    texts = [f"word{i} {'long' * 4}{i % 9} x{i % 3}" for i in range(60)]
    try:
        assert ours(["", *texts]) == library(texts)
    finally:
        table.clear()


def test_lookups_reach_the_files(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "x") for i in range(2000)], "doc_id long, text string, ids string")
    folder = new_path(spark, "orc-lookup")
    token_orc.write_orc(docs, folder)
    some = token_orc.read_orc(spark, folder, ids=[7, 1999, 5000])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id, [" in plan and sorted(r.doc_id for r in some.collect()) == [7, 1999]
    part = token_orc.read_orc(spark, folder, between=(10, 12))
    assert "GreaterThanOrEqual(doc_id,10)" in part._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(list, (r.ids for r in part.collect()))) == sorted(library([f"text {i}" for i in (10, 11, 12)]))
    assert token_orc.read_orc(spark, folder).count() == 2000


def test_flat_files_in_order_of_ids(spark):
    """Numbers and starts follow doc_id, whatever the partitions, and names of special tokens are no separators."""
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(ODD) for _ in range(rng.randrange(12)))) for i in rng.sample(range(1000), 300)] + [(None, "no id"), (5000, None), (5000, "same id, longer"), (5000, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, part string")
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    sizes = sorted(((i is not None, i or 0, len(plain.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows))
    starts = np.cumsum([0, *(n for *_, n in sizes)])
    want = [(i if known else None, k, int(starts[k]), n) for k, (known, i, n) in enumerate(sizes)]
    for parts in (1, 5):
        got = separator_scan.counted_documents(docs.repartition(parts)).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_ids_without_a_place_are_an_error(spark):
    assert separator_scan.width_of(PATH) == 2 and separator_scan.width_of(PATH, 70_000) == 4
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(Exception, match="no place"):
        separator_scan.write_flat(docs, new_path(spark, "narrow"), separator=70_000).collect()
    places = separator_scan.write_flat(docs, new_path(spark, "wide-ids"), separator=70_000, width=4)
    assert separator_scan.scan(separator_scan.sized(places, 4), 70_000, width=4).first().n_tokens == 2
