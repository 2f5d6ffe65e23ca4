"""One id with several texts: links inside hot buckets, and what the pipeline's stage keeps."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from gridfolio.llm import dart_minhash
from gridfolio.llm.common import new_path


def text_of(rng, n=40):
    return " ".join(f"word{rng.randrange(500)}" for _ in range(n))


def test_all_texts_of_an_id_are_compared_in_a_bucket(spark):
    rng = random.Random(1)
    a, b = text_of(rng), text_of(rng)
    places = spark.createDataFrame([(1, 5), (1, 6), (1, 7)], "bucket long, id long")
    texts = spark.createDataFrame([(5, a), (5, b), (6, b), (7, text_of(rng))], "id long, text string")
    got = {tuple(sorted(r)) for r in dart_minhash.across(places, texts, 0.8).collect()}
    assert (5, 6) in got and not {x for x in got if 7 in x}


def test_unrelated_texts_of_one_id_stay(spark):
    rng = random.Random(2)
    a, b, c = text_of(rng, 90), text_of(rng, 90), text_of(rng, 90)
    near = b.replace(b.split()[40], "changed", 1)
    rows = [(5, a), (5, b), (3, near), (9, c), (9, c), (9, None), (9, None), (None, a), (None, a), (12, "")]
    docs = spark.createDataFrame([(i, t, "en", None, None, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, gone string")
    path = new_path(spark, "repeated")
    docs.repartition(3).write.parquet(path)
    kept = corpus_pipeline.near_copies(spark, spark.read.parquet(path), "")
    assert kept.columns == docs.columns
    want = [(5, a), (3, near), (9, c), (9, None), (9, None), (None, a), (None, a), (12, "")]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(want)
