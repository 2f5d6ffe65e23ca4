"""Block search, Merkle manifest and filter audit against brute force and SQL, with edge rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridfolio.llm import block_search, filter_audit, merkle
from gridfolio.llm.queries import CHECKS, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

# 11. block search -----------------------------------------------------------------------


def brute_nearest(rows, every, k):
    """(query_id, rank, vec_id, score) of all usable rows, every component added in turn."""
    usable = [(i, v) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    out = Counter()
    for place, (i, q) in enumerate(usable):
        if i % every:
            continue
        scored = []
        for other, (j, v) in enumerate(usable):
            if other != place and len(v) == len(q):
                total = 0.0
                for a, b in zip(q, v, strict=True):
                    total += a * b
                scored.append((-total, j))
        for rank, (score, j) in enumerate(sorted(scored)[:k], 1):
            out[i, rank, j, -score] += 1
    return out


@pytest.mark.parametrize("tiles", [1, 7])
def test_block_search_on_edge_rows(spark, monkeypatch, tiles):
    monkeypatch.setattr(block_search, "grid", lambda *a: (min(tiles, 2), tiles))
    monkeypatch.setattr(block_search, "CANDIDATE_STEP", 16)
    monkeypatch.setattr(block_search, "QUERY_STEP", 3)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=9).tolist()) for i in range(120)]
    rows += [(200 + i, rows[5][1]) for i in range(60)]  # one hot vector
    rows += [(300 + i, [x + 1e-12 * i for x in rows[7][1]]) for i in range(50)]  # copies that differ in their last digits
    rows += [(10, rows[10][1]), (10, rows[10][1]), (10, rows[11][1]), (20, [0.5] * 9)]  # repeated rows and ids
    rows += [(400, None), (401, []), (402, [0.0] * 9), (403, [float("nan")] * 9), (404, [float("inf")] + [1.0] * 8), (405, [None] + [1.0] * 8), (None, rows[3][1])]
    rows += [(410, [1.0, 2.0]), (411, [2.0, 1.0]), (420, [1.0]), (430, [1e200] * 9), (440, [-1e-300] * 9), (450, [5e-324] * 9)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, label string, rank int").repartition(3)
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in block_search.neighbours(df, every=10, k=6).collect())
    assert got == brute_nearest(rows, 10, 6)
    assert block_search.neighbours(df.limit(0)).collect() == []


def test_block_search_over_many_dimensions(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=2100).astype(np.float32).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = block_search.neighbours(df, every=20, k=5).collect()
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_nearest(rows, 20, 5)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(40, 33)) * rng.uniform(1e-3, 1e3, (40, 1)), rng.standard_cauchy(size=(50, 33))
    near, error = block_search.Coded(a).products(block_search.Coded(b), slice(None))
    assert (np.abs(a @ b.T - near) <= error).all() and (error < 0.05 * np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))).all()


def test_grid_copies_few_vectors():
    assert block_search.grid(0, 0, 0, 8) == (1, 1) and block_search.grid(10_000, 500, 64, 200) == (1, 1)
    blocks, tiles = block_search.grid(75_000_000, 3_750_000, 64, 2000)
    assert 25 <= blocks <= 40 and 1900 <= blocks * tiles <= 2100 and 3_750_000 / blocks * 64 * 8 <= block_search.QUERY_BYTES


# 12. manifest ----------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_proofs(rows, fields, tampered, arity=8):
    """Every row's (id, leaf, subroot, root, proof digest, folded root, verified), trees as nested lists."""

    def leaf(row):
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[f] for f in fields)])

    def tree(digests):
        """Root, and for every digest the (left, right) siblings from the bottom."""
        levels = [digests]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
        paths = []
        for i in range(len(digests)):
            path = []
            for level in levels[:-1]:
                at = i // arity * arity
                path.append(("".join(level[at:i]), "".join(level[i + 1 : at + arity])))
                i //= arity
            paths.append(path)
        return levels[-1][0], paths

    trees = {}
    for row in rows:
        trees.setdefault(row["lang"], []).append(row)
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    made = {}
    for name in order:
        leaves = sorted(trees[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        made[name] = (leaves, *tree([leaf(r) for r in leaves]))
    if not made:
        return Counter()
    root, above = tree([made[t][1] for t in order])
    out = Counter()
    for t, top in zip(order, above, strict=True):
        leaves, subroot, paths = made[t]
        for row, path in zip(leaves, paths, strict=True):
            path = path + top
            digest = leaf(tampered(row))
            for left, right in path:
                digest = sha(left, digest, right)
            out[row["doc_id"], leaf(row), subroot, root, sha(*[x for s in path for x in s]), digest, digest == root] += 1
    return out


def doc_rows(spec):
    rng = random.Random(5)
    rows = []
    for lang, n in spec:
        rows += [dict(doc_id=len(rows) + rng.randrange(3), text=rng.choice(["Some TEXT é", "", None, "lower only", "ÀÉ Z" * 30, f"Doc {i}"]), lang=lang, source=rng.choice([None, "", "web"]), n_chars=rng.choice([None, 3, -1])) for i in range(n)]
    return rows


@pytest.mark.parametrize(
    "spec", [[], [("en", 1)], [("en", 1), (None, 1)], [("en", 8)], [("en", 9), ("", 1), (None, 64)], [("z", 65), ("é", 3), ("Z", 17), (None, 2)], [(f"l{i}", 1 + i % 3) for i in range(70)]], ids=str
)
def test_proofs(spark, spec):
    rows = doc_rows(spec)
    rows += [dict(r) for r in rows[:2]] * 2  # repeated rows
    if len(rows) > 8:
        rows += [rows[0] | {"text": "Another text"}, rows[1] | {"doc_id": None}, rows[1] | {"doc_id": None}, rows[2] | {"text": "Y" * 100_000}]

    def tampered(row):
        changed = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0 and row["text"] is not None
        return row | {"text": re.sub("[A-Z]", lambda m: m[0].lower(), row["text"])} if changed else row

    names = "id tree tree_name lo hi n digest members path part place row other of bucket before".split()
    docs = spark.createDataFrame([(*[r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")], *["x"] * len(names)) for r in rows], DOCS + "".join(f", {n} string" for n in names))
    got = merkle.document_proofs(docs.repartition(3)).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in got) == brute_proofs(rows, merkle.FIELDS, tampered)


def test_intervals_nest(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en" if i % 5 else "de", None, i) for i in range(100)], DOCS)
    made = merkle.manifest(docs, arity=3)
    nodes = made.nodes().collect()
    below = {(n.tree, n.level, n.lo, n.hi): n for n in nodes}
    for n in nodes:
        inside = sorted((m.lo, m.hi, m.digest) for m in nodes if m.tree == n.tree and m.level == n.level - 1 and n.lo <= m.lo and m.hi <= n.hi)
        if n.level:
            assert 1 <= len(inside) <= 3 and inside[0][0] == n.lo and inside[-1][1] == n.hi and n.digest == sha(*[d for *_, d in inside])
    assert len(below) == len(nodes)
    rows = merkle.with_paths(made)
    root = rows.first()["root"]
    assert merkle.verify(spark, rows, root).where("not verified").count() == 0
    assert merkle.verify(spark, rows, sha("x")).where("verified").count() == 0


# 13. audit of filters -----------------------------------------------------------------------


def brute_audit(docs, labels):
    """All counts by running every order over every document."""
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    failed = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = {"A"} if len(words) < 100 else set()
        f |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
        f |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        f |= {"E"} if i is not None and first[text] < i else set()
        failed.append((lang or "", f, i in good and i is not None, i in toxic and i is not None))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in failed}:
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in failed if d[0] == part]
            gone = []
            for step, x in enumerate(order, 1):
                removed, kept = [d for d in left if x in d[1]], [d for d in left if x not in d[1]]
                unique = sum(d[0] == part and d[1] == {x} for d in failed)
                out[part, order, step] = [len(kept), len(removed), sum(x in d[1] for d in gone), unique, sum(d[2] for d in removed), sum(d[3] for d in removed)]
                shapley[part, x] += len(removed)
                gone, left = gone + removed, kept
    return {(p, o, s): (*c, shapley[p, o[s - 1]]) for (p, o, s), c in out.items()}


FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit(spark):
    rng = random.Random(6)
    texts = [None, "", " \t\n", "WORD " * 120, "é漢字😀 " * 150, "x" * 5000, " ".join(f"w{i}" for i in range(130)), "a|b " + " ".join(f"Q{i}" for i in range(99)), "no break #", "\x0b\x0cA\x1fB", "tail words " * 40]
    docs = [(i, rng.choice(texts), rng.choice([None, "", "en", "de"])) for i in range(150)]
    docs += [(3, "extra text", "en"), (3, "extra text", "en"), (None, "WORD " * 120, "en"), (None, None, "fr"), (900, "long and short " * 200_000, "en"), (901, " ".join(f"n{i}" for i in range(300_000)), "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    names = "part failed good toxic n id digest words first of".split()
    table = spark.createDataFrame([(*d, *["x"] * len(names)) for d in docs], "doc_id long, text string, lang string" + "".join(f", {n} string" for n in names)).repartition(4)
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, good string")
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in FIELDS) for r in filter_audit.filter_interactions(table, marks).collect()}
    assert got == brute_audit(docs, labels)
    assert filter_audit.filter_interactions(table.limit(0), marks).collect() == []
    assert filter_audit.filter_interactions(table.limit(1), marks.limit(0)).count() == 600


WORDY = st.lists(st.text(st.sampled_from("aB#é漢😀  \t\n\x0b\x1f|" + "long"), max_size=60), max_size=12)


@settings(max_examples=150, deadline=None)
@given(WORDY, st.sampled_from([7, 50, 1 << 20]), st.sampled_from([3, 9, 256]), st.booleans())
def test_counts_of_any_text(texts, block, long, wide):
    saved = filter_audit.BLOCK, filter_audit.LONG
    filter_audit.BLOCK, filter_audit.LONG = block, long
    try:
        array = pa.array(["skipped", *texts], pa.large_string() if wide else pa.string()).slice(1)
        got = filter_audit.text_counts(array)
    finally:
        filter_audit.BLOCK, filter_audit.LONG = saved
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        want = (len(words), len(set(words)), len(re.findall("[A-Z]", t)), len(t), len(re.findall(r"[#$%&*|]", t)))
        assert tuple(int(got[c][i]) for c in filter_audit.COUNTS) == want


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(filter_audit, "mix", lambda x: x & np.uint64(3))  # nearly all words collide
    words = [f"{'p' * (i % 20)}{i % 37}" for i in range(500)]
    got = filter_audit.text_counts(pa.array([" ".join(words), " ".join(words[:100])]))
    assert got["distinct_words"].tolist() == [len(set(words)), len(set(words[:100]))]


# SQL ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_block_search", "op12_merkle_intervals", "op13_filter_audit"])
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        duck.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cursor = duck.execute(CHECKS[name])
    names = [d[0] for d in cursor.description]
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(cursor.fetchall())


def test_registered_parameters(spark):
    """The production query looks for 20 neighbours of every twentieth row of the whole table."""
    got = QUERIES["op11_block_search"](spark, "/root/testdata/sf0.001")
    assert got.groupBy("query_id").agg(F.max("rank").alias("m")).where("m <> 20").count() == 0
