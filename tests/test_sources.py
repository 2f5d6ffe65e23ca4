"""Sheets in many tasks, wide panels in blocks, published cache versions, models per worker, packed charts."""

from __future__ import annotations

import csv
import datetime as dt
import io
import os
import random

import numpy as np
import pandas as pd
import pytest

from gridfolio.operators import samples as sm
from gridfolio.operators import scoring as sc
from gridfolio.sources import panels, sheets, wide
from gridfolio.sources import store
from gridfolio.sources.store import let_tasks_import

DAY = dt.date(2024, 1, 1)


# ------------------------------------------------------------------ sheets


def random_sheet(rows=400, seed=1):
    rng = random.Random(seed)
    parts = ["", "x", "a,b", 'say ""', "line\nbreak", "\n", '"', "end\r\nof it", "é漢", "1.5", ",", "many\n" * 9, '"quoted"']
    return [[rng.choice(parts) for _ in range(rng.randrange(1, 7))] for _ in range(rows)]


def written(table):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(table)
    return out.getvalue()


@pytest.mark.parametrize("size", ["97", "4k", "128m"])
def test_sheet_in_splits_of_any_size(spark, tmp_path, size):
    """Splits that begin inside quotes, between doubled quotes and inside a record of many lines."""
    table = random_sheet()
    (tmp_path / "s.csv").write_bytes(written(table).encode())
    saved = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {(r.row_no, r.col_no): r.cell for r in sheets.read_sheet(spark, str(tmp_path / "s.csv")).collect()}
    finally:
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(k) if k not in saved else spark.conf.set(k, saved[k])
    assert got == {(i, j): c for i, row in enumerate(table) for j, c in enumerate(row) if c}


def test_sheet_with_windows_lines_and_mark(spark, tmp_path):
    (tmp_path / "s.csv").write_bytes("﻿a,b\r\n\r\n,\"c\r\nd\",\r\n".encode())
    got = sorted(map(tuple, sheets.read_sheet(spark, str(tmp_path / "s.csv")).collect()))
    assert got == [(0, 0, "a"), (0, 1, "b"), (2, 1, "c\r\nd")]
    (tmp_path / "empty.csv").write_text("")
    assert sheets.read_sheet(spark, str(tmp_path / "empty.csv")).count() == 0


def test_sheet_round_trip(spark, tmp_path):
    rng = random.Random(2)
    cells = [(i, j, rng.choice(["v", "a,b", 'q"q', "two\nlines", "\r", " spaced "])) for i in range(300) for j in range(12) if rng.random() < 0.3 and i % 5]
    df = spark.createDataFrame(cells, "row_no int, col_no int, cell string").repartition(6)
    sheets.write_sheet(df, str(tmp_path / "out"))
    assert sorted(map(tuple, sheets.read_sheet(spark, str(tmp_path / "out")).collect())) == sorted(cells)
    sheets.write_sheet(df.limit(0), str(tmp_path / "none"))
    assert sheets.read_sheet(spark, str(tmp_path / "none")).count() == 0


def test_sheet_in_another_encoding(spark, tmp_path):
    (tmp_path / "s.csv").write_bytes("a,ü\nb,\n".encode("latin-1"))
    assert sorted(map(tuple, panels.read_sheet(spark, str(tmp_path / "s.csv"), "ISO-8859-1").collect())) == [(0, 0, "a"), (0, 1, "ü"), (1, 0, "b")]


# ------------------------------------------------------------------ wide panels


def test_wide_panel_of_a_thousand_tickers(spark, tmp_path):
    rng = random.Random(3)
    rows = [(DAY + dt.timedelta(days=d), f"t.{i}", rng.random()) for d in range(3) for i in range(1000) if d == 0 or (rng.random() < 0.9 and (d != 1 or i < 300))]
    df = spark.createDataFrame(rows, "date date, ticker string, value double")
    blocks = wide.write_wide(df, str(tmp_path / "w"), columns=300)
    assert [len(b) for b in blocks] == [300, 300, 300, 100] and len(wide.blocks_of(spark, str(tmp_path / "w"))) == 4
    assert sorted(map(tuple, wide.read_wide(spark, str(tmp_path / "w")).select("date", "ticker", "value").collect())) == sorted(rows)
    assert wide.read_wide(spark, str(tmp_path / "w"), keep_empty=True).count() == 3000
    frame = pd.read_parquet(tmp_path / "w" / "columns=0002")  # as another tool reads it: all dates, one column per ticker
    assert len(frame) == 3 and len(frame.columns) == 301
    some = wide.read_columns(spark, str(tmp_path / "w"), ["t.999", "t.0"])
    values = {(d, t): v for d, t, v in rows}
    assert {(r.Date, t): r[t] for r in some.collect() for t in ("t.0", "t.999") if r[t] is not None} == {k: v for k, v in values.items() if k[1] in ("t.0", "t.999")}
    with pytest.raises(KeyError, match="nobody"):
        wide.read_columns(spark, str(tmp_path / "w"), ["t.1", "nobody"])
    with pytest.raises(ValueError, match="ticker"):
        wide.write_wide(df.limit(0), str(tmp_path / "x"))


def test_wide_panel_of_many_blocks_takes_few_jobs(spark, tmp_path):
    """The number of jobs does not grow with the number of blocks; a block of its own width, repeated cells and empty dates stay."""
    rows = [(DAY + dt.timedelta(days=d), f"a b/{i:03d}", float(i * 10 + d)) for d in range(3) for i in range(101) if (i + d) % 5]
    rows += [(DAY, "a b/001", 99.0), (DAY + dt.timedelta(days=9), "a b/000", None), (DAY, None, 1.0)]
    df = spark.createDataFrame(rows, "date date, ticker string, value double")
    spark.sparkContext.setJobGroup("wide", "wide")
    blocks = wide.write_wide(df, str(tmp_path / "w"), columns=2)
    got = wide.read_wide(spark, str(tmp_path / "w")).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("wide"))
    spark.sparkContext.setJobGroup("", "")
    best = {}
    for d, t, v in rows:
        if t is not None and v is not None:
            best[d, t] = max(v, best.get((d, t), v))
    assert {(r.date, r.ticker): r.value for r in got} == best and len(got) == len(best)
    assert len(blocks) == 51 and len(blocks[-1]) == 1 and jobs < 25
    last = pd.read_parquet(tmp_path / "w" / "columns=0050")
    assert list(last.columns) == ["Date", "a b/100"] and len(last) == 4


# ------------------------------------------------------------------ cache


def test_cache_follows_its_sources(spark, tmp_path):
    source = tmp_path / "source"
    spark.range(3).write.parquet(str(source))
    cache, built = panels.SampleCache(spark, "follow"), []
    make = lambda: built.append(1) or spark.read.parquet(str(source))
    files = [str(source)]
    assert cache.get({"p": 1}, make, files).count() == 3 and cache.get({"p": 1}, make, files).count() == 3 and len(built) == 1
    spark.range(5).write.mode("append").parquet(str(source))
    assert not cache.holds({"p": 1}, files)
    assert cache.get({"p": 1}, make, files).count() == 8 and len(built) == 2


def test_cache_versions_are_published_last(spark):
    cache, params = panels.SampleCache(spark, "versions"), {"v": 1}
    cache.save(spark.range(1), params)
    old = cache.load(params)
    cache.save(spark.range(2), params)
    assert old.count() == 1 and cache.load(params).count() == 2  # who reads the old one goes on
    folder = cache.path(params)
    where, system = cache._fs(f"{folder}/manifest-000000009")  # a writer that was lost before it finished its manifest
    system.create(where, False).close()
    assert cache.load(params).count() == 2
    cache.save(spark.range(3), params)
    assert cache.load(params).count() == 3 and cache.prune(params) == 2 and cache.load(params).count() == 3
    with pytest.raises(KeyError):
        cache.load({"v": 2})


def test_stored_tables_are_released(spark, monkeypatch):
    monkeypatch.setattr(store, "_WRITTEN", {})
    kept = store.stored(spark.range(3), "release")
    folder = store._WRITTEN[spark.sparkContext.applicationId][0]
    assert kept.count() == 3 and os.path.isdir(folder)
    assert store.release(spark) == 1 and not os.path.exists(folder) and store.release(spark) == 0


# ------------------------------------------------------------------ models


def test_models_are_loaded_once_per_worker(spark, tmp_path):
    let_tasks_import(spark)
    marks = str(tmp_path)

    def factory():
        import uuid as names

        open(f"{marks}/{os.getpid()}-{names.uuid4().hex}", "w").close()

        def member(k):
            return lambda x: pd.DataFrame({"prob_up": [float(np.mean([s[0] for s in w])) / k for w in x], "prob_down": 0.0, "prediction": 1})

        return {f"m{k}": member(k) for k in (1, 2, 4)}

    rows = [(DAY, f"t{i}", [[float(i)], [float(i + 1)]]) for i in range(400)]
    df = spark.createDataFrame(rows, "date date, ticker string, x array<array<double>>").repartition(16)
    schema = "prob_up double, prob_down double, prediction int"
    scored = sm.score_with_models(df, factory, schema)
    table = scored.toPandas()
    loads = os.listdir(tmp_path)
    assert len(loads) == len({f.split("-")[0] for f in loads}) <= 4 and len(table) == 1200
    for m, k in (("m1", 1), ("m2", 2), ("m4", 4)):
        alone = sm.score_windows(df, lambda x, k=k: pd.DataFrame({"prob_up": [float(np.mean([s[0] for s in w])) / k for w in x]}), "prob_up double").toPandas()
        both = alone.merge(table[table.model == m], on=["date", "ticker"])
        assert len(both) == 400 and np.allclose(both.prob_up_x, both.prob_up_y)
    mean = table.groupby("ticker").prob_up.mean()
    got = {r.ticker: r.prob_up for r in sc.ensemble_cells(scored, 3).collect()}
    assert got.keys() == set(mean.index) and all(np.isclose(got[t], mean[t]) for t in got)


# ------------------------------------------------------------------ packed charts


@pytest.mark.parametrize(("width", "height"), [(1, 1), (8, 4), (15, 32), (33, 7), (180, 96)])
def test_packed_charts_hold_every_pixel(spark, width, height):
    rng = random.Random(width)
    points = {(w, rng.randrange(width), rng.randrange(height)) for w in range(5) for _ in range(rng.choice([1, 7, width * height // 3 + 1]))}
    df = spark.createDataFrame([*points, *list(points)[:3], (0, -1, 0), (1, 0, height), (2, width, 0)], "w int, px int, py int")
    packed = sm.packed_charts(df, ["w"], width, height)
    row = (width + 7) // 8
    for r in packed.collect():
        bits = np.unpackbits(np.frombuffer(bytes(r.raster), np.uint8).reshape(height, row), axis=1)[:, :width]
        assert len(r.raster) == row * height and {(r.w, x, y) for y, x in np.argwhere(bits)} == {p for p in points if p[0] == r.w}
    assert {tuple(x) for x in sm.unpacked_charts(packed, ["w"], width, height).collect()} == points
