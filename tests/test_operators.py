"""Edge fixtures and brute-force comparisons."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridfolio.functions import features as feat
from gridfolio.functions.ewm import with_ewm
from gridfolio.operators import alignment as al
from gridfolio.operators import cleaning as cl
from gridfolio.operators import evaluation as ev
from gridfolio.operators import portfolio as pf
from gridfolio.operators import reports as rp
from gridfolio.operators import samples as sm
from gridfolio.operators import scoring as sc
from gridfolio.operators.calendar import calendar_of, dense_grid, per_day, rebalance_windows
from gridfolio.operators.panels import zscore_on_years
from gridfolio.operators.ranking import in_ranges, ordered_rank
from gridfolio.sources import panels, tables
from gridfolio.sources.store import shared_dir

DAY = dt.date(2024, 1, 1)


def days(n):
    return [DAY + dt.timedelta(days=i) for i in range(n)]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ------------------------------------------------------------------ grid and rolling frames


def test_dense_grid_has_every_cell(spark):
    d = days(6)
    facts = frame(spark, [("a", d[1], 1.0), ("a", d[4], 2.0), ("b", d[0], 3.0), ("b", d[5], 4.0), ("b", d[2], None)], "ticker string, date date, v double")
    cal = calendar_of(frame(spark, [(x,) for x in d], "date date"))
    got = {(r.ticker, r.pos): r.v for r in dense_grid(facts, cal, ["v"]).collect()}
    assert len(got) == 12
    assert {k: v for k, v in got.items() if v is not None} == {("a", 2): 1.0, ("a", 5): 2.0, ("b", 1): 3.0, ("b", 6): 4.0}


def test_per_day_refuses_other_keys(spark):
    with pytest.raises(TypeError):
        per_day(frame(spark, [("a",)], "k string"), "k")


def test_ewm_gap_fixture(spark):
    values = [None, 1.0, 2.0, None, None, 5.0, 4.0]
    df = frame(spark, [("t", i, v) for i, v in enumerate(values)], "ticker string, pos int, v double")
    got = [r.e for r in with_ewm(df, "v", 3, "e").orderBy("pos").collect()]
    want = [None, 1.0, 1.5, 1.5, 1.5, 4.3, 4.15]
    assert got[0] is None and np.allclose(got[1:], want[1:])


@pytest.mark.parametrize("span", [1, 2, 9, 26, 200])
def test_ewm_long_history_matches_pandas(spark, span):
    rng = random.Random(span)
    rows = []
    for t, n in (("a", 3000), ("b", 1500)):
        for i in range(n):
            gap = t == "b" and 200 < i < 900
            rows.append((t, i, None if gap or rng.random() < 0.1 else rng.uniform(1, 1000)))
    df = frame(spark, rows, "ticker string, pos int, v double")
    got = with_ewm(df, "v", span, "e").orderBy("ticker", "pos").toPandas()
    want = pd.DataFrame(rows, columns=["ticker", "pos", "v"]).groupby("ticker").v.transform(
        lambda s: s.ewm(span=span, adjust=False, min_periods=1).mean()
    )
    assert np.allclose(got.e.to_numpy(dtype=float), want.to_numpy(), rtol=1e-9, equal_nan=True)


def test_feature_specs(spark):
    spec = {"name": "magap", "window": 5}
    assert feat.resolve(spec) == ("magap", {"window": 5}) and feat.resolve(spec)[1] == {"window": 5}
    with pytest.raises(KeyError):
        feat.resolve("nothing")


def test_constant_series(spark):
    rows = [("t", i, 5.0, 5.0, 5.0, 5.0, 0.0) for i in range(10)]
    df = frame(spark, rows, "ticker string, pos int, open double, high double, low double, close double, volume double")
    last = lambda name, **kw: feat.REGISTRY[name](df, out="x", **kw).orderBy(F.desc("pos")).first().x
    assert last("bb") is None and last("volumez") is None and last("rsi") is None
    assert last("stoch") == -0.5 and last("ulcer") == 0.0 and last("logreturn") == 0.0


# ------------------------------------------------------------------ ranks and groups


def test_ordered_rank_is_exact(spark):
    rng = random.Random(1)
    rows = [("hot", float(rng.choice([0.0, 0.0, 0.0, 1.5, rng.random()])), f"t{i:05d}") for i in range(5000)]
    rows += [("cold", rng.random(), f"t{i}") for i in range(7)]
    df = frame(spark, rows, "g string, s double, ticker string")
    got = {(r.g, r.ticker): (r["rank"], r.n) for r in ordered_rank(df, ["g"], "s").collect()}
    for g in ("hot", "cold"):
        part = sorted((s, t) for h, s, t in rows if h == g)
        assert [got[g, t] for _, t in part] == [(i + 1, len(part)) for i in range(len(part))]


def test_large_groups_and_ties_are_cut_into_even_ranges(spark):
    """One group, 50 orders repeated 400 times, as the row order of a panel."""
    df = spark.range(20_000).selectExpr("1 as g", "cast(id % 50 as int) as date", "format_string('t%05d', id div 50) as ticker")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in in_ranges(df, ["g"], "date", "ticker").groupBy("range_no").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(sizes) == 4 and max(sizes) <= 3 * 20_000 / len(sizes)
    ranks = ordered_rank(df, [], "date", "ticker").orderBy("date", "ticker").collect()
    assert [r["rank"] for r in ranks] == list(range(1, 20_001)) and {r.n for r in ranks} == {20_000}


def test_null_groups_are_ranked(spark):
    df = frame(spark, [(None, 2.0, "b"), (None, 1.0, "a"), ("x", 1.0, "a")], "g string, s double, ticker string")
    assert sorted((r.g or "", r["rank"], r.n) for r in ordered_rank(df, ["g"], "s").collect()) == [("", 1, 2), ("", 2, 2), ("x", 1, 1)]


def test_zero_close_gives_no_window_and_no_error(spark):
    rows = [("t", i, 0.0 if i == 3 else float(i + 1)) for i in range(8)]
    df = frame(spark, rows, "ticker string, pos int, close double").select("*", sm.forward_return(1).alias("ret"), sm.forward_drawdown(2).alias("fall"))
    got = {r.pos: (r.ret, r.fall) for r in df.collect()}
    assert got[3][0] is None and got[2] == (-1.0, pytest.approx(1.0))


def test_moments_of_all_years(spark):
    rows = [("t", f"{y}-01-01", float(y)) for y in (1980, 2000, 2020)]
    df = frame(spark, rows, "ticker string, date string, v double").withColumn("date", F.to_date("date"))
    assert [round(r.z, 4) for r in zscore_on_years(df, "v", None, "z").orderBy("date").collect()] == [-1.2247, 0.0, 1.2247]


def test_yearly_bars(spark):
    whole, months = (tables.bars(spark, "/root/testdata/sf0.001", f) for f in ("Y", "M"))
    assert whole.agg(F.sum("volume")).first() == months.agg(F.sum("volume")).first()


@pytest.mark.parametrize("q", [1, 2, 3, 5, 6, 7, 9, 10, 12, 19])
def test_quantile_edges(spark, q):
    sizes = [n for n in (q, q + 1, 2 * q + 3, 60, 113) if n >= q]
    rows = [(n, r) for n in sizes for r in range(1, n + 1)]
    df = frame(spark, rows, "n int, r int").select("n", "r", pf.quantile_bucket(F.col("r"), F.col("n"), q).alias("b"))
    for row in df.collect():
        edges = np.linspace(0, 1, q + 1)[1:-1]
        assert row.b == int(np.digitize([row.r / row.n], edges, right=True)[0])


def cands(spark, scores, **prices):
    rows = [("all", 1, t, s, 1.0, prices.get(t, (10.0, 10.0))[0], prices.get(t, (10.0, 10.0))[1]) for t, s in scores.items()]
    return frame(spark, rows, "run string, window_id int, ticker string, score double, cap double, entry double, exit double")


def test_ties_go_by_ticker_and_small_sets_are_skipped(spark):
    rules = pf.Rules(quantiles=3, min_assets=3)
    got = {r.ticker: r.group_id for r in pf.allocate(cands(spark, {c: 1.0 for c in "dbacfe"}), rules).collect()}
    assert got == {"a": "q1", "b": "q1", "c": "q2", "d": "q2", "e": "q3", "f": "q3"}
    assert pf.allocate(cands(spark, {"a": 1.0, "b": 2.0}), rules).count() == 0
    assert pf.allocate(cands(spark, {"a": None, "b": None}), rules).count() == 0


def test_price_classes(spark):
    prices = {
        "ok": (10.0, 12.0), "noentry": (None, 5.0), "zeroentry": (0.0, 5.0), "noexit": (10.0, None),
        "zeroexit": (10.0, 0.0), "wild": (1.0, 20.5), "crash": (100.0, 4.0), "edge": (1.0, 20.0),
    }
    df = cands(spark, {k: float(i) for i, k in enumerate(prices)}, **prices)
    got = {r.ticker: (r.kept, r.halted, r.x) for r in pf.classify_prices(df).collect()}
    assert got["ok"] == (True, False, 1.2) and got["noentry"][:2] == (False, False) and got["zeroentry"][:2] == (False, False)
    assert got["noexit"] == (True, True, 1.0) and got["zeroexit"] == (True, True, 1.0)
    assert got["wild"][:2] == (False, True) and got["crash"][:2] == (False, True) and got["edge"][:2] == (True, False)


def test_cap_weights_fall_back_to_equal(spark):
    rules = pf.Rules(quantiles=1, min_assets=2, weighting="cap")
    rows = [("all", w, t, "q1", s, c, 10.0, 10.0) for w, t, s, c in
            [(1, "a", 1.0, 1.0), (1, "b", 2.0, 3.0), (2, "a", 1.0, None), (2, "b", 2.0, 3.0), (3, "a", 1.0, -5.0), (3, "b", 2.0, 2.0), (4, "a", 1.0, -1.0), (4, "b", 1.0, 0.0)]]
    df = frame(spark, rows, "run string, window_id int, ticker string, group_id string, score double, cap double, entry double, exit double")
    got = {(r.window_id, r.ticker): r.share for r in pf.hold(pf.classify_prices(df), rules).collect()}
    assert got == {(1, "a"): 0.25, (1, "b"): 0.75, (2, "a"): 0.5, (2, "b"): 0.5, (3, "a"): 0.0, (3, "b"): 1.0, (4, "a"): 0.5, (4, "b"): 0.5}


def test_rules_are_checked():
    for bad in ({"quantiles": 0}, {"min_assets": 2}, {"top_n": 3}, {"enabled": (7,)}, {"capital": 0.0}, {"weighting": "x"},
                {"top_n": 0, "bottom_n": 1}, {"sector_unit": True}, {"min_score": float("nan")}):
        with pytest.raises(ValueError):
            pf.Rules(**bad)
    with pytest.raises(ValueError):
        pf.Costs(buy_bps=-1)


# ------------------------------------------------------------------ capital


def growth_table(spark, factors):
    rows = [("all", w, g, f, 1, 0) for g, fs in factors.items() for w, f in enumerate(fs, 1)]
    return frame(spark, rows, "run string, window_id int, group_id string, factor double, n_positions int, n_halted int")


def walk(factors, longs, shorts, capital):
    """Window by window: half of the total to each side, pro rata inside, equal after a wipe-out."""
    cash = {g: capital / 2 / len(side) for side in (longs, shorts) for g in side}
    out = []
    for w in range(len(next(iter(factors.values())))):
        total = sum(cash.values())
        if total > 0:
            for side in (longs, shorts):
                held = sum(cash[g] for g in side)
                for g in side:
                    cash[g] = total / 2 * (cash[g] / held if held > 0 else 1 / len(side))
        for g in cash:
            out.append((w + 1, g, cash[g], cash[g] * factors[g][w]))
            cash[g] *= factors[g][w]
    return {(w, g): (i, o) for w, g, i, o in out}


@pytest.mark.parametrize("seed", range(4))
def test_dollar_neutral_matches_a_walk(spark, seed):
    rng = random.Random(seed)
    many = seed % 2 == 0
    ids = ["q1", "q2", "q4", "q5"] if many else ["q1", "q5"]
    factors = {g: [rng.choice([0.0, rng.uniform(0.5, 1.6), rng.uniform(0.5, 1.6)]) for _ in range(12)] for g in ids}
    if seed == 2:
        factors["q1"][3] = factors["q2"][3] = 0.0
    shorts = (0, 1) if many else (0,)
    rules = pf.Rules(enabled=tuple(int(g[1]) - 1 for g in ids), short_quantiles=shorts, dollar_neutral=True)
    got = {(r.window_id, r.group_id): (r.capital_in, r.capital_out) for r in pf.compound(growth_table(spark, factors), rules).collect()}
    side = [f"q{s + 1}" for s in shorts]
    want = walk(factors, [g for g in ids if g not in side], side, rules.capital)
    assert got.keys() == want.keys()
    for k in want:
        assert np.allclose(got[k], want[k], rtol=1e-9, atol=1e-9), k


def test_short_floor_and_carry_forward(spark):
    d = days(4)
    prices = {"s": [10.0, 25.0, 12.0, 9.0], "l": [10.0, 11.0, 12.0, 13.0]}
    cal = calendar_of(frame(spark, [(x,) for x in d], "date date"))
    panel = frame(spark, [(t, i + 1, d[i], p, p, 1.0 if t == "s" else 2.0, 1.0) for t, ps in prices.items() for i, p in enumerate(ps)],
                  "ticker string, pos int, date date, open double, close double, score double, cap double")
    windows = frame(spark, [(1, d[0], d[0], d[2], 1, 3), (2, d[2], d[2], d[3], 3, 4)],
                    "window_id int, signal_date date, entry_date date, exit_date date, entry_pos int, exit_pos int")
    bt = pf.Evaluation(panel, cal, windows, {"all": "score"}, pf.Rules(quantiles=2, min_assets=2, capital=100.0))
    trades = {(r.group_id, r.window_id): (r.capital_in, r.capital_out) for r in bt.trades.collect()}
    assert trades["q1", 1] == (100.0, 0.0) and trades["q1", 2] == (0.0, 0.0)
    assert trades["q2", 1][1] == pytest.approx(120.0) and trades["q2", 2][1] == pytest.approx(130.0)
    curve = {r.pos: r.equity for r in bt.equity.where("group_id = 'q1'").collect()}
    assert curve == {1: 100.0, 2: 0.0, 3: 0.0, 4: 0.0}
    net = {r.pos: r.equity for r in bt.equity.where("group_id = 'net'").collect()}
    assert net[1] == 200.0 and net[4] == pytest.approx(130.0)


def test_windows_with_lag(spark):
    cal = calendar_of(frame(spark, [(DAY + dt.timedelta(days=7 * i),) for i in range(12)], "date date"))
    rows = rebalance_windows(cal, "M", 1).orderBy("window_id").collect()
    assert all(r.signal_date < r.entry_date < r.exit_date for r in rows) and len(rows) == 2


# ------------------------------------------------------------------ alignment


def test_score_dates_off_the_calendar_are_lost(spark):
    d = days(5)
    cal = calendar_of(frame(spark, [(d[i],) for i in (1, 2, 4)], "date date"))
    scores = frame(spark, [("a", d[0], 1.0), ("a", d[2], 2.0), ("b", d[3], 9.0), ("b", d[4], 3.0)], "ticker string, date date, score double")
    prices = frame(spark, [("a",), ("b",)], "ticker string")
    got = {(r.ticker, r.date): r.score for r in al.align_scores(scores, cal, prices).collect()}
    assert got == {("a", d[2]): 2.0, ("a", d[4]): 2.0, ("b", d[2]): None, ("b", d[4]): 3.0}


def test_fresh_bars(spark):
    d = days(9)
    rows = [("one", x) for x in d[:8]] + [("two", x) for x in d[:7]] + [("few", x) for x in d[6:]] + [("now", x) for x in d]
    valid = frame(spark, rows, "ticker string, date date")
    got = {r.ticker: r.age for r in al.fresh_bars(valid, str(d[8]), 1, 5).collect()}
    assert got == {"one": 1, "now": 0}


def test_sector_panel_that_starts_late(spark):
    d = days(4)
    panel = frame(spark, [(d[2], "a", "x"), (d[2], "b", None)], "date date, ticker string, sector string")
    windows = frame(spark, [(1, d[0]), (2, d[3])], "window_id int, entry_date date")
    got = [tuple(r) for r in pf.sector_rows(panel, windows, "entry_date").orderBy("ticker").collect()]
    assert got == [(2, "a", "x"), (2, "b", None)]


# ------------------------------------------------------------------ samples, scoring, reports, sources


def test_forward_drawdown(spark):
    closes = [10.0, 12.0, 6.0, 9.0, 3.0]
    df = frame(spark, [("t", i, c) for i, c in enumerate(closes)], "ticker string, pos int, close double")
    got = df.withColumn("dd", sm.forward_drawdown(3)).orderBy("pos").first().dd
    assert got == pytest.approx((1.2 - 0.6) / (1.2 + 1e-8))


def test_duplicate_result_cells_are_an_error(spark):
    rows = frame(spark, [(DAY, "a", 0.1), (DAY, "a", 0.2)], "date date, ticker string, prob_up double")
    with pytest.raises(Exception, match="duplicate"):
        sc.score_panel(rows, "prob_up").collect()


def test_zero_precision_gives_equal_weights(spark):
    rows = frame(spark, [("m", DAY, 1, 0), ("n", DAY, 1, 1)], "model string, date date, label int, prediction int")
    assert {r.model: r.weight for r in sc.precision_weights(rows, 2024).collect()} == {"m": 0.5, "n": 0.5}


def test_histogram_matches_numpy(spark):
    rng = random.Random(3)
    values = [rng.gauss(0, 1) for _ in range(230)]
    df = frame(spark, [("r", "g", v) for v in values], "run string, group_id string, v double")
    got = {r.bin: r.n for r in rp.histogram(df, "v").collect()}
    want, _ = np.histogram(values, bins=int(np.clip(len(values) / 10, 15, 40)))
    assert [got.get(i, 0) for i in range(len(want))] == list(want)
    flat = frame(spark, [("r", "g", 1.0)] * 4, "run string, group_id string, v double")
    assert sum(r.n for r in rp.histogram(flat, "v").collect()) == 4


def test_stability_matches_sets(spark):
    rng = random.Random(5)
    sets = {d: {t for t in "abcdefgh" if rng.random() < 0.5} for d in days(8)}
    sets = {d: s for d, s in sets.items() if s}
    rows = [("long", "x", d, t) for d, s in sets.items() for t in s]
    got = rp.stability(frame(spark, rows, "leg string, sector string, entry_date date, ticker string")).first().jaccard
    order = sorted(sets)
    want = np.mean([len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in zip(order, order[1:])])
    assert got == pytest.approx(want)


def test_empty_denominators_in_statistics(spark):
    curve = frame(spark, [("r", "g", d, 0.0) for d in days(3)], "run string, group_id string, date date, equity double")
    periods = frame(spark, [("r", "g", 0.0)], "run string, group_id string, period_return double")
    row = rp.statistics(curve, periods, "M").first()
    assert [row[s] for s in rp.STATS] == [0.0] * len(rp.STATS)


def test_cache_key_holds_every_parameter():
    a = {"lookback": 5, "features": ["x"], "stride": 1}
    assert panels.parameter_key(a) == panels.parameter_key(dict(reversed(a.items())))
    assert panels.parameter_key(a) != panels.parameter_key({**a, "stride": 2})


def test_recode_keeps_unknown_labels(spark):
    df = frame(spark, [(" 정상 ",), ("거래정지",), (" x",), (None,)], "value string")
    assert [r.value for r in cl.status_flags()(df).collect()] == ["1", "0", "x", None]


def test_shared_folder_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir").rstrip("/")


# ------------------------------------------------------------------ readers and checks


def test_sheet_reader(spark, tmp_path):
    (tmp_path / "sheet.csv").write_text('top,,x\n"two\nlines",1,\n,,"a,b"\n')
    got = sorted(map(tuple, panels.read_sheet(spark, str(tmp_path / "sheet.csv")).collect()))
    assert got == [(0, 0, "top"), (0, 2, "x"), (1, 0, "two\nlines"), (1, 1, "1"), (2, 2, "a,b")]


def test_ticker_lists(spark, tmp_path):
    (tmp_path / "array.json").write_text('[\n "A", "B",\n "C"]')
    assert sorted(r.ticker for r in panels.read_tickers(spark, str(tmp_path / "array.json")).collect()) == ["A", "B", "C"]
    panels.write_tickers(frame(spark, [("A",), ("B",)], "ticker string"), str(tmp_path / "lines"))
    assert sorted(r.ticker for r in panels.read_tickers(spark, str(tmp_path / "lines")).collect()) == ["A", "B"]


def test_datasets_list_files_and_folders(spark, tmp_path):
    frame(spark, [(1,)], "a int").write.parquet(str(tmp_path / "written.parquet"))
    pd.DataFrame({"a": [1]}).to_parquet(tmp_path / "single.parquet")
    sets = panels.Datasets(spark, str(tmp_path))
    assert [r.name for r in sets.available().collect()] == ["single", "written"] and sets.load("written").count() == 1


def test_sample_cache_is_hit(spark):
    cache, built = panels.SampleCache(spark, "cache-test"), []
    make = lambda: built.append(1) or frame(spark, [(1,)], "a int")
    assert cache.get({"p": 1}, make).count() == cache.get({"p": 1}, make).count() == 1 and built == [1]
    cache.get({"p": 2}, make)
    assert built == [1, 1]


def test_inputs_that_cannot_be_evaluated(spark):
    prices = frame(spark, [(DAY, "A", 1.0)], "date date, ticker string, close double")
    scores = frame(spark, [(DAY, "B", 1.0)], "date date, ticker string, score double")
    calendar = calendar_of(prices)
    with pytest.raises(ValueError, match="both scores and prices"):
        al.align_scores(scores, calendar, prices)
    with pytest.raises(ValueError, match="two dates"):
        al.align_scores(scores.withColumn("ticker", F.lit("A")), calendar, prices)
    with pytest.raises(ValueError, match="never|ever a member"):
        al.membership_mask(frame(spark, [(DAY, "A", 0.0)], "date date, ticker string, member double"), calendar)
    with pytest.raises(TypeError, match="rows per"):
        per_day(frame(spark, [(1, "a")], "window_id int, run string"), "window_id")


# ------------------------------------------------------------------ evaluations of own panels


def own_data(spark, n_days=90, n_tickers=6, **more):
    rng = random.Random(7)
    rows = [(d, f"t{i}", 10.0 + rng.random()) for d in days(n_days) for i in range(n_tickers)]
    close = frame(spark, rows, "date date, ticker string, value double")
    scores = {m: frame(spark, [(d, t, rng.random()) for d, t, _ in rows], "date date, ticker string, score double") for m in ("x", "y")}
    return ev.build_panel(scores, close, **more)


def test_sweep_logs_failures_and_selects_groups(spark):
    done = ev.sweep(own_data(spark), {"two": {"quantiles": 2, "min_assets": 4}, "bad": {"quantiles": 0}, "none": {"freq": "Y"}, "odd": {"nonsense": 1}, "three": {"quantiles": 3, "min_assets": 3, "long_short": "off"}})
    assert sorted(done.failed) == ["bad", "none", "odd"] and "quantile" in done.failed["bad"] and "window" in done.failed["none"]
    assert done.runs() == ["two:x", "two:y", "three:x", "three:y"]
    got = done.table("equity", {"two:x": ["q2", "net"], "three:y": ["q3"]}).select("run", "group_id").distinct().collect()
    assert sorted(map(tuple, got)) == [("three:y", "q3"), ("two:x", "net"), ("two:x", "q2")]
    with pytest.raises(ValueError, match="unknown groups"):
        done.table("equity", {"two:x": ["q9"]})
    with pytest.raises(ValueError, match="unknown run"):
        done.table("equity", {"four:x": ["q1"]})


def test_panel_is_cut_and_masked(spark):
    members = frame(spark, [(DAY + dt.timedelta(days=9), f"t{i}", float(i < 3)) for i in range(6)], "date date, ticker string, member double")
    data = own_data(spark, universe=members, first="2024-01-10", last="2024-02-20", symbol="t2")
    with pytest.raises(ValueError, match="member"):
        own_data(spark, universe=members.withColumn("member", F.lit(0.0)))
    with pytest.raises(ValueError, match="two dates"):
        own_data(spark, first="2024-03-29", last="2024-03-29")
    assert data.calendar.count() == 42 and {r.ticker for r in data.panel.select("ticker").distinct().collect()} == {"t0", "t1"}
