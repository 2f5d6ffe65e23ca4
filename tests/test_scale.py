"""Many option sets, long histories, many dates and user strategies against the plain form of each."""

from __future__ import annotations

import datetime as dt
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridfolio.functions import features as feat
from gridfolio.functions.ewm import with_ewm
from gridfolio.operators import alignment as al
from gridfolio.operators import blocks as bl
from gridfolio.operators import evaluation as ev
from gridfolio.operators import portfolio as pf
from gridfolio.operators import samples as sm
from gridfolio.operators import scenarios as scn
from gridfolio.operators import calendar as cl
from gridfolio.operators.calendar import calendar_of, dense_grid, period_start
from gridfolio.operators.panels import rolling_sums
from gridfolio.operators import ranking as rk
from gridfolio.operators.ranking import in_ranges
from gridfolio.operators.strategies import ChosenGroups, selected
from gridfolio.plans import portfolio_plans as pp
from gridfolio.plans import report_plans as rpl
from gridfolio.sources import tables
from gridfolio.sources.store import stored

DAY = dt.date(2024, 1, 1)


def days(n):
    return [DAY + dt.timedelta(days=i) for i in range(n)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def close_to(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and (a == pytest.approx(b, rel=1e-9, abs=1e-12)))


def same_rows(got, want):
    got, want = sorted(map(tuple, got), key=repr), sorted(map(tuple, want), key=repr)
    assert len(got) == len(want)
    key = lambda row: [x for x in row if not isinstance(x, float)]
    for a, b in zip(sorted(got, key=lambda x: repr(key(x))), sorted(want, key=lambda x: repr(key(x))), strict=True):
        assert all(close_to(x, y) for x, y in zip(a, b, strict=True)), (a, b)


# ------------------------------------------------------------------ option sets as rows


@pytest.fixture(scope="module")
def data(spark):
    """Prices with holes, halts and wild moves, scores with ties, caps with gaps, sectors that begin late."""
    rng = random.Random(11)
    dates, names = days(150), [f"t{i:02d}" for i in range(24)]
    close, opens, caps, scores = [], [], [], {"x": [], "y": []}
    for i, t in enumerate(names):
        price = 20.0 + i
        for k, d in enumerate(dates):
            price *= rng.choice([1.0, 0.97, 1.04, 1.01])
            if rng.random() < 0.06 or (i == 3 and k > 80):
                continue
            value = price * (60 if (i, k) == (5, 100) else 1)
            close.append((d, t, value))
            opens.append((d, t, value * 0.99))
            if rng.random() > 0.02:
                caps.append((d, t, float(rng.randrange(-1, 40))))
            for m, start in (("x", 0), ("y", 45)):
                if k >= start and rng.random() > 0.1:
                    scores[m].append((d, t, round(rng.gauss(0, 1), 1)))
    def frame(rows, kind="value double"):
        return spark.createDataFrame(rows, f"date date, ticker string, {kind}")
    sectors = frame([(dates[k], t, f"s{(i + k) % 3}" if i % 7 else None) for k in (20, 90) for i, t in enumerate(names)], "sector string")
    return ev.build_panel({m: frame(s, "score double") for m, s in scores.items()}, frame(close), opens=frame(opens), caps=frame(caps), sectors=sectors)


COSTS = pf.Costs(2.0, 3.0, 15.0)
SETS = {
    "plain": {"quantiles": 4, "min_assets": 8},
    "charged": {"quantiles": 4, "min_assets": 8, "costs": COSTS, "freq": "W"},
    "caps": {"quantiles": 3, "min_assets": 6, "weighting": "cap", "entry_price": "open", "costs": COSTS},
    "ends": {"quantiles": 5, "top_n": 3, "bottom_n": 2, "min_assets": 5, "lag": 2},
    "few": {"quantiles": 5, "top_n": 12, "bottom_n": 11, "min_assets": 5},
    "thin": {"quantiles": 5, "min_assets": 23, "freq": "W"},
    "partial": {"quantiles": 5, "min_assets": 23, "allow_partial": True},
    "least": {"quantiles": 2, "min_assets": 4, "min_score": 0.7, "freq": "W"},
    "never": {"quantiles": 2, "min_assets": 4, "min_score": 9.0},
    "neutral": {"quantiles": 4, "min_assets": 8, "enabled": (0, 3), "dollar_neutral": True, "costs": COSTS},
    "sided": {"quantiles": 4, "min_assets": 8, "short_quantiles": (0, 1), "dollar_neutral": True, "freq": "W"},
    "off": {"quantiles": 2, "min_assets": 4, "long_short": "off", "capital": 500.0},
    "legs": {"quantiles": 2, "min_assets": 4, "long_short": "legs"},
    "inside": {"quantiles": 2, "min_assets": 3, "sector_neutral": True},
    "unit": {"quantiles": 2, "min_assets": 3, "sector_neutral": True, "sector_unit": True, "weighting": "cap", "costs": COSTS},
    "one": {"quantiles": 1, "min_assets": 2, "weighting": "cap", "long_short": "off", "models": ["y"]},
}


def test_option_sets_equal_single_evaluations(data):
    every = scn.Scenarios(data, SETS | {"bad": {"quantiles": 0}, "odd": {"nonsense": 1}, "strange": {"freq": "5X"}, "who": {"models": ["z"]}})
    assert sorted(every.failed) == ["bad", "odd", "strange", "who"] and "quantile" in every.failed["bad"]
    trades = ["group_id", "entry_date", "exit_date", "n_positions", "n_halted", "factor", "capital_in", "capital_out", "period_return"]
    members, curve, notes = ["group_id", "ticker", "entry", "exit", "cap", "score"], ["group_id", "date", "equity"], ["entry_date", "n", "note"]
    held = ["group_id", "ticker", "entry_date", "quantity", "entry_value", "exit_value", "capital_out"]
    tables = {"trades": (every.trades, trades), "members": (every.members, members), "equity": (every.equity, curve), "notes": (every.notes, notes), "held": (pf.position_table(every), held)}
    found = {what: df.select("run", *cols).toPandas().set_index("run") for what, (df, cols) in tables.items()}
    for name, options in SETS.items():
        given = {k: v for k, v in options.items() if k not in ("freq", "lag", "models")}
        alone = ev.evaluate(ev.Data(data.panel, data.calendar, {m: c for m, c in data.models.items() if m in options.get("models", data.models)}, None, data.sectors), pf.Rules(**given), options.get("freq", "M"), options.get("lag", 0))
        single = {"trades": alone.trades, "members": alone.members, "equity": alone.equity, "notes": alone.notes, "held": pf.position_table(alone)}
        for what, df in single.items():
            cols = tables[what][1]
            want = df.select("run", *cols).toPandas().set_index("run")
            for model in alone.models:
                got = found[what].loc[found[what].index == f"{name}:{model}"]
                clean = lambda f: [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in row) for row in f.itertuples(index=False)]
                same_rows(clean(got), clean(want.loc[want.index == model]))


def test_more_option_sets_write_no_more_rows_of_tickers(spark, data, monkeypatch):
    """Priced members and positions were written, and dealt to their days, once per option set."""
    one = {"quantiles": 3, "min_assets": 6, "weighting": "cap", "costs": COSTS}
    inside = {"quantiles": 2, "min_assets": 3, "sector_neutral": True, "sector_unit": True}

    def written(sets):
        rows = {}

        def noted(df, label):
            table = stored(df, label)
            if "ticker" in df.columns:
                rows[label] = rows.get(label, 0) + table.count()
            return table

        for module in (scn, pf, rk):
            monkeypatch.setattr(module, "stored", noted)
        every = scn.Scenarios(data, sets)
        assert every.trades.count() and every.equity.count()
        return rows, {r.run: r.factor for r in every.trades.where("run like '%0:x'").groupBy("run").agg(F.sum("factor").alias("factor")).collect()}, every

    few, want, _ = written({"a0": one, "b0": inside})
    many, got, every = written({f"{n}{i}": o | {"capital": 100.0 + i} for i in range(4) for n, o in (("a", one), ("b", inside))})
    assert many == few and set(few) == {"cells", "ranges"} and got == pytest.approx(want)
    plan = re.sub(r"#\d+L?", "", plan_of(every.paths.groupBy("run").count()) + plan_of(every.positions))
    assert "hashpartitioning(ticker" not in plan and "SortMergeJoin" not in plan


def test_option_sets_over_sectors_that_come_twice(data):
    """A ticker of two rows is two of its section; a group may end between them."""
    twice = ev.Data(data.panel, data.calendar, {"x": data.models["x"]}, None, data.sectors.unionByName(data.sectors))
    inside = dict(quantiles=2, top_n=1, bottom_n=2, min_assets=3, sector_neutral=True)
    every = scn.Scenarios(twice, {"inside": inside, "ends": dict(top_n=3, bottom_n=1, min_assets=5)})
    alone = ev.evaluate(twice, pf.Rules(**inside))
    cols = ["window_id", "group_id", "ticker", "score", "sector"]
    got = every.members.where("run = 'inside:x'").select(*cols).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, alone.members.select(*cols).collect()), key=repr) and len(got) > 20
    sizes = every.members.where("run = 'ends:x'").groupBy("window_id", "group_id").count().collect()
    assert sizes and {(r.group_id, r["count"]) for r in sizes} == {("q1", 1), ("q5", 3)}


@pytest.mark.parametrize("rules", [dict(quantiles=q, min_assets=q) for q in (1, 3, 7, 10)] + [dict(top_n=4, bottom_n=3, min_assets=1), dict(quantiles=6, allow_partial=True)])
def test_limits_are_where_ranks_change_their_group(spark, rules):
    """Cross-sections of 1 to 60 names with ties, each in one window."""
    dates = days(61)
    close = [(d, f"t{i:02d}", 10.0 + i) for d in dates for i in range(60)]
    scores = [(d, f"t{i:02d}", float(i * 7 % 5)) for k, d in enumerate(dates) for i in range(k)]
    rows = lambda x, v: spark.createDataFrame(x, f"date date, ticker string, {v} double")
    panel = rows(close, "close").join(rows(scores, "score_0"), ["date", "ticker"], "left").join(calendar_of(rows(close, "close")), "date").withColumns({"open": F.col("close"), "cap": F.col("close")})
    every = scn.Scenarios(ev.Data(stored(panel, "panel"), calendar_of(panel), {"x": "score_0"}), {"s": rules | {"freq": "D"}})
    ruled = every.rules.on(every.ranked.withColumn("run", F.lit("s:x"))).where(scn.forms_groups(F.col("n"))).withColumn("group_id", scn.group_of(F.col("rank"), F.col("n")))
    want = ruled.where("group_id is not null").select("window_id", "group_id", "ticker").collect()
    got = every.members.select("window_id", "group_id", "ticker").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 300


def test_option_sets_share_rankings_and_schedules(data):
    plan = scn.planned({f"c{i}": {"quantiles": q, "min_assets": 20, "costs": pf.Costs(float(i))} for i, q in enumerate([2, 3, 4, 5] * 5)}, data.models)
    assert len(plan.runs) == 40 and len(plan.rankings) == 2 and plan.schedules == [("M", 0)]
    with pytest.raises(ValueError, match="no option set"):
        scn.Scenarios(data, {"bad": {"quantiles": 0}})
    assert "one by one" in scn.planned({"s": {"selectors": {"a": F.lit(True)}}}, data.models).failed["s"]
    with pytest.raises(ValueError, match="rule table"):
        scn.planned({f"m{i}": {} for i in range(scn.MOST_RUNS)}, data.models)


def test_capital_needs_no_python(spark):
    rows = [("r", w, g, 1.0 + w / 10, 1, 0) for w in (1, 2) for g in ("q1", "q2", "q3", "q4")]
    growth = spark.createDataFrame(rows, "run string, window_id int, group_id string, factor double, n_positions int, n_halted int")
    done = pf.compound(growth, pf.Rules(quantiles=4, short_quantiles=(0, 1), dollar_neutral=True))
    assert "Python" not in plan_of(done) and "Pandas" not in plan_of(done) and done.count() == 8


# ------------------------------------------------------------------ strategies


def test_user_strategy(data):
    def choose(scores):
        if scores.sum() < 0:
            return {}, f"{len(scores)} names, mostly low"
        return {"top": scores.nlargest(3).index, "both": [*scores.index[:2], scores.idxmax()]}

    rules = pf.Rules(strategy=ChosenGroups(choose, ("top", "both", "empty")), costs=COSTS)
    bt = ev.evaluate(data, rules, "W")
    cands = bt.candidates.where("score is not null").toPandas()
    want, notes = set(), {}
    for (run, window), rows in cands.groupby(["run", "window_id"]):
        answer = choose(rows.set_index("ticker").score.sort_index())
        notes[run, window] = answer[1] if isinstance(answer, tuple) else None
        for g, names in (answer[0] if isinstance(answer, tuple) else answer).items():
            want |= {(run, window, g, t) for t in names}
    assert {(r.run, r.window_id, r.group_id, r.ticker) for r in bt.members.collect()} == want
    got = {(r.run, r.window_id): r.note for r in bt.notes.collect()}
    assert any(notes.values()) and all(got[k] == v for k, v in notes.items())
    noted = pf.trade_notes(bt.trades, bt.notes)
    assert {r.group_id for r in noted.collect()} == {"top", "both", "empty"}
    assert noted.where("group_id = 'empty'").select("factor").distinct().collect()[0].factor == 1.0


def test_strategies_inside_sectors_and_their_checks(data):
    by_sector = ev.evaluate(data, pf.Rules(strategy=selected({"best": lambda s: s.index[s.argmax() : s.argmax() + 1]}), sector_neutral=True))
    rows = by_sector.members.groupBy("run", "window_id", "sector").count().collect()
    assert rows and {r["count"] for r in rows} == {1}
    with pytest.raises(Exception, match="names is more than 4"):
        ev.evaluate(data, pf.Rules(strategy=ChosenGroups(lambda s: {"all": s.index}, ("all",), max_rows=4))).members.collect()
    with pytest.raises(Exception, match="unknown groups"):
        ev.evaluate(data, pf.Rules(strategy=ChosenGroups(lambda s: {"other": s.index}, ("all",)))).members.collect()
    with pytest.raises(ValueError, match="selector"):
        selected({})


def test_strategies_by_place_have_no_largest_cross_section(spark, data):
    """A cross-section of more than ``max_rows`` names ended the job, whatever its callable asked for."""
    from gridfolio.plans import scale_plans as sp

    def fifths(scores):
        if len(scores) < 20:
            return {}, f"Only {len(scores)} names."
        ordered = scores.sort_values(kind="mergesort").index
        return {"low": ordered[: len(ordered) // 5], "odd": ordered[::-2], "ends": [ordered[0], *ordered[-2:], ordered[0]]}

    for groups, choose in ((("low", "odd", "ends"), fifths), (("core", "tails"), sp.core_and_tails)):
        seen, unseen, some = (ev.evaluate(data, pf.Rules(strategy=ChosenGroups(choose, groups, n)), "W") for n in (100, 0, 20))
        for bt in (unseen, some):
            for what, cols in (("members", ["run", "window_id", "group_id", "ticker", "score"]), ("notes", ["run", "window_id", "n", "note"])):
                assert sorted(map(tuple, getattr(bt, what).select(*cols).collect()), key=repr) == sorted(map(tuple, getattr(seen, what).select(*cols).collect()), key=repr)
    # 60 names, twelve to a score, one without a ticker: ties go by ticker and that one is the last of its score
    scored = spark.createDataFrame([("r", 1, f"t{i:02d}" if i != 30 else None, float(i % 5)) for i in range(60)], "run string, window_id int, ticker string, score double")
    found = [{(r.group_id, r.ticker) for r in ChosenGroups(sp.core_and_tails, ("core", "tails"), n).decide(scored, pf.WIN).where("ticker <> 'None'").collect()} for n in (60, 59)]
    assert found[0] == found[1] and len(found[0]) == 16


@pytest.mark.parametrize(
    "choose",
    [
        lambda s: {"all": s.sort_values().index}, lambda s: {"all": s.sort_values(kind="mergesort", ascending=False).index}, lambda s: {"all": s[s > 0].index}, lambda s: {"all": s.nlargest(2).index},
        lambda s: {"all": ["t01"]}, lambda s: {"all": [x for x in s.sort_values(kind="stable").index if x != "t01"]}, lambda s: ({}, f"best is {s.sort_values(kind='stable').index[-1]}"),
        lambda s: {"all": ["t01"] if "t01" in s.sort_values(kind="stable").index[:9] else []}, lambda s: {"all": s.index[:3]} if np.mean(s) > 0 else {},
    ],
)
def test_what_is_not_at_hand_is_refused(spark, choose):
    scored = spark.createDataFrame([("r", 1, f"t{i:02d}", float(i)) for i in range(24)], "run string, window_id int, ticker string, score double")
    with pytest.raises(Exception, match="names is more than 4"):
        ChosenGroups(choose, ("all",), 4).decide(scored, pf.WIN).collect()


# ------------------------------------------------------------------ blocks


def long_facts(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for t in ("a", "b", "c"):
        for i, d in enumerate(days(n)):
            if rng.random() < 0.15 or (t == "b" and 90 < i < 260) or (t == "c" and i < 333):
                continue
            p = rng.uniform(5, 50) * rng.choice([1, 1, 1, 0] if t == "a" else [1])
            rows.append((t, d, p, p * 1.1, p * 0.9, rng.choice([p, None]), float(rng.randrange(5))))
    facts = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")
    return facts, calendar_of(spark.createDataFrame([(d,) for d in days(n)], "date date"))


OHLCV = ["open", "high", "low", "close", "volume"]


@pytest.mark.parametrize("rows", [1, 7, 64, 1000])
def test_blocked_grid(spark, rows):
    facts, cal = long_facts(spark)
    got = bl.blocked_grid(facts, cal, OHLCV, rows)
    assert got.where(F.col("block") != bl.block_of(F.col("pos"), rows)).count() == 0
    same_rows(got.drop("block").select("ticker", "pos", "date", *OHLCV).collect(), dense_grid(facts, cal, OHLCV).select("ticker", "pos", "date", *OHLCV).collect())


@pytest.mark.parametrize("rows", [9, 50])
def test_features_over_blocks(spark, rows):
    facts, cal = long_facts(spark)
    specs = [*feat.REGISTRY, ("ulcer", {"window": 30}), {"name": "rsi", "window": 3}]
    want, names = feat.add_features(dense_grid(facts, cal, OHLCV), specs)
    got, same = bl.add_features(bl.blocked_grid(facts, cal, OHLCV, rows), specs, rows=rows)
    assert names == same
    same_rows(got.select("ticker", "pos", *[F.round(n, 9) for n in names]).collect(), want.select("ticker", "pos", *[F.round(n, 9) for n in names]).collect())
    sums = bl.blocked_rolling(bl.blocked_grid(facts, cal, ["close"], rows), "close", [4, 11], rows)
    plain = rolling_sums(dense_grid(facts, cal, ["close"]), "close", [4, 11])
    same_rows(sums.select("window_rows", "ticker", "date", F.round("value", 9)).collect(), plain.select("window_rows", "ticker", "date", F.round("value", 9)).collect())


@pytest.mark.parametrize("span", [1, 2, 9, 200])
def test_weighted_means_over_blocks(spark, span):
    facts, cal = long_facts(spark, seed=span)
    want = with_ewm(dense_grid(facts, cal, ["close"]), "close", span, "e")
    for rows in (5, 128):
        got = bl.blocked_ewm(bl.blocked_grid(facts, cal, ["close"], rows), "close", span, "e", rows)
        a, b = (df.select("ticker", "pos", "e").orderBy("ticker", "pos").toPandas() for df in (got, want))
        assert a[["ticker", "pos"]].equals(b[["ticker", "pos"]]) and np.allclose(a.e, b.e, rtol=1e-9, equal_nan=True)


def test_one_long_ticker_is_many_tasks(spark):
    cells = spark.range(1, 1_000_001).selectExpr("'t' as ticker", "cast(id as int) as pos", "cast(id % 97 as double) as close", "date '2000-01-01' as date")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        done = bl.over_blocks(cells, 19, lambda df: feat.magap(df, out="m"), 50_000)
        sizes = [r["count"] for r in done.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sum(sizes) == 1_000_000 and len(sizes) == 4 and max(sizes) < 600_000
    want = feat.magap(cells, out="m").agg(F.sum("m")).first()[0]
    assert done.agg(F.sum("m")).first()[0] == pytest.approx(want, rel=1e-9)


# ------------------------------------------------------------------ falls, dates, schedules


@pytest.mark.parametrize("horizon", [0, 1, 2, 3, 4, 7, 12, 31])
def test_falls_by_doubling(spark, horizon):
    rng = random.Random(horizon)
    rows = [(t, i, None if t == "holes" and rng.random() < 0.2 else rng.choice([0.0, rng.uniform(1, 9), 5.0])) for t in ("whole", "holes") for i in range(60)]
    df = spark.createDataFrame(rows, "ticker string, pos int, close double")
    got = sm.with_forward_drawdown(df, horizon, "dd")
    assert "collect_list" not in plan_of(got)
    want = df.withColumn("dd", sm.forward_drawdown(horizon))
    a, b = (x.where("close > 0").orderBy("ticker", "pos").toPandas().dd for x in (got, want))
    assert np.allclose(a, b, rtol=0, atol=2e-8) and got.where("not close > 0 and dd is not null").count() == 0


def test_many_dates_equal_one_by_one(spark):
    rng = random.Random(8)
    facts = spark.createDataFrame([(t, d, rng.random()) for t in "abcd" for d in days(60) if rng.random() < 0.4], "ticker string, date date, v double")
    asked = [DAY + dt.timedelta(days=k) for k in range(-3, 70, 2)]
    targets = spark.createDataFrame([(d,) for d in [*asked, asked[4], None]], "target date")
    got = {(r.target, r.ticker): (r.date, r.age, r.n_rows, r.v) for r in al.as_of_many(facts, targets, ["v"], max_age_days=3, rows_needed=4).collect()}
    values = {(r.ticker, r.date): r.v for r in facts.collect()}
    want = {(d, r.ticker): (r.date, r.age, r.n_rows, values[r.ticker, r.date]) for d in asked for r in al.fresh_bars(facts, str(d), 3, 4).collect()}
    assert got == want and got
    free = al.as_of_many(facts, targets).collect()
    assert len(free) == sum(any(f[0] == t and f[1] <= d for f in values) for d in asked for t in "abcd")
    assert al.as_of_many(facts, targets.limit(0)).count() == 0 and al.as_of_many(facts.limit(0), targets).count() == 0


@pytest.mark.parametrize(("freq", "rule"), [("B", "B"), ("MS", "MS"), ("BM", "BME"), ("BMS", "BMS"), ("QS", "QS"), ("M", "ME"), ("Q", "QE")])
def test_periods_match_resampling(spark, freq, rule):
    dates = days(800)
    kept = [d for d in dates if random.Random(d.toordinal()).random() < 0.7]
    df = spark.createDataFrame([(d,) for d in kept], "date date")
    got = sorted(r.last for r in df.groupBy(period_start("date", freq)).agg(F.max("date").alias("last")).collect())
    series = pd.Series(kept, index=pd.DatetimeIndex(kept))
    assert got == sorted(series.resample(rule).last().dropna().tolist())


def test_members_are_not_shuffled_to_meet_the_totals_of_their_group(spark):
    rows = [("r", 1, "q1", f"t{i}", i % 2 == 0, False, 1.0, 1.0) for i in range(20_000)]
    weighed = stored(spark.createDataFrame(rows, "run string, window_id int, group_id string, ticker string, kept boolean, halted boolean, cap double, base double"), "weighed")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")  # fewer bytes than the members have
    try:
        held = pf.shares(weighed, F.lit(True))
        plan = plan_of(held)
        shares = {r.share for r in held.select("share").distinct().collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert shares == {0.0, 1.0 / 10_000}


# ------------------------------------------------------------------ work per task


def test_windows_of_a_grid_run_in_as_many_parts_as_shuffles_have(spark):
    """Left to the optimiser, few bytes were one part however many cells they become; plain and blocked alike."""
    facts = spark.createDataFrame([(f"t{i}", DAY + dt.timedelta(days=d), 1.0) for i in range(12) for d in (0, 2)], "ticker string, date date, close double")
    calendar = calendar_of(facts.unionByName(facts.withColumn("date", F.date_add("date", 1))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = dense_grid(facts, calendar, ["close"])
    assert cells.rdd.getNumPartitions() == parts and cells.count() == 48
    blocked = bl.blocked_grid(facts, calendar, ["close"], 2)
    assert blocked.rdd.getNumPartitions() == parts and blocked.count() == 48
    rolled = bl.over_blocks(blocked, 1, lambda df: df.withColumn("s", F.sum("close").over(Window.partitionBy("ticker").orderBy("pos").rowsBetween(-1, 0))), 2)
    assert rolled.rdd.getNumPartitions() == parts and rolled.count() == 48


def test_parts_follow_the_files_that_are_read(spark, tmp_path, monkeypatch):
    """With a fixed number of parts, the memory of a task grew with the table until it spilled."""
    path = f"{tmp_path}/a table.parquet"
    spark.range(20_000).selectExpr("cast(id as string) as ticker", "cast(id % 7 as int) as g", "id as v").repartition(3).write.parquet(path)
    rows, usual = spark.read.parquet(path), int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = sum(f.stat().st_size for f in (tmp_path / "a table.parquet").glob("part-*"))
    assert cl.parts_of(rows) == usual and cl.in_more_parts(rows, "ticker") is rows
    monkeypatch.setattr(cl, "PART_BYTES", size // 9)
    assert cl.parts_of(rows, rows.limit(1)) == cl.parts_of(rows.unionByName(rows)) == -(-size // (size // 9)) > usual
    assert cl.in_parts(rows, "ticker").rdd.getNumPartitions() == cl.parts_of(rows)
    assert cl.parts_of(spark.createDataFrame([(1,)], "v int")) == usual  # no file at all
    both = cl.dealt_join(rows, rows.select("ticker", F.col("v").alias("w")), ["ticker"])
    assert both.where("v = w").count() == 20_000
    assert in_ranges(rows, ["g"], "v", "ticker").agg(F.max("range_no")).first()[0] >= usual


def test_days_and_holdings_meet_in_the_parts_of_the_panel(spark, tmp_path, monkeypatch):
    """Neither side of the join is dealt a second time to fit the other, and the values are those of few parts."""
    cells = [(f"t{i}", k + 1, 10.0 + i + k) for i in range(12) for k in range(6)]
    spark.createDataFrame(cells, "ticker string, pos int, close double").write.parquet(f"{tmp_path}/panel")
    panel = spark.read.parquet(f"{tmp_path}/panel")
    windows = spark.createDataFrame([("r", 1, 1, 3), ("r", 2, 3, 6)], "run string, window_id int, entry_pos int, exit_pos int")
    held = [("r", w, "q1", f"t{i}", 1.0 / 12, 10.0 + i + p) for w, p in ((1, 0), (2, 2)) for i in range(12)]
    positions = spark.createDataFrame(held, "run string, window_id int, group_id string, ticker string, share double, entry double")
    ends = spark.createDataFrame([("r", 1, "q1", 1.1), ("r", 2, "q1", 1.2)], "run string, window_id int, group_id string, raw_factor double")

    def paths():
        parts = cl.parts_of(panel)
        found = pf.daily_paths(positions, pf.window_days(panel, windows, positions, parts), ends, pf.Rules(), parts)
        return parts, plan_of(found), found.collect()

    few, _, want = paths()
    monkeypatch.setattr(cl, "PART_BYTES", 100)
    many, plan, got = paths()
    assert many > few
    assert f"hashpartitioning(ticker, window_id, {few})" not in re.sub(r"#\d+L?", "", plan)
    same_rows(got, want)


@pytest.mark.parametrize("query", [rpl.agg13, rpl.agg19])
def test_queries_in_many_parts_give_the_same_rows(spark, monkeypatch, query):
    data = "/root/testdata/sf0.001"
    pp.forget()
    want = query(spark, data).collect()
    monkeypatch.setattr(cl, "PART_BYTES", 20_000)
    pp.forget()
    try:
        got = query(spark, data).collect()
    finally:
        pp.forget()
    same_rows(got, want)


def test_blocks_of_tickers_of_any_name_or_none(spark):
    names = ["a", "0|a", "|a", "1", "", None]
    rows = [(n, p, DAY + dt.timedelta(days=p), float(10 * i + p)) for i, n in enumerate(names) for p in range(1, 6)]
    cells = spark.createDataFrame(rows, "ticker string, pos int, date date, close double").withColumn("block", bl.block_of(F.col("pos"), 2))
    frame = Window.partitionBy("ticker").orderBy("pos").rowsBetween(-1, 0)
    got = bl.over_blocks(cells, 1, lambda df: df.withColumn("s", F.sum("close").over(frame)), 2).collect()
    want = {(n, p): v + (v - 1 if p > 1 else 0) for n, p, _, v in rows}
    assert len(got) == len(rows) and {(r.ticker, r.pos): r.s for r in got} == want


def test_scores_of_a_grid_at_hand_read_no_table(spark):
    rows = [("a", p, DAY + dt.timedelta(days=7 * p), float(p), 1.0) for p in range(1, 8)]
    cells = spark.createDataFrame(rows, "ticker string, pos int, date date, close double, amount double")
    got = tables.scores(spark, "/no/such/folder", ["b"], cells).collect()
    assert sorted((r.model, r.pos, r.score) for r in got) == [("b", p, p / (p - 4) - 1.0) for p in (5, 6, 7)]


def line_items(spark, path, n=900, hot=None):
    """Line items of 12 suppliers over five weeks; a third of all rows may be one supplier's."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        supplier = hot if hot and i % 3 == 0 else rng.randrange(1, 13)
        day = dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(35))
        rows.append((i // 4, supplier, i % 4, float(rng.randrange(1, 50)), rng.randrange(100, 99999) / 100, 0.05, day))
    kind = "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp"
    spark.createDataFrame(rows, kind).write.parquet(f"{path}/lineitem.parquet")
    return rows


def test_scan_tasks_keep_no_table_of_bars(spark, tmp_path):
    line_items(spark, tmp_path)
    plan = plan_of(tables.bars(spark, str(tmp_path))).splitlines()
    aggregates = [i for i, line in enumerate(plan) if "Aggregate" in line]
    exchanges = [i for i, line in enumerate(plan) if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 1  # nothing is shuffled twice
    assert max(aggregates) < exchanges[0]  # below stands only what scan tasks do


def test_bars_of_a_supplier_with_a_third_of_all_rows(spark, tmp_path):
    rows = line_items(spark, tmp_path, hot=7)
    want = {}
    for order, supplier, line, qty, amount, _, day in rows:
        monday = (day - dt.timedelta(days=day.weekday())).date()
        want.setdefault((str(supplier), monday), []).append((day, order, line, amount, qty))
    found = {(r["ticker"], r["date"]): r for r in tables.bars(spark, str(tmp_path)).collect()}
    assert found.keys() == want.keys()
    for key, items in want.items():
        items.sort()
        assert found[key]["open"] == items[0][3] / items[0][4]
        assert found[key]["close"] == items[-1][3] / items[-1][4]
        assert found[key]["volume"] == sum(i[4] for i in items)


def test_index_of_a_grid_at_hand_reads_no_table(spark):
    cells = spark.createDataFrame([("a", dt.date(2024, 1, 1), 2.0), ("b", dt.date(2024, 1, 1), 4.0), ("b", dt.date(2024, 1, 8), None)], "ticker string, date date, close double")
    found = {r["date"]: r["value"] for r in tables.index_level(spark, "/nowhere", cells).collect()}
    assert found == {dt.date(2024, 1, 1): 3.0, dt.date(2024, 1, 8): None}
