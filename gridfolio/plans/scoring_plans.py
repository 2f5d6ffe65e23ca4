"""Registered queries: model results, ensembles, rankings, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridfolio.functions.expr import rounded
from gridfolio.operators import scoring as sc
from gridfolio.plans.registry import query
from gridfolio.plans.views_sql import r, view
from gridfolio.sources import tables

C = F.col
ALL = ["a", "b", "c"]
DAY = "1997-06-09"


def res(spark, sf, models=None):
    return tables.results(spark, sf, models or ALL)


@query("agg1_accuracy", f"select model, {r('avg(cast(label = prediction as integer))')} as accuracy from results_long group by model")
def agg1(spark, sf):
    return sc.accuracy(res(spark, sf), ["model"]).select("model", rounded(C("accuracy")).alias("accuracy"))


view(
    "class_rows",
    """select model, k as class, tp, called, support, coalesce(tp / nullif(called, 0), 0) as precision, coalesce(tp / nullif(support, 0), 0) as recall,
        coalesce(2 * coalesce(tp / nullif(called, 0), 0) * coalesce(tp / nullif(support, 0), 0)
            / nullif(coalesce(tp / nullif(called, 0), 0) + coalesce(tp / nullif(support, 0), 0), 0), 0) as f1
       from (select model, k, cast(count(case when label = k and prediction = k then 1 end) as double) as tp,
                cast(count(case when prediction = k then 1 end) as double) as called, cast(count(case when label = k then 1 end) as double) as support
             from results_long, (select unnest([0, 1]) as k) group by model, k)""",
)
_M = ["precision", "recall", "f1"]


@query(
    "agg2_classification_report",
    f"""select model, cast(class as varchar) as row, {', '.join(f'{r(m)} as {m}' for m in _M)}, cast(support as bigint) as support from class_rows
        union all select model, 'macro avg', {', '.join(r(f'avg({m})') for m in _M)}, cast(sum(support) as bigint) from class_rows group by model
        union all select model, 'weighted avg', {', '.join(r(f'sum({m} * support) / sum(support)') for m in _M)}, cast(sum(support) as bigint)
        from class_rows group by model""",
)
def agg2(spark, sf):
    out = sc.classification_report(res(spark, sf), ["model"])
    return out.select("model", "row", *[rounded(C(m)).alias(m) for m in _M], "support")


@query("agg3_confusion_matrix", "select model, label, prediction, count(*) as n from results_long group by all")
def agg3(spark, sf):
    return sc.confusion(res(spark, sf), ["model"])


view(
    "model_weights",
    """select model, case when sum(p) over () = 0 then 1.0 / count(*) over () else p / sum(p) over () end as weight from (
        select model, coalesce(avg(case when prediction = 0 and year(date) = 1996 then cast(label = 0 as integer) end), 0) as p
        from results_long group by model)""",
)


@query("agg4_precision_weights", f"select model, {r('weight')} as weight from model_weights")
def agg4(spark, sf):
    return sc.precision_weights(res(spark, sf), 1996).select("model", rounded(C("weight")).alias("weight"))


@query(
    "agg5_member_ensemble",
    f"""select ticker, date, {r('1 / (1 + exp(-m))')} as prob_up, {r('1 - 1 / (1 + exp(-m))')} as prob_down, cast(1 / (1 + exp(-m)) > 0.5 as integer) as prediction
        from (select ticker, date, avg(score) - avg(0.1 * score) as m from scores_long group by ticker, date)""",
)
def agg5(spark, sf):
    members = tables.scores(spark, sf, ALL).select("ticker", "date", (C("score") * 0.1).alias("l0"), C("score").alias("l1"))
    out = sc.ensemble_members(members, ["ticker", "date"])
    return out.select("ticker", "date", rounded(C("prob_up")).alias("prob_up"), rounded(C("prob_down")).alias("prob_down"), "prediction")


@query(
    "agg6_score_penalty",
    f"select model, ticker, date, {r('prob_up')} as plain, {r('prob_up - 0.5 * prob_down')} as penalised from results_long",
)
def agg6(spark, sf):
    rows = sc.penalised_score(res(spark, sf), 0.0, None).withColumnRenamed("score", "plain")
    out = sc.penalised_score(rows, 0.5, "prob_down")
    return out.select("model", "ticker", "date", rounded(C("plain")).alias("plain"), rounded(C("score")).alias("penalised"))


@query("agg7_score_panel", f"select date, ticker, {r('prob_up')} as score from results_long where model = 'b'")
def agg7(spark, sf):
    return sc.score_panel(res(spark, sf, ["b"]), "prob_up").select("date", "ticker", rounded(C("score")).alias("score"))


@query(
    "jn12_n_way_merge",
    f"""select date, ticker, label, {r('sum(prob_up * weight)')} as weighted_prob_up from results_long join model_weights using (model)
        group by date, ticker, label having count(*) = 3""",
)
def jn12(spark, sf):
    rows = res(spark, sf)
    out = sc.merge_models(rows, sc.precision_weights(rows, 1996), 3)
    return out.select("date", "ticker", "label", rounded(C("weighted_prob_up")).alias("weighted_prob_up"))


@query(
    "jn13_ensemble_intersection",
    f"""select date, ticker, {r('avg(prob_up)')} as prob_up from results_long
        where date in (select date from results_long group by date having count(distinct model) = 3)
        and ticker in (select ticker from results_long group by ticker having count(distinct model) = 3)
        group by date, ticker having count(*) = 3""",
)
def jn13(spark, sf):
    return sc.ensemble_intersection(res(spark, sf), 3).select("date", "ticker", rounded(C("prob_up")).alias("prob_up"))


view(
    "ensemble_day",
    f"""select date, ticker, avg(prob_up) as prob_up, avg(prob_down) as prob_down, count(*) as model_count, cast(avg(prob_up) > 0.5 as integer) as prediction
        from results_long group by date, ticker having count(*) = 3""",
)


@query(
    "jn14_single_date_ensemble",
    f"select ticker, {r('prob_up')} as prob_up, {r('prob_down')} as prob_down, prediction, model_count from ensemble_day where date = '{DAY}'",
)
def jn14(spark, sf):
    out = sc.ensemble_cells(res(spark, sf).where(C("date") == DAY), 3)
    return out.select("ticker", rounded(C("prob_up")).alias("prob_up"), rounded(C("prob_down")).alias("prob_down"), "prediction", "model_count")


def ensemble(spark, sf):
    return sc.ensemble_cells(res(spark, sf).where(C("date") == DAY), 3)


@query(
    "top2_largest_smallest",
    f"""select 'top' as side, ticker, {r('prob_up')} as prob_up from (select * from ensemble_day where date = '{DAY}' order by prob_up desc, ticker limit 10)
        union all select 'bottom', ticker, {r('prob_up')} from (select * from ensemble_day where date = '{DAY}' order by prob_up, ticker limit 10)""",
)
def top2(spark, sf):
    cells = ensemble(spark, sf)
    top = sc.largest(cells, "prob_up", 10).select(F.lit("top").alias("side"), "ticker", "prob_up")
    low = sc.smallest(cells, "prob_up", 10).select(F.lit("bottom").alias("side"), "ticker", "prob_up")
    return top.unionByName(low).select("side", "ticker", rounded(C("prob_up")).alias("prob_up"))


@query("top6_single_ticker", f"select date, {r('prob_up')} as prob_up, {r('prob_down')} as prob_down, prediction from ensemble_day where ticker = '42'")
def top6(spark, sf):
    cells = sc.ensemble_cells(res(spark, sf).where(C("ticker") == "42"), 3)
    return cells.select("date", rounded(C("prob_up")).alias("prob_up"), rounded(C("prob_down")).alias("prob_down"), "prediction")


@query("agg8_date_coverage", "select coalesce(a.date, b.date) as date, coalesce(a.n, 0) as n_left, coalesce(b.n, 0) as n_right from (select date, count(*) as n from results_long where model = 'a' group by date) a full join (select date, count(*) as n from results_long where model = 'c' group by date) b on a.date = b.date")
def agg8(spark, sf):
    rows = res(spark, sf, ["a", "c"])
    return sc.coverage_by_date(rows.where(C("model") == "a"), rows.where(C("model") == "c"))


@query(
    "agg9_sample_summary",
    """select cast(label as varchar) as part, count(*) as n_rows, count(distinct ticker) as n_tickers from results_long where model = 'b' group by label
       union all select 'all', count(*), count(distinct ticker) from results_long where model = 'b'""",
)
def agg9(spark, sf):
    return sc.sample_summary(res(spark, sf, ["b"]))


@query(
    "set1_ticker_coverage",
    """select coalesce(a.ticker, b.ticker) as ticker, case when a.ticker is not null and b.ticker is not null then 'both'
        when a.ticker is not null then 'missing_right' else 'missing_left' end as status
       from (select distinct ticker from bars_w where volume > 150) a full join (select distinct ticker from bars_m where high > 80000) b on a.ticker = b.ticker""",
)
def set1(spark, sf):
    left = tables.bars(spark, sf).where(C("volume") > 150)
    right = tables.bars(spark, sf, "M").where(C("high") > 80000)
    return sc.ticker_coverage(left, right)


DATES = ["1997-06-09", "1997-06-16", "1997-06-23"]


@query(
    "set3_multi_date_batch",
    "select ticker, " + ", ".join(f"{r(f"max(case when date = '{d}' then prob_up end)")} as \"{d}\"" for d in DATES)
    + f" from ensemble_day where date in ({', '.join(repr(d) for d in DATES)}) group by ticker",
)
def set3(spark, sf):
    cells = sc.ensemble_cells(res(spark, sf).where(C("date").isin(DATES)), 3)
    wide = cells.withColumn("day", C("date").cast("string")).groupBy("ticker").pivot("day", DATES).agg(F.max("prob_up"))
    return wide.select("ticker", *[rounded(C(f"`{d}`")).alias(d) for d in DATES])


@query(
    "set4_models_side_by_side",
    f"""select ticker, {', '.join(f"{r(f"max(case when model = '{m}' then prob_up end)")} as {m}" for m in ALL)},
        {r("case when count(*) = 3 then avg(prob_up) end")} as avg from results_long where date = '{DAY}' group by ticker""",
)
def set4(spark, sf):
    rows = res(spark, sf).where(C("date") == DAY)
    wide = rows.groupBy("ticker").pivot("model", ALL).agg(F.max("prob_up"))
    whole = C("a").isNotNull() & C("b").isNotNull() & C("c").isNotNull()
    mean = F.when(whole, (C("a") + C("b") + C("c")) / 3.0)
    return wide.select("ticker", *[rounded(C(m)).alias(m) for m in ALL], rounded(mean).alias("avg"))
