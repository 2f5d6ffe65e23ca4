"""Model results: accuracy reports, ensembles, score panels, rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfolio.functions.expr import div

C = F.col
CELL = ["date", "ticker"]


def accuracy(results: DataFrame, by: Sequence[str]) -> DataFrame:
    return results.groupBy(*by).agg(F.avg((C("label") == C("prediction")).cast("double")).alias("accuracy"))


def confusion(results: DataFrame, by: Sequence[str]) -> DataFrame:
    return results.groupBy(*by, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def classification_report(results: DataFrame, by: Sequence[str], classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Precision, recall, f1 and support per class, and their macro and weighted means.

    Built from the confusion counts, a handful of rows per key; an empty
    denominator gives 0.
    """
    counts = confusion(results, by)
    klass = F.explode(F.array(*[F.lit(c) for c in classes])).alias("class")
    spread = counts.select("*", klass)
    hit = (C("label") == C("class")) & (C("prediction") == C("class"))
    sums = spread.groupBy(*by, "class").agg(
        F.sum(F.when(hit, C("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(C("prediction") == C("class"), C("n")).otherwise(0)).alias("called"),
        F.sum(F.when(C("label") == C("class"), C("n")).otherwise(0)).alias("support"),
    )

    def ratio(num: Column, den: Column) -> Column:
        return F.coalesce(div(num.cast("double"), den.cast("double")), F.lit(0.0))

    per = sums.withColumns({"precision": ratio(C("tp"), C("called")), "recall": ratio(C("tp"), C("support"))})
    per = per.withColumn("f1", ratio(2.0 * C("precision") * C("recall"), C("precision") + C("recall")))
    measures = ["precision", "recall", "f1"]
    rows = per.select(*by, C("class").cast("string").alias("row"), *measures, "support")
    macro = per.groupBy(*by).agg(*[F.avg(m).alias(m) for m in measures], F.sum("support").alias("support"))
    weighted = per.groupBy(*by).agg(
        *[ratio(F.sum(C(m) * C("support")), F.sum("support")).alias(m) for m in measures], F.sum("support").alias("support")
    )
    return rows.unionByName(macro.select(*by, F.lit("macro avg").alias("row"), *measures, "support")).unionByName(
        weighted.select(*by, F.lit("weighted avg").alias("row"), *measures, "support")
    )


def precision_weights(results: DataFrame, year: int) -> DataFrame:
    """Share of each model in the precision of its 0 class in one year; all zero -> equal.

    One row per model."""
    called = results.where((F.year("date") == year) & (C("prediction") == 0))
    per = results.select("model").distinct().join(
        called.groupBy("model").agg(F.avg((C("label") == 0).cast("double")).alias("p")), "model", "left"
    )
    p = F.coalesce(C("p"), F.lit(0.0))
    whole = Window.partitionBy(F.lit(1))  # one row per model
    total, n = F.sum(p).over(whole), F.count(F.lit(1)).over(whole)
    return per.select("model", F.when(total == 0, 1.0 / n).otherwise(p / F.nullif(total, F.lit(0.0))).alias("weight"))


def ensemble_members(logits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean logits over the members, then the two-class softmax."""
    means = logits.groupBy(*keys).agg(F.avg("l0").alias("l0"), F.avg("l1").alias("l1"))
    up = 1.0 / (1.0 + F.exp(C("l0") - C("l1")))
    return means.select(*keys, (1.0 - up).alias("prob_down"), up.alias("prob_up"), (up > 0.5).cast("int").alias("prediction"))


def penalised_score(results: DataFrame, k: float, risk: str | None) -> DataFrame:
    score = C("prob_up") if risk is None else C("prob_up") - F.lit(k) * C(risk)
    return results.withColumn("score", score)


def score_panel(results: DataFrame, value: str) -> DataFrame:
    """(date, ticker, score); a duplicate cell is an error."""
    cells = results.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("score"))
    twice = F.raise_error(F.lit("duplicate (date, ticker) in the results")).cast("double")
    return cells.select(*CELL, F.when(C("n") > 1, twice).otherwise(C("score")).alias("score"))


def merge_models(results: DataFrame, weights: DataFrame, n_models: int) -> DataFrame:
    """Cells (with equal label) that every model has, with the weighted probability.

    A union and one aggregate replace a chain of joins.
    """
    weighed = results.join(F.broadcast(weights), "model")  # one row per model
    return (
        weighed.groupBy(*CELL, "label")
        .agg(F.sum(C("prob_up") * C("weight")).alias("weighted_prob_up"), F.count(F.lit(1)).alias("n"))
        .where(C("n") == n_models)
        .drop("n")
    )


def ensemble_intersection(results: DataFrame, n_models: int) -> DataFrame:
    """Mean over models of the cells that all models have.

    Such a cell's date and ticker are common to all models, so they need no intersection of their own.
    """
    cells = results.groupBy(*CELL).agg(F.avg("prob_up").alias("prob_up"), F.count("prob_up").alias("n"))
    return cells.where(C("n") == n_models).drop("n")


def ensemble_cells(results: DataFrame, n_models: int) -> DataFrame:
    """Mean probabilities where all models have the ticker on the date."""
    means = results.groupBy(*CELL).agg(
        F.avg("prob_up").alias("prob_up"), F.avg("prob_down").alias("prob_down"), F.count(F.lit(1)).alias("model_count")
    )
    return means.where(C("model_count") == n_models).withColumn("prediction", (C("prob_up") > 0.5).cast("int"))


def coverage_by_date(left: DataFrame, right: DataFrame) -> DataFrame:
    """Samples per date in two sources."""
    one = left.groupBy("date").agg(F.count(F.lit(1)).alias("n_left"))
    two = right.groupBy("date").agg(F.count(F.lit(1)).alias("n_right"))
    joined = one.join(two, "date", "full")
    return joined.select("date", F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))


def ticker_coverage(left: DataFrame, right: DataFrame) -> DataFrame:
    a = left.select("ticker").distinct().withColumn("l", F.lit(True))
    b = right.select("ticker").distinct().withColumn("r", F.lit(True))
    where = F.when(C("l") & C("r"), "both").when(C("l"), "missing_right").otherwise("missing_left")
    return a.join(b, "ticker", "full").select("ticker", where.alias("status"))


def sample_summary(samples: DataFrame, label: str = "label") -> DataFrame:
    """Rows and distinct tickers per label, and in all."""
    per = samples.groupBy(C(label).cast("string").alias("part")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ticker").alias("n_tickers")
    )
    whole = samples.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ticker").alias("n_tickers"))
    return per.unionByName(whole.select(F.lit("all").alias("part"), "n_rows", "n_tickers"))


def largest(df: DataFrame, value: str, n: int) -> DataFrame:
    return df.orderBy(C(value).desc(), C("ticker").asc()).limit(n)


def smallest(df: DataFrame, value: str, n: int) -> DataFrame:
    return df.orderBy(C(value).asc(), C("ticker").asc()).limit(n)
