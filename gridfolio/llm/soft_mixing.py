"""Mixing documents to target token shares of soft domains. DataFrame functions only.

Domains are the combinations of the labels: ``good`` (quality 1, not toxic), ``poor`` (quality 0, not toxic) and
``toxic``. A Gaussian classifier on a few measures of a text, fitted by one aggregate over the labelled documents,
gives every document a posterior p over the domains. Each document then gets a nonnegative rate r (how often it is
read) such that the expected tokens per domain, sum of r * tokens * p, match the targets: projected gradient steps on
the least squares of the differences. A step sums K numbers over all documents; documents, posteriors and rates never
leave the executors, and a rate is a fold over the K numbers of all earlier steps.

Defined cases: null and empty texts have no tokens and a rate like any other document; labels with a null are not
learnt from; several labels of a document: the smallest quality and the largest toxic count; a domain without labels
has posterior 0 and is left out of the targets, and with no labels at all the prior is uniform. A domain that the
targets do not name is asked nothing, and shares are those among the named ones. Targets that no rates reach are
approached by least squares, and a warning states the shares.

With a floor of 1 and no stated budget only the shares are wanted. The rates are then those nearest to 1, by squares
weighted with tokens, that have exactly these shares: r = max(1, 1 + p . m) for a vector m of K numbers, found by a few
Newton steps, each an aggregate over all documents.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfolio.llm.common import stored

DOMAINS = ("good", "poor", "toxic")
#: Shares of tokens wanted per domain.
TARGETS = {"good": 0.85, "poor": 0.1, "toxic": 0.05}
#: Shares for documents of which toxic ones are already gone.
KEPT_TARGETS = {"good": 0.9, "poor": 0.1}
STEPS, CLOSE = 30, 1e-6
MISSED = 1e-3  # a share further than this from its target is warned of
SPREAD = 0.05  # least standard deviation of a measure inside a domain


def tokens(text: Column) -> Column:
    """Words of a text: runs of other characters than white space."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("double")


def measures(text: Column, n_tokens: Column) -> dict[str, Column]:
    """Numbers of one scale that tell domains apart; each is a share or a logarithm."""
    chars = F.length(text) + F.lit(1.0)
    runs = lambda pattern: F.regexp_count(text, F.lit(pattern))
    each = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return {
        "log_tokens": F.log1p(n_tokens) / 10,
        "word_length": F.log(chars / (n_tokens + 1)) / 2,
        "symbols": F.sqrt(runs(r"[!-+/:-@\[-`{-~]+") / (n_tokens + 1)),
        "capitals": F.sqrt(runs(r"[A-Z]") / (n_tokens + 1)),
        "digits": F.sqrt(runs(r"[0-9]+") / (n_tokens + 1)),
        "lines": F.sqrt(each("\n") / (n_tokens + 1)),
        "stops": F.sqrt((each(".") + each(",")) / (n_tokens + 1)),
    }


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, tokens, measures...) of every row: the only pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select("doc_id", text.alias("text")).withColumn("tokens", tokens(F.col("text"))).select("doc_id", "tokens", *[c.alias(k) for k, c in measures(F.col("text"), F.col("tokens")).items()])


def fit_domains(rows: DataFrame, labels: DataFrame, names: list[str]) -> list[dict]:
    """Prior, means and deviations of the measures per domain: one aggregate over the labelled rows."""
    one = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    known = rows.join(one.select("doc_id", domain.alias("domain")), "doc_id")
    stats = known.groupBy("domain").agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in names for k, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    found = {r["domain"]: r for r in stats.collect()}  # a row per domain
    total = sum(r["n"] for r in found.values())
    return [
        {"prior": found[d]["n"] / total, "mean": [found[d][f"mean_{c}"] for c in names], "sd": [max(found[d][f"sd_{c}"], SPREAD) for c in names]} if d in found else {"prior": 0.0 if total else 1 / len(DOMAINS)}
        for d in DOMAINS
    ]


def posteriors(model: list[dict], names: list[str]) -> Column:
    """An array with the posterior of each domain."""
    scores = []
    for m in model:
        s = F.lit(math.log(m["prior"]) if m["prior"] else -1e9)
        for c, mean, sd in zip(names, m.get("mean", []), m.get("sd", []), strict=False):
            s = s - F.pow((F.col(c) - F.lit(mean)) / F.lit(sd), 2) / 2 - F.lit(math.log(sd))
        scores.append(s)
    top = F.greatest(*scores)
    weights = [F.exp(s - top) for s in scores]
    total = sum(weights[1:], weights[0])
    return F.array(*[w / total for w in weights])


def rate(moves: list[np.ndarray], floor: float) -> Column:
    """A document's rate after the steps so far: from 1, each step subtracts p . move and keeps it at ``floor`` or above."""
    start = F.lit(max(1.0, floor))
    if not moves:
        return start
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in m]) for m in moves])
    p = F.col("p")
    dot = lambda m: sum((p[k] * m[k] for k in range(1, len(DOMAINS))), p[0] * m[0])
    return F.aggregate(steps, start, lambda r, m: F.greatest(F.lit(float(floor)), r - dot(m)))


def nearest_move(docs: DataFrame, share: np.ndarray, asked: np.ndarray, floor: float) -> np.ndarray | None:
    """The one step after which the tokens of the domains ``asked`` have exactly the shares; None if no rates from ``floor`` on have them.

    Rates max(floor, start + p . m), with m orthogonal to the shares, are those nearest to the start. m minimises a
    convex function whose gradient is the tokens' part orthogonal to the shares: Newton steps, halved until it falls.
    """
    k, at = len(DOMAINS), np.flatnonzero(asked)
    if len(at) < 2:
        return np.zeros(k)
    free = np.zeros((k, len(at) - 1))
    free[at] = np.linalg.svd(share[at][None])[2][1:].T  # directions orthogonal to the shares
    p, low, start = F.col("p"), float(floor), max(1.0, floor)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def sums(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Value, tokens per domain and second moments of the documents above the floor."""
        x, t = F.col("x"), F.col("tokens")
        value = t * F.when(x >= low, x * x / 2).otherwise(x * low - low * low / 2)
        above = F.when(x >= low, t).otherwise(0.0)
        terms = [value, *[t * p[i] * F.greatest(x, F.lit(low)) for i in range(k)], *[above * p[i] * p[j] for i, j in pairs]]
        moved = sum((p[i] * float(m[i]) for i in range(1, k)), p[0] * float(m[0]))
        row = np.array(docs.select("tokens", "p", (moved + start).alias("x")).agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in terms]).first(), float)
        second = np.zeros((k, k))
        for (i, j), v in zip(pairs, row[1 + k :], strict=True):
            second[i, j] = second[j, i] = v
        return row[0], row[1 : 1 + k], second

    m = np.zeros(k)
    value, got, second = sums(m)
    for _ in range(STEPS):
        slope = free.T @ got
        if np.abs(slope).max() <= CLOSE * got[at].sum():
            return -m
        way = -np.linalg.pinv(free.T @ second @ free, hermitian=True) @ slope
        falls, length = float(slope @ way), 1.0
        if not falls < 0:  # nothing above the floor can be moved
            return None
        while True:
            there = m + length * (free @ way)
            found = sums(there)
            if found[0] <= value + 1e-4 * length * falls + 1e-12 * abs(value):
                break
            length /= 2
            if length < 1e-6:
                return None
        m, (value, got, second) = there, found
    return None


def mixing_rates(documents: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = None, floor: float = 0.0) -> DataFrame:
    """(doc_id, tokens, p_<domain>..., rate) of every row; a repeated doc_id gives a row each time.

    ``budget`` is the number of expected tokens wanted in the domains of ``targets``; None keeps that of the documents,
    or with a ``floor`` of 1 takes what the rates nearest to 1 need to have the shares.
    """
    rows = stored(measured(documents), "measures")
    names = [c for c in rows.columns if c not in ("doc_id", "tokens")]
    model = fit_domains(rows, labels, names)
    docs = stored(rows.select("doc_id", "tokens", posteriors(model, names).alias("p")), "posteriors")
    k = len(DOMAINS)

    def expected(moves: list[np.ndarray]) -> np.ndarray:
        r = docs.select("tokens", "p", rate(moves, floor).alias("r"))
        row = r.agg(*[F.coalesce(F.sum(F.col("tokens") * F.col("p")[i] * F.col("r")), F.lit(0.0)) for i in range(k)]).first()
        return np.array(row, float)

    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    second = docs.agg(*[F.coalesce(F.sum(F.col("tokens") * F.col("p")[i] * F.col("p")[j]), F.lit(0.0)) for i, j in pairs]).first()
    square = np.zeros((k, k))
    for (i, j), v in zip(pairs, second, strict=True):
        square[i, j] = square[j, i] = v
    now = square.sum(axis=1)  # tokens per domain at rate 1
    named = np.array([d in targets for d in DOMAINS])
    share = np.array([targets.get(d, 0.0) for d in DOMAINS]) * (now > 0)
    share = share / share.sum() if share.sum() else share
    moves: list[np.ndarray] = []
    only_shares = budget is None and floor >= 1
    move = nearest_move(docs, share, named & (now > 0), floor) if only_shares and share.sum() else None
    if move is not None:
        moves = [move]
    else:
        if budget is None:
            budget = float(now[named].sum()) if floor < 1 else max((n / s for n, s in zip(now, share, strict=True) if s), default=0.0)
        want = share * budget
        # distances are weighted by the inverse of the second moments: with documents measured by their tokens the
        # curvature is then 1, and a step of length 1 is a safe gradient step however unequal the domains are
        inverse = np.zeros((k, k))
        inverse[np.ix_(named, named)] = np.linalg.pinv(square[np.ix_(named, named)], hermitian=True)
        for _ in range(STEPS):
            gap = (expected(moves) - want) * named
            if np.abs(gap).max(initial=0.0) <= CLOSE * max(budget, 1.0):
                break
            moves.append(inverse @ gap)
    got = expected(moves) * named
    reached = got / got.sum() if got.sum() else got
    asked = np.array([targets.get(d, 0.0) for d in DOMAINS]) / (sum(targets.values()) or 1.0)
    if got.sum() and np.abs(reached - asked).max() > MISSED:
        warnings.warn("mixing missed its targets: " + ", ".join(f"{d} {r:.4f} of {w:.4f}" for d, r, w, n in zip(DOMAINS, reached, asked, named, strict=True) if n), stacklevel=2)
    return docs.select("doc_id", "tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], rate(moves, floor).alias("rate"))


def mixed(documents: DataFrame, labels: DataFrame, targets: dict[str, float] = KEPT_TARGETS) -> DataFrame:
    """``documents`` as they are read in one pass of the mixture: every row at least once, others as often as their rate.

    Rates are at least 1, so no document is lost, and as large as the shares ask for; the fraction of a rate becomes one
    more copy for that share of ids, by a hash of the id. Columns and texts stay as they are.
    """
    rates = mixing_rates(documents, labels, targets, floor=1.0)
    # rows of one id have equal rates only if their texts are equal: the mean serves all of them
    rates = rates.groupBy("doc_id").agg(F.avg("rate").alias("_rate")).withColumnRenamed("doc_id", "_id")
    share = F.pmod(F.xxhash64("_id", F.lit("mixing")), F.lit(1_000_000)) / 1_000_000
    copies = (F.floor("_rate") + (share < F.col("_rate") - F.floor("_rate")).cast("long")).cast("int")
    times = F.coalesce(copies, F.lit(1))
    joined = documents.join(rates, documents["doc_id"].eqNullSafe(rates["_id"]), "left")
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).select(*[documents[c] for c in documents.columns])
