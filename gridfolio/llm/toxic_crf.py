"""Toxic spans and document scores from a linear-chain conditional random field.

States are *plain* and *toxic*. A token's features are hashes of the word and of its first 3 to 7 bytes; features
that labelled toxic documents have far oftener than the others form a lexicon, and the tokens of toxic documents that
carry one are the labelled tokens the field is fitted on. Tokens without a lexicon feature all have the same
potentials, so forward-backward jumps over runs of them with a power of one 2 x 2 matrix: the marginals are exact and
the work per text is a hash lookup per token. The expected number of toxic tokens and the largest marginal give the
document's score through a logistic regression, and runs of marginals of at least 0.5 are the offending offsets.

Fitting reads at most ``SAMPLE`` labelled documents, those of the smallest hash of their id, and keeps at most
``LEXICON`` features. Everything else covers all rows.

Defined cases: null, empty and wordless texts have no toxic token and get the score of that; labels that are null are
not learnt from; several labels of a document count as toxic if one is; without labels of both kinds every score is
0.5. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from gridfolio.llm.common import _BYTE_CODES, _POWERS, GOLDEN, chunks, mix, stored

SAMPLE, LEXICON = 12_000, 4096
PREFIXES = (3, 4, 5, 6, 7)
#: A feature is kept if (toxic documents with it) x (its log odds) is at least this, so some five documents at least.
EVIDENCE, LEAST_ODDS = 20.0, 1.0
ROUNDS = 40
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))

SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("length", IntegerType())]))
RESULT = StructType([StructField("score", DoubleType()), StructField("toxic_tokens", DoubleType()), StructField("spans", SPANS)])


@dataclass
class Tokens:
    """Tokens of some texts: text, number inside the text, byte range, and feature hashes (tokens, features)."""

    text: np.ndarray
    number: np.ndarray
    start: np.ndarray
    end: np.ndarray
    features: np.ndarray
    counts: np.ndarray
    base: np.ndarray  # where each text begins in the joined bytes


def tokens(texts: list[str]) -> Tokens:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b" ".join([*raw, b""]).translate(_FOLD), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)
    word = np.concatenate([[False], buf != 32, [False]])
    turn = np.flatnonzero(word[1:] != word[:-1])
    start, end = turn[::2], turn[1::2]
    up, down = _POWERS.get(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[buf] * up[: len(buf)], dtype=np.uint64, out=sums[1:])
    columns = [mix((sums[end] - sums[start]) * down[start])]
    for k in PREFIXES:  # a word of no more bytes has no prefix feature: 0 stands for none
        cut = mix((sums[np.minimum(start + k, end)] - sums[start]) * down[start] + np.uint64(int(GOLDEN) * k % 2**64))
        columns.append(np.where(end - start > k, cut, np.uint64(0)))
    text = np.searchsorted(base, start, "right") - 1
    counts = np.bincount(text, minlength=len(texts))
    number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return Tokens(text, number, start, end, np.stack(columns, 1) if len(text) else np.zeros((0, 1 + len(PREFIXES)), np.uint64), counts, base)


@dataclass
class Field:
    """Weights of the toxic state: per lexicon feature, per token, for entering, staying and leaving."""

    lexicon: np.ndarray
    weights: np.ndarray
    own: float = -4.0
    enter: float = -1.0
    stay: float = 0.5
    final: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.lexicon & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def events(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Tokens with a lexicon feature, and the place of each feature in the lexicon, -1 for others."""
        if not len(self.lexicon):
            return np.zeros(0, np.int64), np.zeros((0, t.features.shape[1]), np.int64)
        maybe = np.flatnonzero(self.seen[(t.features & np.uint64((1 << 20) - 1)).astype(np.int64)].any(axis=1))
        f = t.features[maybe]
        at = np.minimum(np.searchsorted(self.lexicon, f), len(self.lexicon) - 1)
        at = np.where(self.lexicon[at] == f, at, -1)
        some = (at >= 0).any(axis=1)
        return maybe[some], at[some]

    def emissions(self, places: np.ndarray) -> np.ndarray:
        return np.where(places >= 0, self.weights[places], 0.0).sum(axis=1) if len(self.weights) else np.zeros(len(places))

    def power(self, n: np.ndarray) -> np.ndarray:
        """(len(n), 2, 2) powers of the step of a token without features, scaled by the larger eigenvalue."""
        m = np.array([[1.0, np.exp(self.enter + self.own)], [1.0, np.exp(self.stay + self.own)]])
        mean, det = np.trace(m) / 2, np.linalg.det(m)
        root = np.sqrt(max(mean * mean - det, 1e-18))
        one, two = mean + root, mean - root
        first, second = (m - two * np.eye(2)) / (one - two), (one * np.eye(2) - m) / (one - two)
        return first + ((two / one) ** n)[:, None, None] * second, np.log(one) * n

    def forward_backward(self, text: np.ndarray, number: np.ndarray, emit: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginal of the toxic state per event, and log Z per text (texts without events included)."""
        n_texts = len(counts)
        n_events = np.bincount(text, minlength=n_texts)
        first = np.cumsum(n_events) - n_events
        gap = number.copy()
        inner = np.ones(len(text), bool)
        inner[first[n_events > 0]] = False
        gap[inner] = number[inner] - number[np.flatnonzero(inner) - 1]
        gain = np.exp(np.minimum(emit, 60.0))
        step, scale = self.power(gap)
        rest, rest_scale = self.power(np.maximum(counts - 1 - np.where(n_events > 0, number[np.maximum(first + n_events - 1, 0)] if len(number) else 0, 0), 0))
        log_z = rest_scale + np.bincount(text, scale, n_texts)
        begin = np.array([1.0, np.exp(self.own)])
        ahead, back = np.zeros((len(text), 2)), np.zeros((len(text), 2))
        state = np.tile(begin, (n_texts, 1))
        order = np.argsort(-n_events, kind="stable")
        most = int(n_events.max(initial=0))
        for k in range(most):
            at = order[: np.searchsorted(-n_events[order], -k, "left")]
            e = first[at] + k
            v = np.einsum("ij,ijk->ik", state[at], step[e])
            v[:, 1] *= gain[e]
            total = v.sum(axis=1)
            state[at] = ahead[e] = v / total[:, None]
            log_z[at] += np.log(total)
        ends = np.einsum("ij,ijk->i", state, rest)
        log_z += np.log(ends)
        after = rest.sum(axis=2)
        for k in range(most - 1, -1, -1):
            at = order[: np.searchsorted(-n_events[order], -k, "left")]
            e = first[at] + k
            back[e] = after[at]
            v = after[at].copy()
            v[:, 1] *= gain[e]
            v = np.einsum("ijk,ik->ij", step[e], v)
            after[at] = v / v.sum(axis=1)[:, None]
        both = ahead * back
        return both[:, 1] / both.sum(axis=1) if len(text) else np.zeros(0), log_z

    def evidence(self, text: np.ndarray, marginal: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected toxic tokens, columns of the document regression)."""
        expected = np.bincount(text, marginal, len(counts))
        largest = np.zeros(len(counts))
        np.maximum.at(largest, text, marginal)
        return expected, np.stack([np.ones(len(counts)), np.log(expected + 1e-3), largest, np.log((expected + 0.05) / (counts + 20))], 1)

    def score(self, texts: list[str]) -> list[tuple[float, float, list[tuple[int, int]]]]:
        t = tokens(texts)
        at, places = self.events(t)
        marginal, _ = self.forward_backward(t.text[at], t.number[at], self.emissions(places), t.counts)
        expected, x = self.evidence(t.text[at], marginal, t.counts)
        score = 1 / (1 + np.exp(-np.clip(x @ self.final, -30, 30)))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        last: dict[int, int] = {}
        for e in np.flatnonzero(marginal >= 0.5):
            i, n = int(t.text[at[e]]), int(t.number[at[e]])
            a, b = int(t.start[at[e]] - t.base[i]), int(t.end[at[e]] - t.base[i])
            if spans[i] and last[i] == n - 1:
                a = spans[i].pop()[0]
            spans[i].append((a, b))
            last[i] = n
        for i, found in enumerate(spans):  # bytes to code points
            if found and not texts[i].isascii():
                raw = np.frombuffer(texts[i].encode("utf-8", "surrogatepass"), np.uint8)
                places_ = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                spans[i] = [(int(places_[a]), int(places_[b])) for a, b in found]
        return [(float(s), float(e), [(a, b - a) for a, b in found]) for s, e, found in zip(score, expected, spans, strict=True)]


# Fitting --------------------------------------------------------------------------


def sample_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(id, toxic) of at most ``sample`` labelled documents, in the order of a hash of the id."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    return one.orderBy(F.xxhash64("id"), "id").limit(sample)


def feature_counts(train: DataFrame) -> DataFrame:
    """(feature, toxic, plain): in how many documents of ``train(text, toxic)`` of either kind a feature occurs."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic = [x or "" for x in batch.column(0).to_pylist()], np.array(batch.column(1).to_pylist(), np.int64)
            for group in chunks(texts, 1 << 18):  # their features are many times as large
                t = tokens([texts[i] for i in group])
                owner, name = np.repeat(t.text, t.features.shape[1]), t.features.ravel()
                order = np.lexsort((owner, name))
                owner, name = owner[order], name[order]
                new = np.ones(len(name), bool)
                new[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])
                owner, name = owner[new & (name != 0)], name[new & (name != 0)]
                kinds, where = np.unique(name, return_inverse=True)
                bad = toxic[np.array(group)][owner]
                yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(np.bincount(where, bad, len(kinds)).astype(np.int64)), pa.array(np.bincount(where, 1 - bad, len(kinds)).astype(np.int64))], ["feature", "toxic", "plain"])

    return train.select("text", "toxic").mapInArrow(emit, "feature long, toxic long, plain long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))


def training_events(train: DataFrame, field_: Field) -> DataFrame:
    """(toxic, n_tokens, number, places) per document of the sample: its tokens with lexicon features."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic = [x or "" for x in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            for group in chunks(texts):
                t = tokens([texts[i] for i in group])
                at, places = field_.events(t)
                by = np.split(np.arange(len(at)), np.cumsum(np.bincount(t.text[at], minlength=len(group)))[:-1])
                yield pa.RecordBatch.from_arrays([pa.array([toxic[i] for i in group], pa.int64()), pa.array(t.counts.astype(np.int64)), pa.array([t.number[at[b]] for b in by], pa.list_(pa.int64())), pa.array([places[b].ravel() for b in by], pa.list_(pa.int64()))], ["toxic", "n_tokens", "number", "places"])

    return train.select("text", "toxic").mapInArrow(emit, "toxic long, n_tokens long, number array<long>, places array<long>")


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """The field of the labelled documents. Only the bounded sample, its counts and the lexicon reach the driver."""
    few = stored(sample_labels(labels, sample), "labels")
    # at most ``sample`` rows of two numbers
    train = stored(documents.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(few), "id").select("text", F.col("toxic").cast("long").alias("toxic")).limit(2 * sample), "train")
    n_toxic, n = train.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if n_toxic in (0, n):
        return Field(np.zeros(0, np.uint64), np.zeros(0))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1) * (n - n_toxic + 1) / (F.col("plain") + 0.5))
    best = feature_counts(train).withColumn("odds", odds).where((F.col("odds") >= LEAST_ODDS) & (F.col("odds") * F.col("toxic") >= EVIDENCE))
    best = best.orderBy((F.col("odds") * F.col("toxic")).desc(), "feature").limit(LEXICON).select("feature", "odds").toPandas()
    lexicon = best["feature"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(lexicon)
    model = Field(lexicon[order], best["odds"].to_numpy(float)[order] / 2)
    rows = training_events(train, model).toPandas()
    toxic, counts = rows["toxic"].to_numpy(), rows["n_tokens"].to_numpy()
    sizes = rows["number"].map(len).to_numpy()
    text = np.repeat(np.arange(len(rows)), sizes)
    number = np.concatenate([np.zeros(0, np.int64), *rows["number"]]).astype(np.int64)
    places = np.concatenate([np.zeros(0, np.int64), *rows["places"]]).astype(np.int64).reshape(len(number), 1 + len(PREFIXES))
    said = toxic[text] == 1  # the labelled tokens
    follows = np.zeros(len(text), bool)
    follows[1:] = said[1:] & said[:-1] & (text[1:] == text[:-1]) & (number[1:] == number[:-1] + 1)
    n_stay, n_enter = follows.sum(), (said & ~follows & (number > 0)).sum()

    def likelihood(m: Field, all_z: float | None = None) -> float:
        z = m.forward_backward(text, number, m.emissions(places), counts)[1].sum() if all_z is None else all_z
        return m.emissions(places)[said].sum() + m.own * said.sum() + m.stay * n_stay + m.enter * n_enter - z

    speed = {k: 0.0 for k in ("own", "enter", "stay")}
    pace = np.full(len(model.weights), 1e-6)
    for _ in range(ROUNDS):  # steepest ascent with a step size per weight
        marginal, z = model.forward_backward(text, number, model.emissions(places), counts)
        slope = np.zeros(len(model.weights) + 1)
        np.add.at(slope, places.ravel(), np.repeat(said - marginal, places.shape[1]))
        slope = slope[:-1] - 0.5 * model.weights
        here, moves = likelihood(model, z.sum()), {}
        for k in speed:
            near = Field(model.lexicon, model.weights, **({"own": model.own, "enter": model.enter, "stay": model.stay} | {k: getattr(model, k) + 1e-4}))
            moves[k] = (likelihood(near) - here) / 1e-4 - 0.1 * getattr(model, k)
        pace += slope**2
        model.weights = model.weights + 0.3 * slope / np.sqrt(pace)
        for k, g in moves.items():
            speed[k] += g * g
            setattr(model, k, getattr(model, k) + 0.3 * g / np.sqrt(speed[k] + 1e-6))
    marginal, _ = model.forward_backward(text, number, model.emissions(places), counts)
    _, x = model.evidence(text, marginal, counts)
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton steps of a logistic regression held near 0
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.05 * np.eye(len(w)), x.T @ (toxic - p) - 0.05 * w)
    model.final = w
    return model


# Scoring --------------------------------------------------------------------------


def toxicity(model: Field, text: Column) -> Column:
    """A struct (score, toxic_tokens, spans) per text: whole texts, a batch of them at a time."""

    @F.pandas_udf(RESULT)
    def scores(texts: pd.Series) -> pd.DataFrame:
        values = [x or "" for x in texts]
        out: list = [None] * len(values)
        for group in chunks(values):
            for i, row in zip(group, model.score([values[i] for i in group]), strict=True):
                out[i] = row
        return pd.DataFrame(out, columns=["score", "toxic_tokens", "spans"])

    return scores(text)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def toxic_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, toxic_tokens, spans) of every row of ``documents``."""
    model = fit(documents, labels.where(~held_out(F.col("doc_id"))))
    scored = documents.select("doc_id", toxicity(model, F.col("text")).alias("t"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "t.score", (F.col("t.score") >= threshold).cast("int").alias("predicted"), "t.toxic_tokens", "t.spans")
