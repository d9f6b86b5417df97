"""A quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled 1; the unlabelled text is any text. With p the class prior, the risk of a scorer g is estimated without
negatives as p E_pos[loss(g)] + max(0, E_unl[loss(-g)] - p E_pos[loss(-g)]), the non-negative unbiased risk: where the second part
falls below zero, its gradient is turned to bring it back. The loss is logistic, so sigmoid(g) estimates the probability of label 1. The
scorer is a network of one hidden layer over figures of a text's form, fitted in numpy on the driver.

The prior is estimated from positives and unlabelled text alone. A logistic model of trusted positives against unlabelled text gives the ratio
of their densities; where texts are all of label 1, that ratio is one over the prior. Its median over positives that the model wasn't fitted
to is taken, both halves in turn, and shrunk towards one half by PSEUDO rows. Rows labelled 0 are never read.

Fitting reads a bounded sample: the SAMPLE labelled training rows and SAMPLE unlabelled training rows whose hashed ids are smallest. Training
rows are those whose crc32 of the id as text isn't 2 modulo 4. Only their figures, FIGURES numbers a row, go to the driver. Scoring
reads whole texts, and nothing but the text.

Defined results: a null or empty text is scored like any other, from figures of zero; repeated rows repeat their score; labels that are null
or other than 1 don't count; a table without training labels scores everything by the prior of one half; an empty table gives no rows. Very
long texts are read whole. Other columns pass through, whatever their names, but score, which is refused.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import TEXTS, materialize, refuse

SAMPLE, HIDDEN, STEPS, RATE, DECAY, SEED = 6000, 12, 600, 0.03, 1e-4, 11
THRESHOLD = 0.7
FIGURES = 22
PSEUDO = 10


def held_out(id_col: str) -> Column:
    """Whether a row's label is kept from learning."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def figures(text: str | None) -> np.ndarray:
    """A text's form in numbers near 0 to 1: its size, words, repetition, symbols, letters and lines."""
    out = np.zeros(FIGURES)
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    if not n:
        return out
    size = len(data)
    b = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lines = data.split(b"\n")
    counts = Counter(words)
    same = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    upper, lower, digit = b[65:91].sum(), b[97:123].sum(), b[48:58].sum()
    ends = sum(w[-1] in b"#*$%&|<>!" for w in words)
    solid = size - b[32] - b[9:14].sum()
    lengths = np.fromiter(map(len, words), np.int64, n)
    filled = [x for x in lines if x.strip()]
    out[:] = (
        np.log1p(n) / 8, len(counts) / n, same / n, pairs / max(1, n - 1), max(counts.values()) / n, min(1.0, lengths.mean() / 12), min(1.0, lengths.std() / 12),
        ends / n, min(1.0, 4 * sum(b[c] for c in b"#*$%&|<>") / solid), min(1.0, 10 * b[33] / solid), min(1.0, 10 * b[124] / solid),
        upper / max(1, upper + lower), digit / solid, min(1.0, 10 * (b[46] + b[44]) / solid), b[128:].sum() / solid, len(set(filled)) / max(1, len(filled)),
        min(1.0, len(lines) / (n + 1) * 5), float(n < 5), float(n < 50), sum(c for c in counts.values() if c > 3) / n, min(1.0, 20 * (b[123] + b[125] + b[61] + b[95]) / solid), 1.0,
    )
    return out


class Scorer:
    """g(x) = v . tanh(W x + c) + d over standardised figures."""

    def __init__(self, prior: float = 0.5) -> None:
        rng = np.random.default_rng(SEED)
        self.prior = prior
        self.mean, self.scale = np.zeros(FIGURES), np.ones(FIGURES)
        self.w = {"W": rng.normal(0, 1 / np.sqrt(FIGURES), (FIGURES, HIDDEN)), "c": np.zeros(HIDDEN), "v": np.zeros(HIDDEN), "d": np.full(1, np.log(prior / (1 - prior)))}

    def _g(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.w["W"] + self.w["c"])
        return h @ self.w["v"] + self.w["d"], h

    def scores(self, x: np.ndarray) -> np.ndarray:
        g, _ = self._g(np.clip((x - self.mean) / self.scale, -6, 6))
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))

    def risk(self, positive: np.ndarray, unlabelled: np.ndarray) -> tuple[float, float]:
        """The two parts of the unbiased risk on standardised figures: of positives, and what is left for negatives, before it is held at 0."""
        loss = lambda g: np.logaddexp(0, -g).mean()
        gp, gu = self._g(positive)[0], self._g(unlabelled)[0]
        return self.prior * loss(gp), loss(-gu) - self.prior * loss(-gp)

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray) -> Scorer:
        if not len(positive) or not len(unlabelled):
            return self
        both = np.concatenate([positive, unlabelled])
        self.mean, self.scale = both.mean(axis=0), both.std(axis=0) + 1e-3
        xp, xu = (np.clip((x - self.mean) / self.scale, -6, 6) for x in (positive, unlabelled))
        self.w["W"] = np.random.default_rng(SEED).normal(0, 1 / np.sqrt(FIGURES), (FIGURES, HIDDEN))
        self.w["v"] = np.random.default_rng(SEED + 1).normal(0, 0.1, HIDDEN)
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.w.items()}
        sigmoid = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        for step in range(1, STEPS + 1):
            (gp, hp), (gu, hu) = self._g(xp), self._g(xu)
            negative = np.logaddexp(0, gu).mean() - self.prior * np.logaddexp(0, gp).mean()
            ep, eu = np.zeros(len(gp)), sigmoid(gu) / len(gu)
            from_positive = -self.prior * (1 - sigmoid(gp)) / len(gp)
            from_negative = -self.prior * sigmoid(gp) / len(gp)
            ep, eu = (from_positive + from_negative, eu) if negative >= 0 else (-from_negative, -eu)
            grad = {k: DECAY * v if k != "d" else 0 * v for k, v in self.w.items()}
            for x, h, e in ((xp, hp, ep), (xu, hu, eu)):
                grad["d"] = grad["d"] + e.sum()
                grad["v"] = grad["v"] + h.T @ e
                back = e[:, None] * self.w["v"] * (1 - h * h)
                grad["c"] = grad["c"] + back.sum(axis=0)
                grad["W"] = grad["W"] + x.T @ back
            for k, g in grad.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                self.w[k] = self.w[k] - RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of label 1 in unlabelled text."""
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    ratios = []
    for part in (0, 1):
        p, u = positive[part::2], unlabelled[part::2]
        both = np.concatenate([p, u])
        mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
        inputs = lambda x: np.c_[np.clip((x - mean) / scale, -6, 6), np.ones(len(x))]  # noqa: B023, E731
        x, y = inputs(both), np.r_[np.ones(len(p)), np.zeros(len(u))]
        weight = np.r_[np.full(len(p), 0.5 / len(p)), np.full(len(u), 0.5 / len(u))]
        theta, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], DECAY)
        for _ in range(40):  # Newton's steps
            q = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            theta -= np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (q - y)) + ridge * theta)
        ratios.append(np.exp(np.clip(inputs(positive[1 - part :: 2]) @ theta, -30, 30)))
    found = 1 / np.median(np.concatenate(ratios))
    n = len(positive)
    return float((min(1.0, found) * n + 0.5 * PSEUDO) / (n + PSEUDO))


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([figures(t.as_py()).tolist() for t in batch.column(1)], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), found], ["positive", "x"])


def _smallest(ids: DataFrame, n: int) -> DataFrame:
    """The n distinct values of _id whose hashes are smallest. Only ids below a bound that somewhat more than n pass are told apart and sorted."""
    there = ids.agg(F.approx_count_distinct("_id").alias("n")).first()["n"]
    near = ids.where(F.xxhash64("_id") / float(1 << 64) + 0.5 <= (1.25 * n + 100) / max(1, there))
    return near.distinct().orderBy(F.xxhash64("_id"), "_id").limit(n)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Scorer:
    """A scorer from trusted positives and unlabelled text of the training rows."""
    training = lambda df: df.where(~held_out(id_col) & F.col(id_col).isNotNull())
    named = lambda df: df.select(F.col(id_col).cast("long").alias("_id"))
    trusted = _smallest(named(training(labels).where(F.col(label_col) == 1)), sample)
    chosen = materialize(trusted.withColumn("positive", F.lit(True)).unionByName(_smallest(named(training(docs)), sample).withColumn("positive", F.lit(False))), "quality-sample")
    texts = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))  # 2 * sample rows at most
    found = texts.select("_id", "positive", "text").dropDuplicates(["_id", "positive"]).select("positive", "text").mapInArrow(_figures, "positive boolean, x array<double>")
    rows = materialize(found, "quality-figures", TEXTS).collect()
    rows.sort(key=lambda r: (r["positive"], r["x"]))  # the same rows in any order give the same scorer
    pick = lambda p: np.array([r["x"] for r in rows if r["positive"] == p]).reshape(-1, FIGURES)
    shuffled = [x[np.random.default_rng(SEED).permutation(len(x))] for x in (pick(True), pick(False))]
    return Scorer(estimated_prior(*shuffled)).fit(*shuffled)


class _Scored:
    def __init__(self, scorer: Scorer, names: list[str], at: int) -> None:
        self.scorer, self.names, self.at = scorer, names, at

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([figures(t.as_py()) for t in batch.column(self.at)]).reshape(-1, FIGURES)
            rest = [c for k, c in enumerate(batch.columns) if k != self.at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(self.scorer.scores(x), pa.float64())], self.names)


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """docs without the text, with score."""
    refuse(docs, {"score"})
    schema = docs.drop(text_col).selectExpr("*", "0D AS score").schema
    return docs.mapInArrow(_Scored(scorer, schema.names, docs.columns.index(text_col)), schema)
