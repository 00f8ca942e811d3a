"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled text are told apart by a small network over text statistics that minimises the
non-negative unbiased risk: with class prior p, the risk of calling a text bad is estimated from the unlabelled texts
less p times that of the positives, and when this estimate falls below zero the step goes against it, so that the
network doesn't learn the unlabelled texts by heart.

Every text that isn't held out counts as unlabelled. The driver doesn't get their rows, but cells: texts on the same side
of each of ``PLANES`` random planes through the mean are one cell, which one of them stands for with the weight of all, so
that what it gets is bounded while all texts have their weight. The prior is estimated from positives and unlabelled texts
alone: a first network scores them all, and the share of unlabelled texts above a score, over the share of positives above
it, is nearest the prior where it is least.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, materialise, text_or_empty

#: Most labelled positives that the fit takes.
FIT_POSITIVES = 6000
#: Planes between the cells of unlabelled texts: 2 ** PLANES cells at most, each 200 bytes. Rows of a step at once.
PLANES, BLOCK_ROWS = 14, 1 << 16
HIDDEN, STEPS, RATE, DECAY, SEED = 16, 300, 0.03, 1e-4, 5
#: The prior for the first network and where none can be estimated, the bounds of its estimate, the estimate's confidence.
DEFAULT_PRIOR, PRIOR_BOUNDS, DOUBT = 0.5, (0.05, 0.95), 0.1
#: Standardised statistics are cut off here. Bins of scores that the prior is estimated from.
MOST, BINS = 8.0, 4096

_CLASS = np.zeros((256, 9))
for _i, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:", b"!?", b"#$%&*@^~+=", b"|<>{}[]\\/_", b" \t", b"\n\r")):
    _CLASS[list(_set), _i] = 1
FEATURES = 22


def text_features(text: str) -> list[float]:
    """Statistics of a whole text: kinds of characters, words and their repeats, lines."""
    raw = text.encode("utf-8")
    words = raw.split()
    if not words:
        return [0.0] * FEATURES
    upper, lower, digit, stop, cry, sign, frame, space, line = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS
    n, w = len(raw), len(words)
    distinct = len(set(words))
    again = sum(map(bytes.__eq__, words, words[1:]))
    lengths = np.fromiter(map(len, words), np.int64, w)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ended = sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines)
    alpha = upper + lower + 1
    return [
        float(x)
        for x in (
            upper / alpha, digit / n, stop / w, cry / w, sign / w, frame / w, space / n, line / w, (n - upper - lower - digit - stop - cry - sign - frame - space - line) / n,
            np.log1p(w), lengths.mean(), lengths.std(), (lengths > 15).mean(), (lengths < 2).mean(), again / w, distinct / w, np.log(distinct + 1) / np.log(w + 2),
            1 - len(set(lines)) / max(1, len(lines)), ended / max(1, len(lines)), np.log1p(w / max(1, len(lines))), min(1.0, sign / w) ** 0.5, min(1.0, cry / w) ** 0.5,
        )
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x (array of statistics) of every row; null text is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "x": [text_features(t) for t in batch["text"]]})

    found = id_and_text(docs, id_col, text_col).mapInPandas(run, "doc_id string, x array<double>")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((np.clip((x - self.mean) / self.scale, -MOST, MOST)) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_non_negative(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = SEED, moments: tuple[np.ndarray, np.ndarray] | None = None, weights_of_u: np.ndarray | None = None) -> Model:
    """Minimises the non-negative unbiased risk with the logistic loss, by full-batch Adam steps.

    ``moments`` are the statistics' means and deviations, by default those of the rows given; ``weights_of_u`` how many
    texts each row of ``unlabelled`` stands for, by default one.
    """
    rng = np.random.default_rng(seed)
    if moments is None:
        every = np.concatenate([positive, unlabelled])
        moments = every.mean(0), every.std(0)
    mean, scale = moments[0], moments[1] + 1e-6
    p, u = (np.clip((x - mean) / scale, -MOST, MOST) for x in (positive, unlabelled))
    part = np.full(len(u), 1 / len(u)) if weights_of_u is None else weights_of_u / weights_of_u.sum()
    weights = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]

    def back(x: np.ndarray, hidden: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        inner = slope[:, None] * weights[2] * (1 - hidden**2)
        return [x.T @ inner, inner.sum(0), hidden.T @ slope, np.array([slope.sum()])]

    blocks = [(u[i : i + BLOCK_ROWS], part[i : i + BLOCK_ROWS]) for i in range(0, len(u), BLOCK_ROWS)]
    for step in range(1, STEPS + 1):
        hp = np.tanh(p @ weights[0] + weights[1])
        zp = hp @ weights[2] + weights[3]
        loss, of_u = 0.0, [np.zeros_like(w) for w in weights]
        for block, share in blocks:
            hu = np.tanh(block @ weights[0] + weights[1])
            zu = hu @ weights[2] + weights[3]
            loss += share @ np.logaddexp(0, zu)
            of_u = [a + b for a, b in zip(of_u, back(block, hu, _sigmoid(zu) * share), strict=True)]
        negative = loss - prior * np.logaddexp(0, zp).mean()
        at_p = -prior * _sigmoid(zp) / len(zp)  # slopes of the negative part
        if negative < 0:
            at_p, of_u = -at_p, [-x for x in of_u]
        else:
            at_p = at_p - prior * _sigmoid(-zp) / len(zp)
        grads = [a + b for a, b in zip(back(p, hp, at_p), of_u, strict=True)]
        for i, g in enumerate(grads):
            g = g + DECAY * weights[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            weights[i] = weights[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, weights[0], weights[1], weights[2], float(weights[3][0]), prior)


def _matrix(rows: DataFrame) -> np.ndarray:
    """The statistics of ``rows`` (x0, x1, ...) in a fixed order, whatever the order of the rows."""
    found = rows.toArrow()
    x = np.column_stack([found.column(i).to_numpy() for i in range(FEATURES)]).astype(float).reshape(-1, FEATURES)
    return x[np.lexsort(x.T[::-1])]


def estimate_prior(of_positives: np.ndarray, of_unlabelled: np.ndarray, weights: np.ndarray, doubt: float = DOUBT) -> float:
    """Share of positives among the unlabelled, from the scores of both by a network that ranks them.

    Above any score lie at least as many of the unlabelled as the positives among them, so that the share of the unlabelled
    above it over that of the positives bounds the prior. The bound is taken where it is least, with a margin for the
    chance in few rows (``doubt``: probability of an error beyond it).
    """
    n_p, n_u = len(of_positives), weights.sum()
    margin = np.sqrt(np.log(4 / doubt) / 2) * (1 / np.sqrt(n_p) + 1 / np.sqrt(n_u))
    at = np.unique(of_positives)
    above_p = 1 - np.searchsorted(np.sort(of_positives), at) / n_p
    order = np.argsort(of_unlabelled)
    below = np.concatenate([[0.0], np.cumsum(weights[order])])
    above_u = 1 - below[np.searchsorted(of_unlabelled[order], at)] / n_u
    best = np.argmin((above_u + margin) / above_p)
    return float(np.clip(above_u[best] / above_p[best], *PRIOR_BOUNDS))


def cells_of(rows: DataFrame, columns: list[str], mean: np.ndarray, scale: np.ndarray, planes: int = PLANES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """A row of each cell, that with the least ``place``, and the number of its rows, in the order of the cells' codes."""
    normals = np.random.default_rng(seed).normal(size=(planes, len(columns)))
    z = [F.greatest(F.least((F.col(c) - F.lit(float(m))) / F.lit(float(s)), F.lit(MOST)), F.lit(-MOST)) for c, m, s in zip(columns, mean, scale, strict=True)]
    standard = rows.select("place", F.struct(*columns).alias("own"), *(x.alias(c) for x, c in zip(z, columns, strict=True)))
    side = lambda normal: sum((F.col(c) * F.lit(float(v)) for c, v in zip(columns[1:], normal[1:], strict=True)), F.col(columns[0]) * F.lit(float(normal[0]))) > 0
    code = sum((F.shiftleft(side(n).cast("int"), i) for i, n in enumerate(normals[1:], 1)), side(normals[0]).cast("int"))
    first = F.min_by("own", F.struct("place", "own")).alias("own")
    found = standard.select("place", "own", code.alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), first).orderBy("cell").select("n", "own.*").toArrow()
    return np.column_stack([found.column(c).to_numpy() for c in columns]).astype(float).reshape(-1, len(columns)), found.column("n").to_numpy().astype(float)


def score_counts(rows: DataFrame, columns: list[str], model: Model) -> np.ndarray:
    """How many of all rows score in each of ``BINS`` bins of the model's logit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"bin": bins_of(model.logit(batch[columns].to_numpy(float)))})

    counts = rows.select(*columns).mapInPandas(run, "bin long").groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()
    out = np.zeros(BINS)
    for r in counts:
        out[r["bin"]] = r["n"]
    return out


def bins_of(logit: np.ndarray) -> np.ndarray:
    return np.clip((logit + 30) / 60 * BINS, 0, BINS - 1).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, positives: int = FIT_POSITIVES, planes: int = PLANES, seed: int = SEED) -> Model:
    """Fits on at most ``positives`` labelled good rows, those first in a seeded order, and on the cells of all rows.

    Rows held out (see ``is_held_out``) are not used at all; rows labelled bad count as unlabelled like all others, as do
    ids with contradicting labels. Without positives every text scores ``DEFAULT_PRIOR``. Half of the positives train the
    first network, the other half estimates the prior by it.
    """
    good = labels.where(~is_held_out()).groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = 1 and high = 1").select("doc_id")
    texts = docs.select("doc_id", text_or_empty().alias("text")).where(~is_held_out() & F.col("doc_id").isNotNull())
    every = features(texts).groupBy("doc_id").agg(F.min("x").alias("x"))
    every = materialise(every.select("doc_id", F.xxhash64("doc_id", F.lit(seed)).alias("place"), *(F.col("x")[i].alias(f"x{i}") for i in range(FEATURES))), "quality-features")
    columns = [f"x{i}" for i in range(FEATURES)]
    n, *found = every.agg(F.count(F.lit(1)), *(F.avg(c) for c in columns), *(F.stddev_pop(c) for c in columns)).first()
    p = _matrix(every.join(good, "doc_id", "left_semi").orderBy("place", "doc_id").limit(positives).select(*columns))
    if not len(p) or not n:
        zero = np.zeros(FEATURES)
        return Model(zero, zero + 1, np.zeros((FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(DEFAULT_PRIOR / (1 - DEFAULT_PRIOR))), DEFAULT_PRIOR)
    moments = np.array(found[:FEATURES], float), np.array(found[FEATURES:], float)
    u, weights = cells_of(every, columns, moments[0], moments[1] + 1e-6, planes, seed)
    half = p[::2], p[1::2] if len(p) > 1 else p
    first = fit_non_negative(half[0], u, DEFAULT_PRIOR, seed, moments, weights)
    counts = score_counts(every, columns, first)
    prior = estimate_prior(bins_of(first.logit(half[1])).astype(float), np.arange(BINS, dtype=float), counts)
    return fit_non_negative(p, u, prior, seed, moments, weights)


def rate(model: Model):
    """A function over a text column that gives its score."""

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([text_features(t) for t in texts], float).reshape(-1, FEATURES)))

    return scores


def classify(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per row of ``docs``.

    Null text is empty text, which is scored too. A null id is never held out. Repeated rows get equal scores. Only
    text enters a score. An empty table gives an empty result.
    """
    scored = docs.select("doc_id", rate(train(docs, labels, seed=seed))(text_or_empty()).alias("score"))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that score at least one half, with the columns of ``docs``."""
    return docs.where(rate(train(docs, labels, seed=seed))(text_or_empty()) >= 0.5)
