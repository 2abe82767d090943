"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents of quality 1 and the unlabelled set is web text as it comes. The model, one small
hidden layer over statistics of the text and over its words, hashed into `BUCKETS` signed sums, minimises the non-negative
unbiased risk: prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)).

The class prior, the share of good documents in the unlabelled set, is estimated from the two samples alone: a model that
tells positives from unlabelled rows ranks those that it was not trained on, and above a threshold c the share of
unlabelled rows over the share of positives bounds the prior from above; the threshold with the least bound, plus what
chance allows for the sizes of the samples, gives the estimate. Labels of quality 0 are not used.

Only statistics of a bounded sample go to the driver (`SAMPLE` positives and as many unlabelled rows, the first by a
hash of their ids); scoring covers every row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.llm.common import add_columns, small_parts, tidy, with_fields
from sentrylake.llm.words import batch_words

SAMPLE = 20_000
PRIOR_SAMPLE = 8_000  # rows of each side that the prior is estimated from
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
BUCKETS = 64
_NON_WORD = re.compile(r"[^\w\s]")


def held_out(id_column: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string")) % folds == fold, F.lit(False))


def statistics(text: str | None) -> list[float]:
    """Shares of marks, capitals, repeats and the like over the whole text."""
    text = text or ""
    words = text.split()
    n, m = max(1, len(text)), max(1, len(words))
    marks = _NON_WORD.findall(text)
    plain = text.count(".") + text.count(",") + text.count("'") + text.count("-")
    lines = text.count("\n") + 1
    shouted = sum(map(str.isupper, words))
    again = sum(map(eq, words, words[1:]))
    distinct = len(set(words))
    letters = n - len(marks) - (m - 1)
    return [
        shouted / m,
        again / m,
        distinct / m,
        distinct / m**0.7,
        len(marks) / n,
        (len(marks) - plain) / n,
        (len(marks) - plain) / m,
        plain / m,
        text.count("!") / m,
        text.count("?") / m,
        text.count("|") / m,
        (text.count("#") + text.count("$") + text.count("%") + text.count("&") + text.count("*")) / m,
        (text.count("<") + text.count(">") + text.count("{") + text.count("}") + text.count("=")) / m,
        (text.count("http") + text.count("www.") + text.count("@")) / m,
        sum(map(text.count, "0123456789")) / n,
        letters / m / 10,
        np.log1p(m) / 10,
        np.log1p(n / lines) / 10,
        lines / m,
        text.count("�") / n,
        float(not text.strip()),
    ]


WIDTH = len(statistics("")) + BUCKETS


def inputs(column: pa.Array) -> np.ndarray:
    """A row of statistics and hashed words for each text. A word adds 1 or -1 to its bucket; sums are over the root of the words."""
    words = batch_words(column)
    n = len(column)
    row = np.repeat(np.arange(n), np.diff(words.first))
    at = row * BUCKETS + (words.hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
    sign = ((words.hashes >> np.uint64(40)) & np.uint64(1)).astype(float) * 2 - 1
    sums = np.bincount(at, weights=sign, minlength=n * BUCKETS).reshape(n, BUCKETS)
    own = np.array([statistics(t) for t in column.to_pylist()]).reshape(n, WIDTH - BUCKETS)
    return np.hstack((own, sums / np.sqrt(np.maximum(np.diff(words.first), 1))[:, None]))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def non_negative_risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The risk of scores of positives and unlabelled rows with logistic loss, and the direction of its descent for each score.

    Where the part of the negatives is below zero the risk leaves it out, and the direction climbs it back.
    """
    as_negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    as_positive = prior * np.logaddexp(0, -zp).mean()
    if as_negative >= 0:
        return as_positive + as_negative, prior * (sigmoid(zp) - 1) / len(zp) - prior * sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)
    return as_positive, prior * sigmoid(zp) / len(zp), -sigmoid(zu) / len(zu)


def contrast_risk(zp: np.ndarray, zu: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log loss of telling positives from unlabelled rows, both sides of one weight."""
    value = (np.logaddexp(0, -zp).mean() + np.logaddexp(0, zu).mean()) / 2
    return value, (sigmoid(zp) - 1) / len(zp) / 2, sigmoid(zu) / len(zu) / 2


def descend(positive: np.ndarray, unlabelled: np.ndarray, risk, start: float, hidden: int = 16, steps: int = 1000, seed: int = 7, decay: float = 1e-4) -> dict:
    """Full-batch Adam on a risk of both sides' scores. `start` is the score before any step."""
    width = positive.shape[1]
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    rng = np.random.default_rng(seed)
    weights = {"w": rng.normal(0, 1 / np.sqrt(width), (width, hidden)), "b": np.zeros(hidden), "v": rng.normal(0, 0.25, hidden), "c": np.array(start)}
    m1 = {k: np.zeros_like(v) for k, v in weights.items()}
    m2 = {k: np.zeros_like(v) for k, v in weights.items()}

    def forward(x):
        h = np.tanh(x @ weights["w"] + weights["b"])
        return h, h @ weights["v"] + weights["c"]

    def backward(x, h, dz):
        dh = np.outer(dz, weights["v"]) * (1 - h * h)
        return {"w": x.T @ dh, "b": dh.sum(0), "v": h.T @ dz, "c": dz.sum()}

    for step in range(1, steps + 1):
        hp, zp = forward(p)
        hu, zu = forward(u)
        _, dp, du = risk(zp, zu)
        gp, gu = backward(p, hp, dp), backward(u, hu, du)
        rate = 0.01 * min(1, 2 - 2 * step / steps)
        for k in weights:
            g = gp[k] + gu[k] + (decay * weights[k] if k in "wv" else 0)
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g * g
            weights[k] = weights[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return {"mean": mean, "scale": scale, **weights}


def least_bound(positive: np.ndarray, unlabelled: np.ndarray, chance: float = 0.1) -> float:
    """The prior from scores of both sides: above each score, the unlabelled share over the positives'; the one that is least with what
    chance allows."""
    p, u = np.sort(positive), np.sort(unlabelled)
    above_p = 1 - np.searchsorted(p, p, side="left") / len(p)
    above_u = 1 - np.searchsorted(u, p, side="left") / len(u)
    slack = np.sqrt(np.log(4 / chance) / 2 / len(u)) + np.sqrt(np.log(4 / chance) / 2 / len(p))
    return float(min(1.0, (above_u / above_p)[np.argmin((above_u + slack) / above_p)]))


def ranked(positive: np.ndarray, unlabelled: np.ndarray, risk, folds: int, **options) -> list[np.ndarray]:
    """Scores of both sides, each fold's by a model of the others."""
    found = [np.empty(len(x)) for x in (positive, unlabelled)]
    for k in range(folds):
        own = [np.arange(len(x)) % folds == k for x in (positive, unlabelled)]
        model = descend(positive[~own[0]], unlabelled[~own[1]], risk, 0.0, hidden=8, steps=300, **options)
        for x, mine, out in zip((positive, unlabelled), own, found):
            out[mine] = predict(model, x[mine])
    return found


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, folds: int = 3, rounds: int = 3, sample: int = PRIOR_SAMPLE) -> float:
    """The share of positives among the unlabelled rows, from the first `sample` rows of each; too few rows give a half.

    A first estimate comes from a model that tells the two apart. Models of the non-negative risk rank better, and take the
    estimate so far: these estimates swing about the right one, and their mean is taken.
    """
    p, u = positive[:sample], unlabelled[:sample]
    if min(len(p), len(u)) < 20 * folds:
        return 0.5
    found = [least_bound(*ranked(p, u, contrast_risk, folds, decay=3e-3))]
    for _ in range(rounds):
        found.append(least_bound(*ranked(p, u, lambda zp, zu: non_negative_risk(zp, zu, found[-1]), folds, decay=1e-3)))
    return float(np.mean(found[1:]))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, **options) -> dict:
    """The model of least non-negative risk; the prior is estimated if not given. Without positives every score is the prior."""
    if not len(positive) or not len(unlabelled):
        width, hidden, prior = positive.shape[1] if positive.ndim == 2 else WIDTH, 16, min(max(prior or 0.5, 0.01), 0.99)
        return {"mean": np.zeros(width), "scale": np.ones(width), "w": np.zeros((width, hidden)), "b": np.zeros(hidden), "v": np.zeros(hidden), "c": np.log(prior / (1 - prior)), "prior": prior}
    prior = float(min(max(estimate_prior(positive, unlabelled) if prior is None else prior, 0.01), 0.99))
    return descend(positive, unlabelled, lambda zp, zu: non_negative_risk(zp, zu, prior), np.log(prior / (1 - prior)), **options) | {"prior": prior}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8)
    return sigmoid(np.tanh(z @ model["w"] + model["b"]) @ model["v"] + model["c"])


def input_table(df: DataFrame, column: str, out: str) -> DataFrame:
    """Inputs as 32-bit floats, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in small_parts(batch, column)):
            made = [x.tobytes() for x in inputs(part.column(column)).astype("<f4")]
            yield add_columns(part, **{out: pa.array(made, type=pa.binary())})

    return df.mapInArrow(tidy(run), with_fields(df, **{out: "binary"}))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", column: str = "text", label: str = "quality", sample: int = SAMPLE) -> dict:
    """Fit on rows outside the held-out fold. Null labels are none; labels of quality 0 are not used; an id with several texts counts by
    the smallest. Without positives every score is the same."""
    known = labels.where(F.col(label) == 1).select(F.col(id_column).alias("id")).where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    texts = docs.select(F.col(id_column).alias("id"), F.col(column).alias("text")).where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    first = lambda d, role: d.select("id", F.lit(role).alias("role")).distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    # at most two samples of ids, so the broadcast is bounded
    chosen = first(known, 1).unionByName(first(texts, 0))
    # one text for each id, so that no id has more than one row of the sample
    one = texts.join(F.broadcast(chosen), "id").groupBy("id", "role").agg(F.min("text").alias("text"))
    got = input_table(one.select("role", "text"), "text", "x").select("role", "x").collect()
    matrix = lambda role: np.array([np.frombuffer(bytes(r.x), dtype="<f4") for r in got if r.role == role], dtype=float).reshape(-1, WIDTH)
    return train(matrix(1), matrix(0))


def score(docs: DataFrame, model: dict, id_column: str = "doc_id", column: str = "text", out: str = "score") -> DataFrame:
    """Add the score, 0 to 1, of every row's whole text; null text scores as the empty text.

    Repeated rows score alike, an empty table gives an empty one, texts of any length are read whole. Other columns are kept,
    whatever their names, but for one named `out`, which gives way.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in small_parts(batch, column)):
            x = inputs(part.column(column)).astype("<f4").astype(float)
            yield add_columns(part, **{out: pa.array(predict(model, x), type=pa.float64())})

    return docs.mapInArrow(tidy(run), with_fields(docs, **{out: "double"}))
