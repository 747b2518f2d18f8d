"""Quality classifier: Bradley-Terry scores learned from preference pairs.

A pair prefers a document of label 1 over one of label 0 and, by Bradley-Terry,
does so with probability sigmoid(w . (x_i - x_j)); w minimises the logistic loss
of the feature differences plus a ridge term. The decision threshold is the
score that parts as many labelled rows below it as have label 0. Scores map to
0..1 so that it falls on 0.7.

Learning uses every labelled row that is not held out, and all their pairs, in
Newton steps: of a row, the sums over its partners need only its score, so each
step sums rows by label and narrow bins of scores (at most BINS a label), and
pairs bins with bins. The threshold is selected exactly, by counts in bins that
narrow down on it. Only sums and counts reach the driver, however many rows.
Features are built-in functions of the whole text alone, as logarithms, so that
a long or extreme text moves a score ever less but has no value beyond which
nothing counts; no label, language, source or id is an input of a score.

Defined cases: null and empty texts have the features of an empty text and a
score like any other; null ids are never held out nor learned from; repeated
rows are scored each; with no labels of one kind the score is 0.7 everywhere
(prefer all); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import held_out, space_words, written

BINS = 1024
WIDTH = 1 / 32  # of a bin of scores, unless that makes more than BINS
STEPS = 40
RIDGE = 1e-3
THRESHOLD = 0.7
FEATURES = ["chars", "symbols", "bangs", "pipes", "uppers", "digits", "lines", "mean_word", "distinct", "distinct_share", "stops"]


def _left(text: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(text, drop, ""))


def features(text: Column) -> Column:
    """A struct of FEATURES for each whole text."""
    text = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    words = space_words(text)
    n_words = F.greatest(F.size(words), F.lit(1))
    root = F.sqrt(n_words.cast("double"))
    values = [
        F.length(text),
        _left(text, r"[^#*$%&<>@^~=]+") / n_words,
        _left(text, r"[^!]+") / n_words,
        _left(text, r"[^|]+") / n_words,
        _left(text, r"[^A-Z]+") / n,
        _left(text, r"[^0-9]+") / n,
        _left(text, r"[^\n]+") / n_words,
        F.length(F.array_join(words, "")) / n_words,
        F.size(F.array_distinct(words)) / root,
        F.size(F.array_distinct(words)) / n_words,
        _left(text, r"[^.]+") / n_words,
    ]
    return F.array(*[F.log1p(v.cast("double")) for v in values])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), features(F.col("text")).alias("x"))


def _raw(model: dict) -> Column:
    """A row's score before it is mapped to 0..1."""
    raw = F.lit(-float(model["cut"]))
    for i, (w, mean, std) in enumerate(zip(model["w"], model["mean"], model["std"], strict=True)):
        raw = raw + (F.get("x", F.lit(i)) - mean) / std * w
    return raw


def _binned(rows: DataFrame, w: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For label 0 and label 1: how many rows (quality, z) each bin of scores has, the sums of z, and of its products."""
    k = len(FEATURES)
    least, most = np.minimum(w * low, w * high).sum(), np.maximum(w * low, w * high).sum()  # no score lies beyond
    width = float(max(WIDTH, (most - least) / BINS))
    z = [F.get("z", F.lit(i)) for i in range(k)]
    raw = sum((x * float(v) for x, v in zip(z, w, strict=True)), F.lit(0.0))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.count("*").cast("double"), *[F.sum(x) for x in z], *[F.sum(z[i] * z[j]) for i, j in pairs]]
    found = rows.groupBy("quality", F.floor(raw / width).alias("bin")).agg(F.array(*sums).alias("s")).collect()
    found.sort(key=lambda r: (r["quality"], r["bin"]))
    out = []
    for label in (0, 1):
        s = np.array([r["s"] for r in found if r["quality"] == label], np.float64)
        products = np.zeros((len(s), k, k))
        for n, (i, j) in enumerate(pairs):
            products[:, i, j] = products[:, j, i] = s[:, 1 + k + n]
        out.append((s[:, 0], s[:, 1 : 1 + k], products))
    return out


def _step(binned: list[tuple[np.ndarray, np.ndarray, np.ndarray]], w: np.ndarray) -> tuple[float, np.ndarray]:
    """The loss over all pairs, and Newton's step down from w."""
    (n0, x0, q0), (n1, x1, q1) = binned
    apart = (x1 @ w / n1)[:, None] - (x0 @ w / n0)[None]
    pairs = n0.sum() * n1.sum()
    p = 1 / (1 + np.exp(np.clip(apart, -500, 500)))
    slope = p * (1 - p)
    loss = n1 @ np.logaddexp(0, -apart) @ n0 / pairs + RIDGE * (w @ w) / 2
    gradient = (x0.T @ (n1 @ p) - x1.T @ (p @ n0)) / pairs + RIDGE * w
    cross = x1.T @ slope @ x0
    hessian = (np.tensordot(slope @ n0, q1, 1) + np.tensordot(n1 @ slope, q0, 1) - cross - cross.T) / pairs + RIDGE * np.eye(len(w))
    return float(loss), -np.linalg.solve(hessian, gradient)


def _weights(rows: DataFrame, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where the loss over all pairs of rows (quality, z) is least; a step that does not lower it is halved."""
    w = at = np.zeros(len(FEATURES))
    best, step = math.inf, w
    for _ in range(STEPS):
        loss, down = _step(_binned(rows, w, low, high), w)
        if loss <= best + 1e-6:  # bins, unlike steps, are no finer
            at, best, step = w, loss, down
        else:
            step = step / 2
        w = at + step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _cut(scores: DataFrame, n: int) -> float:
    """Midway between the n-th score (from 1, of column s) and the one after it."""
    low, high = scores.agg(F.min("s"), F.max("s")).first()
    behind = 0
    while low < high:  # bins of the range that holds the n-th; the least and the greatest score never share one
        place = F.least(F.floor((F.col("s") - low) / ((high - low) / BINS)), F.lit(BINS - 1))
        for r in scores.filter(F.col("s").between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).orderBy("bin").collect():
            low, high = r["low"], r["high"]
            if behind + r["n"] >= n:
                break
            behind += r["n"]
    upto, after = scores.agg(F.count_if(F.col("s") <= low), F.min(F.when(F.col("s") > low, F.col("s")))).first()
    return (low + (low if upto > n or after is None else after)) / 2


def _trained(rows: DataFrame, labels: DataFrame) -> dict:
    """Learn from all labelled rows of (doc_id, x) that are not held out."""
    k = len(FEATURES)
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality").distinct()
    rows = rows.select("doc_id", "x").join(known, "doc_id").groupBy("quality", "doc_id").agg(F.min("x").alias("x"))  # one row of an id, however often it stands
    rows = written(rows.select("quality", "x"), "labelled")
    x = [F.get("x", F.lit(i)) for i in range(k)]
    known = [f(v).cast("double") for f in (F.avg, F.stddev_pop, F.min, F.max) for v in x]
    bad, good, *known = rows.agg(F.count_if(F.col("quality") == 0), F.count_if(F.col("quality") == 1), *known).first()
    if not good or not bad:
        return {"w": [0.0] * k, "mean": [0.0] * k, "std": [1.0] * k, "cut": 0.0}
    mean, std, low, high = np.array(known, np.float64).reshape(4, k)
    std = std + 1e-6
    z = F.array(*[(v - float(m)) / float(s) for v, m, s in zip(x, mean, std, strict=True)])
    w = _weights(written(rows.select("quality", z.alias("z")), "standardised"), (low - mean) / std, (high - mean) / std)
    model = {"w": w.tolist(), "mean": mean.tolist(), "std": std.tolist(), "cut": 0.0}
    return model | {"cut": _cut(written(rows.select(_raw(model).alias("s")), "scores"), bad)}


def train(docs: DataFrame, labels: DataFrame) -> dict:
    return _trained(_rows(docs), labels)


def _scored(rows: DataFrame, model: dict) -> DataFrame:
    shifted = _raw(model) + math.log(THRESHOLD / (1 - THRESHOLD))
    rows = rows.select("doc_id", "held_out", (1 / (1 + F.exp(-shifted))).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    return _scored(_rows(docs), model)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = written(_rows(docs), "features")
    return _scored(rows, _trained(rows, labels))
