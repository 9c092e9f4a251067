"""Fitting calibration maps from aggregates over distinct scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from labelgrove.functions.scores import binary_loss, logit
from labelgrove.operators.scan import exact_percentile

T_MIN, T_MAX = 0.05, 20.0
GRID = 40
A_BOUNDS = (1e-3, 50.0)
B_BOUNDS = (-50.0, 50.0)
#: Digits of stored scores, and the mean gradient at which a fit stops.
DIGITS, GRADIENT = 6, 1e-12


def score_counts(obs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, z, n, k): rows and positives per distinct score, as logits."""
    return (obs.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("n"),
                                            F.count_if("y").alias("k"))
            .withColumn("z", logit(F.col("score"))))


def _best_temperature(counts: DataFrame, keys: list[str], centres: DataFrame | None,
                      log_width: float) -> DataFrame:
    """Lowest-loss temperature on a log grid: around each key's centre, or over the whole range."""
    step = log_width / GRID
    grid = F.sequence(F.lit(0), F.lit(GRID))
    if centres is None:
        temp = F.exp(F.ln(F.lit(T_MIN)) + F.col("g") * step)
        rows = counts.withColumn("g", F.explode(grid)).withColumn("t", temp)
    else:
        near = (counts.join(centres, keys) if keys
                else counts.withColumn("temperature", centres.select("temperature").scalar()))
        rows = near.withColumn("g", F.explode(grid)).withColumn(
            "t", F.least(F.greatest(F.exp(F.ln("temperature") - log_width / 2 + F.col("g") * step),
                                    F.lit(T_MIN)), F.lit(T_MAX)))
    z = F.col("z") / F.col("t")
    loss = (F.col("k") * binary_loss(z, F.lit(1.0))
            + (F.col("n") - F.col("k")) * binary_loss(z, F.lit(0.0)))
    losses = rows.groupBy(*keys, "g", "t").agg(F.sum(loss).alias("loss"), F.sum("n").alias("n"),
                                               F.sum("k").alias("k"))
    return losses.groupBy(*keys).agg(
        F.min_by("t", F.struct("loss", "g")).alias("temperature"), F.min("loss").alias("loss"),
        F.max("n").alias("n"), F.max("k").alias("k"))


def fit_temperatures(obs: DataFrame, keys: list[str], rounds: int = 2) -> DataFrame:
    """(keys, temperature, loss): masked cross-entropy of sigmoid(logit / T), T in [0.05, 20].

    The loss is an aggregate over distinct scores, so a whole grid of T is one pass; each further
    round searches between the neighbours of the best point. Keys without both classes keep 1.
    `keys` = ['level'] fits per level, no keys fit one global temperature.
    """
    from math import log
    counts = score_counts(obs, keys)
    width = log(T_MAX / T_MIN)
    best = _best_temperature(counts, keys, None, width)
    for _ in range(rounds - 1):
        width = 2 * width / GRID
        best = _best_temperature(counts, keys, best.select(*keys, "temperature"), width)
    both = (F.col("k") > 0) & (F.col("k") < F.col("n"))
    return best.select(*keys, F.when(both, F.col("temperature")).otherwise(F.lit(1.0))
                       .alias("temperature"), (F.col("loss") / F.col("n")).alias("loss"))


def exact_counts(obs: DataFrame, keys: list[str]) -> DataFrame:
    """`score_counts` of scores with six digits, as predictions are stored: at most 1,000,001 rows per key."""
    return score_counts(obs.withColumn("score", F.round("score", DIGITS)), keys)


def _loss(s: np.ndarray, n: np.ndarray, k: np.ndarray) -> float:
    return float((n * (np.maximum(s, 0) + np.log1p(np.exp(-np.abs(s)))) - k * s).sum())


def _sigmoid(s: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(s))
    return np.where(s >= 0, 1 / (1 + e), e / (1 + e))


def best_inverse_temperature(z: np.ndarray, n: np.ndarray, k: np.ndarray) -> float:
    """Minimum of the convex loss over 1 / T, by Newton steps kept inside a shrinking bracket."""
    low, high = 1 / T_MAX, 1 / T_MIN

    def slope(x):
        p = _sigmoid(x * z)
        return (z * (n * p - k)).sum() / n.sum(), (z * z * n * p * (1 - p)).sum() / n.sum()
    if slope(low)[0] >= 0:
        return low
    if slope(high)[0] <= 0:
        return high
    x = 1.0
    for _ in range(200):
        g, h = slope(x)
        low, high = (x, high) if g < 0 else (low, x)
        if abs(g) < GRADIENT or high - low < 1e-15:
            break
        step = x - g / h if h > 0 else low
        x = step if low < step < high else (low + high) / 2
    return x


def exact_temperatures(obs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, temperature, loss, gradient): the best T in [0.05, 20] per key, to the stop of the gradient.

    Keys without both classes keep 1. No keys fit one temperature for all.
    """
    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        z, n, k = (pdf[c].to_numpy(float) for c in ("z", "n", "k"))
        x = best_inverse_temperature(z, n, k) if 0 < k.sum() < n.sum() else 1.0
        g = float((z * (n * _sigmoid(x * z) - k)).sum() / n.sum())
        return pd.DataFrame([(*key, 1 / x, _loss(x * z, n, k) / n.sum(), g)], columns=[*keys, "temperature", "loss", "gradient"])
    counts = exact_counts(obs, keys)
    schema = StructType([*[counts.schema[k] for k in keys], *[StructField(c, DoubleType()) for c in ("temperature", "loss", "gradient")]])
    return counts.groupBy(*keys).applyInPandas(fit, schema)


def best_platt(z: np.ndarray, n: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) within their bounds and the gradient there, by Newton steps on the parameters that no
    bound holds, each halved until the loss falls."""
    low, high = np.array([A_BOUNDS, B_BOUNDS]).T
    x, inputs, total = np.array([1.0, 0.0]), np.column_stack([z, np.ones_like(z)]), n.sum()
    for _ in range(200):
        p = _sigmoid(inputs @ x)
        g = inputs.T @ (n * p - k) / total
        free = ~((x <= low) & (g > 0) | (x >= high) & (g < 0))
        if not free.any() or np.abs(g[free]).max() < GRADIENT:
            break
        h = (inputs * (n * p * (1 - p))[:, None]).T @ inputs / total
        d = np.zeros(2)
        d[free] = -np.linalg.solve(h[np.ix_(free, free)] + 1e-14 * np.eye(free.sum()), g[free])
        if not np.isfinite(d).all() or g @ d >= 0:
            d = np.where(free, -g, 0)
        here, size = _loss(inputs @ x, n, k), 1.0
        while size > 1e-12 and _loss(inputs @ np.clip(x + size * d, low, high), n, k) > here:
            size /= 2
        if size <= 1e-12:
            break
        x = np.clip(x + size * d, low, high)
    return x, np.where(free, g, 0.0)


def fit_platt(obs: DataFrame, key: str = "node") -> DataFrame:
    """(key, a, b) of sigmoid(a logit(p) + b) per class, optimal also where a or b ends at its bound.

    A class is one call over its distinct scores, of which six digits leave at most a million.
    Identity for classes with one label value or one score.
    """
    def fit(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        z, n, k = (pdf[c].to_numpy(float) for c in ("z", "n", "k"))
        (a, b), _ = best_platt(z, n, k) if 0 < k.sum() < n.sum() and np.ptp(z) > 0 else ((1.0, 0.0), None)
        return pd.DataFrame([(*group, a, b)], columns=[key, "a", "b"])
    counts = exact_counts(obs, [key])
    schema = StructType([counts.schema[key], StructField("a", DoubleType()), StructField("b", DoubleType())])
    return counts.groupBy(key).applyInPandas(fit, schema)


def class_weights(obs: DataFrame) -> DataFrame:
    """(node, weight): clamp(negatives / positives, 1, 20) over observed training labels."""
    counts = obs.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.count_if("y").alias("k"))
    ratio = (F.col("n") - F.col("k")) / F.greatest(F.col("k"), F.lit(1))
    return counts.select("node", F.greatest(F.lit(1.0), F.least(F.lit(20.0), ratio)).alias("weight"))


def distill_gate(labels: DataFrame, pairs: DataFrame, teacher: DataFrame | None = None,
                 quantile: float | None = None) -> DataFrame:
    """(item, node) a teacher may fill in: unobserved strict descendants of observed positives.

    With `quantile`, only where the teacher's score reaches that quantile of the node.
    """
    below = pairs.where("depth > 0").select("node", "ancestor")
    if teacher is None:
        open_ = labels.where("y").select("item", F.col("node").alias("ancestor")).join(below, "ancestor").select("item", "node").distinct()
        return open_.join(labels.select("item", "node"), ["item", "node"], "left_anti")
    rest = [c for c in teacher.columns if c not in ("item", "node")]
    if quantile is not None:
        cut = exact_percentile(teacher, ["node"], "score", quantile, "cut")
        teacher = teacher.join(F.broadcast(cut), "node").where(F.col("score") >= F.col("cut")).drop("cut")
    # an item has labels for at most the nodes of the tree, so they fit one row
    known = labels.groupBy("item").agg(F.collect_set("node").alias("known"), F.collect_set(F.when(F.col("y"), F.col("node"))).alias("positive"))
    above = below.groupBy("node").agg(F.collect_set("ancestor").alias("above"))
    scored = teacher.join(F.broadcast(above), "node").join(known.where(F.size("positive") > 0), "item")
    gate = scored.where(~F.array_contains("known", F.col("node")) & F.arrays_overlap("above", "positive"))
    return gate.select("item", "node", *rest) if quantile is None else gate.select("node", "item", *rest)
