"""Column arithmetic on scores: logits, losses, calibration maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLIP = 1e-6


def logit(p: Column) -> Column:
    c = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
    return F.ln(c) - F.log1p(-c)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def binary_loss(z: Column, y: Column) -> Column:
    """Cross-entropy of a logit against a 0/1 target, safe for large |z|."""
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def apply_temperature(scores: DataFrame, temperatures: DataFrame, on: str = "level",
                      trained: DataFrame | None = None) -> DataFrame:
    """Scores rescaled by a temperature per level; with `trained`, other nodes stay raw."""
    out = scores.join(temperatures.select(on, "temperature"), on, "left")
    scaled = sigmoid(logit(F.col("score")) / F.coalesce("temperature", F.lit(1.0)))
    if trained is not None:
        out = out.join(trained.select("node", F.lit(True).alias("__t")), "node", "left")
        scaled = F.when(F.col("__t"), scaled).otherwise(F.col("score"))
    return out.withColumn("score", scaled).select(*scores.columns)


def apply_platt(scores: DataFrame, fits: DataFrame) -> DataFrame:
    """Scores through sigmoid(a logit + b) per node; nodes without a fit pass through raw."""
    out = scores.join(fits.select("node", "a", "b"), "node", "left")
    has = F.col("a").isNotNull()
    return out.select(*[c for c in scores.columns if c != "score"], F.when(
        has, sigmoid(F.col("a") * logit(F.col("score")) + F.col("b"))).otherwise(F.col("score"))
        .alias("score"), has.alias("calibrated"))


def gain_on_log_features(features: Column, gain: Column) -> Column:
    """Apply a linear gain to log1p features exactly: log1p(g * expm1(x))."""
    return F.transform(features, lambda x: F.log1p(gain * F.expm1(x)))


def power_db(x: Column) -> Column:
    """Decibels of a power; null for silence."""
    return F.when(x > 0, 10 * F.log10(x))


def drive_label(residual: Column) -> Column:
    """clean / distorted from the nonlinear residual, null in between."""
    return F.when(residual <= 0.03, "clean").when(residual >= 0.10, "distorted")
