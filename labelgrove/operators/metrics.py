"""Masked multi-label metrics over long observations (item, node, y, score).

A row exists only where the label is observed, so the mask is the presence of the row.
Every metric works from one pre-aggregated table of counts; no metric sorts raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelgrove.operators.ranges import running_sums

UNOBSERVED = "unobserved"
NO_POSITIVES = "no_positives"
NO_NEGATIVES = "no_negatives"
REASONS = (UNOBSERVED, NO_POSITIVES, NO_NEGATIVES)


def positives(y: str = "y") -> Column:
    return F.count_if(F.col(y)).cast("long")


def require_scores(obs: DataFrame, score: str = "score") -> DataFrame:
    """Fail on NaN or null scores of observed pairs (masked pairs have no row)."""
    bad = F.col(score).isNull() | F.isnan(F.col(score))
    return obs.withColumn(score, F.when(
        bad, F.raise_error(F.lit("score of an observed label is missing or NaN"))
    ).otherwise(F.col(score)))


def require_probability(obs: DataFrame, score: str = "score") -> DataFrame:
    """Fail on scores that are NaN, null or outside [0, 1]."""
    ok = F.col(score).between(0.0, 1.0)
    return obs.withColumn(score, F.when(ok, F.col(score)).otherwise(
        F.raise_error(F.lit("calibration needs probabilities in [0, 1]")).cast("double")))


def skip_reason(n: Column, n_pos: Column) -> Column:
    """Why a class has no ranking metric; null when it has one."""
    return (F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(UNOBSERVED))
            .when(n_pos == 0, F.lit(NO_POSITIVES))
            .when(n_pos == n, F.lit(NO_NEGATIVES)))


def class_counts(obs: DataFrame, keys: list[str] | None = None,
                 nodes: DataFrame | None = None) -> DataFrame:
    """Per class: observed, positive and the skip reason; `nodes` adds unobserved classes."""
    keys = keys or ["node"]
    counts = obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_observed"),
                                    positives().alias("n_positive"))
    if nodes is not None:
        counts = nodes.select(*keys).join(counts, keys, "left").fillna(
            0, ["n_observed", "n_positive"])
    return counts.withColumn("skipped", skip_reason(F.col("n_observed"), F.col("n_positive")))


def tie_groups(obs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per distinct score of a class: rows and positives that share it."""
    weight = F.col("w") if "w" in obs.columns else F.lit(1).cast("long")
    return (obs.groupBy(*keys, "score")
            .agg(F.sum(weight).alias("n"),
                 F.sum(F.when(F.col("y"), weight).otherwise(F.lit(0))).alias("tp")))


def precision_curve(ties: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulative counts down the ranking, ties taken together (last row of each tie)."""
    return running_sums(ties, keys, [F.col("score").desc()], {"n": "cum_n", "tp": "cum_tp"})


def average_precision(obs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Tie-aware AP = sum over distinct scores of (recall step) x (precision), per key.

    An optional column `w` weights rows like repeating them. Null AP where a class lacks
    positives or negatives.
    """
    keys = ["node"] if keys is None else keys
    return ap_from_ties(tie_groups(obs, keys), keys)


def ap_from_ties(ties: DataFrame, keys: list[str]) -> DataFrame:
    """`average_precision` from the table of distinct scores."""
    curve = precision_curve(ties, keys).select(
        *keys, "n", "tp", (F.col("tp") * F.col("cum_tp") / F.col("cum_n")).alias("part"))
    totals = curve.groupBy(*keys).agg(F.sum("n").alias("n_observed"),
                                      F.sum("tp").alias("n_positive"),
                                      F.sum("part").alias("part"))
    reason = skip_reason(F.col("n_observed"), F.col("n_positive"))
    return totals.select(*keys, "n_observed", "n_positive", reason.alias("skipped"),
                         F.when(reason.isNull(), F.col("part") / F.col("n_positive")).alias("ap"))


def per_class_ap(obs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """AP per node with its skip reason; `nodes` adds classes that were never observed."""
    ap = average_precision(obs)
    if nodes is None:
        return ap
    full = nodes.select("node").join(ap, "node", "left").fillna(0, ["n_observed", "n_positive"])
    return full.withColumn("skipped", skip_reason(F.col("n_observed"), F.col("n_positive")))


def macro(per_class: DataFrame, value: str = "ap", by: list[str] | None = None) -> DataFrame:
    """Mean over scored classes, with how many were skipped and why."""
    return per_class.groupBy(*(by or [])).agg(
        F.avg(value).alias("value"),
        F.count(F.lit(1)).alias("n_classes"),
        F.count_if(F.col("skipped").isNotNull()).alias("n_skipped"),
        *[F.count_if(F.col("skipped") == r).alias(f"n_{r}") for r in REASONS])


def micro_average_precision(obs: DataFrame) -> DataFrame:
    """AP over one pool of all observed (item, class) pairs; null only without positives."""
    return micro_from_ties(tie_groups(obs.select("y", "score"), []))


def micro_from_ties(ties: DataFrame) -> DataFrame:
    """`micro_average_precision` from distinct scores of any classes."""
    pool = ap_from_ties(ties.groupBy("score").agg(F.sum("n").alias("n"),
                                                           F.sum("tp").alias("tp")), [])
    all_positive = (F.col("n_positive") == F.col("n_observed")) & (F.col("n_observed") > 0)
    return pool.select("n_observed", "n_positive",
                       F.when(all_positive, F.lit(1.0)).otherwise(F.col("ap")).alias("ap"))


def threshold_counts(obs: DataFrame, threshold: float | None = 0.5,
                     thresholds: DataFrame | None = None,
                     keys: list[str] | None = None) -> DataFrame:
    """TP/FP/FN per class at `score >= threshold`; per-class `thresholds(node, thr)` optional."""
    keys = keys or ["node"]
    if thresholds is not None:
        obs = obs.join(thresholds, "node")
        hit = F.col("score") >= F.col("thr")
    else:
        hit = F.col("score") >= F.lit(threshold)
    return obs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_observed"), positives().alias("n_positive"),
        F.count_if(hit & F.col("y")).alias("tp"),
        F.count_if(hit & ~F.col("y")).alias("fp"),
        F.count_if(~hit & F.col("y")).alias("fn"))


def with_prf(counts: DataFrame, skip: bool = True) -> DataFrame:
    """Precision, recall, F1: P = 0 when nothing was predicted, all null for skipped classes."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    if not skip:
        return counts.withColumns({"precision": p, "recall": r, "f1": f1})
    reason = skip_reason(F.col("n_observed"), F.col("n_positive"))
    scored = reason.isNull()
    return counts.withColumns({"skipped": reason, "precision": F.when(scored, p),
                               "recall": F.when(scored, r), "f1": F.when(scored, f1)})


def prf_at_threshold(obs: DataFrame, threshold: float | None = 0.5,
                     thresholds: DataFrame | None = None) -> DataFrame:
    return with_prf(threshold_counts(obs, threshold, thresholds))


def micro_prf(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pooled P/R/F1 including classes the macro mean skips.

    F1 is null only when nothing was predicted and nothing was positive.
    """
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    pooled = counts.groupBy(*(by or [])).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return pooled.withColumns({
        "precision": F.when(tp + fp > 0, tp / (tp + fp)),
        "recall": F.when(tp + fn > 0, tp / (tp + fn)),
        "f1": F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn))})


def calibration_bins(obs: DataFrame, n_bins: int = 15, keys: list[str] | None = None) -> DataFrame:
    """Equal-width bins: count, mean score and positive rate. p = 1 falls in the last bin."""
    p = require_probability(obs)
    b = F.least(F.floor(F.col("score") * n_bins), F.lit(n_bins - 1)).cast("int")
    return p.withColumn("bin", b).groupBy(*(keys or []), "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("sum_score"),
        positives().alias("n_positive"))


def ece_from_bins(bins: DataFrame, keys: list[str] | None = None) -> DataFrame:
    gap = F.abs(F.col("n_positive") - F.col("sum_score"))
    return bins.groupBy(*(keys or [])).agg((F.sum(gap) / F.sum("n")).alias("ece"),
                                           F.sum("n").alias("n"))


def expected_calibration_error(obs: DataFrame, n_bins: int = 15,
                               keys: list[str] | None = None) -> DataFrame:
    """Count-weighted mean gap between positive rate and mean score over the bins."""
    return ece_from_bins(calibration_bins(obs, n_bins, keys), keys)


def calibratable(obs: DataFrame) -> DataFrame:
    """Drop classes that were only ever observed positive; classes without positives stay."""
    keep = class_counts(obs).where(
        F.col("skipped").isNull() | (F.col("skipped") == NO_POSITIVES)).select("node")
    return obs.join(keep, "node", "left_semi")


def classwise_ece(obs: DataFrame, n_bins: int = 15) -> DataFrame:
    per_class = expected_calibration_error(obs, n_bins, ["node"])
    return per_class.agg(F.avg("ece").alias("ece"), F.count(F.lit(1)).alias("n_classes"))


def brier(obs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    gap = F.col("score") - F.col("y").cast("double")
    return obs.groupBy(*(keys or [])).agg(F.avg(gap * gap).alias("brier"),
                                          F.count(F.lit(1)).alias("n"))


def random_ap(n: Column, k: Column) -> Column:
    """Exact expected AP of a random ranking of n items with k positives (k >= 1).

    E[AP] = ((k-1)/(n-1)) + H_n (n-k) / (n (n-1)), and 1 when n = 1. The harmonic number H_n is the
    asymptotic series at n + 16 less the sixteen terms 1/(n+1) to 1/(n+16) (error below 1e-13).
    """
    nd, kd = n.cast("double"), k.cast("double")
    far = nd + 16
    h = (F.ln(far) + F.lit(0.5772156649015329) + 1 / (2 * far) - 1 / (12 * far * far)
         + 1 / (120 * F.pow(far, F.lit(4))) - 1 / (252 * F.pow(far, F.lit(6))))
    for i in range(1, 17):
        h = h - 1 / (nd + i)
    return (F.when(k < 1, F.raise_error(F.lit("random AP needs a positive")).cast("double"))
            .when(n == 1, F.lit(1.0))
            .otherwise((kd - 1) / (nd - 1) + h * (nd - kd) / (nd * (nd - 1))))


def per_node_chance(obs: DataFrame) -> DataFrame:
    """Prevalence, chance AP, AP and lift over prevalence per class."""
    ap = average_precision(obs)
    prev = F.col("n_positive") / F.col("n_observed")
    return ap.select(
        "node", "n_observed", "n_positive", prev.alias("prevalence"), "ap", "skipped",
        F.when(F.col("n_positive") > 0,
               random_ap(F.col("n_observed"), F.greatest(F.col("n_positive"), F.lit(1)))
               ).alias("chance_ap"),
        F.when(prev < 1, (F.col("ap") - prev) / (1 - prev)).alias("lift"))


def brier_from_ties(ties: DataFrame, keys: list[str]) -> DataFrame:
    n, tp, s = F.col("n"), F.col("tp"), F.col("score")
    return ties.groupBy(*keys).agg(
        (F.sum(tp * (1 - s) * (1 - s) + (n - tp) * s * s) / F.sum("n")).alias("brier"))


def positive_ranks(obs: DataFrame) -> DataFrame:
    """Rank of every positive among the observed items of its class; ties share the best rank."""
    curve = precision_curve(tie_groups(obs, ["node"]), ["node"]).select(
        "node", F.col("score"), (F.col("cum_n") - F.col("n") + 1).alias("rank"),
        F.col("tp"))
    ranks = curve.where(F.col("tp") > 0).select("node", "score", "rank")
    return obs.where(F.col("y")).join(ranks, ["node", "score"]).select(
        "node", "item", "score", "rank")


def node_report(obs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """AP and threshold metrics of every class in one table."""
    ap = average_precision(obs).select("node", "ap")
    return prf_at_threshold(obs, threshold).join(ap, "node")
