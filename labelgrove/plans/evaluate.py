"""Score a run: align predictions with labels, then derive every headline metric.

All metrics except the hierarchical ones come from one table of distinct (node, score) counts. It is
written once to the checkpoint folder, as the evaluated arrays of a run are archived anyway.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrove.operators import metrics as M
from labelgrove.operators import taxonomy as T
from labelgrove.operators.audit import label_prior, multiset_hash
from labelgrove.session import cut_lineage

CONFIDENT = 0.6
N_BINS = 15


def align(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Observed pairs with a score: inner join on (item, node)."""
    return labels.drop("score").join(predictions.select("item", "node", "score"), ["item", "node"])


def alignment_counts(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """How many items were evaluated, lack predictions, or were predicted without labels."""
    a = labels.select("item").distinct().withColumn("l", F.lit(True))
    b = predictions.select("item").distinct().withColumn("p", F.lit(True))
    both = a.join(b, "item", "full_outer")
    return both.agg(F.count_if(F.col("l") & F.col("p")).alias("n_evaluated"),
                    F.count_if(F.col("p").isNull()).alias("n_missing_predictions"),
                    F.count_if(F.col("l").isNull()).alias("n_extra_predictions"))


def require_unique(rows: DataFrame, what: str) -> None:
    """Fails if an (item, node) pair occurs more than once."""
    repeated = rows.groupBy("item", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if (row := repeated.first()) is not None:
        raise ValueError(f"{what}: item {row['item']}, node {row['node']} occurs {row['n']} times")


def node_table(ties: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per node: counts, AP, skip reason and TP/FP/FN at both thresholds."""
    ap = M.ap_from_ties(ties, ["node"]).select("node", "ap")

    def total(cond, col):
        return F.sum(F.when(cond, col).otherwise(0))

    n, tp = F.col("n"), F.col("tp")
    sums = [F.sum("n").alias("n_observed"), F.sum("tp").alias("n_positive")]
    for tag, thr in (("", threshold), ("_t60", CONFIDENT)):
        hit = F.col("score") >= thr
        sums += [total(hit, tp).alias(f"tp{tag}"), total(hit, n - tp).alias(f"fp{tag}"),
                 total(~hit, tp).alias(f"fn{tag}")]
    counts = ties.groupBy("node").agg(*sums)
    reason = M.skip_reason(F.col("n_observed"), F.col("n_positive"))
    out = counts.join(ap, "node").withColumns({"skipped": reason, "level": T.level_of("node")})
    for tag in ("", "_t60"):
        p, r, f = F.col(f"tp{tag}"), F.col(f"fp{tag}"), F.col(f"fn{tag}")
        out = out.withColumn(f"f1{tag}", F.when(reason.isNull(), F.when(
            2 * p + r + f > 0, 2 * p / (2 * p + r + f)).otherwise(0.0)))
    return out


def calibration_table(ties: DataFrame) -> DataFrame:
    """(node, level, bin) counts from distinct scores, without classes only seen positive."""
    ties = M.require_probability(ties)
    b = F.least(F.floor(F.col("score") * N_BINS), F.lit(N_BINS - 1)).cast("int")
    n, tp, s = F.col("n"), F.col("tp"), F.col("score")
    bins = ties.groupBy("node", b.alias("bin")).agg(
        F.sum("n").alias("n"), F.sum(s * n).alias("sum_score"), F.sum("tp").alias("n_positive"),
        F.sum(tp * (1 - s) * (1 - s) + (n - tp) * s * s).alias("sum_sq"))
    only_positive = bins.groupBy("node").agg(F.sum("n").alias("n"), F.sum("n_positive").alias("k"))
    dropped = only_positive.where("n = k").select("node")
    return bins.join(dropped, "node", "left_anti").withColumn("level", T.level_of("node"))


def summary(labels: DataFrame, scores: DataFrame, leaves: DataFrame,
            projected: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(metric, value) for all headline metrics of one run.

    `labels(item, node, y)`, `scores(item, node, score)`; `projected(node)` are the classes of the
    benchmark projection. Every branch ends in a one-row aggregate over node-sized tables.
    """
    ties = cut_lineage(M.tie_groups(align(labels, scores), ["node"]))
    per = node_table(ties, threshold).join(
        leaves.select("node", F.lit(True).alias("leaf")), "node", "left").withColumn(
        "leaf", F.coalesce("leaf", F.lit(False)))
    if projected is not None:
        per = per.join(projected.select("node", F.lit(True).alias("proj")), "node", "left")
    else:
        per = per.withColumn("proj", F.lit(None).cast("boolean"))
    leaf = F.col("leaf")

    def micro(tag):
        tp, fp, fn = (F.sum(F.when(leaf, F.col(f"{c}{tag}"))) for c in ("tp", "fp", "fn"))
        return F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn))

    headline = per.agg(
        F.avg("ap").alias("map_macro"), F.avg(F.when(leaf, F.col("ap"))).alias("map_leaf"),
        F.avg(F.when(leaf & (F.col("n_positive") >= 3), F.col("ap"))).alias("map_leaf_min3"),
        F.avg(F.when(leaf, F.col("f1"))).alias("f1_macro_leaf"), micro("").alias("f1_micro_leaf"),
        F.avg(F.when(leaf, F.col("f1_t60"))).alias("f1_macro_leaf_t60"),
        micro("_t60").alias("f1_micro_leaf_t60"),
        *[F.avg(F.when(F.col("level") == lv, F.col("ap"))).alias(f"map_level_{lv}")
          for lv in range(1, T.MAX_LEVEL + 1)],
        F.avg(F.when(F.col("proj"), F.col("ap"))).alias("projection_map"))
    pool = M.micro_from_ties(ties.join(leaves.select("node"), "node", "left_semi")).select(
        F.col("ap").alias("map_micro_leaf"))
    bins = calibration_table(ties)
    if projected is not None:
        bins = bins.join(projected.select("node", F.lit(True).alias("proj")), "node", "left")
    else:
        bins = bins.withColumn("proj", F.lit(None).cast("boolean"))
    scopes = F.array_compact(F.array(
        F.lit("ece"), F.concat(F.lit("ece_level_"), F.col("level").cast("string")),
        F.when(F.col("proj"), F.lit("projection_ece"))))
    pooled = (bins.withColumn("scope", F.explode(scopes)).groupBy("scope", "bin")
              .agg(*[F.sum(c).alias(c) for c in ("n", "sum_score", "n_positive")]))
    ece = M.ece_from_bins(pooled, ["scope"]).select(F.col("scope").alias("metric"),
                                                    F.col("ece").alias("value"))
    classwise = (M.ece_from_bins(bins, ["node"]).agg(F.avg("ece").alias("ece_classwise")))
    brier = bins.agg((F.sum("sum_sq") / F.sum("n")).alias("brier"))
    hier = T.hierarchical_prf(labels, scores, [threshold, CONFIDENT]).agg(*[
        F.max(F.when(F.col("threshold") == thr, F.col(c))).alias(name)
        for thr, c, name in ((threshold, "f1", "hier_f1"), (threshold, "precision", "hier_precision"),
                             (threshold, "recall", "hier_recall"), (CONFIDENT, "f1", "hier_f1_t60"))])
    out = ece
    for wide in (headline, pool, classwise, brier, hier):
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"),
                                             F.col(c).cast("double").alias("value"))
                                    for c in wide.columns])).alias("p")
        out = out.unionByName(wide.select(pairs).select("p.metric", "p.value"))
    return out


def prior_reference(labels: DataFrame, train: DataFrame, nodes: DataFrame) -> DataFrame:
    """(metric, value): calibration of the label prior on the items of a run, the floor that its own ECE
    and Brier are read against. `train(node, y)` gives the prior of every node."""
    obs = labels.select("node", "y").join(label_prior(train, nodes).select("node", F.col("prior").alias("score")), "node")
    bins = calibration_table(M.tie_groups(obs, ["node"]))
    pooled = M.ece_from_bins(bins.groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("n", "sum_score", "n_positive")]))
    each = M.ece_from_bins(bins, ["node"]).agg(F.avg("ece").alias("value"))
    brier = bins.agg((F.sum("sum_sq") / F.sum("n")).alias("value"))
    return (pooled.select(F.lit("prior_ece").alias("metric"), F.col("ece").alias("value"))
            .unionByName(each.select(F.lit("prior_ece_classwise").alias("metric"), "value"))
            .unionByName(brier.select(F.lit("prior_brier").alias("metric"), "value")))


def run_config(labels: DataFrame, predictions: DataFrame, nodes: DataFrame, settings: dict[str, object]) -> DataFrame:
    """(key, value) of what must match for two runs to be comparable: the settings, and hashes of the
    evaluated labels and nodes and of the taxonomy. The hash of the predictions is provenance."""
    spark = labels.sparkSession
    kept = labels.join(predictions.select("item").distinct(), "item", "left_semi")
    tables = {"labels": (kept, ["item", "node", "y"]), "evaluated_nodes": (align(kept, predictions).select("node").distinct(), ["node"]),
              "taxonomy": (nodes, ["node"]), "provenance.predictions": (predictions, ["item", "node", "score"])}
    rows = spark.createDataFrame([(f"config.{k}", str(v)) for k, v in sorted(settings.items())], "key string, value string")
    for name, (table, cols) in tables.items():
        rows = rows.unionByName(multiset_hash(table, *cols).select(
            F.lit(f"{name}.hash").alias("key"), F.concat_ws("/", "hash", F.col("n").cast("string")).alias("value")))
    items = kept.select("item").distinct().agg(F.count(F.lit(1)).cast("string").alias("value"))
    return rows.unionByName(items.select(F.lit("items.n_evaluated").alias("key"), "value"))
