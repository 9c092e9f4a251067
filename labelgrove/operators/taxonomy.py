"""Tree operators: closures, tree queries, score propagation and hierarchical metrics.

A taxonomy is a `nodes` table (node, parent, level, ord, is_leaf, ...) with dotted ids, and its
`closure(node, ancestor, depth)`, which includes each node itself. Its size is that of the label
set, never of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelgrove.operators.metrics import micro_prf

EPS = 1e-9
MAX_LEVEL = 3


def _col(node: Column | str) -> Column:
    return F.col(node) if isinstance(node, str) else node


def level_of(node: Column | str) -> Column:
    c = _col(node)
    return F.length(c) - F.length(F.replace(c, F.lit("."), F.lit(""))) + 1


def ancestors_of(node: Column | str) -> Column:
    """Ids from the root down to the node itself, computed from the dotted id, at any depth."""
    parts = F.split(_col(node), "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def parent_of(node: Column | str) -> Column:
    c = _col(node)
    return F.when(F.contains(c, F.lit(".")), F.regexp_replace(c, "[.][^.]*$", ""))


def family_of(node: Column | str) -> Column:
    return F.substring_index(_col(node), ".", 1)


def nodes_from_ids(ids: DataFrame) -> DataFrame:
    """Node table of every id in `ids(node)` and all its ancestors."""
    up = ids.select(F.col("node").alias("own"), F.explode(ancestors_of("node")).alias("node"))
    every = up.groupBy("node").agg(F.bool_and(F.col("own") == F.col("node")).alias("is_leaf"))
    return every.select("node", parent_of("node").alias("parent"),
                        level_of("node").alias("level"), "is_leaf")


def closure(nodes: DataFrame) -> DataFrame:
    """(node, ancestor, depth) pairs, self included at depth 0."""
    return nodes.select("node", F.posexplode(F.reverse(ancestors_of("node")))
                        .alias("depth", "ancestor"))


def recursive_closure(nodes: DataFrame) -> DataFrame:
    """Closure from parent pointers, for trees whose ids are not dotted."""
    view = "__labelgrove_nodes"
    nodes.select("node", "parent").createOrReplaceTempView(view)
    return nodes.sparkSession.sql(f"""
        WITH RECURSIVE up(node, ancestor, depth) AS (
          SELECT node, node, 0 FROM {view}
          UNION ALL
          SELECT up.node, p.parent, up.depth + 1 FROM up JOIN {view} p ON up.ancestor = p.node
          WHERE p.parent IS NOT NULL)
        SELECT node, ancestor, depth FROM up""")


def close_upward(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Add every ancestor of each (keys, node)."""
    return labels.select(*keys, F.explode(ancestors_of("node")).alias("node")).distinct()


def close_downward(labels: DataFrame, keys: list[str], pairs: DataFrame) -> DataFrame:
    """Add every descendant of each (keys, node), from the closure table."""
    return (labels.select(*keys, F.col("node").alias("ancestor"))
            .join(pairs.select("node", "ancestor"), "ancestor")
            .select(*keys, "node").distinct())


def tree_summary(nodes: DataFrame) -> DataFrame:
    """Children, descendants and leaves below each node."""
    pairs = closure(nodes).join(nodes.select("node", "is_leaf"), "node")
    below = pairs.groupBy("ancestor").agg(
        F.count_if(F.col("depth") == 1).alias("n_children"),
        F.count_if(F.col("depth") > 0).alias("n_descendants"),
        F.count_if(F.col("is_leaf")).alias("n_leaves"))
    return nodes.select("node", "parent", "level", "is_leaf").join(
        below.withColumnRenamed("ancestor", "node"), "node")


def max_propagate(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Each present node takes the maximum of itself and its present descendants."""
    return complete_scores(scores, keys).where(~F.col("synthesised")).drop("synthesised")


def complete_scores(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """`max_propagate` plus the missing ancestors, flagged as synthesised.

    One partial aggregate on (keys, ancestor): a row fans out to its depth (at most three).
    """
    keys = keys or ["item"]
    up = scores.select(*keys, "score", F.col("node").alias("own"),
                       F.explode(ancestors_of("node")).alias("node"))
    return up.groupBy(*keys, "node").agg(
        F.max("score").alias("score"),
        F.bool_and(F.col("own") != F.col("node")).alias("synthesised"))


def violations(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Pairs where a child outscores its present parent."""
    keys = keys or ["item"]
    child = scores.select(*keys, F.col("score").alias("child_score"),
                          parent_of("node").alias("node")).where("node is not null")
    pairs = child.join(scores.select(*keys, "node", "score"), [*keys, "node"])
    return pairs.agg(F.count(F.lit(1)).alias("checked"),
                     F.count_if(F.col("child_score") > F.col("score") + EPS).alias("violations"))


def hierarchical_counts(labels: DataFrame, scores: DataFrame,
                        thresholds: list[float]) -> DataFrame:
    """(threshold, tp, fp, fn) after closing predictions and truths upward, inside the observed pairs.

    `labels(item, node, y)` holds observed pairs only; `scores(item, node, score)` may cover any
    node of the tree, since a prediction on a masked node still credits its observed ancestors.
    All thresholds share one shuffle on (item, node).
    """
    low = min(thresholds)
    hits = scores.where(F.col("score") >= low).select(
        "item", F.explode(ancestors_of("node")).alias("node"), F.lit(False).alias("y"),
        F.lit(False).alias("seen"), "score")
    truths = labels.select(
        "item", F.col("node").alias("own"), "y",
        F.explode(F.when(F.col("y"), ancestors_of("node")).otherwise(F.array("node"))).alias("node")
    ).select("item", "node", "y", (F.col("own") == F.col("node")).alias("seen"),
             F.lit(None).cast("double").alias("score"))
    cells = hits.unionByName(truths).groupBy("item", "node").agg(
        F.bool_or("y").alias("y"), F.bool_or("seen").alias("seen"), F.max("score").alias("score"))
    rows = [F.struct(F.lit(float(t)).alias("threshold"),
                     F.count_if(F.col("y") & _hit(t)).alias("tp"),
                     F.count_if(~F.col("y") & _hit(t)).alias("fp"),
                     F.count_if(F.col("y") & ~_hit(t)).alias("fn")) for t in thresholds]
    return cells.where("seen").agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def _hit(threshold: float) -> Column:
    return F.coalesce(F.col("score") >= threshold, F.lit(False))


def hierarchical_prf(labels: DataFrame, scores: DataFrame,
                     thresholds: list[float] | None = None) -> DataFrame:
    """Pooled hierarchical precision, recall and F1 per threshold; null where undefined."""
    return micro_prf(hierarchical_counts(labels, scores, thresholds or [0.5]), ["threshold"])


def project(scores: DataFrame, projection: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Score of each coarse class = maximum over the nodes that project to it."""
    keys = keys or ["item"]
    return (scores.join(projection.select("node", "cls"), "node")
            .groupBy(*keys, "cls").agg(F.max("score").alias("score")))


def deepest_class(nodes: DataFrame, class_map: DataFrame) -> DataFrame:
    """Projection of each node to the class mapped on its deepest ancestor-or-self."""
    mapped = class_map.select(F.col("node").alias("ancestor"), "cls")
    return (closure(nodes).join(mapped, "ancestor").groupBy("node")
            .agg(F.min_by("cls", "depth").alias("cls")))


def antichain_violations(mapped: DataFrame) -> DataFrame:
    """Mapped nodes that lie above another mapped node (must be empty)."""
    strict = closure(mapped).where("depth > 0").select(
        F.col("ancestor").alias("node"), F.col("node").alias("below"))
    return strict.join(mapped.select("node").distinct(), "node", "left_semi")
