"""Choosing which nodes and items take part in an evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelgrove.operators.metrics import class_counts
from labelgrove.operators.taxonomy import ancestors_of, level_of


def split_filter(items: DataFrame, split: str | None) -> DataFrame:
    """Rows of one split; `all` or None keeps everything."""
    return items if split in (None, "all") else items.where(F.col("split") == split)


def units(mix: DataFrame, stems: DataFrame, unit: str, exclude_bleed: bool = False) -> DataFrame:
    """Labels at mix or stem level; stems get the id `item/stem` and may drop bleed. Fails on stems
    without rows and on a bleed filter for mixes."""
    if unit not in ("mix", "stem"):
        raise ValueError("unit must be mix or stem")
    if unit == "mix":
        if exclude_bleed:
            raise ValueError("only stems have bleed to exclude")
        rows = mix.select(F.col("item").cast("string").alias("item"), "node", "y")
    else:
        kept = stems.where(~F.coalesce("bleed", F.lit(False))) if exclude_bleed else stems
        rows = kept.select(F.concat_ws("/", "item", "stem").alias("item"), "node", "y")
        if rows.isEmpty():
            raise ValueError("no stems" + (" without bleed" if exclude_bleed else ""))
    return rows


def require_single_labels(rows: DataFrame, unit: str) -> DataFrame:
    """The rows of `units`; fails if an (item, node) pair occurs twice."""
    repeated = rows.groupBy("item", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if repeated is not None:
        raise ValueError(f"{unit} {repeated['item']}: node {repeated['node']} occurs {repeated['n']} times")
    return rows


def restrict(obs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Observations of the given nodes only; fails if a wanted node was never scored."""
    wanted = nodes.select("node").distinct()
    missing = wanted.join(obs.select("node").distinct(), "node", "left_anti")
    n_missing = missing.agg(F.count(F.lit(1))).scalar()
    kept = obs.join(wanted, "node", "left_semi")
    return kept.withColumn("node", F.when(n_missing == 0, F.col("node")).otherwise(
        F.raise_error(F.lit("a wanted node has no scores"))))


def eligible_nodes(obs: DataFrame, trained: DataFrame, min_pos: int = 3, min_neg: int = 3,
                   levels: list[int] | None = None) -> DataFrame:
    """Trained nodes with enough observed positives and negatives."""
    counts = class_counts(obs).join(trained.select("node"), "node", "left_semi")
    keep = counts.where((F.col("n_positive") >= min_pos)
                        & (F.col("n_observed") - F.col("n_positive") >= min_neg))
    return keep.where(level_of("node").isin(*levels)) if levels else keep


def scoreable(obs: DataFrame, pool: DataFrame, min_pos: int = 3, min_neg: int = 3,
              min_groups: int = 1) -> DataFrame:
    """As `eligible_nodes`, plus enough distinct groups among the positives; `obs` has grp.

    Counts first per (node, group), so the distinct count needs no expanded aggregate.
    """
    per_group = obs.groupBy("node", "grp").agg(F.count(F.lit(1)).alias("n"),
                                               F.count_if("y").alias("k"))
    counts = per_group.groupBy("node").agg(
        F.sum("n").alias("n_observed"), F.sum("k").alias("n_positive"),
        F.count_if(F.col("k") > 0).alias("n_groups"))
    return counts.join(pool.select("node"), "node", "left_semi").where(
        (F.col("n_positive") >= min_pos) & (F.col("n_observed") - F.col("n_positive") >= min_neg)
        & (F.col("n_groups") >= min_groups))


def trained_nodes(counts: DataFrame) -> DataFrame:
    """Nodes with at least one training item, and all their ancestors."""
    return (counts.where("n > 0").select(F.explode(ancestors_of("node")).alias("node")).distinct())


def node_sets(trained_a: DataFrame, trained_b: DataFrame, scored: DataFrame) -> DataFrame:
    """(node, kind): shared, added, removed and unscoreable nodes of two trained sets."""
    a, b = trained_a.select("node"), trained_b.select("node")
    pool = a.union(b).distinct()
    return (a.intersect(b).withColumn("kind", F.lit("shared"))
            .unionByName(a.subtract(b).withColumn("kind", F.lit("added")))
            .unionByName(b.subtract(a).withColumn("kind", F.lit("removed")))
            .unionByName(pool.subtract(scored.select("node")).withColumn("kind",
                                                                         F.lit("unscoreable"))))


def commercial_ok(title: Column | str) -> Column:
    """Licence title that is present and free of non-commercial and no-derivatives terms."""
    c = F.col(title) if isinstance(title, str) else title
    flat = F.regexp_replace(F.lower(c), "[-_ ]", "")
    blocked = [F.contains(flat, F.lit(b)) for b in BLOCKED_LICENCE_TERMS]
    bad = blocked[0]
    for b in blocked[1:]:
        bad = bad | b
    return F.coalesce((F.length(c) > 0) & ~bad, F.lit(False))


# Licence terms that rule out commercial use, without separators (fixed values).
BLOCKED_LICENCE_TERMS = ("noncommercial", "noderivative", "noderivatives", "noderivs")


def holdout_filter(sources: DataFrame, holdout: DataFrame, split: str) -> DataFrame:
    """(source, leaf) pairs allowed in a split.

    Held-out pairs never serve other splits; in `lso` a leaf with held-out sources uses only those.
    """
    pairs = ["source", "leaf"]
    if split != "lso":
        return sources.join(holdout.select(*pairs), pairs, "left_anti")
    held = sources.join(holdout.select(*pairs), pairs, "left_semi")
    rest = sources.join(holdout.select("leaf").distinct(), "leaf", "left_anti")
    return held.unionByName(rest.select(*held.columns))


def available_sources(sources: DataFrame, listing: DataFrame) -> DataFrame:
    """Sources that are not pending and whose instrument has files in the listing."""
    return (sources.where(F.coalesce("status", F.lit("")) != "pending_approval")
            .join(listing.select("instrument").distinct(), "instrument", "left_semi"))


def corrupt_flag(items: DataFrame, corrupt: DataFrame, key: str = "item") -> DataFrame:
    """Adds `corrupt`: the id prefix before `_` is on the list."""
    bad = corrupt.select(F.col("track").cast("string").alias("__t")).distinct()
    prefix = F.substring_index(F.col(key).cast("string"), "_", 1)
    return (items.join(bad.withColumn("__c", F.lit(True)), prefix == F.col("__t"), "left")
            .withColumn("corrupt", F.coalesce("__c", F.lit(False))).drop("__t", "__c"))
