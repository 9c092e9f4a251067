"""Data-quality audits over labels, splits and ids, and order-free table hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrove.functions.hashing import hash_uniform, row_fingerprint
from labelgrove.operators.metrics import positives

# Flag rule of the missingness audit (fixed values).
MAX_RATE_GAP = 0.10
MIN_UNOBSERVED_SHARE = 0.10
MIN_POSITIVES = 5
SPLITS = ("train", "val", "test")


def missingness(labels: DataFrame, n_items: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Per node: positive rate over all items vs over observed ones, and whether to flag it."""
    total = n_items.scalar()
    counts = labels.groupBy("node").agg(F.count(F.lit(1)).alias("n_observed"),
                                        positives().alias("n_positive"))
    if nodes is not None:
        counts = nodes.select("node").join(counts, "node", "left").fillna(
            0, ["n_observed", "n_positive"])
    c = counts.withColumn("n", total)
    c = c.withColumns({
        "rate_overall": F.col("n_positive") / F.col("n"),
        "rate_observed": F.when(F.col("n_observed") > 0,
                                F.col("n_positive") / F.col("n_observed")),
        "unobserved_share": 1 - F.col("n_observed") / F.col("n")})
    c = c.withColumn("gap", F.col("rate_observed") - F.col("rate_overall"))
    flagged = ((F.col("n_positive") >= MIN_POSITIVES) & (F.col("gap") > MAX_RATE_GAP)
               & (F.col("unobserved_share") >= MIN_UNOBSERVED_SHARE)
               & (F.col("n_observed") > F.col("n_positive")))
    return c.withColumn("flagged", F.coalesce(flagged, F.lit(False)))


def coverage(labels: DataFrame, leaves: DataFrame, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """Positives of each leaf per split and in total. `labels(item, split, node, y)`."""
    pos = labels.where("y").groupBy("node").agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in splits],
        F.count(F.lit(1)).alias("total"))
    return leaves.select("node").join(pos, "node", "left").fillna(0, [*splits, "total"])


def coverage_totals(covered: DataFrame) -> DataFrame:
    """Leaves with at least one and at least three test positives."""
    return covered.agg(F.count(F.lit(1)).alias("n_leaves"),
                       F.count_if(F.col("test") >= 1).alias("test_min1"),
                       F.count_if(F.col("test") >= 3).alias("test_min3"))


def claim_mismatches(labels: DataFrame, claims: DataFrame) -> DataFrame:
    """Leaves whose claimed source never provides a positive, and positives nobody claimed."""
    seen = labels.where("y").select("node").distinct()
    over = claims.select("node").distinct().join(seen, "node", "left_anti")
    under = seen.join(claims.select("node"), "node", "left_anti")
    return (over.withColumn("kind", F.lit("over_claimed"))
            .unionByName(under.withColumn("kind", F.lit("under_claimed"))))


def per_leaf(labels: DataFrame, leaves: DataFrame, n_items: DataFrame) -> DataFrame:
    """Positive and unknown item counts per leaf."""
    counts = labels.groupBy("node").agg(F.count(F.lit(1)).alias("n_observed"),
                                        positives().alias("pos"))
    return (leaves.select("node").join(counts, "node", "left").fillna(0, ["n_observed", "pos"])
            .select("node", "pos", (n_items.scalar() - F.col("n_observed")).alias("unknown")))


def group_leakage(items: DataFrame, group: str = "grp") -> DataFrame:
    """Groups found in more than one split (null groups are not groups)."""
    return (items.where(F.col(group).isNotNull())
            .groupBy(group).agg(F.array_join(F.array_sort(F.collect_set("split")), ",")
                                .alias("splits"), F.count_distinct("split").alias("n_splits"))
            .where("n_splits > 1"))


def require_no_leakage(items: DataFrame, group: str = "grp") -> DataFrame:
    """The items, failing if any group spans splits."""
    leaks = group_leakage(items, group).select(F.col(group).alias("__g"))
    hit = items.join(leaks, F.col(group) == F.col("__g"), "left")
    message = F.concat(F.lit("group in several splits: "), F.col("__g").cast("string"))
    return hit.withColumn("split", F.when(F.col("__g").isNull(), F.col("split")).otherwise(
        F.raise_error(message))).drop("__g")


def duplicate_content(items: DataFrame, content: str = "content", key: str = "item") -> DataFrame:
    """Content shared by several items: how many copies and which splits they fall into."""
    return (items.groupBy(content).agg(
        F.count(F.lit(1)).alias("copies"),
        F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"),
        (F.count_distinct("split") > 1).alias("leaks"), F.min(key).alias("first_item"))
        .where("copies > 1"))


def id_collisions(items: DataFrame, key: str = "song", content: str = "content") -> DataFrame:
    """Ids that stand for several contents: how many, over how many items, and in which splits."""
    return items.groupBy(key).agg(
        F.count_distinct(content).alias("contents"), F.count(F.lit(1)).alias("items"),
        F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits")).where("contents > 1")


def duplicate_ids(items: DataFrame, key: str = "item") -> DataFrame:
    return items.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def table_hash(df: DataFrame, *cols: str, by: list[str] | None = None) -> DataFrame:
    """Order-free hash and row count of a table with unique rows (labels, splits, config, nodes)."""
    return df.groupBy(*(by or [])).agg(F.bit_xor(row_fingerprint(*cols)).alias("hash"),
                                       F.count(F.lit(1)).alias("n"))


def multiset_hash(df: DataFrame, *cols: str) -> DataFrame:
    """(hash, n) of any table: the sum of the rows' fingerprints, so neither the order of rows matters nor
    do equal rows cancel each other. An empty table has hash 0."""
    total = F.coalesce(F.sum(row_fingerprint(*cols).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))
    return df.agg(total.cast("string").alias("hash"), F.count(F.lit(1)).alias("n"))


def label_prior(train: DataFrame, nodes: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Laplace-smoothed positive rate of every node over observed training labels."""
    counts = train.groupBy("node").agg(F.count(F.lit(1)).alias("n"), positives().alias("k"))
    n, k = F.coalesce("n", F.lit(0)), F.coalesce("k", F.lit(0))
    return nodes.select("node").join(counts, "node", "left").select(
        "node", ((k + alpha) / (n + 2 * alpha)).alias("prior"))


def baseline_prior(items: DataFrame, prior: DataFrame) -> DataFrame:
    """The prior as scores of every item; the node list is one small scalar array."""
    row = prior.agg(F.array_sort(F.collect_list(F.struct("node", "prior")))).scalar()
    return (items.select("item", F.explode(row).alias("p"))
            .select("item", "p.node", F.col("p.prior").alias("score")))


def baseline_random(items: DataFrame, nodes: DataFrame, seed: int = 0) -> DataFrame:
    """Seeded random scores that do not depend on row order."""
    names = nodes.agg(F.array_sort(F.collect_list("node"))).scalar()
    cells = items.select("item", F.explode(names).alias("node"))
    return cells.withColumn("score", hash_uniform(seed, F.col("item"), F.col("node")))


def chance_scores(obs: DataFrame) -> DataFrame:
    """Constant scores: every ranking metric falls to chance."""
    return obs.withColumn("score", F.lit(0.0))
