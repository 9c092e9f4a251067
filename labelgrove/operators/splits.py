"""Group-disjoint splits, stratified assignment and seeded subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelgrove.functions.hashing import crc_uniform, hash_hex, hash_uniform, pick_split
from labelgrove.operators.ranges import ranked
from labelgrove.operators.scan import running_totals


def check_fractions(fractions: dict[str, float]) -> None:
    if sum(fractions.values()) <= 0 or any(f < 0 for f in fractions.values()):
        raise ValueError(f"bad split fractions {fractions}")


def split_of(items: DataFrame, fractions: dict[str, float], group: str = "grp") -> DataFrame:
    """Stateless split: CRC-32 of the group against cumulative fractions."""
    check_fractions(fractions)
    return items.withColumn("split", pick_split(crc_uniform(F.col(group)), fractions))


def group_split(items: DataFrame, fractions: dict[str, float], seed: int = 0,
                group: str = "grp") -> DataFrame:
    """(group, n, split): whole groups, each split within one group of its share.

    Groups are laid end to end in seeded hash order; a group goes to the split whose share of
    the total holds the group's midpoint. The running total is two-level, so no task sees all
    groups.
    """
    check_fractions(fractions)
    share = {s: f for s, f in fractions.items() if f > 0}
    sizes = items.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    keyed = sizes.withColumn("h", hash_hex(seed, F.col(group)))
    keyed = keyed.withColumn("chunk", F.substring("h", 1, 3))
    run = running_totals(keyed, [], "chunk", [F.col("h"), F.col(group)], {"n": "cum"})
    total = sizes.agg(F.sum("n")).scalar()
    mid = (F.col("cum") - F.col("n") / 2) / total
    return run.select(group, "n", pick_split(mid, share).alias("split"))


def carve_validation(items: DataFrame, fraction: float, seed: int = 0,
                     group: str = "grp") -> DataFrame:
    """Move whole groups of the train split to `val`, keeping the other splits."""
    train = items.where("split = 'train'")
    cut = group_split(train, {"val": fraction, "train": 1 - fraction}, seed, group)
    moved = cut.where("split = 'val'").select(group, F.lit("val").alias("moved"))
    return (items.join(moved, group, "left")
            .withColumn("split", F.when(F.col("split") == "train",
                                        F.coalesce("moved", F.col("split")))
                        .otherwise(F.col("split"))).drop("moved"))


def candidate_costs(sizes: DataFrame, strata: DataFrame, fractions: dict[str, float],
                    fixed: DataFrame | None, n_candidates: int, seed: int) -> DataFrame:
    """(candidate, cost) of seeded assignments of groups to splits.

    `sizes(grp, n)`, `strata(grp, stratum, n)`; cost = squared relative stratum deviation (strata
    with two or more items) + 5 x squared size deviation + 1 for each split without an item of a
    stratum that has at least three.
    """
    total = sum(fractions.values())
    share = {s: f / total for s, f in fractions.items()}
    # the size of a group is one more stratum (null), so one pass serves both terms
    entries = strata.select("grp", "stratum", "n").unionByName(
        sizes.select("grp", F.lit(None).cast("string").alias("stratum"), "n"))
    groups = entries.groupBy("grp").agg(F.collect_list(F.struct("stratum", "n")).alias("e"))
    counts = (_assign(groups, fractions, fixed, n_candidates, seed)
              .select("candidate", "split", F.inline("e")).groupBy("candidate", "stratum").agg(
        F.sum("n").alias("c"), *[F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)
                                       ).alias(f"c_{s}") for s in share]))
    deviation = sum((F.pow((F.col(f"c_{s}") - F.lit(f) * F.col("c")) / F.col("c"), F.lit(2))
                     for s, f in share.items()), F.lit(0.0))
    missing = sum((F.when((F.col("c") >= 3) & (F.col(f"c_{s}") == 0), 1).otherwise(0)
                   for s, f in share.items() if f > 0), F.lit(0))
    part = F.when(F.col("stratum").isNull(), 5 * deviation).otherwise(
        F.when(F.col("c") >= 2, deviation).otherwise(0.0) + missing)
    return counts.groupBy("candidate").agg(F.sum(part).alias("cost"))


def _assign(rows: DataFrame, fractions: dict[str, float], fixed: DataFrame | None,
            n_candidates: int, seed: int) -> DataFrame:
    """Every row under every candidate, with the split its group gets there."""
    if fixed is not None:
        rows = rows.join(fixed.select("grp", F.col("split").alias("pinned")), "grp", "left")
    many = rows.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(n_candidates - 1))))
    drawn = pick_split(hash_uniform(seed, F.col("candidate"), F.col("grp")), fractions)
    return many.withColumn("split", drawn if fixed is None else F.coalesce("pinned", drawn))


def stratified_split(sizes: DataFrame, strata: DataFrame, fractions: dict[str, float],
                     fixed: DataFrame | None = None, n_candidates: int = 64,
                     seed: int = 0) -> DataFrame:
    """(grp, split) of the cheapest of `n_candidates` seeded assignments; `fixed` groups stay."""
    check_fractions(fractions)
    costs = candidate_costs(sizes, strata, fractions, fixed, n_candidates, seed)
    best = costs.agg(F.min_by("candidate", F.struct(F.round("cost", 9), "candidate"))).scalar()
    drawn = pick_split(hash_uniform(seed, best, F.col("grp")), fractions)
    if fixed is None:
        return sizes.select("grp", drawn.alias("split"))
    pins = fixed.select("grp", F.col("split").alias("pinned"))
    return sizes.join(pins, "grp", "left").select("grp", F.coalesce("pinned", drawn).alias("split"))


def pin_required(carriers: DataFrame) -> DataFrame:
    """(grp, split='test'): the smallest group that carries each required node.

    `carriers(node, grp, n)` with n = size of the group.
    """
    return (carriers.groupBy("node").agg(F.min_by("grp", F.struct("n", "grp")).alias("grp"))
            .select("grp").distinct().withColumn("split", F.lit("test")))


def round_robin(items: DataFrame, order: str, group: str = "grp") -> DataFrame:
    """Adds (turn, group_rank), both from 1: taking one item per group in turn, largest groups first.

    Sort by (turn, group_rank) to read the order. Positions come from ranges of the rows, so neither a
    very large group nor very many groups of one size become one task.
    """
    numbered = ranked(items, [group], [order], "turn").withColumn("turn", F.col("turn") + 1)
    sizes = items.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    ranks = ranked(sizes, [], [F.col("n").desc(), F.col(group)], "group_rank")
    return numbered.join(ranks.select(group, (F.col("group_rank") + 1).alias("group_rank")), group)


def nested_subset(items: DataFrame, n: int, seed: int = 0, key: str = "item") -> DataFrame:
    """The n items with the smallest seeded hash: a smaller subset lies inside a larger one. Items are
    numbered over ranges of the hash, so a large sample is not gathered in one task."""
    hashed = items.withColumn("__h", hash_hex(seed, F.col(key)))
    return ranked(hashed, [], ["__h", key], "__rank").where(F.col("__rank") < n).drop("__h", "__rank")


def capped_sample(items: DataFrame, cap: int, seed: int, family: str, key: str,
                  done: DataFrame | None = None) -> DataFrame:
    """At most `cap` items per family in seeded hash order, leaving out those already `done`.

    Spark limits each input partition to `cap` rows per family before the shuffle
    (WindowGroupLimit), so a huge family stays cheap.
    """
    todo = items if done is None else items.join(done.select(key), key, "left_anti")
    w = Window.partitionBy(family).orderBy(hash_hex(seed, F.col(key)), F.col(key))
    return todo.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= cap)
