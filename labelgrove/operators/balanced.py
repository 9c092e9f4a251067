"""Group splits that follow their targets: the greedy rule over any number of groups, and improvement.

The greedy rule takes groups by falling size and gives each to the split that lacks most. Groups of one
size differ in nothing but their order, so the rule only needs the table of sizes: distinct sizes, of
which N items allow at most sqrt(2 N). Within a size the split of the group at a given place follows
from how far the splits lag behind when the size begins; every task works that out for its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrove.functions.hashing import hash_hex
from labelgrove.operators.ranges import ranked
from labelgrove.operators.splits import check_fractions
from labelgrove.session import cut_lineage

#: Cost of the size term; strata count from the first number of items on, and must reach every split from the second.
SIZE_WEIGHT, COUNTED, NEEDED = 5.0, 2, 3
_SIZE = "\0size"


def picks_before(lack: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How many of the first `place` groups of equal size every split gets, if each goes to the split
    that lacks most (rows x splits). The picks of a split lower its lack step by step, so the first
    ones of all are those above some level, which is found by halving; the last few are counted out."""
    lack, size, place = np.atleast_2d(lack), np.asarray(size, float)[:, None], np.asarray(place)[:, None]
    high = lack.max(1, keepdims=True)
    low = high - (place + 1.0) * size
    for _ in range(64):
        middle = (high + low) / 2
        few = np.maximum(np.ceil((lack - middle) / size), 0).sum(1, keepdims=True) <= place
        high, low = np.where(few, middle, high), np.where(few, low, middle)
    picks = np.maximum(np.ceil((lack - high) / size) - 1, 0)
    left = place[:, 0] - picks.sum(1)
    while (left > 0).any():
        next_ = np.argmax(lack - picks * size, 1)
        picks[np.arange(len(picks)), next_] += left > 0
        left = left - (left > 0)
    return picks


def place_groups(sizes: DataFrame, fractions: dict[str, float], seed: int = 0, group: str = "grp") -> DataFrame:
    """(group, n, split) by the greedy rule; groups of one size in the order of a seeded hash."""
    check_fractions(fractions)
    names = list(fractions)
    classes = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("n")).collect()
    total = sum(r["n"] * r["c"] for r in classes)
    target = np.array([total * f / sum(fractions.values()) for f in fractions.values()])
    have, lacks = np.zeros(len(names)), {}
    for r in classes:
        lacks[r["n"]] = target - have
        have = have + r["n"] * picks_before(target - have, [r["n"]], [r["c"]])[0]
    label = np.array(names, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, place = batch.column("n").to_numpy(), batch.column("place").to_numpy()
                lack = np.array([lacks[x] for x in n])
                split = np.argmax(lack - picks_before(lack, n, place) * n[:, None], 1)
                yield pa.record_batch([batch.column(0), batch.column("n"), pa.array(label[split], pa.string())], [group, "n", "split"])
    order = ranked(sizes.select(group, F.col("n").cast("long").alias("n")), ["n"], [hash_hex(seed, F.col(group)), F.col(group)], "place")
    kind = sizes.schema[group].dataType.simpleString()
    return order.select(group, "n", "place").mapInArrow(run, f"{group} {kind}, n long, split string")


def greedy_split(items: DataFrame, fractions: dict[str, float], seed: int = 0, group: str = "grp") -> DataFrame:
    """(group, n, split): whole groups, the largest first, each to the split that lacks most."""
    return place_groups(items.groupBy(group).agg(F.count(F.lit(1)).alias("n")), fractions, seed, group)


def carve_validation(items: DataFrame, fraction: float, seed: int = 0, group: str = "grp") -> DataFrame:
    """Whole groups of the train split moved to `val` by the greedy rule; the other splits stay."""
    cut = greedy_split(items.where("split = 'train'"), {"train": 1 - fraction, "val": fraction}, seed, group)
    moved = cut.where("split = 'val'").select(group, F.lit("val").alias("__moved"))
    kept = F.when(F.col("split") == "train", F.coalesce("__moved", "split")).otherwise(F.col("split"))
    return items.join(moved, group, "left").withColumn("split", kept).drop("__moved")


def _cost(counts: np.ndarray, share: np.ndarray, total: np.ndarray, weight: np.ndarray, needed: np.ndarray) -> float:
    """Weighted squared deviations, and 1 for every split without an item of a stratum that needs one."""
    gap = (counts - share[:, None] * total) / np.maximum(total, 1)
    return float((weight * gap ** 2).sum() + ((counts == 0) & needed & (share > 0)[:, None]).sum())


def _table(entries: DataFrame, assigned: DataFrame, names: list[str]) -> tuple[list[str], np.ndarray]:
    """Strata, and items of each in every split."""
    rows = entries.join(assigned, "grp").groupBy("stratum").pivot("split", names).agg(F.sum("n")).fillna(0).orderBy("stratum").collect()
    return [r["stratum"] for r in rows], np.array([[r[s] for r in rows] for s in names], float)


def improved_split(sizes: DataFrame, strata: DataFrame, fractions: dict[str, float], fixed: DataFrame | None = None,
                   seed: int = 0, rounds: int = 25) -> tuple[DataFrame, list[float]]:
    """((grp, split), costs): the greedy split, improved by moving groups until no round lowers the cost.

    `sizes(grp, n)`, `strata(grp, stratum, n)`, `fixed(grp, split)` stays. The cost is that of
    `splits.candidate_costs`. A round takes the best move of every group, and of those the prefix, of
    a power of two, that lowers the cost most when made together; costs holds the start and every round,
    and never rises. Only tables of strata x splits pass the driver.
    """
    check_fractions(fractions)
    names, whole = list(fractions), sum(fractions.values())
    share = np.array([fractions[s] / whole for s in names])
    entries = cut_lineage(strata.select("grp", "stratum", F.col("n").cast("long").alias("n")).unionByName(
        sizes.select("grp", F.lit(_SIZE).alias("stratum"), F.col("n").cast("long").alias("n"))))
    start = place_groups(sizes, fractions, seed).select("grp", "split")
    pins = None if fixed is None else fixed.select("grp", F.col("split").alias("pinned"))
    if pins is not None:
        start = start.join(pins, "grp", "left").select("grp", F.coalesce("pinned", "split").alias("split"))
    assigned = cut_lineage(start)
    labels, counts = _table(entries, assigned, names)
    if not labels:
        return assigned, [0.0]
    total, own = counts.sum(0), np.array([x == _SIZE for x in labels])
    weight, needed = np.where(own, SIZE_WEIGHT, (total >= COUNTED) * 1.0), ~own & (total >= NEEDED)
    costs = [_cost(counts, share, total, weight, needed)]
    spark = sizes.sparkSession
    for step in range(rounds):
        state = spark.createDataFrame([(x, float(total[j]), float(weight[j]), bool(needed[j]), s, float(counts[i, j]), float(share[i]))
                                       for j, x in enumerate(labels) for i, s in enumerate(names)],
                                      "stratum string, c double, w double, need boolean, split string, have double, f double")
        src = state.select("stratum", "split", *[F.col(c).alias(f"s_{c}") for c in ("have", "f")])
        dst = state.select("stratum", F.col("split").alias("to"), "c", "w", "need", "have", "f")
        rows = entries.join(assigned, "grp")
        if pins is not None:
            rows = rows.join(pins, "grp", "left_anti")
        n, f, have, s_f, s_have, c = (F.col(x) for x in ("n", "f", "have", "s_f", "s_have", "c"))
        square = lambda x: x * x
        change = (F.col("w") / square(c) * (square(s_have - n - s_f * c) - square(s_have - s_f * c)
                                            + square(have + n - f * c) - square(have - f * c))
                  + F.when(F.col("need"), ((s_have == n) & (s_f > 0)).cast("int") - ((have == 0) & (f > 0)).cast("int")).otherwise(0))
        moves = rows.join(src, ["stratum", "split"]).join(dst, "stratum").where(F.col("to") != F.col("split")).groupBy(
            "grp", "split", "to").agg(F.sum(change).alias("gain")).groupBy("grp", "split").agg(
            F.min_by("to", F.struct("gain", "to")).alias("to"), F.min("gain").alias("gain")).where("gain < -1e-12")
        moves = cut_lineage(ranked(moves, [], ["gain", hash_hex(seed + step + 1, F.col("grp")), "grp"], "nth").withColumn(
            "level", F.ceil(F.log2(F.col("nth") + 1)).cast("int")))
        moved = entries.join(moves, "grp").groupBy("level", "stratum", "split", "to").agg(F.sum("n").alias("n")).collect()
        best, change_at, at = None, np.zeros_like(counts), {x: j for j, x in enumerate(labels)}
        for level in sorted({r["level"] for r in moved}):
            for r in moved:
                if r["level"] == level:
                    change_at[names.index(r["split"]), at[r["stratum"]]] -= r["n"]
                    change_at[names.index(r["to"]), at[r["stratum"]]] += r["n"]
            cost = _cost(counts + change_at, share, total, weight, needed)
            if cost < costs[-1] - 1e-12 and (best is None or cost < best[0]):
                best = cost, level, counts + change_at
        if best is None:
            break
        chosen = moves.where(F.col("level") <= best[1]).select("grp", F.col("to").alias("moved"))
        assigned = cut_lineage(assigned.join(chosen, "grp", "left").select("grp", F.coalesce("moved", "split").alias("split")))
        counts = best[2]
        costs.append(best[0])
    return assigned, costs
