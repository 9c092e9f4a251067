"""Promotion, adoption and comparison of runs from long metric tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelgrove.operators.resample import POINT, paired_intervals, single_intervals

EPS = 1e-9
REL_TOL = 0.02
ABS_TOL_CALIBRATION = 0.005
MIN_VALID_SHARE = 0.95
NODE_FLOOR = 0.01


def lower_is_better(metric: Column) -> Column:
    return (F.startswith(metric, F.lit("ece")) | F.startswith(metric, F.lit("brier"))
            | F.endswith(metric, F.lit("_ece")))


def comparability(candidate: DataFrame, incumbent: DataFrame) -> DataFrame:
    """(key, candidate, incumbent) of every setting that differs; the loader seed and provenance are ignored.

    Both sides are (key, value) tables of config, hashes and versions.
    """
    c = candidate.select("key", F.col("value").alias("candidate"))
    i = incumbent.select("key", F.col("value").alias("incumbent"))
    return (c.join(i, "key", "full_outer").where(~F.col("key").isin("loader.seed", "config.loader.seed") & ~F.startswith("key", F.lit("provenance.")))
            .where(~F.col("candidate").eqNullSafe(F.col("incumbent"))))


def secondary_verdicts(metrics: DataFrame, primary: str,
                       tolerance: float | None = None) -> DataFrame:
    """Per secondary metric(metric, candidate, incumbent): delta, allowed regression, verdict."""
    c, i = F.col("candidate"), F.col("incumbent")
    lower = lower_is_better(F.col("metric"))
    regress = F.when(lower, c - i).otherwise(i - c)
    allowed = (F.lit(float(tolerance)) if tolerance is not None else
               F.when(lower, F.lit(ABS_TOL_CALIBRATION)).otherwise(F.abs(i) * REL_TOL))
    verdict = (F.when(c.isNull() & i.isNull(), "skipped")
               .when(c.isNull() | i.isNull(), "undefined")
               .when(regress > allowed + EPS, "regressed").otherwise("ok"))
    return metrics.where(F.col("metric") != primary).select(
        "metric", "candidate", "incumbent", (c - i).alias("delta"), allowed.alias("allowed"),
        verdict.alias("verdict"))


def promotion_gate(metrics: DataFrame, primary: str, config_diff: DataFrame | None = None,
                   bootstrap: DataFrame | None = None, tolerance: float | None = None) -> DataFrame:
    """One row: promote, comparable and the reasons against.

    `metrics(metric, candidate, incumbent)`; `bootstrap(delta, lo, hi, n_valid, n_boot)` has one
    row for the primary. All inputs are metric-sized.
    """
    c, i = F.col("c"), F.col("i")
    main = metrics.where(F.col("metric") == primary).agg(F.max("candidate").alias("c"),
                                                         F.max("incumbent").alias("i"))
    bad = secondary_verdicts(metrics, primary, tolerance).where(
        "verdict in ('undefined', 'regressed')")
    bad_names = bad.agg(F.array_sort(F.collect_list(F.concat_ws(" ", F.lit("secondary"), "metric",
                                                                "verdict"))).alias("s"))
    n_diff = (F.lit(0) if config_diff is None
              else config_diff.agg(F.count(F.lit(1))).scalar())
    lower = lower_is_better(F.lit(primary))
    better = F.when(lower, c < i - EPS).otherwise(c > i + EPS)
    reasons = [F.when(~better, F.lit(f"primary {primary} does not beat the incumbent"))]
    if bootstrap is not None:
        b = bootstrap.agg(F.struct(F.max("lo").alias("lo"), F.max("hi").alias("hi"),
                                   F.max("n_valid").alias("v"), F.max("n_boot").alias("n"))).scalar()
        main = main.withColumn("b", b)
        share = F.coalesce(F.col("b.v") / F.col("b.n"), F.lit(0.0))
        clear = F.when(lower, F.col("b.hi") < 0).otherwise(F.col("b.lo") > 0)
        reasons.append(F.when(share < MIN_VALID_SHARE - EPS, F.lit("significance unavailable"))
                       .when(~F.coalesce(clear, F.lit(False)), F.lit("interval includes 0")))
    undefined = c.isNull() | i.isNull()
    comparable = (F.col("n_diff") == 0) & ~undefined
    out = main.withColumns({"n_diff": n_diff.cast("long"), "s": bad_names.scalar()})
    found = F.concat(F.array_compact(F.array(*reasons)), F.col("s"))
    why = (F.when(F.col("n_diff") > 0, F.array(F.lit("configurations differ")))
           .when(undefined, F.array(F.lit(f"primary {primary} undefined"))).otherwise(found))
    return out.select((comparable & (F.size(why) == 0)).alias("promote"),
                      comparable.alias("comparable"), (c - i).alias("delta"),
                      F.array_join(why, "; ").alias("reasons"))


def check_old(macro_ci: DataFrame, node_ci: DataFrame, incumbent_ap: DataFrame) -> DataFrame:
    """Shared nodes: mean AP may drop by at most 2 %, no node's interval lies wholly below -0.01.

    `macro_ci`, `node_ci` from `paired_ci`; `incumbent_ap(node, ap)`.
    """
    allowed = incumbent_ap.agg(F.avg("ap") * REL_TOL).scalar()
    low = node_ci.where(F.col("hi") < -NODE_FLOOR)
    names = low.agg(F.array_join(F.array_sort(F.collect_list("node")), ",")).scalar()
    out = macro_ci.withColumns({"allowed": allowed, "low_nodes": names})
    fine = (F.col("delta") >= -F.col("allowed") - 1e-12) & (F.col("low_nodes") == "")
    return out.select(F.coalesce(fine, F.lit(False)).alias("passed"), "delta", "allowed",
                      "low_nodes")


def check_new(vs_incumbent: DataFrame, vs_chance: DataFrame) -> DataFrame:
    """New nodes: the mean AP must beat both the incumbent and chance with a CI above 0."""
    i = vs_incumbent.agg(F.max("lo")).scalar()
    return vs_chance.agg(F.max("lo").alias("lo_chance")).withColumn("lo_incumbent", i).select(
        F.coalesce((F.col("lo_chance") > 0) & (F.col("lo_incumbent") > 0), F.lit(False))
        .alias("passed"), "lo_incumbent", "lo_chance")


def parse_run(folder: Column) -> Column:
    """Run name of a folder `<UTC time>_<name>`; null when it does not match."""
    return F.nullif(F.regexp_extract(folder, "^[0-9]{8}T[0-9]{6}Z_(.+)$", 1), F.lit(""))


def arm_of(name: Column) -> Column:
    """Arm of a run name `<arm>_s<seed>`; the whole name when it has no seed."""
    return F.regexp_replace(name, "^(.+)_s[0-9]+$", "$1")


def seed_of(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, "^.+_s([0-9]+)$", 1), F.lit("")).cast("int")


def arm_table(runs: DataFrame) -> DataFrame:
    """Mean, minimum and maximum of each arm over its seeds. `runs(arm, seed, value)`."""
    return runs.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n_seeds"), F.avg("value").alias("mean"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.min_by("value", F.coalesce("seed", F.lit(-1))).alias("first_seed"))


def arm_deltas(runs: DataFrame, base: str) -> DataFrame:
    """Difference of every arm to `base`: seed by seed where both have the seed, else against
    the first seed of `base`."""
    ref = runs.where(F.col("arm") == base)
    same = ref.select(F.coalesce("seed", F.lit(-1)).alias("k"), F.col("value").alias("same"))
    first = ref.agg(F.min_by("value", F.coalesce("seed", F.lit(-1)))).scalar()
    rows = (runs.where(F.col("arm") != base).withColumn("k", F.coalesce("seed", F.lit(-1)))
            .join(same, "k", "left").withColumn("first", first))
    paired, alone = F.col("value") - F.col("same"), F.col("value") - F.col("first")
    return rows.groupBy("arm").agg(
        F.count("same").alias("n_shared"),
        F.when(F.count("same") > 0, F.avg(paired)).otherwise(F.avg(alone)).alias("mean_delta"),
        F.when(F.count("same") > 0, F.min(paired)).otherwise(F.min(alone)).alias("min_delta"),
        F.when(F.count("same") > 0, F.max(paired)).otherwise(F.max(alone)).alias("max_delta"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """Newest folder of every run name (re-runs supersede). `runs(folder)`."""
    named = runs.withColumn("name", parse_run(F.col("folder"))).where("name is not null")
    return named.groupBy("name").agg(F.max("folder").alias("folder"))


def metric_pairs(candidate: DataFrame, incumbent: DataFrame) -> DataFrame:
    """Two (metric, value) tables side by side."""
    return candidate.select("metric", F.col("value").alias("candidate")).join(
        incumbent.select("metric", F.col("value").alias("incumbent")), "metric", "full_outer")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def check_old_nodes(values: DataFrame, candidate: str, incumbent: str) -> DataFrame:
    """`check_old` on the nodes of `values` (from `resample.node_values`)."""
    macro = paired_intervals(_mean_ap(values), candidate, incumbent)
    each = paired_intervals(values.select("run", "node", "r", F.col("ap").alias("value")), candidate, incumbent, ["node"])
    return check_old(macro, each, values.where((F.col("run") == incumbent) & (F.col("r") == POINT)).select("node", "ap"))


def check_new_nodes(values: DataFrame, candidate: str, incumbent: str, chance: str) -> DataFrame:
    """`check_new` on the nodes of `values`, which also hold a run of constant scores."""
    mean = _mean_ap(values)
    return check_new(paired_intervals(mean, candidate, incumbent), paired_intervals(mean, candidate, chance))


def _mean_ap(values: DataFrame) -> DataFrame:
    return values.groupBy("run", "r").agg(F.avg("ap").alias("value")).withColumn("metric", F.lit("map_macro"))


def arm_intervals(values: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per arm: mean, least and largest mean AP over its seeds, and the interval of its first
    seed. `values` from `resample.node_values`; `runs(run, arm, seed)`, a run without a seed comes first."""
    mean = _mean_ap(values).join(runs, "run")
    seed = F.coalesce("seed", F.lit(-1))
    first = runs.groupBy("arm").agg(F.min_by("run", seed).alias("run"))
    ci = single_intervals(mean.join(first, ["arm", "run"]), ["arm"]).select("arm", "lo", "hi", "n_valid")
    return mean.where(F.col("r") == POINT).groupBy("arm").agg(
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.count(F.lit(1)).alias("n_seeds")).join(ci, "arm")


def arm_pairs(values: DataFrame, runs: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """One row per pair of arms and seed: the difference of mean AP with its interval, seed by seed, or
    every seed of the candidate against the first of an arm that shares none; pairs with an arm that
    has no run come without values."""
    mean = _mean_ap(values).join(runs, "run").withColumn("k", F.coalesce("seed", F.lit(-1))).select("arm", "k", "r", "value")
    pair, keys = ["candidate", "incumbent"], values.sparkSession.createDataFrame(pairs, "candidate string, incumbent string")
    c = keys.join(mean.withColumnsRenamed({"arm": "candidate", "value": "c"}), "candidate")
    i = keys.join(mean.withColumnsRenamed({"arm": "incumbent", "value": "i", "k": "ik"}), "incumbent")
    seeds = i.select(*pair, "ik").distinct()
    shared = c.select(*pair, "k").distinct().join(seeds.withColumnRenamed("ik", "k"), [*pair, "k"]).select(
        *pair, F.lit(True).alias("shared")).distinct()
    least = seeds.groupBy(*pair).agg(F.min("ik").alias("least"))
    to = F.when(F.col("shared"), F.col("k")).otherwise(F.col("least"))
    both = c.join(shared, pair, "left").join(least, pair).withColumn("ik", to).join(i, [*pair, "ik", "r"])
    d, point = F.col("c") - F.col("i"), F.col("r") == POINT
    drawn = F.when(~point, d)
    rows = both.groupBy(*pair, "k", "ik").agg(
        F.max(F.when(point, d)).alias("delta"), F.percentile(drawn, F.lit(0.025)).alias("lo"),
        F.percentile(drawn, F.lit(0.975)).alias("hi"), F.count(drawn).alias("n_valid"))
    return keys.join(rows, pair, "left").select(
        *pair, F.col("k").alias("seed"), F.col("ik").alias("incumbent_seed"), "delta", "lo", "hi", "n_valid",
        ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("excludes_0"))
