"""spark-submit jobs over stored tables: python -m labelgrove.jobs <job> --help."""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelgrove.operators import audit, balanced, bootstrap, calibrate, gate, resample, selection, taxonomy
from labelgrove.plans import evaluate
from labelgrove.session import get_session
from labelgrove.sources import runs, taxonomy_files

STAGE_ROW = ("job_id long, stage string, model_name string, status string, wall_ms long, "
             "error string")


def run_stage(spark: SparkSession, job_id: int, stage: str, action: Callable[[], object],
              table: str, model: str = "") -> object | None:
    """Run one timed stage (it ends in a write) and append its row; a failure is kept as a row."""
    start, result, error = time.monotonic(), None, ""
    try:
        result = action()
    except Exception as e:  # a failed stage must not stop the job
        error = f"{type(e).__name__}: {e}"[:500]
    _stage_row(spark, table, job_id, stage, model, "failed" if error else "ok",
               int((time.monotonic() - start) * 1000), error)
    return result


def skip_stage(spark: SparkSession, job_id: int, stage: str, reason: str, table: str) -> None:
    _stage_row(spark, table, job_id, stage, "", "skipped", 0, reason)


def _stage_row(spark, table, *row) -> None:
    spark.createDataFrame([row], STAGE_ROW).coalesce(1).write.mode("append").parquet(table)


def job_taxonomy(spark, a) -> DataFrame:
    return taxonomy_files.taxonomy_errors(taxonomy_files.read_taxonomy_entries(spark, a.input))


def job_run(spark, a) -> DataFrame:
    """Score predictions(item, node, score) against labels(item, node, y) and archive the run with its
    settings and hashes.

    Repeated (item, node) pairs are refused, and so are items without predictions unless allowed.
    Scores are made consistent up the tree unless switched off. With --train labels the archived
    metrics hold the calibration of their prior on the same items.
    """
    labels, scores = spark.read.parquet(a.input), spark.read.parquet(a.scores)
    nodes = spark.read.parquet(a.nodes)
    evaluate.require_unique(labels, "labels")
    evaluate.require_unique(scores, "predictions")
    missing = evaluate.alignment_counts(labels, scores).first()["n_missing_predictions"]
    if missing and not a.allow_missing:
        raise ValueError(f"{missing} labelled items have no predictions")
    settings = {"threshold": a.threshold, "propagate": not a.no_propagate, "allow_missing": a.allow_missing, "bins": evaluate.N_BINS}
    config = evaluate.run_config(labels, scores, nodes, settings)
    if not a.no_propagate:
        scores = taxonomy.complete_scores(scores).drop("synthesised")
    summary = evaluate.summary(labels, scores, nodes.where("is_leaf"), threshold=a.threshold)
    if a.train:
        kept = labels.join(scores.select("item").distinct(), "item", "left_semi")
        summary = summary.unionByName(evaluate.prior_reference(kept, spark.read.parquet(a.train), nodes))
    folder = runs.archive_run(evaluate.align(labels, scores), summary, a.output, a.stamp, a.name, config)
    return spark.read.parquet(f"{folder}/metrics")


def job_baseline(spark, a) -> DataFrame:
    """The label prior of every node, or random scores of every item and node."""
    labels, nodes = spark.read.parquet(a.input), spark.read.parquet(a.nodes)
    out = (audit.label_prior(labels, nodes) if a.kind == "prior"
           else audit.baseline_random(labels.select("item").distinct(), nodes, a.seed))
    out.write.mode("errorifexists").parquet(a.output)
    return spark.read.parquet(a.output)


def job_coverage(spark, a) -> DataFrame:
    return audit.coverage(spark.read.parquet(a.input), spark.read.parquet(a.nodes).where("is_leaf"))


def job_make_split(spark, a) -> DataFrame:
    """Pin a group-disjoint split of items(item, grp)."""
    items = spark.read.parquet(a.input)
    groups = balanced.greedy_split(items, {"train": .7, "val": .1, "test": .2}, a.seed)
    runs.write_split_pin(items.join(groups.select("grp", "split"), "grp"), a.output)
    return groups.groupBy("split").agg(F.sum("n").alias("n"))


def _sides(spark, a) -> dict[str, DataFrame]:
    """Observations (item, node, y, score, grp) of candidate and incumbent: tables, or archived runs."""
    return {name: spark.read.parquet(f"{path}/obs" if a.archived else path)
            for name, path in (("cand", a.input), ("inc", a.scores))}


def _runs(sides: dict[str, DataFrame]) -> DataFrame:
    """Rows of all runs; an observation without a group is a group by itself."""
    def grp(df):
        return F.col("grp").cast("string") if "grp" in df.columns else F.col("item").cast("string")
    return gate.union_all([df.select(F.lit(r).alias("run"), "item", "node", "y", "score", grp(df).alias("grp"))
                           for r, df in sides.items()])


def _leaves(spark, a, obs: DataFrame) -> DataFrame:
    """Leaves of --nodes, else the observed nodes without an observed child."""
    if a.nodes:
        return spark.read.parquet(a.nodes).where("is_leaf").select("node")
    seen = obs.select("node").distinct()
    return seen.join(seen.select(taxonomy.parent_of("node").alias("node")), "node", "left_anti")


def job_compare(spark, a) -> DataFrame:
    """Gate of a candidate against an incumbent, both (item, node, y, score, grp) of equal pairs.

    The primary must improve, with an interval that excludes 0 unless --no-bootstrap; secondaries may
    not regress. Archived runs are compared only if their settings and hashes agree.
    """
    sides = _sides(spark, a)
    for name, df in sides.items():
        evaluate.require_unique(df, name)
    leaves = _leaves(spark, a, sides["cand"])
    summaries = [evaluate.summary(df.select("item", "node", "y"), df.select("item", "node", "score"), leaves, threshold=a.threshold)
                 for df in sides.values()]
    wanted = [a.primary, *(a.secondary or SECONDARIES)]
    table = gate.metric_pairs(*summaries).where(F.col("metric").isin(wanted))
    errors = bootstrap.alignment_errors(*[_runs({"x": df}) for df in sides.values()]).select(F.col("reason").alias("key"))
    if a.archived:
        configs = [runs.read_run_config(spark, path) for path in (a.input, a.scores)]
        errors = errors.unionByName(gate.comparability(*configs).select("key"))
    ci = None
    if not a.no_bootstrap:
        values = resample.node_values(_runs(sides), a.n_boot, a.seed, a.threshold)
        ci = resample.paired_intervals(resample.run_values(values, leaves, [a.primary]), "cand", "inc")
    return gate.promotion_gate(table, a.primary, errors, ci, a.tolerance)


def _trained(spark, path: str) -> DataFrame:
    return selection.trained_nodes(spark.read.parquet(path))


def job_adopt(spark, a) -> DataFrame:
    """Adoption of a new model on the nodes both were trained on (--check old) or only the candidate
    was (--check new); --train and --inc-train hold the training counts (node, n)."""
    sides = _sides(spark, a)
    sets = selection.node_sets(_trained(spark, a.train), _trained(spark, a.inc_train), sides["cand"].select("node").distinct())
    pool = sets.where(F.col("kind") == ("shared" if a.check == "old" else "added")).select("node")
    nodes = selection.scoreable(_runs({"cand": sides["cand"]}), pool, a.min_pos, a.min_neg, a.min_groups).select("node")
    if a.check == "new":
        sides["chance"] = audit.chance_scores(sides["cand"])
    values = resample.node_values(_runs(sides).join(nodes, "node", "left_semi"), a.n_boot, a.seed)
    if a.check == "old":
        return gate.check_old_nodes(values, "cand", "inc")
    return gate.check_new_nodes(values, "cand", "inc", "chance")


def job_triangle(spark, a) -> DataFrame:
    """Arms of the archived runs of a folder: `<arm>_s<seed>`, the newest run of every name. With --pair
    the differences of arms, else a row per arm; --nodes restricts both to its leaves."""
    newest = [(r["name"], r["folder"]) for r in runs.archived_runs(spark, a.input).orderBy("name").collect()
              if r["name"].startswith(a.match)]
    if not newest:
        raise ValueError(f"no archived run starts with {a.match!r}")
    sides = {name[len(a.strip):]: spark.read.parquet(f"{a.input}/run={folder}/obs") for name, folder in newest}
    obs = _runs(sides).join(_leaves(spark, a, next(iter(sides.values()))), "node", "left_semi")
    values = resample.node_values(obs, a.n_boot, a.seed)
    named = values.select("run").distinct().select("run", gate.arm_of(F.col("run")).alias("arm"), gate.seed_of(F.col("run")).alias("seed"))
    if a.pair:
        return gate.arm_pairs(values, named, [tuple(p.split(":", 1)) for p in a.pair])
    return gate.arm_intervals(values, named)


def job_calibrate(spark, a) -> DataFrame:
    """Platt parameters per node from (node, y, score)."""
    fits = calibrate.fit_platt(spark.read.parquet(a.input))
    fits.write.mode("errorifexists").parquet(a.output)
    return fits


JOBS = {"taxonomy": job_taxonomy, "run": job_run, "baseline": job_baseline, "coverage": job_coverage,
        "make-split": job_make_split, "compare": job_compare, "adopt": job_adopt, "triangle": job_triangle,
        "calibrate": job_calibrate}
#: Jobs whose whole result goes to --output.
REPORTS = ("taxonomy", "coverage", "compare", "adopt", "triangle")
#: Metric that a candidate must improve.
PRIMARY = "map_leaf"
#: Metrics that may not regress (fixed values).
SECONDARIES = ("map_macro", "f1_macro_leaf", "hier_f1", "ece", "ece_classwise")
#: Rows printed on the console.
PREVIEW = 200


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="labelgrove.jobs")
    p.add_argument("job", choices=sorted(JOBS))
    p.add_argument("--input", required=True, help="labels, items, observations or taxonomy file")
    p.add_argument("--scores", help="predictions, or the incumbent's observations")
    p.add_argument("--archived", action="store_true", help="compare, adopt: both are folders of archived runs")
    p.add_argument("--train", help="run: training labels of the prior; adopt: the candidate's training counts")
    p.add_argument("--inc-train", help="adopt: the incumbent's training counts")
    p.add_argument("--check", choices=("old", "new"), default="old")
    p.add_argument("--min-pos", type=int, default=3)
    p.add_argument("--min-neg", type=int, default=3)
    p.add_argument("--min-groups", type=int, default=1)
    p.add_argument("--kind", choices=("prior", "random"), default="prior")
    p.add_argument("--threshold", type=float, default=0.5)
    p.add_argument("--primary", default=PRIMARY)
    p.add_argument("--secondary", action="append", help="repeatable")
    p.add_argument("--tolerance", type=float, help="regression that every secondary may show")
    p.add_argument("--no-bootstrap", action="store_true")
    p.add_argument("--match", default="", help="triangle: prefix of run names")
    p.add_argument("--strip", default="", help="triangle: prefix taken off run names")
    p.add_argument("--pair", action="append", help="triangle: CANDIDATE:INCUMBENT arms, repeatable")
    p.add_argument("--nodes", help="node table")
    p.add_argument("--output", help="folder to write; never overwritten")
    p.add_argument("--allow-missing", action="store_true", help="run: score items that have predictions only")
    p.add_argument("--no-propagate", action="store_true", help="run: keep scores as they are")
    p.add_argument("--name", default="run")
    p.add_argument("--stamp", default=time.strftime("%Y%m%dT%H%M%SZ", time.gmtime()))
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--n-boot", type=int, default=1000)
    a = p.parse_args(argv)
    result = JOBS[a.job](get_session(f"labelgrove-{a.job}"), a)
    if a.output and a.job in REPORTS:
        result.write.parquet(a.output)
        result = result.sparkSession.read.parquet(a.output)
    result.show(PREVIEW, truncate=False)
    if (rows := result.count()) > PREVIEW:
        print(f"{rows} rows, of which {PREVIEW} are shown; --output takes all")


if __name__ == "__main__":
    main()
