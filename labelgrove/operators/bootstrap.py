"""Cluster bootstrap of average precision: resample groups, recompute every run on the same draws.

Rows are first reduced to distinct (run, node, score, group) counts. Each class is cut into chunks
of bounded size along its ranking; a chunk gets the cumulative counts of all
chunks above it for every resample, so its share of each resampled AP is one vectorised pass.
No task ever holds a whole class, and the resamples never multiply the shuffled rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelgrove.functions.hashing import hash_int
from labelgrove.operators.scan import row_numbers, running_totals, score_chunk
from labelgrove.session import cut_lineage

KEYS = ["run", "node"]
CELLS = 8_000_000  # counts (rows x resamples) one Python call holds at most
DRAW_BLOCK = 65_536
# row kinds of a chunk: ranking rows, draw counts of a group, and scores summed per resample
ROWS, GROUPS, TIES = 0, 1, 2
_TYPES = {"grp": "string", "score": "double", "n": "long", "tp": "long", "rs": "array<int>",
          "ms": "array<int>", "vn": "array<long>", "vtp": "array<long>"}


def _empty(*columns: str) -> list[Column]:
    return [F.lit(None).cast(_TYPES[c]).alias(c) for c in columns]


def group_index(groups: DataFrame, group: str = "grp") -> DataFrame:
    """Distinct groups numbered from 0 in the order of their MD5."""
    g = groups.select(group).distinct().withColumn("h", F.md5(F.col(group).cast("string")))
    g = g.withColumn("chunk", F.substring("h", 1, 3))
    return row_numbers(g, [], "chunk", [F.col("h"), F.col(group)], "rn").select(
        group, (F.col("rn") - 1).alias("idx"))


def draws(groups: DataFrame, n_boot: int, seed: int = 0, group: str = "grp") -> DataFrame:
    """(grp, r, m): how often each group is drawn in resample r (as many draws as groups)."""
    index = group_index(groups, group)
    n_groups = groups.agg(F.count_distinct(group)).scalar()
    resamples = groups.sparkSession.range(n_boot).select(F.col("id").cast("int").alias("r"))
    last = F.col("n_groups") - 1
    blocks = resamples.withColumn("n_groups", n_groups).select("r", "n_groups", F.explode(
        F.sequence(F.lit(0).cast("long"), F.floor(last / DRAW_BLOCK))).alias("b"))
    one = F.sequence(F.col("b") * DRAW_BLOCK, F.least(F.col("b") * DRAW_BLOCK + DRAW_BLOCK - 1, last))
    picks = blocks.select("r", "n_groups", F.explode(one).alias("d")).select(
        "r", (hash_int(seed, F.col("r"), F.col("d")) % F.col("n_groups")).alias("idx"))
    counts = picks.groupBy("r", "idx").agg(F.count(F.lit(1)).cast("int").alias("m"))
    return counts.join(index, "idx").select(group, "r", "m")


def identity_draws(groups: DataFrame, n_boot: int, group: str = "grp") -> DataFrame:
    """Every group exactly once in each resample (resampled metrics equal the point estimate)."""
    return (groups.select(group).distinct()
            .select(group, F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("r"),
                    F.lit(1).alias("m")))


def _prepare(pdf: pd.DataFrame, n_boot: int):
    """Ranking rows of one chunk as weighted count matrices (distinct scores x resamples)."""
    data = pdf[pdf["kind"] == ROWS].sort_values("score", ascending=False, kind="stable")
    drawn = pdf[pdf["kind"] == GROUPS]
    weights = np.zeros((len(drawn) + 1, n_boot))
    place = {}
    for i, (g, rs, ms) in enumerate(zip(drawn["grp"], drawn["rs"], drawn["ms"])):
        place[g] = i
        weights[i, np.asarray(rs, dtype=int)] = ms
    codes = data["grp"].map(place).fillna(len(drawn)).to_numpy(dtype=int)
    score = data["score"].to_numpy(dtype=float)
    n, tp = np.zeros((0, n_boot)), np.zeros((0, n_boot))
    if len(score):
        starts = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
        w = weights[codes]
        n = np.add.reduceat(w * data["n"].to_numpy(dtype=float)[:, None], starts, axis=0)
        tp = np.add.reduceat(w * data["tp"].to_numpy(dtype=float)[:, None], starts, axis=0)
        score = score[starts]
    ties = pdf[pdf["kind"] == TIES]
    if len(ties):  # scores shared by very many groups arrive already summed per resample
        extra = np.zeros((2, len(ties), n_boot))
        for i, (rs, vn, vtp) in enumerate(zip(ties["rs"], ties["vn"], ties["vtp"])):
            at = np.asarray(rs, dtype=int)
            extra[0, i, at], extra[1, i, at] = vn, vtp
        score = np.r_[score, ties["score"].to_numpy(dtype=float)]
        order = np.argsort(-score, kind="stable")
        n, tp = np.vstack([n, extra[0]])[order], np.vstack([tp, extra[1]])[order]
    return n, tp


def bootstrap_ap(obs: DataFrame, drawn: DataFrame, n_boot: int,
                 chunk_rows: int | None = None) -> DataFrame:
    """(run, node, r, ap) for every resample; null where a class lacks positives or negatives.

    `obs(run, node, grp, y, score)`, `drawn(grp, r, m)`. A chunk has at most twice `chunk_rows`
    rows: scores shared by more groups than that are summed per resample by Spark beforehand and
    count as one row.
    """
    limit = chunk_rows or max(500, CELLS // n_boot)
    rows = cut_lineage(obs.groupBy(*KEYS, "score", "grp")
                       .agg(F.count(F.lit(1)).alias("n"), F.count_if("y").alias("tp")))
    per_score = (rows.groupBy(*KEYS, "score").agg(F.count(F.lit(1)).alias("k"))
                 .withColumns({"sc": score_chunk("score"), "heavy": F.col("k") > limit}))
    per_score = per_score.withColumn("m", F.when(F.col("heavy"), 1).otherwise(F.col("k")))
    placed = running_totals(per_score, KEYS, "sc", [F.col("score").desc()], {"m": "upto"}, True)
    chunk = F.floor((F.col("upto") - F.col("m")) / limit).cast("long").alias("chunk")
    scores = placed.select(*KEYS, "score", "heavy", chunk)
    located = rows.join(scores, [*KEYS, "score"])
    light = located.where(~F.col("heavy")).select(
        *KEYS, "chunk", F.lit(ROWS).alias("kind"), "grp", "score", "n", "tp", *_empty("rs", "ms", "vn", "vtp"))
    packed = drawn.groupBy("grp").agg(F.collect_list(F.struct("r", "m")).alias("rm")).select(
        "grp", F.col("rm.r").alias("rs"), F.col("rm.m").alias("ms"))
    groups = (light.select(*KEYS, "chunk", "grp").distinct().join(packed, "grp").select(
        *KEYS, "chunk", F.lit(GROUPS).alias("kind"), "grp", *_empty("score", "n", "tp"), "rs", "ms",
        *_empty("vn", "vtp")))
    summed = (located.where("heavy").join(drawn, "grp").groupBy(*KEYS, "chunk", "score", "r")
              .agg(F.sum(F.col("n") * F.col("m")).alias("vn"), F.sum(F.col("tp") * F.col("m")).alias("vtp"))
              .groupBy(*KEYS, "chunk", "score").agg(F.collect_list(F.struct("r", "vn", "vtp")).alias("v")))
    ties = summed.select(
        *KEYS, "chunk", F.lit(TIES).alias("kind"), *_empty("grp"), "score", *_empty("n", "tp"),
        F.col("v.r").alias("rs"), *_empty("ms"), F.col("v.vn").alias("vn"), F.col("v.vtp").alias("vtp"))
    # both passes read this table; it keeps its partitioning, so neither shuffles it again
    inputs = cut_lineage(light.unionByName(groups).unionByName(ties).repartition(*KEYS, "chunk"))

    def chunk_totals(pdf: pd.DataFrame) -> pd.DataFrame:
        n, tp = _prepare(pdf, n_boot)
        return pd.DataFrame({"run": [pdf["run"].iat[0]], "node": [pdf["node"].iat[0]],
                             "chunk": [pdf["chunk"].iat[0]], "tot_n": [n.sum(0)],
                             "tot_tp": [tp.sum(0)]})

    totals = (inputs.groupBy(*KEYS, "chunk")
              .applyInPandas(chunk_totals, "run string, node string, chunk long, "
                                           "tot_n array<double>, tot_tp array<double>"))
    flat = totals.select(*KEYS, "chunk", F.posexplode(F.arrays_zip("tot_n", "tot_tp"))
                         .alias("r", "v")).select(*KEYS, "chunk", "r", "v.tot_n", "v.tot_tp")
    above = Window.partitionBy(*KEYS, "r").orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    based = flat.select(*KEYS, "chunk", F.struct(
        "r", F.coalesce(F.sum("tot_n").over(above), F.lit(0.0)).alias("bn"),
        F.coalesce(F.sum("tot_tp").over(above), F.lit(0.0)).alias("bt")).alias("b"))
    bases = (based.groupBy(*KEYS, "chunk").agg(F.array_sort(F.collect_list("b")).alias("b"))
             .select(*KEYS, "chunk", F.col("b.bn").alias("base_n"), F.col("b.bt").alias("base_tp")))

    def chunk_parts(pdf: pd.DataFrame, above_it: pd.DataFrame) -> pd.DataFrame:
        n, tp = _prepare(pdf, n_boot)
        base = above_it.iloc[0]
        cum_n = np.asarray(base["base_n"])[None, :] + n.cumsum(0)
        cum_tp = np.asarray(base["base_tp"])[None, :] + tp.cumsum(0)
        with np.errstate(invalid="ignore", divide="ignore"):
            part = np.where(cum_n > 0, tp * cum_tp / cum_n, 0.0).sum(0)
        return pd.DataFrame({"run": pdf["run"].iat[0], "node": pdf["node"].iat[0],
                             "r": np.arange(n_boot), "part": part, "n": n.sum(0),
                             "tp": tp.sum(0)})

    parts = (inputs.groupBy(*KEYS, "chunk").cogroup(bases.groupBy(*KEYS, "chunk"))
             .applyInPandas(chunk_parts, "run string, node string, r int, part double, "
                                         "n double, tp double"))
    total = parts.groupBy(*KEYS, "r").agg(*[F.sum(c).alias(c) for c in ("part", "n", "tp")])
    defined = (F.col("tp") > 0) & (F.col("tp") < F.col("n"))
    return total.select(*KEYS, "r", F.when(defined, F.col("part") / F.col("tp")).alias("ap"))


def resample(obs: DataFrame, drawn: DataFrame, n_boot: int) -> DataFrame:
    """`bootstrap_ap` computed once and kept in the checkpoint folder, as several intervals
    usually read it; it has one row per run, node and resample."""
    return cut_lineage(bootstrap_ap(obs, drawn, n_boot))


def macro_draws(ap: DataFrame, by_node: bool = False) -> DataFrame:
    """(run, node, r, value): mean over defined classes per resample, or each class by itself."""
    if by_node:
        return ap.withColumnRenamed("ap", "value")
    return (ap.groupBy("run", "r").agg(F.avg("ap").alias("value"))
            .select("run", F.lit("(macro)").alias("node"), "r", "value"))


def paired_ci(values: DataFrame, point: DataFrame, candidate: str, incumbent: str, n_boot: int,
              alpha: float = 0.05) -> DataFrame:
    """(node, delta, lo, hi, n_valid, n_boot): percentile interval of candidate - incumbent.

    `values(run, node, r, value)`, `point(run, node, value)`. A resample counts only if the
    metric is defined on both sides.
    """
    def side_by_side(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.max(F.when(F.col("run") == candidate, F.col("value"))).alias("c"),
            F.max(F.when(F.col("run") == incumbent, F.col("value"))).alias("i"))

    d = F.col("c") - F.col("i")
    draws_ = side_by_side(values, "node", "r").select("node", d.alias("d"), F.lit(True).alias("drawn"))
    points = side_by_side(point, "node").select("node", d.alias("d"), F.lit(False).alias("drawn"))
    x = F.when(F.col("drawn"), F.col("d"))
    return points.unionByName(draws_).groupBy("node").agg(
        F.max(F.when(~F.col("drawn"), F.col("d"))).alias("delta"), *_interval(x, alpha),
        F.lit(n_boot).alias("n_boot"))


def _interval(x: Column, alpha: float) -> list[Column]:
    """Percentile interval over at most n_boot values per key."""
    return [F.percentile(x, F.lit(alpha / 2)).alias("lo"),
            F.percentile(x, F.lit(1 - alpha / 2)).alias("hi"), F.count(x).alias("n_valid")]


def single_ci(values: DataFrame, point: DataFrame, n_boot: int, alpha: float = 0.05) -> DataFrame:
    """(run, node, value, lo, hi, n_valid, n_boot) of each run by itself, on the same draws."""
    rows = (point.select("run", "node", "value", F.lit(False).alias("drawn"))
            .unionByName(values.select("run", "node", "value", F.lit(True).alias("drawn"))))
    return rows.groupBy("run", "node").agg(
        F.max(F.when(~F.col("drawn"), F.col("value"))).alias("value"),
        *_interval(F.when(F.col("drawn"), F.col("value")), alpha), F.lit(n_boot).alias("n_boot"))


def alignment_errors(candidate: DataFrame, incumbent: DataFrame) -> DataFrame:
    """Why two runs cannot be paired: (item, node) pairs missing on one side or labelled apart.

    Both sides have (item, node, y, grp).
    """
    c = candidate.select("item", "node", F.col("y").alias("cy"), F.col("grp").alias("cg"))
    i = incumbent.select("item", "node", F.col("y").alias("iy"), F.col("grp").alias("ig"))
    why = (F.when(F.col("cy").isNull(), "only_incumbent").when(F.col("iy").isNull(), "only_candidate")
           .when(F.col("cy") != F.col("iy"), "labels_differ")
           .when(~F.col("cg").eqNullSafe(F.col("ig")), "groups_differ"))
    return (c.join(i, ["item", "node"], "full_outer").select(why.alias("reason"))
            .where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n")))
