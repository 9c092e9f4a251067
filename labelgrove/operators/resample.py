"""Cluster bootstrap of any metric: groups get hashed weights, and every metric follows from sums.

A resample gives each group a Poisson(1) weight, the form of drawing groups with replacement in which
groups are independent of each other. The weight follows from a hash of (seed, group, resample), so a
task computes it where it needs it: there is no table of draws, all runs see the same resamples, and
nothing grows with resamples x rows. Resample -1 has all weights 1; it is the point estimate.

Rows shrink to counts of (run, node, score, group) and are cut by the data into ranges of the ranking.
A task multiplies the weights of its rows with their contributions: counts, squared errors, hits and
calibration bins are sums that merge across tasks. Average precision also needs what ranks above a
range, one row of sums per range; scores that tie across ranges are carried the same way.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelgrove.session import cut_lineage

POINT = -1
#: Rows of a range, and resamples whose weights a task holds at once.
ROWS, BLOCK = 50_000, 64
N_BINS = 15
_WORD = np.uint64(0xFFFFFFFF)
#: Cumulative Poisson(1) probabilities in units of 2**-32; a weight is the number of them not above the hash.
POISSON = [math.floor(2 ** 32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]


def group_word(seed: int, group: Column) -> Column:
    """32-bit hash of a group; a null group is a group."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(group.cast("string"), F.lit("\0")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def weights(words: np.ndarray, resamples: np.ndarray) -> np.ndarray:
    """Weights of groups x resamples; 1 for resample POINT."""
    x = (words.astype(np.uint64)[:, None] + resamples.astype(np.uint64)[None, :] * np.uint64(2654435769)) & _WORD
    x ^= x >> np.uint64(16)
    x = (x * np.uint64(0x7FEB352D)) & _WORD
    x ^= x >> np.uint64(15)
    x = (x * np.uint64(0x846CA68B)) & _WORD
    x ^= x >> np.uint64(16)
    out = np.searchsorted(np.array(POISSON, np.uint64), x, "right").astype(float)
    out[:, resamples == POINT] = 1
    return out


def _contributions(score: np.ndarray, n: np.ndarray, tp: np.ndarray, threshold: float, bins: int) -> np.ndarray:
    """Per row: n, positives, squared error, true and false hits, then n, scores and positives per bin."""
    hit = score >= threshold
    out = np.zeros((len(score), 5 + 3 * bins))
    out[:, 0], out[:, 1], out[:, 3], out[:, 4] = n, tp, tp * hit, (n - tp) * hit
    out[:, 2] = tp * (1 - score) ** 2 + (n - tp) * score ** 2
    b = np.clip(np.floor(score * bins), 0, bins - 1).astype(int)
    at = np.arange(len(score))
    out[at, 5 + b], out[at, 5 + bins + b], out[at, 5 + 2 * bins + b] = n, n * score, tp
    return out


class _Range:
    """Rows of one range, sorted: segments are its (run, node) pairs, ties their distinct scores."""

    def __init__(self, rows: pa.Table):
        pdf = rows.select(["run", "node", "score", "word", "n", "tp"]).to_pandas().sort_values(
            ["run", "node", "score"], ascending=[True, True, False], kind="stable", ignore_index=True)
        pair = (pdf["run"] != pdf["run"].shift()) | (pdf["node"] != pdf["node"].shift())
        tie = pair | (pdf["score"] != pdf["score"].shift())
        self.part = rows.column("part")[0].as_py()
        self.segment, self.tie = np.flatnonzero(pair), np.flatnonzero(tie)
        self.first_tie = np.searchsorted(self.tie, self.segment)
        self.last_tie = np.append(self.first_tie[1:], len(self.tie)) - 1
        self.run, self.node = pdf["run"].to_numpy()[self.segment], pdf["node"].to_numpy()[self.segment]
        self.score, self.n, self.tp = (pdf[c].to_numpy(float) for c in ("score", "n", "tp"))
        self.words, self.group = np.unique(pdf["word"].to_numpy(), return_inverse=True)

    def weight(self, resamples: np.ndarray) -> np.ndarray:
        return weights(self.words, resamples)[self.group]

    def tied(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weighted rows and positives of every tie."""
        return (np.add.reduceat(weight * self.n[:, None], self.tie, axis=0),
                np.add.reduceat(weight * self.tp[:, None], self.tie, axis=0))


def _blocks(n_boot: int) -> list[np.ndarray]:
    return [np.arange(a, min(a + BLOCK, n_boot)) for a in range(POINT, n_boot, BLOCK)]


_SUMS = "run string, node string, part long, block int, first double, last double, sums binary, head_n binary, head_tp binary"


def _range_sums(n_boot: int, threshold: float, bins: int):
    def run(rows: pa.Table) -> pa.Table:
        r, out = _Range(rows), []
        what = _contributions(r.score, r.n, r.tp, threshold, bins)
        ends = np.append(r.segment[1:], len(r.score))
        for block, resamples in enumerate(_blocks(n_boot)):
            w = r.weight(resamples)
            n, tp = r.tied(w)
            for i, (a, b) in enumerate(zip(r.segment, ends, strict=True)):
                out.append((r.run[i], r.node[i], r.part, block, r.score[a], r.score[b - 1], (what[a:b].T @ w[a:b]).tobytes(),
                            n[r.first_tie[i]].tobytes(), tp[r.first_tie[i]].tobytes()))
        return pa.Table.from_pylist([dict(zip(_names(_SUMS), x, strict=True)) for x in out], _schema(_SUMS))
    return run


_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _schema(schema: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in schema.split(", ")])


_BASES = "run string, node string, part long, block int, base binary, after binary"


def _range_bases(rows: pa.Table) -> pa.Table:
    """What ranks above each range of a (run, node) pair, and what later ranges add to its last score."""
    ranges = sorted(rows.to_pylist(), key=lambda x: x["part"])
    width = len(np.frombuffer(ranges[0]["head_n"]))
    after, out = np.zeros((2, width)), []
    totals = [np.frombuffer(x["sums"]).reshape(-1, width)[:2] for x in ranges]
    above = np.cumsum([np.zeros((2, width)), *totals[:-1]], axis=0)
    for i in range(len(ranges) - 1, -1, -1):
        x = ranges[i]
        if i + 1 == len(ranges) or ranges[i + 1]["first"] != x["last"]:
            after = np.zeros((2, width))
        out.append({"run": x["run"], "node": x["node"], "part": x["part"], "block": x["block"], "base": above[i].tobytes(),
                    "after": after.tobytes()})
        head = np.array([np.frombuffer(x["head_n"]), np.frombuffer(x["head_tp"])])
        after = head + after if x["first"] == x["last"] else head
    return pa.Table.from_pylist(out, _schema(_BASES))


_PARTS = "run string, node string, part long, block int, ap binary"


def _range_precision(n_boot: int):
    def run(rows: pa.Table, bases: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _schema(_PARTS).empty_table()
        r, out = _Range(rows), []
        known = {(x["run"], x["node"], x["block"]): x for x in bases.to_pylist()}
        for block, resamples in enumerate(_blocks(n_boot)):
            n, tp = r.tied(r.weight(resamples))
            for i, (a, b) in enumerate(zip(r.first_tie, r.last_tie + 1, strict=True)):
                x = known[r.run[i], r.node[i], block]
                (base_n, base_tp), (more_n, more_tp) = (np.frombuffer(x[c]).reshape(2, -1) for c in ("base", "after"))
                cum_n, cum_tp = base_n + n[a:b].cumsum(0), base_tp + tp[a:b].cumsum(0)
                cum_n[-1] += more_n
                cum_tp[-1] += more_tp
                part = np.divide(tp[a:b] * cum_tp, cum_n, out=np.zeros_like(cum_n), where=cum_n > 0).sum(0)
                out.append((r.run[i], r.node[i], r.part, block, part.tobytes()))
        return pa.Table.from_pylist([dict(zip(_names(_PARTS), x, strict=True)) for x in out], _schema(_PARTS))
    return run


def _per_resample(n_boot: int, bins: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        resamples = _blocks(n_boot)[key[2]]
        sums = np.sum([np.frombuffer(x) for x in pdf["sums"].dropna()], axis=0).reshape(-1, len(resamples))
        part = np.sum([np.frombuffer(x) for x in pdf["ap"].dropna()], axis=0)
        n, tp, square, hits, false = sums[:5]
        bin_n, bin_s, bin_tp = sums[5:].reshape(3, bins, -1)
        with np.errstate(invalid="ignore", divide="ignore"):
            ranked = (tp > 0) & (tp < n)
            return pd.DataFrame({
                "run": key[0], "node": key[1], "r": resamples, "n": n, "tp": tp, "hits": hits, "false_hits": false, "square": square,
                "ap": np.where(ranked, part / tp, np.nan),
                "f1": np.where(ranked, 2 * hits / (tp + hits + false), np.nan),
                "ece": np.where(n > 0, np.abs(bin_tp - bin_s).sum(0) / n, np.nan), "brier": np.where(n > 0, square / n, np.nan),
                "gaps": list((bin_tp - bin_s).T)})
    return run


NODE_VALUES = ("run string, node string, r int, n double, tp double, hits double, false_hits double, square double, "
               "ap double, f1 double, ece double, brier double, gaps array<double>")


def node_values(obs: DataFrame, n_boot: int, seed: int = 0, threshold: float = 0.5, bins: int = N_BINS,
                rows: int = ROWS) -> DataFrame:
    """(run, node, r, ...) for the point estimate (r = -1) and every resample: weighted counts, ap, f1,
    ece, brier and the gap of each calibration bin, computed once and kept in the checkpoint folder.

    `obs(run, node, grp, y, score)` holds observed pairs only. `ap` and `f1` are null where a class lacks
    positives or negatives in the resample, `ece` and `brier` where it lacks rows.
    """
    counts = cut_lineage(obs.groupBy("run", "node", "score", group_word(seed, F.col("grp")).alias("word")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("y").alias("tp")))
    ranges = max(1, math.ceil(counts.count() / rows))
    order = [F.col("run"), F.col("node"), F.col("score").desc(), F.col("word")]
    ranked = cut_lineage(counts.repartitionByRange(ranges, *order).withColumn(
        "part", F.spark_partition_id().cast("long")).repartition("part"))
    sums = cut_lineage(ranked.groupBy("part").applyInArrow(_range_sums(n_boot, threshold, bins), _SUMS))
    bases = sums.groupBy("run", "node", "block").applyInArrow(_range_bases, _BASES)
    parts = ranked.groupBy("part").cogroup(bases.groupBy("part")).applyInArrow(_range_precision(n_boot), _PARTS)
    both = sums.select("run", "node", "block", "sums", F.lit(None).cast("binary").alias("ap")).unionByName(
        parts.select("run", "node", "block", F.lit(None).cast("binary").alias("sums"), "ap"))
    values = both.groupBy("run", "node", "block").applyInPandas(_per_resample(n_boot, bins), NODE_VALUES)
    undefined = {c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("ap", "f1", "ece", "brier")}
    return cut_lineage(values.withColumns(undefined))


def run_metrics(bins: int = N_BINS) -> dict[str, Column]:
    """Metric name -> aggregate over the nodes of a run; `leaf` marks leaves. Calibration leaves out
    classes that have positives only."""
    leaf, mixed = F.col("leaf"), F.col("tp") < F.col("n")
    tp, found = F.sum(F.when(leaf, F.col("tp"))), F.sum(F.when(leaf, F.col("hits") + F.col("false_hits")))
    gap = sum((F.abs(F.sum(F.when(mixed, F.col("gaps")[i]))) for i in range(bins)), F.lit(0.0))
    n = F.sum(F.when(mixed, F.col("n")))
    return {"map_macro": F.avg("ap"), "map_leaf": F.avg(F.when(leaf, F.col("ap"))),
            "f1_macro_leaf": F.avg(F.when(leaf, F.col("f1"))),
            "f1_micro_leaf": F.when(tp + found > 0, 2 * F.sum(F.when(leaf, F.col("hits"))) / (tp + found)),
            "ece": F.when(n > 0, gap / n), "ece_classwise": F.avg(F.when(mixed, F.col("ece"))),
            "brier": F.when(n > 0, F.sum(F.when(mixed, F.col("square"))) / n)}


def run_values(values: DataFrame, leaves: DataFrame, metrics: Iterable[str] | None = None,
               bins: int = N_BINS) -> DataFrame:
    """(run, metric, r, value) of the chosen metrics, all by default, from `node_values`."""
    known = run_metrics(bins)
    chosen = list(known) if metrics is None else list(metrics)
    if unknown := sorted(set(chosen) - set(known)):
        raise ValueError(f"unknown metrics {unknown}; known are {sorted(known)}")
    marked = values.join(leaves.select("node", F.lit(True).alias("leaf")), "node", "left").fillna(False, ["leaf"])
    wide = marked.groupBy("run", "r").agg(*[known[m].alias(m) for m in chosen])
    return wide.unpivot(["run", "r"], chosen, "metric", "value").select("run", "metric", "r", "value")


def paired_intervals(values: DataFrame, candidate: str, incumbent: str, keys: Iterable[str] = ("metric",),
                     alpha: float = 0.05) -> DataFrame:
    """(keys, candidate, incumbent, delta, lo, hi, n_valid, n_boot): percentile interval of the difference.
    A resample counts if the value is defined on both sides."""
    keys = list(keys)
    side = lambda run: F.max(F.when(F.col("run") == run, F.col("value")))
    both = values.groupBy(*keys, "r").agg(side(candidate).alias("c"), side(incumbent).alias("i"))
    point, drawn = F.col("r") == POINT, F.when(F.col("r") != POINT, F.col("c") - F.col("i"))
    return both.groupBy(*keys).agg(
        F.max(F.when(point, F.col("c"))).alias("candidate"), F.max(F.when(point, F.col("i"))).alias("incumbent"),
        F.max(F.when(point, F.col("c") - F.col("i"))).alias("delta"), *_interval(drawn, alpha))


def single_intervals(values: DataFrame, keys: Iterable[str] = ("run", "metric"), alpha: float = 0.05) -> DataFrame:
    """(keys, value, lo, hi, n_valid, n_boot) of each run by itself."""
    point = F.col("r") == POINT
    return values.groupBy(*keys).agg(F.max(F.when(point, F.col("value"))).alias("value"),
                                     *_interval(F.when(~point, F.col("value")), alpha))


def _interval(x: Column, alpha: float) -> list[Column]:
    return [F.percentile(x, F.lit(alpha / 2)).alias("lo"), F.percentile(x, F.lit(1 - alpha / 2)).alias("hi"),
            F.count(x).cast("int").alias("n_valid"), F.count_if(F.col("r") != POINT).cast("int").alias("n_boot")]
