"""The metric-generic bootstrap against plain loops over repeated rows, cut into ranges of any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelgrove.operators import metrics as M
from labelgrove.operators import resample as RS

N_BOOT = 70


def rows(spark, n=400):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([
        (run, f"n{i % 3}", None if i % 11 == 0 else f"g{i % 17}", bool(rng.random() < 0.4 + 0.2 * (i % 3)),
         float(rng.integers(0, 6)) / 5) for run in ("a", "b") for i in range(n)] + [
        (run, "only", "g1", True, 0.7) for run in ("a", "b")],
        "run string, node string, grp string, y boolean, score double")


def plain(obs, word, r):
    """Metrics of one resample by looping over rows with their weights."""
    weight = {g: RS.weights(np.array([w]), np.array([r]))[0, 0] for g, w in word.items()}
    out = {}
    for key in {(o.run, o.node) for o in obs}:
        mine = [(o.score, o.y, weight[o.grp]) for o in obs if (o.run, o.node) == key]
        n, tp = sum(w for *_, w in mine), sum(w for _, y, w in mine if y)
        ap = None
        if 0 < tp < n:
            ap = 0.0
            for s in {s for s, *_ in mine}:
                cn, ct = (sum(w for s2, y, w in mine if s2 >= s and (y or not only)) for only in (False, True))
                own = sum(w for s2, y, w in mine if s2 == s and y)
                ap += own * ct / cn / tp if cn else 0
        bins = [(min(int(np.floor(s * 15)), 14), y - s, w) for s, y, w in mine]
        ece = sum(abs(sum(g * w for b, g, w in bins if b == k)) for k in range(15)) / n if n else None
        brier = sum(w * (s - y) ** 2 for s, y, w in mine) / n if n else None
        out[key] = (n, tp, ap, ece, brier)
    return out


@pytest.mark.parametrize("size", [50_000, 40, 7])
def test_values_equal_loops(spark, size):
    obs = rows(spark)
    got = RS.node_values(obs, N_BOOT, seed=5, rows=size).collect()
    word = {r.grp: r.w for r in obs.select("grp", RS.group_word(5, F.col("grp")).alias("w")).distinct().collect()}
    assert len(got) == 8 * (N_BOOT + 1)
    table = obs.collect()
    for r in (-1, 0, 63, 64, 69):
        want = plain(table, word, r)
        for x in got:
            if x.r == r:
                for a, b in zip((x.n, x.tp, x.ap, x.ece, x.brier), want[x.run, x.node]):
                    assert (a is None and b is None) or a == pytest.approx(b, abs=1e-12)


def test_point_estimate_is_the_metric(spark):
    obs = rows(spark)
    point = {(r.run, r.node): r.ap for r in RS.node_values(obs, 2).where("r = -1").collect()}
    want = {(r.run, r.node): r.ap for r in M.average_precision(obs, ["run", "node"]).collect()}
    assert point.keys() == want.keys()
    assert all(point[k] == want[k] or point[k] == pytest.approx(want[k]) for k in want)


def test_weights_are_poisson():
    w = RS.weights(np.arange(0, 2 ** 32, 2 ** 20), np.arange(200))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.05


def test_equal_runs_have_no_interval_and_unknown_metrics_fail(spark):
    obs = rows(spark)
    same = obs.where("run = 'a'").unionByName(obs.where("run = 'a'").withColumn("run", F.lit("b")))
    leaves = obs.select("node").distinct()
    values = RS.node_values(same, 20)
    for r in RS.paired_intervals(RS.run_values(values, leaves), "a", "b").collect():
        assert max(abs(r.delta), abs(r.lo), abs(r.hi)) < 1e-12 and r.n_valid == r.n_boot == 20
    with pytest.raises(ValueError, match="unknown metrics"):
        RS.run_values(values, leaves, ["map_leaf", "speed"])


def test_no_rows(spark):
    assert RS.node_values(rows(spark).limit(0), 5).count() == 0
