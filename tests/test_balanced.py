"""The greedy rule against its loop, and improvement that never costs more."""

import hashlib
import random

import numpy as np
import pytest

from labelgrove.operators import balanced as B
from labelgrove.operators import splits as P


def loop(groups, fractions, seed):
    total = sum(groups.values())
    lack = {s: total * f / sum(fractions.values()) for s, f in fractions.items()}
    out = {}
    for g in sorted(groups, key=lambda g: (-groups[g], hashlib.sha256(f"{seed}:{g}".encode()).hexdigest())):
        out[g] = max(lack, key=lambda s: (lack[s], -list(lack).index(s)))
        lack[out[g]] -= groups[g]
    return out


@pytest.mark.parametrize("fractions", [{"train": .7, "val": .1, "test": .2}, {"a": 1, "b": 1, "c": 1}, {"x": .8, "none": 0.0, "y": .2}])
def test_greedy_equals_the_loop(spark, fractions):
    rng = random.Random(3)
    for sizes in ({f"g{i}": rng.choice([1, 1, 1, 2, 3, 7, 50]) for i in range(300)}, {"big": 60, **{f"s{i}": 1 for i in range(40)}}):
        df = spark.createDataFrame(list(sizes.items()), "grp string, n long")
        got = {r.grp: r.split for r in B.place_groups(df, fractions, 5).collect()}
        assert got == loop(sizes, fractions, 5)
        if "val" in fractions:
            assert set(got.values()) == set(fractions)


def test_places_of_many_equal_groups():
    lack = np.array([70_000.3, 10_000.1, 19_999.6])
    at = np.arange(0, 100_000, 997)
    picks = B.picks_before(np.tile(lack, (len(at), 1)), np.ones(len(at)), at)
    assert (picks.sum(1) == at).all() and np.abs(picks[-1] - lack * at[-1] / 1e5).max() < 4000 and (np.diff(picks, axis=0) >= 0).all()


def test_improvement(spark):
    rng = random.Random(6)
    strata = [(f"g{k}", s, rng.randrange(1, 6)) for k in range(60) for s in rng.sample(["p", "q", "r", "t"], 2)] + [("g1", "rare", 1), ("g2", "rare", 1), ("g3", "rare", 2)]
    table = spark.createDataFrame(strata, "grp string, stratum string, n long")
    sizes = table.groupBy("grp").sum("n").withColumnRenamed("sum(n)", "n")
    fixed = spark.createDataFrame([("g1", "test"), ("g2", "test")], "grp string, split string")
    fractions = {"train": .6, "val": .2, "test": .2}
    out, costs = B.improved_split(sizes, table, fractions, fixed, seed=2)
    got = {r.grp: r.split for r in out.collect()}
    assert len(got) == 60 and got["g1"] == got["g2"] == "test"
    assert all(b < a for a, b in zip(costs, costs[1:])) and len(costs) > 1

    def cost(assign):
        names, total = list(fractions), {}
        for g, s, n in [*strata, *[(g, None, n) for g, _, n in strata]]:
            total.setdefault(s, dict.fromkeys(names, 0))[assign[g]] += n
        out = 0.0
        for s, c in total.items():
            n = sum(c.values())
            dev = sum(((c[x] - fractions[x] * n) / n) ** 2 for x in names)
            out += 5 * dev if s is None else (dev if n >= 2 else 0) + sum(n >= 3 and c[x] == 0 for x in names)
        return out
    assert cost(got) == pytest.approx(costs[-1])
    best_of_8 = {r.grp: r.split for r in P.stratified_split(sizes, table, fractions, fixed, 8, 3).collect()}
    assert cost(got) < cost(best_of_8)


def test_carved_validation(spark):
    items = spark.createDataFrame([(i, f"g{i % 30}", "test" if i % 30 == 3 else "train") for i in range(300)], "item long, grp string, split string")
    out = B.carve_validation(items, .2, 1).collect()
    by = {r.grp: r.split for r in out}
    assert len(out) == 300 and all(by[r.grp] == r.split for r in out) and by["g3"] == "test"
    assert sum(s == "val" for s in by.values()) == 6


def test_no_groups(spark):
    none = spark.createDataFrame([], "grp string, n long")
    assert B.place_groups(none, {"a": 1.0}).count() == 0
    assert B.improved_split(none, spark.createDataFrame([], "grp string, stratum string, n long"), {"a": 1.0})[0].count() == 0
