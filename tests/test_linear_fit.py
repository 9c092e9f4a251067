"""The joint fit against plain numpy on masked labels, its early stop, and the shortcut test."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelgrove.operators import linear_fit as L

rng = np.random.default_rng(4)
N, D, NODES = 240, 5, ["a", "b", "rare"]
X = rng.normal(size=(N, D)) * [1, 5, .1, 1, 1] + [0, 100, 0, 0, 3]
X[:, 4] = 7.0  # a feature that never changes
Y = np.column_stack([X[:, 0] + rng.normal(size=N) * .3 > 0, X[:, 1] > 103, np.arange(N) % 40 == 3])
SEEN = rng.random((N, 3)) < [.9, .5, 1]


def frames(spark):
    features = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)] + [(9999, [0.0] * D)], "item long, vec array<double>")
    labels = spark.createDataFrame([(i, NODES[k], bool(Y[i, k]), f"g{i % 13}") for i in range(N) for k in range(3) if SEEN[i, k]]
                                   + [(7777, "a", True, "g0")], "item long, node string, y boolean, grp string")
    return features.repartition(4), labels


def plain(rows, steps, rate, momentum, decay):
    x, y, m = X[rows], Y[rows], SEEN[rows]
    scale = np.maximum(x.std(0, ddof=1), 1e-4)
    x = np.column_stack([(x - x.mean(0)) / scale, np.ones(len(x))])
    pw = np.clip((~y & m).sum(0) / np.maximum((y & m).sum(0), 1), 1, 20)
    w = v = np.zeros((3, D + 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w.T))
        g = (m * np.where(y, pw, 1) * (p - y)).T @ x / m.sum(0)[:, None]
        g[:, :-1] += decay * w[:, :-1]
        v = momentum * v - rate * g
        w = w + v
    return w


def test_steps_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(L, "CELLS", 50)
    features, labels = frames(spark)
    model = L.fit(features, labels.where("item <> 7777"), steps=6, rate=.4, momentum=.8, decay=.02)
    rows = np.flatnonzero(SEEN.any(1))
    assert list(model.nodes) == NODES
    assert model.weights == pytest.approx(plain(rows, 6, .4, .8, .02), abs=1e-10)
    scores = {(r.item, r.node): r.score for r in L.score_all(model, features).collect()}
    assert len(scores) == (N + 1) * 3
    seen = L.score_rows(model, L.labelled(features, labels, NODES)).collect()
    assert len(seen) == SEEN.sum() and all(r.score == pytest.approx(scores[r.item, r.node]) and r.y == Y[r.item, NODES.index(r.node)] for r in seen)


def test_early_stop_keeps_the_best(spark):
    features, labels = frames(spark)
    model = L.fit(features, labels.where("item % 3 > 0"), labels.where("item % 3 = 0"), steps=40, rate=.5, every=2, patience=1)
    assert 0 < model.step < 40 and model.step % 2 == 0


def test_no_training_rows(spark):
    features, labels = frames(spark)
    with pytest.raises(ValueError, match="no labelled training items"):
        L.fit(features, labels.limit(0))
    with pytest.raises(ValueError, match="no labelled training items"):
        L.fit(features.limit(0), labels)


def test_real_features_beat_noise_and_not_themselves(spark):
    features, labels = frames(spark)
    labels = labels.where("node <> 'rare'")
    noise = features.select("item", F.array((F.hash("item") % 1000).cast("double"), F.lit(1.0)).alias("vec"))
    split = (labels.where("item % 2 = 0"), None, labels.where("item % 2 = 1"))
    out = {r.node: r for r in L.shortcut_baseline(features, noise, *split, n_boot=60, steps=25, rate=.5).collect()}
    assert out["(macro)"].beats_shortcut and out["a"].beats_shortcut and out["a"].ap_real > .9 > out["a"].ap_shortcut
    same = {r.node: r for r in L.shortcut_baseline(features, features, *split, n_boot=20, steps=3).collect()}
    assert all(abs(r.delta) < 1e-12 and not r.beats_shortcut for r in same.values())
