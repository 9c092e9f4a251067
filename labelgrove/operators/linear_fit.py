"""One fit of masked, class-weighted logistic models for all nodes at once.

The rows of the training items are stored once, each with its vector and its observed labels. A step
is one pass over them: a task multiplies its vectors with the weights of all nodes and returns the sum
of their gradients, one row per node, so what is gathered is as large as the model and does not depend
on the number of items. Now and then the models are scored on validation items; the best stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrove.operators import resample
from labelgrove.operators.calibrate import class_weights
from labelgrove.operators.metrics import average_precision
from labelgrove.session import cut_lineage

LEAST_SCALE = 1e-4
#: Cells of items x nodes that a task holds at once.
CELLS = 4_000_000


@dataclass(frozen=True)
class LinearModel:
    """Weights of all nodes on standardised features; the bias is the last column."""
    nodes: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    step: int = 0

    def inputs(self, vectors: np.ndarray) -> np.ndarray:
        return np.column_stack([(vectors - self.mean) / self.scale, np.ones(len(vectors))])

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        return _sigmoid(self.inputs(vectors) @ self.weights.T)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1 / (1 + e), e / (1 + e))


def labelled(features: DataFrame, labels: DataFrame, nodes: list[str]) -> DataFrame:
    """(item, vec, at, y): every item that has labels, with the numbers of its observed nodes."""
    place = F.array_position(F.array(*[F.lit(n) for n in nodes]), F.col("node")).cast("int") - 1
    seen = labels.select("item", place.alias("k"), "y").where("k >= 0").groupBy("item").agg(
        F.collect_list(F.struct("k", "y")).alias("o"))
    return features.select("item", F.col("vec").cast("array<double>").alias("vec")).join(seen, "item").select(
        "item", "vec", F.col("o.k").alias("at"), F.col("o.y").alias("y"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _observed(batch: pa.RecordBatch, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of observed and positive cells of a batch."""
    at = batch.column("at")
    row = np.repeat(np.arange(len(at)), np.diff(at.offsets.to_numpy()))
    col = at.flatten().to_numpy(zero_copy_only=False)
    seen, positive = np.zeros((2, len(at), nodes), bool)
    seen[row, col] = True
    positive[row, col] = batch.column("y").flatten().to_numpy(zero_copy_only=False)
    return seen, positive


def _slices(batches: Iterator[pa.RecordBatch], nodes: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, CELLS // max(1, nodes))
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            # a copy of its own, so that offsets of lists start at 0
            yield batch.slice(a, rows).take(pa.array(np.arange(min(rows, batch.num_rows - a))))


def _moments(features: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of every feature, merged from the tasks' own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, square = 0, 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                m, own, total = x.mean(0), len(x), n + len(x)
                square = square + ((x - m) ** 2).sum(0) + (m - mean) ** 2 * (n * own / total)
                mean, n = mean + (m - mean) * (own / total), total
        if n:
            yield pa.record_batch([pa.array([n]), pa.array([mean.tolist()]), pa.array([square.tolist()])], ["n", "mean", "square"])
    n, mean, square = 0, 0.0, 0.0
    for r in features.select("vec").mapInArrow(run, "n long, mean array<double>, square array<double>").toLocalIterator():
        m, total = np.array(r["mean"]), n + r["n"]
        square = square + np.array(r["square"]) + (m - mean) ** 2 * (n * r["n"] / total)
        mean, n = mean + (m - mean) * (r["n"] / total), total
    if not n:
        raise ValueError("no labelled training items")
    return mean, np.maximum(np.sqrt(square / max(1, n - 1)), LEAST_SCALE)


def gradient(rows: DataFrame, model: LinearModel, positive_weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed gradient (nodes x features) and summed loss of every node over all rows, in one pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss = np.zeros_like(model.weights), np.zeros(len(model.nodes))
        for batch in _slices(batches, len(model.nodes)):
            x = model.inputs(_matrix(batch.column("vec")))
            seen, y = _observed(batch, len(model.nodes))
            z = x @ model.weights.T
            w = np.where(y, positive_weight, 1.0) * seen
            total += (w * (_sigmoid(z) - y)).T @ x
            loss += (w * (np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z))))).sum(0)
        yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total.tolist()), pa.array(loss)], ["k", "g", "loss"])

    def merge(part: pa.Table) -> pa.Table:
        return pa.table({"k": part.column("k")[:1], "g": [_matrix(part.column("g").combine_chunks()).sum(0).tolist()],
                         "loss": [part.column("loss").to_numpy().sum()]})
    schema = "k long, g array<double>, loss double"
    merged = rows.mapInArrow(run, schema).groupBy("k").applyInArrow(merge, schema).collect()
    by = sorted(merged, key=lambda r: r["k"])
    return np.array([r["g"] for r in by]), np.array([r["loss"] for r in by])


def fit(features: DataFrame, train: DataFrame, val: DataFrame | None = None, steps: int = 60, rate: float = 1.0,
        momentum: float = 0.9, decay: float = 1e-3, every: int = 10, patience: int = 2) -> LinearModel:
    """Models of all nodes of `train(item, node, y)` on `features(item, vec)`.

    A node's loss is the mean over its observed items, positives weighted by the class weights, plus
    `decay` / 2 times its squared weights; the bias is free. With `val(item, node, y)` the mean AP is
    taken every `every` steps; fitting stops once it has not risen `patience` times, and the best
    model stays. Items without a vector or without labels take no part.
    """
    found = train.groupBy("node").agg(F.count(F.lit(1)).alias("n")).join(class_weights(train), "node").orderBy("node").collect()
    if not found:
        raise ValueError("no labelled training items")
    nodes = [r["node"] for r in found]
    count, positive = np.array([r["n"] for r in found], float), np.array([r["weight"] for r in found])
    rows = cut_lineage(labelled(features, train, nodes))
    mean, scale = _moments(rows)
    model = LinearModel(tuple(nodes), mean, scale, np.zeros((len(nodes), len(mean) + 1)))
    held = None if val is None else cut_lineage(labelled(features, val, nodes))
    velocity, best, best_ap, worse = np.zeros_like(model.weights), model, -1.0, 0
    for step in range(1, steps + 1):
        total, _ = gradient(rows, model, positive)
        slope = total / count[:, None]
        slope[:, :-1] += decay * model.weights[:, :-1]
        velocity = momentum * velocity - rate * slope
        model = replace(model, weights=model.weights + velocity, step=step)
        if held is not None and step % every == 0:
            ap = average_precision(score_rows(model, held)).agg(F.avg("ap")).first()[0] or 0.0
            best, best_ap, worse = (model, ap, 0) if ap > best_ap + 1e-4 else (best, best_ap, worse + 1)
            if worse >= patience:
                break
    return model if held is None or best_ap < 0 else best


def score_rows(model: LinearModel, rows: DataFrame) -> DataFrame:
    """(item, node, y, score) of the observed cells of `labelled` rows."""
    names = np.array(model.nodes, object)
    kind = rows.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, len(model.nodes)):
            seen, y = _observed(batch, len(model.nodes))
            row, col = np.nonzero(seen)
            score = model.scores(_matrix(batch.column("vec")))
            yield pa.record_batch([batch.column("item").take(pa.array(row)), pa.array(names[col], pa.string()), pa.array(y[row, col]),
                                   pa.array(score[row, col])], ["item", "node", "y", "score"])
    return rows.mapInArrow(run, f"item {kind}, node string, y boolean, score double")


def score_all(model: LinearModel, features: DataFrame) -> DataFrame:
    """(item, node, score) of every node for every item with a vector."""
    names, kind = pa.array(model.nodes, pa.string()), features.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, len(names)):
            n = batch.num_rows
            yield pa.record_batch([batch.column("item").take(pa.array(np.repeat(np.arange(n), len(names)))),
                                   pa.array(np.tile(names.to_pylist(), n), pa.string()),
                                   pa.array(model.scores(_matrix(batch.column("vec"))).ravel())], ["item", "node", "score"])
    return features.where("vec is not null").select("item", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(
        run, f"item {kind}, node string, score double")


def weight_rows(model: LinearModel, spark) -> DataFrame:
    """(node, i, weight): i counts the features from 1, 0 is the bias."""
    cells = [(n, (i + 1) % (len(model.mean) + 1), float(w)) for n, row in zip(model.nodes, model.weights, strict=True)
             for i, w in enumerate(row)]
    return spark.createDataFrame(cells, "node string, i int, weight double")


def shortcut_baseline(features: DataFrame, nuisance: DataFrame, train: DataFrame, val: DataFrame | None, test: DataFrame,
                      n_boot: int = 1000, seed: int = 0, **options) -> DataFrame:
    """How far the real features beat a model that sees nuisance features only.

    Both models are fitted alike and scored on the same `test(item, node, y, grp)` items. One row for
    the mean AP, `(macro)`, and one per node: AP of both, the difference and its paired interval, and
    whether that lies above 0. Items without either vector are left out on both sides.
    """
    sides = {"real": features, "shortcut": nuisance}
    both = features.select("item").join(nuisance.select("item"), "item", "left_semi")
    obs = None
    for run, table in sides.items():
        model = fit(table, train.join(both, "item", "left_semi"), None if val is None else val.join(both, "item", "left_semi"), **options)
        rows = labelled(table, test.join(both, "item", "left_semi"), list(model.nodes))
        scored = score_rows(model, rows).join(test.select("item", "node", "grp"), ["item", "node"]).select(
            F.lit(run).alias("run"), "item", "node", "y", "score", "grp")
        obs = scored if obs is None else obs.unionByName(scored)
    values = resample.node_values(obs, n_boot, seed)
    mean = values.groupBy("run", "r").agg(F.avg("ap").alias("value")).withColumn("node", F.lit("(macro)"))
    each = values.select("run", "node", "r", F.col("ap").alias("value")).unionByName(mean.select("run", "node", "r", "value"))
    ci = resample.paired_intervals(each, "real", "shortcut", ["node"])
    return ci.select("node", F.col("candidate").alias("ap_real"), F.col("incumbent").alias("ap_shortcut"), "delta", "lo", "hi",
                     "n_valid", F.coalesce(F.col("lo") > 0, F.lit(False)).alias("beats_shortcut"))
