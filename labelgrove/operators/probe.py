"""Scores of stored linear heads on stored vectors (`linear_fit` fits them)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def linear_scores(features: DataFrame, heads: DataFrame, vec: str = "vec") -> DataFrame:
    """(item, node, score) from stored heads(node, weights, bias): sigmoid of a dot product.

    The heads are node-sized; they ride along as one scalar array, so vectors are not shuffled.
    """
    packed = heads.agg(F.array_sort(F.collect_list(F.struct("node", "weights", "bias")))).scalar()
    rows = features.select("item", vec, F.explode(packed).alias("h"))
    dot = F.aggregate(F.zip_with(vec, "h.weights", lambda x, w: x.cast("double") * w), F.lit(0.0),
                      lambda acc, v: acc + v)
    return rows.select("item", "h.node", (1 / (1 + F.exp(-(dot + F.col("h.bias"))))).alias("score"))
