"""Linear CKA of two embeddings of the same items."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _partial_products(batches):
    """Per partition: count, column sums and cross-products of [x | y], one row per entry."""
    total = None
    for pdf in batches:
        if len(pdf) == 0:
            continue
        z = np.hstack([np.stack(pdf["x"].to_numpy()).astype(float),
                       np.stack(pdf["y"].to_numpy()).astype(float)])
        z1 = np.hstack([np.ones((len(z), 1)), z])
        part = z1.T @ z1
        total = part if total is None else total + part
    if total is not None:
        i, j = np.meshgrid(*map(np.arange, total.shape), indexing="ij")
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})


def linear_cka(vectors: DataFrame, x_size: int) -> DataFrame:
    """One row `cka` from `vectors(x, y)`: centred ||X'Y||^2 / (||X'X|| ||Y'Y||).

    Every partition sends (d+1)^2 partial sums; the rest works on d^2 rows.
    """
    sums = (vectors.select("x", "y").mapInPandas(_partial_products, "i int, j int, v double")
            .groupBy("i", "j").agg(F.sum("v").alias("v")))
    n = sums.where("i = 0 and j = 0").select("v").scalar()
    means = sums.where("i = 0 and j > 0")
    left = means.select(F.col("j").alias("i"), F.col("v").alias("si"))
    right = means.select("j", F.col("v").alias("sj"))
    centred = (sums.where("i > 0 and j > 0").join(left, "i").join(right, "j")
               .withColumn("c", F.col("v") - F.col("si") * F.col("sj") / n))
    sq = F.col("c") * F.col("c")
    xi, xj = F.col("i") <= x_size, F.col("j") <= x_size
    return centred.agg(
        F.sum(F.when(xi & ~xj, sq)).alias("xy"), F.sum(F.when(xi & xj, sq)).alias("xx"),
        F.sum(F.when(~xi & ~xj, sq)).alias("yy")).select(
        (F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("cka"))
