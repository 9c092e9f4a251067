"""Training rows from several sources: synthetic clips joined by real ones with coarse labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrove.operators.selection import commercial_ok


def usable(labels: DataFrame, cached: DataFrame, licences: DataFrame | None = None) -> DataFrame:
    """Labels of items with a cached vector and, given licences(item, title), a commercial licence."""
    kept = labels.join(cached.select("item"), "item", "left_semi")
    if licences is None:
        return kept
    return kept.join(licences.where(commercial_ok("title")).select("item"), "item", "left_semi")


def cotraining(sources: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(item, vec) and (item, node, y) of all sources together.

    `sources` maps a name to features(item, vec) and labels(item, node, y). Items are named
    `<source>:<item>`, so equal ids of two sources stay two items; an item without labels or without a
    vector takes no part. Labels stay masked: a source says nothing about nodes it does not observe.
    """
    features = labels = None
    for name, (f, o) in sources.items():
        item = F.concat(F.lit(f"{name}:"), F.col("item").cast("string")).alias("item")
        f = f.join(o.select("item").distinct(), "item", "left_semi")
        o = o.join(f.select("item"), "item", "left_semi")
        f, o = f.select(item, F.col("vec").cast("array<double>").alias("vec")), o.select(item, "node", "y")
        features = f if features is None else features.unionByName(f)
        labels = o if labels is None else labels.unionByName(o)
    return features, labels
