"""Running totals and carried values that stay parallel when one key is very large.

A plain window over `key` sends a whole key to one task. Here every key is cut into chunks by an
expression that is monotone in the order; chunks are summarised, the small per-key list of chunk
summaries is scanned, and each row then only needs a window inside its own chunk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOGIT_CLIP = 1e-9
CHUNKS_PER_LOGIT = 64


def score_chunk(score: Column | str) -> Column:
    """Monotone chunk number of a probability-like score, at most 2,654 values.

    Chunks have equal width in log-odds, so they stay balanced both for scores spread over
    [0, 1] and for scores that crowd against 0 or 1. Scores outside [0, 1] fall into the end
    chunks, which is still exact.
    """
    s = F.col(score) if isinstance(score, str) else score
    p = F.least(F.greatest(s.cast("double"), F.lit(LOGIT_CLIP)), F.lit(1 - LOGIT_CLIP))
    return F.floor((F.ln(p) - F.log1p(-p)) * CHUNKS_PER_LOGIT).cast("int")


def time_chunk(ts: Column | str, seconds: int = 86400) -> Column:
    """Monotone chunk number of an event time."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(t.cast("timestamp").cast("double") / seconds).cast("long")


def _null_safe_join(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") for c in cols],
                           *[c for c in right.columns if c not in cols])
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in cols])
    return left.join(renamed, cond, "left").drop(*[f"__r_{c}" for c in cols])


def running_totals(df: DataFrame, keys: list[str], chunk: str, order: list[Column],
                   totals: dict[str, str], descending: bool = False) -> DataFrame:
    """Inclusive running sums of `totals` (input column -> output column) in `order` within `keys`.

    `chunk` must be monotone in `order` (falling if `descending`). Ties in `order` are broken
    arbitrarily, so group ties first or give a total order.
    """
    cols = [*keys, chunk]
    direction = F.col(chunk).desc() if descending else F.col(chunk).asc()
    before = Window.partitionBy(*keys).orderBy(direction).rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = df.groupBy(*cols).agg(*[F.sum(c).alias(f"__t_{o}") for c, o in totals.items()])
    offsets = offsets.select(*cols, *[
        F.coalesce(F.sum(f"__t_{o}").over(before), F.lit(0)).alias(f"__b_{o}")
        for o in totals.values()])
    inside = Window.partitionBy(*cols).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = _null_safe_join(df, offsets, cols)
    return joined.select(*df.columns, *[
        (F.col(f"__b_{o}") + F.sum(c).over(inside)).alias(o) for c, o in totals.items()])


def row_numbers(df: DataFrame, keys: list[str], chunk: str, order: list[Column],
                name: str = "rn", descending: bool = False) -> DataFrame:
    """1-based position in `order` within `keys` (give a total order)."""
    one = df.withColumn("__one", F.lit(1).cast("long"))
    return running_totals(one, keys, chunk, order, {"__one": name}, descending).drop("__one")


def carry_last(df: DataFrame, keys: list[str], chunk: str, order: list[Column],
               values: dict[str, str], inclusive: bool = True) -> DataFrame:
    """Last non-null of each value column at or before the row (strictly before unless
    `inclusive`), in `order` within `keys`."""
    cols = [*keys, chunk]
    inside = Window.partitionBy(*cols).orderBy(*order)
    up_to = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = df.select("*", *[F.last(c, ignorenulls=True).over(up_to).alias(f"__l_{o}")
                             for c, o in values.items()],
                      F.row_number().over(inside).alias("__n"))
    ends = local.groupBy(*cols).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__n"))).alias(f"__e_{o}")
        for c, o in values.items()])
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*cols, *[
        F.last(f"__e_{o}", ignorenulls=True).over(before).alias(f"__c_{o}")
        for o in values.values()])
    joined = _null_safe_join(local, carried, cols)
    return joined.select(*df.columns, *[
        F.coalesce(F.col(f"__l_{o}"), F.col(f"__c_{o}")).alias(o) for o in values.values()])


def previous_value(df: DataFrame, keys: list[str], chunk: str, order: list[Column],
                   values: dict[str, str]) -> DataFrame:
    """`lag(value, 1)` in `order` within `keys` (values must be non-null)."""
    cols = [*keys, chunk]
    inside = Window.partitionBy(*cols).orderBy(*order)
    local = df.select("*", *[F.lag(c).over(inside).alias(f"__l_{o}") for c, o in values.items()],
                      F.row_number().over(inside).alias("__n"))
    ends = local.groupBy(*cols).agg(*[
        F.max_by(c, "__n").alias(f"__e_{o}") for c, o in values.items()])
    before = Window.partitionBy(*keys).orderBy(chunk)
    carried = ends.select(*cols, *[
        F.lag(f"__e_{o}").over(before).alias(f"__c_{o}") for o in values.values()])
    joined = _null_safe_join(local, carried, cols)
    return joined.select(*df.columns, *[
        F.when(F.col("__n") == 1, F.col(f"__c_{o}")).otherwise(F.col(f"__l_{o}")).alias(o)
        for o in values.values()])


def next_value(df: DataFrame, keys: list[str], chunk: str, order_cols: list[str],
               values: dict[str, str]) -> DataFrame:
    """`lead(value, 1)` in ascending `order_cols` within `keys` (values must be non-null)."""
    cols = [*keys, chunk]
    asc = Window.partitionBy(*cols).orderBy(*[F.col(c).asc() for c in order_cols])
    local = df.select("*", *[F.lead(c).over(asc).alias(f"__l_{o}") for c, o in values.items()],
                      F.row_number().over(asc).alias("__n"),
                      F.count(F.lit(1)).over(Window.partitionBy(*cols)).alias("__m"))
    heads = local.groupBy(*cols).agg(*[
        F.min_by(c, "__n").alias(f"__h_{o}") for c, o in values.items()])
    after = Window.partitionBy(*keys).orderBy(chunk)
    carried = heads.select(*cols, *[
        F.lead(f"__h_{o}").over(after).alias(f"__c_{o}") for o in values.values()])
    joined = _null_safe_join(local, carried, cols)
    return joined.select(*df.columns, *[
        F.when(F.col("__n") == F.col("__m"), F.col(f"__c_{o}")).otherwise(F.col(f"__l_{o}")).alias(o)
        for o in values.values()])


def exact_percentile(df: DataFrame, keys: list[str], value: str, q: float,
                     name: str = "percentile", chunk: Column | None = None) -> DataFrame:
    """Linear-interpolated percentile per key, without holding a key's values in one task.

    `chunk` must be monotone in the value; the default suits probability-like values.
    """
    ties = (df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("chunk", score_chunk(value) if chunk is None else chunk))
    run = running_totals(ties, keys, "chunk", [F.col(value).asc()], {"n": "cum"})
    sizes = ties.groupBy(*keys).agg(F.sum("n").alias("size"))
    pos = (F.col("size") - 1) * q
    at = lambda k: (F.col("cum") - F.col("n") <= k) & (k < F.col("cum"))
    picked = run.join(sizes, keys).withColumns({"lo": F.floor(pos), "hi": F.ceil(pos)})
    picked = picked.where(at(F.col("lo")) | at(F.col("hi")))
    ends = picked.groupBy(*keys, "size").agg(
        F.max(F.when(at(F.col("lo")), F.col(value))).alias("lo_v"),
        F.max(F.when(at(F.col("hi")), F.col(value))).alias("hi_v"))
    share = pos - F.floor(pos)
    return ends.select(*keys, (F.col("lo_v") + share * (F.col("hi_v") - F.col("lo_v"))).alias(name))
