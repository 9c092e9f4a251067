"""Positions and running totals over ranges that are cut by the data.

One range exchange sorts the rows into partitions whose bounds come from a sample of the rows
themselves, so crowded scores or one busy day spread over as many tasks as their rows fill. Each
partition then needs only what all earlier partitions sum to: a table of one row per partition and key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from labelgrove.session import work_folder


def _written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _named(order: list[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def with_parts(placed: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """`placed` with the columns that `parts` has for its key and partition (null keys match)."""
    names = [c for c in parts.columns if c not in (*keys, "__part")]
    right = parts.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k_{k}") for k in keys], *names)
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return placed.join(right, reduce(lambda a, b: a & b, same, F.col("__part") == F.col("__p"))).drop(
        "__p", *[f"__k_{k}" for k in keys])


def ranked(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "rank",
           size: str | None = None) -> DataFrame:
    """`df` with the 0-based position of each row in `order` within its key and, as `size`, the key's
    number of rows. Equal rows take arbitrary but distinct positions; null keys are a key.

    The sorted rows are written once, so positions stay the same however often they are read.
    """
    by = [*[F.col(k) for k in keys], *_named(order)]
    placed = _written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(
        "__id", F.monotonically_increasing_id()), "ranked").withColumn("__part", F.shiftright("__id", 33))
    parts = placed.groupBy(*keys, "__part").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "__part", (F.col("__first") - F.coalesce(F.sum("__n").over(before), F.lit(0))).alias("__base"),
                         *([F.sum("__n").over(whole).alias(size)] if size else []))
    out = with_parts(placed, parts, keys).withColumn(name, F.col("__id") - F.col("__base"))
    return out.drop("__id", "__part", "__base")


def key_changes(rows: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """True where a row's key differs from the row before, and at the first row."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for k in keys:
        column = rows.column(k)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def local_ranges(df: DataFrame, keys: list[str], order: list[str | Column], kernel: Callable[[pa.Table, int], pa.Table],
                 schema: StructType, name: str) -> DataFrame:
    """`kernel(rows, number)` of every sorted range of `df`, written once; ranges are cut by the data and
    hold about RANGE_ROWS rows, those of one task."""
    by = [*[F.col(k) for k in keys], *_named(order)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held) if (held := list(batches)) else None
        if rows is not None and rows.num_rows:
            yield from kernel(rows, TaskContext.get().partitionId()).to_batches()
    ranges = max(1, -(-df.count() // RANGE_ROWS))
    return _written(df.repartitionByRange(ranges, *by).sortWithinPartitions(*by).mapInArrow(run, schema), name)


#: Rows of a range that a task holds at once.
RANGE_ROWS = 1_000_000


def _local_sums(keys: list[str], totals: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, carried = None, dict.fromkeys(totals, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = key_changes(batch, keys)
            first = tuple(batch.column(k)[0].as_py() for k in keys)
            heads = np.flatnonzero(new)
            sums = []
            for c in totals:
                values = batch.column(c).to_numpy(zero_copy_only=False)
                upto = values.cumsum()
                base = np.repeat(upto[heads] - values[heads], np.diff(np.append(heads, len(values))))
                upto = upto - base
                if first == last:
                    upto[:heads[1] if len(heads) > 1 else None] += carried[c]
                carried[c] = upto[-1]
                sums.append(pa.array(upto))
            last = tuple(batch.column(k)[-1].as_py() for k in keys)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *sums, pa.array(np.full(batch.num_rows, part))],
                [*batch.schema.names, *totals.values(), "__part"])
    return run


def running_sums(df: DataFrame, keys: list[str], order: list[str | Column], totals: dict[str, str]) -> DataFrame:
    """Inclusive running sums of the integer columns `totals` (input -> output) in `order` within `keys`.

    Three exchanges: the rows by range, then two of the table of partitions. Rows that tie in `order`
    are summed one after another, so group ties first or give a total order. Nulls count as 0.
    """
    by = [*[F.col(k) for k in keys], *_named(order)]
    whole = df.withColumns({c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in totals})
    schema = StructType([*whole.schema.fields, *[StructField(o, LongType()) for o in totals.values()],
                         StructField("__part", LongType())])
    placed = _written(whole.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(
        _local_sums(keys, totals), schema), "running")
    parts = placed.groupBy(*keys, "__part").agg(*[F.sum(c).alias(f"__t_{o}") for c, o in totals.items()])
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "__part", *[
        F.coalesce(F.sum(f"__t_{o}").over(before), F.lit(0)).alias(f"__b_{o}") for o in totals.values()])
    joined = with_parts(placed, parts, keys)
    return joined.select(*df.columns, *[(F.col(f"__b_{o}") + F.col(o)).alias(o) for o in totals.values()])
