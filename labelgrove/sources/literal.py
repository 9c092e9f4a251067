"""Small vocabulary tables (rules, class maps, ranges) as local relations with a known size."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows as a local relation, so Spark knows the size and broadcasts it by itself.

    `createDataFrame` on a Python list would hide the size behind a Python scan.
    """
    struct = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    columns = list(zip(*rows)) if rows else [[] for _ in struct]
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema=struct)
