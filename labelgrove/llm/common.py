"""Helpers shared by the corpus operators: reading, storing, null keys, compressed texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelgrove.session import SETTINGS, work_folder

#: Stands for a null doc_id in keys; no document may carry it as its own id.
NULL_ID = -(2 ** 63)

#: Rows of whole texts that a task exchanges with Python at once.
BATCH_ROWS = 3000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Session settings that the operators rely on."""
    for key, value in (SETTINGS | {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}).items():
        spark.conf.set(key, value)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared checkpoint folder and read back: it cuts the lineage and
    survives lost executors."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def doc_key(c: str | Column = "doc_id") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("long"), F.lit(NULL_ID))


def from_key(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(NULL_ID))


def keyed_texts(documents: DataFrame) -> DataFrame:
    """(doc, text) with null ids mapped to a key; every other column is dropped."""
    return documents.select(doc_key().alias("doc"), "text")


def keyed_rows(documents: DataFrame) -> DataFrame:
    """The documents, stored, with a key `__row` of each row's own."""
    return stored(documents.withColumn("__row", F.monotonically_increasing_id()), "rows")


def crc_of_id() -> Column:
    """CRC-32 of doc_id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = zstandard.ZstdCompressor(level=1)
    for b in batches:
        packed = [None if t is None else codec.compress(t.encode()) for t in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), pa.array(packed, pa.binary())], ["doc", "packed"])


def packed_texts(texts: DataFrame) -> DataFrame:
    """(doc, packed): texts compressed before a shuffle, to move fewer bytes."""
    return texts.select("doc", "text").mapInArrow(_packed, "doc long, packed binary")


def unpack(packed: bytes | None) -> bytes:
    return b"" if packed is None else zstandard.ZstdDecompressor().decompress(packed)


_HELD: dict[str, Any] = {}


def held(name: str, make: Callable[[], Any]) -> Any:
    """What a worker keeps between tasks under `name`. Workers serve one stage after another, so
    asking for another name drops what was kept before and gives unused memory back."""
    if name not in _HELD:
        if _HELD:
            _HELD.clear()
            pa.default_memory_pool().release_unused()
        _HELD[name] = make()
    return _HELD[name]
