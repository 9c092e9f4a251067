"""Exact nearest vectors by inner product, in tiles.

Queries are cut into blocks and candidates into shards of bounded size; every (block, shard) tile
is one matrix product, from which each query's best are selected. The lists of a query are then
merged in a tree: first within groups of shards, then across groups.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelgrove.llm.common import prepare, stored

SCALE = 256
QUERIES, CANDIDATES = 1024, 16_384
#: Shards whose lists are merged before the last merge.
MERGED = 64


def integer_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, vector): floor(scale * component), of vectors without null, NaN or infinite
    components and with an id; repeated rows count once."""
    x = F.col("embedding")
    fine = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (
        F.abs(v.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return embeddings.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector")).distinct()


def _matrix(t: pa.Table) -> np.ndarray:
    flat = t.column("vector").combine_chunks()
    values = flat.flatten().to_numpy()
    return values.reshape(len(flat), -1) if len(values) else np.zeros((len(flat), 0), np.int64)


def best_of_tile(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int):
    """(query position, candidate position, score) of each query's k best; ties to the smaller id."""
    by = np.argsort(ids, kind="stable")
    ids, vectors = ids[by], vectors[by]
    largest = int(np.abs(queries).max(initial=0)) * int(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    kind = np.float64 if largest < 2 ** 53 else np.int64
    scores = (queries.astype(kind) @ vectors.T.astype(kind)).astype(np.int64)
    same = own[:, None] == ids[None, :]
    lowest = np.iinfo(np.int64).min
    scores[same] = lowest
    out_q, out_c = [], []
    n = min(k, len(ids))
    cut = np.partition(scores, len(ids) - n, axis=1)[:, len(ids) - n]
    for q in range(len(queries)):
        above = np.flatnonzero(scores[q] > cut[q])
        level = np.flatnonzero((scores[q] == cut[q]) & ~same[q])[:n - len(above)]
        out_c.append(np.concatenate([above, level]))
        out_q.append(np.full(len(out_c[-1]), q))
    q, c = np.concatenate(out_q), np.concatenate(out_c)
    return q, by[c], scores[q, c]


def _tile(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        empty = pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score", "shard")})
        if not queries.num_rows or not candidates.num_rows:
            return empty
        own, ids = queries.column("query_id").to_numpy(), candidates.column("vec_id").to_numpy()
        q, c, score = best_of_tile(_matrix(queries), ids, _matrix(candidates), own, k)
        shard = candidates.column("shard")[0].as_py()
        return pa.table({"query_id": own[q], "vec_id": ids[c], "score": score, "shard": np.full(len(q), shard)})
    return run


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by `every`, the k
    highest integer inner products with the other vectors; ties go to the smaller id.

    Vectors that are null or hold null or non-finite components, and rows without an id, take no
    part. Only vectors of equal length meet. Rows repeated whole count once; an id with several
    vectors is a candidate with each, and asks with the least of them (in array order). A vector
    never meets its own id. Other columns are ignored.
    """
    prepare(embeddings.sparkSession)
    vectors = stored(integer_vectors(embeddings).withColumn("dim", F.size("vector")), "vectors")
    asked = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector")).select(
        F.col("vec_id").alias("query_id"), "vector", F.size("vector").alias("dim"))
    counts = vectors.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).first()
    blocks, shards = max(1, math.ceil(counts.q / QUERIES)), max(1, math.ceil(counts.n / CANDIDATES))
    place = lambda of, n: F.pmod(F.xxhash64(*of), F.lit(n)).cast("long")
    left = asked.withColumn("block", place(["query_id"], blocks)).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    right = vectors.withColumn("shard", place(["vec_id", "vector"], shards)).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    tiles = left.groupBy("dim", "block", "shard").cogroup(right.groupBy("dim", "block", "shard")).applyInArrow(
        _tile(k), "query_id long, vec_id long, score long, shard long")
    order = [F.col("score").desc(), F.col("vec_id")]
    some = tiles.withColumn("part", F.floor(F.col("shard") / MERGED))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))).where(
        F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
