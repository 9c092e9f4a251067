"""Positions and running sums over data-cut ranges against plain loops, with crowded orders and null keys."""

import itertools
import random

from pyspark.sql import functions as F

from labelgrove.operators import ranges

random.seed(2)
ROWS = [(random.choice(["a", "a", "a", "b", None]), random.choice([0.5, 0.5, 0.50001, 0.9]), i, random.randrange(-3, 9)) for i in range(900)]


def frame(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges, however few the rows
    return spark.createDataFrame(ROWS, "k string, s double, id long, v int").repartition(7)


def expected(reverse=False):
    key = lambda r: (r[0] is not None, r[0] or "", -r[1] if reverse else r[1], r[2])
    for _, group in itertools.groupby(sorted(ROWS, key=key), key=lambda r: r[0]):
        group = list(group)
        total = 0
        for i, r in enumerate(group):
            total += r[3]
            yield r[2], i, len(group), total


def test_positions(spark):
    got = ranges.ranked(frame(spark), ["k"], ["s", "id"], "rank", "n").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.id, r["rank"], r.n) for r in got) == sorted(x[:3] for x in expected())


def test_positions_without_a_key(spark):
    got = ranges.ranked(frame(spark), [], ["id"]).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(r.id == r["rank"] for r in got) and len(got) == len(ROWS)


def test_running_sums(spark):
    got = ranges.running_sums(frame(spark), ["k"], [F.col("s").desc(), F.col("id")], {"v": "upto"}).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.id, r.upto) for r in got) == sorted((i, t) for i, _, _, t in expected(True))


def test_crowded_order_is_spread(spark):
    """All rows in two scores, one key: no range holds more than twice the mean."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(40_000).select(F.lit("one").alias("k"), (F.col("id") % 2 / 1e6).alias("s"), "id")
    by = [F.col("k"), F.col("s"), F.col("id")]
    sizes = [r["count"] for r in df.repartitionByRange(*by).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 4 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_rows(spark):
    none = frame(spark).limit(0)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranges.ranked(none, ["k"], ["s"]).count() == 0
    assert ranges.running_sums(none, ["k"], ["s"], {"v": "upto"}).count() == 0
