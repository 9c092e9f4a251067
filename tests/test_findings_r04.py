"""Cases of the findings of round 4."""

import hashlib

from pyspark.sql import functions as F

import __spark_entry__ as contract
from labelgrove.operators import calibrate as C
from labelgrove.operators import taxonomy as T
from labelgrove.plans.standins import Tables
from labelgrove.sources import runs as R
from labelgrove.streaming import epochs as E
from oracle import DATA
from test_findings_r03 import equal_to_sql, tables


def test_file_longer_than_an_array(spark, tmp_path):
    files = {"long file.bin": bytes(range(256)) * 400, "copy.bin": bytes(range(256)) * 400}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    key = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(key, "1000")
    try:
        got = {r.path.rsplit("/", 1)[1]: (r.content_hash, r.bytes) for r in R.upload_files(spark, f"{tmp_path}/*.bin").collect()}
    finally:
        spark.conf.unset(key)
    assert got == {name: (hashlib.sha256(content).hexdigest(), len(content)) for name, content in files.items()}


def test_frames_of_many_files_keep_their_order(spark, tmp_path, monkeypatch):
    i = F.col("id")
    hour = (F.lit(1704067200) + i * 7200).cast("timestamp")
    events = spark.range(600).select(
        i.alias("event_id"), hour.alias("ts"), (i % 2).alias("user_id"),
        F.when(i % 3 != 0, "click").otherwise("view").alias("event_type"),
        F.when(i % 31 != 5, (F.xxhash64("id") % 1000).cast("double") / 10).alias("value"), F.lit("{}").alias("props"))
    # exchanges as of a large table: more parts than the files of one epoch
    fine = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "30", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1b", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in fine.items():
        monkeypatch.setitem(contract.SIZED, key, value)
    try:
        equal_to_sql(spark, "stream_intervals", *tables(spark, tmp_path, events=events))
    finally:
        for key in fine:
            spark.conf.unset(key)


def test_open_intervals_are_carried(spark, tmp_path):
    schema = "series string, frame long, p double"
    batches = [[("a", 0, .1), ("a", 1, .7), ("b", 0, .9), ("b", 1, .1), ("d", 0, .8)], [("a", 2, .5), ("c", 0, .7), ("c", 1, None)],
               [("c", 2, float("nan")), ("a", 3, None)], [("a", 4, .4), ("a", 5, .6), ("c", 3, .2), ("c", 4, .8)], [("a", 6, .1), ("b", 2, .5)]]
    want = {("a", .5, 2.0), ("b", .0, .5), ("c", .0, 1.5), ("a", 2.5, 3.0)}
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        got = E.interval_epochs_in_order(stream, str(tmp_path / "work"), .6, .42, .5)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_teacher_is_built_once(spark):
    gate = contract.queries()["distillation_gate"](spark, DATA)
    assert not any("lineitem" in f for f in gate.inputFiles())
    plan = Tables(spark, DATA).tree_obs()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(item" in plan and not [x for x in plan.splitlines() if "hashpartitioning(item" in x and ", node" in x.split("hashpartitioning", 1)[1]]


def test_gate_of_repeated_and_missing_rows(spark):
    nodes = T.nodes_from_ids(spark.createDataFrame([("a.b.c",), ("a.b.d",), ("e.f",)], "node string"))
    labels = [(1, "a", True), (1, "a", True), (1, "a.b", True), (1, "a.b.c", None), (2, "a", False), (2, "a.b", True), (3, "e", None),
              (4, None, True), (None, "a", True), (5, "x", True), (5, "e", True), (None, None, None)]
    teacher = [(i, n, s) for i, s in ((1, .5), (2, .9), (3, .1), (4, .7), (5, .2), (6, .8), (None, .9))
               for n in ("a", "a.b", "a.b.c", "a.b.d", "e", "e.f", "x.y", None)] + [(1, "a.b.d", .95), (1, "a.b.d", .95), (5, "e.f", None), (2, "a.b.c", .1)]
    known = {(i, n) for i, n, _ in labels}
    open_ = {(i, n) for i, a, y in labels if y and i is not None and a for n in ("a.b", "a.b.c", "a.b.d", "e.f")
             if n.startswith(f"{a}.") and (i, n) not in known}
    pairs = T.closure(nodes)
    told = spark.createDataFrame(labels, "item long, node string, y boolean")
    scored = spark.createDataFrame(teacher, "item long, node string, score double")
    order = lambda rows: sorted(rows, key=str)
    rows = lambda df: order(tuple(r) for r in df.select(*[c for c in ("item", "node", "score") if c in df.columns]).collect())
    assert rows(C.distill_gate(told, pairs)) == order(open_ | {(None, n) for n in ("a.b", "a.b.c", "a.b.d")})
    assert rows(C.distill_gate(told, pairs, scored)) == order(t for t in teacher if t[:2] in open_)
    cuts = {n: sorted(s for _, m, s in teacher if m == n and s is not None) for n in {n for _, n in open_}}
    half = {n: (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 for n, v in cuts.items()}
    got = rows(C.distill_gate(told, pairs, scored.where("score is not null"), .5))
    assert got == order(t for t in teacher if t[:2] in open_ and t[2] is not None and t[2] >= half[t[1]])
