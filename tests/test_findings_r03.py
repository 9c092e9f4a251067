"""Cases of the findings of round 3."""


import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as contract
from labelgrove.llm import decontaminate, near_dedup
from labelgrove.operators import clips as C
from labelgrove.operators import library as L
from labelgrove.streaming import epochs as E
from labelgrove.streaming import jobs as J
from labelgrove.streaming import limiter as LIM
from labelgrove.streaming import merging as MG
from oracle import DATA, differences


def tables(spark, folder, **frames):
    """A folder of tables and the same ones in DuckDB."""
    con = duckdb.connect()
    for name, df in frames.items():
        df.write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    return str(folder), con


def equal_to_sql(spark, name, folder, con):
    assert differences(contract.queries()[name](spark, folder), con, contract.oracle_sql()[name]) is None


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_streamed_table_may_be_a_folder(spark, tmp_path):
    docs = documents(spark, [(i, f"t{i % 7}", "en", "web", 2) for i in range(40)]).repartition(3)
    equal_to_sql(spark, "stream_dedup", *tables(spark, tmp_path / "many", documents=docs))
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    one = J.read_table_stream(spark, str(tmp_path), "documents", docs.schema)
    assert J.run_to_table(one, str(tmp_path / "work")).count() == 40


def test_kept_rules_count_zero(spark, tmp_path):
    docs = documents(spark, [(i, f"t{i}", "en", "web", 2) for i in range(1100)])
    orders = spark.range(50).select(F.col("id").alias("o_orderkey"))
    equal_to_sql(spark, "library_integrity", *tables(spark, tmp_path, documents=docs, orders=orders))


def test_clip_keys_of_seven_digits(spark, tmp_path):
    orders = spark.createDataFrame([(k, k % 3) for k in (12, 1234567, 1234568, 1234560)], "o_orderkey long, o_custkey long")
    lines = spark.createDataFrame([(k, p, 5.0 * p, 1, 0.0, "N") for k in (12, 1234567, 1234568, 1234560) for p in (1, 8)],
                                  "l_orderkey long, l_partkey long, l_quantity double, l_linenumber int, l_tax double, l_returnflag string")
    parts = spark.createDataFrame([(1, "PROMO", "Brand#1"), (8, "LARGE", "Brand#2")], "p_partkey long, p_type string, p_brand string")
    equal_to_sql(spark, "read_partial_clips", *tables(spark, tmp_path, orders=orders, lineitem=lines, part=parts))


def test_least_upload_arrives_late(spark, tmp_path):
    schema = "upload_id long, content_hash string"
    for rows in ([(5, "a"), (7, None)], [(3, "a"), (6, "b")], [(4, "a"), (2, None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "up"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "up"))
    got = {r.content_hash: r.upload_id for r in MG.membership_sink(stream, str(tmp_path / "members")).collect()}
    assert got == {"a": 3, None: 2, "b": 6}


def sliced(spark, folder, batches, schema):
    """A stream of one file per batch, `ts` from seconds `s`."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return stream.withColumn("ts", F.timestamp_seconds("s"))


def test_admission_epochs_carry_counters_and_quota(spark, tmp_path):
    changes = [(float(100 + 7 * i), 2, i, i % 3) for i in range(20)] + [(float(105 + 7 * i), 1, i, i % 3) for i in range(0, 20, 2)] + [
        (float(180 + 9 * i), 0, i, i % 3) for i in range(0, 20, 4)] + [(float(86400 + 10 * i), 2, 100 + i, i % 2) for i in range(6)]
    changes.sort()
    batches = [changes[8:20], [*changes[:8], *changes[22:30]], [*changes[20:22], *changes[30:]], [(1e7, -1, -1, -1)]]
    schema = "s double, step int, job_id long, user_id long"
    table = spark.createDataFrame(changes, schema).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    for k, (limits, own) in enumerate((((4, 6, 9, 2), False), ((1, 3, 4, 2), True))):
        s = sliced(spark, str(tmp_path / f"in{k}"), batches, schema)
        got = E.admission_epochs(s, str(tmp_path / f"w{k}"), *limits, per_user=own, delay_s=100).collect()
        want = L.admission(table, *limits, per_user=own).select("ts", "job_id", "user_id", "running", "queued", "code", "retry_s").collect()
        assert sorted(tuple(r)[:7] for r in got) == sorted(tuple(r) for r in want) and len({r.epoch for r in got}) > 1


def test_limit_epochs_equal_the_log(spark, tmp_path):
    hits = [("a", 1, 100.0), ("a", 2, 130.0), ("a", 3, 101.0), ("a", 4, 159.0), ("b", 5, 90.0), ("a", 6, 161.5), ("b", 7, 150.5), ("a", 8, 189.0)]
    batches = [[hits[1], hits[3]], [hits[0], hits[2], hits[4], hits[6]], [hits[5], hits[7]], [("", -1, 1e7)]]
    s = sliced(spark, str(tmp_path / "in"), batches, "key string, event_id long, s double")
    got = E.limit_epochs(s.select("key", "event_id", F.col("s").alias("ts")), str(tmp_path / "w"), 2, 60, 70).collect()
    want = LIM.limit_log(spark.createDataFrame(hits, "key string, event_id long, ts double"), 2, 60).collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted(tuple(r) for r in want) and len({r.epoch for r in got}) > 1


def test_interval_epochs_carry_open_ones(spark, tmp_path):
    frames = [("x", float(100 + i), i, p) for i, p in enumerate([.1, .9, .5, .1, .8, .7])] + [("y", float(100 + i), i, .9) for i in range(3)]
    batches = [frames[1:4], [frames[0], *frames[5:]], [frames[4]], [("z", 500.0, 0, .7)], [("", 1e7, -1, 0.0)]]
    s = sliced(spark, str(tmp_path / "in"), batches, "series string, s double, frame long, p double")
    got = E.interval_epochs(s, str(tmp_path / "w"), .6, .4, hop_s=.5, idle_s=60, delay_s=3).collect()
    assert sorted(tuple(r) for r in got) == [("x", .5, 1.5), ("x", 2.0, 3.0), ("y", 0.0, 1.5), ("z", 0.0, .5)]


def test_progress_epochs_carry_ended_jobs(spark, tmp_path):
    events = [("1", 10.0, 1, "stage", "mix", "running"), ("1", 20.0, 2, "job", "", "done"), ("1", 15.0, 3, "stage", "mix", "done"),
              ("2", 12.0, 4, "job", "", "running"), ("1", 90.0, 5, "stage", "mix", "late")]
    batches = [events[1:2], [events[0], *events[2:4]], events[4:], [("", 1e7, -1, "job", "", "")]]
    s = sliced(spark, str(tmp_path / "in"), batches, "job_id string, s double, event_id long, type string, stage string, status string")
    got = E.progress_epochs(s, str(tmp_path / "w"), keep_s=100, delay_s=60).drop("epoch").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([
        ("1", None, "done", True), ("1", "mix", "done", True), ("2", None, "running", False), ("1", "mix", "late", True)], key=repr)


def test_exchanges_follow_the_input(spark):
    contract.queries()["ece_bins"](spark, DATA)
    rows = spark.range(4_000_000).select(F.xxhash64("id").alias("h")).groupBy("h").count()
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 8  # the session's own number


def test_source_choice_meets_few_sources(spark):
    sources = spark.createDataFrame([("a", f"s{i:04d}", float(1 + i % 5)) for i in range(2000)] + [("b", "t", 2.0), ("b", "u", 0.0)],
                                    "leaf string, source string, weight double")
    requests = spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("leaf"))
    out = C.choose_source(requests, sources, F.col("id") / 3000)
    got = {r.id: r.source for r in out.collect()}
    upto = np.cumsum([1.0 + i % 5 for i in range(2000)])
    want = {i: f"s{np.searchsorted(upto, i / 3000 * upto[-1], side='right'):04d}" if i % 10 else "t" for i in range(3000)}
    assert got == want and len(got) == 3000
    assert "filter(" not in out._jdf.queryExecution().optimizedPlan().toString()  # no list of all sources beside a request


def test_pairs_around_a_centre_are_told_apart_by_changes(spark, monkeypatch):
    """Copies of one text that is not there: nearly all share shingles, few share changes, fewer are linked."""
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(200)]

    def copy(changed):
        words = list(base)
        for i in rng.choice(200, changed, replace=False):
            words[i] = f"x{rng.integers(1 << 40)}"
        return " ".join(words)
    texts = [copy(4) for _ in range(120)]
    sets = [set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 75 * len(a | sets[j]) and (x := top(i)) != (y := top(j)):
                root[max(x, y)] = min(x, y)
    tried, confirmed = [], near_dedup.confirmed
    monkeypatch.setattr(near_dedup, "confirmed", lambda pairs, kept: tried.append(pairs.count()) or confirmed(pairs, kept))
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: top(i) for i in range(len(texts))}
    assert len({top(i) for i in range(len(texts))}) > 5 and tried[-1] < 4000, tried


def test_clean_texts_are_not_shuffled(spark):
    """All columns stay, each block of patterns takes its rows, and no exchange carries a text."""
    words = lambda x: " ".join(f"{x}{i}" for i in range(14))
    rows = [(i, None if i % 7 == 0 else f"{words('x')} {words(f'w{i}_')}", f"s{i}", i / 2) for i in range(30)] + [(30, words("b"), None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, q double").repartition(3)
    bench = spark.createDataFrame([(i, words(f"w{i}_")) for i in range(0, 30, 4)] + [(99, "b3 b4")], "item_id long, text string")
    want = [r for r in rows[:30] if r[0] % 4 or r[1] is None]
    for at_once in (decontaminate.PATTERNS, 9):
        clean = decontaminate.without_contaminated(docs, bench, at_once)
        assert clean.columns == docs.columns and sorted(map(tuple, clean.collect())) == want
    plan = decontaminate.without_contaminated(spark.read.parquet(f"{DATA}/documents.parquet"), bench)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan
