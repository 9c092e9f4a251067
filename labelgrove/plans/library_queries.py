"""Library, operations and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelgrove.operators import library as L
from labelgrove.operators import taxonomy as T
from labelgrove.plans.catalog import query
from labelgrove.plans.report_queries import INTERVALS, frames
from labelgrove.plans.standins import PLACE_NODES, PLACES
from labelgrove.sources import schema as SCH
from labelgrove.sources.literal import small_table
from labelgrove.session import work_folder
from labelgrove.streaming import epochs as E
from labelgrove.streaming import jobs as J
from labelgrove.streaming import limiter as LIM

#: Slices of time in which the frames of a stream arrive.
SLICES = 5


# customers are songs, their orders are jobs
def songs(t):
    return t.read("customer").select(
        F.col("c_custkey").alias("song_id"), F.col("c_name").alias("title"),
        F.col("c_nationkey").cast("long").alias("user_id"),
        F.concat_ws(" , ", F.col("c_mktsegment"), F.when(F.col("c_acctbal") < 0, "Debt"), F.lit(" "))
        .alias("genres"), F.col("c_acctbal").alias("uploaded_at"))


def jobs(t):
    return t.read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("song_id"),
                                   F.col("o_orderstatus").alias("status"))


@query("latest_job_per_song", """SELECT o_custkey AS song_id, max(o_orderkey) AS id,
    arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1""")
def latest_job_per_song(t):
    return L.latest(jobs(t), "song_id")


@query("latest_turn", """SELECT conv_id, turn, role, md5(text) AS digest FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""")
def latest_turn(t):
    rows = t.read("conversations").select("conv_id", "turn", "role", F.md5("text").alias("digest"))
    return L.latest(rows, "conv_id", "turn")


@query("genre_tag_rows", """SELECT DISTINCT c_custkey AS song_id, unnest(CASE WHEN c_acctbal < 0
    THEN [lower(c_mktsegment), 'debt'] ELSE [lower(c_mktsegment)] END) AS tag FROM customer""")
def genre_tag_rows(t):
    return L.genre_tags(songs(t))


@query("song_list", """SELECT c_custkey AS song_id, c_name AS title, CAST(c_nationkey AS BIGINT) AS user_id,
    c_acctbal AS uploaded_at, id AS job_id, status AS job_status,
    CASE WHEN c_acctbal < 0 THEN array_to_string(list_sort([lower(c_mktsegment), 'debt']), ',')
      ELSE lower(c_mktsegment) END AS genres
  FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS id,
    arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1) j ON o_custkey = c_custkey""")
def song_list(t):
    tags = L.genre_tags(songs(t))
    return L.list_songs(songs(t).drop("genres"), jobs(t), tags)


SUBTREE = f"""WITH names AS (SELECT node AS label FROM ({PLACE_NODES}) n WHERE node = 'asia'
    OR starts_with(node, 'asia.') UNION SELECT 'PROMO' UNION SELECT 'promo')
  SELECT DISTINCT o_custkey AS song_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey JOIN ({PLACES}) p ON l_suppkey % 25 = n_nationkey
  WHERE (CASE WHEN l_linenumber = 1 THEN p_type ELSE node END) IN (SELECT label FROM names)
    AND l_quantity >= 45"""


@query("subtree_instrument_search", SUBTREE)
def subtree_instrument_search(t):
    orders = t.read("orders").select("o_orderkey", "o_custkey")
    rows = (t.read("lineitem").where("l_quantity >= 45")
            .select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(t.read("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
            .join(t.places(), F.col("l_suppkey") % 25 == F.col("n_nationkey"))
            .select(F.col("o_custkey").alias("song_id"),
                    F.when(F.col("l_linenumber") == 1, F.col("p_type")).otherwise(F.col("node"))
                    .alias("label")))
    names = small_table(t.spark, [("promo", "asia"), ("PROMO", "asia")], "label string, node string")
    return L.with_instrument(t.read("customer").select(F.col("c_custkey").alias("song_id")), rows,
                             names, T.closure(t.place_nodes()), "Promo")


@query("title_and_genre_filter", """SELECT c_custkey AS song_id FROM customer
  WHERE lower(c_name) LIKE '%r#00000001%' AND lower(c_mktsegment) = 'building'""")
def title_and_genre_filter(t):
    s = songs(t)
    return L.with_genre(L.title_contains(s, "R#00000001"), L.genre_tags(s), "Building").select("song_id")


@query("owner_view", "SELECT c_custkey AS song_id, c_name AS title FROM customer WHERE c_nationkey = 3")
def owner_view(t):
    return L.visible_to(songs(t), 3).select("song_id", "title")


@query("upload_deduplication", """WITH h AS (SELECT doc_id, sha256(text) AS hash FROM documents),
    s AS (SELECT hash, min(doc_id) AS song_id FROM h WHERE doc_id % 3 = 0 GROUP BY 1),
    j AS (SELECT o_orderkey % 1000 AS song_id, max(o_orderkey) AS job_id FROM orders GROUP BY 1),
    i AS (SELECT * FROM h WHERE doc_id % 3 <> 0),
    o AS (SELECT hash, min(doc_id) AS owner FROM i GROUP BY 1)
  SELECT i.doc_id AS upload_id, i.hash AS content_hash, s.song_id, j.job_id,
    s.hash IS NOT NULL OR i.doc_id <> owner AS deduplicated
  FROM i JOIN o USING (hash) LEFT JOIN s ON s.hash = i.hash LEFT JOIN j ON j.song_id = s.song_id""")
def upload_deduplication(t):
    docs = t.read("documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    stored = docs.where("doc_id % 3 = 0").groupBy("content_hash").agg(F.min("doc_id").alias("song_id"))
    runs = t.read("orders").select(F.col("o_orderkey").alias("id"),
                                   (F.col("o_orderkey") % 1000).alias("song_id"))
    incoming = docs.where("doc_id % 3 <> 0").withColumnRenamed("doc_id", "upload_id")
    return L.deduplicate_uploads(incoming, stored, runs)


@query("upload_limits", """SELECT doc_id AS upload_id, CASE WHEN length(text) > 5000 THEN 'too_large'
    WHEN doc_id % 10 = 0 THEN 'unreadable' WHEN n_chars / 10.0 > 300 THEN 'too_long' END AS error
  FROM documents""")
def upload_limits(t):
    u = t.read("documents").select(
        F.col("doc_id").alias("upload_id"), F.length("text").alias("bytes"),
        F.when(F.col("doc_id") % 10 != 0, F.col("n_chars") / 10).alias("duration_s"))
    return L.ingest_errors(u, 5000, 300.0).select("upload_id", "error")


REQUESTS = """SELECT event_id, user_id, CASE event_type WHEN 'signup' THEN 'POST' ELSE 'GET' END AS method,
    CASE event_type WHEN 'signup' THEN '/api/v1/songs' WHEN 'view' THEN '/api/v1/songs/1/stems/x'
      WHEN 'click' THEN '/api/v1/songs/1/audio' ELSE '/api/v1/songs' END AS path FROM events"""


@query("endpoint_classes", f"""SELECT user_id, CASE WHEN method = 'POST' AND path LIKE '%/songs' THEN 'upload'
    WHEN path LIKE '%/stems/%' OR path LIKE '%/audio%' OR path LIKE '%/midi/%' THEN 'download'
    ELSE 'general' END AS cls, count(*) AS n FROM ({REQUESTS}) r GROUP BY 1, 2""")
def endpoint_classes(t):
    kind = F.col("event_type")
    r = t.read("events").select(
        "user_id", F.when(kind == "signup", "POST").otherwise("GET").alias("method"),
        F.when(kind == "view", "/api/v1/songs/1/stems/x").when(kind == "click", "/api/v1/songs/1/audio")
        .otherwise("/api/v1/songs").alias("path"))
    return r.groupBy("user_id", L.endpoint_class(F.col("method"), F.col("path")).alias("cls")).agg(
        F.count(F.lit(1)).alias("n"))


STAGES = ("transcode", "separation", "tagging_mix", "attributes", "tagging_leaf", "tagging_bass",
          "tagging_vocals")
STAGE_SQL = "CASE l_linenumber " + " ".join(
    f"WHEN {i + 1} THEN '{s}'" for i, s in enumerate(STAGES)) + " END"
STATUS_SQL = """CASE WHEN l_linenumber = 1 THEN CASE WHEN l_quantity > 2 THEN 'ok' ELSE 'failed' END
  WHEN l_returnflag = 'R' AND l_quantity > 25 THEN 'failed' WHEN l_returnflag = 'N' THEN 'skipped' ELSE 'ok' END"""


def stage_runs(t):
    names = F.array(*[F.lit(s) for s in STAGES])
    q, flag = F.col("l_quantity"), F.col("l_returnflag")
    return t.read("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("job_id"), F.get(names, F.col("l_linenumber") - 1).alias("stage"),
        F.when(F.col("l_linenumber") == 1, F.when(q > 2, "ok").otherwise("failed"))
        .when((flag == "R") & (q > 25), "failed").when(flag == "N", "skipped").otherwise("ok")
        .alias("status"), F.concat(F.lit("m"), F.col("l_suppkey").cast("string")).alias("model_name"),
        F.lit("1").alias("model_version"))


@query("job_status_rollup", f"""WITH s AS (SELECT l_orderkey AS job_id, {STAGE_SQL} AS stage,
      {STATUS_SQL} AS status FROM lineitem),
    f AS (SELECT job_id, bool_or(coalesce(stage = 'transcode' AND status = 'ok', false)) AS ready,
      bool_or(coalesce(stage IN ('separation', 'tagging_mix', 'attributes') AND status = 'ok', false)) AS a,
      bool_or(coalesce(stage IN ('separation', 'tagging_mix', 'attributes', 'tagging_leaf')
        AND status = 'failed', false)) AS b FROM s GROUP BY 1)
  SELECT job_id, CASE WHEN NOT ready THEN 'failed' WHEN a AND NOT b THEN 'done' WHEN a THEN 'partial'
    ELSE 'failed' END AS status FROM f""")
def job_status_rollup(t):
    return L.job_status(stage_runs(t), ["separation", "tagging_mix", "attributes"], ["tagging_leaf"])


@query("job_provenance", f"""SELECT job_id, string_agg(stage || ':' || model || ':' || status, ',' ORDER BY id)
    AS stages FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS job_id,
      {STAGE_SQL} AS stage, {STATUS_SQL} AS status, 'm' || l_suppkey AS model, l_suppkey
    FROM lineitem) s WHERE stage IS NOT NULL GROUP BY 1 HAVING count(DISTINCT id) = count(*)""")
def job_provenance(t):
    p = L.provenance(stage_runs(t).where("stage is not null"))
    text = F.transform("stages", lambda s: F.concat_ws(":", s["stage"], s["model_name"], s["status"]))
    ids = F.transform("stages", lambda s: s["id"])
    return p.where(F.size(F.array_distinct(ids)) == F.size(ids)).select(
        "job_id", F.array_join(text, ",").alias("stages"))


LEDGER = """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, round(sum(value), 4) AS gpu_s,
    count(*) FILTER (WHERE event_type = 'purchase') AS jobs_count FROM events GROUP BY 1, 2"""


def costs(e):
    return e.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("gpu_s"),
                    F.lit(0).cast("long").alias("storage_bytes"),
                    (F.col("event_type") == "purchase").cast("long").alias("jobs"))


def as_ledger(df):
    return df.select("user_id", F.col("day").cast("string").alias("day"),
                     F.round("gpu_s", 4).alias("gpu_s"), "jobs_count")


@query("cost_ledger", LEDGER)
def cost_ledger(t):
    return as_ledger(L.cost_ledger(costs(t.events())))


@query("cost_ledger_merge", LEDGER)
def cost_ledger_merge(t):
    """A stored ledger plus new costs equals the ledger of all costs."""
    c = t.events()
    halves = [L.cost_ledger(costs(c.where(f"event_id % 2 = {k}"))) for k in (0, 1)]
    return as_ledger(L.merge_ledger(*halves))


CHANGES = """SELECT o_orderdate AS ts, 2 AS step, o_orderkey AS job_id, o_custkey % 50 AS user_id FROM orders
  UNION ALL SELECT o_orderdate + to_days(CAST(o_custkey % 5 AS INT)), 1, o_orderkey, o_custkey % 50 FROM orders
  UNION ALL SELECT o_orderdate + to_days(CAST(o_custkey % 5 + o_orderkey % 7 + 1 AS INT)), 0, o_orderkey,
    o_custkey % 50 FROM orders"""


def changes(t):
    o = t.read("orders").select(
        F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderkey").alias("job_id"),
        (F.col("o_custkey") % 50).alias("user_id"), (F.col("o_custkey") % 5).cast("int").alias("wait"),
        (F.col("o_orderkey") % 7 + 1).cast("int").alias("run"))
    steps = F.explode(F.array(
        F.struct(F.col("at").alias("ts"), F.lit(2).alias("step")),
        F.struct((F.col("at") + F.make_dt_interval("wait")).alias("ts"), F.lit(1).alias("step")),
        F.struct((F.col("at") + F.make_dt_interval(F.col("wait") + F.col("run"))).alias("ts"),
                 F.lit(0).alias("step")))).alias("c")
    return o.select("job_id", "user_id", steps).select("c.ts", "c.step", "job_id", "user_id")


@query("admission_decisions", f"""WITH c AS ({CHANGES}),
    r AS (SELECT *, sum(CASE step WHEN 1 THEN 1 WHEN 0 THEN -1 ELSE 0 END) OVER w AS running,
      sum(CASE step WHEN 2 THEN 1 WHEN 1 THEN -1 ELSE 0 END) OVER w AS queued FROM c
      WINDOW w AS (ORDER BY ts, step, job_id ROWS UNBOUNDED PRECEDING)),
    k AS (SELECT * FROM r WHERE step = 2),
    p AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, job_id) AS turn
      FROM k WHERE running < 25 AND queued < 15 AND running + queued < 38)
  SELECT k.job_id, CAST(k.running AS BIGINT) AS running, CAST(k.queued AS BIGINT) AS queued,
    CASE WHEN k.running >= 25 THEN 'concurrency' WHEN k.queued >= 15 OR k.running + k.queued >= 38
      THEN 'queue_full' WHEN turn > 1 THEN 'quota_daily' END AS code,
    CASE WHEN k.running >= 25 THEN 120 WHEN k.queued >= 15 OR k.running + k.queued >= 38 THEN 300
      WHEN turn > 1 THEN 3600 END AS retry_s
  FROM k LEFT JOIN p ON p.job_id = k.job_id""")
def admission_decisions(t):
    return L.admission(changes(t), 25, 15, 38, 1).select("job_id", "running", "queued", "code", "retry_s")


@query("library_integrity", """SELECT 'unique songs(content_hash)' AS "check", count(*) AS n FROM (
    SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(*) > 1) d
  UNION ALL SELECT 'reference jobs.song_id', count(*) FROM orders WHERE o_orderkey % 1100 NOT IN
    (SELECT doc_id FROM documents)""")
def library_integrity(t):
    docs = t.read("documents").select(F.col("doc_id").alias("id"), F.lit(None).cast("long").alias("user_id"),
                                      F.sha2("text", 256).alias("content_hash"))
    runs = t.read("orders").select(F.col("o_orderkey").alias("id"),
                                   (F.col("o_orderkey") % 1100).alias("song_id"))
    return SCH.library_checks({"songs": docs, "jobs": runs})


@query("report_fields", """SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events""")
def report_fields(t):
    return t.read("events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "int").alias("k"))


@query("instrument_index", """SELECT user_id AS analysis_id, coalesce(CASE WHEN event_type <> 'error'
    THEN 'n.' || event_type END, event_type) AS label, max(value) AS confidence FROM events
  GROUP BY 1, 2""")
def instrument_index(t):
    """Instrument rows rebuilt from JSON reports."""
    rows = t.read("events").groupBy("user_id", "event_type").agg(F.max("value").alias("confidence"))
    entry = F.struct(F.col("event_type").alias("label"), F.when(
        F.col("event_type") != "error", F.concat(F.lit("n."), "event_type")).alias("node"),
        "confidence", F.lit("mix").alias("stem"))
    reports = rows.groupBy(F.col("user_id").alias("song_id")).agg(
        F.to_json(F.struct(F.collect_list(entry).alias("instruments"))).alias("report"))
    return L.instrument_index(reports.withColumn("analysis_id", F.col("song_id"))).select(
        "analysis_id", "label", "confidence")


# ---- rate limits
def requests(e):
    return e.select(F.col("user_id").cast("string").alias("key"), "event_id",
                    F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us")).select(
        "key", "event_id", (F.floor(F.col("us") / 1e6)).cast("double").alias("ts"))


DAY = 86400
ALLOWED = f"""SELECT key, total, res.n AS allowed, total - res.n AS rejected FROM (
  SELECT key, count(*) AS total, list_reduce(list({{'hist': [ts], 'n': 1::BIGINT}} ORDER BY ts, event_id),
    lambda acc, x: CASE WHEN len(list_filter(acc.hist, lambda h: h > x.hist[1] - {DAY})) < 2
      THEN {{'hist': list_concat(list_filter(acc.hist, lambda h: h > x.hist[1] - {DAY}), x.hist),
             'n': acc.n + 1}}
      ELSE {{'hist': list_filter(acc.hist, lambda h: h > x.hist[1] - {DAY}), 'n': acc.n}} END) AS res
  FROM (SELECT CAST(user_id AS VARCHAR) AS key, event_id, floor(epoch_us(ts) / 1e6) AS ts FROM events) e
  GROUP BY key) q"""


def allowed_counts(d):
    return d.groupBy("key").agg(F.count(F.lit(1)).alias("total"), F.count_if("allowed").alias("allowed"),
                                F.count_if(~F.col("allowed")).alias("rejected"))


@query("rate_limit_log", ALLOWED)
def rate_limit_log(t):
    return allowed_counts(LIM.limit_log(requests(t.events()), 2, DAY))


def event_stream(t):
    return J.read_table_stream(t.spark, t.folder, "events", t.read("events").schema)


def with_state_store(t):
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                     "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return t


@query("rate_limit_stream", ALLOWED)
def rate_limit_stream(t):
    """The limiter as a stateful stream, drained into a table."""
    s = event_stream(with_state_store(t))
    out = J.run_to_table(LIM.limit_stream(requests(s), 2, DAY), work_folder(t.spark, "limit"))
    return allowed_counts(out)


HITS = """SELECT CAST(user_id AS VARCHAR) AS key, event_id, floor(epoch_us(ts) / 1e6) AS ts FROM events"""


@query("trailing_hit_count", f"""SELECT a.key, a.event_id, count(*) AS hits FROM ({HITS}) a JOIN ({HITS}) b
    ON a.key = b.key AND b.ts > a.ts - {DAY}
    AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id <= a.event_id)) GROUP BY 1, 2""")
def trailing_hit_count(t):
    return LIM.trailing_hits(requests(t.events()), DAY)


# ---- streams
@query("stream_cost_ledger", LEDGER)
def stream_cost_ledger(t):
    out = J.run_to_table(J.daily_ledger(costs(event_stream(t))), work_folder(t.spark, "ledger"), "update")
    return as_ledger(J.upserted(out, ["user_id", "day"]))


def job_events(e):
    return e.select("event_id", F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"),
                    F.when(F.col("event_type") == "error", "job").otherwise("stage").alias("type"),
                    F.col("event_type").alias("stage"),
                    F.when(F.col("value") > 60, "done").when(F.col("value") > 20, "running")
                    .otherwise("failed").alias("status"))


STATUS = "CASE WHEN value > 60 THEN 'done' WHEN value > 20 THEN 'running' ELSE 'failed' END"


@query("stream_stage_progress", f"""SELECT user_id AS job_id, event_type AS stage,
    arg_max({STATUS}, (ts, event_id)) AS status FROM events GROUP BY 1, 2""")
def stream_stage_progress(t):
    s = J.stage_progress(job_events(event_stream(t)))
    out = J.run_to_table(s, work_folder(t.spark, "progress"), "update")
    return J.upserted(out, ["job_id", "stage"])


@query("job_progress", f"""SELECT job_id, status, status IN ('done', 'failed', 'partial') AS ended FROM (
    SELECT user_id AS job_id, arg_max({STATUS}, (ts, event_id)) AS status FROM events
    WHERE event_type = 'error' GROUP BY 1) j""")
def job_progress(t):
    return J.job_progress(job_events(t.events()))


@query("late_subscription", f"""WITH f AS (SELECT user_id AS job_id, arg_max({STATUS}, (ts, event_id)) AS status
      FROM events WHERE event_type = 'error' GROUP BY 1 HAVING arg_max({STATUS}, (ts, event_id)) <> 'running')
  SELECT type, status, count(*) AS n FROM (
    SELECT CASE event_type WHEN 'error' THEN 'job' ELSE 'stage' END AS type, {STATUS} AS status FROM events
    WHERE user_id NOT IN (SELECT job_id FROM f) UNION ALL SELECT 'job', status FROM f) e GROUP BY 1, 2""")
def late_subscription(t):
    events = job_events(t.events())
    done = J.job_progress(events).where("ended").select("job_id", "status")
    return J.subscribe(events, done).groupBy("type", "status").agg(F.count(F.lit(1)).alias("n"))


@query("stream_dedup", """SELECT sha256(text) AS content_hash FROM documents GROUP BY 1""")
def stream_dedup(t):
    """First upload of each content, deduplicated on the stream."""
    s = J.read_table_stream(t.spark, t.folder, "documents", t.read("documents").schema)
    up = s.select(F.col("doc_id").alias("upload_id"), F.sha2("text", 256).alias("content_hash"),
                  F.timestamp_seconds(F.col("doc_id") + 1704067200).alias("ts"))
    out = J.run_to_table(J.dedup_stream(up, "10000 days"), work_folder(t.spark, "dedup"))
    return out.select("content_hash")


@query("batch_ingest_new_content", """WITH h AS (SELECT doc_id, sha256(text) AS hash FROM documents)
  SELECT hash AS content_hash, min(doc_id) AS upload_id FROM h WHERE doc_id % 4 <> 0 AND hash NOT IN
    (SELECT hash FROM h WHERE doc_id % 4 = 0) GROUP BY 1""")
def batch_ingest_new_content(t):
    docs = t.read("documents").select(F.col("doc_id").alias("upload_id"),
                                      F.sha2("text", 256).alias("content_hash"))
    return J.ingest_batch(docs.where("upload_id % 4 <> 0"), docs.where("upload_id % 4 = 0"))


@query("stream_intervals", f"""SELECT song || '/' || label AS series, start_s, end_s FROM ({INTERVALS}) i
  JOIN (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) c
    ON c.user_id = i.song AND c.event_type = i.label WHERE i.end_s < c.n""")
def stream_intervals(t):
    """Closed intervals from a frame stream that arrives in slices of time; open tails are carried."""
    rows = t.stored(frames(t).select(F.concat_ws("/", "song", "label").alias("series"), "frame", "p", F.unix_seconds("ts").alias("at")), "frame-rows")
    low, high = rows.agg(F.min("at"), F.max("at")).first()
    part = F.coalesce(F.floor((F.col("at") - F.lit(low)) / (F.lit(high) - F.lit(low) + 1.0) * SLICES), F.lit(0))
    folder, arriving = work_folder(t.spark, "frames"), rows.select("series", "frame", "p")
    for k in range(SLICES):
        rows.where(part == k).select(*arriving.columns).write.mode("append").parquet(f"{folder}/in")
        out = E.interval_epochs_in_order(t.spark.readStream.schema(arriving.schema).parquet(f"{folder}/in"), folder, 0.6, 0.42)
    return out
