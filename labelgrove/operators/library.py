"""Song library queries, ingest deduplication, job roll-ups, the ledger and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelgrove.operators.ranges import ranked, running_sums
from labelgrove.operators.scan import time_chunk

UNLIMITED = -1


def latest(df: DataFrame, key: str, order: str = "id") -> DataFrame:
    """Newest row per key by id: an aggregate, so a busy key is combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("row")).select(key, "row.*")


def genre_tags(songs: DataFrame, column: str = "genres") -> DataFrame:
    """(song_id, tag) from comma-separated genres: trimmed, lower-cased, blanks dropped."""
    tag = F.explode(F.split(column, ",")).alias("tag")
    return (songs.select("song_id", tag)
            .select("song_id", F.lower(F.trim("tag")).alias("tag"))
            .where(F.length("tag") > 0).distinct())


def title_contains(songs: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring filter."""
    return songs.where(F.contains(F.lower("title"), F.lit(text.lower())))


def with_genre(songs: DataFrame, tags: DataFrame, genre: str) -> DataFrame:
    return songs.join(tags.where(F.col("tag") == genre.lower()).select("song_id"), "song_id",
                      "left_semi")


def visible_to(songs: DataFrame, caller: int) -> DataFrame:
    """Only the caller's own songs."""
    return songs.where(F.col("user_id") == caller)


def with_instrument(songs: DataFrame, instruments: DataFrame, label_nodes: DataFrame,
                    pairs: DataFrame, key: str) -> DataFrame:
    """Songs with an instrument row that equals the key, its node, anything in the node's subtree,
    or a label whose node lies there.

    `pairs` is the taxonomy closure: the subtree becomes a small set of names and the search an
    equi semi-join, in place of a prefix comparison against every row.
    """
    key = key.lower()
    hit = label_nodes.where(F.col("label") == key).agg(F.max("node")).scalar()
    node = F.coalesce(hit, F.lit(key))
    subtree = pairs.where(F.col("ancestor") == node).select("node")
    labels = label_nodes.join(subtree, "node", "left_semi").select("label")
    own = subtree.sparkSession.range(1).select(
        F.explode(F.array(F.lit(key), node)).alias("label"))
    names = (labels.union(subtree.select("node")).union(own)).toDF("label").distinct()
    found = instruments.join(names, "label", "left_semi").select("song_id")
    return songs.join(found, "song_id", "left_semi")


def list_songs(songs: DataFrame, jobs: DataFrame, tags: DataFrame) -> DataFrame:
    """Song list with its tags and latest job, newest upload first."""
    job = latest(jobs, "song_id").select("song_id", F.col("id").alias("job_id"),
                                         F.col("status").alias("job_status"))
    genre = tags.groupBy("song_id").agg(
        F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("genres"))
    return (songs.join(job, "song_id", "left").join(genre, "song_id", "left")
            .orderBy(F.col("uploaded_at").desc(), F.col("song_id").desc()))


def deduplicate_uploads(incoming: DataFrame, songs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Outcome of every upload: the existing song and its latest job, or the first upload of new
    content.

    `incoming(upload_id, content_hash)`, `songs(song_id, content_hash)`, `jobs(id, song_id)`. Copies
    inside the batch follow the smallest upload id; that owner is one aggregate per hash.
    """
    known = songs.join(latest(jobs, "song_id").select("song_id", F.col("id").alias("job_id")),
                       "song_id", "left").select("content_hash", "song_id", "job_id",
                                                 F.lit(True).alias("known"))
    owner = incoming.groupBy("content_hash").agg(F.min("upload_id").alias("owner"))
    rows = incoming.join(owner, "content_hash").join(known, "content_hash", "left")
    return rows.select(
        "upload_id", "content_hash", "song_id", "job_id",
        (F.col("known").isNotNull() | (F.col("upload_id") != F.col("owner"))).alias("deduplicated"))


def ingest_errors(uploads: DataFrame, max_bytes: int, max_duration_s: float) -> DataFrame:
    """Adds `error`: too_large, too_long, unreadable, or null."""
    return uploads.withColumn(
        "error", F.when(F.col("bytes") > max_bytes, "too_large")
        .when(F.col("duration_s").isNull(), "unreadable")
        .when(F.col("duration_s") > max_duration_s, "too_long"))


def endpoint_class(method: Column, path: Column) -> Column:
    """upload, download or general, as the rate limits distinguish them."""
    download = (F.contains(path, F.lit("/stems/")) | F.contains(path, F.lit("/audio"))
                | F.contains(path, F.lit("/midi/")))
    return (F.when((method == "POST") & F.endswith(path, F.lit("/songs")), "upload")
            .when(download, "download").otherwise("general"))


def job_status(stage_runs: DataFrame, counted: list[str], failing_only: list[str],
               required: str = "transcode") -> DataFrame:
    """(job_id, status) rolled up from stage rows (job_id, stage, status).

    `counted` stages can make a job ok or failed, `failing_only` stages can only fail it; a job
    whose required stage did not succeed has failed.
    """
    stage, status = F.col("stage"), F.col("status")
    flags = stage_runs.groupBy("job_id").agg(
        F.bool_or((stage == required) & (status == "ok")).alias("ready"),
        F.bool_or(stage.isin(*counted) & (status == "ok")).alias("any_ok"),
        F.bool_or(stage.isin(*counted, *failing_only) & (status == "failed")).alias("any_failed"))
    return flags.select("job_id", F.when(~F.col("ready"), "failed")
                        .when(F.col("any_ok") & ~F.col("any_failed"), "done")
                        .when(F.col("any_ok"), "partial").otherwise("failed").alias("status"))


def provenance(stage_runs: DataFrame) -> DataFrame:
    """Ordered list of the stages of a job (a job has a handful)."""
    entry = F.struct("id", "stage", "model_name", "model_version", "status")
    return stage_runs.groupBy("job_id").agg(F.array_sort(F.collect_list(entry)).alias("stages"))


def cost_ledger(costs: DataFrame) -> DataFrame:
    """Sums per (user, UTC day) of costs(user_id, ts, gpu_s, storage_bytes, jobs)."""
    return costs.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.sum("gpu_s").alias("gpu_s"), F.sum("storage_bytes").alias("storage_bytes"),
        F.sum("jobs").alias("jobs_count"))


def merge_ledger(ledger: DataFrame, delta: DataFrame) -> DataFrame:
    """Add new costs to a stored ledger."""
    return ledger.unionByName(delta).groupBy("user_id", "day").agg(
        F.sum("gpu_s").alias("gpu_s"), F.sum("storage_bytes").alias("storage_bytes"),
        F.sum("jobs_count").alias("jobs_count"))


def admission(changes: DataFrame, concurrency: int = UNLIMITED, queued: int = UNLIMITED,
              depth: int = UNLIMITED, daily: int = UNLIMITED, per_user: bool = False,
              before: DataFrame | None = None) -> DataFrame:
    """Decision for every submitted job: admitted, or a code and the seconds to wait.

    `changes(ts, step, job_id, user_id)` with step 0 = finish, 1 = start, 2 = submit orders equal
    times. A new job already counts as queued. Counts are global unless `per_user`. Running and
    queued counts are running sums over ranges of the changes, so neither a user nor a busy day becomes
    one task. The quota counts admitted jobs only, so it admits the first `daily` submits per user and day that
    passed the other limits. `before(user_id, running, queued, day, admitted)` is what earlier changes left:
    counters of the scopes, with a null day, and jobs admitted per user and day.
    """
    step = F.col("step")
    rows = changes.withColumns({
        "day": time_chunk("ts"),
        "d_running": F.when(step == 1, 1).when(step == 0, -1).otherwise(0).cast("long"),
        "d_queued": F.when(step == 2, 1).when(step == 1, -1).otherwise(0).cast("long")})
    order = [F.col("ts"), step, F.col("job_id")]
    keys = ["user_id"] if per_user else []
    if before is not None:
        rows = rows.unionByName(before.where("day is null").select(
            F.lit(-1).alias("step"), "user_id", F.col("running").alias("d_running"), F.col("queued").alias("d_queued")), allowMissingColumns=True)
    counts = running_sums(rows, keys, order, {"d_running": "running", "d_queued": "queued"}).where("step = 2")
    code = F.lit(None).cast("string")
    wait = F.lit(None).cast("int")
    rules = ((concurrency, F.col("running"), "concurrency", 120),
             (queued, F.col("queued"), "queue_full", 300),
             (depth, F.col("running") + F.col("queued"), "queue_full", 300))
    for limit, value, name, seconds in reversed(rules):
        if limit != UNLIMITED:
            hit = value >= limit
            code, wait = F.when(hit, name).otherwise(code), F.when(hit, seconds).otherwise(wait)
    judged = counts.select("ts", "job_id", "user_id", "day", "running", "queued",
                           code.alias("code"), wait.alias("retry_s"))
    if daily == UNLIMITED:
        return judged.drop("day")
    passed = ranked(judged.where("code is null"), ["user_id", "day"], ["ts", "job_id"], "turn")
    if before is not None:
        held = before.where("day is not null").select("user_id", "day", "admitted")
        passed = passed.join(held, ["user_id", "day"], "left").withColumn(
            "turn", F.col("turn") + F.coalesce("admitted", F.lit(0))).drop("admitted")
    over = F.col("turn") >= daily
    quota = passed.withColumns({"code": F.when(over, "quota_daily"), "retry_s": F.when(over, 3600)})
    blocked = judged.where("code is not null").withColumn("turn", F.lit(None).cast("long"))
    return quota.unionByName(blocked).drop("turn", "day")


def instrument_index(reports: DataFrame) -> DataFrame:
    """Instrument rows rebuilt from stored reports: node where present, else label.

    `reports(analysis_id, song_id, report)` with JSON reports.
    """
    doc = F.from_json("report", "instruments array<struct<label: string, node: string, "
                                "confidence: double, stem: string>>")
    rows = reports.select("analysis_id", "song_id", F.explode(doc["instruments"]).alias("i"))
    return rows.select("analysis_id", "song_id", F.coalesce("i.node", "i.label").alias("label"),
                       "i.confidence", "i.stem")
