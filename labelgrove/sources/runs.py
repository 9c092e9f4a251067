"""Predictions, run archives, split pins, vector caches, uploads and the source registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelgrove.functions.hashing import file_sha256
from labelgrove.operators.gate import latest_runs

PREDICTIONS = ("taxonomy_version string, dataset string, nodes array<string>, "
               "items array<struct<item_id: string, scores: array<double>>>")
SAFE_NAME = "^[A-Za-z0-9][A-Za-z0-9._-]*$"


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(item, node, score) from JSON documents with an array of items.

    Items stay an array of pairs, so repeated ids are kept and can be rejected.
    """
    doc = spark.read.schema(PREDICTIONS).json(path, multiLine=True)
    rows = doc.select("nodes", F.explode("items").alias("i")).select(
        F.col("i.item_id").alias("item"), "nodes", "i.scores")
    ok = F.size("nodes") == F.size("scores")
    checked = rows.withColumn("scores", F.when(ok, F.col("scores")).otherwise(
        F.raise_error(F.concat(F.lit("score count differs from node count: "), F.col("item")))))
    return checked.select("item", F.explode(F.arrays_zip("nodes", "scores")).alias("z")).select(
        "item", F.col("z.nodes").alias("node"), F.col("z.scores").alias("score"))


def prediction_errors(scores: DataFrame, nodes: DataFrame) -> DataFrame:
    """(item, node, error): repeated pairs, unknown nodes, missing scores."""
    twice = scores.groupBy("item", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "item", "node", F.lit("duplicate").alias("error"))
    unknown = scores.join(nodes.select("node"), "node", "left_anti").select(
        "item", "node", F.lit("unknown node").alias("error"))
    empty = scores.where("score is null or isnan(score)").select(
        "item", "node", F.lit("missing score").alias("error"))
    return twice.unionByName(unknown).unionByName(empty)


def write_predictions(scores: DataFrame, path: str, meta: dict[str, str] | None = None) -> None:
    """Columnar predictions rounded to six decimals, with a sidecar of settings."""
    scores.select("item", "node", F.round("score", 6).alias("score")).write.mode("errorifexists").parquet(
        f"{path}/scores")
    rows = [(k, str(v)) for k, v in sorted((meta or {}).items())]
    scores.sparkSession.createDataFrame(rows, "key string, value string").coalesce(1).write.mode(
        "errorifexists").json(f"{path}/meta")


def read_written_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("item string, node string, score double").parquet(f"{path}/scores")


def archive_run(obs: DataFrame, metrics: DataFrame, root: str, stamp: str, name: str,
                config: DataFrame | None = None) -> str:
    """Store a run under `<stamp>_<name>`; never overwrites. `config(key, value)` holds the settings,
    versions and hashes that two runs must share to be compared."""
    import re
    if not re.match(SAFE_NAME, name):
        raise ValueError(f"unsafe run name {name!r}")
    folder = f"{root}/run={stamp}_{name}"
    obs.write.mode("errorifexists").parquet(f"{folder}/obs")
    metrics.write.mode("errorifexists").parquet(f"{folder}/metrics")
    if config is not None:
        config.select("key", "value").write.mode("errorifexists").parquet(f"{folder}/config")
    return folder


def read_run_config(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("key string, value string").parquet(f"{folder}/config")


def archived_runs(spark: SparkSession, root: str) -> DataFrame:
    """(name, folder) of the newest archived run of every name."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").schema(
        "metric string").parquet(f"{root}/*/metrics")
    return latest_runs(rows.select(F.regexp_extract("_metadata.file_path", "run=([^/]+)/", 1).alias("folder")).distinct())


def read_run_metrics(spark: SparkSession, root: str, newest_only: bool = True) -> DataFrame:
    """Metrics of the archived runs with their folder name; by default the newest per run name."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").schema(
        "metric string, value double").parquet(f"{root}/*/metrics")
    rows = rows.select(F.regexp_extract("_metadata.file_path", "run=([^/]+)/", 1).alias("folder"),
                       "metric", "value")
    if not newest_only:
        return rows
    return rows.join(latest_runs(rows.select("folder").distinct()).select("folder"), "folder")


def write_split_pin(items: DataFrame, path: str) -> None:
    """Pin (item, split); refuses to overwrite a pin."""
    items.select("item", "split").write.mode("errorifexists").json(path)


def read_split_pin(spark: SparkSession, path: str) -> DataFrame:
    """(item, split) with valid split names only."""
    rows = spark.read.schema("item string, split string").json(path)
    return rows.withColumn("split", F.when(F.col("split").isin("train", "val", "test"), F.col("split"))
                           .otherwise(F.raise_error(F.concat(F.lit("bad split "), F.col("split")))))


def split_pin_errors(items: DataFrame, pin: DataFrame, partial: bool = False) -> DataFrame:
    """(item, error): items without a pin, and pinned items that are absent unless `partial`."""
    a = items.select("item", F.lit(True).alias("here"))
    b = pin.select("item", F.lit(True).alias("pinned"))
    why = F.when(F.col("pinned").isNull(), "unpinned")
    if not partial:
        why = why.when(F.col("here").isNull(), "pinned but absent")
    return a.join(b, "item", "full_outer").select("item", why.alias("error")).where("error is not null")


def extend_cache(wanted: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame],
                 schema: str = "item string, layer int, vec array<float>") -> DataFrame:
    """Vectors of the wanted items: stored ones are reused, the rest computed and appended.

    `embed` maps items to vector rows (for example with `mapInPandas`); a rerun after a failure
    starts from what is already stored.
    """
    spark = wanted.sparkSession
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    done = spark.read.schema(schema).parquet(path)
    todo = wanted.select("item").distinct().join(done.select("item").distinct(), "item", "left_anti")
    embed(todo).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).join(wanted.select("item"), "item", "left_semi")


def align_vectors(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted(item, pos) with its vector, failing on an item without one."""
    rows = wanted.join(cache.select("item", "vec"), "item", "left")
    return rows.withColumn("vec", F.when(F.col("vec").isNotNull(), F.col("vec")).otherwise(
        F.raise_error(F.concat(F.lit("no vector for "), F.col("item").cast("string"))).cast(
            "array<float>")))


def upload_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content_hash, bytes) of uploaded files of any length; the content passes as a stream."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", file_sha256(spark, files["path"]).alias("content_hash"), F.col("length").alias("bytes"))


#: Folders that songs are dealt over; an append rewrites those of its songs alone.
SONG_FOLDERS = 4096


def save_report(reports: DataFrame, root: str) -> None:
    """Append analyses(analysis_id, song_id, report) and renew the instrument rows of their songs.

    Songs lie in SONG_FOLDERS folders by a hash of their id. Only the folders of the appended songs are
    read again, and only theirs are replaced; at most SONG_FOLDERS numbers pass the driver.
    """
    from labelgrove.operators.library import instrument_index
    spark, place = reports.sparkSession, F.pmod(F.xxhash64("song_id"), F.lit(SONG_FOLDERS)).cast("int")
    dealt = reports.withColumn("folder", place)
    folders = [r["folder"] for r in dealt.select("folder").distinct().collect()]
    dealt.write.mode("append").partitionBy("folder").parquet(f"{root}/analyses")
    stored = spark.read.schema(dealt.schema).parquet(f"{root}/analyses").where(F.col("folder").isin(folders))
    instrument_index(stored).withColumn("folder", place).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(f"{root}/instruments")


# Kinds of sources (fixed values); the reviewed licences are an input table.
KINDS = ("sfz", "sf2", "synth", "notes")


def registry_errors(sources: DataFrame, leaves: DataFrame, licences: DataFrame, pairs: DataFrame,
                    required: DataFrame) -> DataFrame:
    """(source, error) of a source registry.

    `sources(source, kind, license, commercial_clean, leaves, programs, path, label_as, weight,
    status)` where `programs` lists the leaves with a program, `licences(license, commercial)`, `pairs` the taxonomy closure, `required(leaf)`.
    """
    known = sources.join(licences, "license", "left")
    named = sources.select("source", "label_as", F.explode("leaves").alias("node"))

    def found(df: DataFrame, cond: str, error: str) -> DataFrame:
        return df.where(cond).select("source", F.lit(error).alias("error"))

    twice = sources.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    not_leaf = named.join(leaves.select("node"), "node", "left_anti").distinct()
    coarse = named.where("label_as is not null").join(
        pairs.select("node", F.col("ancestor").alias("label_as")), ["node", "label_as"], "left_anti")
    clean = (known.where("commercial_clean and commercial").select(F.explode("leaves").alias("leaf"))
             .distinct())
    uncovered = required.join(clean, "leaf", "left_anti").select(
        F.col("leaf").alias("source"), F.lit("leaf without commercially clean source").alias("error"))
    return (found(twice, "n > 1", "duplicate id")
            .unionByName(found(sources, f"kind not in {KINDS}", "unknown kind"))
            .unionByName(found(known, "commercial is null", "licence not reviewed"))
            .unionByName(found(known, "commercial_clean and not commercial", "contradicts licence"))
            .unionByName(found(not_leaf, "true", "not a leaf"))
            .unionByName(found(sources, "kind <> 'synth' and path is null", "needs a path"))
            .unionByName(found(coarse.select("source").distinct(), "true", "label_as is no ancestor"))
            .unionByName(found(sources, "weight <= 0", "weight must be positive"))
            .unionByName(found(sources, "size(array_except(programs, leaves)) > 0",
                               "program of another leaf"))
            .unionByName(found(sources, "kind = 'sf2' and size(array_except(leaves, programs)) > 0",
                               "leaf without program"))
            .unionByName(found(sources, "coalesce(status, '') not in ('', 'pending_approval')",
                               "unknown status"))
            .unionByName(uncovered))
