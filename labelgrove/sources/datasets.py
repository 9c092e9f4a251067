"""Label readers for the supported file layouts. Each returns DataFrames; nothing is parsed on the
driver. Inputs are JSON lines, CSV, XML or file listings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelgrove.functions import text as X

SPLITS = ("train", "val", "test")

MULTITRACK = ("track_id string, artist string, genre string, has_bleed string, mix_filename string, "
              "stem_dir string, stems map<string, struct<instrument: string, filename: string, "
              "raw: map<string, struct<instrument: string>>>>")


def multitrack(spark: SparkSession, path: str, audio: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tracks, stem labels and raw labels of multitrack metadata.

    `instrument` may be a string or a list. With a listing `audio(track_id)` tracks without audio
    are left out.
    """
    doc = spark.read.schema(MULTITRACK).json(path)
    if audio is not None:
        doc = doc.join(audio.select("track_id"), "track_id", "left_semi")
    doc = doc.withColumnRenamed("track_id", "item")
    stems = doc.select("item", F.explode("stems").alias("stem", "s"))
    label = lambda c: F.explode(X.as_list(F.col(c))).alias("label")
    return {
        "items": doc.select("item", X.artist_or_prefix(F.col("artist"), F.col("item")).alias("artist"),
                            "genre", X.truth_value(F.col("has_bleed")).alias("bleed")),
        "stems": stems.select("item", "stem", "s.filename"),
        "stem_labels": stems.select("item", "stem", label("s.instrument")),
        "raw_labels": stems.select("item", "stem", F.explode("s.raw").alias("raw", "r")).select(
            "item", "stem", label("r.instrument"))}


def clip_labels(spark: SparkSession, labels: str, metadata: str, partitions: dict[str, str],
                classes: DataFrame) -> dict[str, DataFrame]:
    """Clips where only some classes were judged.

    CSV `sample_key,cls,prob,observed`, metadata CSV with artist and licence, and one key list per
    split. `errors` collects unknown classes, keys without metadata and probabilities outside [0, 1].
    """
    probs = spark.read.csv(labels, header=True,
                           schema="sample_key string, cls string, prob double, observed boolean")
    meta = spark.read.csv(metadata, header=True, schema=(
        "track_id long, artist_id long, artist_name string, license_title string, sample_key string, "
        "start_time double"))
    parts = None
    for split, path in partitions.items():
        p = partition_keys(spark, path).withColumn("split", F.lit(split))
        parts = p if parts is None else parts.unionByName(p)
    items = meta.join(parts.where("ok").select("sample_key", "split"), "sample_key", "left")
    bad = lambda df, why: df.select(F.col("sample_key").alias("key"), F.lit(why).alias("error"))
    errors = (bad(probs.join(classes.select("cls"), "cls", "left_anti"), "unknown class")
              .unionByName(bad(probs.where("observed and not prob between 0 and 1"), "bad probability"))
              .unionByName(bad(probs.join(meta, "sample_key", "left_anti"), "no metadata"))
              .unionByName(bad(parts.where("not ok"), "bad key"))
              .unionByName(bad(parts.where("ok").groupBy("sample_key").agg(
                  F.count_distinct("split").alias("k")).where("k > 1"), "key in several partitions"))
              .unionByName(bad(parts.where("ok").join(meta, "sample_key", "left_anti"),
                               "partition key without metadata"))).distinct()
    return {"items": items, "probs": probs.withColumnRenamed("sample_key", "item"), "errors": errors}


def partition_keys(spark: SparkSession, path: str) -> DataFrame:
    """(sample_key, ok) of a headerless key list; `ok` tells keys of the right form."""
    return (spark.read.text(path).select(F.trim(F.substring_index("value", ",", 1)).alias("sample_key"))
            .where("sample_key <> ''").withColumn("ok", F.rlike("sample_key", F.lit(X.PARTITION_KEY))))


def licences(spark: SparkSession, metadata: str) -> DataFrame:
    return spark.read.csv(metadata, header=True, schema=(
        "track_id long, artist_id long, artist_name string, license_title string, sample_key string, "
        "start_time double")).select("sample_key", "license_title")


RENDERED = ("track_id string, UUID string, stems map<string, struct<audio_rendered: boolean, "
            "inst_class: string, is_drum: boolean, program_num: int, plugin_name: string, "
            "integrated_loudness: double>>")


def rendered_tracks(spark: SparkSession, path: str, plugins: DataFrame, families: DataFrame,
                    floor_lufs: float | None = -60.0) -> DataFrame:
    """(item, stem, kind, node) of rendered tracks.

    The plugin rule wins over the family rule (`effects` tables as from `rule_effects`); stems that
    were not rendered are skipped; stems below the loudness floor turn unknown.
    """
    doc = spark.read.schema(RENDERED).json(path)
    s = doc.select(F.col("track_id").alias("item"), F.explode("stems").alias("stem", "s")).select(
        "item", "stem", "s.*")
    return rendered_stems(s, plugins, families, floor_lufs)


def rendered_stems(stems: DataFrame, plugins: DataFrame, families: DataFrame,
                   floor_lufs: float | None = -60.0) -> DataFrame:
    real = ((F.coalesce("audio_rendered", F.lit(False)))
            | (F.col("plugin_name").isNotNull() & F.col("integrated_loudness").isNotNull()))
    by_plugin = plugins.select(F.col("label").alias("plugin_name"), F.col("effects").alias("ep"))
    by_family = families.select(F.col("label").alias("inst_class"), F.col("effects").alias("ef"))
    hide_all = F.array(F.struct(F.lit("unknown").alias("kind"), F.lit("*").alias("node")))
    rows = (stems.where(real).join(by_plugin, "plugin_name", "left").join(by_family, "inst_class", "left")
            .withColumn("e", F.explode(F.coalesce("ep", "ef", hide_all))))
    quiet = (F.lit(False) if floor_lufs is None
             else F.coalesce(F.col("integrated_loudness") < floor_lufs, F.lit(False)))
    return rows.select("item", "stem", F.when(quiet, "unknown").otherwise(F.col("e.kind")).alias("kind"),
                       F.col("e.node").alias("node"))


WINDOW_CLIP = ("schema string, song_id string, song string, artist string, genre string, "
               "window struct<start_s: double, dur_s: double>, tracks array<struct<track_id: string, "
               "trackType: string, stemName: string, has_bleed: boolean, rms_db: double, "
               "peak_frame_db: double>>")
WINDOW_SCHEMA = "moisesdb_clip/1"  # format tag of the files (fixed value)


def window_clips(spark: SparkSession, path: str, start_s: float | None = None) -> DataFrame:
    """(item, clip, type, bleed, genre, rms_db, peak_frame_db, artist): one row per track of a window.

    Fails on documents with another schema tag; `start_s` picks one window per song.
    """
    doc = spark.read.schema(WINDOW_CLIP).json(path)
    tag = F.when(F.col("schema") == WINDOW_SCHEMA, F.col("song_id")).otherwise(
        F.raise_error(F.concat(F.lit("unexpected clip schema "), F.coalesce("schema", F.lit("null")))))
    doc = doc.withColumn("song_id", tag)
    if start_s is not None:
        doc = doc.where(F.col("window.start_s") == start_s)
    clip = F.concat_ws("/", "song_id", X.window_tag(F.col("window.start_s"))).alias("clip")
    return doc.select(F.col("song_id").alias("item"), clip, "genre", "artist",
                      F.explode("tracks").alias("t")).select(
        "item", "clip", F.col("t.trackType").alias("type"), F.col("t.has_bleed").alias("bleed"),
        "genre", "t.rms_db", "t.peak_frame_db", "artist")


def missing_tracks(tracks: DataFrame, listing: DataFrame) -> DataFrame:
    """Tracks whose built path `song/stem/track.wav` is not in an archive listing(path)."""
    path = F.concat_ws("/", "song_id", "stem", F.concat("track_id", F.lit(".wav"))).alias("path")
    return tracks.select("song_id", "stem", "track_id", path).join(listing.select("path"), "path",
                                                                   "left_anti")


def solo_notes(listing: DataFrame) -> DataFrame:
    """(path, note, problem) decoded from file names; the style must match the folder."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "[.]wav$", "")
    folder = F.get(F.split("path", "/"), F.size(F.split("path", "/")) - 2)
    note = X.bass_note(name)
    return listing.select("path", folder.alias("folder"), note.alias("note")).withColumn(
        "problem", F.when(F.col("note").isNull(), "unreadable name")
        .when(F.col("note.style") != F.col("folder"), "folder and name differ"))


EVENT_ROW = "pitch INT, onsetSec DOUBLE, offsetSec DOUBLE, excitationStyle STRING, expressionStyle STRING"


def annotated_tracks(spark: SparkSession, path: str) -> DataFrame:
    """(file, pitch, onsetSec, offsetSec, excitationStyle, expressionStyle) of XML note lists."""
    rows = spark.read.format("xml").option("rowTag", "event").schema(EVENT_ROW).load(path)
    return rows.select(F.regexp_extract("_metadata.file_name", "^(.*)[.]xml$", 1).alias("file"), "*")


def track_styles(events: DataFrame) -> DataFrame:
    """Union of the styles of a track's notes, as label rows."""
    style = F.explode(F.array_compact(F.array("excitationStyle", "expressionStyle"))).alias("label")
    return events.select(F.col("file").alias("item"), style).distinct()


def effect_notes(listing: DataFrame, listed: DataFrame) -> DataFrame:
    """(path, fields, problem): file-name decode checked against the list of the release.

    `listed(file, instrument, ...)` holds the same fields; leading zeros do not matter.
    """
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "[.]wav$", "")
    own = listing.select("path", name.alias("file"), X.effect_note(name).alias("f"))
    fields = [f for f in X.EFFECT_FIELDS if f not in ("rest", "instrument")]
    other = listed.select("file", F.lit(True).alias("found"), *[F.col(f).alias(f"l_{f}") for f in fields])
    rows = own.join(other, "file", "left")
    same = F.lit(True)
    for f in fields:
        same = same & F.coalesce(X.same_number(F.col(f"f.{f}"), F.col(f"l_{f}").cast("string")), F.lit(False))
    return rows.select("path", "f", F.when(F.col("f").isNull(), "unreadable name")
                       .when(F.col("found").isNull(), "not in list").when(~same, "fields differ")
                       .alias("problem"))


HAND_LABELS = ("artist string, title string, genre string, audio_filename string, listened_fully boolean, "
               "labels map<string, struct<state: string, intervals: array<array<double>>>>")


def hand_labels(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Items, label states and intervals of hand-labelled songs."""
    doc = spark.read.schema(HAND_LABELS).json(path)
    item = F.trim(F.concat_ws(" - ", "artist", "title")).alias("item")
    rows = doc.select(item, "artist", "genre", "listened_fully", "labels")
    states = rows.select("item", F.explode("labels").alias("node", "v"))
    return {"items": rows.select("item", F.lower(F.coalesce("artist", "item")).alias("artist"), "genre",
                                 F.coalesce("listened_fully", F.lit(False)).alias("listened_fully")),
            "states": states.select("item", "node", "v.state"),
            "intervals": states.select("item", "node", F.explode("v.intervals").alias("i")).select(
                "item", "node", F.col("i")[0].alias("start_s"), F.col("i")[1].alias("end_s"))}


RENDERED_CLIP = ("schema_version int, clip_id string, split string, commercial_clean boolean, "
                 "positive_leaves array<string>, unknown_below array<string>, "
                 "midi struct<composition: string>")


def synthetic_clips(spark: SparkSession, path: str, commercial_only: bool = False,
                    versions: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(item, split, artist, kind, node) of rendered clips: positives and unknown roots."""
    doc = spark.read.schema(RENDERED_CLIP).json(path)
    doc = doc.withColumn("clip_id", F.when(F.col("schema_version").isin(*versions), F.col("clip_id"))
                         .otherwise(F.raise_error(F.lit("unsupported clip version"))))
    if commercial_only:
        doc = doc.where("commercial_clean")
    marks = F.concat(F.transform("positive_leaves", lambda n: F.struct(
        F.lit("positive").alias("kind"), n.alias("node"))), F.transform("unknown_below", lambda n: F.struct(
            F.lit("unknown").alias("kind"), n.alias("node"))))
    return doc.select(F.col("clip_id").alias("item"), "split",
                      F.substring_index("midi.composition", "/", 1).alias("artist"),
                      F.explode(marks).alias("m")).select("item", "split", "artist", "m.kind", "m.node")


READERS: dict[str, Callable] = {
    "multitrack": multitrack, "clips": clip_labels, "rendered": rendered_tracks,
    "windows": window_clips, "annotated": annotated_tracks, "hand": hand_labels,
    "synthetic": synthetic_clips,
}


def load_dataset(spark: SparkSession, name: str, *args, **options):
    """Reader by name; options set to None are left out."""
    if name not in READERS:
        raise ValueError(f"unknown dataset {name}; known: {sorted(READERS)}")
    return READERS[name](spark, *args, **{k: v for k, v in options.items() if v is not None})
