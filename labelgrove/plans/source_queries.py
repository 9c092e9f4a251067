"""Readers, writers and validators on files that Spark derives from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelgrove.operators import labels as L
from labelgrove.operators import metrics as M
from labelgrove.operators import taxonomy as T
from labelgrove.plans.catalog import query
from labelgrove.plans.label_queries import order_labels
from labelgrove.plans.metric_queries import r6
from labelgrove.plans.standins import (FLAT_OBS, ORDER_TYPES, PLACE_NODES, PLACES, TYPE_EFFECTS, ap_sql)
from labelgrove.sources import datasets as D
from labelgrove.sources import runs as R
from labelgrove.sources import taxonomy_files as TF
from labelgrove.sources.literal import small_table
from labelgrove.session import work_folder


# ---- label readers
def write_json(t, df, name):
    folder = work_folder(t.spark, name)
    df.write.json(folder)
    return folder


STEM_ROWS = """SELECT l_orderkey AS item, CAST(l_linenumber % 2 AS VARCHAR) AS stem, p_type, p_brand, l_returnflag
  FROM lineitem JOIN part ON l_partkey = p_partkey"""


@query("read_multitrack", f"""SELECT 'stem' AS kind, item, stem, p_type AS label, count(*) AS n FROM ({STEM_ROWS}) s
  WHERE l_returnflag <> 'R' GROUP BY ALL
  UNION ALL SELECT 'raw', item, stem, p_brand, count(*) FROM ({STEM_ROWS}) s WHERE l_returnflag = 'R' GROUP BY ALL""")
def read_multitrack(t):
    """Nested metadata written as JSON lines and read back into long label tables."""
    base = t.lines().select(F.col("l_orderkey").cast("string").alias("track_id"),
                            (F.col("l_linenumber") % 2).cast("string").alias("stem"), "l_linenumber",
                            "p_type", "p_brand", "l_returnflag")
    names = F.when(F.col("l_returnflag") != "R", F.col("p_type"))
    raws = F.when(F.col("l_returnflag") == "R", F.struct(
        F.col("l_linenumber").cast("string").alias("k"), F.struct(F.col("p_brand").alias("instrument")).alias("v")))
    stems = base.groupBy("track_id", "stem").agg(
        F.to_json(F.array_sort(F.collect_list(names))).alias("instrument"), F.collect_list(raws).alias("raws"))
    # line numbers repeat inside an order, so raw tracks are keyed by their position
    raw = F.map_from_entries(F.transform("raws", lambda r, i: F.struct(i.cast("string"), r["v"])))
    docs = stems.groupBy("track_id").agg(F.map_from_entries(F.collect_list(F.struct("stem", F.struct(
        "instrument", raw.alias("raw"))))).alias("stems"))
    tables = D.multitrack(t.spark, write_json(t, docs, "multitrack"))
    parts = [tables[f"{k}_labels"].groupBy("item", "stem", "label").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("kind", F.lit(k)) for k in ("stem", "raw")]
    return parts[0].unionByName(parts[1]).withColumn("item", F.col("item").cast("long"))


@query("read_partial_clips", """SELECT cls, CASE o_orderkey % 10 WHEN 0 THEN 'test' ELSE 'train' END AS split,
    count(*) AS n, count(*) FILTER (WHERE prob >= 0.5) AS n_positive FROM (
    SELECT l_orderkey, p_type AS cls, max(l_quantity) / 50 AS prob FROM lineitem JOIN part ON l_partkey = p_partkey
    GROUP BY 1, 2) c JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def read_partial_clips(t):
    """Class CSV, metadata CSV and partition key lists, with the checks between them."""
    key = lambda order: F.concat_ws("_", F.format_string("%06d", order), F.lit("1"))
    probs = t.lines().groupBy(key("l_orderkey").alias("sample_key"), F.col("p_type").alias("cls")).agg(
        (F.max("l_quantity") / 50).alias("prob")).withColumn("observed", F.lit(True))
    ids = t.read("orders").select(key("o_orderkey").alias("sample_key"),
                                  F.col("o_orderkey").alias("track_id"), F.col("o_custkey").alias("artist_id"))
    root = work_folder(t.spark, "clips")
    probs.write.csv(f"{root}/labels", header=True)
    ids.select("track_id", "artist_id", F.lit("a").alias("artist_name"), F.lit("CC-BY").alias("license_title"),
               "sample_key", F.lit(0.0).alias("start_time")).write.csv(f"{root}/meta", header=True)
    ids.where("track_id % 10 <> 0").select("sample_key").write.text(f"{root}/train")
    ids.where("track_id % 10 = 0").select("sample_key").write.text(f"{root}/test")
    classes = t.read("part").select(F.col("p_type").alias("cls")).distinct()
    d = D.clip_labels(t.spark, f"{root}/labels", f"{root}/meta",
                      {"train": f"{root}/train", "test": f"{root}/test"}, classes)
    clean = d["probs"].join(d["errors"].select(F.col("key").alias("item")), "item", "left_anti")
    return clean.join(d["items"].select(F.col("sample_key").alias("item"), "split"), "item").groupBy(
        "cls", "split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prob") >= 0.5).alias("n_positive"))


@query("rendered_track_labels", f"""WITH s AS (SELECT l_orderkey AS item, l_linenumber AS stem,
      CASE WHEN l_linenumber % 2 = 0 THEN p_type ELSE 'none' END AS plugin, p_brand AS cls, -2.0 * l_quantity AS lufs
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'N'),
    f AS (SELECT 'Brand#' || (n_nationkey + 1) AS label, 'positive' AS kind, node FROM ({PLACES}) p
      WHERE n_nationkey < 20),
    e AS (SELECT s.*, p.kind, p.node FROM s JOIN ({TYPE_EFFECTS}) p ON plugin = p.label
      UNION ALL SELECT s.*, coalesce(f.kind, 'unknown'), coalesce(f.node, '*') FROM s LEFT JOIN f ON cls = f.label
      WHERE plugin NOT IN (SELECT label FROM ({TYPE_EFFECTS}) x))
  SELECT CASE WHEN lufs < -60 THEN 'unknown' ELSE kind END AS kind, node, count(*) AS n FROM e GROUP BY 1, 2""")
def rendered_track_labels(t):
    stems = t.lines().select(
        F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("stem"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("p_type")).otherwise("none").alias("plugin_name"),
        F.col("p_brand").alias("inst_class"), (F.col("l_returnflag") != "N").alias("audio_rendered"),
        F.when(F.col("l_returnflag") != "N", -2.0 * F.col("l_quantity")).alias("integrated_loudness"))
    nodes = t.place_nodes()
    family = t.brand_rules().where("cast(substring(label, 7) as int) <= 20")
    rows = D.rendered_stems(stems, L.rule_effects(t.type_rules(), nodes), L.rule_effects(family, nodes))
    return rows.groupBy("kind", "node").agg(F.count(F.lit(1)).alias("n"))


@query("read_window_clips", """SELECT l_orderkey || '/w' || (o_custkey % 3 * 20) AS clip, p_type AS type, count(*) AS n,
    count(*) FILTER (WHERE l_returnflag = 'R') AS n_bleed, round(min(-l_quantity), 3) AS lowest
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def read_window_clips(t):
    orders = t.read("orders").select("o_orderkey", (F.col("o_custkey") % 3 * 20.0).alias("start"))
    track = F.struct(F.col("p_type").alias("trackType"), (F.col("l_returnflag") == "R").alias("has_bleed"),
                     (-F.col("l_quantity")).alias("rms_db"))
    docs = (t.lines().join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(F.col("l_orderkey").cast("string").alias("song_id"), "start")
            .agg(F.collect_list(track).alias("tracks"))
            .select(F.lit(D.WINDOW_SCHEMA).alias("schema"), "song_id",
                    F.struct(F.col("start").alias("start_s"), F.lit(20.0).alias("dur_s")).alias("window"), "tracks"))
    rows = D.window_clips(t.spark, write_json(t, docs, "windows"))
    return rows.groupBy("clip", "type").agg(F.count(F.lit(1)).alias("n"), F.count_if("bleed").alias("n_bleed"),
                                            F.round(F.min("rms_db"), 3).alias("lowest"))


@query("missing_archive_tracks", """SELECT l_orderkey AS song_id, l_linenumber AS stem, l_partkey AS track_id
  FROM lineitem WHERE l_partkey % 9 = 0 GROUP BY ALL""")
def missing_archive_tracks(t):
    tracks = t.read("lineitem").select(F.col("l_orderkey").alias("song_id"), F.col("l_linenumber").alias("stem"),
                                       F.col("l_partkey").alias("track_id")).distinct()
    listing = tracks.where("track_id % 9 <> 0").select(F.concat_ws(
        "/", "song_id", "stem", F.concat("track_id", F.lit(".wav"))).alias("path"))
    return D.missing_tracks(tracks, listing).drop("path")


@query("read_annotated_xml", """SELECT CAST(event_id % 60 AS INT) AS pitch, event_type AS style, count(*) AS n,
    round(sum(value), 3) AS onset FROM events GROUP BY 1, 2""")
def read_annotated_xml(t):
    folder = work_folder(t.spark, "xml")
    (t.read("events").select((F.col("event_id") % 60).cast("int").alias("pitch"),
                             F.col("value").alias("onsetSec"), (F.col("value") + 1).alias("offsetSec"),
                             F.col("event_type").alias("excitationStyle"))
     .write.format("xml").option("rowTag", "event").save(folder))
    return D.annotated_tracks(t.spark, folder).groupBy("pitch", F.col("excitationStyle").alias("style")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("onsetSec"), 3).alias("onset"))


@query("read_hand_labels", f"""SELECT c_name || ' - ' || c_mktsegment AS item, c_acctbal > 0 AS listened_fully,
    CASE WHEN c_custkey % 3 = 0 THEN 'present' ELSE 'unsure' END AS state, node,
    CAST(c_custkey % 10 AS DOUBLE) AS start_s FROM customer JOIN ({PLACES}) p ON c_nationkey = n_nationkey""")
def read_hand_labels(t):
    c = t.read("customer").join(t.places(), F.col("c_nationkey") == F.col("n_nationkey"))
    at = (F.col("c_custkey") % 10).cast("double")
    label = F.struct(F.when(F.col("c_custkey") % 3 == 0, "present").otherwise("unsure").alias("state"),
                     F.array(F.array(at, at + 1)).alias("intervals"))
    docs = c.select(F.col("c_name").alias("artist"), F.col("c_mktsegment").alias("title"),
                    (F.col("c_acctbal") > 0).alias("listened_fully"), F.create_map("node", label).alias("labels"))
    d = D.hand_labels(t.spark, write_json(t, docs, "hand"))
    return (d["items"].select("item", "listened_fully").join(d["states"], "item")
            .join(d["intervals"].select("item", "node", "start_s"), ["item", "node"]))


@query("read_rendered_clips", f"""SELECT kind, node, count(*) AS n FROM (
    SELECT 'positive' AS kind, node FROM customer JOIN ({PLACES}) p ON c_nationkey = n_nationkey
      WHERE c_acctbal > 0
    UNION ALL SELECT 'unknown', split_part(node, '.', 1) FROM customer JOIN ({PLACES}) p
      ON c_nationkey = n_nationkey WHERE c_acctbal > 0 AND c_custkey % 4 = 0) k GROUP BY 1, 2""")
def read_rendered_clips(t):
    c = t.read("customer").join(t.places(), F.col("c_nationkey") == F.col("n_nationkey"))
    below = F.when(F.col("c_custkey") % 4 == 0, F.array(T.family_of("node"))).otherwise(
        F.array().cast("array<string>"))
    docs = c.select(F.lit(2).alias("schema_version"), F.col("c_custkey").cast("string").alias("clip_id"),
                    F.lit("train").alias("split"), (F.col("c_acctbal") > 0).alias("commercial_clean"),
                    F.array("node").alias("positive_leaves"), below.alias("unknown_below"),
                    F.struct(F.concat("c_mktsegment", F.lit("/x")).alias("composition")).alias("midi"))
    rows = D.load_dataset(t.spark, "synthetic", write_json(t, docs, "clips"), commercial_only=True, versions=None)
    return rows.groupBy("kind", "node").agg(F.count(F.lit(1)).alias("n"))


BASS = """SELECT l_orderkey, l_linenumber, 'd/' || CASE WHEN l_tax > 0.06 THEN 'MU' ELSE style END || '/BS_' || (l_suppkey % 4 + 1)
    || '_EQ_' || (l_suppkey % 2 + 1) || '_' || style || '_NO_' || (l_partkey % 4 + 1) || '_' || (l_partkey % 13) || '.wav' AS path,
    style, 28 + 5 * (l_partkey % 4) + l_partkey % 13 AS pitch
  FROM (SELECT *, CASE l_returnflag WHEN 'R' THEN 'FS' WHEN 'A' THEN 'PK' ELSE 'ST' END AS style FROM lineitem) l"""


@query("solo_note_names", f"""SELECT style, CAST(pitch AS INT) AS pitch, CASE WHEN split_part(path, '/', 2) <> style
    THEN 'folder and name differ' END AS problem, count(*) AS n FROM ({BASS}) b GROUP BY ALL""")
def solo_note_names(t):
    style = F.when(F.col("l_returnflag") == "R", "FS").when(F.col("l_returnflag") == "A", "PK").otherwise("ST")
    folder = F.when(F.col("l_tax") > 0.06, "MU").otherwise(style)
    n = lambda c: c.cast("string")
    name = F.concat(F.lit("BS_"), n(F.col("l_suppkey") % 4 + 1), F.lit("_EQ_"), n(F.col("l_suppkey") % 2 + 1),
                    F.lit("_"), style, F.lit("_NO_"), n(F.col("l_partkey") % 4 + 1), F.lit("_"),
                    n(F.col("l_partkey") % 13), F.lit(".wav"))
    listing = t.read("lineitem").select(F.concat_ws("/", F.lit("d"), folder, name).alias("path"))
    return D.solo_notes(listing).groupBy(F.col("note.style").alias("style"), F.col("note.pitch").alias("pitch"),
                                         "problem").agg(F.count(F.lit(1)).alias("n"))


@query("effect_note_names", """SELECT problem, count(*) AS n FROM (SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'not in list'
    WHEN s_suppkey % 7 = 0 THEN 'fields differ' END AS problem FROM supplier) p GROUP BY 1""")
def effect_note_names(t):
    k = F.col("s_suppkey")
    name = F.format_string("G%d%d-%02d%03d-%d%02d%d-%d", k % 10, k % 3, k % 60 + 28, k % 999, k % 5, k % 42,
                           k % 4, k)
    s = t.read("supplier").select(k.alias("k"), name.alias("file"))
    listing = s.select(F.concat(F.lit("fx/"), "file", F.lit(".wav")).alias("path"))
    listed = s.where("k % 5 <> 0").select(
        "file", (F.col("k") % 3).alias("playstyle"), (F.col("k") % 10).alias("setting"),
        (F.col("k") % 60 + 28).alias("midi"), (F.col("k") % 5).alias("fxgroup"),
        F.when(F.col("k") % 7 == 0, 99).otherwise(F.col("k") % 42).alias("fxtype"),
        (F.col("k") % 4).alias("fxsetting"), F.col("k").alias("filenr"))
    return D.effect_notes(listing, listed).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


# ---- validators
@query("taxonomy_file_errors", f"""SELECT node, 'leaf without source' AS error FROM ({PLACE_NODES}) n
    WHERE contains(node, '.') AND ends_with(node, '7')
  UNION ALL SELECT node, 'sources only on leaves' FROM ({PLACE_NODES}) n WHERE node = 'asia'
  UNION ALL SELECT 'oceania.x', 'parent missing or listed after child' UNION ALL SELECT 'Bad Id', 'bad id'
  UNION ALL SELECT 'africa.nation_0', 'duplicate node' UNION ALL SELECT NULL, 'bad version'""")
def taxonomy_file_errors(t):
    """A taxonomy document built from the place table with one flaw of each kind."""
    none = F.array().cast("array<string>")
    data = F.when(F.col("is_leaf") & ~F.endswith("node", F.lit("7")) | (F.col("node") == "asia"),
                  F.array(F.lit("x"))).otherwise(none)
    good = t.place_nodes().select(F.col("node").alias("id"), data.alias("data"), none.alias("planned"))
    dup = good.where("id = 'africa.nation_0'")
    odd = good.where("id in ('asia', 'europe')").select(
        F.when(F.col("id") == "asia", "oceania.x").otherwise("Bad Id").alias("id"),
        F.array(F.lit("x")).alias("data"), none.alias("planned"))
    entry = F.struct("id", F.lit(None).cast("string").alias("name"), "data", "planned",
                     F.lit(None).cast("string").alias("note"))
    doc = good.unionByName(dup).unionByName(odd).agg(
        F.array_sort(F.collect_list(entry)).alias("nodes")).select(F.lit("1.2").alias("version"), "nodes")
    folder = work_folder(t.spark, "taxonomy")
    doc.coalesce(1).write.json(folder)
    return TF.taxonomy_errors(TF.read_taxonomy_entries(t.spark, folder))


@query("rule_table_errors", """SELECT p_type AS label, e.error FROM (SELECT DISTINCT p_type FROM part) p JOIN (VALUES
    ('SMALL', 'unknown node nowhere'), ('LARGE', 'mapped and ignored'), ('PROMO', 'ignore needs a reason'),
    ('MEDIUM', 'unexpected keys'), ('ECONOMY', 'node must name taxonomy ids')) e(label, error) ON p_type = e.label""")
def rule_table_errors(t):
    """Short and long rule forms over the part types, each with one flaw."""
    kind = F.col("p_type")
    types = t.read("part").select(kind).distinct()
    spec = (F.when(kind == "SMALL", '["asia", "nowhere"]').when(kind == "LARGE", "europe")
            .when(kind == "PROMO", '{"unknown": ["asia"]}')
            .when(kind == "MEDIUM", '{"node": "asia", "color": "red"}')
            .when(kind == "ECONOMY", '{"node": ["*"]}').otherwise('{"node": ["africa"], "children_unknown": false}'))
    rows = types.select(F.lit("parts").alias("source"), F.when(kind == "PROMO", "ignore").otherwise("map").alias("table"),
                        kind.alias("label"), spec.alias("spec"))
    again = rows.where("label = 'LARGE'").select("source", F.lit("ignore").alias("table"), "label",
                                                 F.lit('{"reason": "x"}').alias("spec"))
    rules = TF.read_rules(t.spark, write_json(t, rows.unionByName(again), "rules"))
    return TF.rule_errors(rules, t.place_nodes()).select("label", "error")


@query("dataset_mask_errors", """SELECT node, error FROM (VALUES ('europe', 'rule targets masked subtree'),
    ('asia.nation_2', 'not level 1'), ('asia', 'missing reason'), ('atlantis', 'unknown node'),
    ('asia', 'rule targets masked subtree')) e(node, error) WHERE EXISTS (SELECT 1 FROM region)""")
def dataset_mask_errors(t):
    roots = small_table(t.spark, [("europe", "x"), ("asia.nation_2", "x"), ("asia", ""), ("atlantis", "x")],
                        "node string, reason string")
    return TF.mask_errors(roots, t.type_rules(), t.place_nodes())


@query("source_registry_errors", f"""SELECT 's' || s_suppkey AS source, e.error FROM supplier JOIN (VALUES
    (1, 'unknown kind'), (2, 'licence not reviewed'), (3, 'contradicts licence'), (4, 'not a leaf'), (5, 'needs a path'),
    (6, 'label_as is no ancestor'), (7, 'weight must be positive'), (8, 'unknown status'), (9, 'leaf without program'),
    (10, 'program of another leaf')) e(k, error) ON s_suppkey % 20 = e.k
  UNION ALL SELECT node, 'leaf without commercially clean source' FROM ({PLACE_NODES}) n WHERE contains(node, '.') AND node NOT IN
    (SELECT p.node FROM supplier JOIN ({PLACES}) p ON s_nationkey = n_nationkey WHERE s_suppkey % 20 NOT IN (2, 3, 4))""")
def source_registry_errors(t):
    m = F.col("s_suppkey") % 20
    s = t.read("supplier").join(t.places(), F.col("s_nationkey") == F.col("n_nationkey"))
    leaves = F.when(m == 4, F.array(F.lit("nowhere"))).otherwise(F.array("node"))
    programs = F.when(m == 9, F.array().cast("array<string>")).when(m == 10, F.array(F.lit("zz"))).otherwise(leaves)
    rows = s.select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source"),
        F.when(m == 1, "wav").when(m == 9, "sf2").otherwise("sfz").alias("kind"),
        F.when(m == 2, "??").when(m == 3, "CC-NC").otherwise("CC0").alias("license"),
        F.lit(True).alias("commercial_clean"), leaves.alias("leaves"), programs.alias("programs"),
        F.when(m != 5, "p").alias("path"), F.when(m == 6, "zz").otherwise(F.lit(None).cast("string")).alias("label_as"),
        F.when(m == 7, 0.0).otherwise(1.0).alias("weight"), F.when(m == 8, "odd").alias("status"))
    licences = small_table(t.spark, [("CC0", True), ("CC-NC", False)], "license string, commercial boolean")
    nodes = t.place_nodes()
    leaf = nodes.where("is_leaf")
    return R.registry_errors(rows, leaf, licences, T.closure(nodes), leaf.select(F.col("node").alias("leaf")))


# ---- runs
@query("predictions_round_trip", f"""SELECT node, n_observed, n_positive, round(ap, 6) AS ap FROM ({ap_sql(FLAT_OBS)}) a""")
def predictions_round_trip(t):
    """Predictions written, read back and scored."""
    obs = t.flat_obs()
    folder = work_folder(t.spark, "predictions")
    R.write_predictions(obs.select(F.col("item").cast("string").alias("item"), "node", "score"), folder,
                        {"taxonomy_version": "1.0.0"})
    back = R.read_written_predictions(t.spark, folder).withColumn("item", F.col("item").cast("long"))
    scored = obs.select("item", "node", "y").join(back, ["item", "node"])
    return M.average_precision(scored).drop("skipped").withColumn("ap", r6("ap"))


@query("predictions_from_json", """SELECT doc_id AS item, 'quality' AS node, CAST((n_chars % 1000) / 1000.0 AS DOUBLE) AS score
    FROM documents UNION ALL SELECT doc_id, 'toxic', CAST(1 - (n_chars % 1000) / 1000.0 AS DOUBLE) FROM documents""")
def predictions_from_json(t):
    s = F.col("score")
    docs = t.flat_items().groupBy("grp").agg(F.collect_list(F.struct(
        F.col("item").cast("string").alias("item_id"), F.array(s, F.round(1 - s, 3)).alias("scores"))).alias("items"))
    doc = docs.select(F.lit("1.0.0").alias("taxonomy_version"), F.array(F.lit("quality"), F.lit("toxic")).alias("nodes"),
                      "items")
    folder = work_folder(t.spark, "json")
    doc.repartition("items").write.option("maxRecordsPerFile", 1).json(folder)
    return R.read_predictions(t.spark, folder).withColumn("item", F.col("item").cast("long"))


@query("prediction_errors", """SELECT doc_id AS item, CASE WHEN doc_id % 7 = 0 THEN 'other' ELSE 'quality' END AS node,
    e.error FROM documents JOIN (VALUES (1, 'duplicate'), (2, 'missing score'), (3, 'unknown node')) e(k, error)
    ON (k = 1 AND doc_id % 11 = 0) OR (k = 2 AND n_chars % 13 = 0) OR (k = 3 AND doc_id % 7 = 0)
  UNION ALL SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'other' ELSE 'quality' END, e.error FROM documents
    JOIN (VALUES (2, 'missing score'), (3, 'unknown node')) e(k, error) ON doc_id % 11 = 0
    AND ((k = 2 AND n_chars % 13 = 0) OR (k = 3 AND doc_id % 7 = 0))""")
def prediction_errors(t):
    k = F.col("doc_id")
    s = t.read("documents").select(
        k.alias("item"), F.when(k % 7 == 0, "other").otherwise("quality").alias("node"),
        F.when(F.col("n_chars") % 13 != 0, F.col("n_chars") / 1e6).alias("score"))
    nodes = small_table(t.spark, [("quality",), ("toxic",)], "node string")
    return R.prediction_errors(s.unionByName(s.where("item % 11 = 0")), nodes)


@query("newest_archived_runs", """SELECT * FROM (SELECT '20240102T000000Z_a' AS folder, 'n_' || lang AS metric,
    CAST(count(*) AS DOUBLE) AS value FROM documents GROUP BY lang
  UNION ALL SELECT '20240101T000000Z_b', 'n_' || lang, CAST(max(n_chars) AS DOUBLE) FROM documents GROUP BY lang) r""")
def newest_archived_runs(t):
    """Three archived runs of two names; a re-run supersedes the older one."""
    docs = t.read("documents")
    name = F.concat(F.lit("n_"), "lang").alias("metric")
    counts = docs.groupBy(name).agg(F.count(F.lit(1)).cast("double").alias("value"))
    sizes = docs.groupBy(name).agg(F.max("n_chars").cast("double").alias("value"))
    root = work_folder(t.spark, "runs")
    obs = docs.select("doc_id", "lang")
    R.archive_run(obs, sizes, root, "20240101T000000Z", "a")
    R.archive_run(obs, counts, root, "20240102T000000Z", "a")
    R.archive_run(obs, sizes, root, "20240101T000000Z", "b")
    return R.read_run_metrics(t.spark, root)


@query("split_pin_check", """SELECT CAST(doc_id AS VARCHAR) AS item, CASE WHEN doc_id % 5 = 0 THEN 'unpinned'
    ELSE 'pinned but absent' END AS error FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0""")
def split_pin_check(t):
    docs = t.read("documents").select(F.col("doc_id").cast("string").alias("item"), "doc_id")
    folder = work_folder(t.spark, "pin")
    R.write_split_pin(docs.where("doc_id % 5 <> 0").withColumn("split", F.lit("train")), folder)
    present = docs.where("doc_id % 5 = 0 or doc_id % 7 <> 0")
    return R.split_pin_errors(present, R.read_split_pin(t.spark, folder))


@query("resumable_vector_cache", """SELECT CAST(vec_id AS VARCHAR) AS item, round(embedding[1]::DOUBLE, 5) AS first_value,
    vec_id AS pos FROM embeddings""")
def resumable_vector_cache(t):
    """A cache filled in two steps; the second computes only what is missing."""
    e = t.read("embeddings").select(F.col("vec_id").cast("string").alias("item"), "vec_id", "embedding")
    folder = work_folder(t.spark, "cache")

    def embed(todo):
        return todo.join(e, "item").select("item", F.lit(0).alias("layer"), F.col("embedding").alias("vec"))

    R.extend_cache(e.where("vec_id % 3 = 0"), folder, embed)
    cache = R.extend_cache(e, folder, embed)
    aligned = R.align_vectors(e.select("item", F.col("vec_id").alias("pos")), cache)
    return aligned.select("item", "pos", F.round(F.col("vec")[0].cast("double"), 5).alias("first_value"))


@query("strict_mapping", f"""SELECT o.label, count(*) AS n FROM ({ORDER_TYPES}) o WHERE label <> 'SMALL' GROUP BY 1""")
def strict_mapping(t):
    """Labels under strict mapping (the unmapped type is left out first, else the query would fail)."""
    effects = L.rule_effects(t.type_rules(), t.place_nodes())
    return L.require_mapped(t.order_types().where("label <> 'SMALL'"), effects).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"))


@query("uploaded_file_hashes")
def uploaded_file_hashes(t):
    """Content hashes of the table files themselves (binary source, rows only)."""
    return R.upload_files(t.spark, f"{t.folder}/*.parquet").groupBy("content_hash").agg(
        F.count(F.lit(1)).alias("copies"), F.max("bytes").alias("bytes"))


@query("label_hash_of_orders", """SELECT 1 AS ok FROM region WHERE r_regionkey = 0""")
def label_hash_of_orders(t):
    """The order-free label hash does not depend on how the labels are partitioned."""
    from labelgrove.operators.audit import table_hash
    labels = order_labels(t)
    a = table_hash(labels, "item", "node", "y").select("hash", "n")
    b = table_hash(labels.repartition(5, "node"), "item", "node", "y").select("hash", "n")
    return a.intersect(b).select(F.lit(1).alias("ok"))


@query("licence_by_sample", """SELECT 'k' || doc_id AS sample_key, CASE doc_id % 3 WHEN 0 THEN 'CC BY, 4.0' WHEN 1 THEN 'CC BY-NC' END AS license_title
  FROM documents""")
def licence_by_sample(t):
    """The licence column of a metadata file, keyed by sample."""
    folder = work_folder(t.spark, "licences")
    title = F.when(F.col("doc_id") % 3 == 0, "CC BY, 4.0").when(F.col("doc_id") % 3 == 1, "CC BY-NC")
    t.read("documents").select(
        F.col("doc_id").alias("track_id"), (F.col("doc_id") % 9).alias("artist_id"), F.lit("a, b").alias("artist_name"),
        title.alias("license_title"), F.concat(F.lit("k"), "doc_id").alias("sample_key"), F.lit(0.5).alias("start_time")).write.csv(
        f"{folder}/meta", header=True)
    return D.licences(t.spark, f"{folder}/meta")


@query("rule_file_hashes", """SELECT sha256(r_name || chr(10)) AS sha256, '2.' || r_regionkey AS rules_version FROM region""")
def rule_file_hashes(t):
    """Hashes of rule files, one per region, whose version must have the taxonomy's major part."""
    folder = work_folder(t.spark, "rules")
    t.read("region").select("r_regionkey", "r_name").write.partitionBy("r_regionkey").text(f"{folder}/rules")
    files = TF.file_hashes(t.spark, f"{folder}/rules/*/*.txt")
    key = F.regexp_extract("path", "r_regionkey=([0-9]+)", 1)
    return files.select("sha256", TF.require_same_major(F.concat(F.lit("2."), key), F.lit("2.7")).alias("rules_version"))
