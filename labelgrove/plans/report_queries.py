"""Report derivation on event streams: users are songs, event types are labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelgrove.operators import report as R
from labelgrove.operators.scan import row_numbers, time_chunk
from labelgrove.plans.catalog import query
from labelgrove.plans.metric_queries import r6
from labelgrove.plans.standins import PLACES
from labelgrove.sources.literal import small_table

FRAMES = """SELECT user_id AS song, event_type AS label, event_id, ts, CAST(row_number() OVER (
    PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS BIGINT) AS frame,
    least(value / 100, 1.0::DOUBLE) AS p FROM events"""


def frames(t):
    e = t.events().select(F.col("user_id").alias("song"), F.col("event_type").alias("label"),
                          "event_id", "ts", F.least(F.col("value") / 100, F.lit(1.0)).alias("p"),
                          time_chunk("ts").alias("day"))
    rows = row_numbers(e, ["song", "label"], "day", [F.col("ts"), F.col("event_id")])
    return rows.withColumn("frame", F.col("rn") - 1)


INTERVALS = f"""WITH f AS ({FRAMES}),
  m AS (SELECT *, CASE WHEN p >= 0.6 THEN 1 WHEN p < 0.42 THEN 0 END AS mark FROM f),
  s AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY song, label ORDER BY frame
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS st FROM m),
  c AS (SELECT *, coalesce(lag(st) OVER (PARTITION BY song, label ORDER BY frame), 0) AS prev,
    max(frame) OVER (PARTITION BY song, label) + 1 AS n FROM s),
  e AS (SELECT *, lead(frame) OVER (PARTITION BY song, label ORDER BY frame) AS nxt FROM c
    WHERE st <> prev)
  SELECT song, label, CAST(frame AS DOUBLE) AS start_s, CAST(coalesce(nxt, n) AS DOUBLE) AS end_s
  FROM e WHERE st = 1"""


@query("hysteresis_intervals", INTERVALS)
def hysteresis_intervals(t):
    return R.hysteresis_intervals(frames(t), ["song", "label"], 0.6, 0.42)


CONF = f"SELECT song, label, quantile_cont(p, 0.95) AS confidence FROM ({FRAMES}) f GROUP BY 1, 2"


@query("song_confidence", f"SELECT song, label, round(confidence, 6) AS confidence FROM ({CONF}) c")
def song_confidence(t):
    return R.song_confidence(frames(t), ["song", "label"]).withColumn("confidence", r6("confidence"))


@query("label_scores", """SELECT user_id AS song, label, event_id % 50 AS frame,
    max(least(value / 100, 1.0::DOUBLE)) AS p FROM events JOIN (VALUES ('click', 'touch'),
      ('view', 'touch'), ('purchase', 'money'), ('signup', 'money')) m(cls, label) ON event_type = cls
  GROUP BY 1, 2, 3""")
def label_scores(t):
    classes = small_table(t.spark, [("click", "touch"), ("view", "touch"), ("purchase", "money"),
                                    ("signup", "money")], "cls string, label string")
    f = t.read("events").select(
        F.col("user_id").alias("song"), F.lit("mix").alias("stem"), F.col("event_type").alias("cls"),
        (F.col("event_id") % 50).alias("frame"), F.least(F.col("value") / 100, F.lit(1.0)).alias("p"))
    return R.label_scores(f, classes).drop("stem")


MIX = """SELECT user_id AS song, event_type AS label, floor(max(least(value / 100, 1.0::DOUBLE)) * 1000)
    / 1000 AS confidence FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2"""
STEMS = """SELECT user_id AS song, CASE event_id % 3 WHEN 0 THEN 'vocals' WHEN 1 THEN 'drums'
    ELSE 'bass' END AS stem, event_type AS label, floor(max(least(value / 100, 1.0::DOUBLE)) * 1000)
    / 1000 AS confidence FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2, 3"""
ROLES = "(VALUES ('vocals', 'click'), ('drums', 'view'), ('drums', 'error'), ('bass', 'purchase')) r(stem, label)"
COMBINED = f"""WITH mix AS (SELECT * FROM ({MIX}) m WHERE confidence >= 0.3),
  v AS (SELECT s.* FROM ({STEMS}) s JOIN {ROLES} ON s.stem = r.stem AND s.label = r.label
    WHERE s.confidence >= 0.3 AND (s.label <> 'click' OR EXISTS (SELECT 1 FROM mix m
      WHERE m.song = s.song AND m.label = 'click'))),
  u AS (SELECT song, label, confidence, 'mix' AS stem FROM mix UNION ALL
    SELECT song, label, confidence, stem FROM v)
  SELECT song, label, confidence, stem FROM (SELECT *, row_number() OVER (PARTITION BY song, label
    ORDER BY confidence DESC, stem = 'mix' DESC, stem DESC) AS rn FROM u) r WHERE rn = 1"""


def tags(t):
    e = t.read("events").select("event_id", F.col("user_id").alias("song"),
                                F.col("event_type").alias("label"),
                                F.least(F.col("value") / 100, F.lit(1.0)).alias("p"))
    conf = (F.floor(F.max("p") * 1000) / 1000).alias("confidence")
    m = F.col("event_id") % 3
    stem = F.when(m == 0, "vocals").when(m == 1, "drums").otherwise("bass").alias("stem")
    mix = e.where("event_id % 2 = 0").groupBy("song", "label").agg(conf)
    stems = e.where("event_id % 2 = 1").groupBy("song", stem, "label").agg(conf)
    return R.shown(mix), R.shown(stems)


def combined(t):
    roles = small_table(t.spark, [("vocals", "click"), ("drums", "view"), ("drums", "error"),
                                  ("bass", "purchase")], "stem string, label string")
    return R.combine(*tags(t), roles, needs_mix=("click",))


@query("combine_mix_and_stems", COMBINED)
def combine_mix_and_stems(t):
    return combined(t)


P95 = f"""SELECT song, node, max(s) AS score FROM (SELECT user_id AS song, node,
    floor(max(least(value / 100, 1.0::DOUBLE)) * 1000) / 1000 AS s
    FROM events JOIN ({PLACES}) p ON event_id % 25 = n_nationkey GROUP BY 1, 2) q GROUP BY 1, 2
  UNION ALL SELECT user_id, split_part(node, '.', 1), floor(max(least(value / 100, 1.0::DOUBLE)) * 1000)
    / 1000 FROM events JOIN ({PLACES}) p ON event_id % 25 = n_nationkey GROUP BY 1, 2"""
LABEL_NODES = """(VALUES ('click', 'asia'), ('view', 'europe'), ('purchase', 'africa'),
  ('signup', 'america')) ln(label, node)"""
SUBTYPES = """(VALUES ('click', 'asia.nation_2'), ('click', 'asia.nation_7'),
  ('click', 'asia.nation_12'), ('view', 'europe.nation_3'), ('view', 'europe.nation_8'),
  ('view', 'europe.nation_13'), ('view', 'europe.nation_18'), ('view', 'europe.nation_23'))
  st(label, node)"""
ROUTED = f"""WITH present AS ({COMBINED}), p95 AS ({P95}),
  top AS (SELECT song, split_part(node, '.', 1) AS parent, arg_max(node, (score, node)) AS best,
    max(score) AS s1, count(*) AS k, list_sort(list(score), 'DESC')[2] AS s2
    FROM p95 WHERE contains(node, '.') GROUP BY 1, 2),
  rows_ AS (SELECT song, label, confidence, stem, false AS calibrated, 'incumbent' AS model FROM present
      WHERE label <> 'signup'
    UNION ALL SELECT song, 'signup', score, 'mix', true, 'own' FROM p95
      WHERE node = 'america' AND score >= 0.3),
  r AS (SELECT rows_.*, ln.node AS root,
      coalesce(ln.label IN (SELECT label FROM {SUBTYPES}), false) AS listed
    FROM rows_ LEFT JOIN {LABEL_NODES} ON ln.label = rows_.label),
  w AS (SELECT r.*, CASE WHEN listed AND k >= 2 AND s1 >= 0.3 AND s1 - s2 >= 0.05
      AND EXISTS (SELECT 1 FROM {SUBTYPES} WHERE st.label = r.label AND st.node = best)
      THEN best END AS target, s1 FROM r LEFT JOIN top ON top.song = r.song AND top.parent = r.root),
  x AS (SELECT *, target IS NOT NULL AND least(s1, confidence) >= 0.3 AS moved FROM w)
  SELECT song, CASE WHEN moved THEN target WHEN listed THEN label || ' (subtype uncertain)'
      ELSE label END AS label, CASE WHEN moved THEN target ELSE root END AS node,
    CASE WHEN moved THEN least(s1, confidence) ELSE confidence END AS confidence,
    CASE WHEN moved THEN 'mix' ELSE stem END AS stem,
    CASE WHEN moved THEN false ELSE calibrated END AS calibrated,
    CASE WHEN moved THEN 'own' ELSE model END AS model, moved AS subtype,
    listed AND NOT moved AS subtype_uncertain FROM x"""


def p95(t):
    e = (t.read("events").join(t.places(), F.col("event_id") % 25 == F.col("n_nationkey"))
         .select(F.col("user_id").alias("song"), "node",
                 F.least(F.col("value") / 100, F.lit(1.0)).alias("p")))
    up = F.explode(F.array("node", F.substring_index("node", ".", 1))).alias("node")
    return e.select("song", up, "p").groupBy("song", "node").agg(
        (F.floor(F.max("p") * 1000) / 1000).alias("score"))


def routed(t):
    label_nodes = small_table(t.spark, [("click", "asia"), ("view", "europe"), ("purchase", "africa"),
                                        ("signup", "america")], "label string, node string")
    subtypes = small_table(t.spark, [("click", f"asia.nation_{k}") for k in (2, 7, 12)]
                           + [("view", f"europe.nation_{k}") for k in (3, 8, 13, 18, 23)],
                           "label string, node string")
    owned = small_table(t.spark, [("signup",)], "label string")
    present = combined(t).withColumn("calibrated", F.lit(None).cast("boolean"))
    return R.route(present, p95(t), owned, label_nodes, subtypes, margin=0.05)


@query("subtype_routing", ROUTED)
def subtype_routing(t):
    return routed(t)


KEY = f"""SELECT user_id AS item, u.node, bool_or(event_id % 2 = 0) AS y FROM (
    SELECT user_id, event_id, node FROM events JOIN ({PLACES}) p ON (event_id * 7 + user_id) % 25
      = n_nationkey WHERE event_id % 5 <> 0) k,
  LATERAL (SELECT unnest([split_part(k.node, '.', 1), k.node]) AS node) u GROUP BY 1, 2"""
SCORED = f"""SELECT r.song, r.label, r.node, r.confidence, r.subtype,
    CASE WHEN r.subtype OR NOT r.calibrated OR r.confidence < 0.6 THEN 'uncertain' ELSE 'confident'
      END AS shown_as, split_part(r.node, '.', 1) AS family,
    CASE WHEN r.node IS NULL THEN 'unmapped' WHEN k.y THEN 'hit' WHEN NOT k.y THEN 'false_alarm'
      ELSE 'unlabelled' END AS outcome
  FROM ({ROUTED}) r LEFT JOIN ({KEY}) k ON k.item = r.song AND k.node = r.node"""


def answer_key(t):
    place = (F.col("event_id") * 7 + F.col("user_id")) % 25 == F.col("n_nationkey")
    e = t.read("events").where("event_id % 5 <> 0").select("event_id", "user_id")
    up = F.explode(F.array("node", F.substring_index("node", ".", 1))).alias("node")
    return (e.join(t.places(), place)
            .select(F.col("user_id").alias("item"), up, (F.col("event_id") % 2 == 0).alias("y"))
            .groupBy("item", "node").agg(F.bool_or("y").alias("y")))


@query("report_vs_answer_key", SCORED)
def report_vs_answer_key(t):
    return R.score_entries(routed(t), answer_key(t), t.place_nodes())


@query("node_outcomes", f"""WITH s AS ({SCORED}), songs AS (SELECT DISTINCT user_id AS song FROM events),
    n AS (SELECT DISTINCT split_part(node, '.', 1) AS node FROM ({PLACES}) p),
    g AS (SELECT song, split_part(node, '.', 1) AS node, bool_or(shown_as = 'confident') AS sure
      FROM s WHERE node IS NOT NULL GROUP BY 1, 2)
  SELECT songs.song, n.node, CASE WHEN k.y THEN 'present' WHEN NOT k.y THEN 'absent' ELSE 'unknown' END
    AS truth, g.song IS NOT NULL AS shown, coalesce(sure, false) AS shown_confident
  FROM songs CROSS JOIN n LEFT JOIN ({KEY}) k ON k.item = songs.song AND k.node = n.node
  LEFT JOIN g ON g.song = songs.song AND g.node = n.node""")
def node_outcomes(t):
    key = answer_key(t)
    scored = R.score_entries(routed(t), key, t.place_nodes())
    songs = t.read("events").select(F.col("user_id").alias("song")).distinct()
    return R.node_outcomes(scored, key, t.place_nodes().where("level = 1"), songs)


@query("subtype_agreement", f"""SELECT CASE outcome WHEN 'hit' THEN 'agree'
    WHEN 'false_alarm' THEN 'disagree' ELSE 'unlabelled' END AS agreement, count(*) AS n
  FROM ({SCORED}) s WHERE subtype GROUP BY 1""")
def subtype_agreement(t):
    scored = R.score_entries(routed(t), answer_key(t), t.place_nodes())
    return R.subtype_agreement(scored).groupBy("agreement").agg(F.count(F.lit(1)).alias("n"))


@query("song_reports", f"""WITH c AS ({COMBINED}), i AS ({INTERVALS}),
    a AS (SELECT song, count(*) AS n_labels FROM c GROUP BY 1),
    b AS (SELECT song, count(*) AS n_intervals FROM i WHERE label <> 'error' GROUP BY 1)
  SELECT s.song, coalesce(n_labels, 0) AS n_labels, coalesce(n_intervals, 0) AS n_intervals,
    CASE WHEN n_labels IS NULL THEN 'missing' ELSE 'ok' END AS instruments_status
  FROM (SELECT DISTINCT user_id AS song FROM events) s LEFT JOIN a ON a.song = s.song
  LEFT JOIN b ON b.song = s.song""")
def song_reports(t):
    """JSON reports assembled from sections, read back through JSON paths."""
    songs = t.read("events").select(F.col("user_id").alias("song"))
    lanes = R.hysteresis_intervals(frames(t), ["song", "label"], 0.6, 0.42).where("label <> 'error'")
    doc = R.assemble(songs, {"instruments": combined(t), "activations": lanes})
    v = doc.withColumn("r", F.from_json(
        "report", "schema_version int, status struct<instruments: string>, "
                  "instruments array<struct<label: string>>, activations array<struct<label: string>>"))
    return v.select("song", F.coalesce(F.size("r.instruments"), F.lit(0)).cast("long").alias("n_labels"),
                    F.coalesce(F.size("r.activations"), F.lit(0)).cast("long").alias("n_intervals"),
                    F.col("r.status.instruments").alias("instruments_status"))


@query("instruments_by_confidence", """SELECT user_id AS song, string_agg(event_type, ',' ORDER BY v DESC, event_type) AS labels, max(v) AS best
  FROM (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY 1, 2) e GROUP BY 1""")
def instruments_by_confidence(t):
    """Each song's instruments, the surest first."""
    rows = t.events().groupBy(F.col("user_id").alias("song"), F.col("event_type").alias("label")).agg(F.max("value").alias("confidence"))
    return R.by_confidence(rows).select("song", F.array_join("instruments.label", ",").alias("labels"),
                                        F.col("instruments")[0]["confidence"].alias("best"))
