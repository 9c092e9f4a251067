"""Clip planning on event streams: users are files, events are notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelgrove.functions import gm
from labelgrove.functions.hashing import hash_uniform
from labelgrove.operators import clips as C
from labelgrove.operators import taxonomy as T
from labelgrove.plans.catalog import query
from labelgrove.plans.metric_queries import r6
from labelgrove.plans.standins import PLACE_NODES, PLACES
from labelgrove.session import cut_lineage

DAY, HOP = 86400.0, 43200.0
BASE = 1704067200
NOTES = f"""SELECT user_id AS midi_id, CAST(event_id % 3 AS INT) AS track, CAST((event_id % 3) * 31
    + user_id % 9 AS INT) AS program, event_id % 3 = 2 AS is_drum, CAST(35 + event_id % 48 AS INT) AS pitch,
    floor(epoch_us(ts) / 1e6) - {BASE} AS start_s,
    floor(epoch_us(ts) / 1e6) - {BASE} + 600 + floor(value) * 600 AS end_s,
    CAST(1 + floor(value) % 127 AS INT) AS velocity FROM events"""


def notes(t):
    start = F.floor(F.unix_micros("ts") / 1e6).cast("double") - F.lit(float(BASE))
    track = (F.col("event_id") % 3).cast("int")
    return t.events().select(
        F.col("user_id").alias("midi_id"), track.alias("track"),
        (track * 31 + F.col("user_id") % 9).cast("int").alias("program"), (track == 2).alias("is_drum"),
        (35 + F.col("event_id") % 48).cast("int").alias("pitch"), start.alias("start_s"),
        (start + 600 + F.floor("value") * 600).alias("end_s"),
        (1 + F.floor("value") % 127).cast("int").alias("velocity"))


ROLE_SQL = "CASE WHEN NOT is_drum THEN CASE " + " ".join(
    f"WHEN program BETWEEN {lo} AND {hi} THEN '{r}'" for lo, hi, r in gm.PROGRAM_ROLES) + " END ELSE CASE " + (
    f"WHEN pitch IN {gm.KIT_NOTES} THEN 'drums' ") + " ".join(
    f"WHEN pitch IN ({', '.join(map(str, ns))}) THEN '{r}'" for r, ns in gm.PERCUSSION_NOTES.items()) + " END END"
ROLES = f"SELECT *, {ROLE_SQL} AS role FROM ({NOTES}) n WHERE ({ROLE_SQL}) IS NOT NULL"


@query("note_roles", f"SELECT role, count(*) AS n FROM ({ROLES}) r GROUP BY 1")
def note_roles(t):
    return C.with_role(notes(t)).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


WINDOWED = f"""WITH r AS ({ROLES}), e AS (SELECT midi_id, max(end_s) AS fe FROM ({NOTES}) n GROUP BY 1),
  w AS (SELECT midi_id, unnest(range(0, CAST(floor((fe - {DAY}) / {HOP}) AS BIGINT) + 1)) AS w FROM e
    WHERE fe >= {DAY}),
  o AS (SELECT r.*, w.w, greatest(0, start_s - w.w * {HOP}) AS start_in,
      least({DAY}, end_s - w.w * {HOP}) AS end_in FROM r JOIN w ON w.midi_id = r.midi_id
    AND r.end_s > w.w * {HOP} AND r.start_s < w.w * {HOP} + {DAY}),
  p AS (SELECT midi_id, w, track, role, count(*) AS n_notes, sum(end_in - start_in) AS sounding_s,
      bool_or(is_drum AND pitch IN {gm.CYMBAL_NOTES}) AS cymbals, min(program) AS program,
      bool_or(is_drum) AS is_drum
    FROM o WHERE end_in - start_in > 0.01 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3)"""


def parts(t):
    # the file end is that of all notes, so windows are cut before roles are dropped
    return C.window_parts(C.with_role(C.window_notes(notes(t), DAY, HOP)), 3)


@query("note_windows", f"""{WINDOWED} SELECT midi_id, w, track, role, n_notes,
    round(sounding_s, 3) AS sounding_s, cymbals FROM p""")
def note_windows(t):
    return parts(t).select("midi_id", "w", "track", "role", "n_notes",
                           F.round("sounding_s", 3).alias("sounding_s"), "cymbals")


@query("max_polyphony", f"""WITH e AS (SELECT midi_id, track, start_s AS t, 1 AS d FROM ({NOTES}) n
    UNION ALL SELECT midi_id, track, end_s, -1 FROM ({NOTES}) n)
  SELECT midi_id, track, max(s) AS polyphony FROM (SELECT midi_id, track, CAST(sum(d) OVER (
    PARTITION BY midi_id, track ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM e) q
  GROUP BY 1, 2""")
def max_polyphony(t):
    return C.max_polyphony(notes(t), ["midi_id", "track"], "start_s", "end_s", DAY)


LEAVES = tuple(x for r in ("keys_piano", "guitar", "bass", "strings_solo", "strings_section", "brass",
                           "reed", "drums", "perc_claps", "perc_hand_drums", "organ")
               for x in gm.ROLE_LEAVES[r])


def assigned(t):
    w = C.with_role(C.window_notes(notes(t), DAY, HOP))
    keys = ["midi_id", "w", "track", "role"]
    poly = C.max_polyphony(w, keys, "start_in", "end_in", HOP)
    p = cut_lineage(C.window_parts(w, 3).join(poly, keys))
    p = p.join(C.sample_windows(p, seed=4), ["midi_id", "w"], "left_semi")
    pools, hints = C.leaf_pools(t.spark, list(LEAVES))
    return C.assign_leaves(p, pools, hints, seed=4)


CHOSEN = """ch AS (SELECT midi_id, w FROM (SELECT DISTINCT midi_id, w FROM p)
    QUALIFY row_number() OVER (PARTITION BY midi_id ORDER BY sha256('4:' || midi_id || ':' || w), w) <= 2)"""


@query("sampled_windows", f"{WINDOWED}, {CHOSEN} SELECT midi_id, w FROM ch")
def sampled_windows(t):
    return C.sample_windows(parts(t), seed=4)


def sql_list(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]" if xs else "[]::VARCHAR[]"


POOL_SQL = "CASE role " + " ".join(
    f"WHEN '{r}' THEN CASE WHEN polyphony > 2 THEN {sql_list([x for x in ls if x in LEAVES and x not in gm.SOLO_LEAVES])}"
    f" ELSE {sql_list([x for x in ls if x in LEAVES])} END" for r, ls in gm.ROLE_LEAVES.items()) + " END"
HINT_SQL = "CASE program " + " ".join(
    f"WHEN {p} THEN {sql_list([x for x in ls if x in LEAVES])}" for p, ls in gm.PROGRAM_LEAVES.items()
) + " ELSE []::VARCHAR[] END"
IDENT = "midi_id || ':' || w || ':' || track || ':' || role"
ASSIGNED = f"""{WINDOWED}, {CHOSEN},
  ed AS (SELECT midi_id, w, track, role, start_in AS t, 1 AS d FROM o WHERE end_in - start_in > 0.01
    UNION ALL SELECT midi_id, w, track, role, end_in, -1 FROM o WHERE end_in - start_in > 0.01),
  po AS (SELECT midi_id, w, track, role, max(s) AS polyphony FROM (SELECT midi_id, w, track, role,
    sum(d) OVER (PARTITION BY midi_id, w, track, role ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS s
    FROM ed) q GROUP BY 1, 2, 3, 4),
  a AS (SELECT p.*, polyphony, {POOL_SQL} AS cands, {HINT_SQL} AS hint0 FROM p JOIN ch USING (midi_id, w)
    JOIN po USING (midi_id, w, track, role)),
  b AS (SELECT *, list_filter(hint0, lambda x: list_contains(cands, x)) AS hint FROM a),
  c AS (SELECT *, CASE WHEN NOT is_drum AND len(hint) > 0 AND
      ('0x' || substr(md5('4:hint:' || {IDENT}), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.7
      THEN hint ELSE cands END AS choice FROM b),
  d AS (SELECT *, array_to_string(choice, '|') AS pool_key, row_number() OVER (
      PARTITION BY array_to_string(choice, '|') ORDER BY md5('4:' || {IDENT}), midi_id, w, track, role)
      AS turn FROM c WHERE len(choice) > 0),
  asg AS (SELECT *, choice[CAST((turn - 1) % len(choice) AS INT) + 1] AS leaf FROM d)"""


@query("balanced_leaf_assignment", f"""{ASSIGNED} SELECT midi_id, w, track, role, pool_key, leaf,
    CAST(polyphony AS BIGINT) AS polyphony FROM asg""")
def balanced_leaf_assignment(t):
    return assigned(t).select("midi_id", "w", "track", "role", "pool_key", "leaf", "polyphony")


LIMITED = f"""{ASSIGNED}, h AS (SELECT *, sha256('4:part:' || {IDENT}) AS hh FROM asg),
  one AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY midi_id, w, leaf ORDER BY hh) = 1),
  lim AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY midi_id, w ORDER BY hh) <= 2)"""


@query("parts_per_window", f"{LIMITED} SELECT midi_id, w, track, role, leaf FROM lim")
def parts_per_window(t):
    return C.limit_parts(assigned(t), 4, max_parts=2).select("midi_id", "w", "track", "role", "leaf")


CLIP_SEED = "('0x' || substr(md5('4:clip:' || midi_id || ':' || w), 1, 8))::BIGINT % 2147483648"


@query("clip_plan", f"""{WINDOWED}, {CHOSEN} SELECT midi_id, w, CAST(w * {HOP} AS DOUBLE) AS start_s, seed,
    substr(sha1(midi_id || ':' || w || ':' || seed), 1, 16) AS clip_id, seed % 1000 < 100 AS stems_saved
  FROM (SELECT *, {CLIP_SEED} AS seed FROM ch) s""")
def clip_plan(t):
    """Planned clips (the CRC split is checked in the unit tests; the oracle has no CRC)."""
    chosen = C.sample_windows(parts(t), seed=4)
    return C.plan_clips(chosen, 4, HOP).drop("split")


@query("leave_source_out_clips", f"""{WINDOWED}, {CHOSEN}, s AS (SELECT *, {CLIP_SEED} AS seed FROM ch)
  SELECT CASE WHEN midi_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
    substr(sha1(midi_id || ':' || w || ':' || seed), 1, 16) AS clip_id FROM s
  UNION ALL SELECT 'test_lso', substr(sha1(midi_id || ':' || w || ':' || seed || ':lso'), 1, 16) FROM s
    WHERE midi_id % 5 = 0""")
def leave_source_out_clips(t):
    plan = C.plan_clips(C.sample_windows(parts(t), seed=4), 4, HOP).withColumn(
        "split", F.when(F.col("midi_id") % 5 == 0, "test").otherwise("train"))
    return C.leave_source_out(plan).select("split", "clip_id")


@query("nearest_recorded_note", """WITH rec AS (SELECT DISTINCT l_suppkey % 20 AS instrument,
      CAST(36 + (l_partkey % 12) * 7 AS INT) AS pitch, CAST(l_quantity * 2 AS INT) AS velocity FROM lineitem
      WHERE l_quantity > 45),
    w AS (SELECT event_id, user_id % 20 AS instrument, CAST(event_id % 128 AS INT) AS pitch,
      CAST(1 + floor(value) % 127 AS INT) AS velocity FROM events),
    b AS (SELECT w.event_id, w.instrument, w.pitch, w.velocity, r.pitch AS have FROM w JOIN (SELECT DISTINCT
      instrument, pitch FROM rec) r ON r.instrument = w.instrument AND abs(r.pitch - w.pitch) <= 3
      QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(r.pitch - w.pitch), r.pitch) = 1),
    v AS (SELECT b.event_id, b.have, r.velocity AS have_velocity FROM b JOIN rec r
      ON r.instrument = b.instrument AND r.pitch = b.have QUALIFY row_number() OVER (PARTITION BY event_id
      ORDER BY abs(r.velocity - b.velocity), r.velocity) = 1)
  SELECT w.event_id, v.have, v.have_velocity FROM w LEFT JOIN v USING (event_id)""")
def nearest_recorded_note(t):
    rec = t.read("lineitem").where("l_quantity > 45").select(
        (F.col("l_suppkey") % 20).alias("instrument"),
        (36 + (F.col("l_partkey") % 12) * 7).cast("int").alias("pitch"),
        (F.col("l_quantity") * 2).cast("int").alias("velocity"))
    want = t.read("events").select("event_id", (F.col("user_id") % 20).alias("instrument"),
                                   (F.col("event_id") % 128).cast("int").alias("pitch"),
                                   (1 + F.floor("value") % 127).cast("int").alias("velocity"))
    return C.nearest_recording(want, rec).select("event_id", "have", "have_velocity")


@query("octave_fit", """WITH n AS (SELECT user_id AS grp, CAST(20 + (event_id * 7 + user_id) % 60 AS INT) AS pitch
      FROM events), r AS (SELECT DISTINCT user_id AS grp, 28 + user_id % 30 AS lo, 52 + user_id % 40 AS hi FROM events),
    c AS (SELECT grp, o, count(*) FILTER (WHERE pitch + 12 * o BETWEEN lo AND hi) AS c, count(*) AS n
      FROM n JOIN r USING (grp), range(-4, 5) x(o) GROUP BY 1, 2)
  SELECT grp, CAST(CASE WHEN bool_or(o = 0 AND c >= 0.8 * n) THEN 0 ELSE 12 * arg_max(o, (c, -abs(o), o)) END AS INT)
    AS shift FROM c GROUP BY grp""")
def octave_fit(t):
    e = t.read("events")
    n = e.select(F.col("user_id").alias("grp"),
                 (20 + (F.col("event_id") * 7 + F.col("user_id")) % 60).cast("int").alias("pitch"))
    ranges = e.select(F.col("user_id").alias("grp"), (28 + F.col("user_id") % 30).alias("lo"),
                      (52 + F.col("user_id") % 40).alias("hi")).distinct()
    return C.fit_octaves(n, ranges, ["grp"])


@query("pitch_mismatch_report", """SELECT l_suppkey AS instrument, count(*) AS files,
    count(*) FILTER (WHERE abs(est - named) <= 0.6) AS kept,
    count(*) FILTER (WHERE est IS NULL OR abs(est - named) > 0.6) AS pitch_mismatch,
    min(named) FILTER (WHERE abs(est - named) <= 0.6) AS lowest,
    max(named) FILTER (WHERE abs(est - named) <= 0.6) AS highest
  FROM (SELECT l_suppkey, CAST(l_partkey % 88 AS INT) AS named, CASE WHEN l_tax > 0
    THEN l_partkey % 88 + (l_quantity - 25) / 25.0 END AS est FROM lineitem) f GROUP BY 1""")
def pitch_mismatch_report(t):
    named = (F.col("l_partkey") % 88).cast("int")
    files = t.read("lineitem").select(
        F.col("l_suppkey").alias("instrument"), named.alias("named"),
        F.when(F.col("l_tax") > 0, named + (F.col("l_quantity") - 25) / 25).alias("estimate"))
    return C.pitch_report(files)


@query("velocity_slots")
def velocity_slots(t):
    """Order-dependent slot allocation (checked against brute force in the tests)."""
    takes = t.read("lineitem").select(
        F.col("l_suppkey").alias("instrument"), (F.col("l_partkey") % 12).cast("int").alias("pitch"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        (F.col("l_quantity") * 2).cast("int").alias("velocity"))
    return C.velocity_slots(takes)


# ---- sources: suppliers are instruments labelled with places
LABELS = f"""SELECT s_suppkey AS instrument, CASE WHEN s_suppkey % 11 = 0 THEN 'skip'
    WHEN s_suppkey % 4 = 0 THEN split_part(node, '.', 1) WHEN s_suppkey % 7 = 0 THEN node || '.deep'
    ELSE node END AS node FROM supplier JOIN ({PLACES}) p ON s_nationkey = n_nationkey"""
SERVED = f"""SELECT node AS leaf FROM ({PLACE_NODES}) n WHERE contains(node, '.') AND NOT starts_with(node, 'asia')"""
EXPANDED = f"""WITH l AS (SELECT * FROM ({LABELS}) x WHERE node <> 'skip'), s AS ({SERVED}),
  up AS (SELECT leaf, unnest([split_part(leaf, '.', 1), leaf]) AS node FROM s),
  mv AS (SELECT instrument, CASE WHEN node IN (SELECT node FROM up) THEN node
    WHEN contains(node, '.') THEN array_to_string(string_split(node, '.')[1:-2], '.') END AS node FROM l),
  sv AS (SELECT instrument, mv.node, leaf FROM mv JOIN up USING (node)),
  b AS (SELECT leaf, count(*) AS n FROM sv GROUP BY 1),
  p AS (SELECT instrument, node, count(*) AS k, max(n) AS mx, min(leaf) AS l1 FROM sv JOIN b USING (leaf) GROUP BY 1, 2),
  ex AS (SELECT 'set:' || sv.instrument AS source, sv.instrument, sv.leaf,
    CASE WHEN NOT (k = 1 AND l1 = sv.node) THEN sv.node END AS label_as, 2.0 / mx AS weight
    FROM sv JOIN p ON p.instrument = sv.instrument AND p.node = sv.node)"""


def labelled(t):
    k = F.col("s_suppkey")
    return t.read("supplier").join(t.places(), F.col("s_nationkey") == F.col("n_nationkey")).select(
        k.alias("instrument"), F.when(k % 11 == 0, "skip").when(k % 4 == 0, T.family_of("node"))
        .when(k % 7 == 0, F.concat("node", F.lit(".deep"))).otherwise(F.col("node")).alias("node"))


def served(t):
    return t.place_nodes().where("is_leaf and node not like 'asia%'").select("node")


def expanded(t):
    return C.expand_labels(labelled(t), served(t), "set", 2.0)


@query("expanded_sources", f"{EXPANDED} SELECT source, instrument, leaf, label_as, round(weight, 6) AS weight FROM ex")
def expanded_sources(t):
    return expanded(t).withColumn("weight", r6("weight"))


@query("unexpandable_labels", f"""{EXPANDED} SELECT instrument, node FROM l
  WHERE instrument NOT IN (SELECT instrument FROM sv)""")
def unexpandable_labels(t):
    return C.unexpandable(labelled(t), served(t))


SOURCES = f"""{EXPANDED}, src AS (SELECT source, leaf, label_as, CASE WHEN instrument % 9 = 1
    THEN 'fluidr3_gm' ELSE 'g' || (instrument % 40) END AS grp, instrument % 6 <> 5 AS present FROM ex),
  g AS (SELECT leaf, grp, bool_or(label_as IS NULL AND present) AS have, bool_or(label_as IS NULL) AS ever,
    count(*) FILTER (WHERE label_as IS NOT NULL) AS coarse FROM src GROUP BY 1, 2),
  gate AS (SELECT s.leaf, count(*) FILTER (WHERE have) AS n_instruments,
    count(*) FILTER (WHERE ever AND NOT have) AS n_pending, CAST(coalesce(sum(coarse), 0) AS BIGINT) AS n_coarse,
    count(*) FILTER (WHERE have) >= 2 AS trainable FROM s LEFT JOIN g ON g.leaf = s.leaf GROUP BY 1),
  us AS (SELECT src.* FROM src JOIN gate USING (leaf) WHERE label_as IS NULL AND present AND n_instruments >= 3),
  ho AS (SELECT DISTINCT us.source, us.leaf FROM us JOIN (SELECT leaf, min(grp) AS grp FROM us
    WHERE grp <> 'fluidr3_gm' GROUP BY 1) f ON f.leaf = us.leaf AND f.grp = us.grp)"""


def sources(t):
    i = F.col("instrument")
    return expanded(t).select(
        "source", "leaf", "label_as", F.when(i % 9 == 1, "fluidr3_gm").otherwise(
            F.concat(F.lit("g"), (i % 40).cast("string"))).alias("grp"), (i % 6 != 5).alias("present"))


def gated(t):
    return C.leaf_gate(sources(t), served(t).withColumnRenamed("node", "leaf"))


@query("leaf_gate", f"{SOURCES} SELECT * FROM gate")
def leaf_gate(t):
    return gated(t)


@query("holdout_pairs", f"{SOURCES} SELECT * FROM ho")
def holdout_pairs(t):
    return C.holdout_pairs(sources(t), gated(t))


@query("active_leaf_set", f"""{SOURCES} SELECT leaf FROM gate WHERE trainable
  UNION SELECT node FROM ({PLACE_NODES}) n WHERE starts_with(node, 'asia.')""")
def active_leaf_set(t):
    base = t.place_nodes().where("is_leaf and node like 'asia%'").select(F.col("node").alias("leaf"))
    return C.leaf_set(base, gated(t))


@query("unsafe_holdouts", f"""{SOURCES} SELECT gate.leaf, count(DISTINCT r.grp) AS n_train FROM gate
  LEFT JOIN (SELECT src.* FROM src WHERE label_as IS NULL AND present AND (source, leaf) NOT IN
    (SELECT source, leaf FROM ho)) r ON r.leaf = gate.leaf WHERE trainable GROUP BY 1
  HAVING count(DISTINCT r.grp) < 3""")
def unsafe_holdouts(t):
    """Holdout safety with a stricter limit than the holdout rule, so that some leaves fail."""
    return C.unsafe_holdouts(sources(t), gated(t), C.holdout_pairs(sources(t), gated(t)), 3)


U = "('0x' || substr(md5('6:' || event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query("weighted_source_choice", f"""{EXPANDED}, q AS (SELECT leaf, source, sum(w) OVER (PARTITION BY leaf ORDER BY source
      ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY leaf) AS total
      FROM (SELECT leaf, source, CAST(1 + instrument % 5 AS DOUBLE) AS w FROM ex) z),
    e AS (SELECT event_id, node AS leaf, {U} AS u FROM events JOIN ({PLACES}) p ON event_id % 25 = n_nationkey)
  SELECT e.event_id, e.leaf, arg_min(source, cum) AS source FROM e JOIN q ON q.leaf = e.leaf AND cum > u * total
  GROUP BY 1, 2""")
def weighted_source_choice(t):
    s = expanded(t).select("leaf", "source",
                           (1 + F.col("instrument") % 5).cast("double").alias("weight"))
    req = t.read("events").join(t.places(), F.col("event_id") % 25 == F.col("n_nationkey")).select(
        "event_id", F.col("node").alias("leaf"))
    return C.choose_source(req, s, hash_uniform(6, F.col("event_id")))


STEMS = f"""SELECT midi_id || ':' || w AS clip_id, leaf AS part_leaf, CASE WHEN (midi_id + w + track) % 7 = 0
    THEN split_part(leaf, '.', 1) END AS label_as, cymbals, (midi_id + track) % 3 <> 0 AS clean,
    'src' || (midi_id % 4) AS source FROM lim"""


def stems(t):
    lim = C.limit_parts(assigned(t), 4, max_parts=2)
    return lim.select(
        F.concat_ws(":", "midi_id", "w").alias("clip_id"), F.col("leaf").alias("part_leaf"),
        F.when((F.col("midi_id") + F.col("w") + F.col("track")) % 7 == 0,
               F.substring_index("leaf", ".", 1)).alias("label_as"), "cymbals",
        ((F.col("midi_id") + F.col("track")) % 3 != 0).alias("clean"),
        F.concat(F.lit("src"), (F.col("midi_id") % 4).cast("string")).alias("source"))


CLIP_LABELS = f"""{LIMITED}, st AS ({STEMS}), cl AS (SELECT clip_id, list_sort(list_distinct(list(coalesce(label_as, part_leaf))
    || CASE WHEN bool_or(cymbals AND starts_with(part_leaf, 'drums')) THEN ['cymbals'] ELSE [] END)) AS positive,
  list_sort(list_distinct(list(label_as) FILTER (WHERE label_as IS NOT NULL AND label_as <> part_leaf))) AS below,
  bool_and(clean) AS sources_clean, count(*) AS n_stems FROM st GROUP BY 1)"""


@query("clip_label_assembly", f"""{CLIP_LABELS} SELECT clip_id, array_to_string(positive, ',') AS positive,
    coalesce(array_to_string(below, ','), '') AS unknown_below, sources_clean, n_stems FROM cl""")
def clip_label_assembly(t):
    return C.clip_labels(stems(t)).withColumns({c: F.array_join(c, ",")
                                                for c in ("positive", "unknown_below")})


@query("build_manifest", f"""{CLIP_LABELS}, c2 AS (SELECT *, CASE WHEN n_stems > 1 THEN 'train' ELSE 'test' END AS split FROM cl)
  SELECT 'split' AS counter, split AS name, count(*) AS n FROM c2 GROUP BY 2
  UNION ALL SELECT 'leaf', x, count(*) FROM (SELECT unnest(positive) AS x FROM c2) u GROUP BY 2
  UNION ALL SELECT 'source', source, count(*) FROM st GROUP BY 2""")
def build_manifest(t):
    s = stems(t)
    c = C.clip_labels(s).withColumn("split", F.when(F.col("n_stems") > 1, "train").otherwise("test"))
    return C.build_manifest(c, s)


@query("merge_instrument_metadata", """SELECT doc_id AS key, CASE WHEN doc_id % 3 = 0 THEN lang || '*' ELSE lang END AS value
  FROM documents""")
def merge_instrument_metadata(t):
    docs = t.read("documents").select(F.col("doc_id").alias("key"), F.col("lang").alias("value"))
    newer = docs.where("key % 3 = 0").withColumn("value", F.concat("value", F.lit("*")))
    return C.merge_newer(docs, newer, "key")


@query("merge_hand_label_files", """SELECT doc_id % 97 AS key, arg_max(CASE WHEN doc_id % 5 = 0 THEN 'skip' ELSE lang END, doc_id)
    AS value, arg_max(CASE WHEN doc_id % 5 = 0 THEN 'skip' ELSE lang END, doc_id) <> 'skip' AS usable
  FROM documents GROUP BY 1""")
def merge_hand_label_files(t):
    rows = t.read("documents").select(
        (F.col("doc_id") % 97).alias("key"), F.col("doc_id").alias("file_no"),
        F.when(F.col("doc_id") % 5 == 0, "skip").otherwise(F.col("lang")).alias("value"))
    return C.merge_files(rows)
