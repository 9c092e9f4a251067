"""Scalar functions and array kernels over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelgrove.functions import arrays as A
from labelgrove.functions import scores as S
from labelgrove.functions import text as X
from labelgrove.operators import report as R
from labelgrove.operators.report import display_class
from labelgrove.plans.catalog import query
from labelgrove.plans.metric_queries import r6
from labelgrove.plans.report_queries import INTERVALS, frames
from labelgrove.sources.literal import small_table


NAMES = """SELECT p_partkey, p_name, CASE p_partkey % 3 WHEN 0 THEN '  ' || upper(p_name) || ' ' WHEN 1
    THEN replace(p_name, ' ', '   ') ELSE 'ﬁ' || p_name END AS raw FROM part"""


@query("normalized_names", f"""SELECT p_partkey, CASE WHEN n = 'red ring' THEN 'the ring' ELSE n END AS name,
    regexp_replace(CASE WHEN n = 'red ring' THEN 'the ring' ELSE n END, '[^a-z0-9]+', '', 'g') AS key
  FROM (SELECT p_partkey, trim(regexp_replace(replace(lower(raw), 'ﬁ', 'fi'), '\\s+', ' ', 'g')) AS n FROM ({NAMES}) x) y""")
def normalized_names(t):
    """NFKC, case folding, whitespace and aliases; only distinct names pass through Python."""
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "))).when(
        k == 1, F.replace("p_name", F.lit(" "), F.lit("   "))).otherwise(F.concat(F.lit("ﬁ"), "p_name"))
    aliases = small_table(t.spark, [("Red Ring", "The Ring")], "alias string, name string")
    rows = X.normalize_names(t.read("part").select("p_partkey", raw.alias("raw")), "raw", "name", aliases)
    return rows.select("p_partkey", "name", X.group_key(F.col("name")).alias("key"))


@query("instrument_keys", """SELECT p_partkey, regexp_replace(regexp_replace(lower(p_brand || ' (' || p_type || ')!'),
    '[^0-9a-z]+', '_', 'g'), '^_+|_+$', '', 'g') AS key,
    CASE WHEN p_size % 3 = 0 THEN true WHEN p_size % 3 = 1 THEN false END AS flag, len(l) AS n_list FROM (SELECT *,
    CASE WHEN p_size % 2 = 0 THEN ['a', p_type] ELSE [p_type] END AS l FROM part) p""")
def instrument_keys(t):
    m = F.col("p_size") % 3
    flag = F.when(m == 0, " Yes").when(m == 1, "no").otherwise("maybe")
    listed = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('["a", null, "'), "p_type", F.lit('"]'))
                    ).otherwise(F.col("p_type"))
    label = F.concat("p_brand", F.lit(" ("), "p_type", F.lit(")!"))
    return t.read("part").select("p_partkey", X.instrument_key(label).alias("key"),
                                 X.truth_value(flag).alias("flag"),
                                 F.size(X.as_list(listed)).cast("long").alias("n_list"))


NOTE_SQL = """12 * (o + 1) + CASE l WHEN 'C' THEN 0 WHEN 'D' THEN 2 WHEN 'E' THEN 4 WHEN 'F' THEN 5 WHEN 'G' THEN 7
  WHEN 'A' THEN 9 WHEN 'B' THEN 11 END + CASE a WHEN 'b' THEN -1 WHEN '#' THEN 1 ELSE 0 END"""
LETTERS = "CDEFGAB"
PARTS = """SELECT event_id, substr('CDEFGAB', CAST(event_id % 7 + 1 AS INT), 1) AS l,
    CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'b' ELSE '#' END AS a, CAST(event_id % 9 - 1 AS INT) AS o,
    CASE event_id % 5 WHEN 0 THEN 'pp' WHEN 1 THEN 'p' WHEN 2 THEN 'mf' WHEN 3 THEN 'f' ELSE 'ff' END AS d,
    event_id % 8 + 1 AS take FROM events"""
VEL = "CASE d WHEN 'pp' THEN 40 WHEN 'p' THEN 55 WHEN 'mf' THEN 80 WHEN 'f' THEN 100 ELSE 112 END"


def note_parts(t, letters=LETTERS):
    k = F.col("event_id")
    letter = F.substring(F.lit(letters), (k % 7 + 1).cast("int"), F.lit(1))
    acc = F.when(k % 3 == 0, "").when(k % 3 == 1, "b").otherwise("#")
    name = F.concat(letter, acc, (k % 9 - 1).cast("string"))
    dyn = F.element_at(F.array(*map(F.lit, ("pp", "p", "mf", "f", "ff"))), (k % 5 + 1).cast("int"))
    return t.read("events").select("event_id", name.alias("note"), dyn.alias("dyn"), (k % 8 + 1).alias("take"))


@query("file_name_tokens", f"""SELECT event_id, CAST({NOTE_SQL} AS INT) AS pitch, CAST({VEL} AS INT) AS velocity,
    CAST(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_pitches FROM ({PARTS}) p""")
def file_name_tokens(t):
    n = note_parts(t)
    stem = F.concat_ws(".", F.lit("Horn"), "dyn", F.when(F.col("event_id") % 2 == 0, F.concat("note", F.lit("B7")))
                       .otherwise(F.col("note")))
    s = X.parse_tokens(stem)
    return n.select("event_id", s["pitches"][0].alias("pitch"), s["velocity"].alias("velocity"),
                    F.size(s["pitches"]).cast("long").alias("n_pitches"))


@query("layered_file_names", f"""SELECT event_id, CAST({NOTE_SQL} AS INT) AS pitch,
    CAST(CASE event_id % 3 WHEN 0 THEN {VEL} WHEN 1 THEN 30 + 22 * take ELSE {VEL} END AS INT) AS velocity,
    CAST(take AS INT) AS rr FROM ({PARTS.replace(LETTERS, 'CDEGGAB')}) p""")
def layered_file_names(t):
    """Without the letter F, since `F2` reads as the dynamic f with take 2."""
    n = note_parts(t, "CDEGGAB")
    take = F.col("take").cast("string")
    m = F.col("event_id") % 3
    level = F.when(m == 0, F.concat_ws("_", F.col("dyn"), F.concat(F.lit("rr"), take))).when(
        m == 1, F.concat_ws("_", F.concat(F.lit("vl"), take), F.concat(F.lit("rr"), take))).otherwise(
        F.concat("dyn", take))
    s = X.layered_tokens(F.concat_ws("_", F.lit("KSHarp"), level, "note", F.lit("Main")))
    return n.select("event_id", s["pitch"].alias("pitch"), s["velocity"].alias("velocity"), s["rr"].alias("rr"))


@query("pitch_checks", """SELECT l_orderkey, l_linenumber, abs(d) <= 0.6 AS exact,
    abs((d + 6) - 12 * floor((d + 6) / 12) - 6) <= 0.6 AS any_octave FROM (
    SELECT l_orderkey, l_linenumber, l_quantity - l_partkey % 50 AS d FROM lineitem) x""")
def pitch_checks(t):
    est, named = F.col("l_quantity"), F.col("l_partkey") % 50
    return t.read("lineitem").select("l_orderkey", "l_linenumber", X.pitch_ok(est, named).alias("exact"),
                                     X.pitch_ok(est, named, octave_free=True).alias("any_octave"))


@query("pitch_shift_by_folder", """SELECT l_suppkey % 5 AS folder, min(l_partkey % 88 + CASE WHEN l_suppkey % 5 = 2 THEN 12
    ELSE 0 END) AS lowest, count(*) AS n FROM lineitem GROUP BY 1""")
def pitch_shift_by_folder(t):
    files = t.read("lineitem").select((F.col("l_suppkey") % 5).alias("folder"), (F.col("l_partkey") % 88).alias("pitch"))
    shifts = small_table(t.spark, [(2, 12)], "folder long, shift int")
    return X.shift_by_folder(files, shifts).groupBy("folder").agg(
        F.min("pitch").alias("lowest"), F.count(F.lit(1)).alias("n"))


@query("composition_keys", """SELECT p_partkey, lower(p_brand) || '/' || lower(split_part(p_name, ' ', 1)) AS key,
    lower(p_brand) AS artist FROM part""")
def composition_keys(t):
    path = F.concat(F.lit("root/"), "p_brand", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit(".mid"))
    key = X.composition_key(path, F.col("p_name"))
    return t.read("part").select("p_partkey", key.alias("key"), X.artist_key(key).alias("artist"))


@query("canonical_track_split", """SELECT o_orderkey, CASE WHEN m % 50 = 0 THEN 'omitted' WHEN m <= 1500 THEN 'train'
    WHEN m <= 1875 THEN 'val' ELSE 'test' END AS split FROM (SELECT o_orderkey, o_orderkey % 2100 + 1 AS m FROM orders) o""")
def canonical_track_split(t):
    m = F.col("o_orderkey") % 2100 + 1
    rows = t.read("orders").select("o_orderkey", F.format_string("Track%05d", m).alias("track"), m.alias("m"))
    omitted = rows.where("m % 50 = 0").select("track").distinct()
    moves = omitted.withColumn("dest", F.lit("test"))
    return X.canonical_split(rows, "redux", omitted, moves).select("o_orderkey", "split")


@query("redacted_urls", r"""SELECT page_id, regexp_replace('get ' || url || ' done', 'https?://\S+', '<url>', 'g') AS line
  FROM pages""")
def redacted_urls(t):
    line = F.concat(F.lit("get "), "url", F.lit(" done"))
    return t.read("pages").select("page_id", X.redact_urls(line).alias("line"))


@query("embedded_song_ids", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'TR' || upper(substr(md5(CAST(doc_id AS VARCHAR)), 1, 16))
    END AS song FROM documents""")
def embedded_song_ids(t):
    tag = F.concat(F.lit("lmd/"), F.lit("TR"), F.upper(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 16)))
    text = F.when(F.col("doc_id") % 2 == 0, tag).otherwise("none")
    return t.read("documents").select("doc_id", X.song_ids(text).alias("song"))


@query("window_tags", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'w' || (event_id % 100) ELSE
    'w' || (event_id % 100) || '.5' END AS tag FROM events""")
def window_tags(t):
    k = F.col("event_id")
    return t.read("events").select("event_id", X.window_tag((k % 100) + F.when(k % 2 == 0, 0.0).otherwise(0.5))
                                   .alias("tag"))


@query("score_arithmetic", """SELECT doc_id, round(ln(p) - ln(1 - p), 6) AS z, round(CASE WHEN s > 0 THEN 10 * log10(s) END, 6) AS db,
    CASE WHEN s <= 0.03 THEN 'clean' WHEN s >= 0.10 THEN 'distorted' END AS drive,
    round(greatest(ln(p) - ln(1 - p), 0) - (ln(p) - ln(1 - p)) + ln(1 + exp(-abs(ln(p) - ln(1 - p)))), 6) AS loss,
    CASE WHEN doc_id % 5 = 0 OR doc_id % 3 = 0 OR s < 0.6 THEN 'uncertain' ELSE 'confident' END AS shown
  FROM (SELECT doc_id, (n_chars % 1000) / 1000.0::DOUBLE AS s, least(greatest((n_chars % 1000) / 1000.0::DOUBLE, 1e-6), 1 - 1e-6) AS p
    FROM documents) d""")
def score_arithmetic(t):
    s = F.col("score")
    k = F.col("item")
    z = S.logit(s)
    return t.flat_items().select(
        k.alias("doc_id"), r6(z).alias("z"), r6(S.power_db(s)).alias("db"), S.drive_label(s).alias("drive"),
        r6(S.binary_loss(z, F.lit(1.0))).alias("loss"),
        display_class(s, F.when(k % 3 == 0, False), k % 5 == 0).alias("shown"))


# ---- arrays
@query("sample_levels", """SELECT vec_id, round_even(10 * log10(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) / 64), 2) AS rms,
    round_even(10 * log10(list_max(list_transform(range(0, 8), lambda f: list_sum(list_transform(embedding[f * 8 + 1:f * 8 + 8],
      lambda x: x::DOUBLE * x)) / 8))), 2) AS peak FROM embeddings""")
def sample_levels(t):
    e = t.read("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("s"))
    lv = A.levels(e, ["vec_id"], "s", 8)
    return lv.select("vec_id", F.col("rms_db").alias("rms"), F.col("peak_frame_db").alias("peak"))


LONG = "SELECT vec_id, i - 1 AS i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)"


@query("sample_levels_long", f"""SELECT vec_id, round_even(10 * log10(sum(e) / sum(n)), 2) AS rms, round_even(10 * log10(max(e / n)), 2) AS peak
  FROM (SELECT vec_id, i // 8 AS f, sum(x * x) AS e, count(*) AS n FROM ({LONG}) l GROUP BY 1, 2) g GROUP BY 1""")
def sample_levels_long(t):
    long = t.read("embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    lv = A.levels_long(long, ["vec_id"], 8)
    return lv.select("vec_id", F.col("rms_db").alias("rms"), F.col("peak_frame_db").alias("peak"))


@query("chopped_windows", """SELECT vec_id, CAST(w AS INT) AS w, round(list_sum(list_transform(embedding[w * 20 + 1:least(w * 20 + 20, n)],
    lambda x: x::DOUBLE)), 5) AS total, CAST(20 AS BIGINT) AS size FROM (SELECT *, 40 + vec_id % 25 AS n FROM embeddings) e,
    range(0, 4) r(w) WHERE w * 20 < n AND (w = 0 OR least(20, n - w * 20) >= 5)""")
def chopped_windows(t):
    e = t.read("embeddings").select("vec_id", F.slice("embedding", F.lit(1), (40 + F.col("vec_id") % 25).cast("int"))
                                    .alias("s"))
    w = A.windows(e, ["vec_id"], "s", 20, 5)
    return w.select("vec_id", "w", F.round(A.array_sum(F.col("part")), 5).alias("total"),
                    F.size("part").cast("long").alias("size"))


@query("nonlinear_residual", """WITH v AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS x,
      list_transform(embedding[33:64], lambda x: x::DOUBLE) AS y FROM embeddings),
    g AS (SELECT *, list_sum(list_transform(range(1, 33), lambda i: x[i] * y[i])) / list_sum(list_transform(x, lambda a: a * a)) AS g,
      list_sum(list_transform(x, lambda a: a * a)) AS xx FROM v),
    r AS (SELECT vec_id, g, xx, list_sum(list_transform(range(1, 33), lambda i: (y[i] - g * x[i]) * (y[i] - g * x[i]))) AS s FROM g)
  SELECT vec_id, round(sqrt(s) / (abs(g) * sqrt(xx)), 4) AS residual FROM r""")
def nonlinear_residual(t):
    e = t.read("embeddings").select("vec_id", *[F.slice("embedding", s, 32).cast("array<double>").alias(c)
                                                for c, s in (("x", 1), ("y", 33))])
    return A.nonlinearity(e, ["vec_id"], "x", "y").withColumn("residual", F.round("residual", 4))


PROFILES = " UNION ALL ".join(
    f"SELECT {s} AS shift, '{m}' AS mode, {list(p)}::DOUBLE[] AS prof, {2 * s + k} AS o"
    for s in range(12) for k, (m, p) in enumerate((("major", A.MAJOR), ("minor", A.MINOR))))


@query("key_estimate", f"""WITH p AS ({PROFILES}), c AS (SELECT vec_id, list_transform(embedding[1:12], lambda x: x::DOUBLE) AS v FROM embeddings),
    x AS (SELECT vec_id, shift, mode, o, k, v[(k + shift) % 12 + 1] AS a, prof[k + 1] AS b FROM c, p, range(0, 12) r(k)),
    r AS (SELECT vec_id, shift, mode, o, corr(a, b) AS r FROM x GROUP BY 1, 2, 3, 4),
    t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY r DESC, o) AS rn,
      lead(r) OVER (PARTITION BY vec_id ORDER BY r DESC, o) AS second FROM r)
  SELECT vec_id, {list(A.NAMES)}[shift + 1] || ' ' || mode AS key,
    round(least(greatest(0.5 + (r - second) * 4, 0.05), 0.99), 2) AS confidence FROM t WHERE rn = 1""")
def key_estimate(t):
    e = t.read("embeddings").select("vec_id", F.slice("embedding", 1, 12).cast("array<double>").alias("chroma"))
    return A.detect_key(e, ["vec_id"])


@query("beat_regularity", """WITH g AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (
    PARTITION BY user_id ORDER BY ts) AS gap FROM events)
  SELECT user_id, round(CASE WHEN count(*) > 3 THEN least(greatest(1 - stddev_pop(gap) / (avg(gap) + 1e-9), 0.05), 0.99) ELSE 0.2 END, 5)
    AS regularity FROM g GROUP BY 1""")
def beat_regularity(t):
    beats = t.events().select("user_id", (F.unix_micros("ts") / 1e6).alias("t"))
    return A.beat_regularity(beats, ["user_id"]).withColumn("regularity", F.round("regularity", 5))


@query("waveform_buckets", """SELECT vec_id, CAST(b AS INT) AS b, round(list_min(embedding[b * 6 + 1:b * 6 + 6])::DOUBLE, 5) AS lo,
    round(list_max(embedding[b * 6 + 1:b * 6 + 6])::DOUBLE, 5) AS hi FROM embeddings, range(0, 10) r(b)""")
def waveform_buckets(t):
    w = A.waveform_buckets(t.read("embeddings"), ["vec_id"], "embedding", 10)
    return w.select("vec_id", "b", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in ("lo", "hi")])


@query("log_feature_gain", """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: ln(1 + 2 * (exp(abs(x::DOUBLE)) - 1)))), 5) AS total
  FROM embeddings""")
def log_feature_gain(t):
    f = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return t.read("embeddings").select("vec_id", F.round(A.array_sum(S.gain_on_log_features(f, F.lit(2.0))), 5)
                                       .alias("total"))


@query("activation_lanes", f"""SELECT song, label, count(*) AS n, round(sum(100 * (end_s - start_s) / 100.0), 4) AS covered
  FROM ({INTERVALS}) i GROUP BY 1, 2""")
def activation_lanes(t):
    """Intervals packed as report arrays, unpacked again and laid out in percent."""
    iv = R.hysteresis_intervals(frames(t), ["song", "label"], 0.6, 0.42)
    rows = A.array_to_intervals(A.intervals_to_array(iv, ["song", "label"]), ["song", "label"])
    width = A.block_percent(F.col("start_s"), F.col("end_s"), F.lit(100.0))["width"]
    return rows.groupBy("song", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(width), 4).alias("covered"))
