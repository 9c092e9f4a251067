"""Whole-run evaluation, bootstrap, gates, calibration, probes and propagation."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelgrove.functions import scores as SC
from labelgrove.operators import bootstrap as B
from labelgrove.operators import calibrate as C
from labelgrove.operators import gate as G
from labelgrove.operators import metrics as M
from labelgrove.operators import probe as PR
from labelgrove.operators import similarity as SIM
from labelgrove.operators import taxonomy as T
from labelgrove.plans import evaluate as E
from labelgrove.plans.catalog import query
from labelgrove.plans.metric_queries import BINS_SQL, CALIB, PRF_SQL, prf_cols, r6
from labelgrove.plans.standins import FLAT_OBS, LEAF_OBS, LEVEL, TREE_OBS, ap_sql
from labelgrove.session import cut_lineage
from labelgrove.sources.literal import small_table


# ---- propagation over the tree
@query("complete_scores", f"""SELECT node, count(*) AS n, round(sum(score), 4) AS total,
    count(*) FILTER (WHERE synthesised) AS n_synthesised FROM (
    SELECT item, u.node, max(score) AS score, bool_and(lo.node <> u.node) AS synthesised
    FROM ({LEAF_OBS}) lo, LATERAL (SELECT unnest([split_part(lo.node, '.', 1),
      split_part(lo.node, '.', 1) || '.' || split_part(lo.node, '.', 2), lo.node]) AS node) u
    GROUP BY 1, 2) c GROUP BY node""")
def complete_scores(t):
    return T.complete_scores(t.leaf_obs()).groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("total"),
        F.count_if("synthesised").alias("n_synthesised"))


PARTIAL_TREE = f"SELECT item, node, score FROM ({TREE_OBS}) o WHERE {LEVEL} <> 2 OR item % 2 = 0"


@query("max_propagation", f"""WITH s AS ({PARTIAL_TREE})
  SELECT a.item, a.node, max(b.score) AS score FROM s a JOIN s b ON b.item = a.item
    AND (b.node = a.node OR starts_with(b.node, a.node || '.')) GROUP BY 1, 2""")
def max_propagation(t):
    s = t.tree_obs().where((T.level_of("node") != 2) | (F.col("item") % 2 == 0))
    return T.max_propagate(s.select("item", "node", "score"))


@query("child_parent_violations", f"""WITH s AS (SELECT item, node, CASE WHEN {LEVEL} = 2
      THEN score / 2 ELSE score END AS score FROM ({TREE_OBS}) o)
  SELECT count(*) AS checked, count(*) FILTER (WHERE c.score > p.score + 1e-9) AS violations
  FROM s c JOIN s p ON c.item = p.item
    AND p.node = array_to_string(string_split(c.node, '.')[1:-2], '.') AND contains(c.node, '.')""")
def child_parent_violations(t):
    half = F.when(T.level_of("node") == 2, F.col("score") / 2).otherwise(F.col("score"))
    return T.violations(t.tree_obs().select("item", "node", half.alias("score")))


@query("hierarchical_prf", f"""WITH s AS (SELECT item, node, score FROM ({LEAF_OBS}) o WHERE item % 3 <> 0),
    l AS (SELECT item, node, y FROM ({TREE_OBS}) o WHERE {LEVEL} < 3 OR item % 2 = 0),
    p AS (SELECT DISTINCT item, u.node FROM s, LATERAL (SELECT unnest([split_part(s.node, '.', 1),
      split_part(s.node, '.', 1) || '.' || split_part(s.node, '.', 2), s.node]) AS node) u
      WHERE score >= 0.6),
    c AS (SELECT l.*, p.item IS NOT NULL AS hit FROM l LEFT JOIN p USING (item, node)),
    n AS (SELECT count(*) FILTER (WHERE hit AND y) AS tp, count(*) FILTER (WHERE hit AND NOT y) AS fp,
      count(*) FILTER (WHERE NOT hit AND y) AS fn FROM c)
  SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
    round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM n""")
def hierarchical_prf(t):
    labels = t.tree_obs().where((T.level_of("node") < 3) | (F.col("item") % 2 == 0))
    scores = t.leaf_obs().where("item % 3 <> 0")
    return T.hierarchical_prf(labels, scores, [0.6]).drop("threshold").withColumns(
        {c: r6(c) for c in ("precision", "recall", "f1")})


SEGMENTS = """(SELECT node, CASE split_part(node, '.', 3) WHEN 'building' THEN 'b'
    WHEN 'machinery' THEN 'm' WHEN 'household' THEN 'h' END AS cls FROM o)"""


@query("class_projection", f"""WITH o AS ({LEAF_OBS})
  SELECT item, cls, max(score) AS score FROM (SELECT item, score,
    CASE WHEN starts_with(node, 'asia.') THEN CASE WHEN starts_with(node, 'asia.nation_2.') THEN 'n2'
      ELSE 'asia' END WHEN starts_with(node, 'africa.') THEN 'africa' END AS cls FROM o) c
  WHERE cls IS NOT NULL GROUP BY 1, 2""")
def class_projection(t):
    """Scores projected through the class of the deepest mapped ancestor."""
    classes = small_table(t.spark, [("asia", "asia"), ("asia.nation_2", "n2"), ("africa", "africa")],
                          "node string, cls string")
    return T.project(t.leaf_obs(), T.deepest_class(t.tree_nodes(), classes))


@query("antichain_check", """SELECT 'asia' AS node, 'asia.nation_2' AS below FROM nation
  WHERE n_name = 'NATION_2'""")
def antichain_check(t):
    """Mapped nodes above another mapped node (the projection of `class_projection` has one)."""
    mapped = t.place_nodes().where("node in ('asia', 'asia.nation_2', 'africa')")
    return T.antichain_violations(mapped)


@query("merged_class_diagnostic", f"""SELECT n_observed, n_positive, skipped, round(ap, 6) AS ap FROM ({ap_sql(
    f'''SELECT a.y, greatest(a.score, b.score) AS score FROM ({TREE_OBS}) a JOIN ({TREE_OBS}) b
      ON a.item = b.item WHERE a.node = 'asia' AND b.node = 'africa' ''', '')}) x""")
def merged_class_diagnostic(t):
    """AP of max(class, sibling class) against the truth of the class."""
    o = t.tree_obs()
    a = o.where("node = 'asia'").select("item", "y", F.col("score").alias("sa"))
    b = o.where("node = 'africa'").select("item", F.col("score").alias("sb"))
    both = a.join(b, "item").select("y", F.greatest("sa", "sb").alias("score"))
    return M.average_precision(both, []).withColumn("ap", r6("ap"))


# ---- a whole run
def run_tables(t):
    """Labels and scores of a stored run."""
    obs = t.stored(t.tree_obs(), "run")
    return obs.select("item", "node", "y"), obs.select("item", "node", "score")


NODE_SUM = f"""WITH o AS ({TREE_OBS}), ap AS ({ap_sql('SELECT * FROM o')}),
  q5 AS ({prf_cols(PRF_SQL.format(thr=0.5, src='SELECT * FROM o'))}),
  q6 AS ({prf_cols(PRF_SQL.format(thr=0.6, src='SELECT * FROM o'))}),
  per AS (SELECT ap.node, ap.ap, q5.n_positive, q5.tp, q5.fp, q5.fn, q5.f1, q6.tp AS tp6, q6.fp AS fp6,
    q6.fn AS fn6, q6.f1 AS f16, len(string_split(ap.node, '.')) AS level
    FROM ap JOIN q5 USING (node) JOIN q6 USING (node)),
  cal AS ({CALIB.format(src='SELECT * FROM o')}),
  lv AS (SELECT *, {LEVEL} AS level FROM cal),
  bins AS (SELECT scope, CAST(least(floor(score * 15), 14) AS INT) AS bin, count(*) AS n,
      sum(score) AS s, count(*) FILTER (WHERE y) AS k
    FROM (SELECT *, unnest(['ece', 'ece_level_' || level] || CASE WHEN level = 2
      THEN ['projection_ece'] ELSE [] END) AS scope FROM lv) e GROUP BY 1, 2),
  cw AS (SELECT avg(e) AS e FROM (SELECT node, sum(abs(n_positive - sum_score)) / sum(n) AS e FROM (
    {BINS_SQL.format(keys='node,', src='SELECT * FROM cal')}) b GROUP BY node) f),
  mic AS ({ap_sql("SELECT * FROM o WHERE len(string_split(node, '.')) = 3", '')}),
  h AS (SELECT count(*) FILTER (WHERE score >= 0.5 AND y) AS tp,
    count(*) FILTER (WHERE score >= 0.5 AND NOT y) AS fp, count(*) FILTER (WHERE score < 0.5 AND y) AS fn,
    count(*) FILTER (WHERE score >= 0.6 AND y) AS tp6,
    count(*) FILTER (WHERE score >= 0.6 AND NOT y) AS fp6, count(*) FILTER (WHERE score < 0.6 AND y)
    AS fn6 FROM o),
  m AS (SELECT 'map_macro' AS metric, avg(ap) AS value FROM per
    UNION ALL SELECT 'map_leaf', avg(ap) FILTER (WHERE level = 3) FROM per
    UNION ALL SELECT 'map_leaf_min3', avg(ap) FILTER (WHERE level = 3 AND n_positive >= 3) FROM per
    UNION ALL SELECT 'f1_macro_leaf', avg(f1) FILTER (WHERE level = 3) FROM per
    UNION ALL SELECT 'f1_macro_leaf_t60', avg(f16) FILTER (WHERE level = 3) FROM per
    UNION ALL SELECT 'f1_micro_leaf', 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) FROM per
      WHERE level = 3
    UNION ALL SELECT 'f1_micro_leaf_t60', 2 * sum(tp6) / (2 * sum(tp6) + sum(fp6) + sum(fn6)) FROM per
      WHERE level = 3
    UNION ALL SELECT 'map_level_' || level, avg(ap) FROM per GROUP BY level
    UNION ALL SELECT 'projection_map', avg(ap) FROM per WHERE level = 2
    UNION ALL SELECT 'map_micro_leaf', ap FROM mic
    UNION ALL SELECT scope, sum(abs(k - s)) / sum(n) FROM bins GROUP BY scope
    UNION ALL SELECT 'ece_classwise', e FROM cw
    UNION ALL SELECT 'brier', avg((score - CAST(y AS INT)) * (score - CAST(y AS INT))) FROM cal
    UNION ALL SELECT 'hier_f1', 2 * tp / (2 * tp + fp + fn) FROM h
    UNION ALL SELECT 'hier_precision', tp / (tp + fp) FROM h
    UNION ALL SELECT 'hier_recall', tp / (tp + fn) FROM h
    UNION ALL SELECT 'hier_f1_t60', 2 * tp6 / (2 * tp6 + fp6 + fn6) FROM h)
  SELECT metric, round(value, 6) AS value FROM m"""


@query("run_summary", NODE_SUM)
def run_summary(t):
    labels, scores = run_tables(t)
    nodes = t.tree_nodes()
    out = E.summary(labels, scores, nodes.where("is_leaf"), nodes.where("level = 2"))
    return out.withColumn("value", r6("value"))


@query("prediction_alignment", """SELECT count(*) FILTER (WHERE l AND p) AS n_evaluated,
    count(*) FILTER (WHERE p IS NULL) AS n_missing_predictions,
    count(*) FILTER (WHERE l IS NULL) AS n_extra_predictions
  FROM (SELECT DISTINCT doc_id, true AS l FROM labels) a
  FULL JOIN (SELECT doc_id, true AS p FROM documents WHERE doc_id % 4 <> 0) b USING (doc_id)""")
def prediction_alignment(t):
    labels = t.flat_obs().select("item", "node", "y")
    preds = t.flat_items().where("item % 4 <> 0").withColumn("node", F.lit("quality"))
    return E.alignment_counts(labels, preds)


# ---- bootstrap, gates, adoption
N_BOOT = 20


def two_runs(t, max_level=2):
    """(run, item, node, y, score, grp) of both runs on the upper levels of the tree."""
    obs = t.tree_obs().where(T.level_of("node") <= max_level).join(t.item_group(), "item")
    return obs.select("item", "node", "y", "grp", F.explode(F.array(
        F.struct(F.lit("cand").alias("run"), F.col("score").alias("score")),
        F.struct(F.lit("inc").alias("run"), F.col("score2").alias("score")))).alias("s")).select(
        "s.run", "item", "node", "y", "s.score", "grp")


RUNS = f"""SELECT run, item, node, y, grp, CASE run WHEN 'cand' THEN score ELSE score2 END AS score
  FROM (SELECT o.*, p_brand AS grp FROM ({TREE_OBS}) o JOIN part ON item = p_partkey
    WHERE {LEVEL} <= 2) z CROSS JOIN (SELECT unnest(['cand', 'inc']) AS run) r"""
DRAWS = f"""gi AS (SELECT grp, row_number() OVER (ORDER BY md5(grp), grp) - 1 AS idx
    FROM (SELECT DISTINCT p_brand AS grp FROM part) d),
  dr AS (SELECT r, ('0x' || substr(md5('1:' || r || ':' || d), 1, 8))::BIGINT
      % (SELECT count(*) FROM gi) AS idx, count(*) AS m
    FROM range({N_BOOT}) a(r), range((SELECT count(*) FROM gi)) b(d) GROUP BY 1, 2),
  dg AS (SELECT grp, r, m FROM dr JOIN gi USING (idx))"""
BOOT_AP = f"""WITH runs AS ({RUNS}), {DRAWS},
  x AS (SELECT run, node, r, score, sum(m) AS n, coalesce(sum(m) FILTER (WHERE y), 0) AS tp
    FROM runs JOIN dg USING (grp) GROUP BY 1, 2, 3, 4),
  c AS (SELECT *, CAST(sum(tp) OVER w AS DOUBLE) AS ctp, sum(n) OVER w AS cn FROM x
    WINDOW w AS (PARTITION BY run, node, r ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
  boot AS (SELECT run, node, r, CASE WHEN sum(tp) > 0 AND sum(tp) < sum(n)
    THEN sum(tp * ctp / cn) / sum(tp) END AS ap FROM c GROUP BY 1, 2, 3),
  point AS ({ap_sql('SELECT * FROM runs', 'run, node')})"""


def boot_tables(t):
    runs = t.stored(two_runs(t), "runs")
    drawn = B.draws(t.item_group(), N_BOOT, seed=1)
    boot = B.resample(runs, drawn, N_BOOT)
    point = M.average_precision(runs, ["run", "node"]).select("run", "node",
                                                              F.col("ap").alias("value"))
    return boot, point


def rounded_ci(df):
    return df.withColumns({c: r6(c) for c in ("delta", "lo", "hi") if c in df.columns})


@query("bootstrap_resamples", f"""{BOOT_AP} SELECT run, node, CAST(r AS INT) AS r, round(ap, 6) AS ap
  FROM boot""")
def bootstrap_resamples(t):
    return boot_tables(t)[0].withColumn("ap", r6("ap"))


PAIRED = """SELECT p.node, round(p.delta, 6) AS delta,
    round(quantile_cont(c.v - i.v, 0.025), 6) AS lo, round(quantile_cont(c.v - i.v, 0.975), 6) AS hi,
    count(c.v - i.v) AS n_valid, {b} AS n_boot
  FROM ({point}) p LEFT JOIN ({vals} AND run = 'cand') c ON c.node = p.node
  LEFT JOIN ({vals} AND run = 'inc') i ON i.node = p.node AND i.r = c.r GROUP BY p.node, p.delta"""
NODE_POINT = """SELECT a.node, a.ap - b.ap AS delta FROM point a JOIN point b ON a.node = b.node
  WHERE a.run = 'cand' AND b.run = 'inc'"""
MACRO_VALS = "SELECT run, '(macro)' AS node, r, avg(ap) AS v FROM boot GROUP BY run, r HAVING true"
MACRO_POINT = """SELECT '(macro)' AS node, avg(ap) FILTER (WHERE run = 'cand')
  - avg(ap) FILTER (WHERE run = 'inc') AS delta FROM point"""


@query("paired_bootstrap_nodes", f"""{BOOT_AP} {PAIRED.format(
    point=NODE_POINT, vals='SELECT run, node, r, ap AS v FROM boot WHERE true', b=N_BOOT)}""")
def paired_bootstrap_nodes(t):
    boot, point = boot_tables(t)
    return rounded_ci(B.paired_ci(B.macro_draws(boot, True), point, "cand", "inc", N_BOOT))


def macro_point(point):
    return point.groupBy("run").agg(F.avg("value").alias("value")).withColumn(
        "node", F.lit("(macro)"))


@query("paired_bootstrap_macro", f"""{BOOT_AP} {PAIRED.format(
    point=MACRO_POINT, vals=MACRO_VALS, b=N_BOOT)}""")
def paired_bootstrap_macro(t):
    boot, point = boot_tables(t)
    return rounded_ci(B.paired_ci(B.macro_draws(boot), macro_point(point), "cand", "inc", N_BOOT))


@query("bootstrap_intervals", f"""{BOOT_AP} SELECT p.run, p.node, round(p.ap, 6) AS value,
    round(quantile_cont(b.ap, 0.025), 6) AS lo, round(quantile_cont(b.ap, 0.975), 6) AS hi,
    count(b.ap) AS n_valid, {N_BOOT} AS n_boot
  FROM point p LEFT JOIN boot b ON b.run = p.run AND b.node = p.node GROUP BY 1, 2, 3""")
def bootstrap_intervals(t):
    boot, point = boot_tables(t)
    ci = B.single_ci(B.macro_draws(boot, True), point, N_BOOT)
    return ci.withColumns({c: r6(c) for c in ("value", "lo", "hi")})


@query("paired_run_alignment", f"""WITH c AS (SELECT item, node, y FROM ({LEAF_OBS}) o WHERE item % 7 <> 0),
    i AS (SELECT item, node, CASE WHEN item % 5 = 0 THEN NOT y ELSE y END AS y FROM ({LEAF_OBS}) o
      WHERE item % 11 <> 0)
  SELECT reason, count(*) AS n FROM (SELECT CASE WHEN c.y IS NULL THEN 'only_incumbent'
    WHEN i.y IS NULL THEN 'only_candidate' WHEN c.y <> i.y THEN 'labels_differ' END AS reason
    FROM c FULL JOIN i ON c.item = i.item AND c.node = i.node) r WHERE reason IS NOT NULL GROUP BY 1""")
def paired_run_alignment(t):
    o = t.leaf_obs().select("item", "node", "y").join(t.item_group(), "item")
    flip = F.when(F.col("item") % 5 == 0, ~F.col("y")).otherwise(F.col("y"))
    return B.alignment_errors(o.where("item % 7 <> 0"),
                              o.where("item % 11 <> 0").withColumn("y", flip))


def run_metrics(t):
    """(metric, candidate, incumbent): mean AP per level, overall, and Brier of both runs."""
    runs = two_runs(t, 3)
    ties = cut_lineage(M.tie_groups(runs, ["run", "node"]))
    ap = M.ap_from_ties(ties, ["run", "node"]).withColumn("level", T.level_of("node"))
    scope = F.explode(F.array(F.lit("map_macro"),
                              F.concat(F.lit("map_level_"), F.col("level").cast("string"))))
    maps = ap.withColumn("metric", scope).groupBy("metric", "run").agg(F.avg("ap").alias("value"))
    brier = M.brier_from_ties(ties, ["run"]).select(F.lit("brier").alias("metric"), "run",
                                          F.col("brier").alias("value"))
    both = maps.unionByName(brier)
    return both.groupBy("metric").agg(
        F.max(F.when(F.col("run") == "cand", F.col("value"))).alias("candidate"),
        F.max(F.when(F.col("run") == "inc", F.col("value"))).alias("incumbent"))


RUNS3 = RUNS.replace(f"WHERE {LEVEL} <= 2", "WHERE true")
RUN_METRICS = f"""WITH runs AS ({RUNS3}), ap AS ({ap_sql('SELECT * FROM runs', 'run, node')}),
  mv AS (SELECT unnest(['map_macro', 'map_level_' || {LEVEL}]) AS metric, run, ap FROM ap),
  mm AS (SELECT metric, avg(ap) FILTER (WHERE run = 'cand') AS candidate,
      avg(ap) FILTER (WHERE run = 'inc') AS incumbent FROM mv GROUP BY 1
    UNION ALL SELECT 'brier', avg(pow(score - CAST(y AS INT), 2)) FILTER (WHERE run = 'cand'),
      avg(pow(score - CAST(y AS INT), 2)) FILTER (WHERE run = 'inc') FROM runs),
  sec AS (SELECT *, CASE WHEN metric = 'brier' THEN candidate - incumbent ELSE incumbent - candidate
      END AS regress, CASE WHEN metric = 'brier' THEN 0.005 ELSE abs(incumbent) * 0.02 END AS allowed
    FROM mm WHERE metric <> 'map_macro')"""


@query("gate_secondaries", f"""{RUN_METRICS} SELECT metric, round(candidate, 6) AS candidate,
    round(incumbent, 6) AS incumbent, round(candidate - incumbent, 6) AS delta,
    round(allowed, 6) AS allowed, CASE WHEN regress > allowed + 1e-9 THEN 'regressed' ELSE 'ok' END
    AS verdict FROM sec""")
def gate_secondaries(t):
    return G.secondary_verdicts(run_metrics(t), "map_macro").withColumns(
        {c: r6(c) for c in ("candidate", "incumbent", "delta", "allowed")})


@query("promotion_gate", f"""{RUN_METRICS},
  pr AS (SELECT candidate AS c, incumbent AS i FROM mm WHERE metric = 'map_macro'),
  bad AS (SELECT coalesce(string_agg('secondary ' || metric || ' regressed', '; ' ORDER BY metric), '')
    AS s FROM sec WHERE regress > allowed + 1e-9),
  why AS (SELECT c, i, concat_ws('; ', CASE WHEN NOT c > i + 1e-9
    THEN 'primary map_macro does not beat the incumbent' END, nullif(s, '')) AS reasons FROM pr, bad)
  SELECT reasons = '' AS promote, true AS comparable, round(c - i, 6) AS delta, reasons FROM why""")
def promotion_gate(t):
    return G.promotion_gate(run_metrics(t), "map_macro").withColumn("delta", r6("delta"))


@query("comparability_check", """WITH c AS (SELECT source AS key, count(*) AS v FROM documents GROUP BY 1),
    i AS (SELECT source AS key, count(*) AS v FROM documents WHERE doc_id % 50 <> 0 GROUP BY 1)
  SELECT key, CAST(c.v AS VARCHAR) AS candidate, CAST(i.v AS VARCHAR) AS incumbent
  FROM c FULL JOIN i USING (key) WHERE c.v IS DISTINCT FROM i.v""")
def comparability_check(t):
    def config(rows):
        return rows.groupBy(F.col("source").alias("key")).agg(
            F.count(F.lit(1)).cast("string").alias("value"))
    docs = t.read("documents")
    return G.comparability(config(docs), config(docs.where("doc_id % 50 <> 0")))


@query("adoption_old_nodes", f"""{BOOT_AP},
  mac AS ({PAIRED.format(point=MACRO_POINT, vals=MACRO_VALS, b=N_BOOT)}),
  per AS ({PAIRED.format(point=NODE_POINT,
                         vals='SELECT run, node, r, ap AS v FROM boot WHERE true', b=N_BOOT)}),
  low AS (SELECT coalesce(string_agg(node, ',' ORDER BY node), '') AS s FROM per WHERE hi < -0.01),
  al AS (SELECT avg(ap) * 0.02 AS a FROM point WHERE run = 'inc')
  SELECT coalesce(delta >= -a - 1e-12 AND s = '', false) AS passed, delta,
    round(a, 6) AS allowed, s AS low_nodes FROM mac, low, al""")
def adoption_old_nodes(t):
    boot, point = boot_tables(t)
    macro = B.paired_ci(B.macro_draws(boot), macro_point(point), "cand", "inc", N_BOOT)
    nodes = B.paired_ci(B.macro_draws(boot, True), point, "cand", "inc", N_BOOT)
    inc = point.where("run = 'inc'").select("node", F.col("value").alias("ap"))
    return G.check_old(macro, nodes, inc).withColumns({c: r6(c) for c in ("delta", "allowed")})


CHANCE_BOOT = f"""WITH runs AS (SELECT * FROM ({RUNS}) q UNION ALL
    SELECT 'chance', item, node, y, grp, 0.0 FROM ({RUNS}) q2 WHERE run = 'cand'), {DRAWS},
  x AS (SELECT run, node, r, score, sum(m) AS n, coalesce(sum(m) FILTER (WHERE y), 0) AS tp
    FROM runs JOIN dg USING (grp) GROUP BY 1, 2, 3, 4),
  c AS (SELECT *, CAST(sum(tp) OVER w AS DOUBLE) AS ctp, sum(n) OVER w AS cn FROM x
    WINDOW w AS (PARTITION BY run, node, r ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
  boot AS (SELECT run, node, r, CASE WHEN sum(tp) > 0 AND sum(tp) < sum(n)
    THEN sum(tp * ctp / cn) / sum(tp) END AS ap FROM c GROUP BY 1, 2, 3),
  mv AS (SELECT r, avg(ap) FILTER (WHERE run = 'cand') AS c, avg(ap) FILTER (WHERE run = 'inc') AS i,
    avg(ap) FILTER (WHERE run = 'chance') AS h FROM boot GROUP BY r),
  lo AS (SELECT quantile_cont(c - i, 0.025) AS li, quantile_cont(c - h, 0.025) AS lh FROM mv)"""


@query("adoption_new_nodes", f"""{CHANCE_BOOT} SELECT li > 0 AND lh > 0 AS passed,
    round(li, 6) AS lo_incumbent, round(lh, 6) AS lo_chance FROM lo""")
def adoption_new_nodes(t):
    runs = t.stored(two_runs(t), "runs")
    chance = runs.where("run = 'cand'").withColumns({"run": F.lit("chance"), "score": F.lit(0.0)})
    every = runs.unionByName(chance)
    boot = B.resample(every, B.draws(t.item_group(), N_BOOT, seed=1), N_BOOT)
    point = macro_point(M.average_precision(every, ["run", "node"]).select(
        "run", "node", F.col("ap").alias("value")))
    values = B.macro_draws(boot)
    sides = [B.paired_ci(values, point, "cand", other, N_BOOT) for other in ("inc", "chance")]
    return G.check_new(*sides).withColumns({c: r6(c) for c in ("lo_incumbent", "lo_chance")})


ARMS = """SELECT CASE WHEN k = 0 THEN 'base' ELSE 'arm' || (k % 3) || '_s' || (k % 5) END AS name, value
  FROM (SELECT user_id % 16 AS k, avg(value) AS value FROM events GROUP BY 1) e"""
ARM = f"""SELECT regexp_replace(name, '^(.+)_s[0-9]+$', '\\1') AS arm,
    CAST(nullif(regexp_extract(name, '^.+_s([0-9]+)$', 1), '') AS INT) AS seed, avg(value) AS value
  FROM ({ARMS}) a GROUP BY 1, 2"""


def arms(t):
    k = t.read("events").groupBy((F.col("user_id") % 16).alias("k")).agg(
        F.avg("value").alias("value"))
    name = F.when(F.col("k") == 0, "base").otherwise(F.concat(
        F.lit("arm"), (F.col("k") % 3).cast("string"), F.lit("_s"), (F.col("k") % 5).cast("string")))
    return k.select(G.arm_of(name).alias("arm"), G.seed_of(name).alias("seed"), "value").groupBy(
        "arm", "seed").agg(F.avg("value").alias("value"))


@query("arm_table", f"""SELECT arm, count(*) AS n_seeds, round(avg(value), 6) AS mean,
    round(min(value), 6) AS min, round(max(value), 6) AS max,
    round(arg_min(value, coalesce(seed, -1)), 6) AS first_seed FROM ({ARM}) a GROUP BY arm""")
def arm_table(t):
    return G.arm_table(arms(t)).withColumns(
        {c: r6(c) for c in ("mean", "min", "max", "first_seed")})


@query("arm_deltas", f"""WITH a AS ({ARM}), r AS (SELECT * FROM a WHERE arm = 'arm1'),
    d AS (SELECT a.arm, a.value - r.value AS s, a.value - (SELECT arg_min(value, coalesce(seed, -1))
      FROM r) AS f FROM a LEFT JOIN r ON coalesce(a.seed, -1) = coalesce(r.seed, -1)
      WHERE a.arm <> 'arm1')
  SELECT arm, count(s) AS n_shared, round(coalesce(avg(s), avg(f)), 6) AS mean_delta,
    round(CASE WHEN count(s) > 0 THEN min(s) ELSE min(f) END, 6) AS min_delta,
    round(CASE WHEN count(s) > 0 THEN max(s) ELSE max(f) END, 6) AS max_delta FROM d GROUP BY arm""")
def arm_deltas(t):
    return G.arm_deltas(arms(t), "arm1").withColumns(
        {c: r6(c) for c in ("mean_delta", "min_delta", "max_delta")})


# ---- calibration
LOGIT = "(ln(p) - ln(1 - p))"
Z = """SELECT *, ln(p) - ln(1 - p) AS z FROM (SELECT *, least(greatest(score, 1e-6), 1 - 1e-6) AS p
  FROM ({src}) s) q"""


@query("temperature_fit", f"""WITH o AS (SELECT *, {LEVEL} AS level FROM ({TREE_OBS}) x),
    z AS ({Z.format(src='SELECT * FROM o')}),
    g AS (SELECT level, g, exp(ln(0.05) + g * (ln(20 / 0.05) / 40)) AS t, z.z, y
      FROM z, range(0, 41) r(g)),
    l AS (SELECT level, g, t, sum(greatest(z / t, 0) - z / t * CAST(y AS INT)
      + ln(1 + exp(-abs(z / t)))) AS loss, count(*) AS n FROM g GROUP BY 1, 2, 3)
  SELECT level, round(arg_min(t, loss), 6) AS temperature, round(min(loss) / max(n), 6) AS loss
  FROM l GROUP BY level""")
def temperature_fit(t):
    """One pass over the log grid of temperatures per level."""
    obs = t.tree_obs().withColumn("level", T.level_of("node"))
    return C.fit_temperatures(obs, ["level"], rounds=1).withColumns(
        {c: r6(c) for c in ("temperature", "loss")})


def temperature_sql(source: str, keys: str, rounds: int = 40) -> str:
    """Newton steps of 1 / T from 1, each at most a factor of two, over distinct logits."""
    key, by, on = (f"{keys}, ", f"GROUP BY {keys}", f"USING ({keys})") if keys else ("", "", "ON true")
    out = f"""WITH z AS (SELECT {key}ln(p) - ln(1 - p) AS z, count(*) AS n, count(*) FILTER (WHERE y) AS k FROM (
      SELECT *, least(greatest(round(score, 6), 1e-6), 1 - 1e-6) AS p FROM ({source}) s) q GROUP BY ALL),
    x0 AS (SELECT {key}1.0::DOUBLE AS x FROM z {by or 'LIMIT 1'})"""
    for i in range(rounds):
        out += f""",
    x{i + 1} AS (SELECT {key}least(greatest(x - g / h, x / 2, 0.05), 2 * x, 20) AS x FROM (SELECT {key}any_value(x) AS x,
      sum(z * (n / (1 + exp(-x * z)) - k)) AS g, sum(z * z * n / (1 + exp(-x * z)) / (1 + exp(x * z))) AS h FROM z JOIN x{i} {on} {by}) s)"""
    return out + f""" SELECT {key}round(1 / any_value(x), 6) AS temperature, round(sum(n * (greatest(x * z, 0)
      + ln(1 + exp(-abs(x * z)))) - k * x * z) / sum(n), 6) AS loss FROM z JOIN x{rounds} {on} {by}"""


@query("temperature_fit_global", temperature_sql(TREE_OBS, ""))
def temperature_fit_global(t):
    """One temperature for all classes, to the stop of the gradient."""
    return C.exact_temperatures(t.tree_obs(), []).select(r6("temperature").alias("temperature"), r6("loss").alias("loss"))


@query("temperature_fit_exact", temperature_sql(f"SELECT *, {LEVEL} AS level FROM ({TREE_OBS}) o", "level"))
def temperature_fit_exact(t):
    """The best temperature of every level, to the stop of the gradient."""
    fits = C.exact_temperatures(t.tree_obs().withColumn("level", T.level_of("node")), ["level"])
    return fits.select("level", r6("temperature").alias("temperature"), r6("loss").alias("loss"))


@query("temperature_apply", f"""SELECT node, count(*) AS n, round(avg(1 / (1 + exp(-z / t))), 6) AS mean_score
  FROM (SELECT *, 0.5 * {LEVEL} AS t FROM ({Z.format(src=TREE_OBS)}) x) q GROUP BY node""")
def temperature_apply(t):
    s = t.tree_obs().withColumn("level", T.level_of("node"))
    temps = small_table(t.spark, [(1, 0.5), (2, 1.0), (3, 1.5)], "level int, temperature double")
    return SC.apply_temperature(s, temps).groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("score")).alias("mean_score"))


def platt_sql(source: str, rounds: int = 30) -> str:
    """Newton steps of (a, b) from the identity, each at most 1 in either, over distinct logits."""
    out = f"""WITH z AS (SELECT node, ln(p) - ln(1 - p) AS z, count(*) AS n, count(*) FILTER (WHERE y) AS k FROM (
      SELECT *, least(greatest(round(score, 6), 1e-6), 1 - 1e-6) AS p FROM ({source}) s) q GROUP BY ALL),
    x0 AS (SELECT DISTINCT node, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM z)"""
    for i in range(rounds):
        out += f""",
    x{i + 1} AS (SELECT node, a - least(greatest((hbb * ga - hab * gb) / d, -1), 1) AS a, b - least(greatest((haa * gb - hab * ga) / d, -1), 1) AS b
      FROM (SELECT *, haa * hbb - hab * hab AS d FROM (SELECT node, any_value(a) AS a, any_value(b) AS b, sum(r * z) AS ga, sum(r) AS gb,
        sum(h * z * z) AS haa, sum(h * z) AS hab, sum(h) AS hbb FROM (SELECT node, z, a, b, n / (1 + exp(-a * z - b)) - k AS r,
          n / (1 + exp(-a * z - b)) / (1 + exp(a * z + b)) AS h FROM z JOIN x{i} USING (node)) u GROUP BY node) v) w)"""
    return out + f" SELECT node, round(least(greatest(a, 1e-3), 50), 6) AS a, round(b, 6) AS b FROM x{rounds}"


@query("platt_fit", platt_sql(f"SELECT item, node, y, (score + CAST(y AS INT) * 0.3 * (item % 5) / 4) / 1.3 AS score FROM ({FLAT_OBS}) o"))
def platt_fit(t):
    """Platt scaling of every class, to the stop of the gradient; scores lean towards the labels."""
    lean = (F.col("score") + F.col("y").cast("int") * 0.3 * (F.col("item") % 5) / 4) / 1.3
    return C.fit_platt(t.flat_obs().withColumn("score", lean)).withColumns({c: r6(c) for c in ("a", "b")})


@query("platt_apply", f"""SELECT item, node, round(CASE WHEN node = 'quality'
    THEN 1 / (1 + exp(-(1.3 * z - 0.4))) ELSE score END, 6) AS score, node = 'quality' AS calibrated
  FROM ({Z.format(src=FLAT_OBS)}) q""")
def platt_apply(t):
    fits = small_table(t.spark, [("quality", 1.3, -0.4)], "node string, a double, b double")
    out = SC.apply_platt(t.flat_obs().select("item", "node", "score"), fits)
    return out.withColumn("score", r6("score"))


@query("class_weights", f"""SELECT node, round(greatest(1, least(20, count(*) FILTER (WHERE NOT y) /
    greatest(count(*) FILTER (WHERE y), 1))), 6) AS weight FROM ({TREE_OBS}) o GROUP BY node""")
def class_weights(t):
    return C.class_weights(t.tree_obs()).withColumn("weight", r6("weight"))


@query("distillation_gate", f"""WITH o AS ({TREE_OBS}),
    l AS (SELECT * FROM o WHERE {LEVEL} < 3 OR item % 2 = 0),
    q AS (SELECT node, quantile_cont(score, 0.75) AS cut FROM o GROUP BY node),
    b AS (SELECT DISTINCT l.item, o.node, o.score FROM l JOIN o ON o.item = l.item
      AND starts_with(o.node, l.node || '.') WHERE l.y)
  SELECT b.item, b.node, b.score FROM b JOIN q USING (node)
  WHERE b.score >= cut AND NOT EXISTS (SELECT 1 FROM l WHERE l.item = b.item AND l.node = b.node)""")
def distillation_gate(t):
    o = t.stored(t.tree_obs().select("item", "node", "y", "score"), "teacher")
    labels = o.where((T.level_of("node") < 3) | (F.col("item") % 2 == 0)).select("item", "node", "y")
    return C.distill_gate(labels, T.closure(t.tree_nodes()), o.select("item", "node", "score"), 0.75)


# ---- vectors
CKA = """WITH v AS (SELECT vec_id, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)),
    m AS (SELECT i, avg(x) AS mu FROM v GROUP BY i), c AS (SELECT vec_id, i, x - mu AS x FROM v JOIN m USING (i)),
    p AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS c FROM c a JOIN c b USING (vec_id) GROUP BY 1, 2)
  SELECT round(sum(c * c) FILTER (WHERE i <= 32 AND j > 32) / sqrt(sum(c * c) FILTER (WHERE i <= 32
    AND j <= 32) * sum(c * c) FILTER (WHERE i > 32 AND j > 32)), 6) AS cka FROM p"""


@query("linear_cka", CKA)
def linear_cka(t):
    v = t.read("embeddings").select(F.slice("embedding", 1, 32).alias("x"),
                                    F.slice("embedding", 33, 32).alias("y"))
    return SIM.linear_cka(v, 32).withColumn("cka", r6("cka"))


@query("linear_head_scores", """WITH h AS (SELECT label, list(a ORDER BY i) AS w FROM (
    SELECT label, i, avg(embedding[i]::DOUBLE) AS a FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) q
    GROUP BY label)
  SELECT vec_id AS item, 'c' || h.label AS node, round(1 / (1 + exp(-(list_sum(list_transform(
    range(1, 65), lambda k: embedding[k]::DOUBLE * w[k])) - 0.5))), 5) AS score
  FROM embeddings, h""")
def linear_head_scores(t):
    """Scores of linear heads (here: the class means) on every vector."""
    e = t.read("embeddings")
    means = e.groupBy("label").agg(*[F.avg(F.col("embedding")[i].cast("double")).alias(f"m{i}")
                                     for i in range(64)])
    heads = means.select(F.concat(F.lit("c"), F.col("label").cast("string")).alias("node"),
                         F.array(*[F.col(f"m{i}") for i in range(64)]).alias("weights"),
                         F.lit(-0.5).alias("bias"))
    feats = e.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vec"))
    return PR.linear_scores(feats, heads).withColumn("score", F.round("score", 5))
