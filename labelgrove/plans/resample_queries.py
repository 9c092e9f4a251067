"""Bootstrap of all metrics on all levels of the tree, and the gate that uses its intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelgrove.operators import gate as G
from labelgrove.operators import resample as RS
from labelgrove.plans import evaluate as E
from labelgrove.plans.catalog import query
from labelgrove.plans.run_queries import RUNS3, two_runs
from labelgrove.plans.standins import FLAT_OBS, LEAF_OBS, TREE_NODES

N_BOOT = 200
SEED = 7


def node_values_sql(runs: str, groups: str, depth: int = 3) -> str:
    """SQL twin of `node_values`: `runs(run, item, node, y, grp, score)`, `groups(grp)`; `depth` is that of leaves."""
    return f"""WITH runs AS ({runs}),
  x0 AS (SELECT grp, r, (('0x' || substr(md5('{SEED}:' || grp), 1, 8))::BIGINT + r * 2654435769) % 4294967296 AS x
    FROM ({groups}) g, range(-1, {N_BOOT}) t(r)),
  x1 AS (SELECT grp, r, (xor(x, x >> 16)::HUGEINT * 2146121005 % 4294967296)::BIGINT AS x FROM x0),
  x2 AS (SELECT grp, r, (xor(x, x >> 15)::HUGEINT * 2221713035 % 4294967296)::BIGINT AS x FROM x1),
  w AS (SELECT grp, r, CASE WHEN r = -1 THEN 1 ELSE len(list_filter({RS.POISSON}, lambda c: c <= xor(x, x >> 16))) END AS w FROM x2),
  cells AS (SELECT run, node, score, grp, count(*) AS n, count(*) FILTER (WHERE y) AS tp FROM runs GROUP BY ALL),
  x AS (SELECT run, node, r, score, sum(n * w) AS n, sum(tp * w) AS tp FROM cells JOIN w USING (grp) GROUP BY ALL),
  c AS (SELECT *, CAST(sum(tp) OVER k AS DOUBLE) AS ctp, sum(n) OVER k AS cn FROM x
    WINDOW k AS (PARTITION BY run, node, r ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
  s AS (SELECT run, node, r, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(tp) AS DOUBLE) AS tp,
      CAST(coalesce(sum(tp) FILTER (WHERE score >= 0.5), 0) AS DOUBLE) AS hits,
      CAST(coalesce(sum(n - tp) FILTER (WHERE score >= 0.5), 0) AS DOUBLE) AS false_hits,
      sum(tp * (1 - score) * (1 - score) + (n - tp) * score * score) AS square,
      sum(CASE WHEN cn > 0 THEN tp * ctp / cn ELSE 0 END) AS part FROM c GROUP BY ALL),
  b AS (SELECT run, node, r, least(floor(score * 15), 14) AS bin, sum(tp) - sum(n * score) AS gap FROM x GROUP BY ALL),
  g AS (SELECT run, node, r, sum(abs(gap)) AS gap FROM b GROUP BY ALL),
  v AS (SELECT s.*, len(string_split(s.node, '.')) = {depth} AS leaf, tp < n AS mixed, CASE WHEN tp > 0 AND tp < n THEN part / tp END AS ap,
      CASE WHEN tp > 0 AND tp < n THEN 2 * hits / (tp + hits + false_hits) END AS f1,
      CASE WHEN n > 0 THEN g.gap / n END AS ece, CASE WHEN n > 0 THEN square / n END AS brier FROM s JOIN g USING (run, node, r))"""


NODE_VALUES = node_values_sql(RUNS3, "SELECT DISTINCT p_brand AS grp FROM part")
RUN_VALUES = f"""{NODE_VALUES},
  bins AS (SELECT run, r, bin, sum(gap) AS gap FROM b JOIN v USING (run, node, r) WHERE mixed GROUP BY ALL),
  pooled AS (SELECT run, r, sum(abs(gap)) AS gap FROM bins GROUP BY ALL),
  wide AS (SELECT run, r, avg(ap) AS map_macro, avg(ap) FILTER (WHERE leaf) AS map_leaf, avg(f1) FILTER (WHERE leaf) AS f1_macro_leaf,
      2 * sum(hits) FILTER (WHERE leaf) / sum(tp + hits + false_hits) FILTER (WHERE leaf) AS f1_micro_leaf,
      any_value(pooled.gap) / sum(n) FILTER (WHERE mixed) AS ece, avg(ece) FILTER (WHERE mixed) AS ece_classwise,
      sum(square) FILTER (WHERE mixed) / sum(n) FILTER (WHERE mixed) AS brier FROM v JOIN pooled USING (run, r) GROUP BY 1, 2),
  long AS (UNPIVOT wide ON map_macro, map_leaf, f1_macro_leaf, f1_micro_leaf, ece, ece_classwise, brier INTO NAME metric VALUE value),
  pair AS (SELECT c.metric, c.r, c.value AS c, i.value AS i FROM long c JOIN long i ON c.metric = i.metric AND c.r = i.r
    WHERE c.run = 'cand' AND i.run = 'inc'),
  ci AS (SELECT metric, max(c) FILTER (WHERE r = -1) AS candidate, max(i) FILTER (WHERE r = -1) AS incumbent,
      max(c - i) FILTER (WHERE r = -1) AS delta, quantile_cont(c - i, 0.025) FILTER (WHERE r <> -1) AS lo,
      quantile_cont(c - i, 0.975) FILTER (WHERE r <> -1) AS hi, CAST(count(c - i) FILTER (WHERE r <> -1) AS INT) AS n_valid
    FROM pair GROUP BY metric)"""


def node_values(t):
    """Values of every node of both runs, point estimate and resamples."""
    return RS.node_values(two_runs(t, 3), N_BOOT, SEED)


def metric_intervals(t):
    leaves = t.tree_nodes().where("is_leaf")
    return RS.paired_intervals(RS.run_values(node_values(t), leaves), "cand", "inc")


def rounded(df):
    """Ten digits: sums of scores with four digits often end half-way between two numbers of six."""
    return df.withColumns({c: F.round(c, 10) for c in ("value", "candidate", "incumbent", "delta", "lo", "hi") if c in df.columns})


@query("bootstrap_metrics", f"""{RUN_VALUES} SELECT metric, round(candidate, 10) AS candidate, round(incumbent, 10) AS incumbent,
    round(delta, 10) AS delta, round(lo, 10) AS lo, round(hi, 10) AS hi, n_valid, CAST({N_BOOT} AS INT) AS n_boot FROM ci""")
def bootstrap_metrics(t):
    """Paired intervals of ranking, threshold and calibration metrics over the whole tree."""
    return rounded(metric_intervals(t))


@query("bootstrap_node_metrics", f"""{NODE_VALUES},
  long AS (UNPIVOT (SELECT run, node, r, ap, f1, ece, brier FROM v) ON ap, f1, ece, brier INTO NAME metric VALUE value),
  every AS (SELECT DISTINCT run, node, metric FROM runs, (SELECT unnest(['ap', 'f1', 'ece', 'brier']) AS metric) m),
  ci AS (SELECT run, node, metric, max(value) FILTER (WHERE r = -1) AS value, quantile_cont(value, 0.025) FILTER (WHERE r <> -1) AS lo,
      quantile_cont(value, 0.975) FILTER (WHERE r <> -1) AS hi, CAST(count(value) FILTER (WHERE r <> -1) AS INT) AS n_valid
    FROM every LEFT JOIN long USING (run, node, metric) GROUP BY 1, 2, 3)
  SELECT run, node, metric, round(value, 10) AS value, round(lo, 10) AS lo, round(hi, 10) AS hi, n_valid, CAST({N_BOOT} AS INT) AS n_boot
  FROM ci""")
def bootstrap_node_metrics(t):
    """Intervals of four metrics of every class of each run."""
    wide = node_values(t).unpivot(["run", "node", "r"], ["ap", "f1", "ece", "brier"], "metric", "value")
    return rounded(RS.single_intervals(wide, ("run", "node", "metric")))


@query("gate_with_interval", f"""{RUN_VALUES},
  sec AS (SELECT *, metric IN ('ece', 'ece_classwise', 'brier') AS lower FROM ci WHERE metric <> 'map_leaf'),
  bad AS (SELECT coalesce(string_agg('secondary ' || metric || ' regressed', '; ' ORDER BY metric), '') AS s FROM sec
    WHERE CASE WHEN lower THEN candidate - incumbent ELSE incumbent - candidate END
      > CASE WHEN lower THEN 0.005 ELSE abs(incumbent) * 0.02 END + 1e-9),
  why AS (SELECT delta, concat_ws('; ', CASE WHEN NOT candidate > incumbent + 1e-9 THEN 'primary map_leaf does not beat the incumbent' END,
      CASE WHEN n_valid / {N_BOOT} < 0.95 - 1e-9 THEN 'significance unavailable'
        WHEN NOT coalesce(lo > 0, false) THEN 'interval includes 0' END, nullif(s, '')) AS reasons
    FROM ci, bad WHERE metric = 'map_leaf')
  SELECT reasons = '' AS promote, true AS comparable, round(delta, 10) AS delta, reasons FROM why""")
def gate_with_interval(t):
    """Promotion over all metrics of the bootstrap, the primary's interval included."""
    ci = metric_intervals(t)
    return G.promotion_gate(ci.select("metric", "candidate", "incumbent"), "map_leaf",
                            bootstrap=ci.where("metric = 'map_leaf'")).withColumn("delta", F.round("delta", 10))


MEAN_AP = f"""{NODE_VALUES},
  mac AS (SELECT r, avg(ap) FILTER (WHERE run = 'cand') - avg(ap) FILTER (WHERE run = 'inc') AS d FROM v GROUP BY r)"""


@query("adoption_old_all_levels", f"""{MEAN_AP},
  per AS (SELECT c.node, quantile_cont(c.ap - i.ap, 0.975) AS hi FROM v c JOIN v i ON c.node = i.node AND c.r = i.r
    WHERE c.run = 'cand' AND i.run = 'inc' AND c.r <> -1 GROUP BY 1),
  low AS (SELECT coalesce(string_agg(node, ',' ORDER BY node), '') AS s FROM per WHERE hi < -0.01),
  al AS (SELECT avg(ap) * 0.02 AS a FROM v WHERE run = 'inc' AND r = -1)
  SELECT coalesce(d >= -a - 1e-12 AND s = '', false) AS passed, round(d, 10) AS delta, round(a, 10) AS allowed, s AS low_nodes
  FROM mac, al, low WHERE r = -1""")
def adoption_old_all_levels(t):
    """No class of the whole tree may fall clearly behind the incumbent."""
    return G.check_old_nodes(node_values(t), "cand", "inc").withColumns({c: F.round(c, 10) for c in ("delta", "allowed")})


ARMS = f"""SELECT name AS run, item, node, y, grp, CASE name WHEN 'base_s0' THEN score WHEN 'base_s1' THEN floor(score * 8) / 8
    WHEN 'new_s1' THEN 1 - score ELSE CAST(y AS INT) * 0.25 + score / 2 END AS score
  FROM ({FLAT_OBS}) o, (SELECT unnest(['base_s0', 'base_s1', 'new_s1', 'ref']) AS name) n"""
ARM_VALUES = f"""{node_values_sql(ARMS, "SELECT DISTINCT source AS grp FROM documents", 1)},
  mean AS (SELECT run, r, avg(ap) AS m FROM v GROUP BY 1, 2)"""


def arm_values(t):
    """Four runs over the documents: two seeds of one arm, one of another, one without a seed."""
    s, y = F.col("score"), F.col("y").cast("int")
    names = F.array(*[F.struct(F.lit(n).alias("run"), x.alias("score")) for n, x in (
        ("base_s0", s), ("base_s1", F.floor(s * 8) / 8), ("new_s1", 1 - s), ("ref", y * 0.25 + s / 2))])
    rows = t.flat_obs().select("item", "node", "y", "grp", F.explode(names).alias("n")).select("n.run", "item", "node", "y", "grp", "n.score")
    values = RS.node_values(rows, N_BOOT, SEED)
    runs = values.select("run").distinct().select("run", G.arm_of(F.col("run")).alias("arm"), G.seed_of(F.col("run")).alias("seed"))
    return values, runs


@query("arm_intervals", f"""{ARM_VALUES},
  a AS (SELECT *, regexp_replace(run, '_s[0-9]+$', '') AS arm, run IN ('base_s0', 'new_s1', 'ref') AS first FROM mean)
  SELECT arm, round(avg(m) FILTER (WHERE r = -1), 10) AS mean, round(min(m) FILTER (WHERE r = -1), 10) AS min,
    round(max(m) FILTER (WHERE r = -1), 10) AS max, count(*) FILTER (WHERE r = -1) AS n_seeds,
    round(quantile_cont(m, 0.025) FILTER (WHERE first AND r <> -1), 10) AS lo,
    round(quantile_cont(m, 0.975) FILTER (WHERE first AND r <> -1), 10) AS hi,
    CAST(count(m) FILTER (WHERE first AND r <> -1) AS INT) AS n_valid FROM a GROUP BY arm""")
def arm_intervals(t):
    return G.arm_intervals(*arm_values(t)).withColumns({c: F.round(c, 10) for c in ("mean", "min", "max", "lo", "hi")})


@query("arm_pairs", f"""{ARM_VALUES},
  p AS (SELECT * FROM (VALUES ('new', 'base', 1, 1, 'new_s1', 'base_s1'), ('base', 'ref', 0, -1, 'base_s0', 'ref'),
    ('base', 'ref', 1, -1, 'base_s1', 'ref')) x(candidate, incumbent, seed, incumbent_seed, c, i)),
  d AS (SELECT candidate, incumbent, seed, incumbent_seed, a.r, a.m - b.m AS d FROM p JOIN mean a ON a.run = c JOIN mean b ON b.run = i AND b.r = a.r),
  q AS (SELECT candidate, incumbent, seed, incumbent_seed, max(d) FILTER (WHERE r = -1) AS delta, quantile_cont(d, 0.025) FILTER (WHERE r <> -1) AS lo,
    quantile_cont(d, 0.975) FILTER (WHERE r <> -1) AS hi, count(d) FILTER (WHERE r <> -1) AS n_valid FROM d GROUP BY ALL)
  SELECT candidate, incumbent, seed, incumbent_seed, round(delta, 10) AS delta, round(lo, 10) AS lo, round(hi, 10) AS hi, n_valid,
    lo > 0 OR hi < 0 AS excludes_0 FROM q""")
def arm_pairs(t):
    """Seed by seed where the arms share seeds, else against the first seed."""
    pairs = G.arm_pairs(*arm_values(t), [("new", "base"), ("base", "ref")])
    return pairs.withColumns({c: F.round(c, 10) for c in ("delta", "lo", "hi")})


@query("prior_reference", f"""WITH o AS ({LEAF_OBS}),
  c AS (SELECT node, count(*) AS n, count(*) FILTER (WHERE y) AS k FROM o WHERE item % 2 = 0 GROUP BY 1),
  p AS (SELECT t.node, (coalesce(k, 0) + 1) / (coalesce(n, 0) + 2) AS s FROM ({TREE_NODES}) t LEFT JOIN c USING (node)),
  e AS (SELECT node, any_value(s) AS s, count(*) AS n, count(*) FILTER (WHERE y) AS tp FROM o JOIN p USING (node) WHERE item % 2 = 1
    GROUP BY node HAVING count(*) > count(*) FILTER (WHERE y)),
  b AS (SELECT least(floor(s * 15), 14) AS bin, abs(sum(tp - n * s)) AS gap FROM e GROUP BY 1)
  SELECT 'prior_ece' AS metric, round((SELECT sum(gap) FROM b) / sum(n), 9) AS value FROM e
  UNION ALL SELECT 'prior_ece_classwise', round(avg(abs(tp - n * s) / n), 9) FROM e
  UNION ALL SELECT 'prior_brier', round(sum(tp * (1 - s) * (1 - s) + (n - tp) * s * s) / sum(n), 9) FROM e""")
def prior_reference(t):
    """The label prior of the even items, read on the odd ones."""
    o = t.leaf_obs().select("item", "node", "y")
    return E.prior_reference(o.where("item % 2 = 1"), o.where("item % 2 = 0"), t.tree_nodes()).withColumn("value", F.round("value", 9))


SETTING = "SELECT 'config.threshold' AS key, '{0}' AS value UNION ALL SELECT 'config.propagate', 'True' UNION ALL"
CONFIG = """{setting} SELECT 'items.n_evaluated', CAST(count(DISTINCT doc_id) AS VARCHAR) FROM labels WHERE {where}
  UNION ALL SELECT 'labels.n', CAST(count(*) * 2 AS VARCHAR) FROM labels WHERE {where}
  UNION ALL SELECT 'evaluated_nodes.n', '2' UNION ALL SELECT 'taxonomy.n', '2'"""


@query("run_differences", f"""WITH a AS ({CONFIG.format(setting=SETTING.format(0.5), where='true')}),
    b AS ({CONFIG.format(setting=SETTING.format(0.6), where='doc_id % 3 <> 0')})
  SELECT key, a.value AS candidate, b.value AS incumbent FROM a JOIN b USING (key) WHERE a.value <> b.value""")
def run_differences(t):
    """What keeps two runs from being compared: settings, and the sizes of the hashed tables."""
    labels = t.flat_obs().select("item", "node", "y")
    nodes = labels.select("node").distinct()
    predictions = t.flat_items().select("item", "score", F.explode(F.array(F.lit("quality"), F.lit("toxic"))).alias("node"))

    def config(predicted, threshold):
        c = E.run_config(labels, predicted, nodes, {"threshold": threshold, "propagate": True})
        hashed = F.endswith("key", F.lit(".hash"))
        return c.select(F.when(hashed, F.replace("key", F.lit(".hash"), F.lit(".n"))).otherwise(F.col("key")).alias("key"),
                        F.when(hashed, F.substring_index("value", "/", -1)).otherwise(F.col("value")).alias("value"))
    return G.comparability(config(predictions, 0.5), config(predictions.where("item % 3 <> 0"), 0.6))
