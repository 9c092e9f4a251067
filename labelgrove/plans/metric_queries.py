"""Metric operators on the flat and hierarchical evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelgrove.operators import metrics as M
from labelgrove.operators import taxonomy as T
from labelgrove.plans.catalog import query
from labelgrove.plans.standins import (FLAT_OBS, LEAF_OBS, LEVEL, TREE_NODES, TREE_OBS, ap_sql)


def r6(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6)


COUNTS = """SELECT node, count(*) AS n_observed, count(*) FILTER (WHERE y) AS n_positive
  FROM ({src}) s GROUP BY node"""
SKIP = """CASE WHEN coalesce(n_observed, 0) = 0 THEN 'unobserved'
  WHEN n_positive = 0 THEN 'no_positives' WHEN n_positive = n_observed THEN 'no_negatives' END"""
PRF_SQL = """SELECT node, count(*) AS n_observed, count(*) FILTER (WHERE y) AS n_positive,
    count(*) FILTER (WHERE hit AND y) AS tp, count(*) FILTER (WHERE hit AND NOT y) AS fp,
    count(*) FILTER (WHERE NOT hit AND y) AS fn
  FROM (SELECT *, score >= {thr} AS hit FROM ({src}) s) h GROUP BY node"""


def prf_cols(counts_sql: str, extra: str = "") -> str:
    return f"""SELECT *, {SKIP} AS skipped,
      CASE WHEN ({SKIP}) IS NULL THEN p END AS precision,
      CASE WHEN ({SKIP}) IS NULL THEN r END AS recall,
      CASE WHEN ({SKIP}) IS NULL THEN CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END
        END AS f1 {extra}
    FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p,
        CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM ({counts_sql}) c) q"""


@query("flat_ap_macro", f"""WITH ap AS ({ap_sql(FLAT_OBS)})
  SELECT node, n_observed, n_positive, coalesce(skipped, '') AS skipped, round(ap, 6) AS ap,
    CAST(0 AS BIGINT) AS n_skipped FROM ap
  UNION ALL SELECT '(macro)', CAST(sum(n_observed) AS BIGINT), CAST(sum(n_positive) AS BIGINT), '',
    round(avg(ap), 6), count(skipped) FROM ap""")
def flat_ap_macro(t):
    """Per-class AP with a macro row (the flagship): grouping sets over two classes."""
    ap = M.per_class_ap(M.require_scores(t.flat_obs()))
    sets = ap.rollup("node").agg(
        F.sum("n_observed").alias("n_observed"), F.sum("n_positive").alias("n_positive"),
        F.coalesce(F.max("skipped"), F.lit("")).alias("why"), r6(F.avg("ap")).alias("ap"),
        F.count("skipped").alias("n_skip"))
    total = F.col("node").isNull()
    return sets.select(
        F.coalesce("node", F.lit("(macro)")).alias("node"), "n_observed", "n_positive",
        F.when(total, F.lit("")).otherwise(F.col("why")).alias("skipped"), "ap",
        F.when(total, F.col("n_skip")).otherwise(F.lit(0).cast("long")).alias("n_skipped"))


@query("class_skip_reasons", f"""SELECT n.node, coalesce(n_observed, 0) AS n_observed,
    coalesce(n_positive, 0) AS n_positive, {SKIP} AS skipped
  FROM ({TREE_NODES}) n LEFT JOIN ({COUNTS.format(src=LEAF_OBS)}) c ON n.node = c.node""")
def class_skip_reasons(t):
    return M.class_counts(t.leaf_obs(), nodes=t.tree_nodes())


@query("tree_average_precision", f"""SELECT node, n_observed, n_positive, skipped,
    round(ap, 6) AS ap FROM ({ap_sql(TREE_OBS)}) a""")
def tree_average_precision(t):
    return M.average_precision(t.tree_obs()).withColumn("ap", r6("ap"))


@query("macro_by_level", f"""WITH ap AS (SELECT n.node, a.ap,
      CASE WHEN a.node IS NULL THEN 'unobserved' ELSE a.skipped END AS skipped
    FROM ({TREE_NODES}) n LEFT JOIN ({ap_sql(LEAF_OBS)}) a ON n.node = a.node)
  SELECT {LEVEL} AS level, round(avg(ap), 6) AS value, count(*) AS n_classes,
    count(skipped) AS n_skipped, count(*) FILTER (WHERE skipped = 'unobserved') AS n_unobserved,
    count(*) FILTER (WHERE skipped = 'no_positives') AS n_no_positives,
    count(*) FILTER (WHERE skipped = 'no_negatives') AS n_no_negatives FROM ap GROUP BY 1""")
def macro_by_level(t):
    ap = M.per_class_ap(t.leaf_obs(), t.tree_nodes()).withColumn("level", T.level_of("node"))
    return M.macro(ap, by=["level"]).withColumn("value", r6("value"))


@query("micro_average_precision", f"""SELECT n_observed, n_positive, round(ap, 6) AS ap
  FROM ({ap_sql(LEAF_OBS, '')}) a""")
def micro_average_precision(t):
    return M.micro_average_precision(t.leaf_obs()).withColumn("ap", r6("ap"))


@query("prf_at_half", f"""SELECT node, n_observed, n_positive, tp, fp, fn, skipped,
    round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
  FROM ({prf_cols(PRF_SQL.format(thr=0.5, src=TREE_OBS))}) q""")
def prf_at_half(t):
    return M.prf_at_threshold(t.tree_obs(), 0.5).withColumns(
        {c: r6(c) for c in ("precision", "recall", "f1")})


@query("prf_per_class_threshold", f"""WITH o AS ({FLAT_OBS}),
  thr AS (SELECT node, avg(score) AS thr FROM o GROUP BY node),
  c AS (SELECT o.node, count(*) AS n_observed, count(*) FILTER (WHERE y) AS n_positive,
    count(*) FILTER (WHERE score >= thr AND y) AS tp,
    count(*) FILTER (WHERE score >= thr AND NOT y) AS fp,
    count(*) FILTER (WHERE score < thr AND y) AS fn FROM o JOIN thr USING (node) GROUP BY 1)
  SELECT node, n_observed, n_positive, tp, fp, fn, skipped, round(precision, 6) AS precision,
    round(recall, 6) AS recall, round(f1, 6) AS f1 FROM ({prf_cols('SELECT * FROM c')}) q""")
def prf_per_class_threshold(t):
    obs = t.flat_obs()
    thresholds = obs.groupBy("node").agg(F.avg("score").alias("thr"))
    return M.prf_at_threshold(obs, thresholds=thresholds).withColumns(
        {c: r6(c) for c in ("precision", "recall", "f1")})


@query("micro_macro_f1", f"""WITH q AS ({prf_cols(PRF_SQL.format(thr=0.6, src=TREE_OBS))}),
    l AS (SELECT *, {LEVEL} AS level FROM q)
  SELECT level, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp,
    CAST(sum(fn) AS BIGINT) AS fn,
    round(CASE WHEN sum(tp) + sum(fp) > 0 THEN sum(tp) / (sum(tp) + sum(fp)) END, 6) AS precision,
    round(CASE WHEN sum(tp) + sum(fn) > 0 THEN sum(tp) / (sum(tp) + sum(fn)) END, 6) AS recall,
    round(CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) > 0
      THEN 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) END, 6) AS f1,
    round(avg(f1), 6) AS f1_macro, count(skipped) AS n_skipped FROM l GROUP BY 1""")
def micro_macro_f1(t):
    per = M.prf_at_threshold(t.tree_obs(), 0.6).withColumn("level", T.level_of("node"))
    pooled = M.micro_prf(per, ["level"])
    means = M.macro(per, "f1", ["level"]).select("level", r6("value").alias("f1_macro"),
                                                 "n_skipped")
    return pooled.join(means, "level").withColumns(
        {c: r6(c) for c in ("precision", "recall", "f1")})


BINS_SQL = """SELECT {keys} CAST(least(floor(score * 15), 14) AS INT) AS bin, count(*) AS n,
    sum(score) AS sum_score, count(*) FILTER (WHERE y) AS n_positive
  FROM ({src}) s GROUP BY ALL"""
CALIB = f"""SELECT * FROM ({{src}}) o WHERE node NOT IN
  (SELECT node FROM ({{src}}) x GROUP BY node HAVING count(*) = count(*) FILTER (WHERE y))"""


@query("ece_bins", f"""SELECT bin, n, round(sum_score / n, 6) AS conf,
    round(n_positive / n, 6) AS acc FROM ({BINS_SQL.format(keys='', src=TREE_OBS)}) b""")
def ece_bins(t):
    return M.calibration_bins(t.tree_obs()).select(
        "bin", "n", r6(F.col("sum_score") / F.col("n")).alias("conf"),
        r6(F.col("n_positive") / F.col("n")).alias("acc"))


@query("ece_pooled_by_level", f"""WITH o AS (SELECT *, {LEVEL} AS level FROM ({TREE_OBS}) x),
    c AS ({CALIB.format(src='SELECT * FROM o')}),
    b AS ({BINS_SQL.format(keys='level,', src='SELECT * FROM c')}),
    a AS ({BINS_SQL.format(keys='', src='SELECT * FROM c')})
  SELECT level, round(sum(abs(n_positive - sum_score)) / sum(n), 6) AS ece,
    CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY level
  UNION ALL SELECT 0, round(sum(abs(n_positive - sum_score)) / sum(n), 6), CAST(sum(n) AS BIGINT)
  FROM a""")
def ece_pooled_by_level(t):
    """Per-level and pooled ECE from one bin table (pooled bins are sums of level bins)."""
    obs = M.calibratable(t.tree_obs()).withColumn("level", T.level_of("node"))
    bins = M.calibration_bins(obs, keys=["level"])
    sets = (bins.select("*", F.explode(F.array(F.col("level"), F.lit(0))).alias("lv"))
            .groupBy("lv", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "sum_score", "n_positive")])
            .withColumnRenamed("lv", "level"))
    return M.ece_from_bins(sets, ["level"]).select("level", r6("ece").alias("ece"), "n")


@query("ece_classwise", f"""WITH o AS ({TREE_OBS}), c AS ({CALIB.format(src='SELECT * FROM o')}),
    b AS ({BINS_SQL.format(keys='node,', src='SELECT * FROM c')}),
    e AS (SELECT node, sum(abs(n_positive - sum_score)) / sum(n) AS ece FROM b GROUP BY node)
  SELECT round(avg(ece), 6) AS ece, count(*) AS n_classes FROM e""")
def ece_classwise(t):
    return M.classwise_ece(M.calibratable(t.tree_obs())).withColumn("ece", r6("ece"))


@query("brier_score", f"""SELECT node, round(avg((score - CAST(y AS INT)) *
    (score - CAST(y AS INT))), 6) AS brier, count(*) AS n FROM ({TREE_OBS}) o GROUP BY node""")
def brier_score(t):
    return M.brier(t.tree_obs(), ["node"]).withColumn("brier", r6("brier"))


@query("positive_ranks", f"""SELECT node, item, score, rank FROM (SELECT node, item, score, y,
    rank() OVER (PARTITION BY node ORDER BY score DESC) AS rank FROM ({FLAT_OBS}) o) r WHERE y""")
def positive_ranks(t):
    return M.positive_ranks(t.flat_obs())


@query("chance_and_lift", f"""WITH a AS ({ap_sql(TREE_OBS)}),
    p AS (SELECT *, n_positive / n_observed AS prev, CAST(n_observed AS DOUBLE) AS n,
      CAST(n_positive AS DOUBLE) AS k,
      CASE WHEN n_observed <= 1000
        THEN list_sum(list_transform(range(1, n_observed + 1), lambda i: 1.0::DOUBLE / i))
        ELSE ln(n_observed) + 0.5772156649015329 + 1.0 / (2.0 * n_observed)
          - 1.0 / (12.0 * n_observed * n_observed) END AS h FROM a)
  SELECT node, n_observed, n_positive, round(prev, 6) AS prevalence, round(ap, 6) AS ap, skipped,
    round(CASE WHEN n_positive > 0 THEN CASE WHEN n_observed = 1 THEN 1.0
      ELSE (k - 1) / (n - 1) + h * (n - k) / (n * (n - 1)) END END, 6) AS chance_ap,
    round(CASE WHEN prev < 1 THEN (ap - prev) / (1 - prev) END, 6) AS lift FROM p""")
def chance_and_lift(t):
    return M.per_node_chance(t.tree_obs()).withColumns(
        {c: r6(c) for c in ("prevalence", "ap", "chance_ap", "lift")})


@query("node_report", f"""WITH q AS ({prf_cols(PRF_SQL.format(thr=0.5, src=TREE_OBS))}),
    a AS ({ap_sql(TREE_OBS)})
  SELECT node, q.n_observed, q.n_positive, tp, fp, fn, q.skipped, round(precision, 6) AS precision,
    round(recall, 6) AS recall, round(f1, 6) AS f1, round(ap, 6) AS ap FROM q JOIN a USING (node)""")
def node_report(t):
    return M.node_report(t.tree_obs()).withColumns(
        {c: r6(c) for c in ("precision", "recall", "f1", "ap")})
