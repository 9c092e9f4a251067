"""Linear models of all classes on stored vectors, and the test against a shortcut."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelgrove.operators import cotrain as CT
from labelgrove.operators import linear_fit as L
from labelgrove.operators import metrics as M
from labelgrove.plans.catalog import query
from labelgrove.plans.resample_queries import N_BOOT, SEED, node_values_sql

STEPS = 3
OPTIONS = {"steps": STEPS, "rate": 0.5, "momentum": 0.9, "decay": 1e-3}
CLASSES = "(SELECT DISTINCT 'c' || label AS node, label AS k FROM embeddings)"
LABELS = f"""SELECT e.vec_id AS item, c.node, e.label = c.k AS y FROM embeddings e CROSS JOIN {CLASSES} c"""
VECTORS = "SELECT vec_id AS item, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(i)"
#: What a text looks like without its words.
NUISANCE = """SELECT doc_id AS item, unnest([1, 2, 3, 4]) AS i, unnest([CAST(n_chars AS DOUBLE), CAST(len(text) - len(replace(text, ' ', '')) AS DOUBLE),
  CAST(len(text) - len(replace(text, 'e', '')) AS DOUBLE), CAST(doc_id % 97 AS DOUBLE)]) AS v FROM documents
  WHERE doc_id IN (SELECT vec_id FROM embeddings)"""


def fit_sql(name: str, features: str, train: str) -> str:
    """CTEs of the fixed-step fit on `features(item, i, v)` and `train(item, node, y)`; weights end in {name}_w{STEPS}."""
    out = f"""{name}_f AS ({features}), {name}_l AS ({train}),
  {name}_m AS (SELECT i, avg(v) AS mu, greatest(stddev_samp(v), 1e-4) AS sd FROM {name}_f
    WHERE item IN (SELECT item FROM {name}_l) GROUP BY i),
  {name}_x AS (SELECT item, i, (v - mu) / sd AS x FROM {name}_f JOIN {name}_m USING (i)
    UNION ALL SELECT DISTINCT item, 0, 1.0 FROM {name}_f),
  {name}_c AS (SELECT node, count(*) AS n, greatest(1, least(20, count(*) FILTER (WHERE NOT y) / greatest(count(*) FILTER (WHERE y), 1))) AS pw
    FROM {name}_l GROUP BY node),
  {name}_w0 AS (SELECT node, i, 0.0::DOUBLE AS w, 0.0::DOUBLE AS v FROM {name}_c, (SELECT DISTINCT i FROM {name}_x) d)"""
    for t in range(STEPS):
        out += f""",
  {name}_z{t} AS (SELECT l.item, l.node, l.y, sum(x * w) AS z FROM {name}_l l JOIN {name}_x x ON l.item = x.item
    JOIN {name}_w{t} w ON w.node = l.node AND w.i = x.i GROUP BY ALL),
  {name}_g{t} AS (SELECT z.node, x.i, sum((1 / (1 + exp(-z)) - CAST(y AS INT)) * CASE WHEN y THEN pw ELSE 1 END * x / n) AS g
    FROM {name}_z{t} z JOIN {name}_c c ON c.node = z.node JOIN {name}_x x ON x.item = z.item GROUP BY ALL),
  {name}_w{t + 1} AS (SELECT node, i, w + d AS w, d AS v FROM (SELECT w.node, w.i, w, {OPTIONS['momentum']} * v
    - {OPTIONS['rate']} * (g + CASE WHEN w.i > 0 THEN {OPTIONS['decay']} * w ELSE 0 END) AS d
    FROM {name}_w{t} w JOIN {name}_g{t} g ON g.node = w.node AND g.i = w.i) s)"""
    return out


def vectors(t):
    return t.read("embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("vec"))


def labels(t):
    """One-vs-rest labels of all ten classes."""
    e = t.read("embeddings").select("vec_id", "label")
    classes = [r["label"] for r in e.select("label").distinct().orderBy("label").collect()]
    cells = F.explode(F.array(*[F.struct(F.lit(f"c{k}").alias("node"), (F.col("label") == k).alias("y")) for k in classes])).alias("o")
    return e.select(F.col("vec_id").alias("item"), cells).select("item", "o.node", "o.y")


def nuisance(t):
    count = lambda ch: F.length("text") - F.length(F.replace("text", F.lit(ch), F.lit("")))
    ids = t.read("embeddings").select(F.col("vec_id").alias("doc_id"))
    return t.read("documents").join(ids, "doc_id", "left_semi").select(F.col("doc_id").alias("item"), F.array(*[
        x.cast("double") for x in (F.col("n_chars"), count(" "), count("e"), F.col("doc_id") % 97)]).alias("vec"))


@query("linear_fit_steps", f"""WITH {fit_sql('a', VECTORS, f'SELECT * FROM ({LABELS}) l WHERE item % 5 < 3')}
  SELECT node, CAST(i AS INTEGER) AS i, round(w, 8) AS weight FROM a_w{STEPS}""")
def linear_fit_steps(t):
    """Weights of all ten classes after fixed steps of the one fit."""
    model = L.fit(vectors(t), labels(t).where("item % 5 < 3"), **OPTIONS)
    return L.weight_rows(model, t.spark).withColumn("weight", F.round("weight", 8))


@query("linear_probe")
def linear_probe(t):
    """All ten classes, stopped by the validation AP and scored on held-out rows."""
    o = labels(t)
    model = L.fit(vectors(t), o.where("item % 5 < 3"), o.where("item % 5 = 3"), steps=40, rate=0.5)
    return M.average_precision(L.score_rows(model, L.labelled(vectors(t), o.where("item % 5 = 4"), list(model.nodes))))


TEST = f"SELECT * FROM ({LABELS}) l WHERE item % 5 = 4 AND item IN (SELECT doc_id FROM documents)"
TRAIN = f"SELECT * FROM ({LABELS}) l WHERE item % 5 < 3 AND item IN (SELECT doc_id FROM documents)"
SCORED = """SELECT '{run}' AS run, l.item, l.node, l.y, CAST(l.item % 40 AS VARCHAR) AS grp, 1 / (1 + exp(-sum(x * w))) AS score
  FROM ({test}) l JOIN {name}_x x ON x.item = l.item JOIN {name}_w{steps} w ON w.node = l.node AND w.i = x.i GROUP BY ALL"""
SIDES = " UNION ALL ".join(SCORED.format(run=run, name=name, test=TEST, steps=STEPS) for run, name in (("real", "a"), ("shortcut", "b")))
SHORTCUT = node_values_sql(f"SELECT run, item, node, y, grp, round(score, 9) AS score FROM ({SIDES}) s",
                           "SELECT DISTINCT CAST(vec_id % 40 AS VARCHAR) AS grp FROM embeddings", 1).replace(
    "WITH runs", f"WITH {fit_sql('a', VECTORS, TRAIN)}, {fit_sql('b', NUISANCE, TRAIN)}, runs", 1)


@query("shortcut_baseline", f"""{SHORTCUT},
  every AS (SELECT run, node, r, ap FROM v UNION ALL SELECT run, '(macro)', r, avg(ap) FROM v GROUP BY run, r),
  p AS (SELECT c.node, c.r, c.ap AS c, i.ap AS i FROM every c JOIN every i ON c.node = i.node AND c.r = i.r AND c.run = 'real' AND i.run = 'shortcut'),
  ci AS (SELECT node, max(c) FILTER (WHERE r = -1) AS ap_real, max(i) FILTER (WHERE r = -1) AS ap_shortcut,
      max(c - i) FILTER (WHERE r = -1) AS delta, quantile_cont(c - i, 0.025) FILTER (WHERE r <> -1) AS lo,
      quantile_cont(c - i, 0.975) FILTER (WHERE r <> -1) AS hi, CAST(count(c - i) FILTER (WHERE r <> -1) AS INT) AS n_valid FROM p GROUP BY node)
  SELECT node, round(ap_real, 8) AS ap_real, round(ap_shortcut, 8) AS ap_shortcut, round(delta, 8) AS delta, round(lo, 8) AS lo,
    round(hi, 8) AS hi, n_valid, coalesce(lo > 0, false) AS beats_shortcut FROM ci""")
def shortcut_baseline(t):
    """The embeddings against what documents look like without their words."""
    o = labels(t).withColumn("grp", (F.col("item") % 40).cast("string"))
    out = L.shortcut_baseline(vectors(t), nuisance(t), o.where("item % 5 < 3"), None, o.where("item % 5 = 4"), N_BOOT, SEED, **OPTIONS)
    return out.withColumns({c: F.round(c, 8) for c in ("ap_real", "ap_shortcut", "delta", "lo", "hi")})


REAL = """SELECT l.doc_id AS item, u.node, u.flag = 1 AS y FROM labels l, LATERAL (SELECT unnest(['quality', 'toxic']) AS node,
    unnest([quality, toxic]) AS flag) u WHERE l.doc_id IN (SELECT vec_id FROM embeddings)
  AND l.doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'fr')"""


@query("cotraining_rows", f"""WITH s AS (SELECT 'synthetic:' || item AS item, node, y FROM ({LABELS}) l WHERE item % 2 = 0),
    r AS (SELECT 'real:' || item AS item, node, y FROM ({REAL}) q),
    b AS (SELECT * FROM s UNION ALL SELECT * FROM r)
  SELECT split_part(item, ':', 1) AS source, node, count(*) AS n, count(*) FILTER (WHERE y) AS n_positive,
    CAST(count(DISTINCT item) * 64 AS BIGINT) AS cells FROM b GROUP BY 1, 2""")
def cotraining_rows(t):
    """Synthetic classes joined by real labels of documents that have a vector and a free licence."""
    vecs, own = vectors(t), labels(t).where("item % 2 = 0")
    real = t.read("labels").selectExpr("doc_id as item", "stack(2, 'quality', quality = 1, 'toxic', toxic = 1) as (node, y)")
    licences = t.read("documents").select(F.col("doc_id").alias("item"), F.when(
        F.col("lang") == "fr", "CC BY-Non-Commercial").otherwise("CC BY").alias("title"))
    both, obs = CT.cotraining({"synthetic": (vecs, own), "real": (vecs, CT.usable(real, vecs, licences))})
    cells = obs.join(both.select("item", F.size("vec").alias("d")), "item")
    return cells.groupBy(F.split_part("item", F.lit(":"), F.lit(1)).alias("source"), "node").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("y").alias("n_positive"), F.sum("d").alias("cells"))
