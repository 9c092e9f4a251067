"""Splits, subsets, audits, hashes, priors and node selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelgrove.operators import audit as A
from labelgrove.operators import selection as S
from labelgrove.operators import balanced as BAL
from labelgrove.operators import splits as P
from labelgrove.plans.catalog import query
from labelgrove.plans.standins import (FLAT_OBS, LEAF_OBS, LEVEL, TREE_NODES, TREE_OBS)

FRACTIONS = {"train": 0.7, "val": 0.1, "test": 0.2}
LADDER = "CASE WHEN {u} < 0.7 THEN 'train' WHEN {u} < 0.7 + 0.1 THEN 'val' ELSE 'test' END"
MD5_U = "('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def orders(t):
    return t.read("orders").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("grp"),
                                   "o_orderpriority", "o_orderstatus")


@query("split_by_crc")
def split_by_crc(t):
    """Stateless CRC-32 split of orders by customer (no CRC in the oracle's SQL)."""
    groups = t.read("customer").select(F.col("c_custkey").cast("string").alias("grp"))
    return P.split_of(groups, FRACTIONS).groupBy("split").agg(F.count(F.lit(1)).alias("n_groups"))


GROUP_SPLIT = f"""WITH s AS (SELECT o_custkey AS grp, count(*) AS n FROM orders GROUP BY 1),
  r AS (SELECT *, sum(n) OVER (ORDER BY sha256('7:' || grp), grp) AS cum, sum(n) OVER () AS total
    FROM s)
  SELECT grp, n, {LADDER.format(u='((cum - n / 2) / total)')} AS split FROM r"""


@query("group_disjoint_split", GROUP_SPLIT)
def group_disjoint_split(t):
    return P.group_split(orders(t), FRACTIONS, seed=7)


GREEDY_STEPS = f"""WITH RECURSIVE s AS (SELECT o_custkey AS grp, count(*) AS n FROM orders GROUP BY 1),
  o AS (SELECT *, row_number() OVER (ORDER BY n DESC, sha256('7:' || grp), grp) AS k FROM s),
  g AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS split, {", ".join(f"sum(n) * {f} / {sum(FRACTIONS.values())} AS d_{s}" for s, f in FRACTIONS.items())} FROM s
    UNION ALL SELECT k, split, {", ".join(f"d_{s} - CASE split WHEN '{s}' THEN n ELSE 0 END" for s in FRACTIONS)}
    FROM (SELECT o.k, o.n, {", ".join(f"d_{s}" for s in FRACTIONS)}, CASE {" ".join(
      f"WHEN {' AND '.join(f'd_{s} >= d_{u}' for u in FRACTIONS if u != s)} THEN '{s}'" for s in FRACTIONS)} END AS split
      FROM g JOIN o ON o.k = g.k + 1) x)"""


@query("greedy_group_split", f"{GREEDY_STEPS} SELECT grp, n, split FROM o JOIN g USING (k)")
def greedy_group_split(t):
    """The greedy rule, every group in the split that it would get one by one."""
    return BAL.greedy_split(orders(t), FRACTIONS, seed=7)


@query("improved_split")
def improved_split(t):
    """The greedy split with strata balanced by rounds of moves, one group pinned."""
    return BAL.improved_split(group_sizes(t), strata(t), FRACTIONS, pins(t), 7, rounds=6)[0]


TRAIN_ITEMS = f"""SELECT o_orderkey AS item, o_custkey AS grp,
    CASE WHEN o_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM orders"""


@query("validation_carve_out", f"""WITH i AS ({TRAIN_ITEMS}),
  s AS (SELECT grp, count(*) AS n FROM i WHERE split = 'train' GROUP BY 1),
  r AS (SELECT *, sum(n) OVER (ORDER BY sha256('3:' || grp), grp) AS cum, sum(n) OVER () AS total
    FROM s),
  v AS (SELECT grp FROM r WHERE (cum - n / 2) / total < 0.15)
  SELECT CASE WHEN split = 'train' AND grp IN (SELECT grp FROM v) THEN 'val' ELSE split END AS split,
    count(*) AS n_items, count(DISTINCT grp) AS n_groups FROM i GROUP BY 1""")
def validation_carve_out(t):
    items = orders(t).withColumn("split", F.when(F.col("grp") % 5 == 0, "test").otherwise("train"))
    cut = P.carve_validation(items, 0.15, seed=3)
    return (cut.groupBy("split", "grp").agg(F.count(F.lit(1)).alias("n")).groupBy("split")
            .agg(F.sum("n").alias("n_items"), F.count(F.lit(1)).alias("n_groups")))


CANDS = f"""SELECT c.candidate, g.*, CASE WHEN g.grp = 1 THEN 'test' ELSE
    {LADDER.format(u='(' + MD5_U.format(text="'5:' || candidate || ':' || grp") + ')')} END AS split
  FROM (SELECT unnest(range(0, 16)) AS candidate) c, ({{src}}) g"""
DEV = "+".join(f"pow((c_{s} - {f} * c) / c, 2)" for s, f in FRACTIONS.items())
SIZE = "+".join(f"pow((c_{s} - {f} * c) / c, 2)" for s, f in FRACTIONS.items())
MISS = "+".join(f"CASE WHEN c >= 3 AND c_{s} = 0 THEN 1 ELSE 0 END" for s in FRACTIONS)
SUMS = "sum(n) AS c, " + ", ".join(
    f"coalesce(sum(n) FILTER (WHERE split = '{s}'), 0) AS c_{s}" for s in FRACTIONS)
STRATIFIED = f"""WITH sz AS (SELECT o_custkey AS grp, count(*) AS n FROM orders GROUP BY 1),
  st AS (SELECT o_custkey AS grp, stratum, count(*) AS n FROM (
      SELECT o_custkey, o_orderpriority AS stratum FROM orders
      UNION ALL SELECT o_custkey, o_orderstatus FROM orders) x GROUP BY 1, 2),
  a AS (SELECT candidate, {SUMS} FROM ({CANDS.format(src='SELECT * FROM sz')}) q GROUP BY 1),
  b AS (SELECT candidate, stratum, {SUMS} FROM ({CANDS.format(src='SELECT * FROM st')}) q
    GROUP BY 1, 2),
  cost AS (SELECT candidate, 5 * ({SIZE}) + sc AS cost FROM a JOIN (
    SELECT candidate, sum(CASE WHEN c >= 2 THEN {DEV} ELSE 0 END + {MISS}) AS sc FROM b GROUP BY 1) k
    USING (candidate))"""


def strata(t):
    rows = orders(t).select("grp", F.explode(F.array("o_orderpriority", "o_orderstatus"))
                            .alias("stratum"))
    return rows.groupBy("grp", "stratum").agg(F.count(F.lit(1)).alias("n"))


def group_sizes(t):
    return orders(t).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


def pins(t):
    return (t.read("customer").where("c_custkey = 1")
            .select(F.col("c_custkey").alias("grp"), F.lit("test").alias("split")))


@query("stratified_split_costs", f"""{STRATIFIED} SELECT candidate, round(cost, 6) AS cost FROM cost""")
def stratified_split_costs(t):
    return P.candidate_costs(group_sizes(t), strata(t), FRACTIONS, pins(t), 16, 5).withColumn(
        "cost", F.round("cost", 6))


@query("stratified_split", f"""{STRATIFIED} SELECT grp, split FROM ({CANDS.format(
    src='SELECT * FROM sz')}) q
  WHERE candidate = (SELECT candidate FROM cost ORDER BY round(cost, 9), candidate LIMIT 1)""")
def stratified_split(t):
    return P.stratified_split(group_sizes(t), strata(t), FRACTIONS, pins(t), 16, 5)


@query("required_node_pins", f"""WITH o AS (SELECT DISTINCT node, p_brand AS grp FROM ({LEAF_OBS}) l
    JOIN part ON l.item = p_partkey WHERE y),
  s AS (SELECT p_brand AS grp, count(*) AS n FROM part GROUP BY 1)
  SELECT DISTINCT grp, 'test' AS split FROM (SELECT o.grp, row_number() OVER (
    PARTITION BY node ORDER BY n, o.grp) AS rn FROM o JOIN s ON o.grp = s.grp) r WHERE rn = 1""")
def required_node_pins(t):
    groups = t.item_group()
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    carriers = (t.leaf_obs().where("y").join(groups, "item").select("node", "grp").distinct()
                .join(sizes, "grp"))
    return P.pin_required(carriers)


@query("artist_round_robin", """WITH s AS (SELECT source AS grp, row_number() OVER (
    ORDER BY count(*) DESC, source) AS group_rank FROM documents GROUP BY source)
  SELECT doc_id AS item, source AS grp,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn, group_rank
  FROM documents JOIN s ON s.grp = source""")
def artist_round_robin(t):
    items = t.read("documents").select(F.col("doc_id").alias("item"), F.col("source").alias("grp"))
    return P.round_robin(items, "item").select("item", "grp", "turn", "group_rank")


@query("nested_subset", """SELECT doc_id AS item, lang FROM documents
  ORDER BY sha256('11:' || doc_id), doc_id LIMIT 100""")
def nested_subset(t):
    """Seeded subset of 100 items (the limit is the operator)."""
    docs = t.read("documents").select(F.col("doc_id").alias("item"), "lang")
    return P.nested_subset(docs, 100, seed=11)


@query("capped_family_sample", """SELECT doc_id AS item, source AS family, pick FROM (
    SELECT doc_id, source, row_number() OVER (PARTITION BY source
      ORDER BY sha256('2:' || doc_id), doc_id) AS pick FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM labels)) r WHERE pick <= 5""")
def capped_family_sample(t):
    items = t.read("documents").select(F.col("doc_id").alias("item"), F.col("source").alias("family"))
    done = t.read("labels").select(F.col("doc_id").alias("item"))
    return P.capped_sample(items, 5, 2, "family", "item", done).select("item", "family",
                                                                      F.col("pick").cast("long"))


# ---- audits
MISSING = f"""WITH c AS (SELECT node, count(*) AS n_observed,
    count(*) FILTER (WHERE y) AS n_positive FROM ({{src}}) s GROUP BY node),
  m AS (SELECT n.node, coalesce(n_observed, 0) AS n_observed, coalesce(n_positive, 0) AS n_positive,
    ({{total}}) AS n FROM ({{nodes}}) n LEFT JOIN c USING (node)),
  r AS (SELECT *, n_positive / n AS ro, CASE WHEN n_observed > 0 THEN n_positive / n_observed END
    AS rb, 1 - n_observed / n AS un FROM m)
  SELECT node, n, n_observed, n_positive, round(ro, 6) AS rate_overall, round(rb, 6) AS rate_observed,
    round(rb - ro, 6) AS gap, round(un, 6) AS unobserved_share,
    coalesce(n_positive >= 5 AND rb - ro > 0.10 AND un >= 0.10 AND n_observed > n_positive, false)
      AS flagged FROM r"""


@query("missingness_audit", MISSING.format(src=FLAT_OBS, total="SELECT count(*) FROM documents",
                                           nodes="SELECT unnest(['quality', 'toxic']) AS node"))
def missingness_audit(t):
    total = t.read("documents").agg(F.count(F.lit(1)))
    m = A.missingness(t.flat_obs(), total)
    return m.withColumns({c: F.round(c, 6) for c in
                          ("rate_overall", "rate_observed", "gap", "unobserved_share")})


@query("missingness_audit_tree", MISSING.format(
    src=TREE_OBS, total="SELECT count(*) FROM part", nodes=TREE_NODES))
def missingness_audit_tree(t):
    total = t.read("part").agg(F.count(F.lit(1)))
    m = A.missingness(t.tree_obs(), total, t.tree_nodes())
    return m.withColumns({c: F.round(c, 6) for c in
                          ("rate_overall", "rate_observed", "gap", "unobserved_share")})


SPLIT3 = "CASE p_size % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END"
LEAVES = f"SELECT node FROM ({TREE_NODES}) n WHERE {LEVEL} = 3"


def item_split(t):
    m = F.col("p_size") % 3
    return t.read("part").select(
        F.col("p_partkey").alias("item"),
        F.when(m == 0, "train").when(m == 1, "val").otherwise("test").alias("split"))


def covered(t):
    labels = t.leaf_obs().select("item", "node", "y").join(item_split(t), "item")
    leaves = t.tree_nodes().where("is_leaf").select("node")
    return A.coverage(labels, leaves)


COVER = f"""SELECT n.node, count(*) FILTER (WHERE split = 'train') AS train,
    count(*) FILTER (WHERE split = 'val') AS val, count(*) FILTER (WHERE split = 'test') AS test,
    count(split) AS total
  FROM ({LEAVES}) n LEFT JOIN (SELECT node, {SPLIT3} AS split FROM ({LEAF_OBS}) o
    JOIN part ON item = p_partkey WHERE y) p USING (node) GROUP BY 1"""


@query("coverage_by_split", COVER)
def coverage_by_split(t):
    return covered(t)


@query("coverage_totals", f"""SELECT count(*) AS n_leaves, count(*) FILTER (WHERE test >= 1) AS test_min1,
    count(*) FILTER (WHERE test >= 3) AS test_min3 FROM ({COVER}) c""")
def coverage_totals(t):
    return A.coverage_totals(covered(t))


@query("claim_mismatches", f"""WITH seen AS (SELECT DISTINCT node FROM ({LEAF_OBS}) o WHERE y),
  cl AS (SELECT node FROM ({LEAVES}) l WHERE node NOT LIKE '%.furniture'
    UNION SELECT 'asia.nation_2.nothing')
  SELECT node, 'over_claimed' AS kind FROM cl WHERE node NOT IN (SELECT node FROM seen)
  UNION ALL SELECT node, 'under_claimed' FROM seen WHERE node NOT IN (SELECT node FROM cl)""")
def claim_mismatches(t):
    leaves = t.tree_nodes().where("is_leaf")
    extra = t.tree_nodes().where("node = 'asia.nation_2'").select(
        F.concat("node", F.lit(".nothing")).alias("node"))
    claims = leaves.where("node not like '%.furniture'").select("node").unionByName(extra)
    return A.claim_mismatches(t.leaf_obs(), claims)


@query("per_leaf_counts", f"""SELECT n.node, count(*) FILTER (WHERE y) AS pos,
    (SELECT count(*) FROM part) - count(y) AS unknown
  FROM ({LEAVES}) n LEFT JOIN ({LEAF_OBS}) o USING (node) GROUP BY 1""")
def per_leaf_counts(t):
    leaves = t.tree_nodes().where("is_leaf")
    return A.per_leaf(t.leaf_obs(), leaves, t.read("part").agg(F.count(F.lit(1))))


@query("group_leakage", """SELECT grp, string_agg(split, ',' ORDER BY split) AS splits,
    count(*) AS n_splits FROM (SELECT DISTINCT source AS grp,
      CASE WHEN lang = 'en' THEN 'train' ELSE 'test' END AS split FROM documents) d
  GROUP BY 1 HAVING count(*) > 1""")
def group_leakage(t):
    items = t.read("documents").select(
        F.col("source").alias("grp"),
        F.when(F.col("lang") == "en", "train").otherwise("test").alias("split"))
    return A.group_leakage(items)


@query("duplicate_content_leakage", """SELECT content, count(*) AS copies,
    string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(DISTINCT split) > 1 AS leaks,
    min(doc_id) AS first_item
  FROM (SELECT sha256(text) AS content, doc_id,
    CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM documents) d
  GROUP BY 1 HAVING count(*) > 1""")
def duplicate_content_leakage(t):
    m = F.col("doc_id") % 3
    items = t.read("documents").select(
        F.sha2("text", 256).alias("content"), F.col("doc_id").alias("item"),
        F.when(m == 0, "train").when(m == 1, "val").otherwise("test").alias("split"))
    return A.duplicate_content(items)


@query("duplicate_ids", """SELECT conv_id AS item, count(*) AS n FROM conversations
  GROUP BY 1 HAVING count(*) > 1""")
def duplicate_ids(t):
    return A.duplicate_ids(t.read("conversations").select(F.col("conv_id").alias("item")))


@query("label_table_hash", f"""SELECT node, bit_xor(('0x' || substr(md5(item || ':' || node || ':' || y),
    1, 15))::BIGINT) AS hash, count(*) AS n FROM ({LEAF_OBS}) o GROUP BY node""")
def label_table_hash(t):
    return A.table_hash(t.leaf_obs(), "item", "node", "y", by=["node"])


@query("label_prior", f"""SELECT n.node, round((count(*) FILTER (WHERE y) + 1) / (count(y) + 2), 6)
    AS prior FROM ({TREE_NODES}) n LEFT JOIN ({TREE_OBS}) o USING (node) GROUP BY 1""")
def label_prior(t):
    return A.label_prior(t.tree_obs(), t.tree_nodes()).withColumn("prior", F.round("prior", 6))


@query("baseline_prior_scores", f"""SELECT doc_id AS item, node, round(prior, 6) AS score
  FROM documents CROSS JOIN (SELECT node, (count(*) FILTER (WHERE y) + 1) / (count(*) + 2) AS prior
    FROM ({FLAT_OBS}) o GROUP BY node) p""")
def baseline_prior_scores(t):
    nodes = t.flat_obs().select("node").distinct()
    prior = A.label_prior(t.flat_obs(), nodes)
    return A.baseline_prior(t.flat_items(), prior).withColumn("score", F.round("score", 6))


@query("baseline_random_scores", f"""SELECT doc_id AS item, node,
    round({MD5_U.format(text="'9:' || doc_id || ':' || node")}, 6) AS score
  FROM documents CROSS JOIN (SELECT unnest(['quality', 'toxic']) AS node) n""")
def baseline_random_scores(t):
    nodes = t.flat_obs().select("node").distinct()
    return A.baseline_random(t.flat_items(), nodes, 9).withColumn("score", F.round("score", 6))


# ---- selection of nodes and items
@query("eligible_nodes", f"""SELECT node, count(*) AS n_observed, count(*) FILTER (WHERE y) AS n_positive
  FROM ({TREE_OBS}) o WHERE {LEVEL} IN (2, 3) AND NOT starts_with(node, 'asia') GROUP BY 1
  HAVING count(*) FILTER (WHERE y) >= 5 AND count(*) FILTER (WHERE NOT y) >= 5""")
def eligible_nodes(t):
    trained = t.tree_nodes().where("node not like 'asia%'")
    return S.eligible_nodes(t.tree_obs(), trained, 5, 5, [2, 3]).drop("skipped")


@query("scoreable_nodes", f"""SELECT node, count(*) AS n_observed, count(*) FILTER (WHERE y) AS n_positive,
    count(DISTINCT p_brand) FILTER (WHERE y) AS n_groups
  FROM ({LEAF_OBS}) o JOIN part ON item = p_partkey GROUP BY 1
  HAVING count(*) FILTER (WHERE y) >= 3 AND count(*) FILTER (WHERE NOT y) >= 3
    AND count(DISTINCT p_brand) FILTER (WHERE y) >= 4""")
def scoreable_nodes(t):
    obs = t.leaf_obs().join(t.item_group(), "item")
    return S.scoreable(obs, t.tree_nodes(), 3, 3, 4)


@query("trained_node_sets", f"""WITH a AS (SELECT DISTINCT u.node FROM ({LEAF_OBS}) o, LATERAL (
      SELECT unnest([split_part(o.node, '.', 1), split_part(o.node, '.', 1) || '.' ||
        split_part(o.node, '.', 2), o.node]) AS node) u WHERE score >= 0.9),
  b AS (SELECT DISTINCT u.node FROM ({LEAF_OBS}) o, LATERAL (
      SELECT unnest([split_part(o.node, '.', 1), split_part(o.node, '.', 1) || '.' ||
        split_part(o.node, '.', 2), o.node]) AS node) u WHERE score2 >= 0.9),
  s AS (SELECT node FROM ({LEAF_OBS}) o GROUP BY node
    HAVING count(*) FILTER (WHERE y) BETWEEN 1 AND count(*) - 1)
  SELECT node, 'shared' AS kind FROM a WHERE node IN (SELECT node FROM b)
  UNION ALL SELECT node, 'added' FROM a WHERE node NOT IN (SELECT node FROM b)
  UNION ALL SELECT node, 'removed' FROM b WHERE node NOT IN (SELECT node FROM a)
  UNION ALL SELECT node, 'unscoreable' FROM (SELECT * FROM a UNION SELECT * FROM b) p
    WHERE node NOT IN (SELECT node FROM s)""")
def trained_node_sets(t):
    obs = t.leaf_obs()
    counts = obs.groupBy("node").agg(
        F.count_if(F.col("score") >= 0.9).alias("a"), F.count_if(F.col("score2") >= 0.9).alias("b"),
        F.count_if("y").alias("k"), F.count(F.lit(1)).alias("m"))
    a = S.trained_nodes(counts.select("node", F.col("a").alias("n")))
    b = S.trained_nodes(counts.select("node", F.col("b").alias("n")))
    return S.node_sets(a, b, counts.where("k between 1 and m - 1"))


@query("restricted_to_nodes", f"""SELECT node, count(*) AS n, round(avg(score), 6) AS mean_score
  FROM ({LEAF_OBS}) o WHERE node IN (SELECT node FROM ({LEAF_OBS}) p GROUP BY node
    HAVING count(*) >= 20) GROUP BY node""")
def restricted_to_nodes(t):
    obs = t.leaf_obs()
    wanted = obs.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")
    return S.restrict(obs, wanted).groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("units_without_bleed", """SELECT l_orderkey || '/' || l_linenumber AS item, p_type AS node,
    l_quantity >= 25 AS y FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_returnflag IS DISTINCT FROM 'R'""")
def units_without_bleed(t):
    stems = t.lines().select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("stem"),
                             F.col("p_type").alias("node"), (F.col("l_quantity") >= 25).alias("y"),
                             (F.col("l_returnflag") == "R").alias("bleed"))
    return S.units(stems, stems, "stem", exclude_bleed=True)


LICENCE_WORDS = ("CC-BY-NC", "Non-Commercial", "NoDerivs", "Attribution", "no derivatives", "")


@query("commercial_licences", """SELECT title, ok, count(*) AS n FROM (
    SELECT title, length(title) > 0 AND NOT (flat LIKE '%noncommercial%' OR flat LIKE '%noderivative%'
      OR flat LIKE '%noderivs%') AS ok
    FROM (SELECT title, replace(replace(replace(lower(title), '-', ''), '_', ''), ' ', '') AS flat
      FROM (SELECT CASE doc_id % 6 WHEN 0 THEN 'CC-BY-NC' WHEN 1 THEN 'Non-Commercial'
        WHEN 2 THEN 'NoDerivs' WHEN 3 THEN 'Attribution' WHEN 4 THEN 'no derivatives' ELSE '' END
        AS title FROM documents) d) f) g GROUP BY 1, 2""")
def commercial_licences(t):
    words = F.array(*[F.lit(w) for w in LICENCE_WORDS])
    titles = t.read("documents").select(
        F.element_at(words, (F.col("doc_id") % 6 + 1).cast("int")).alias("title"))
    return titles.groupBy("title", S.commercial_ok("title").alias("ok")).agg(
        F.count(F.lit(1)).alias("n"))


@query("holdout_filter_lso", """WITH s AS (SELECT DISTINCT s_suppkey AS source, p_type AS leaf
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
  h AS (SELECT * FROM s WHERE source % 7 = 0 AND leaf IN ('SMALL', 'LARGE', 'PROMO'))
  SELECT 'train' AS role, leaf, count(*) AS n FROM s WHERE (source, leaf) NOT IN (SELECT * FROM h)
    GROUP BY 1, 2
  UNION ALL SELECT 'lso', leaf, count(*) FROM s WHERE (source, leaf) IN (SELECT * FROM h)
    OR leaf NOT IN (SELECT leaf FROM h) GROUP BY 1, 2""")
def holdout_filter_lso(t):
    pairs = (t.read("lineitem").select("l_partkey", "l_suppkey")
             .join(t.read("part").select("p_partkey", "p_type"),
                   F.col("l_partkey") == F.col("p_partkey"))
             .join(t.read("supplier").select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"))
             .select(F.col("s_suppkey").alias("source"), F.col("p_type").alias("leaf")).distinct())
    held = pairs.where("source % 7 = 0 and leaf in ('SMALL', 'LARGE', 'PROMO')")
    roles = [S.holdout_filter(pairs, held, r).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("role", F.lit(r)) for r in ("train", "lso")]
    return roles[0].unionByName(roles[1])


@query("corrupt_item_flags", """SELECT doc_id AS item, source || '_' || doc_id AS key,
    source IN (SELECT source FROM documents GROUP BY source HAVING count(*) % 2 = 0) AS corrupt
  FROM documents""")
def corrupt_item_flags(t):
    docs = t.read("documents")
    bad = (docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 0")
           .select(F.col("source").alias("track")))
    items = docs.select(F.col("doc_id").alias("item"), F.concat_ws("_", "source", "doc_id").alias("key"))
    return S.corrupt_flag(items, bad, "key")


@query("split_rows", """SELECT part, count(*) AS n FROM (
    SELECT CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents) d
  JOIN (VALUES ('test', 'test'), ('train', 'train'), ('all', NULL)) p(part, want) ON want IS NULL OR want = split GROUP BY part""")
def split_rows(t):
    """The rows of one split, or of all."""
    items = t.read("documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"))
    parts = [S.split_filter(items, p).agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).alias("part"), "n") for p in ("test", "train", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("available_sources", """SELECT p_partkey AS source, p_brand AS instrument FROM part
  WHERE p_partkey % 7 <> 0 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)""")
def available_sources(t):
    """Sources that are approved and have files."""
    sources = t.read("part").select(F.col("p_partkey").alias("source"), F.col("p_brand").alias("brand"), F.col("p_partkey").alias("instrument"),
                                    F.when(F.col("p_partkey") % 7 == 0, "pending_approval").alias("status"))
    listing = t.read("lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("instrument"))
    return S.available_sources(sources, listing).select("source", F.col("brand").alias("instrument"))


@query("song_id_collisions", """SELECT song, contents, items, splits FROM (SELECT doc_id % 300 AS song, count(DISTINCT sha256(text)) AS contents,
    count(*) AS items, string_agg(DISTINCT lang, ',' ORDER BY lang) AS splits FROM documents GROUP BY 1) c WHERE contents > 1""")
def song_id_collisions(t):
    """Song ids that stand for several contents."""
    items = t.read("documents").select((F.col("doc_id") % 300).alias("song"), F.sha2("text", 256).alias("content"), F.col("lang").alias("split"))
    return A.id_collisions(items)
