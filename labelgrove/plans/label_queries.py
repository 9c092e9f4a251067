"""Label algebra on orders (items) whose part types are the source labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrove.operators import labels as L
from labelgrove.operators import taxonomy as T
from labelgrove.plans.catalog import query
from labelgrove.plans.standins import (CUSTOMER_LEAF, ORDER_TYPES, PLACE_NODES, PLACES, TREE_NODES,
                                       TYPE_EFFECTS, observed_sql, up_sql)


def per_item(labels: DataFrame) -> DataFrame:
    """Compact, order-free view of a label table: one row per item."""
    return labels.groupBy("item").agg(
        F.count(F.lit(1)).alias("n_observed"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("y"), F.col("node")))), ","
                     ).alias("positive"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("y"), F.col("node")))), ","
                     ).alias("negative"))


def per_item_sql(labels: str) -> str:
    return f"""SELECT item, count(*) AS n_observed,
      coalesce(string_agg(node, ',' ORDER BY node) FILTER (WHERE y), '') AS positive,
      coalesce(string_agg(node, ',' ORDER BY node) FILTER (WHERE NOT y), '') AS negative
    FROM ({labels}) l GROUP BY item"""


EFFECT_ROWS = f"""SELECT o.item, o.label, coalesce(e.kind, 'unknown') AS kind,
    coalesce(e.node, '*') AS node
  FROM ({ORDER_TYPES}) o LEFT JOIN ({TYPE_EFFECTS}) e ON o.label = e.label"""
POS = up_sql(f"SELECT item, node FROM ({EFFECT_ROWS}) e WHERE kind = 'positive'")
UNK = f"SELECT item, node FROM ({EFFECT_ROWS}) e WHERE kind = 'unknown'"
OBSERVED = observed_sql(ORDER_TYPES, POS, UNK)


@query("label_resolution", f"""SELECT kind, node, count(*) AS n_items FROM (
    SELECT item, 'positive' AS kind, node FROM ({POS}) p UNION
    SELECT item, kind, node FROM ({EFFECT_ROWS}) e WHERE kind <> 'positive') r GROUP BY 1, 2""")
def label_resolution(t):
    effects = L.rule_effects(t.type_rules(), t.place_nodes())
    return L.resolve(t.order_types(), effects).groupBy("kind", "node").agg(
        F.count(F.lit(1)).alias("n_items"))


@query("unmapped_labels", f"""SELECT label, count(*) AS n FROM ({ORDER_TYPES}) o
  WHERE label NOT IN (SELECT label FROM ({TYPE_EFFECTS}) e) GROUP BY label""")
def unmapped_labels(t):
    return L.unmapped_labels(t.order_types(), L.rule_effects(t.type_rules(), t.place_nodes()))


def order_labels(t) -> DataFrame:
    effects = L.rule_effects(t.type_rules(), t.place_nodes())
    return L.exhaustive_labels(t.order_types(), effects, t.place_nodes())


@query("observed_exhaustive", per_item_sql(OBSERVED))
def observed_exhaustive(t):
    return per_item(order_labels(t))


@query("dataset_wide_mask", per_item_sql(f"""SELECT * FROM ({OBSERVED}) o
  WHERE y OR NOT (node = 'africa' OR starts_with(node, 'africa.'))"""))
def dataset_wide_mask(t):
    roots = t.place_nodes().where("node = 'africa'").select("node")
    return per_item(L.apply_unobserved(order_labels(t), roots, t.place_nodes()))


STEM = """SELECT l_orderkey AS item, l_linenumber % 2 AS stem, p_type AS label
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R'"""
RAW = """SELECT l_orderkey AS item, l_linenumber % 2 AS stem,
    CASE WHEN l_linenumber % 3 = 0 THEN p_type ELSE p_brand END AS label
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'"""
BOTH_EFFECTS = f"""{TYPE_EFFECTS} UNION ALL
  SELECT 'Brand#' || (n_nationkey + 1), 'positive', node FROM ({PLACES}) p"""
REFINED = f"""WITH stem AS (SELECT DISTINCT * FROM ({STEM}) s),
  raw0 AS (SELECT DISTINCT * FROM ({RAW}) r), eff AS ({BOTH_EFFECTS}),
  base AS (SELECT s.item, s.stem, coalesce(kind, 'unknown') AS kind, coalesce(node, '*') AS node
    FROM stem s LEFT JOIN eff e USING (label)),
  mapped AS (SELECT DISTINCT item, stem, node FROM base WHERE kind = 'positive'),
  raw AS (SELECT r.* FROM raw0 r WHERE EXISTS (SELECT 1 FROM stem s WHERE s.item = r.item
      AND s.stem = r.stem) AND NOT EXISTS (SELECT 1 FROM stem s WHERE s.item = r.item
      AND s.stem = r.stem AND s.label = r.label)),
  extra AS (SELECT r.item, r.stem, coalesce(kind, 'unknown') AS kind, coalesce(node, '*') AS node
    FROM raw r LEFT JOIN eff e USING (label)),
  cand AS (SELECT DISTINCT item, stem, node FROM extra WHERE kind = 'positive'),
  judged AS (SELECT c.*, EXISTS (SELECT 1 FROM mapped m WHERE m.item = c.item AND m.stem = c.stem
      AND (m.node = c.node OR starts_with(c.node, m.node || '.'))) AS inside FROM cand c),
  allrows AS (SELECT *, false AS outside FROM base
    UNION ALL SELECT *, false FROM extra WHERE kind = 'unknown'
    UNION ALL SELECT *, false FROM extra x WHERE kind = 'stem_unknown' AND (node = '*' OR
      NOT EXISTS (SELECT 1 FROM mapped m WHERE m.item = x.item AND m.stem = x.stem))
    UNION ALL SELECT item, stem, 'positive', node, false FROM judged WHERE inside
    UNION ALL SELECT item, stem, 'unknown', node, true FROM judged WHERE NOT inside
    UNION ALL SELECT item, stem, 'unknown', '*', false FROM raw0 r WHERE NOT EXISTS
      (SELECT 1 FROM stem s WHERE s.item = r.item AND s.stem = r.stem)),
  closed AS (SELECT item, stem, kind, unnest(CASE WHEN kind = 'positive'
      THEN [split_part(node, '.', 1), node] ELSE [node] END) AS node, outside FROM allrows)
  SELECT item, stem, kind, node, bool_or(outside) AS outside FROM closed GROUP BY ALL"""


def refined(t) -> DataFrame:
    rules = t.type_rules().unionByName(t.brand_rules())
    effects = L.rule_effects(rules, t.place_nodes())
    base = t.lines().select(F.col("l_orderkey").alias("item"), "p_type", "p_brand",
                            "l_linenumber", "l_returnflag",
                            (F.col("l_linenumber") % 2).alias("stem"))
    stem = base.where("l_returnflag <> 'R'").select("item", "stem", F.col("p_type").alias("label"))
    raw = base.where("l_returnflag = 'R'").select(
        "item", "stem", F.when(F.col("l_linenumber") % 3 == 0, F.col("p_type"))
        .otherwise(F.col("p_brand")).alias("label"))
    return L.refine_raw(stem, raw, effects)


@query("raw_label_refinement", f"""SELECT item, stem, kind,
    string_agg(node, ',' ORDER BY node) AS nodes, count(*) FILTER (WHERE outside) AS n_outside
  FROM ({REFINED}) r GROUP BY 1, 2, 3""")
def raw_label_refinement(t):
    return refined(t).groupBy("item", "stem", "kind").agg(
        F.array_join(F.array_sort(F.collect_list("node")), ",").alias("nodes"),
        F.count_if("outside").alias("n_outside"))


@query("track_union_over_stems", f"""SELECT kind, node, count(*) AS n_items FROM (
    SELECT DISTINCT item, kind, node FROM ({REFINED}) r WHERE kind <> 'stem_unknown') u
  GROUP BY 1, 2""")
def track_union_over_stems(t):
    return L.union_tracks(refined(t)).groupBy("kind", "node").agg(
        F.count(F.lit(1)).alias("n_items"))


PROBS = f"""SELECT l_orderkey AS item, node AS cls, max(l_quantity) / 50 AS prob,
    bool_or(l_linenumber % 2 = 1) AS observed
  FROM lineitem JOIN (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN split_part(node, '.', 1)
      ELSE node END AS node FROM ({PLACES}) x) p ON l_suppkey % 25 = n_nationkey GROUP BY 1, 2"""


@query("partial_clip_labels", per_item_sql(f"""WITH j AS (SELECT item, cls AS node, prob >= 0.5 AS y
    FROM ({PROBS}) c WHERE observed),
  pos AS ({up_sql('SELECT item, node FROM j WHERE y')}),
  neg AS (SELECT DISTINCT j.item, n.node FROM j JOIN ({PLACE_NODES}) n
    ON n.node = j.node OR starts_with(n.node, j.node || '.')
    WHERE NOT j.y AND NOT (n.node = 'asia' OR starts_with(n.node, 'asia.')))
  SELECT item, node, true AS y FROM pos UNION ALL
  SELECT n.item, n.node, false FROM neg n WHERE NOT EXISTS
    (SELECT 1 FROM pos p WHERE p.item = n.item AND p.node = n.node)"""))
def partial_clip_labels(t):
    classes = t.places().select("n_nationkey", F.when(
        F.col("n_nationkey") % 2 == 0, T.family_of("node")).otherwise(F.col("node")).alias("cls"))
    probs = (t.read("lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_linenumber")
             .join(classes, F.col("l_suppkey") % 25 == F.col("n_nationkey"))
             .groupBy(F.col("l_orderkey").alias("item"), "cls")
             .agg((F.max("l_quantity") / 50).alias("prob"),
                  F.bool_or(F.col("l_linenumber") % 2 == 1).alias("observed")))
    nodes = t.place_nodes()
    class_map = nodes.select(F.col("node").alias("cls"), "node")
    masked = nodes.where("node = 'asia'").select("node")
    return per_item(L.partial_labels(probs, class_map, nodes, masked))


STATES = f"""SELECT l_orderkey AS item, p.node,
    CASE min(l_linenumber % 3) WHEN 0 THEN 'present' WHEN 1 THEN 'unsure' ELSE 'absent' END AS state
  FROM lineitem JOIN (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN split_part(node, '.', 1)
      ELSE node END AS node FROM ({PLACES}) x) p ON l_suppkey % 25 = n_nationkey GROUP BY 1, 2"""


@query("hand_label_semantics", per_item_sql(f"""WITH st AS ({STATES}),
  items AS (SELECT o_orderkey AS item, o_orderstatus <> 'P' AS full_ FROM orders
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
  nodes AS ({PLACE_NODES}),
  pos AS ({up_sql("SELECT item, node FROM st WHERE state = 'present'")}),
  untyped AS (SELECT s.item, n.node FROM st s JOIN items i ON i.item = s.item AND i.full_
    JOIN nodes n ON starts_with(n.node, s.node || '.') WHERE s.state IN ('present', 'unsure')
    AND NOT EXISTS (SELECT 1 FROM pos p WHERE p.item = s.item AND starts_with(p.node, s.node || '.'))),
  unheard AS (SELECT i.item, n.node FROM items i, nodes n WHERE NOT i.full_ AND n.node LIKE '%.%'
    AND NOT EXISTS (SELECT 1 FROM st s WHERE s.item = i.item AND s.node = n.node
      AND s.state = 'present')),
  hid AS ({up_sql('''SELECT s.item, s.node FROM st s JOIN items i ON i.item = s.item
      WHERE i.full_ AND s.state = 'unsure'
      UNION ALL SELECT * FROM untyped UNION ALL SELECT * FROM unheard''')})
  SELECT i.item, n.node, p.item IS NOT NULL AS y FROM items i CROSS JOIN nodes n
  LEFT JOIN pos p ON p.item = i.item AND p.node = n.node
  LEFT JOIN hid h ON h.item = i.item AND h.node = n.node
  WHERE p.item IS NOT NULL OR h.item IS NULL"""))
def hand_label_semantics(t):
    leaves = t.places().select("n_nationkey", F.when(
        F.col("n_nationkey") % 3 == 0, T.family_of("node")).otherwise(F.col("node")).alias("node"))
    lines = t.read("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    kind = F.min(F.col("l_linenumber") % 3)
    states = (lines.join(leaves, F.col("l_suppkey") % 25 == F.col("n_nationkey"))
              .groupBy(F.col("l_orderkey").alias("item"), "node")
              .agg(F.when(kind == 0, "present").when(kind == 1, "unsure").otherwise("absent")
                   .alias("state")))
    items = (t.read("orders").select(F.col("o_orderkey").alias("item"),
                                     (F.col("o_orderstatus") != "P").alias("listened_fully"))
             .join(lines.select(F.col("l_orderkey").alias("item")), "item", "left_semi"))
    return per_item(L.hand_labels(items, states, t.place_nodes()))


TRACKS = """SELECT l_orderkey AS clip, l_linenumber, p_type AS type, l_returnflag = 'R' AS bleed,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Rap' WHEN '2-HIGH' THEN 'electronic' ELSE 'pop' END
      AS genre, CASE WHEN l_tax > 0 THEN -1.2 * l_quantity END AS rms_db,
    CASE WHEN l_tax > 0 THEN -1.6 * l_quantity END AS peak_frame_db
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey"""
ACTIVITY = f"""SELECT *, CASE WHEN rms >= -50 AND rms >= loud - 35 THEN 'active'
      WHEN peak < -70 THEN 'silent' ELSE 'uncertain' END AS state
  FROM (SELECT *, max(rms) OVER (PARTITION BY clip) AS loud FROM (
    SELECT *, coalesce(rms_db, '-infinity'::DOUBLE) AS rms,
      coalesce(peak_frame_db, '-infinity'::DOUBLE) AS peak FROM ({TRACKS}) t) u) v"""


def clip_tracks(t) -> DataFrame:
    orders = t.read("orders").select("o_orderkey", "o_orderpriority")
    urgent, high = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "2-HIGH"
    loud = F.col("l_tax") > 0
    return (t.lines().join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("l_orderkey").alias("clip"), "l_linenumber", F.col("p_type").alias("type"),
                    (F.col("l_returnflag") == "R").alias("bleed"),
                    F.when(urgent, "Rap").when(high, "electronic").otherwise("pop").alias("genre"),
                    F.when(loud, -1.2 * F.col("l_quantity")).alias("rms_db"),
                    F.when(loud, -1.6 * F.col("l_quantity")).alias("peak_frame_db")))


@query("activity_states", f"""SELECT clip, type, state, count(*) AS n FROM ({ACTIVITY}) a
  GROUP BY 1, 2, 3""")
def activity_states(t):
    return L.activity_states(clip_tracks(t)).groupBy("clip", "type", "state").agg(
        F.count(F.lit(1)).alias("n"))


CONTEXT = L.ContextVocabulary(
    full_kit="STANDARD", overheads="MEDIUM", drum_machine="PROMO", close_mics=("ECONOMY",),
    vocals=("LARGE",), vocal_node="europe", kit_node="asia", kit_unknown=("asia.nation_2",),
    always_unknown="middle_east", constant_mask=("africa.nation_5",))
CTX_FACTS = f"""WITH a AS ({ACTIVITY}), f AS (SELECT clip, bool_or(genre = 'Rap') AS rap,
    (bool_or(type = 'PROMO' AND state <> 'silent') OR bool_or(genre IN ('Rap', 'electronic')))
    AND NOT bool_or(type IN ('STANDARD', 'MEDIUM') AND state = 'active' AND NOT bleed) AS amb
    FROM a GROUP BY clip),
  b AS (SELECT clip, type, bool_and(bleed) AS bleed_only FROM a GROUP BY 1, 2),
  eff AS ({TYPE_EFFECTS}),
  r AS (SELECT a.clip AS item, a.type, state, bleed_only, rap, amb,
      state = 'active' AND NOT bleed AS clean FROM a JOIN f USING (clip)
    JOIN b ON a.clip = b.clip AND a.type = b.type),
  e AS (SELECT item, 'unknown' AS kind, eff.node FROM r JOIN eff ON eff.label = r.type
      WHERE bleed_only AND eff.kind <> 'stem_unknown'
    UNION ALL SELECT item, 'unknown', '*' FROM r WHERE type = 'SMALL' AND state <> 'silent'
    UNION ALL SELECT item, CASE WHEN clean THEN v.kind ELSE 'unknown' END, v.node FROM r,
      (VALUES ('positive', 'europe'), ('unknown', 'europe')) v(kind, node)
      WHERE NOT bleed_only AND state <> 'silent' AND rap AND type = 'LARGE'
    UNION ALL SELECT item, CASE WHEN clean THEN v.kind ELSE 'unknown' END, v.node FROM r,
      (VALUES ('positive', 'asia'), ('unknown', 'asia.nation_2')) v(kind, node)
      WHERE NOT bleed_only AND state <> 'silent' AND amb AND type = 'ECONOMY'
    UNION ALL SELECT item, CASE WHEN clean THEN eff.kind ELSE 'unknown' END, eff.node
      FROM r JOIN eff ON eff.label = r.type WHERE eff.kind <> 'stem_unknown' AND NOT bleed_only
      AND state <> 'silent' AND NOT (rap AND type = 'LARGE') AND NOT (amb AND type = 'ECONOMY')
    UNION ALL SELECT clip, 'unknown', 'middle_east' FROM a)"""


@query("context_labels", CTX_FACTS + " " + per_item_sql(f"""SELECT * FROM ({observed_sql(
    'SELECT item FROM r', up_sql("SELECT item, node FROM e WHERE kind = 'positive'"),
    "SELECT item, node FROM e WHERE kind = 'unknown'")}) o
  WHERE y OR node <> 'africa.nation_5'"""))
def context_labels(t):
    tracks = L.activity_states(clip_tracks(t)).withColumnRenamed("clip", "item")
    effects = L.rule_effects(t.type_rules(), t.place_nodes())
    return per_item(L.context_labels(tracks, effects, t.place_nodes(), CONTEXT))


@query("solo_labels", per_item_sql(observed_sql(
    "SELECT l_orderkey AS item FROM lineitem",
    up_sql(f"""SELECT l_orderkey AS item, node FROM lineitem JOIN ({PLACES}) p
      ON l_suppkey % 25 = n_nationkey WHERE l_linenumber = 1"""),
    f"""SELECT l_orderkey AS item, split_part(node, '.', 1) AS node FROM lineitem
      JOIN ({PLACES}) p ON l_suppkey % 25 = n_nationkey WHERE l_linenumber = 2
      AND NOT EXISTS (SELECT 1 FROM lineitem b JOIN ({PLACES}) q ON b.l_suppkey % 25 = q.n_nationkey
        WHERE b.l_orderkey = lineitem.l_orderkey AND b.l_linenumber = 1
        AND split_part(q.node, '.', 1) = split_part(p.node, '.', 1))""")))
def solo_labels(t):
    lines = (t.read("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
             .join(t.places(), F.col("l_suppkey") % 25 == F.col("n_nationkey"))
             .select(F.col("l_orderkey").alias("item"), "node", "l_linenumber"))
    pos = lines.where("l_linenumber = 1").select("item", "node")
    unk = lines.where("l_linenumber = 2").select("item", T.family_of("node").alias("node"))
    items = t.read("lineitem").select(F.col("l_orderkey").alias("item"))
    return per_item(L.solo_labels(items, pos, unk, t.place_nodes()))


# ---- the tree itself
TREE = f"""SELECT node, len(string_split(node, '.')) AS level FROM ({TREE_NODES}) n"""


@query("tree_summary", f"""WITH n AS ({TREE})
  SELECT a.node, CASE WHEN a.level > 1 THEN array_to_string(string_split(a.node, '.')[1:a.level - 1],
      '.') END AS parent, a.level,
    NOT bool_or(coalesce(d.level > a.level, false)) AS is_leaf,
    count(*) FILTER (WHERE d.level = a.level + 1) AS n_children,
    count(*) FILTER (WHERE d.level > a.level) AS n_descendants,
    count(*) FILTER (WHERE d.level = 3) AS n_leaves
  FROM n a JOIN n d ON d.node = a.node OR starts_with(d.node, a.node || '.') GROUP BY 1, 2, 3""")
def tree_summary(t):
    return T.tree_summary(t.tree_nodes())


@query("recursive_closure", f"""WITH RECURSIVE n AS ({TREE}), up(node, ancestor) AS (
    SELECT node, node FROM n UNION ALL
    SELECT up.node, array_to_string(string_split(ancestor, '.')[1:-2], '.') FROM up
    WHERE contains(ancestor, '.'))
  SELECT ancestor, count(*) AS n_below FROM up GROUP BY 1""")
def recursive_closure(t):
    return T.recursive_closure(t.tree_nodes()).groupBy("ancestor").agg(
        F.count(F.lit(1)).alias("n_below"))


@query("subtree_closure", f"""SELECT DISTINCT c_custkey AS item, n.node
  FROM ({CUSTOMER_LEAF}) c JOIN ({TREE_NODES}) n
    ON n.node = split_part(c.node, '.', 1) || '.' || split_part(c.node, '.', 2)
    OR starts_with(n.node, split_part(c.node, '.', 1) || '.' || split_part(c.node, '.', 2) || '.')""")
def subtree_closure(t):
    roots = t.customer_leaf().select(F.col("c_custkey").alias("item"),
                                     T.parent_of("node").alias("node"))
    return T.close_downward(roots, ["item"], T.closure(t.tree_nodes()))
