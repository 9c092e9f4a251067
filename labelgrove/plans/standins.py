"""Domain frames (labels, scores, groups, frames, notes, ...) built from the driver tables.

Each builder has a SQL twin with the same columns, so every operator can be checked on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelgrove.operators.taxonomy import ancestors_of, nodes_from_ids
from labelgrove.session import work_folder
from labelgrove.sources.literal import small_table


def slug(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.replace(c, F.lit(" "), F.lit("_")))


_SCHEMAS: dict[str, object] = {}


class Tables:
    """Lazy access to the tables of one folder plus the frames derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        """The table, with its schema inferred only once per path."""
        path = f"{self.folder}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """`df` written once to the shared checkpoint folder and read back, for plans that read it
        several times (a run's labels and scores are stored tables in practice)."""
        path = work_folder(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    # ---- flat multi-label evaluation: documents with two partly observed labels
    def flat_obs(self) -> DataFrame:
        labels = self.read("labels").selectExpr(
            "doc_id as item", "stack(2, 'quality', quality, 'toxic', toxic) as (node, flag)")
        return (labels.join(self.flat_items(), "item")
                .select("item", "node", (F.col("flag") == 1).alias("y"), "score", "grp"))

    def flat_items(self) -> DataFrame:
        return self.read("documents").select(
            F.col("doc_id").alias("item"), F.col("source").alias("grp"),
            ((F.col("n_chars") % 1000) / 1000.0).alias("score"))

    # ---- hierarchical evaluation: parts scored on region.nation.segment leaves
    def customer_leaf(self) -> DataFrame:
        places = self.read("nation").join(
            self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return (self.read("customer")
                .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
                .select("c_custkey", F.concat_ws(".", slug("r_name"), slug("n_name"),
                                                 slug("c_mktsegment")).alias("node")))

    def order_leaf(self) -> DataFrame:
        return (self.read("orders").select("o_orderkey", "o_custkey")
                .join(self.customer_leaf(), F.col("o_custkey") == F.col("c_custkey"))
                .select("o_orderkey", "node"))

    def _line_groups(self) -> DataFrame:
        """Line facts with the nation key and segment of their customer; names come later."""
        lines = self.read("lineitem").select(
            "l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_returnflag")
        buyers = (self.read("orders").select("o_orderkey", "o_custkey")
                  .join(self.read("customer").select("c_custkey", "c_nationkey", "c_mktsegment"),
                        F.col("o_custkey") == F.col("c_custkey"))
                  .select("o_orderkey", "c_nationkey", "c_mktsegment"))
        return lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))

    def leaf_obs(self) -> DataFrame:
        """(item, node, y, score, score2) at leaf level; short keys are grouped, then named."""
        n = F.count(F.lit(1))
        per = self._line_groups().groupBy(
            F.col("l_partkey").alias("item"), "c_nationkey", "c_mktsegment").agg(
            F.bool_or(F.col("l_returnflag") == "R").alias("y"),
            (F.floor(F.sum("l_quantity") * 200.0 / n) / 10000.0).alias("score"),
            (F.floor(F.sum(F.round(F.col("l_discount") * 100).cast("long")) * 1000.0 / n)
             / 10000.0).alias("score2"))
        named = per.join(self.places(), F.col("c_nationkey") == F.col("n_nationkey"))
        return named.select("item", F.concat_ws(".", "node", slug("c_mktsegment")).alias("node"),
                            "y", "score", "score2")

    def tree_obs(self) -> DataFrame:
        """Leaf observations closed upward: y = any, scores = maximum below. Rows are shuffled by item
        before they are closed, so those of the ancestors are not."""
        return (self.leaf_obs().repartition("item").select("item", F.explode(ancestors_of("node")).alias("node"),
                                       "y", "score", "score2")
                .groupBy("item", "node").agg(F.bool_or("y").alias("y"),
                                             F.max("score").alias("score"),
                                             F.max("score2").alias("score2")))

    def tree_nodes(self) -> DataFrame:
        return nodes_from_ids(self.customer_leaf().select("node").distinct())

    def item_group(self) -> DataFrame:
        return self.read("part").select(F.col("p_partkey").alias("item"),
                                        F.col("p_brand").alias("grp"))

    # ---- label algebra: orders labelled by the types of their parts, over a region.nation tree
    def places(self) -> DataFrame:
        return (self.read("nation")
                .join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
                .select("n_nationkey", F.concat_ws(".", slug("r_name"), slug("n_name"))
                        .alias("node")))

    def place_nodes(self) -> DataFrame:
        return nodes_from_ids(self.places().select("node"))

    def type_rules(self) -> DataFrame:
        """Rule table over `p_type`; SMALL stays unmapped."""
        schema = ("label string, nodes array<string>, children_unknown boolean, "
                  "unknown array<string>, stem_unknown array<string>, ignored boolean, "
                  "reason string")
        return small_table(self.spark, [
            ("STANDARD", ["africa.nation_0"], None, [], [], False, None),
            ("ECONOMY", ["asia"], None, [], [], False, None),
            ("MEDIUM", ["america"], False, ["america.nation_1"], [], False, None),
            ("PROMO", [], None, ["europe.nation_3"], ["middle_east"], True, "mixed content"),
            ("LARGE", ["europe", "europe.nation_8"], None, [], [], False, None)], schema)

    def brand_rules(self) -> DataFrame:
        """Every brand maps to one nation leaf (used as the finer vocabulary of raw tracks)."""
        none = F.array().cast("array<string>")
        return self.places().select(
            F.concat(F.lit("Brand#"), (F.col("n_nationkey") + 1).cast("string")).alias("label"),
            F.array("node").alias("nodes"), F.lit(None).cast("boolean").alias("children_unknown"),
            none.alias("unknown"), none.alias("stem_unknown"), F.lit(False).alias("ignored"),
            F.lit(None).cast("string").alias("reason"))

    def lines(self) -> DataFrame:
        parts = self.read("part").select("p_partkey", "p_type", "p_brand")
        return (self.read("lineitem")
                .select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_tax",
                        "l_returnflag")
                .join(parts, F.col("l_partkey") == F.col("p_partkey")))

    def order_types(self) -> DataFrame:
        return self.lines().select(F.col("l_orderkey").alias("item"), F.col("p_type").alias("label"))

    def events(self) -> DataFrame:
        """Events with `ts` as an instant (UTC)."""
        return self.read("events").withColumn("ts", F.col("ts").cast("timestamp"))


FLAT_ITEMS = """SELECT doc_id AS item, source AS grp, (n_chars % 1000) / 1000.0 AS score
  FROM documents"""
FLAT_OBS = """SELECT d.doc_id AS item, l.node, l.flag = 1 AS y,
    CAST((d.n_chars % 1000) / 1000.0 AS DOUBLE) AS score, d.source AS grp
  FROM documents d JOIN (
    SELECT doc_id, 'quality' AS node, quality AS flag FROM labels
    UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) l ON l.doc_id = d.doc_id"""
CUSTOMER_LEAF = """SELECT c_custkey,
    lower(replace(r_name, ' ', '_')) || '.' || lower(replace(n_name, ' ', '_')) || '.'
      || lower(replace(c_mktsegment, ' ', '_')) AS node
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey"""
LEAF_OBS = f"""SELECT l_partkey AS item, node, bool_or(l_returnflag = 'R') AS y,
    floor(sum(l_quantity) * 200.0 / count(*)) / 10000.0 AS score,
    floor(CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) * 1000.0 / count(*))
      / 10000.0 AS score2
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN ({CUSTOMER_LEAF}) cl ON o_custkey = c_custkey GROUP BY 1, 2"""
TREE_OBS = f"""SELECT item, u.node, bool_or(y) AS y, max(score) AS score, max(score2) AS score2
  FROM ({LEAF_OBS}) lo, LATERAL (SELECT unnest([split_part(lo.node, '.', 1),
    split_part(lo.node, '.', 1) || '.' || split_part(lo.node, '.', 2), lo.node]) AS node) u
  GROUP BY 1, 2"""
TREE_NODES = f"""SELECT DISTINCT u.node FROM ({CUSTOMER_LEAF}) lo,
  LATERAL (SELECT unnest([split_part(lo.node, '.', 1),
    split_part(lo.node, '.', 1) || '.' || split_part(lo.node, '.', 2), lo.node]) AS node) u"""
LEVEL = "len(string_split(node, '.'))"


def ap_sql(source: str, keys: str = "node") -> str:
    """SQL for tie-aware AP per `keys` over a relation with (keys, y, score)."""
    part = f"PARTITION BY {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {head}CAST(sum(n) AS BIGINT) AS n_observed,
      CAST(sum(tp) AS BIGINT) AS n_positive,
      CASE WHEN sum(tp) = 0 THEN 'no_positives' WHEN sum(tp) = sum(n) THEN 'no_negatives' END
        AS skipped,
      CASE WHEN sum(tp) > 0 AND sum(tp) < sum(n)
        THEN sum(tp * cum_tp / cum_n) / sum(tp) END AS ap
    FROM (SELECT *, CAST(sum(tp) OVER w AS DOUBLE) AS cum_tp, sum(n) OVER w AS cum_n
      FROM (SELECT {head}score, count(*) AS n, count(*) FILTER (WHERE y) AS tp
            FROM ({source}) src GROUP BY {head}score) g
      WINDOW w AS ({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) c {group}"""

PLACES = """SELECT n_nationkey, lower(replace(r_name, ' ', '_')) || '.' ||
    lower(replace(n_name, ' ', '_')) AS node
  FROM nation JOIN region ON n_regionkey = r_regionkey"""
PLACE_NODES = f"""SELECT DISTINCT unnest([split_part(node, '.', 1), node]) AS node
  FROM ({PLACES}) p"""
# (label, kind, node) of the type rules, internal nodes already expanded
TYPE_EFFECTS = """SELECT * FROM (VALUES ('STANDARD', 'positive', 'africa.nation_0'),
    ('ECONOMY', 'positive', 'asia'), ('ECONOMY', 'unknown', 'asia'),
    ('MEDIUM', 'positive', 'america'), ('MEDIUM', 'unknown', 'america.nation_1'),
    ('PROMO', 'unknown', 'europe.nation_3'), ('PROMO', 'stem_unknown', 'middle_east'),
    ('LARGE', 'positive', 'europe'), ('LARGE', 'positive', 'europe.nation_8'),
    ('LARGE', 'unknown', 'europe')) e(label, kind, node)"""
ORDER_TYPES = """SELECT l_orderkey AS item, p_type AS label
  FROM lineitem JOIN part ON l_partkey = p_partkey"""
# roots hide their subtree and their ancestors (two-level tree)
PLACE_MASK = f"""SELECT r.node AS root, n.node FROM ({PLACE_NODES}) r, ({PLACE_NODES}) n
  WHERE n.node = r.node OR starts_with(n.node, r.node || '.') OR starts_with(r.node, n.node || '.')"""


def observed_sql(items: str, pos: str, unk: str, nodes: str = PLACE_NODES,
                 mask: str = PLACE_MASK) -> str:
    """SQL twin of `observed_exhaustive`: `pos(item, node)` closed, `unk(item, node)` roots."""
    return f"""SELECT i.item, n.node, p.item IS NOT NULL AS y
      FROM (SELECT DISTINCT item FROM ({items}) a) i CROSS JOIN ({nodes}) n
      LEFT JOIN (SELECT DISTINCT item, node FROM ({pos}) b) p
        ON p.item = i.item AND p.node = n.node
      LEFT JOIN (SELECT DISTINCT u.item, m.node FROM ({unk}) u JOIN ({mask}) m
        ON m.root = u.node) h ON h.item = i.item AND h.node = n.node
      LEFT JOIN (SELECT DISTINCT item FROM ({unk}) u WHERE u.node = '*') s ON s.item = i.item
      WHERE p.item IS NOT NULL OR (h.item IS NULL AND s.item IS NULL)"""


def up_sql(source: str) -> str:
    """Upward closure of (item, node) in a two-level tree."""
    return f"""SELECT DISTINCT item, unnest([split_part(node, '.', 1), node]) AS node
      FROM ({source}) up_src"""
