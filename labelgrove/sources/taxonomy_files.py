"""Taxonomy and rule-table readers: every problem of a file is reported at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelgrove.functions.text import as_list
from labelgrove.operators.taxonomy import MAX_LEVEL, closure, level_of, parent_of

SEMVER = "^[0-9]+\\.[0-9]+\\.[0-9]+$"
NODE_ID = "^[a-z0-9_]+([.][a-z0-9_]+)*$"
TAXONOMY_DOC = ("version string, nodes array<struct<id: string, name: string, data: array<string>, "
                "planned: array<string>, note: string>>")


def read_taxonomy_entries(spark: SparkSession, path: str) -> DataFrame:
    """(version, ord, node, name, data, planned, note) in file order, unchecked."""
    doc = spark.read.schema(TAXONOMY_DOC).json(path, multiLine=True)
    none = F.array().cast("array<string>")
    return doc.select("version", F.posexplode("nodes").alias("ord", "n")).select(
        "version", "ord", F.col("n.id").alias("node"), F.coalesce("n.name", "n.id").alias("name"),
        F.coalesce("n.data", none).alias("data"), F.coalesce("n.planned", none).alias("planned"),
        "n.note")


def taxonomy_errors(entries: DataFrame) -> DataFrame:
    """(node, error) for bad ids, duplicates, depth, parent order, misplaced or missing sources,
    and a version that is not X.Y.Z."""
    first = entries.groupBy("node").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"))
    good = entries.where(F.rlike("node", F.lit(NODE_ID)))
    sourced = F.size("data") + F.size("planned") > 0
    parents = first.select(F.col("node").alias("parent"), F.col("ord").alias("parent_ord"))
    placed = good.withColumn("parent", parent_of("node")).join(parents, "parent", "left")
    kids = good.select(parent_of("node").alias("node")).where("node is not null").distinct()
    inner = good.join(kids.withColumn("inner", F.lit(True)), "node", "left")

    def found(df: DataFrame, cond: Column, error: str) -> DataFrame:
        return df.where(cond).select("node", F.lit(error).alias("error"))

    checks = [
        found(entries, ~F.rlike("node", F.lit(NODE_ID)), "bad id"),
        found(first, F.col("n") > 1, "duplicate node"),
        found(good, level_of("node") > MAX_LEVEL, "too deep"),
        found(placed, F.col("parent").isNotNull() & (
            F.col("parent_ord").isNull() | (F.col("parent_ord") > F.col("ord"))),
            "parent missing or listed after child"),
        found(inner, F.col("inner").isNotNull() & sourced, "sources only on leaves"),
        found(inner, F.col("inner").isNull() & ~sourced, "leaf without source"),
        found(entries.select("version").distinct().withColumn("node", F.lit(None).cast("string")),
              ~F.coalesce(F.rlike("version", F.lit(SEMVER)), F.lit(False)), "bad version")]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def taxonomy_nodes(entries: DataFrame) -> DataFrame:
    """Node table, failing if any check does. The error list is as small as the taxonomy."""
    errors = taxonomy_errors(entries)
    text = errors.agg(F.array_join(F.array_sort(F.collect_list(
        F.concat_ws(": ", "node", "error"))), "; ")).scalar()
    kids = entries.select(parent_of("node").alias("node")).where("node is not null").distinct()
    nodes = entries.join(kids.withColumn("inner", F.lit(True)), "node", "left").withColumn("bad", text)
    ok = F.when(F.col("bad") == "", F.col("node")).otherwise(
        F.raise_error(F.concat(F.lit("invalid taxonomy: "), F.col("bad"))))
    return nodes.select(ok.alias("node"), "name", parent_of("node").alias("parent"),
                        level_of("node").alias("level"), "ord", F.col("inner").isNull().alias("is_leaf"),
                        "data", "planned", "note")


RULE_ROW = "source string, table string, label string, spec string"
RULE_KEYS = ("node", "children_unknown", "unknown", "stem_unknown", "reason")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from JSON lines {source, table, label, spec}; `spec` is a node, a list or an object.

    Tables named `*ignore` hold ignored labels.
    """
    return parse_rules(spark.read.schema(RULE_ROW).json(path))


def parse_rules(rows: DataFrame) -> DataFrame:
    """(source, label, nodes, children_unknown, unknown, stem_unknown, ignored, reason, keys)."""
    is_object = F.startswith(F.trim("spec"), F.lit("{"))
    obj = F.when(is_object, F.col("spec"))
    def get(k: str) -> Column:
        return F.get_json_object(obj, f"$.{k}")

    none = F.array().cast("array<string>")
    ignored = F.endswith("table", F.lit("ignore"))
    nodes = F.when(ignored, none).when(is_object, as_list(get("node"))).otherwise(as_list(F.col("spec")))
    return rows.select(
        "source", "label", nodes.alias("nodes"),
        get("children_unknown").cast("boolean").alias("children_unknown"),
        as_list(get("unknown")).alias("unknown"), as_list(get("stem_unknown")).alias("stem_unknown"),
        ignored.alias("ignored"), get("reason").alias("reason"),
        F.coalesce(F.json_object_keys(obj), none).alias("keys"))


def rule_errors(rules: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, label, error): unknown nodes, both mapped and ignored, stray keys, missing parts."""
    named = rules.select("source", "label", F.explode(F.concat("nodes", "unknown", "stem_unknown"))
                         .alias("node")).where("node <> '*'")
    unknown = named.join(nodes.select("node"), "node", "left_anti").select(
        "source", "label", F.concat(F.lit("unknown node "), F.col("node")).alias("error"))
    both = (rules.groupBy("source", "label").agg(F.count_distinct("ignored").alias("k"))
            .where("k > 1").select("source", "label", F.lit("mapped and ignored").alias("error")))
    ignored = F.col("ignored")
    allowed = F.when(ignored, F.array(*map(F.lit, ("reason", "unknown", "stem_unknown")))).otherwise(
        F.array(*map(F.lit, ("node", "children_unknown", "unknown"))))

    def found(cond: Column, error: str) -> DataFrame:
        return rules.where(cond).select("source", "label", F.lit(error).alias("error"))

    return (unknown.unionByName(both)
            .unionByName(found(F.size(F.array_except("keys", allowed)) > 0, "unexpected keys"))
            .unionByName(found(~ignored & ((F.size("nodes") == 0) | F.array_contains("nodes", "*")),
                               "node must name taxonomy ids"))
            .unionByName(found(ignored & F.coalesce(F.col("reason") == "", F.lit(True)),
                               "ignore needs a reason")))


def mask_errors(roots: DataFrame, rules: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, error) of dataset-wide masks: unknown node, missing reason, not level 1, or a rule
    that targets the masked subtree."""
    missing = roots.join(nodes.select("node"), "node", "left_anti").select(
        "node", F.lit("unknown node").alias("error"))
    reason = roots.where(F.coalesce(F.col("reason") == "", F.lit(True))).select(
        "node", F.lit("missing reason").alias("error"))
    level = roots.where(level_of("node") != 1).select("node", F.lit("not level 1").alias("error"))
    targets = rules.select(F.explode(F.concat("nodes", "unknown", "stem_unknown")).alias("node"))
    hit = (targets.join(closure(nodes), "node").select(F.col("ancestor").alias("node"))
           .join(roots.select("node"), "node", "left_semi").distinct()
           .select("node", F.lit("rule targets masked subtree").alias("error")))
    return missing.unionByName(reason).unionByName(level).unionByName(hit)


def require_same_major(rules_version: Column, taxonomy_version: Column) -> Column:
    """The rules' version, failing when its major part differs from the taxonomy's."""
    same = (F.substring_index(rules_version, ".", 1)
            == F.substring_index(taxonomy_version, ".", 1))
    return F.when(same, rules_version).otherwise(
        F.raise_error(F.lit("rules and taxonomy have different major versions")))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of small configuration files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
