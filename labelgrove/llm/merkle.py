"""Merkle manifest of a document table: proofs from nested intervals of leaf ranks.

Each row is a leaf of the tree of its language; the subroots of the trees are the leaves of one more
tree. A node is labelled with the interval [lo, hi) of the leaf ranks it covers, so one node is an
ancestor of another exactly if its interval contains the other's. Nodes of a level have equal widths:
the parent of a node lies in the bucket `lo div width`, which makes the containment join an equi-join
with one parent per bucket, however large a tree is. Within a parent, the members left over when a
node's own interval is taken away are its siblings.

Proofs are attached downwards, level by level: a node inherits its parent's siblings up to the root, so
only the last join has a row per leaf. No level is gathered anywhere; a node sees its ARITY children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelgrove.llm.common import prepare, stored
from labelgrove.operators.ranges import ranked

ARITY = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEPS = "array<struct<left:binary,right:binary>>"


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def as_hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(text: Column | None = None) -> Column:
    columns = [F.col(c) for c in FIELDS[:-1]] + [F.col("text") if text is None else text]
    return digest(F.concat(*[encoded(c) for c in columns]))


def joined(members: Column) -> Column:
    """Hex digests of member nodes, left to right."""
    return F.array_join(F.transform(members, lambda m: as_hex(m["hash"])), "")


def leaves(documents: DataFrame) -> DataFrame:
    """(tree, doc_id, hash, altered): the altered leaf is that of the tampered copy, or null."""
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(picked & F.col("text").isNotNull(), leaf_digest(F.translate("text", UPPER, LOWER)))
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    return documents.select(*FIELDS).select(tree.alias("tree"), "doc_id", leaf_digest().alias("hash"), tampered.alias("altered"))


def labelled(rows: DataFrame, order: list[str]) -> DataFrame:
    """Leaves with their intervals (lo, hi) in `order` and the number n of their tree's leaves."""
    return ranked(rows, ["tree"], order, "lo", "n").withColumn("hi", F.col("lo") + 1)


def levels_above(bottom: DataFrame) -> list[DataFrame]:
    """Nodes (tree, lo, hi, n, hash, members) of each level, up to the roots; a lone leaf is a root."""
    largest = bottom.agg(F.max("n")).first()[0] or 0
    out, width, below = [], 1, bottom
    while width < largest:
        width *= ARITY
        member = F.struct("lo", "hi", "hash").alias("m")
        groups = below.where(F.col("hi") - F.col("lo") < F.col("n")).groupBy(
            "tree", "n", F.floor(F.col("lo") / width).alias("bucket")).agg(F.array_sort(F.collect_list(member)).alias("members"))
        below = stored(groups.select(
            "tree", "n", F.col("members")[0]["lo"].alias("lo"), F.element_at("members", -1)["hi"].alias("hi"),
            digest(joined(F.col("members"))).alias("hash"), "members"), "level")
        out.append(below)
    return out


def is_root() -> Column:
    return F.col("hi") - F.col("lo") == F.col("n")


def _attach(children: DataFrame, parents: DataFrame | None, width: int, above: DataFrame) -> DataFrame:
    """`children` with `up` (subroot, root and the siblings of every step up to the root): roots take
    it from `above(tree, up)`, others from the parent of the given width that contains them."""
    cols = children.columns
    tops = children.where(is_root()).join(above, "tree").select(*cols, F.struct(
        F.col("hash").alias("subroot"), F.col("up.root").alias("root"), F.col("up.steps").alias("steps")).alias("up"))
    if parents is None:
        return tops
    p = parents.select(F.col("tree").alias("p_tree"), F.floor(F.col("lo") / width).alias("p_bucket"), F.col("lo").alias("p_lo"),
                       F.col("hi").alias("p_hi"), F.col("members").alias("p_members"), F.col("up").alias("p_up"))
    inside = ((F.col("tree") == F.col("p_tree")) & (F.floor(F.col("lo") / width) == F.col("p_bucket"))
              & (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi")))

    def rest(outside) -> Column:
        return F.unhex(joined(F.filter("p_members", outside)))
    step = F.struct(rest(lambda m: m["hi"] <= F.col("lo")).alias("left"), rest(lambda m: m["lo"] >= F.col("hi")).alias("right"))
    below = children.where(~is_root()).join(p, inside).select(*cols, F.struct(
        F.col("p_up.subroot").alias("subroot"), F.col("p_up.root").alias("root"),
        F.concat(F.array(step), F.col("p_up.steps")).alias("steps")).alias("up"))
    return tops.unionByName(below)


def attached(bottom: DataFrame, levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves `bottom` with `up`, from what lies `above` the root of each tree."""
    nodes = None
    for i in range(len(levels), -1, -1):
        nodes = _attach(levels[i - 1] if i else bottom, nodes, ARITY ** (i + 1), above)
    return nodes


def folded(leaf: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate("up.steps", as_hex(leaf), lambda node, s: F.sha2(
        F.concat(as_hex(s["left"]), node, as_hex(s["right"])).cast("binary"), 256))


def manifest(documents: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row.

    Null values are encoded as `-`; a null language is a tree of its own and comes first. Null ids come
    first in their tree and are never tampered with. Rows that share an id are leaves each, in the order
    of their digests; rows repeated whole are interchangeable. A text that is null stays null, an empty
    one is tampered into itself. No row, no manifest. Other columns are ignored.
    """
    prepare(documents.sparkSession)
    bottom = labelled(stored(leaves(documents), "leaves"), ["doc_id", "hash"])
    levels = levels_above(bottom)
    roots = bottom.where(is_root()).select("tree", "hash")
    for level in levels:
        roots = roots.unionByName(level.where(is_root()).select("tree", "hash"))
    forest = labelled(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash"), ["name"])
    forest_levels = levels_above(forest)
    top = (forest_levels[-1] if forest_levels else forest).where(is_root())
    no_steps = F.array().cast(_STEPS)
    above = top.select("tree", F.struct(F.col("hash").alias("root"), no_steps.alias("steps")).alias("up"))
    trees = stored(attached(forest, forest_levels, above).select(
        F.col("name").alias("tree"), F.struct("up.root", "up.steps").alias("up")), "forest")
    proof = F.aggregate("up.steps", F.lit(""), lambda all_, s: F.concat(all_, as_hex(s["left"]), as_hex(s["right"])))
    out = attached(bottom, levels, trees).select(
        "doc_id", as_hex(F.col("hash")).alias("leaf"), as_hex(F.col("up.subroot")).alias("subroot"),
        as_hex(F.col("up.root")).alias("root"), F.sha2(proof.cast("binary"), 256).alias("proof_sha256"),
        folded(F.coalesce("altered", "hash")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
