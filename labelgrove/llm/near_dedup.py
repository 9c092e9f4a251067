"""MinHash near-duplicate groups with tensored banding.

Two collections of sub-keys, each sub-key made of two MinHashes, are combined pairwise into table
keys: SUBKEYS**2 tables from 4 * SUBKEYS hashes. Two documents of similarity s meet in some table
with probability (1 - (1 - s**2) ** SUBKEYS) ** 2, which is 1 - 4e-6 at s = 0.75.

Steps: hash every text once; collapse equal sets; keep sub-keys that at least two sets share;
combine them into table keys; compare every set with the best-connected set it shares a table
with; group. Tables that then still hold several groups are searched for links across groups: two
sets of such similarity share a shingle among the rarest quarter of either (prefix filter), so no
table's pairs are ever listed. Sets around one centre share nearly all shingles; there the filter
takes what tells them from the centre in place of the shingles. Candidates are confirmed on the full
shingle sets, recomputed from the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelgrove.llm.common import doc_key, from_key, held, keyed_rows, keyed_texts, packed_texts, prepare, stored, unpack
from labelgrove.llm.components import connected_components
from labelgrove.llm.kernels import RUN_BASE, Words, mix, runs_hash, white_words, word_blocks

SHINGLE = 5
PERCENT = 75
#: Sub-keys in each of the two collections; each takes two MinHashes.
SUBKEYS = 16
HASHES = 4 * SUBKEYS
#: Shingles that one worker keeps while it confirms pairs.
KEPT_SHINGLES = 4_000_000
#: Rounds of comparisons across groups at most, and the share of links below which they end; what they leave
#: goes to the prefix filter.
ROUNDS, FEW = 16, 0.05
#: Tables of a document that serve a round; the same ones wherever they are shared.
TRIED = 16

_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a block and each document's bounds in them (repeats not yet removed)."""
    grams, at = words.grams(SHINGLE), words.whole(SHINGLE)
    counts = np.maximum(words.n - SHINGLE + 1, 0)
    short = np.flatnonzero((words.n > 0) & (words.n < SHINGLE))
    bounds = np.zeros(len(words.n) + 1, np.int64)
    counts[short] = 1
    np.cumsum(counts, out=bounds[1:])
    out = np.empty(bounds[-1], np.uint64)
    hole = np.zeros(len(out), bool)
    hole[bounds[short]] = True
    out[~hole] = grams[at]
    out[bounds[short]] = runs_hash(words.hash, words.bounds[short], words.bounds[short + 1], RUN_BASE)
    return out, bounds


def text_set(text: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    data = np.frombuffer(text, np.uint8)
    return np.unique(shingles(Words(data, np.array([0, len(data)]), white_words(), True))[0])


def _min_hashes(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(documents, HASHES) minima of seeded hashes, 32 bits each."""
    out = np.empty((len(starts), HASHES), np.uint64)
    for i, seed in enumerate(_SEEDS):
        h = (grams ^ seed) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, i] = np.minimum.reduceat(h, starts)
    return out >> np.uint64(32)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held("shingles", lambda: None)
    for batch in batches:
        docs = batch.column(0)
        for at, to, words in word_blocks(batch.column(1), fold=True):
            grams, bounds = shingles(words)
            full = np.flatnonzero(np.diff(bounds) > 0)
            n = np.zeros(to - at, np.int64)
            sums, keys = np.zeros((to - at, 2), np.uint64), np.zeros((to - at, 2 * SUBKEYS), np.uint64)
            if len(full):
                mins = _min_hashes(grams, bounds[full])
                keys[full] = mins[:, 0::2] << np.uint64(32) | mins[:, 1::2]
            for i in full:
                own = np.unique(grams[bounds[i]:bounds[i + 1]])
                n[i] = len(own)
                sums[i] = mix(own).sum(dtype=np.uint64), mix(own ^ _SEEDS[0]).sum(dtype=np.uint64)
            yield pa.record_batch([
                docs.slice(at, to - at), pa.array(n), pa.array(sums[:, 0].view(np.int64)),
                pa.array(sums[:, 1].view(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.arange(to - at + 1, dtype=np.int32) * (2 * SUBKEYS)),
                                         pa.array(keys.ravel().view(np.int64)))],
                ["doc", "n", "h1", "h2", "keys"])


def signatures(documents: DataFrame) -> DataFrame:
    """(doc, n, h1, h2, keys): set size, 128-bit set hash and sub-keys."""
    return keyed_texts(documents).mapInArrow(
        _signatures, "doc long, n long, h1 long, h2 long, keys array<long>")


class _Sets:
    """Shingle sets of packed texts; recent ones are kept."""

    def __init__(self):
        self.kept, self.size = {}, 0

    def get(self, packed: bytes) -> np.ndarray:
        own = self.kept.get(packed)
        if own is None:
            own = text_set(unpack(packed))
            self.size += len(own)
            if self.size > KEPT_SHINGLES:
                self.kept, self.size = {}, len(own)
            self.kept[packed] = own
        return own


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = _Sets()
    for batch in batches:
        links = []
        for a, b, p, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = sets.get(p), sets.get(q)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both and 100 * both >= PERCENT * (len(x) + len(y) - both):
                links.append((a, b))
        yield pa.record_batch([pa.array([x[0] for x in links], pa.int64()),
                               pa.array([x[1] for x in links], pa.int64())], ["u", "v"])


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (u, v) pairs whose full shingle sets reach the threshold. `texts`: (doc, packed)."""
    left = pairs.join(texts.select(F.col("doc").alias("u"), F.col("packed").alias("p")), "u")
    both = left.join(texts.select(F.col("doc").alias("v"), F.col("packed").alias("q")), "v")
    return both.select("u", "v", "p", "q").mapInArrow(_confirm, "u long, v long")


def table_rows(reps: DataFrame) -> DataFrame:
    """(bucket, doc, order): one row per table key that may be shared. `order` puts first how widely
    a document's sub-keys are shared, then a hash of its id: one long, so that sets are aggregated
    without sorting them."""
    keys = reps.select("doc", F.posexplode("keys").alias("pos", "value")).select(
        "doc", (F.col("pos") >= SUBKEYS).alias("second"), F.xxhash64("pos", "value").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1")
    own = keys.join(shared, "key").groupBy("doc").agg(
        F.collect_list(F.when(~F.col("second"), F.col("key"))).alias("a"),
        F.collect_list(F.when(F.col("second"), F.col("key"))).alias("b"),
        F.sum(F.log2("docs")).alias("degree"))
    widely = F.shiftleft((F.col("degree") * 256).cast("long"), 44)
    own = own.withColumn("order", widely + F.shiftrightunsigned(F.xxhash64("doc"), 20))
    return (own.select("doc", "order", F.explode("a").alias("x"), "b")
            .select("doc", "order", "x", F.explode("b").alias("y"))
            .select(F.xxhash64("x", "y").alias("bucket"), "doc", "order"))


def _list_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, packed = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for at in range(0, len(packed), 256):
            sets = [text_set(unpack(p)).view(np.int64) for p in packed[at:at + 256]]
            sizes = np.array([len(s) for s in sets])
            yield pa.record_batch([pa.array(np.repeat(docs[at:at + 256], sizes)), pa.array(np.repeat(sizes, sizes)),
                                   pa.array(np.concatenate(sets))], ["doc", "n", "gram"])


def _placed(grams: DataFrame, *keys: str) -> DataFrame:
    """Rows of `grams` (doc, n, gram, ...) whose gram another set has too (with equal `keys`), with its
    place among its set's n by rarity."""
    shared = grams.groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1")
    own = grams.join(shared, [*keys, "gram"])
    each = Window.partitionBy("doc")
    return own.withColumn("place", F.row_number().over(each.orderBy("docs", "gram")) + F.col("n") - F.count(F.lit(1)).over(each))


def rare_grams(texts: DataFrame) -> DataFrame:
    """(doc, n, gram, place): of each set's rarest `n - ceil(0.75 n) + 1` shingles, those that another of
    these sets has too, with the place in that order. Sets that reach the threshold have one of them in common."""
    grams = texts.mapInArrow(_list_grams, "doc long, n long, gram long")
    return _placed(grams).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1).select(
        "doc", "n", "gram", "place")


def _list_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = _Sets()
    for batch in batches:
        rows = []
        for doc, centre, p, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own, base = text_set(unpack(p)), sets.get(q)
            lost, new = (np.setdiff1d(x, y, assume_unique=True) for x, y in ((base, own), (own, base)))
            if 2 * (len(base) - len(lost)) >= len(base) + len(new):
                rows.append((doc, centre, len(base), PERCENT * len(new) + 100 * len(lost), np.concatenate([lost, new]).view(np.int64)))
        sizes = np.array([len(r[4]) for r in rows], np.int64)
        wide = [pa.array(np.repeat(np.array([r[i] for r in rows], np.int64), sizes)) for i in range(4)]
        yield pa.record_batch([*wide, pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate([np.zeros(0, np.int64), *[r[4] for r in rows]]))],
                              ["doc", "centre", "base", "cost", "n", "gram"])


def changes(centres: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, centre, base, cost, n, gram): the n shingles that only the set or only its centre's set has,
    for sets at most half of whose union with the centre's differs. `base` is the centre's size.

    With x shingles of the centre lost and y new ones, cost = 100 x + 75 y; sets u and v of one centre are
    linked exactly if they share (cost_u + cost_v - 25 base) / 175 changes or more."""
    left = centres.join(texts, "doc").withColumnRenamed("packed", "p")
    both = left.join(texts.select(F.col("doc").alias("centre"), F.col("packed").alias("q")), "centre")
    return both.select("doc", "centre", "p", "q").mapInArrow(
        _list_changes, "doc long, centre long, base long, cost long, n long, gram long")


def rare_changes(changed: DataFrame) -> DataFrame:
    """`changed` with places: of each set's rarest changes, as many as may hold the first one shared with a linked set."""
    least = changed.groupBy("centre").agg(F.min("cost").alias("least"))
    need = F.greatest(F.lit(1), F.ceil((F.col("cost") + F.col("least") - (100 - PERCENT) * F.col("base")) / (100 + PERCENT)))
    return _placed(changed, "centre").join(least, "centre").where(F.col("place") <= F.col("n") - need + 1).drop("docs", "least")


def top_centres(rows: DataFrame) -> DataFrame:
    """(doc, centre): the best-connected set that a document reaches in three steps over its tables' centres."""
    to = rows.groupBy("doc").agg(F.max_by("centre", "top").alias("centre"))
    near = to
    for _ in range(2):
        near = near.join(to.select(F.col("doc").alias("centre"), F.col("centre").alias("next")), "centre").select(
            "doc", F.col("next").alias("centre"))
    return near


def merged_groups(placed: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of the tables (bucket, doc, grp) that hold several groups, and links (u, v) found.

    In every round each document of such a table is compared with one document of another group: the
    table's centre, or if it is of the centre's own group, the centre of the others. Of its tables' centres
    it takes the one it shares most of TRIED tables with. Groups that a link joins are one from then on, so a
    cluster of n texts whose pairs are often, but not always, links comes together in a few rounds of
    n comparisons. Rounds end when few of their comparisons still are links.
    """
    def several(rows: DataFrame) -> DataFrame:
        spread = rows.groupBy("bucket").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low != high")
        return stored(rows.join(spread.select("bucket"), "bucket").select("bucket", "doc", "grp"), "several")
    left, joined = several(placed), None
    for step in range(ROUNDS):
        order = F.xxhash64("doc", F.lit(step))
        own = Window.partitionBy("doc").orderBy(F.xxhash64("bucket", F.lit(step)), "bucket")
        few = left.withColumn("turn", F.row_number().over(own)).where(F.col("turn") <= TRIED).drop("turn")
        first = few.groupBy("bucket").agg(F.max_by(F.struct("doc", "grp"), order).alias("first"))
        rows = few.join(first, "bucket")
        other = rows.where("grp != first.grp").groupBy("bucket").agg(F.max_by("doc", order).alias("other"))
        centre = F.when(F.col("grp") != F.col("first.grp"), F.col("first.doc")).otherwise(F.col("other"))
        tries = rows.join(other, "bucket").groupBy("doc", centre.alias("v")).agg(F.count(F.lit(1)).alias("n")).groupBy(
            F.col("doc").alias("u")).agg(F.max_by("v", F.struct("n", "v")).alias("v"))
        tries = stored(tries, "tries")
        found = stored(confirmed(tries, texts), "joined")
        joined = found if joined is None else joined.unionByName(found)
        tried, links = tries.count(), found.count()
        if links:
            of = left.select("doc", "grp").distinct()
            ends = found.join(of.withColumnsRenamed({"doc": "u", "grp": "a"}), "u").join(of.withColumnsRenamed({"doc": "v", "grp": "b"}), "v")
            merged = connected_components(ends.select(F.col("a").alias("u"), F.col("b").alias("v")))
            left = several(left.join(merged, left.grp == merged.node, "left").select("bucket", "doc", F.coalesce("root", "grp").alias("grp")))
        if links <= FEW * tried:
            break
    return left, joined


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Null and empty texts have no shingles and stay alone; texts under five words are one shingle.
    Null ids count as one id that sorts first. Rows that share a doc_id are one document: what is
    linked to any of them is linked to all. Other columns are ignored.
    """
    prepare(documents.sparkSession)
    sets = stored(signatures(documents), "signatures")
    least = sets.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc").alias("rep"))
    members = stored(sets.where("n > 0").join(least, ["n", "h1", "h2"]).select(
        "doc", "n", "rep", "keys"), "members")
    reps = members.where("doc = rep").drop("rep")

    # tables: every document that shares one, with the table's best-connected document
    rows = stored(table_rows(reps), "tables")
    centres = rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("docs"), F.max("order").alias("top"), F.max_by("doc", "order").alias("centre"))
    rows = stored(rows.join(centres.where("docs > 1").drop("docs"), "bucket").select(
        "bucket", "doc", "centre", "top"), "shared")
    texts = stored(packed_texts(keyed_texts(documents)).join(
        rows.select("doc").distinct(), "doc"), "texts")

    # first, each document with the best-connected one among the centres of its tables, and the one that leads to
    first = rows.where("doc != centre").groupBy(F.col("doc").alias("u")).agg(
        F.max_by("centre", "top").alias("v"))
    centres = stored(top_centres(rows), "centres")
    tops = centres.where("doc != centre").select(F.col("doc").alias("u"), F.col("centre").alias("v"))
    links = stored(confirmed(first.unionByName(tops).distinct(), texts), "links")
    several = members.groupBy("doc").agg(F.min("rep").alias("v"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    links = links.unionByName(members.join(several, "doc").where("rep != v").select(F.col("rep").alias("u"), "v"))
    groups = connected_components(links)

    # then, among documents of tables that still hold several groups, pairs across groups
    placed = rows.join(groups, rows.doc == groups.node, "left").select(
        "bucket", "doc", F.coalesce("root", "doc").alias("grp"))
    left, joined = merged_groups(placed, texts)
    mixed = left.select("doc", "grp").distinct()
    changed = stored(changes(centres.join(mixed.select("doc"), "doc").where("doc != centre"), texts), "changes")
    space = changed.select("doc", "centre").distinct()
    rare = stored(rare_grams(texts.join(mixed.select("doc"), "doc")).join(mixed, "doc").join(space, "doc", "left").withColumn(
        "centre", F.coalesce("centre", "doc")), "rare")
    changed = stored(rare_changes(changed).join(mixed, "doc"), "rare")

    def of(rows: DataFrame, name: str, *keys: str) -> DataFrame:
        return rows.select(*keys, *[F.col(c).alias(f"{c}_{name}") for c in rows.columns if c not in keys])
    # at the first shingle in common, what is left of both sets must still hold the needed overlap
    far = of(rare, "u", "gram").join(of(rare, "v", "gram"), "gram").where("grp_u != grp_v and doc_u < doc_v and centre_u != centre_v").where(
        (100 + PERCENT) * (1 + F.least(F.col("n_u") - F.col("place_u"), F.col("n_v") - F.col("place_v")))
        >= PERCENT * (F.col("n_u") + F.col("n_v")))
    # likewise the changes of two sets around one centre; sets that need none in common are both linked with it
    keys = ("centre", "base", "gram")
    near = of(changed, "u", *keys).join(of(changed, "v", *keys), [*keys]).where("grp_u != grp_v and doc_u < doc_v").where(
        (100 + PERCENT) * (1 + F.least(F.col("n_u") - F.col("place_u"), F.col("n_v") - F.col("place_v")))
        >= F.col("cost_u") + F.col("cost_v") - (100 - PERCENT) * F.col("base"))
    pairs = far.select("doc_u", "doc_v").unionByName(near.select("doc_u", "doc_v")).toDF("u", "v").distinct()
    more = stored(confirmed(pairs, texts), "more")
    groups = connected_components(groups.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(joined).unionByName(more))

    found = members.join(groups, members.rep == groups.node, "left").select(
        "doc", "n", F.coalesce("root", "rep").alias("component"))
    alone = sets.where("n = 0").select("doc", "n", F.col("doc").alias("component"))
    return found.unionByName(alone).select(
        from_key("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
        from_key("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))


def without_near_duplicates(documents: DataFrame) -> DataFrame:
    """One document of each group: the rows that `near_duplicates` keeps, one per doc_id."""
    keep = near_duplicates(documents).where("kept").select(doc_key().alias("__doc")).distinct()
    return (documents.withColumn("__doc", doc_key()).join(keep, "__doc")
            .dropDuplicates(["__doc"]).drop("__doc"))


def without_near_duplicate_rows(documents: DataFrame) -> DataFrame:
    """One row of each group of similar texts, whatever its id: the one with the smallest id (null
    ids first). Rows that share an id, or have none, are told apart by a key written with them."""
    rows = keyed_rows(documents)
    found = near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "__row")
    first = found.join(rows.select("__row", doc_key().alias("doc")), "__row").groupBy(
        "component_id").agg(F.min(F.struct("doc", "__row")).alias("first"))
    return rows.join(first.select(F.col("first.__row").alias("__row")), "__row").select(*documents.columns)
