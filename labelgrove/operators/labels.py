"""Label algebra: source labels -> tri-state labels (positive, negative, unknown).

Long tables hold only observed (item, node, y) rows; unknown is the absence of a row.
`*` as an unknown root masks the whole tree of an item.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelgrove.operators.taxonomy import ancestors_of, close_upward, closure

ALL = "*"
POSITIVE, UNKNOWN, STEM_UNKNOWN = "positive", "unknown", "stem_unknown"

# Activity limits in dB (fixed values).
ABS_FLOOR_DB = -50.0
REL_DB = 35.0
SILENCE_DB = -70.0


def rule_effects(rules: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per label with everything it implies: ARRAY<STRUCT<kind, node>>.

    Internal mapped nodes also make their subtree unknown, unless `children_unknown` is false.
    """
    leaf = nodes.select("node", "is_leaf")
    mapped = rules.where(~F.col("ignored")).select(
        "label", F.coalesce("children_unknown", F.lit(True)).alias("cu"),
        F.explode("nodes").alias("node"))
    internal = mapped.where("cu").join(leaf.where(~F.col("is_leaf")), "node", "left_semi")
    rows = (mapped.select("label", F.lit(POSITIVE).alias("kind"), "node")
            .unionByName(internal.select("label", F.lit(UNKNOWN).alias("kind"), "node"))
            .unionByName(rules.select("label", F.lit(UNKNOWN).alias("kind"),
                                      F.explode("unknown").alias("node")))
            .unionByName(rules.select("label", F.lit(STEM_UNKNOWN).alias("kind"),
                                      F.explode("stem_unknown").alias("node"))))
    per_label = rows.groupBy("label").agg(F.collect_set(F.struct("kind", "node")).alias("effects"))
    empty = F.array().cast("array<struct<kind:string,node:string>>")
    return rules.select("label", "ignored").join(per_label, "label", "left").select(
        "label", "ignored", F.coalesce("effects", empty).alias("effects"))


def label_effects(item_labels: DataFrame, effects: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, kind, node) of every source label; unmapped labels give (`unknown`, `*`).

    One left join on the label. The rule side is as small as the vocabulary, so Spark
    broadcasts it by its measured size; a hot label then needs no shuffle at all.
    """
    unmapped = F.array(F.struct(F.lit(UNKNOWN).alias("kind"), F.lit(ALL).alias("node")))
    joined = item_labels.select(*keys, "label").join(effects, "label", "left")
    return (joined.withColumn("unmapped", F.col("effects").isNull())
            .select(*keys, "label", "unmapped",
                    F.explode(F.coalesce("effects", unmapped)).alias("e"))
            .select(*keys, "label", "unmapped", "e.kind", "e.node"))


def unmapped_labels(item_labels: DataFrame, effects: DataFrame) -> DataFrame:
    """Labels without a rule and how often they occur."""
    return (item_labels.join(effects.select("label"), "label", "left_anti")
            .groupBy("label").agg(F.count(F.lit(1)).alias("n")))


def require_mapped(item_labels: DataFrame, effects: DataFrame) -> DataFrame:
    """The labels, failing on the first unmapped one when strict mapping is wanted."""
    known = effects.select("label", F.lit(True).alias("known"))
    joined = item_labels.join(known, "label", "left")
    message = F.concat(F.lit("unmapped source label: "), F.col("label"))
    return joined.withColumn("label", F.when(F.col("known"), F.col("label")).otherwise(
        F.raise_error(message))).drop("known")


def resolve(item_labels: DataFrame, effects: DataFrame,
            keys: list[str] | None = None) -> DataFrame:
    """(keys, kind, node): ancestor-closed positives plus unknown and stem-unknown roots."""
    keys = keys or ["item"]
    e = label_effects(item_labels, effects, keys)
    up = F.when(F.col("kind") == POSITIVE, ancestors_of("node")).otherwise(F.array("node"))
    return e.select(*keys, "kind", F.explode(up).alias("node")).distinct()


def mask_pairs(nodes: DataFrame) -> DataFrame:
    """(root, node): everything an unknown root hides, i.e. its subtree and its ancestors."""
    pairs = closure(nodes)
    return (pairs.select(F.col("ancestor").alias("root"), "node")
            .union(pairs.select(F.col("node").alias("root"), F.col("ancestor").alias("node")))
            .distinct())


def masks(nodes: DataFrame) -> DataFrame:
    """(root, hidden): `mask_pairs` as one small set per root."""
    return mask_pairs(nodes).groupBy("root").agg(F.collect_set("node").alias("hidden"))


def observed_exhaustive(items: DataFrame | None, resolved: DataFrame, nodes: DataFrame,
                        keys: list[str] | None = None) -> DataFrame:
    """(keys, node, y) for sources that annotate everything they contain.

    All nodes are observed except unknown subtrees and their ancestors; positives always are.
    `items` adds items without any resolved row (None when there are none). The per-item sets are
    bounded by the size of the taxonomy.
    """
    keys = keys or ["item"]
    none = F.array().cast("array<string>")
    every = nodes.agg(F.array_sort(F.collect_list("node"))).scalar()
    unknown = F.col("kind") == UNKNOWN
    rows = (resolved.where(F.col("kind").isin(POSITIVE, UNKNOWN))
            .join(masks(nodes).withColumnRenamed("root", "node"), "node", "left"))
    sets = rows.groupBy(*keys).agg(
        F.collect_set(F.when(~unknown, F.col("node"))).alias("pos"),
        F.array_distinct(F.flatten(F.collect_set(F.when(
            unknown, F.coalesce("hidden", F.array("node")))))).alias("hid"))
    if items is not None:
        sets = (items.select(*keys).distinct().join(sets, keys, "left")
                .withColumns({"pos": F.coalesce("pos", none), "hid": F.coalesce("hid", none)}))
    observed = F.when(F.array_contains("hid", ALL), F.col("pos")).otherwise(
        F.array_union(F.array_except(every, "hid"), "pos"))
    return (sets.withColumn("node", F.explode(observed))
            .select(*keys, "node", F.array_contains("pos", F.col("node")).alias("y")))


def exhaustive_labels(item_labels: DataFrame, effects: DataFrame, nodes: DataFrame) -> DataFrame:
    """`resolve` and `observed_exhaustive` in one shuffle on the item.

    What each label proves and hides is worked out once per label (vocabulary size), so items
    only union a few small sets.
    """
    e = effects.select("label", F.explode_outer("effects").alias("e")).select("label", "e.*")
    shown = e.where(F.col("kind") == POSITIVE).select(
        "label", F.explode(ancestors_of("node")).alias("node"), F.lit(True).alias("p"))
    hidden = (e.where(F.col("kind") == UNKNOWN).withColumnRenamed("node", "root")
              .join(mask_pairs(nodes), "root", "left")
              .select("label", F.coalesce("node", "root").alias("node"), F.lit(False).alias("p")))
    proof = shown.unionByName(hidden).groupBy("label").agg(
        F.collect_set(F.when(F.col("p"), F.col("node"))).alias("pos"),
        F.collect_set(F.when(~F.col("p"), F.col("node"))).alias("hid"))
    none = F.array().cast("array<string>")
    known = effects.select("label").join(proof, "label", "left").select(
        "label", F.coalesce("pos", none).alias("pos"), F.coalesce("hid", none).alias("hid"))
    every = nodes.agg(F.array_sort(F.collect_list("node"))).scalar()
    sets = (item_labels.select("item", "label").join(known, "label", "left")
            .select("item", F.coalesce("pos", none).alias("pos"),
                    F.coalesce("hid", F.array(F.lit(ALL))).alias("hid"))
            .groupBy("item").agg(
                F.array_distinct(F.flatten(F.collect_set("pos"))).alias("pos"),
                F.array_distinct(F.flatten(F.collect_set("hid"))).alias("hid")))
    observed = F.when(F.array_contains("hid", ALL), F.col("pos")).otherwise(
        F.array_union(F.array_except(every, "hid"), "pos"))
    return (sets.withColumn("node", F.explode(observed))
            .select("item", "node", F.array_contains("pos", F.col("node")).alias("y")))


def apply_unobserved(labels: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """Dataset-wide mask of whole subtrees; never removes a positive."""
    masked = (closure(nodes).join(roots.select(F.col("node").alias("ancestor")), "ancestor")
              .select("node").distinct().withColumn("masked", F.lit(True)))
    return (labels.join(masked, "node", "left")
            .where(F.col("y") | F.col("masked").isNull()).select(*labels.columns))


def union_tracks(stem_labels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Track resolution = union over its stems, without the stem-only unknowns."""
    keys = keys or ["item"]
    return (stem_labels.where(F.col("kind") != STEM_UNKNOWN)
            .select(*keys, "kind", "node").distinct())


def refine_raw(stem_labels: DataFrame, raw_labels: DataFrame, effects: DataFrame) -> DataFrame:
    """Stem resolution refined by the labels of its raw tracks: (item, stem, kind, node, outside).

    A raw node counts only inside the subtree of a node its stem maps to; otherwise it turns
    unknown and is flagged `outside`. Stems without a label hide everything. One shuffle on
    (item, stem); the sets collected per stem are bounded by the label vocabulary.
    """
    unmapped = F.array(F.struct(F.lit(UNKNOWN).alias("kind"), F.lit(ALL).alias("node")))
    rows = (stem_labels.select("item", "stem", "label", F.lit(False).alias("raw"))
            .unionByName(raw_labels.select("item", "stem", "label", F.lit(True).alias("raw")))
            .join(effects.select("label", "effects"), "label", "left")
            .withColumn("entry", F.struct("label", F.coalesce("effects", unmapped).alias("effects"))))
    sets = rows.groupBy("item", "stem").agg(
        F.collect_set(F.when(~F.col("raw"), F.col("entry"))).alias("own"),
        F.collect_set(F.when(F.col("raw"), F.col("entry"))).alias("below"))

    def implied(entries: Column) -> Column:
        return F.flatten(F.transform(entries, lambda x: x["effects"]))

    def of_kind(es: Column, kind: str) -> Column:
        return F.filter(es, lambda e: e["kind"] == kind)

    def rows_as(es: Column, kind: str, outside: bool) -> Column:
        return F.transform(es, lambda e: F.struct(
            F.lit(kind).alias("kind"), e["node"].alias("node"), F.lit(outside).alias("outside")))

    parts = (sets
             .withColumn("base", implied(F.col("own")))
             .withColumn("mapped", F.transform(of_kind(F.col("base"), POSITIVE), lambda e: e["node"]))
             .withColumn("names", F.transform("own", lambda x: x["label"]))
             .withColumn("extra", implied(F.filter(
                 "below", lambda r: ~F.array_contains("names", r["label"])))))

    def inside(e: Column) -> Column:
        return F.arrays_overlap(ancestors_of(e["node"]), F.col("mapped"))

    raw_pos = of_kind(F.col("extra"), POSITIVE)
    asserts_nothing = F.size("mapped") == 0
    found = F.concat(
        *[rows_as(of_kind(F.col("base"), k), k, False) for k in (POSITIVE, UNKNOWN, STEM_UNKNOWN)],
        rows_as(of_kind(F.col("extra"), UNKNOWN), UNKNOWN, False),
        rows_as(F.filter("extra", lambda e: (e["kind"] == STEM_UNKNOWN) & (
            asserts_nothing | (e["node"] == ALL))), STEM_UNKNOWN, False),
        rows_as(F.filter(raw_pos, inside), POSITIVE, False),
        rows_as(F.filter(raw_pos, lambda e: ~inside(e)), UNKNOWN, True))
    hide_all = F.array(F.struct(F.lit(UNKNOWN).alias("kind"), F.lit(ALL).alias("node"),
                                F.lit(False).alias("outside")))
    flat = parts.select("item", "stem", F.explode(F.array_distinct(
        F.when(F.size("own") == 0, hide_all).otherwise(found))).alias("e"))
    up = F.when(F.col("e.kind") == POSITIVE, ancestors_of("e.node")).otherwise(F.array("e.node"))
    return (flat.select("item", "stem", "e.kind", F.explode(up).alias("node"), "e.outside")
            .groupBy("item", "stem", "kind", "node").agg(F.bool_or("outside").alias("outside")))


def partial_labels(class_probs: DataFrame, class_map: DataFrame, nodes: DataFrame,
                   unknown: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(item, node, y) of clips where only some classes were judged.

    Positive classes close upward; negative classes close downward, minus positives and minus
    `unknown(node)` roots. Ancestors of a negative stay unobserved.
    """
    judged = (class_probs.where("observed").join(class_map, "cls")
              .select("item", "node", (F.col("prob") >= threshold).alias("y")))
    pos = close_upward(judged.where("y"), ["item"]).withColumn("y", F.lit(True))
    pairs = closure(nodes).select("node", "ancestor")
    if unknown is not None:
        masked = (closure(nodes).join(unknown.select(F.col("node").alias("ancestor")), "ancestor")
                  .select("node").distinct())
        pairs = pairs.join(masked, "node", "left_anti")
    neg = (judged.where(~F.col("y")).select("item", F.col("node").alias("ancestor"))
           .join(pairs, "ancestor").select("item", "node", F.lit(False).alias("y")))
    return pos.unionByName(neg).groupBy("item", "node").agg(F.bool_or("y").alias("y"))


def hand_labels(items: DataFrame, states: DataFrame, nodes: DataFrame) -> DataFrame:
    """(item, node, y) from present / unsure / absent marks and whether the item was fully heard.

    `items(item, listened_fully)`, `states(item, node, state)`.
    """
    leaf = nodes.select("node", "is_leaf")
    present = states.where("state = 'present'").select("item", "node")
    unsure = states.where("state = 'unsure'").select("item", "node")
    pos = close_upward(present, ["item"])
    strict = closure(nodes).where("depth > 0").select(F.col("ancestor").alias("node"),
                                                      F.col("node").alias("below"))
    full = items.where("listened_fully").select("item")
    partial = items.where(~F.coalesce("listened_fully", F.lit(False))).select("item")
    inner = (present.union(unsure).distinct().join(full, "item", "left_semi")
             .join(leaf.where(~F.col("is_leaf")), "node", "left_semi"))
    under = inner.join(strict, "node")
    has_child = (under.join(pos.select("item", F.col("node").alias("below")), ["item", "below"],
                            "left_semi").select("item", "node").distinct())
    untyped = (under.join(has_child, ["item", "node"], "left_anti")
               .select("item", F.col("below").alias("node")))
    leaves = nodes.where("is_leaf").agg(F.array_sort(F.collect_list("node"))).scalar()
    told = present.groupBy("item").agg(F.collect_set("node").alias("told"))
    unheard = (partial.join(told, "item", "left")
               .select("item", F.explode(F.array_except(
                   leaves, F.coalesce("told", F.array().cast("array<string>")))).alias("node")))
    hidden = (unsure.join(full, "item", "left_semi").union(untyped).union(unheard)
              .select("item", F.explode(ancestors_of("node")).alias("node")).distinct())
    marks = (pos.select("item", "node", F.lit(True).alias("p"))
             .unionByName(hidden.select("item", "node", F.lit(False).alias("p"))))
    sets = marks.groupBy("item").agg(
        F.collect_set(F.when(F.col("p"), F.col("node"))).alias("pos"),
        F.collect_set(F.when(~F.col("p"), F.col("node"))).alias("hid"))
    none = F.array().cast("array<string>")
    every = nodes.agg(F.array_sort(F.collect_list("node"))).scalar()
    return (items.select("item").join(sets, "item", "left")
            .withColumns({"pos": F.coalesce("pos", none), "hid": F.coalesce("hid", none)})
            .withColumn("node", F.explode(F.array_union(F.array_except(every, "hid"), "pos")))
            .select("item", "node", F.array_contains("pos", F.col("node")).alias("y")))


def level_or_silence(db: Column) -> Column:
    """Levels in dB; null means digital silence."""
    return F.coalesce(db.cast("double"), F.lit(float("-inf")))


def activity_states(tracks: DataFrame, clip: str = "clip") -> DataFrame:
    """Adds `state`: active, uncertain or silent, relative to the loudest track of the clip.

    The loudest level is one aggregate per clip joined back, not a window over the clip.
    """
    rms, peak = level_or_silence(F.col("rms_db")), level_or_silence(F.col("peak_frame_db"))
    loud = tracks.groupBy(clip).agg(F.max(rms).alias("loudest"))
    state = (F.when((rms >= ABS_FLOOR_DB) & (rms >= F.col("loudest") - REL_DB), F.lit("active"))
             .when(peak < SILENCE_DB, F.lit("silent")).otherwise(F.lit("uncertain")))
    return tracks.join(loud, clip).withColumn("state", state).drop("loudest")


@dataclass(frozen=True)
class ContextVocabulary:
    """Which track types and genres take part in the song-level rules."""
    full_kit: str
    overheads: str
    drum_machine: str
    close_mics: tuple[str, ...]
    vocals: tuple[str, ...]
    vocal_node: str
    kit_node: str
    kit_unknown: tuple[str, ...]
    always_unknown: str
    constant_mask: tuple[str, ...]
    rap_genres: tuple[str, ...] = ("rap",)
    kit_genres: tuple[str, ...] = ("rap", "electronic")


def context_labels(tracks: DataFrame, effects: DataFrame, nodes: DataFrame,
                   vocab: ContextVocabulary) -> DataFrame:
    """(item, node, y) of windows whose labels depend on the other tracks of the song.

    `tracks(item, type, state, bleed, genre)`. The distinct tracks of an item (at most types x
    states x 2) are collected in one shuffle; song facts are tests on that small set, and what
    follows keeps the partitioning by item.
    """
    genre = F.lower(F.coalesce("genre", F.lit("")))
    track = F.struct("type", "state", F.coalesce("bleed", F.lit(False)).alias("bleed"),
                     genre.alias("genre"))
    songs = tracks.groupBy("item").agg(F.collect_set(track).alias("set"))

    def some(test) -> Column:
        return F.exists("set", test)

    def clean_track(x: Column) -> Column:
        return (x["state"] == "active") & ~x["bleed"]

    facts = songs.withColumns({
        "rap": some(lambda x: x["genre"].isin(*vocab.rap_genres)),
        "ambiguous": (some(lambda x: (x["type"] == vocab.drum_machine) & (x["state"] != "silent"))
                      | some(lambda x: x["genre"].isin(*vocab.kit_genres)))
        & ~some(lambda x: x["type"].isin(vocab.full_kit, vocab.overheads) & clean_track(x))})
    rows = (facts.withColumn("t", F.explode("set"))
            .withColumn("bleed_only", ~F.exists("set", lambda x: (x["type"] == F.col("t.type"))
                                                & ~x["bleed"]))
            .select("item", "rap", "ambiguous", "bleed_only", F.col("t.type").alias("type"),
                    (F.col("t.state") == "silent").alias("silent"),
                    clean_track(F.col("t")).alias("clean"))
            .join(effects.select(F.col("label").alias("type"), "effects"), "type", "left"))
    mapped = F.col("effects").isNotNull()

    def effect(kind: str, node: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(node).alias("node"))

    vocal = F.array(effect(POSITIVE, vocab.vocal_node), effect(UNKNOWN, vocab.vocal_node))
    kit = F.array(effect(POSITIVE, vocab.kit_node),
                  *[effect(UNKNOWN, n) for n in vocab.kit_unknown])
    hide_all = F.array(effect(UNKNOWN, ALL))
    nothing = F.array().cast("array<struct<kind:string,node:string>>")

    def hide(c: Column) -> Column:
        known = F.filter(c, lambda e: e["kind"] != STEM_UNKNOWN)
        return F.transform(known, lambda e: F.struct(F.lit(UNKNOWN).alias("kind"),
                                                     e["node"].alias("node")))

    rule = (F.when(F.col("rap") & F.col("type").isin(*vocab.vocals), vocal)
            .when(F.col("ambiguous") & F.col("type").isin(*vocab.close_mics), kit)
            .otherwise(F.col("effects")))
    implied = (F.when(F.col("bleed_only") & mapped, hide(F.col("effects")))
               .when(F.col("silent"), nothing)
               .when(~mapped, hide_all)
               .when(F.col("clean"), rule)
               .otherwise(hide(rule)))
    always = F.array(effect(UNKNOWN, vocab.always_unknown))
    out = rows.select("item", F.explode(F.concat(implied, always)).alias("e")).select(
        "item", "e.kind", "e.node")
    out = out.where(~((F.col("kind") == POSITIVE) & (F.col("node") == vocab.always_unknown)))
    up = F.when(F.col("kind") == POSITIVE, ancestors_of("node")).otherwise(F.array("node"))
    resolved = out.select("item", "kind", F.explode(up).alias("node"))
    labels = observed_exhaustive(None, resolved, nodes)
    return labels.where(F.col("y") | ~F.col("node").isin(*vocab.constant_mask))


def solo_labels(items: DataFrame, positive: DataFrame, unknown: DataFrame,
                nodes: DataFrame) -> DataFrame:
    """Solo recordings: everything is observed except unknown subtrees that are not positive."""
    pos = close_upward(positive, ["item"]).select("item", F.lit(POSITIVE).alias("kind"), "node")
    roots = (unknown.select("item", "node").join(pos.select("item", "node"), ["item", "node"],
                                                 "left_anti")
             .select("item", F.lit(UNKNOWN).alias("kind"), "node"))
    return observed_exhaustive(items, pos.unionByName(roots), nodes)
