"""Clip planning from note events: windows, roles, leaf assignment, sources and clip labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelgrove.functions import gm
from labelgrove.functions.hashing import clip_id, hash_hex, hash_int, hash_uniform, pick_split
from labelgrove.operators.scan import row_numbers, running_totals
from labelgrove.operators.taxonomy import ancestors_of, parent_of
from labelgrove.sources.literal import small_table

WINDOW_S, HOP_S = 10.0, 5.0
MIN_NOTE_S, MIN_NOTES = 0.01, 4
WINDOWS_PER_FILE, MAX_PARTS, HINT_SHARE = 2, 5, 0.7
CLIP_FRACTIONS = {"train": 0.8, "val": 0.1, "test": 0.1}


def role_table(spark: SparkSession) -> DataFrame:
    """(is_drum, key, role): one row per program or drum note, so the range lookup is an equi-join."""
    rows = [(False, p, role) for lo, hi, role in gm.PROGRAM_ROLES for p in range(lo, hi + 1)]
    rows += [(True, n, "drums") for n in gm.KIT_NOTES]
    rows += [(True, n, role) for role, notes in gm.PERCUSSION_NOTES.items() for n in notes]
    return small_table(spark, rows, "is_drum boolean, key int, role string")


def with_role(notes: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """Role of every note from its program, or from its pitch on the drum channel."""
    table = role_table(notes.sparkSession) if roles is None else roles
    key = F.when(F.col("is_drum"), F.col("pitch")).otherwise(F.col("program")).cast("int")
    return notes.withColumn("key", key).join(table, ["is_drum", "key"]).drop("key")


def active_roles(spark: SparkSession, leaves: list[str]) -> DataFrame:
    """Roles that can become at least one of the leaves; others need not be read."""
    keep = [(r,) for r, ls in gm.ROLE_LEAVES.items() if set(ls) & set(leaves)]
    return small_table(spark, keep, "role string")


def window_notes(notes: DataFrame, window_s: float = WINDOW_S, hop_s: float = HOP_S,
                 min_note_s: float = MIN_NOTE_S) -> DataFrame:
    """Notes of every window they sound in, clipped to it: adds (w, start_in, end_in).

    The windows a note meets follow from its own times, so the overlap join needs no second
    table: a note fans out to about (length + window) / hop rows. Files shorter than the window
    give nothing.
    """
    length = notes.groupBy("midi_id").agg(F.max("end_s").alias("file_end"))
    first = F.greatest(F.lit(0), F.floor((F.col("start_s") - window_s) / hop_s) + 1)
    last = F.least(F.ceil(F.col("end_s") / hop_s) - 1,
                   F.floor((F.col("file_end") - window_s) / hop_s))
    met = notes.join(length.where(F.col("file_end") >= window_s), "midi_id")
    rows = met.where(last >= first).withColumn("w", F.explode(F.sequence(first, last)))
    t = F.col("w") * hop_s
    rows = rows.withColumns({"start_in": F.greatest(F.lit(0.0), F.col("start_s") - t),
                             "end_in": F.least(F.lit(window_s), F.col("end_s") - t)})
    return rows.where(F.col("end_in") - F.col("start_in") > min_note_s).drop("file_end")


def window_parts(windowed: DataFrame, min_notes: int = MIN_NOTES) -> DataFrame:
    """Parts with enough notes: one row per (file, window, track, role)."""
    keys = ["midi_id", "w", "track", "role"]
    return windowed.groupBy(*keys).agg(
        F.min("program").alias("program"), F.bool_or("is_drum").alias("is_drum"),
        F.count(F.lit(1)).alias("n_notes"),
        F.sum(F.col("end_in") - F.col("start_in")).alias("sounding_s"),
        F.bool_or(F.col("is_drum") & F.col("pitch").isin(*gm.CYMBAL_NOTES)).alias("cymbals")
    ).where(F.col("n_notes") >= min_notes)


def max_polyphony(notes: DataFrame, keys: list[str], start: str, end: str,
                  slot_s: float = 3600.0) -> DataFrame:
    """Most notes sounding at once per key; ends come before starts at equal times.

    The running count is cut by time slots, so a long busy key spreads over many tasks.
    """
    edges = notes.select(*keys, F.explode(F.array(
        F.struct(F.col(start).alias("t"), F.lit(1).cast("long").alias("d")),
        F.struct(F.col(end).alias("t"), F.lit(-1).cast("long").alias("d")))).alias("e")).select(
        *keys, "e.t", "e.d").groupBy(*keys, "t", "d").agg(F.sum("d").alias("delta"))
    edges = edges.withColumn("slot", F.floor(F.col("t") / slot_s))
    run = running_totals(edges, keys, "slot", [F.col("t"), F.col("d")], {"delta": "sounding"})
    return run.groupBy(*keys).agg(F.max("sounding").alias("polyphony"))


def sample_windows(parts: DataFrame, seed: int, per_file: int = WINDOWS_PER_FILE) -> DataFrame:
    """(midi_id, w): at most `per_file` seeded windows of every file that has parts.

    Spark limits each partition before the shuffle, so long files stay cheap.
    """
    windows = parts.select("midi_id", "w").distinct()
    order = Window.partitionBy("midi_id").orderBy(
        hash_hex(seed, F.col("midi_id"), F.col("w")), F.col("w"))
    return windows.withColumn("pick", F.row_number().over(order)).where(
        F.col("pick") <= per_file).drop("pick")


def leaf_pools(spark: SparkSession, leaves: list[str]) -> tuple[DataFrame, DataFrame]:
    """(role, pool, solo_free_pool) and (program, hint) restricted to the active leaves."""
    active = set(leaves)
    pools = [(r, [x for x in ls if x in active],
              [x for x in ls if x in active and x not in gm.SOLO_LEAVES])
             for r, ls in gm.ROLE_LEAVES.items()]
    hints = [(p, [x for x in ls if x in active]) for p, ls in gm.PROGRAM_LEAVES.items()]
    return (small_table(spark, pools, "role string, pool array<string>, quiet array<string>"),
            small_table(spark, hints, "program int, hint array<string>"))


def assign_leaves(parts: DataFrame, pools: DataFrame, hints: DataFrame, seed: int,
                  hint_share: float = HINT_SHARE) -> DataFrame:
    """Adds `leaf` to parts(midi_id, w, track, role, program, is_drum, polyphony).

    A part takes its program's hint with the given probability, else its role's pool; chords never
    become solo leaves. Parts of one pool go round its leaves in seeded order, so the counts of a
    pool differ by at most one. Positions are counted in hash chunks, not in one task per pool.
    """
    chord = F.col("polyphony") > gm.MAX_SOLO_POLYPHONY
    rows = (parts.join(pools, "role").join(hints, parts["program"] == hints["program"], "left")
            .drop(hints["program"]).withColumn("cands", F.when(chord, F.col("quiet"))
                                               .otherwise(F.col("pool"))))
    ident = [F.col(c) for c in ("midi_id", "w", "track", "role")]
    hint = F.array_intersect(F.coalesce("hint", F.array().cast("array<string>")), "cands")
    use = (~F.col("is_drum") & (F.size(hint) > 0)
           & (hash_uniform(seed, F.lit("hint"), *ident) < hint_share))
    rows = rows.withColumn("choice", F.when(use, hint).otherwise(F.col("cands"))).where(
        F.size("choice") > 0)
    rows = rows.withColumns({"pool_key": F.array_join("choice", "|"),
                             "h": F.md5(F.concat_ws(":", F.lit(str(seed)), *ident))})
    rows = rows.withColumn("chunk", F.substring("h", 1, 2))
    placed = row_numbers(rows, ["pool_key"], "chunk", [F.col("h"), *ident], "turn")
    at = ((F.col("turn") - 1) % F.size("choice")).cast("int")
    return placed.withColumn("leaf", F.get("choice", at)).drop(
        "pool", "quiet", "hint", "cands", "choice", "h", "chunk", "turn")


def limit_parts(parts: DataFrame, seed: int, max_parts: int = MAX_PARTS) -> DataFrame:
    """One part per (window, leaf) and at most `max_parts` per window, in seeded order."""
    h = hash_hex(seed, F.lit("part"), F.col("midi_id"), F.col("w"), F.col("track"), F.col("role"))
    ranked = parts.withColumn("h", h)
    per_leaf = Window.partitionBy("midi_id", "w", "leaf").orderBy("h")
    one = ranked.withColumn("k", F.row_number().over(per_leaf)).where("k = 1")
    per_window = Window.partitionBy("midi_id", "w").orderBy("h")
    return one.withColumn("k", F.row_number().over(per_window)).where(
        F.col("k") <= max_parts).drop("k", "h")


def plan_clips(windows: DataFrame, seed: int, hop_s: float = HOP_S, group: Column | None = None,
               fractions: dict[str, float] | None = None, stem_share: float = 0.1) -> DataFrame:
    """Clip rows of the chosen windows: split by artist, own seed, id, and whether stems are kept."""
    artist = F.col("midi_id").cast("string") if group is None else group
    clip_seed = hash_int(seed, F.lit("clip"), F.col("midi_id"), F.col("w")) % 2147483648
    rows = windows.withColumn("seed", clip_seed)
    u = F.crc32(artist) / F.lit(4294967296.0)
    return rows.select(
        "midi_id", "w", (F.col("w") * hop_s).alias("start_s"),
        pick_split(u, fractions or CLIP_FRACTIONS).alias("split"), "seed",
        clip_id(F.col("midi_id"), F.col("w"), F.col("seed")).alias("clip_id"),
        (F.col("seed") % 1000 < stem_share * 1000).alias("stems_saved"))


def leave_source_out(clips: DataFrame) -> DataFrame:
    """The clips plus a second copy of every test clip for the held-out sources."""
    again = clips.where("split = 'test'").withColumns({
        "split": F.lit("test_lso"), "clip_id": clip_id(F.col("midi_id"), F.col("w"), F.col("seed"),
                                                       F.lit("lso"))})
    return clips.unionByName(again)


def choose_source(requests: DataFrame, sources: DataFrame, u: Column) -> DataFrame:
    """Weighted source of every request(leaf): the first cumulative weight above u x total.

    The cumulative weights of a leaf's `sources(leaf, source, weight)` are cut into as many slots as it
    has sources, so the range lookup is an equi-join on leaf and slot: a source lies in about two slots,
    and a request meets about two sources however many the leaf has.
    """
    w = Window.partitionBy("leaf").orderBy("source")
    upto = sources.withColumns({"__cum": F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0)),
                                "__next": F.lead("source").over(w)})
    leaves = sources.groupBy("leaf").agg(F.sum("weight").alias("__total"), F.count(F.lit(1)).alias("__n"))
    slot = lambda at: F.least(F.floor(at * F.col("__n") / F.col("__total")), F.col("__n"))
    spans = upto.withColumn("__low", F.coalesce(F.lag("__cum").over(w), F.lit(0.0))).join(leaves, "leaf").withColumn(
        "__to", F.when(F.col("__next").isNull(), F.col("__n")).otherwise(slot(F.col("__cum"))))
    spans = spans.select("leaf", "source", "__low", F.when(F.col("__next").isNotNull(), F.col("__cum")).alias("__cum"),
                         F.explode(F.sequence(slot(F.col("__low")), "__to")).alias("__slot"))
    rows = requests.withColumn("__u", u).join(leaves, "leaf").withColumn("__cut", F.col("__u") * F.col("__total"))
    rows = rows.withColumn("__slot", slot(F.col("__cut"))).join(spans, ["leaf", "__slot"])
    # the last source of a leaf has no upper end
    return rows.where((F.col("__low") <= F.col("__cut")) & (F.col("__cum").isNull() | (F.col("__cut") < F.col("__cum")))).drop(
        "__u", "__cut", "__total", "__n", "__slot", "__low", "__cum")


def nearest_recording(wanted: DataFrame, recorded: DataFrame, max_shift: int = 3) -> DataFrame:
    """Recorded note used for every wanted one: nearest pitch (lower on ties) within `max_shift`,
    then nearest velocity (lower on ties).

    `wanted(instrument, pitch, velocity)`, `recorded(instrument, pitch, velocity)`. Recorded
    pitches are listed under each pitch they can serve, so the lookup is an equi-join.
    """
    pitches = recorded.select("instrument", F.col("pitch").alias("have")).distinct()
    reach = pitches.withColumn("pitch", F.explode(F.sequence(F.col("have") - max_shift,
                                                             F.col("have") + max_shift)))
    best = reach.groupBy("instrument", "pitch").agg(
        F.min_by("have", F.struct(F.abs(F.col("have") - F.col("pitch")), "have")).alias("have"))
    levels = recorded.groupBy("instrument", F.col("pitch").alias("have")).agg(
        F.collect_set("velocity").alias("levels"))
    lookup = best.join(levels, ["instrument", "have"])
    rows = wanted.join(lookup, ["instrument", "pitch"], "left")
    near = F.array_min(F.transform("levels", lambda v: F.struct(
        F.abs(v - F.col("velocity")).alias("d"), v.alias("v"))))
    return rows.withColumn("have_velocity", near["v"]).drop("levels")


def fit_octaves(notes: DataFrame, ranges: DataFrame, keys: list[str],
                keep_share: float = 0.8) -> DataFrame:
    """(keys, shift): 0 if enough notes lie in [lo, hi], else the octave shift covering the most
    (smallest on ties). Pitches are counted first; each has nine shifted copies."""
    counts = notes.groupBy(*keys, "pitch").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.join(ranges, keys).withColumn("o", F.explode(F.sequence(F.lit(-4), F.lit(4))))
    fits = (F.col("pitch") + 12 * F.col("o")).between(F.col("lo"), F.col("hi"))
    cover = rows.groupBy(*keys, "o").agg(F.sum(F.when(fits, F.col("n")).otherwise(0)).alias("c"),
                                         F.sum("n").alias("n"))
    return cover.groupBy(*keys).agg(
        F.max(F.when(F.col("o") == 0, F.col("c") >= keep_share * F.col("n"))).alias("fine"),
        F.max_by("o", F.struct("c", -F.abs("o"), "o")).alias("o")).select(
        *keys, F.when(F.col("fine"), 0).otherwise(12 * F.col("o")).cast("int").alias("shift"))


def pitch_report(files: DataFrame) -> DataFrame:
    """Files kept and mismatched per instrument from files(instrument, named, estimate)."""
    ok = F.abs(F.col("estimate") - F.col("named")) <= 0.6
    return files.groupBy("instrument").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(ok).alias("kept"),
        F.count_if(~F.coalesce(ok, F.lit(False))).alias("pitch_mismatch"),
        F.min(F.when(ok, F.col("named"))).alias("lowest"),
        F.max(F.when(ok, F.col("named"))).alias("highest"))


def velocity_slots(takes: DataFrame) -> DataFrame:
    """Gives takes(instrument, pitch, velocity, ord) their own velocity in 1..127: the nearest free
    one above, else below, in `ord` order.

    The order matters, so each (instrument, pitch) is replayed from sorted partitions; the state
    is at most 127 numbers.
    """
    def replay(batches):
        current, taken = None, set()
        for pdf in batches:
            out = []
            for inst, pitch, vel in zip(pdf["instrument"], pdf["pitch"], pdf["velocity"]):
                if (inst, pitch) != current:
                    current, taken = (inst, pitch), set()
                start = max(1, min(127, int(vel)))
                above = next((v for v in range(start, 128) if v not in taken), None)
                below = next((v for v in range(126, 0, -1) if v not in taken), 1)
                slot = above if above is not None else below
                taken.add(slot)
                out.append(slot)
            yield pd.DataFrame({"instrument": pdf["instrument"], "pitch": pdf["pitch"],
                                "ord": pdf["ord"], "velocity": pdf["velocity"], "slot": out})

    return (takes.select("instrument", "pitch", "ord", "velocity")
            .repartition("instrument", "pitch").sortWithinPartitions("instrument", "pitch", "ord")
            .mapInPandas(replay, "instrument long, pitch int, ord long, velocity int, slot int"))


# ---- sources
def expand_labels(labels: DataFrame, leaves: DataFrame, entry: str, weight: float) -> DataFrame:
    """Registry rows (source, leaf, label_as, weight) from hand-labelled instruments.

    `labels(instrument, node)`, `leaves(node)` served by the entry. A coarse node serves every
    leaf below it and is labelled coarsely; a node that covers none moves to its parent. The
    entry's weight is shared evenly by the instruments of the busiest leaf an instrument serves.
    """
    up = leaves.select(F.col("node").alias("leaf"), F.explode(ancestors_of("node")).alias("node"))
    usable = labels.where(F.col("node").isNotNull() & (F.col("node") != "skip"))
    own = usable.join(up, "node", "left_semi")
    moved = usable.join(up, "node", "left_anti").select(
        "instrument", parent_of("node").alias("node"))
    served = own.select("instrument", "node").unionByName(moved).join(up, "node")
    busy = served.groupBy("leaf").agg(F.count(F.lit(1)).alias("n_for"))
    per = served.join(busy, "leaf").groupBy("instrument", "node").agg(
        F.collect_list("leaf").alias("leaves"), F.max("n_for").alias("n_max"))
    exact = (F.size("leaves") == 1) & (F.get("leaves", 0) == F.col("node"))
    return per.select(
        F.concat_ws(":", F.lit(entry), F.col("instrument").cast("string")).alias("source"),
        "instrument", F.explode("leaves").alias("leaf"),
        F.when(~exact, F.col("node")).alias("label_as"),
        (F.lit(weight) / F.col("n_max")).alias("weight"))


def unexpandable(labels: DataFrame, leaves: DataFrame) -> DataFrame:
    """Labelled instruments that cover no leaf of the entry, even through their parent."""
    up = leaves.select(F.explode(ancestors_of("node")).alias("node")).distinct()
    usable = labels.where(F.col("node").isNotNull() & (F.col("node") != "skip"))
    return (usable.withColumn("tried", F.explode(F.array_compact(F.array("node", parent_of("node")))))
            .join(up.select(F.col("node").alias("tried"), F.lit(True).alias("ok")), "tried", "left")
            .groupBy("instrument", "node").agg(F.bool_or(F.coalesce("ok", F.lit(False))).alias("ok"))
            .where("not ok").select("instrument", "node"))


def leaf_gate(sources: DataFrame, candidates: DataFrame, min_instruments: int = 2) -> DataFrame:
    """Per candidate leaf: distinct instruments on hand, pending ones, coarse sources, trainable.

    `sources(source, leaf, grp, label_as, present)`; coarse sources do not count.
    """
    exact = F.col("label_as").isNull()
    groups = sources.groupBy("leaf", "grp").agg(
        F.bool_or(exact & F.col("present")).alias("have"), F.bool_or(exact).alias("ever"),
        F.count_if(~exact).alias("coarse"))
    per = groups.groupBy("leaf").agg(
        F.count_if("have").alias("n_instruments"),
        F.count_if(F.col("ever") & ~F.col("have")).alias("n_pending"),
        F.sum("coarse").alias("n_coarse"))
    return (candidates.select("leaf").join(per, "leaf", "left")
            .fillna(0, ["n_instruments", "n_pending", "n_coarse"])
            .withColumn("trainable", F.col("n_instruments") >= min_instruments))


def holdout_pairs(sources: DataFrame, gate: DataFrame, min_instruments: int = 2) -> DataFrame:
    """(source, leaf) held out: the first non-shared group of every leaf that can spare one."""
    spare = gate.where(F.col("trainable") & (F.col("n_instruments") >= min_instruments + 1))
    usable = sources.where(F.col("label_as").isNull() & F.col("present")).join(
        spare.select("leaf"), "leaf", "left_semi")
    first = (usable.where(~F.col("grp").isin(*gm.SHARED_BANKS)).groupBy("leaf")
             .agg(F.min("grp").alias("grp")))
    return usable.join(first, ["leaf", "grp"], "left_semi").select("source", "leaf").distinct()


def leaf_set(base: DataFrame, gate: DataFrame) -> DataFrame:
    """Base leaves plus the candidates that passed the gate."""
    return base.select("leaf").union(gate.where("trainable").select("leaf")).distinct()


def unsafe_holdouts(sources: DataFrame, gate: DataFrame, holdout: DataFrame,
                    min_instruments: int = 2) -> DataFrame:
    """Gated leaves left with too few training instruments once the holdout is taken out."""
    train = (sources.where(F.col("label_as").isNull() & F.col("present"))
             .join(holdout, ["source", "leaf"], "left_anti")
             .groupBy("leaf").agg(F.count_distinct("grp").alias("n_train")))
    return (gate.where("trainable").select("leaf").join(train, "leaf", "left")
            .withColumn("n_train", F.coalesce("n_train", F.lit(0)))
            .where(F.col("n_train") < min_instruments))


def clip_labels(stems: DataFrame, cymbal_node: str = "cymbals") -> DataFrame:
    """One row per clip from stems(clip_id, part_leaf, label_as, cymbals, clean): positives, coarse
    labels whose subtree is unknown, and whether every source is commercially clean."""
    label = F.coalesce("label_as", "part_leaf")
    coarse = label != F.col("part_leaf")
    per = stems.groupBy("clip_id").agg(
        F.collect_set(label).alias("labels"), F.collect_set(F.when(coarse, label)).alias("below"),
        F.bool_or(F.col("cymbals") & F.startswith("part_leaf", F.lit("drums"))).alias("implied"),
        F.bool_and("clean").alias("sources_clean"), F.count(F.lit(1)).alias("n_stems"))
    extra = F.when(F.coalesce("implied", F.lit(False)), F.array(F.lit(cymbal_node))).otherwise(
        F.array().cast("array<string>"))
    return per.select("clip_id", F.array_sort(F.array_union("labels", extra)).alias("positive"),
                      F.array_sort("below").alias("unknown_below"), "sources_clean", "n_stems")


def build_manifest(clips: DataFrame, stems: DataFrame) -> DataFrame:
    """(counter, name, n) over clips(split, positive) and stems(source)."""
    by_split = clips.groupBy(F.col("split").alias("name")).count()
    by_leaf = clips.select(F.explode("positive").alias("name")).groupBy("name").count()
    by_source = stems.groupBy(F.col("source").alias("name")).count()
    parts = [df.select(F.lit(k).alias("counter"), F.col("name").cast("string").alias("name"),
                       F.col("count").alias("n"))
             for k, df in (("split", by_split), ("leaf", by_leaf), ("source", by_source))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def merge_newer(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows replace stored rows of the same key."""
    return stored.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def merge_files(rows: DataFrame, key: str = "key", order: str = "file_no") -> DataFrame:
    """Last file wins per key; `usable` tells rows that are not skipped."""
    last = rows.groupBy(key).agg(F.max_by("value", order).alias("value"))
    return last.withColumn("usable", F.coalesce(F.col("value") != "skip", F.lit(False)))
