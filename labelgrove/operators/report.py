"""From framewise scores to activity intervals, instrument rows and whole-song reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from labelgrove.operators.ranges import key_changes, local_ranges, with_parts
from labelgrove.operators.scan import exact_percentile
from labelgrove.operators.taxonomy import ancestors_of, family_of, level_of, parent_of

SHOW = 0.30
CONFIDENT = 0.60
EXIT_SHARE = 0.7
DESCEND_MARGIN = 0.2
# Which labels a separated stem may vouch for, and which of them the mix must show too.
STEM_ROLES = (("vocals", "voice"), ("drums", "drums"), ("drums", "cymbals"), ("bass", "bass"))
STEM_NEEDS_MIX = ("voice",)


def label_scores(frames: DataFrame, class_map: DataFrame) -> DataFrame:
    """Score of a label in a frame = maximum over the source classes mapped to it."""
    return (frames.join(class_map.select("cls", "label"), "cls")
            .groupBy("song", "stem", "label", "frame").agg(F.max("p").alias("p")))


def song_confidence(frames: DataFrame, keys: list[str], q: float = 0.95) -> DataFrame:
    """95th percentile over the frames of each series, exact and linear-interpolated."""
    return exact_percentile(frames, keys, "p", q, "confidence")


def hysteresis_intervals(frames: DataFrame, keys: list[str], enter: float, exit_: float,
                         hop_s: float = 1.0) -> DataFrame:
    """(keys, start_s, end_s): open at p >= enter, close at p < exit, open tails end at n * hop.

    A frame either decides the state or keeps it. An interval opens at the first deciding frame of 1
    after one of 0, and ends at the next deciding frame of 0 wherever that is, so a range of frames only
    needs the last decision before it and the first 0 after it. Null scores decide nothing.
    """
    if exit_ > enter:
        raise ValueError("exit threshold above the enter threshold")
    mark = F.when(F.col("p") >= enter, 1).when(F.col("p") < exit_, 0)
    f = frames.select(*keys, F.col("frame").cast("long").alias("frame"), mark.alias("mark"))
    opened = StructType([*[f.schema[k] for k in keys], *[StructField(c, LongType()) for c in _OPENED]])
    found = local_ranges(f, keys, ["frame"], _openings(keys), opened, "openings")
    parts = found.where("opens is null")
    whole = Window.partitionBy(*keys)
    later = whole.orderBy("__part").rowsBetween(1, Window.unboundedFollowing)
    earlier = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "__part", F.last("last_mark", ignorenulls=True).over(earlier).alias("before"),
                         F.first("first_0", ignorenulls=True).over(later).alias("after"),
                         (F.max("last_frame").over(whole) + 1).alias("n"))
    each = with_parts(found.where("opens is not null").drop("last_mark", "first_0", "last_frame"), parts, keys)
    fresh = (F.col("first") == 0) | (F.coalesce("before", F.lit(0)) == 0)
    return each.where(fresh).select(*keys, F.bround(F.col("opens") * hop_s, 2).alias("start_s"),
                                    F.bround(F.coalesce("ends", "after", "n") * hop_s, 2).alias("end_s"))


_OPENED = ("opens", "ends", "first", "last_mark", "first_0", "last_frame", "__part")


def _openings(keys: list[str]):
    """Of each series in a range: where it opens, the next 0, and whether that is its first decision; and
    one row with the last decision, the first 0 and the last frame."""
    def run(rows: pa.Table, part: int) -> pa.Table:
        head = np.flatnonzero(key_changes(rows, keys))
        tail = np.append(head[1:], rows.num_rows)
        frame = rows.column("frame").to_numpy()
        mark = rows.column("mark").to_pandas().fillna(-1).to_numpy(int)
        series = np.repeat(np.arange(len(head)), tail - head)
        at = np.flatnonzero(mark >= 0)
        first = np.ones(len(at), bool)
        first[1:] = series[at[1:]] != series[at[:-1]]
        opens = first | np.append(True, mark[at[1:]] != mark[at[:-1]])[:len(at)]
        opens &= mark[at] == 1
        zeros = np.flatnonzero(mark == 0)

        def next_zero(places):
            nth = np.searchsorted(zeros, places)
            place = np.append(zeros, rows.num_rows)[nth]
            own = np.append(series, -1)
            return [int(frame[p]) if own[p] == own[q] else None for p, q in zip(place, places, strict=True)]
        o = at[opens]
        last = np.searchsorted(at, tail) - 1
        decided = [int(mark[at[i]]) if i >= 0 and at[i] >= a else None for i, a in zip(last, head, strict=True)]
        n, m = len(o), len(head)
        columns = {"opens": [*frame[o].tolist(), *[None] * m], "ends": [*next_zero(o), *[None] * m],
                   "first": [*first[opens].astype(int).tolist(), *[None] * m], "last_mark": [*[None] * n, *decided],
                   "first_0": [*[None] * n, *next_zero(head)], "last_frame": [*[None] * n, *frame[tail - 1].tolist()],
                   "__part": [part] * (n + m)}
        taken = rows.select(keys).take(pa.array(np.concatenate([o, head])))
        return pa.table([*taken.columns, *[pa.array(columns[c], pa.int64()) for c in _OPENED]], names=[*keys, *_OPENED])
    return run


def by_confidence(rows: DataFrame, song: str = "song") -> DataFrame:
    """(song, instruments): each song's rows(label, confidence) by falling confidence, equal ones by label."""
    entry = F.struct((-F.col("confidence")).alias("order"), "label", "confidence")
    listed = F.array_sort(F.collect_list(entry))
    return rows.groupBy(song).agg(F.transform(listed, lambda e: F.struct(e["label"].alias("label"), e["confidence"].alias("confidence")))
                                  .alias("instruments"))


def shown(rows: DataFrame, show: float = SHOW) -> DataFrame:
    return rows.where(F.col("confidence") >= show)


def display_class(confidence: Column, calibrated: Column, subtype: Column) -> Column:
    """`uncertain` for subtypes, uncalibrated or weak rows; a missing flag counts as calibrated."""
    unsure = (F.coalesce(subtype, F.lit(False)) | ~F.coalesce(calibrated, F.lit(True))
              | (confidence < CONFIDENT))
    return F.when(unsure, "uncertain").otherwise("confident")


def combine(mix: DataFrame, stems: DataFrame, roles: DataFrame,
            needs_mix: tuple[str, ...] = STEM_NEEDS_MIX) -> DataFrame:
    """Best row per (song, label) of the mix and the stems entitled to vouch for it.

    `mix(song, label, confidence)`, `stems(song, stem, label, confidence)`, `roles(stem, label)`.
    A stem cannot create a label of `needs_mix`; on equal confidence the mix row stays.
    """
    vouching = stems.join(roles, ["stem", "label"], "left_semi")
    guarded = vouching.where(F.col("label").isin(*needs_mix)).join(
        mix.select("song", "label"), ["song", "label"], "left_semi")
    free = vouching.where(~F.col("label").isin(*needs_mix))
    rows = (mix.select("song", "label", "confidence", F.lit("mix").alias("stem"))
            .unionByName(guarded.unionByName(free).select("song", "label", "confidence", "stem")))
    rank = F.struct(F.col("confidence"), (F.col("stem") == "mix").cast("int"), F.col("stem"))
    return rows.groupBy("song", "label").agg(F.max(rank).alias("best")).select(
        "song", "label", "best.confidence", "best.stem")


def descend(starts: DataFrame, p95: DataFrame, allowed: DataFrame, show: float = SHOW,
            margin: float = DESCEND_MARGIN) -> DataFrame:
    """Adds `node`: the deepest subtype reached from `root` of each (song, label, root).

    Per level: of two or more trained children the best must be allowed for the label, reach
    `show` and lead the runner-up by `margin`. `p95(song, node, score)`, `allowed(label, node)`.
    """
    kids = p95.select("song", parent_of("node").alias("parent"),
                      F.struct(F.col("score"), F.col("node")).alias("kid")).where("parent is not null")
    top = kids.groupBy("song", "parent").agg(
        F.slice(F.sort_array(F.collect_list("kid"), asc=False), 1, 2).alias("top")).where(
        F.size("top") == 2)
    best, second = F.col("top")[0], F.col("top")[1]
    moves = (top.where((best["score"] >= show) & (best["score"] - second["score"] >= margin))
             .select("song", F.col("parent").alias("node"), best["node"].alias("best")))
    walk = starts.withColumn("node", F.col("root"))
    may = allowed.select("label", F.col("node").alias("best"), F.lit(True).alias("ok"))
    for _ in range(2):  # three levels at most
        walk = (walk.join(moves, ["song", "node"], "left").join(may, ["label", "best"], "left")
                .withColumn("node", F.when(F.col("ok"), F.col("best")).otherwise(F.col("node")))
                .drop("best", "ok"))
    return walk


def route(present: DataFrame, p95: DataFrame, owned: DataFrame, label_nodes: DataFrame,
          subtypes: DataFrame, show: float = SHOW, margin: float = DESCEND_MARGIN) -> DataFrame:
    """Final instrument rows of every song.

    `present(song, label, confidence, stem, calibrated)`: rows whose label is in `owned(label)`
    are replaced by one row from our score of the label's node. `label_nodes(label, node)`,
    `subtypes(label, node)` list the nodes a label may be narrowed to. A narrowed row is capped by
    the confidence of the row it came from; otherwise the row says its subtype is uncertain.
    """
    theirs = present.join(owned, "label", "left_anti").select(
        "song", "label", "confidence", "stem", F.coalesce("calibrated", F.lit(False))
        .alias("calibrated"), F.lit("incumbent").alias("model"))
    ours = (p95.join(label_nodes.join(owned, "label", "left_semi"), "node")
            .where(F.col("score") >= show)
            .select("song", "label", F.bround("score", 3).alias("confidence"),
                    F.lit("mix").alias("stem"), F.lit(True).alias("calibrated"),
                    F.lit("own").alias("model")))
    rows = theirs.unionByName(ours).join(
        label_nodes.select("label", F.col("node").alias("root")), "label", "left")
    listed = subtypes.select("label").distinct().withColumn("listed", F.lit(True))
    known = p95.select("node").distinct().select(F.col("node").alias("root"),
                                                 F.lit(True).alias("trained"))
    rows = rows.join(listed, "label", "left").join(known, "root", "left")
    narrow = rows.where("listed and trained").drop("listed", "trained")
    plain = rows.where("listed is null or trained is null").select(
        "song", "label", F.col("root").alias("node"), "confidence", "stem", "calibrated", "model",
        F.lit(False).alias("subtype"), F.lit(False).alias("subtype_uncertain"))
    allowed = (subtypes.select("label", F.explode(ancestors_of("node")).alias("node")).distinct()
               .join(label_nodes.select("label", F.col("node").alias("top")), "label")
               .where(F.startswith("node", F.concat("top", F.lit(".")))).select("label", "node"))
    walked = descend(narrow, p95, allowed, show, margin).join(
        p95.select("song", "node", "score"), ["song", "node"], "left")
    capped = F.least(F.col("score"), F.col("confidence"))
    moved = (F.col("node") != F.col("root")) & F.coalesce(capped >= show, F.lit(False))
    deep = walked.select(
        "song", F.when(moved, F.col("node")).otherwise(
            F.concat("label", F.lit(" (subtype uncertain)"))).alias("label"),
        F.when(moved, F.col("node")).otherwise(F.col("root")).alias("node"),
        F.when(moved, F.bround(capped, 3)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(moved, "mix").otherwise(F.col("stem")).alias("stem"),
        F.when(moved, False).otherwise(F.col("calibrated")).alias("calibrated"),
        F.when(moved, "own").otherwise(F.col("model")).alias("model"),
        moved.alias("subtype"), (~moved).alias("subtype_uncertain"))
    return plain.unionByName(deep)


def score_entries(entries: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Report rows against the answer key: hit, false_alarm, unlabelled or unmapped.

    `entries(song, label, node, confidence, calibrated, subtype)`, `labels(item, node, y)`.
    """
    known = nodes.select("node", F.lit(True).alias("known"))
    truth = labels.select(F.col("item").alias("song"), "node", "y")
    rows = entries.join(known, "node", "left").withColumn(
        "node", F.when(F.col("known"), F.col("node"))).join(truth, ["song", "node"], "left")
    outcome = (F.when(F.col("node").isNull(), "unmapped").when(F.col("y"), "hit")
               .when(~F.col("y"), "false_alarm").otherwise("unlabelled"))
    return rows.select("song", "label", "node", "confidence", "subtype",
                       display_class(F.col("confidence"), F.col("calibrated"), F.col("subtype"))
                       .alias("shown_as"), family_of("node").alias("family"),
                       outcome.alias("outcome"))


def node_outcomes(scored: DataFrame, labels: DataFrame, nodes: DataFrame,
                  songs: DataFrame) -> DataFrame:
    """(song, node, truth, shown, shown_confident) for the wanted nodes of every song.

    An entry shows its node and every ancestor of it.
    """
    seen = (scored.where("node is not null")
            .select("song", F.explode(ancestors_of("node")).alias("node"),
                    (F.col("shown_as") == "confident").alias("sure"))
            .groupBy("song", "node").agg(F.bool_or("sure").alias("sure")))
    names = nodes.agg(F.array_sort(F.collect_list("node"))).scalar()
    truth = labels.select(F.col("item").alias("song"), "node", "y")
    return (songs.select("song", F.explode(names).alias("node"))
            .join(truth, ["song", "node"], "left").join(seen, ["song", "node"], "left")
            .select("song", "node", F.when(F.col("y"), "present").when(~F.col("y"), "absent")
                    .otherwise("unknown").alias("truth"), F.col("sure").isNotNull().alias("shown"),
                    F.coalesce("sure", F.lit(False)).alias("shown_confident")))


def subtype_agreement(scored: DataFrame) -> DataFrame:
    """Named subtypes: agree, disagree or unlabelled."""
    return scored.where("subtype").withColumn(
        "agreement", F.when(F.col("outcome") == "hit", "agree")
        .when(F.col("outcome") == "false_alarm", "disagree").otherwise("unlabelled"))


def assemble(songs: DataFrame, sections: dict[str, DataFrame], schema_version: int = 2) -> DataFrame:
    """(song, report): one JSON document per song with the status of every section.

    Each section is a table keyed by `song`; rows of a section become a list ordered by their
    fields. A song without rows in a section is marked `missing` there.
    """
    out = songs.select("song").distinct()
    for name, df in sections.items():
        fields = [c for c in df.columns if c != "song"]
        packed = df.groupBy("song").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        out = out.join(packed, "song", "left")
    parts = [F.when(F.col(n).isNull(), "missing").otherwise("ok").alias(n) for n in sections]
    return out.select("song", F.to_json(F.struct(
        F.lit(schema_version).alias("schema_version"), F.struct(*parts).alias("status"),
        *[F.col(n) for n in sections])).alias("report"))


def top_nodes(p95: DataFrame, level: int) -> DataFrame:
    """Best node of a level per song."""
    return (p95.where(level_of("node") == level).groupBy("song")
            .agg(F.max_by("node", F.struct("score", "node")).alias("node"),
                 F.max("score").alias("score")))
