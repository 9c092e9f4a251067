"""Kernels over arrays of samples, chroma and beats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelgrove.functions.scores import power_db
from labelgrove.operators.scan import previous_value, time_chunk

# Key profiles by semitone above the tonic, and pitch names (fixed values).
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def levels(tracks: DataFrame, keys: list[str], samples: str, frame: int) -> DataFrame:
    """(keys, rms_db, peak_frame_db): level of the whole window and of its loudest full frame."""
    n = F.size(samples)
    squares = F.transform(samples, lambda x: x * x)
    frames = F.transform(F.sequence(F.lit(1), F.greatest(F.floor(n / frame).cast("int"), F.lit(1))),
                         lambda i: F.slice(squares, (i - 1) * frame + 1, F.lit(frame)))
    whole = F.when(n > 0, array_sum(squares) / n)
    loudest = F.when(n >= frame, F.array_max(F.transform(frames, lambda f: array_sum(f) / frame)))
    return tracks.select(*keys, level(whole).alias("rms_db"),
                         level(F.coalesce(loudest, whole)).alias("peak_frame_db"))


def level(power: Column) -> Column:
    return F.bround(power_db(power), 2)


def levels_long(samples: DataFrame, keys: list[str], frame: int) -> DataFrame:
    """The same from one row per sample(keys, i, x): two partial aggregates, no long arrays."""
    frames = samples.groupBy(*keys, F.floor(F.col("i") / frame).alias("f")).agg(
        F.sum(F.col("x") * F.col("x")).alias("e"), F.count(F.lit(1)).alias("n"))
    whole = F.sum("e") / F.sum("n")
    loudest = F.max(F.when(F.col("n") == frame, F.col("e") / frame))
    return frames.groupBy(*keys).agg(level(whole).alias("rms_db"),
                                     level(F.coalesce(loudest, whole)).alias("peak_frame_db"))


def windows(df: DataFrame, keys: list[str], samples: str, size: int, min_size: int) -> DataFrame:
    """(keys, w, part): consecutive windows; a short tail is dropped unless it is the only window,
    and short windows are padded with zeros."""
    n = F.size(samples)
    count = F.greatest(F.ceil(n / size).cast("int"), F.lit(1))
    rows = df.select(*keys, samples, n.alias("n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("w"))
    part = F.slice(samples, F.col("w") * size + 1, F.lit(size))
    keep = (F.size(part) >= min_size) | (F.col("w") == 0)
    pad = F.array_repeat(F.lit(0.0), F.lit(size) - F.size(part))
    return rows.where(keep).select(*keys, "w", F.concat(part.cast("array<double>"), pad).alias("part"))


def nonlinearity(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Residual of y after its best scalar fit of x, relative to the fit; 0 where x or the fit is."""
    xx = array_sum(F.transform(x, lambda a: a * a))
    fitted = df.withColumns({"__xx": xx, "__g": array_sum(F.zip_with(x, y, lambda a, b: a * b)) / xx})
    rest = array_sum(F.zip_with(x, y, lambda a, b: (b - F.col("__g") * a) * (b - F.col("__g") * a)))
    size = F.abs("__g") * F.sqrt("__xx")
    return fitted.select(*keys, F.when((F.col("__xx") > 0) & (size > 0), F.sqrt(rest) / size)
                         .otherwise(F.lit(0.0)).alias("residual"))


def detect_key(chroma: DataFrame, keys: list[str], bins: str = "chroma") -> DataFrame:
    """(keys, key, confidence): best of the 24 rotated profiles by correlation; the confidence is
    the margin over the second best, squashed into [0.05, 0.99]."""
    mean = array_sum(F.col(bins)) / 12
    c = F.transform(bins, lambda x: x.cast("double") - mean)
    norm = F.sqrt(array_sum(F.transform(c, lambda x: x * x)))
    rows = chroma.select(*keys, c.alias("__c"), norm.alias("__n"))
    candidates = []
    for shift in range(12):
        for mode, profile in (("major", MAJOR), ("minor", MINOR)):
            avg = sum(profile) / 12
            centred = [v - avg for v in profile]
            size = sum(v * v for v in centred) ** 0.5
            # profile bin k meets chroma bin (k + shift) mod 12
            turned = [centred[(b - shift) % 12] / size for b in range(12)]
            dot = array_sum(F.zip_with("__c", F.array(*[F.lit(v) for v in turned]), lambda a, b: a * b))
            candidates.append(F.struct((dot / F.col("__n")).alias("r"),
                                       F.lit(-len(candidates)).alias("o"),
                                       F.lit(f"{NAMES[shift]} {mode}").alias("key")))
    top = F.slice(F.sort_array(F.array(*candidates), asc=False), 1, 2)
    ranked = rows.withColumn("__t", top)
    margin = F.col("__t")[0]["r"] - F.col("__t")[1]["r"]
    return ranked.select(*keys, F.col("__t")[0]["key"].alias("key"), F.round(F.least(F.greatest(
        0.5 + margin * 4, F.lit(0.05)), F.lit(0.99)), 2).alias("confidence"))


def beat_regularity(beats: DataFrame, keys: list[str], t: str = "t",
                    seconds_per_chunk: int = 86400) -> DataFrame:
    """(keys, regularity): 1 - std/mean of the gaps between beats, in [0.05, 0.99]; 0.2 for up to
    three beats."""
    chunked = beats.withColumn("__chunk", time_chunk(F.timestamp_seconds(t), seconds_per_chunk))
    gaps = previous_value(chunked, keys, "__chunk", [F.col(t)], {t: "__before"})
    gap = F.col(t) - F.col("__before")
    spread = F.stddev_pop(gap) / (F.avg(gap) + 1e-9)
    return gaps.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) > 3, F.least(F.greatest(1 - spread, F.lit(0.05)), F.lit(0.99)))
        .otherwise(F.lit(0.2)).alias("regularity"))


def waveform_buckets(df: DataFrame, keys: list[str], samples: str, width: int) -> DataFrame:
    """(keys, b, lo, hi): minimum and maximum of each of `width` equal slices of the samples."""
    n = F.size(samples)
    step = F.greatest(F.floor(n / width).cast("int"), F.lit(1))
    rows = df.select(*keys, samples, step.alias("__s"), F.explode(F.sequence(
        F.lit(0), F.least(F.lit(width), n) - 1)).alias("b"))
    part = F.slice(samples, F.col("b") * F.col("__s") + 1, F.col("__s"))
    return rows.select(*keys, "b", F.array_min(part).alias("lo"), F.array_max(part).alias("hi"))


def block_percent(start_s: Column, end_s: Column, duration_s: Column) -> Column:
    """Left edge and width of an interval in percent of the duration."""
    return F.struct((100 * start_s / duration_s).alias("left"),
                    (100 * (end_s - start_s) / duration_s).alias("width"))


def intervals_to_array(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals of a series as one sorted array, the form stored in reports."""
    return intervals.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.array("start_s", "end_s"))).alias("activations"))


def array_to_intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, F.explode("activations").alias("a")).select(
        *keys, F.col("a")[0].alias("start_s"), F.col("a")[1].alias("end_s"))
