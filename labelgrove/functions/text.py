"""Names, file-name decoding and note tokens."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the note and dynamics vocabularies.
SEMITONES = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
DYNAMICS = {"pp": 40, "p": 55, "mf": 80, "f": 100, "ff": 112}
WIDE_DYNAMICS = {"ppp": 30, "pp": 40, "p": 55, "mp": 68, "mf": 80, "f": 100, "ff": 112, "fff": 120,
                 "soft": 50, "med": 80, "medium": 80, "loud": 110, "hard": 110, "normal": 85}
NOTE = "^([A-G])(b|#)?(-?[0-9])$"
OPEN_STRINGS = {"1": 28, "2": 33, "3": 38, "4": 43}
# File-name patterns of the solo-note and effect collections (fixed values).
PLUCK_STYLE = "^BS_(\\d)_EQ_(\\d)_(FS|MU|PK|SP|ST)_NO_(\\d)_(\\d+)$"
SLIDE_STYLE = "^BS_(\\d)_EQ_(\\d)_PS_FS_ES_(SLU|SLD)_(\\d)_(\\d+)$"
EFFECT_NAME = "^([BGP])(\\d)(\\d)-(\\d{2})(\\d{3})-(\\d)(\\d{2})(\\d)-(\\d+)$"
SONG_ID = "TR[A-Z0-9]{16}"
PARTITION_KEY = "^[0-9]+_[0-9]+$"


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def lookup(table: dict, key: Column) -> Column:
    """Value of a small fixed table, null for other keys."""
    return F.when(key.isin(*table), _lookup(table, key))


@F.pandas_udf(T.StringType())
def fold_unicode(names: pd.Series) -> pd.Series:
    """NFKC and case folding, which Spark has no function for."""
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).casefold())


def unify(name: Column) -> Column:
    """Quotes unified, whitespace collapsed and trimmed."""
    q = F.translate(name, "‘’“”`", "''\"\"'")
    return F.trim(F.regexp_replace(q, "\\s+", " "))


def normalize_names(df: DataFrame, column: str, out: str,
                    aliases: DataFrame | None = None) -> DataFrame:
    """Adds the normalised name: NFKC, quotes, case folding, whitespace, then aliases.

    Only the distinct names pass through Python; they are joined back on the raw name.
    `aliases(alias, name)` are normalised the same way.
    """
    names = df.select(F.col(column).alias("__raw")).where("__raw is not null").distinct()
    clean = names.select("__raw", unify(fold_unicode("__raw")).alias("__n"))
    if aliases is not None:
        table = aliases.select(unify(fold_unicode("alias")).alias("__n"),
                               unify(fold_unicode("name")).alias("__to"))
        clean = clean.join(table, "__n", "left").select(
            "__raw", F.coalesce("__to", "__n").alias("__n"))
    return (df.join(clean, df[column] == F.col("__raw"), "left").drop("__raw")
            .withColumnRenamed("__n", out))


def artist_or_prefix(artist: Column, track: Column) -> Column:
    """Artist name, else the track id before its first underscore."""
    return F.coalesce(F.nullif(artist, F.lit("")), F.substring_index(track, "_", 1))


def group_key(normalized: Column) -> Column:
    """Grouping key: the normalised name without anything but letters and digits."""
    return F.regexp_replace(normalized, "[^\\p{L}\\p{N}]+", "")


def instrument_key(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^0-9a-z]+", "_"), "^_+|_+$", "")


def truth_value(v: Column) -> Column:
    """yes/true and no/false in any case; anything else is unknown."""
    s = F.lower(F.trim(v.cast("string")))
    return F.when(s.isin("yes", "true"), True).when(s.isin("no", "false"), False)


def as_list(v: Column) -> Column:
    """A JSON list or a plain string as a list; nulls dropped, null becomes empty."""
    none = F.array().cast("array<string>")
    is_list = F.startswith(F.trim(v), F.lit("["))
    parsed = F.from_json(F.when(is_list, v), "array<string>")
    return (F.when(v.isNull(), none).when(is_list, F.filter(parsed, lambda x: x.isNotNull()))
            .otherwise(F.array(v)))


def composition_key(path: Column, content: Column) -> Column:
    """`artist/title` of `.../Artist/Title.N.mid`; the content's MD5 for files without a folder."""
    parts = F.split(path, "/")
    title = F.lower(F.trim(F.substring_index(F.element_at(parts, -1), ".", 1)))
    artist = F.lower(F.trim(F.get(parts, F.size(parts) - 2)))
    return F.when(F.size(parts) >= 2, F.concat_ws("/", artist, title)).otherwise(F.md5(content))


def artist_key(composition: Column) -> Column:
    return F.substring_index(composition, "/", 1)


def track_split(track: Column) -> Column:
    """Split of `TrackNNNNN` ids by number: 1-1500, 1501-1875, 1876-2100."""
    n = F.regexp_extract(track, "^Track(\\d{5})$", 1)
    k = F.nullif(n, F.lit("")).cast("int")
    bad = F.raise_error(F.concat(F.lit("track id out of range: "), track)).cast("string")
    return (F.when(k.between(1, 1500), "train").when(k.between(1501, 1875), "val")
            .when(k.between(1876, 2100), "test").otherwise(bad))


def canonical_split(tracks: DataFrame, mode: str, omitted: DataFrame, moves: DataFrame) -> DataFrame:
    """Adds `split` under `orig`, `redux` (omitted tracks) or `split2` (moved tracks).

    `omitted(track)`, `moves(track, dest)` are the override tables.
    """
    if mode not in ("redux", "split2", "orig"):
        raise ValueError("split mode must be redux, split2 or orig")
    base = tracks.withColumn("split", track_split(F.col("track")))
    if mode == "redux":
        gone = omitted.select("track", F.lit("omitted").alias("__s"))
    elif mode == "split2":
        dest = F.when(F.col("dest") == "validation", "val").otherwise(F.col("dest"))
        gone = moves.select("track", dest.alias("__s"))
    else:
        return base
    return (base.join(gone, "track", "left")
            .withColumn("split", F.coalesce("__s", "split")).drop("__s"))


def note_to_midi(name: Column) -> Column:
    """MIDI number of a note name such as `C4`, `Bb3` or `F#-1`; null for other text."""
    letter, accidental = F.regexp_extract(name, NOTE, 1), F.regexp_extract(name, NOTE, 2)
    octave = F.nullif(F.regexp_extract(name, NOTE, 3), F.lit("")).cast("int")
    shift = F.when(accidental == "b", -1).when(accidental == "#", 1).otherwise(0)
    return F.when(F.rlike(name, F.lit(NOTE)),
                  12 * (octave + 1) + lookup(SEMITONES, letter) + shift).cast("int")


def parse_tokens(stem: Column) -> Column:
    """STRUCT<pitches, velocity> of a dotted file name; a range such as `E2B2` gives both ends."""
    tokens = F.split(stem, "[.]")
    both = "^([A-G][b#]?-?[0-9])([A-G][b#]?-?[0-9])$"
    named = F.flatten(F.transform(tokens, lambda t: F.when(
        F.rlike(t, F.lit(both)), F.array(note_to_midi(F.regexp_extract(t, both, 1)),
                                         note_to_midi(F.regexp_extract(t, both, 2))))
        .otherwise(F.array(note_to_midi(t)))))
    levels = F.array_compact(F.transform(tokens, lambda t: lookup(DYNAMICS, F.lower(t))))
    return F.struct(F.array_compact(named).alias("pitches"),
                    F.get(levels, F.size(levels) - 1).alias("velocity"))


def layered_tokens(stem: Column) -> Column:
    """STRUCT<pitch, velocity, rr> of a name with dynamics, layers, takes and a pitch.

    Later tokens override earlier ones; velocity starts at 80 and the round robin at 1.
    """
    tokens = F.split(stem, "[_\\s]+")

    def judge(tok: Column) -> Column:
        t = F.lower(tok)
        word, take = F.regexp_extract(t, "^([a-z]+)(\\d)$", 1), F.regexp_extract(t, "^([a-z]+)(\\d)$", 2)
        plain = lookup(WIDE_DYNAMICS, t)
        numbered = lookup(WIDE_DYNAMICS, word)
        layer = F.when(F.rlike(t, F.lit("^vl?\\d$")), 30 + 22 * F.right(t, F.lit(1)).cast("int"))
        robin = F.when(F.rlike(t, F.lit("^rr\\d+$")), F.substring(t, 3, 1_000_000).try_cast("int")).when(
            F.rlike(t, F.lit("^\\d{1,2}$")), t.try_cast("int"))
        robin = F.when(numbered.isNotNull() & plain.isNull(), F.nullif(take, F.lit("")).cast("int")
                       ).otherwise(robin)
        velocity = F.coalesce(plain, numbered, layer)
        other = plain.isNull() & numbered.isNull() & layer.isNull() & robin.isNull()
        return F.struct(velocity.alias("v"), robin.alias("r"),
                        F.when(other, note_to_midi(tok)).alias("p"))

    start = F.struct(F.lit(None).cast("int").alias("pitch"), F.lit(80).alias("velocity"),
                     F.lit(1).alias("rr"))
    return F.aggregate(F.transform(tokens, judge), start, lambda acc, j: F.struct(
        F.coalesce(j["p"], acc["pitch"]).alias("pitch"),
        F.coalesce(j["v"], acc["velocity"]).alias("velocity"),
        F.coalesce(j["r"], acc["rr"]).alias("rr")))


def pitch_ok(estimate: Column, named: Column, octave_free: bool = False,
             tolerance: float = 0.6) -> Column:
    """Whether an estimated pitch confirms the named one, optionally in any octave."""
    d = estimate - named
    if octave_free:
        d = F.pmod(d + 6, F.lit(12.0)) - 6
    return F.coalesce(F.abs(d) <= tolerance, F.lit(False))


def shift_by_folder(files: DataFrame, shifts: DataFrame) -> DataFrame:
    """Named pitch moved by the shift of its folder; other folders stay."""
    return (files.join(shifts.select("folder", "shift"), "folder", "left")
            .withColumn("pitch", F.col("pitch") + F.coalesce("shift", F.lit(0))).drop("shift"))


def bass_note(name: Column) -> Column:
    """STRUCT<bass, pickup, style, string, fret, pitch> of a solo-note file name, else null."""
    plucked, slid = F.rlike(name, F.lit(PLUCK_STYLE)), F.rlike(name, F.lit(SLIDE_STYLE))

    def part(i: int) -> Column:
        return F.when(plucked, F.regexp_extract(name, PLUCK_STYLE, i)).otherwise(
            F.regexp_extract(name, SLIDE_STYLE, i))

    pitch = lookup(OPEN_STRINGS, part(4)) + F.nullif(part(5), F.lit("")).cast("int")
    return F.when(plucked | slid, F.struct(
        part(1).alias("bass"), F.nullif(part(2), F.lit("")).cast("int").alias("pickup"),
        part(3).alias("style"), F.nullif(part(4), F.lit("")).cast("int").alias("string"),
        F.nullif(part(5), F.lit("")).cast("int").alias("fret"), pitch.alias("pitch")))


EFFECT_FIELDS = ("instrument", "setting", "playstyle", "midi", "rest", "fxgroup", "fxtype",
                 "fxsetting", "filenr")


def effect_note(name: Column) -> Column:
    """STRUCT of the nine fields of an effect-note file name, else null."""
    return F.when(F.rlike(name, F.lit(EFFECT_NAME)), F.struct(*[
        F.regexp_extract(name, EFFECT_NAME, i + 1).alias(f) for i, f in enumerate(EFFECT_FIELDS)]))


def same_number(a: Column, b: Column) -> Column:
    """Equality of numeric codes, ignoring leading zeros."""
    return F.regexp_replace(a, "^0+(?=.)", "") == F.regexp_replace(b, "^0+(?=.)", "")


def window_tag(start_s: Column) -> Column:
    """`w20` or `w2.5`: the start in its shortest decimal form."""
    whole = start_s == F.floor(start_s)
    return F.concat(F.lit("w"), F.when(whole, F.floor(start_s).cast("string")).otherwise(
        start_s.cast("string")))


def song_ids(text: Column) -> Column:
    """First song id inside a text; null without one."""
    return F.nullif(F.regexp_extract(text, SONG_ID, 0), F.lit(""))


def redact_urls(text: Column) -> Column:
    return F.regexp_replace(text, "https?://\\S+", "<url>")
