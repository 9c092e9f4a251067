"""Dated URL lists joined to captures as of their fetch time.

List entries (list, pattern, action, at) become validity intervals per list and pattern. A capture
is looked up under its host, every parent domain and every path prefix; intervals are cut into
slices of time, so that a lookup meets only intervals of its own slice, however long a pattern's
history is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelgrove.llm.common import prepare

#: Days in a slice of time.
SLICE = 32


def host_of(url: Column) -> Column:
    """Lower-case host without user, port, `www.` and a final dot; empty if there is none."""
    authority = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    name = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"\.$", ""), r"^www\.", "")


def path_of(url: Column) -> Column:
    """Path without query and fragment, without the final slash."""
    path = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)
    return F.regexp_replace(path, "/+$", "")


def lookup_keys(url: Column) -> Column:
    """Patterns that would list the URL: `host`, parent domains, and `host/a`, `host/a/b`, ..."""
    labels, steps = F.split(host_of(url), r"\."), F.split(path_of(url), "/")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))
    paths = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(
        host_of(url), F.array_join(F.slice(steps, 1, i), "/")))
    return F.when(host_of(url) != "", F.array_distinct(F.concat(domains, paths))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, since, until) of times [since, until) during which a pattern is listed.

    Entries repeated at one time count once; if a pattern is both added and removed at one time,
    it is listed. Rows with a null field are no entries. `until` is null for what is still listed.
    """
    dated = entries.where("list is not null and pattern is not null and at is not null and action in ('add', 'remove')")
    states = dated.groupBy("list", "pattern", "at").agg(F.max((F.col("action") == "add").cast("int")).alias("on"))
    each = Window.partitionBy("list", "pattern").orderBy("at")
    turns = states.withColumn("was", F.coalesce(F.lag("on").over(each), F.lit(0))).where("on != was")
    return turns.withColumn("until", F.lead("at").over(each)).where("on = 1").select(
        "list", "pattern", F.col("at").alias("since"), "until")


def listed(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, list, pattern, since): list entries active for a capture (id, url, at) when it was
    fetched; per capture and list the most specific (longest) pattern.

    A null or unreadable URL and a null fetch time match nothing. Repeated captures give one result
    per id, list and pattern.
    """
    prepare(captures.sparkSession)
    number = lambda c: F.floor(F.unix_date(F.to_date(c)) / SLICE)
    asked = captures.where(F.col("at").isNotNull() & F.col("url").isNotNull()).select(
        "id", F.col("at").alias("fetched"), F.explode(lookup_keys(F.col("url"))).alias("key"),
        number("at").alias("slice"))
    last = F.lit(captures.agg(F.max(number("at"))).first()[0]).cast("long")
    spans = intervals(entries).withColumn("end", F.least(F.coalesce(number("until"), last), last)).where(
        number("since") <= F.col("end")).withColumn("slice", F.explode(F.sequence(number("since"), F.col("end"))))
    active = asked.join(spans.select("list", "pattern", "since", "until", "slice"), (
        (F.col("key") == F.col("pattern")) & (asked["slice"] == spans["slice"]) & (F.col("since") <= F.col("fetched"))
        & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))))
    return active.groupBy("id", "list").agg(
        F.max(F.struct(F.length("pattern").alias("size"), F.col("pattern"), F.col("since"))).alias("best")).select(
        "id", "list", "best.pattern", "best.since")
