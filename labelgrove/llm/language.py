"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams of one to three symbols in order; a
document's own list is compared with each profile by the out-of-place distance: the sum over its
n-grams of how far their ranks lie apart, with the longest distance for those a profile lacks.
Symbols are all letters of Unicode, lower-cased, and one symbol for whatever stands between words,
so a script that few training texts use keeps its own n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelgrove.llm.common import crc_of_id, held, prepare

#: N-grams in a profile.
RANKS = 300
#: Documents per language that profiles are made from, at most.
SAMPLE = 20_000
#: Different n-grams that a task holds before it passes its counts on.
HELD = 1_000_000
UNKNOWN = "und"

#: An n-gram is a number: up to three code points of 21 bits, the last in the lowest bits. GAP (no
#: letter) stands for whatever lies between words; as it is not 0, n-grams of all sizes differ.
_BITS, GAP = 21, 1


def _lower_letters() -> np.ndarray:
    """Code point of the lower-case letter for each code point; 0 for what is no letter."""
    return held("letters", _make_letters)


def _make_letters() -> np.ndarray:
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The different n-grams of a text in order and their counts, or None if it has no letter."""
    own = _lower_letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    own = np.concatenate([[0], own, [0]]).astype(np.int64)
    keep = np.ones(len(own), bool)
    keep[1:] = (own[1:] != 0) | (own[:-1] != 0)
    own = np.maximum(own[keep], GAP)
    if len(own) < 3:
        return None
    pairs = (own[:-1] << _BITS) | own[1:]
    triples = ((own[:-2] << 2 * _BITS) | pairs[1:])[own[1:-1] != GAP]
    return np.unique(np.concatenate([own[own != GAP], pairs, triples]), return_counts=True)


def top_grams(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent n-grams in order; equal counts by n-gram number."""
    if len(grams) > RANKS:
        some = counts >= np.partition(counts, len(counts) - RANKS)[len(counts) - RANKS]
        grams, counts = grams[some], counts[some]
    return grams[np.lexsort((grams, -counts))][:RANKS]


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of each language, added up within a task as far as HELD lets it."""
    parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    held_now = 0
    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = gram_counts(text)
            if found is None:
                continue
            parts.setdefault(lang, []).append(found)
            held_now += len(found[0])
            if held_now > HELD:
                parts = {name: [_added(p)] for name, p in parts.items()}
                held_now = sum(len(p[0][0]) for p in parts.values())
                if held_now > HELD // 2:
                    yield _rows(parts)
                    parts, held_now = {}, 0
    if parts:
        yield _rows(parts)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([p[1] for p in parts]), len(grams)).astype(np.int64)


def _rows(parts: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> pa.RecordBatch:
    sums = {lang: _added(p) for lang, p in parts.items()}
    return pa.record_batch([
        pa.array([lang for lang, (grams, _) in sums.items() for _ in range(len(grams))], pa.string()),
        pa.array(np.concatenate([grams for grams, _ in sums.values()])),
        pa.array(np.concatenate([counts for _, counts in sums.values()]))], ["lang", "gram", "n"])


class Profiles:
    """At most RANKS n-grams in order for each language."""

    def __init__(self, ranked: dict[str, list[int]]):
        self.ranked = dict(sorted(ranked.items()))

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams of any profile in order, and the rank of each in each language (-1: none).
        The last column stands for n-grams that no profile holds."""
        grams = np.unique(np.array([g for own in self.ranked.values() for g in own], np.int64))
        place = np.full((len(self.ranked), len(grams) + 1), -1, np.int32)
        for i, own in enumerate(self.ranked.values()):
            place[i, np.searchsorted(grams, own)] = np.arange(len(own))
        return grams, place


def chosen_rows(known: DataFrame, sample: int) -> DataFrame:
    """(lang, text) of at most `sample` rows of each language: those with the least hashes of id and
    text. Rows that share both stand together, in or out. Only hashes are shuffled."""
    sizes = {r.lang: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return known.select("lang", "text")
    span = 1 << 62
    hashed = known.withColumn("__h", F.xxhash64("doc_id", "text").bitwiseAND(F.lit(span - 1)))
    # a little more than needed, so that few hashes are ranked; no bound where all rows fit
    near = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(span * min(1.0, 1.25 * (sample + 100) / n)))])
    some = hashed.where(F.col("__h") < near[F.col("lang")])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("__h"))
    beyond = some.select("lang", "__h", nth.alias("nth")).where(F.col("nth") <= sample + 1).where(F.col("nth") == sample + 1)
    cut = {r.lang: r["__h"] for r in beyond.collect()}
    if cut:
        most = F.coalesce(F.create_map(*[F.lit(x) for p in cut.items() for x in p])[F.col("lang")], F.lit(span))
        some = some.where(F.col("__h") < most)
    return some.select("lang", "text")


def train(labelled: DataFrame, sample: int = SAMPLE) -> Profiles:
    """Profiles of the languages in (doc_id, text, lang); rows with a null text or lang are left out.

    At most `sample` documents of each language are read."""
    known = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    grams = chosen_rows(known, sample).mapInArrow(_gram_rows, "lang string, gram long, n long").groupBy(
        "lang", "gram").agg(F.sum("n").alias("n"))
    best = grams.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= RANKS)
    ranked: dict[str, list[int]] = {}
    for r in sorted(best.collect(), key=lambda r: (r.lang, r["rank"])):
        ranked.setdefault(r.lang, []).append(r.gram)
    return Profiles(ranked)


def _predict(profiles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(profiles.value.ranked)
        grams, place = profiles.value.places()
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(2).to_pylist():
                found = gram_counts(text) if text and names else None
                if found is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                top = top_grams(*found)
                at = np.searchsorted(grams, top)
                at[grams[np.minimum(at, len(grams) - 1)] != top] = len(grams)
                theirs = place[:, at]
                far = np.where(theirs < 0, RANKS, np.abs(theirs - np.arange(len(top))))
                distance = far.sum(1)
                best = int(distance.argmin())
                langs.append(names[best])
                scores.append(1.0 - float(distance[best]) / (RANKS * len(top)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(langs, pa.string()),
                                   pa.array(scores, pa.float64())], ["doc_id", "mark", "lang_pred", "score"])
    return run


def predict(documents: DataFrame, profiles: Profiles, mark: str) -> DataFrame:
    """(doc_id, mark, lang_pred, score). The score is one less the out-of-place distance as a share
    of the longest; texts that are null or have no letter are `und` with score 0. `mark` is any
    boolean column carried along."""
    sent = documents.sparkSession.sparkContext.broadcast(profiles)
    return documents.select("doc_id", F.col(mark).alias("mark"), "text").mapInArrow(
        _predict(sent), "doc_id long, mark boolean, lang_pred string, score double")


def identify(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; profiles come from rows whose
    crc32(doc_id as text) mod 3 is not 1 (a null id counts as the empty text).

    Without a labelled training row every document is `und`. Other columns are ignored.
    """
    prepare(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn(
        "held_out", crc_of_id() % 3 == 1)
    found = predict(rows, train(rows.where("not held_out")), "held_out")
    return found.select("doc_id", F.col("mark").alias("held_out"), "lang_pred", "score")


def _carry(profiles):
    inner = _predict(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            rows = pa.nulls(batch.num_rows)
            found = next(inner(iter([pa.record_batch([rows, rows, batch.column(at)], ["a", "b", "text"])])))
            yield batch.filter(pc.not_equal(found.column(2), UNKNOWN))
    return run


def with_language(documents: DataFrame) -> DataFrame:
    """The documents that have a language, with their columns: those without any letter go."""
    prepare(documents.sparkSession)
    rows = documents.withColumn("__held", crc_of_id() % 3 == 1)
    sent = documents.sparkSession.sparkContext.broadcast(train(rows.where("not __held")))
    return documents.mapInArrow(_carry(sent), documents.schema)
