"""Removal of repeated passages by seed and extend.

Every window of WINDOW words is represented by one of its SEED-word grams, the least in a fixed
order (winnowing), so equal windows share their anchor. Consecutive windows with the same anchor
form a segment: the anchor extended to both sides as far as it stays the chosen one. Segments with
the same anchor and the same content are repeats as a whole; segments that share an anchor but
differ further out are extended word by word, that is, window by window.

Grams of a large share of the corpus come last in the order, so that a very common line is an
anchor only for windows that consist of such grams. A task reports equal segments once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrove.llm.common import from_key, keyed_texts, packed_texts, prepare, stored, unpack
from labelgrove.llm.kernels import SPAN_BASE, Words, mix, runs_hash, white_words, word_blocks

WINDOW = 20
SEED = 6
#: Grams with at least this share of all grams are ordered last; at most 1 / COMMON of them exist.
COMMON = 1e-4
#: Rows that a task gathers before it merges equal ones.
GATHER = 1_000_000

_SEGMENT = "anchor long, span long, doc long, start int, windows int, removed boolean"


def _count_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush():
        grams, counts = np.unique(np.concatenate(held), return_counts=True)
        many = counts >= max(2, COMMON * counts.sum())
        return pa.record_batch([pa.array(np.append(grams[many].view(np.int64), 0)),
                                pa.array(np.append(counts[many], counts.sum())),
                                pa.array(np.append(np.zeros(many.sum(), bool), True))], ["gram", "n", "total"])

    held, size = [], 0
    for batch in batches:
        for _, _, words in word_blocks(batch.column(0)):
            held.append(words.grams(SEED)[words.whole(SEED)])
            size += len(held[-1])
            if size >= GATHER:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def common_grams(texts: DataFrame) -> np.ndarray:
    """Grams that take at least the share COMMON of all grams wherever they are frequent; sorted,
    at most 1 / COMMON."""
    counted = texts.select("text").mapInArrow(_count_common, "gram long, n long, total boolean")
    sums = stored(counted.groupBy("total", "gram").agg(F.sum("n").alias("n")), "grams")
    whole = sums.where("total").agg(F.sum("n")).first()[0] or 0
    rows = sums.where(~F.col("total") & (F.col("n") >= max(2.0, COMMON * whole))).select("gram").collect()
    return np.sort(np.array([r.gram for r in rows], np.int64).view(np.uint64))


def _least_in_windows(order: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value among `width` values from each position on."""
    at, span = np.arange(len(order)), 1

    def merge(a, b):
        return np.where(order[a] <= order[b], a, b)
    while 2 * span <= width:
        at = merge(at[:-span], at[span:])
        span *= 2
    return merge(at[:len(at) - (width - span)], at[width - span:]) if span < width else at


def block_segments(words: Words, docs: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, span, doc, start, windows) of every segment of a block."""
    at = words.whole(WINDOW)
    if not len(at):
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int32, np.int32))
    grams = words.grams(SEED)
    order = grams >> np.uint64(1)
    if len(common):
        place = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        order |= (common[place] == grams).astype(np.uint64) << np.uint64(63)
    anchor = _least_in_windows(order, WINDOW - SEED + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(anchor) != 0)
    first = np.flatnonzero(new)
    start, count, seed = at[first], np.diff(np.append(first, len(at))), anchor[first]
    span = runs_hash(words.hash, start, start + count - 1 + WINDOW, SPAN_BASE)
    own = np.repeat(np.arange(len(words.n)), words.n)[start]
    return (grams[seed], mix(span ^ (seed - start).astype(np.uint64)), docs[own],
            (start - words.bounds[own]).astype(np.int32), count.astype(np.int32))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before in any of the columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _later(new: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """True for rows that lie at another place than the first row of their run."""
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    return (doc != doc[head]) | (start != start[head])


def _segments(common: np.ndarray):
    def flush(held):
        anchor, span, doc, start, count = (np.concatenate(x) for x in zip(*held, strict=True))
        by = np.lexsort((start, doc, span, anchor))
        anchor, span, doc, start, count = (x[by] for x in (anchor, span, doc, start, count))
        new = _runs(anchor, span)
        later = _later(new, doc, start)
        keep = new | later
        # what is already known to be a repeat needs no comparison: any key will do
        anchor = np.where(later, mix(doc.astype(np.uint64) * np.uint64(31) + start.astype(np.uint64)), anchor)
        return pa.record_batch([pa.array(x[keep]) for x in (
            anchor.view(np.int64), span.view(np.int64), doc, start, count, later)],
            ["anchor", "span", "doc", "start", "windows", "removed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            docs = batch.column(0).to_numpy()
            for at, to, words in word_blocks(batch.column(1)):
                held.append(block_segments(words, docs[at:to], common))
                size += len(held[-1][0])
                if size >= GATHER:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)
    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted segments in, repeats (removed) and the first of each differing segment out. Only the
    first segments of the anchor at hand are held between batches."""
    def out(anchor, doc, start, count, removed):
        return pa.record_batch([pa.array(x) for x in (anchor, doc, start, count, np.full(len(doc), removed))],
                               ["anchor", "doc", "start", "windows", "removed"])

    held = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        known = columns[5]
        if known.any():
            yield out(*[columns[i][known] for i in (0, 2, 3, 4)], True)
        columns = [c[~known] for c in columns[:5]]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        anchor, span, doc, start, count = columns
        if not len(anchor):
            continue
        new = _runs(anchor, span)
        later = _later(new, doc, start)
        yield out(anchor[later], doc[later], start[later], count[later], True)
        heads = [c[new] for c in columns]
        last = heads[0] == heads[0][-1]
        held = [c[last] for c in heads]
        yield from _differing([c[~last] for c in heads], out)
    if held is not None:
        yield from _differing(held, out)


def _differing(heads, out):
    if len(heads[0]):
        group = np.cumsum(_runs(heads[0])) - 1
        several = np.bincount(group)[group] > 1
        yield out(*[heads[i][several] for i in (0, 2, 3, 4)], False)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows of listed segments: (anchor, content, doc, start)."""
    for batch in batches:
        for doc, packed, segments in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = np.frombuffer(unpack(packed), np.uint8)
            hashes = Words(data, np.array([0, len(data)]), white_words(), False).grams(WINDOW, SPAN_BASE)
            at = np.concatenate([np.arange(s["start"], s["start"] + s["windows"]) for s in segments])
            anchor = np.repeat([s["anchor"] for s in segments], [s["windows"] for s in segments])
            at, anchor = (at[at < len(hashes)], anchor[at < len(hashes)])
            yield pa.record_batch([pa.array(anchor), pa.array(hashes[at].view(np.int64)),
                                   pa.array(np.full(len(at), doc)), pa.array(at.astype(np.int32))],
                                  ["anchor", "content", "doc", "start"])


def repeated_ranges(documents: DataFrame) -> DataFrame:
    """(doc, start, words): runs of words whose windows all occur earlier too. `doc` is a key."""
    texts = keyed_texts(documents)
    segments = texts.mapInArrow(_segments(common_grams(texts)), _SEGMENT)
    compared = stored(segments.repartition("anchor").sortWithinPartitions("anchor", "span", "doc", "start").mapInArrow(
        _compare, "anchor long, doc long, start int, windows int, removed boolean"), "segments")
    differing = compared.where("not removed").groupBy("doc").agg(
        F.collect_list(F.struct("anchor", "start", "windows")).alias("segments"))
    windows = stored(packed_texts(texts).join(differing, "doc").select("doc", "packed", "segments").mapInArrow(
        _windows, "anchor long, content long, doc long, start int"), "windows")
    first = windows.groupBy("anchor", "content").agg(
        F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = windows.join(first, ["anchor", "content"]).where(F.struct("doc", "start") != F.col("first"))
    whole = compared.where("removed").select("doc", "start", (F.col("windows") - 1 + WINDOW).alias("words"))
    return whole.unionByName(later.select("doc", "start", F.lit(WINDOW).alias("words")))


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, packed, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = unpack(packed).split()
            gone = np.zeros(len(words), bool)
            for r in ranges or ():
                gone[r["start"]:r["start"] + r["words"]] = True
            kept = b" ".join([words[i] for i in np.flatnonzero(~gone)] if ranges else words)
            out.append((doc, len(words), int(gone.sum()), kept.decode()))
        yield pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate(
            (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc", "n_words", "n_removed", "kept_text"])


def remove_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for every row.

    Texts of fewer than WINDOW words, empty and null ones lose nothing. A null id sorts before all
    others. Rows that share a doc_id lie at the same places: none counts as earlier than the other,
    and what is repeated in one is removed from all of them. Other columns are ignored.
    """
    prepare(documents.sparkSession)
    ranges = repeated_ranges(documents).groupBy("doc").agg(F.collect_list(F.struct("start", "words")).alias("ranges"))
    return packed_texts(keyed_texts(documents)).join(ranges, "doc", "left").select("doc", "packed", "ranges").mapInArrow(
        _strip, "doc long, n_words long, n_removed long, kept_text string").select(
        from_key("doc").alias("doc_id"), "n_words", "n_removed", "kept_text")


def kept_hash(kept: str = "kept_text"):
    return F.sha2(F.col(kept).cast("binary"), 256)
