"""Removal of every byte string of LENGTH bytes that occurs more than once, by suffix order.

Equal strings are brought together first. Each string of LENGTH bytes is represented by the least of its
SEED-byte grams; consecutive strings with the same one form a segment, and segments go to the task of
their gram. Equal segments are merged where they arise, so copies cost one row per task; a segment
that occurs twice is a repeat as a whole. Where different segments share a gram, their texts are
fetched, and the repeats among them follow from their Burrows-Wheeler transform (`bwt`). Segments
of a gram with more than CROWD spans in one task are such different ones for certain: they need
not meet for that and are spread over all tasks.

A group whose texts exceed GROUP_BYTES is cut by content: strings are told apart by how far their gram
lies from their start, in steps of WIDTHS, and by the bytes that all strings of such a class share. With
a step of one these are the whole strings, so every group comes apart or merges in the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrove.llm.bwt import repeated_starts
from labelgrove.llm.common import doc_key, from_key, prepare, stored, unpack
from labelgrove.llm.kernels import RUN_BASE, SPAN_BASE, _byte_values, mix, runs_hash, text_blocks
from labelgrove.llm.repeats import _least_in_windows, _runs

LENGTH = 400
SEED = 256
#: Steps in which a too large group is cut, one round after another.
WIDTHS = (64, 16, 4, 1)
#: Strings of a segment at most (runs of one gram go on for long only in periodic text), bytes of a
#: group that are compared at once, and bytes that a task gathers before it compares.
SEGMENT, GROUP_BYTES, KERNEL_BYTES = 4096, 1 << 20, 1 << 20
#: Bytes of one long text that are handled at a time, and segments that are merged at once.
PIECE, GATHER = 1 << 20, 500_000

#: Spans of one gram among the segments that a task merges at once, above which they are spread.
CROWD = 32

REPEAT, ALONE, KNOWN = 0, 1, 2
#: How `_classify` takes a row: by its span, as a known repeat, as a member of a crowd.
MEET, SPARE, MEMBER = 0, 1, 2
_PLACE = ("doc", "copy")
_ROW = "anchor long, span long, doc long, copy long, start long, windows int, twice boolean, several boolean, role int, task long"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]
_SEEN = "anchor long, doc long, copy long, start long, windows int, kind int"


def pieces(column: pa.Array) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, first byte, bytes, offsets): long texts come in overlapping pieces, so that
    each string of LENGTH bytes lies whole in one of them."""
    for at, to, data, offsets in text_blocks(column):
        if to - at > 1 or len(data) <= PIECE + LENGTH:
            yield at, to, 0, data, offsets
            continue
        for p in range(0, len(data) - LENGTH + 1, PIECE):
            piece = data[p:p + PIECE + LENGTH - 1]
            yield at, to, p, piece, np.array([0, len(piece)])


def segments(data: np.ndarray, offsets: np.ndarray, width: int | None = None):
    """(group, span, text, start, windows, several) of the segments of some texts. Without a width,
    segments go by the value of their gram; with one, by the gram's place and its distance from the
    start of the string in steps of `width`. `several`: the gram occurs at more than one place."""
    values = _byte_values(False)[data]
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    at = np.flatnonzero(room >= LENGTH)
    if not len(at):
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int32, bool))
    where = np.arange(len(data) - SEED + 1)
    grams = runs_hash(values, where, where + SEED, RUN_BASE)
    gram = _least_in_windows(grams, LENGTH - SEED + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = np.diff(at) != 1
    if width is None:
        new[1:] |= grams[gram[1:]] != grams[gram[:-1]]
    else:
        step = (gram - at) // width
        new[1:] |= (np.diff(gram) != 0) | (np.diff(step) != 0)
    head = np.flatnonzero(new)
    since = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
    head = np.flatnonzero(since % SEGMENT == 0)
    count = np.diff(np.append(head, len(at)))
    start, seed = at[head], gram[head]
    group = grams[seed]
    if width is not None:
        near = step[head] * width
        shared = runs_hash(values, seed - near, seed - near - width + 1 + LENGTH, SPAN_BASE)
        group = mix(group ^ mix(shared + step[head].astype(np.uint64)))
    span = runs_hash(values, start, start + count - 1 + LENGTH, SPAN_BASE)
    text = np.searchsorted(offsets, start, "right") - 1
    return group, span, text, start - offsets[text], count.astype(np.int32), gram[head + count - 1] != seed


def _merged(held: list[tuple], crowd: int) -> pa.RecordBatch:
    """Segments of a task with equal ones brought together: the first of them stands for all, the
    others are known repeats. These and the members of crowds go anywhere, but for one member that
    tells the gram's task that there is something to compare."""
    group, span, doc, copy, start, count, twice, several = (np.concatenate(x) for x in zip(*held, strict=True))
    by = np.lexsort((span, group))
    group, span, doc, copy, start, count, twice, several = (x[by] for x in (group, span, doc, copy, start, count, twice, several))
    new = _runs(group, span)
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(group)))
    twice = np.repeat(np.logical_or.reduceat(twice, head) | (size > 1), size)
    first = np.flatnonzero(_runs(group))
    spans = np.repeat(np.add.reduceat(new.astype(np.int64), first), np.diff(np.append(first, len(group))))
    crowded = spans > crowd
    several = several | crowded
    role = np.where(new, np.where(crowded & ~_runs(group), MEMBER, MEET), SPARE).astype(np.int32)
    task = np.where(role == MEET, group, mix(span ^ doc.astype(np.uint64) * np.uint64(31) + start.astype(np.uint64)))
    return pa.record_batch([pa.array(x) for x in (
        group.view(np.int64), span.view(np.int64), doc, copy, start, count, twice, several, role, task.view(np.int64))], _NAMES)


def _gathered(found: Iterator[tuple], crowd: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for part in found:
        held.append(part)
        size += len(part[0])
        if size >= GATHER:
            yield _merged(held, crowd)
            held, size = [], 0
    if size:
        yield _merged(held, crowd)


def _text_segments(crowd: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in batches:
                doc, copy = (batch.column(i).to_numpy() for i in (0, 1))
                for first, _, byte, data, offsets in pieces(batch.column(2)):
                    group, span, text, start, count, several = segments(data, offsets)
                    yield (group, span, doc[first + text], copy[first + text], start + byte, count, np.zeros(len(group), bool), several)
        yield from _gathered(found(), crowd)
    return run


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    strings = column.to_pylist()
    return np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0, *map(len, strings)])


def _finer_segments(width: int, crowd: int):
    """Segments of the strings of too large groups, told apart in steps of `width`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in batches:
                doc, copy, start, twice = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "copy", "start", "twice"))
                group, span, text, at, count, several = segments(*_bytes(batch.column("string")), width)
                yield group, span, doc[text], copy[text], start[text] + at, count, twice[text], several
        yield from _gathered(found(), crowd if width > 1 else np.inf)
    return run


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted segments in; out come repeats, and the members of groups that need a comparison: one of
    each span, if the group has several spans. Kept between batches are the last span's rows, one for
    each batch of a task that has it, and the last group's first member."""
    def out(rows, kind):
        return pa.record_batch([pa.array(rows[i]) for i in (0, 2, 3, 4, 5)] + [pa.array(np.full(len(rows[0]), kind, np.int32))],
                               [c.split()[0] for c in _SEEN.split(", ")])

    def members(rows, single, last):
        nonlocal waiting, mixed_group
        if not len(rows[0]):
            return
        new = _runs(rows[0])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(new)))
        mixed = np.repeat((size > 1) | np.logical_or.reduceat(rows[7], head), size) | (rows[0] == mixed_group)
        if waiting is not None:
            if waiting[0][0][0] == rows[0][0]:
                mixed[:size[0]] = True
                yield out(*waiting)
            waiting = None
        tail = [c[-1:] for c in rows]
        mixed_group = tail[0][0] if mixed[-1] else None
        if not mixed[-1] and not last:
            waiting = tail, int(ALONE if single[-1] else KNOWN)
        for kind, of in ((ALONE, single), (KNOWN, ~single)):
            if (mixed & of).any():
                yield out([c[mixed & of] for c in rows], kind)

    def handled(rows, last):
        if not len(rows[0]):
            return
        head = np.flatnonzero(_runs(rows[0], rows[1]))
        size = np.diff(np.append(head, len(rows[0])))
        single = (size == 1) & ~rows[6][head]
        again = np.repeat(~single, size)
        if again.any():
            yield out([c[again] for c in rows], REPEAT)
        yield from members([c[head] for c in rows], single, last)

    held, waiting, mixed_group = None, None, None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:9]]
        role, twice = rows[8], rows[6]
        for kind, of in ((REPEAT, (role == SPARE) | (role == MEMBER) & twice), (KNOWN, (role == MEMBER) & twice),
                         (ALONE, (role == MEMBER) & ~twice)):
            if of.any():
                yield out([c[of] for c in rows], kind)
        rows = [c[role == MEET] for c in rows[:8]]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        cut = np.flatnonzero(_runs(rows[0], rows[1]))[-1]
        held = [c[cut:] for c in rows]
        yield from handled([c[:cut] for c in rows], False)
    if held is not None:
        yield from handled(held, True)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the listed members: (anchor, doc, copy, start, twice, string)."""
    for batch in batches:
        out = []
        for doc, copy, packed, listed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = unpack(packed)
            out += [(m["anchor"], doc, copy, m["start"], m["kind"] == KNOWN, text[m["start"]:m["start"] + m["windows"] - 1 + LENGTH])
                    for m in listed]
        yield pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate(
            (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))],
            ["anchor", "doc", "copy", "start", "twice", "string"])


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted members of whole groups in; repeats of those that occur once as a whole out."""
    def compared(rows):
        data, bounds = _bytes(rows.column("string"))
        repeated = repeated_starts(data, bounds, LENGTH)
        new = repeated.copy()
        new[1:] &= ~repeated[:-1]
        new[bounds[:-1][bounds[:-1] < len(new)]] = repeated[bounds[:-1][bounds[:-1] < len(new)]]
        head = np.flatnonzero(new)
        size = np.add.reduceat(repeated, head) if len(head) else head
        own = np.searchsorted(bounds, head, "right") - 1
        doc, copy, start, twice = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "copy", "start", "twice"))
        keep = ~twice[own]
        own, head, size = own[keep], head[keep], size[keep]
        return pa.record_batch([pa.array(x) for x in (
            doc[own], copy[own], start[own] + head - bounds[own], size.astype(np.int64) - 1 + LENGTH)], ["doc", "copy", "start", "bytes"])

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        if not rows.num_rows:
            continue
        rows = rows.to_batches()[0]
        held = rows
        if pa.compute.sum(pa.compute.binary_length(rows.column("string"))).as_py() < KERNEL_BYTES:
            continue
        cut = int(np.flatnonzero(_runs(rows.column("anchor").to_numpy()))[-1])
        if cut:
            yield compared(rows.slice(0, cut))
            held = rows.slice(cut)
    if held is not None:
        yield compared(held)


def packed_rows(documents: DataFrame) -> DataFrame:
    """(doc, copy, packed): compressed texts with a key of the id and the text. Rows that agree in both
    have the same repeats, each being one of the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        codec = zstandard.ZstdCompressor(level=1)
        for b in batches:
            packed = [None if t is None else codec.compress(t.encode()) for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(packed, pa.binary())], ["doc", "copy", "packed"])
    return keyed(documents).mapInArrow(run, "doc long, copy long, packed binary")


def keyed(documents: DataFrame) -> DataFrame:
    return documents.select(doc_key().alias("doc"), F.xxhash64("text").alias("copy"), "text")


def repeated_ranges(documents: DataFrame, group_bytes: int = GROUP_BYTES, crowd: int = CROWD) -> DataFrame:
    """(doc, copy, start, bytes): runs of bytes whose strings of LENGTH bytes all occur elsewhere too."""
    texts = keyed(documents)
    rows, found = texts.mapInArrow(_text_segments(crowd), _ROW), []
    for width in (*WIDTHS, None):
        seen = stored(rows.repartition("task").sortWithinPartitions("anchor", "span").mapInArrow(_classify, _SEEN), "segments")
        length = (F.col("windows") - 1 + LENGTH).cast("long")
        found.append(seen.where(F.col("kind") == REPEAT).select(*_PLACE, "start", length.alias("bytes")))
        members = seen.where(F.col("kind") != REPEAT)
        large = members.groupBy("anchor").agg(F.sum(length).alias("bytes")).where(F.col("bytes") > group_bytes).select(
            "anchor", F.lit(True).alias("large"))
        listed = members.groupBy(*_PLACE).agg(F.collect_list(F.struct("anchor", "start", "windows", "kind")).alias("listed"))
        strings = packed_rows(documents).join(listed, list(_PLACE)).select(*_PLACE, "packed", "listed").mapInArrow(
            _strings, "anchor long, doc long, copy long, start long, twice boolean, string binary")
        last = width is None or large.isEmpty()
        if not last:
            strings = stored(strings.join(large, "anchor", "left"), "strings")
        small = strings if last else strings.where("large is null").drop("large")
        found.append(small.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
            _expanded, "doc long, copy long, start long, bytes long"))
        if last:
            break
        rows = strings.where("large").drop("large").mapInArrow(_finer_segments(width, crowd), _ROW)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, packed, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = unpack(packed)
            edge = np.zeros(len(text) + 1, np.int64)
            for r in ranges or ():
                edge[r["start"]] += 1
                edge[r["start"] + r["bytes"]] -= 1
            gone = edge[:-1].cumsum() > 0
            new = gone.copy()
            new[1:] &= ~gone[:-1]
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if ranges else text
            out.append((doc, len(text), int(gone.sum()), int(new.sum()), kept))
        yield pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate(
            (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_byte_repeats(documents: DataFrame, group_bytes: int = GROUP_BYTES, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row; `kept` are the bytes that stay.

    Null and empty texts have no bytes; texts shorter than LENGTH lose nothing. Every row is a document
    by itself, whether its id is null, repeated or not; rows that are equal in id and text are repeats
    of each other. Other columns are ignored.
    """
    prepare(documents.sparkSession)
    ranges = repeated_ranges(documents, group_bytes, crowd).groupBy(*_PLACE).agg(
        F.collect_list(F.struct("start", "bytes")).alias("ranges"))
    return packed_rows(documents).join(ranges, list(_PLACE), "left").select("doc", "packed", "ranges").mapInArrow(
        _strip, "doc long, n_bytes long, n_removed long, n_spans long, kept binary").select(
        from_key("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
