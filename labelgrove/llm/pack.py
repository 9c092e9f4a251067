"""Packing of tokenized documents into sequences, with dominance reduction before best fit.

Only lengths matter for the packing, and there are at most CAPACITY of them, so the plan is made
from the counts of each length. Martello and Toth's dominance tests fix sets that some optimal
packing has: a piece nothing fits beside; a piece and its exact complement; a piece beside which
only one other fits, with the largest such; and a piece beside which at most two fit, with a pair
that covers every alternative. They repeat on the shrunken counts until none applies; the rest is
packed by best fit in falling length, a whole length at a time. The plan is a list of placements
(length, first rank, copies per sequence, first sequence, offset), applied to the pieces by their
rank within their length.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelgrove.llm.common import doc_key, from_key, held, prepare, stored

CAPACITY = 4096
END = 1
TOKENIZER = "word_bpe_49k.json"
#: Starts of special tokens, and separators that str.split takes for white space and the tokenizer does not.
_UNSPLIT = re.compile(rb"<\||[\x1c-\x1f]")
#: Chunks in each of the two generations that a worker remembers, about.
REMEMBERED = 200_000
#: What may close a chunk of letters: the tokenizer takes a run of these for one part, after the letters.
CLOSING = ".,;:!?$%&#*"
#: Pieces of one length that are ranked in one task, about.
RANKED = 200_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes.

    The tokenizer treats white-space separated chunks apart from each other, so chunks are encoded
    once and remembered; a chunk of letters and closing punctuation is two parts. When the memory is
    full it becomes the older generation, from which chunks that occur again are taken over, so
    frequent chunks are never encoded anew. Texts that hold the start of a special token or an odd
    separator go to the tokenizer as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        latin = [chr(c) for c in range(0xC0, 0x180) if chr(c).isalpha() and len(chr(c).lower()) == 1]
        spelled = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.latin = {ord(c): spelled(c)[0][0] for c in latin} | {c: chr(c) for c in range(97, 123)}
        self.parts = re.compile(f"([a-z{''.join(latin)}]+)([{re.escape(CLOSING)}]*)").fullmatch

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def remember(self, chunks: set[str]) -> None:
        """Afterwards `known` holds all of `chunks`."""
        new = chunks - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.older, self.known, new = self.known, {}, chunks
        again = new & self.older.keys()
        self.known.update((c, self.older[c]) for c in again)
        self.learn(new - again)

    def learn(self, chunks: set[str]) -> None:
        odd, tokenize = [], self.model.tokenize
        for chunk in chunks:
            found = self.parts(chunk)
            if found is None:
                odd.append(chunk)
                continue
            body, tail = found.groups()
            ids = [t.id for t in tokenize(body.lower().translate(self.latin))]
            self.known[chunk] = struct.pack(f"<{len(ids)}I", *ids)
            if tail:
                if tail not in self.known:
                    self.known[tail] = self.whole([tail])[0]
                self.known[chunk] += self.known[tail]
        self.known.update(zip(odd, self.whole(odd), strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        chunks = [None if _UNSPLIT.search(t) else t.lower().decode().split() for t in texts]
        every = set().union(*(c for c in chunks if c))
        if len(every) > REMEMBERED // 2 and len(texts) > 1:
            half = len(texts) // 2
            return self.encode(texts[:half]) + self.encode(texts[half:])
        self.remember(every)
        get = self.known.__getitem__
        for i, own in enumerate(chunks):
            out[i] = self.whole([texts[i].decode()])[0] if own is None else b"".join(map(get, own))
        return out


def _tokenize(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = held(f"encoder {path}", lambda: Encoder(path)), np.array([END], "<u4").tobytes()
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").cast(pa.binary())
            for at in range(0, len(texts), 500):
                rows = []
                docs = batch.column(0).slice(at, 500).to_pylist()
                for doc, ids in zip(docs, encoder.encode(texts.slice(at, 500).to_pylist()), strict=True):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start:start + 4 * capacity]
                        rows.append((doc, piece, start // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(
                    (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    ["doc", "piece", "start", "length", "ids_crc32"])
    return run


def pieces(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc, piece, start, length, ids_crc32): each document's ids and the end id, cut where they
    pass `capacity`."""
    return documents.select(doc_key().alias("doc"), "text").mapInArrow(
        _tokenize(path or tokenizer_path(), capacity),
        "doc long, piece int, start long, length long, ids_crc32 long")


class _Plan:
    """Counts of lengths still to be placed, and the placements made so far."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = {k: n for k, n in counts.items() if n}
        self.lengths = sorted(self.left)
        self.used = dict.fromkeys(self.left, 0)
        self.capacity = capacity
        self.sequences = 0
        self.placed: list[tuple[int, int, int, int, int, int]] = []

    def take(self, length: int, copies: int, times: int, sequence: int, offset: int) -> None:
        """`copies` pieces of a length into each of `times` sequences from `sequence` on."""
        n = copies * times
        self.placed.append((length, self.used[length], n, copies, sequence, offset))
        self.used[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.lengths.pop(bisect_left(self.lengths, length))

    def fix(self, parts: list[int]) -> None:
        """As many sequences of just these pieces as there are."""
        need = {k: parts.count(k) for k in parts}
        times, offset = min(self.left[k] // c for k, c in need.items()), 0
        for length, copies in need.items():
            self.take(length, copies, times, self.sequences, offset)
            offset += length * copies
        self.sequences += times

    def has(self, length: int, but: list[int]) -> bool:
        return self.left.get(length, 0) > but.count(length)

    def largest(self, room: int, but: list[int]) -> int | None:
        at = bisect_right(self.lengths, room)
        while at:
            at -= 1
            if self.has(self.lengths[at], but):
                return self.lengths[at]
        return None

    def smallest(self, but: list[int], n: int) -> list[int]:
        out: list[int] = []
        for length in self.lengths:
            out += [length] * min(n - len(out), self.left[length] - but.count(length))
            if len(out) == n:
                break
        return out

    def dominating(self, length: int) -> list[int] | None:
        """A set with this piece that some optimal packing uses, if a test proves one."""
        room = self.capacity - length
        others = self.smallest([length], 3)
        if not others or others[0] > room:
            return [length]
        if self.has(room, [length]):
            return [length, room]
        if len(others) < 2 or others[0] + others[1] > room:
            return [length, self.largest(room, [length])]
        if len(others) < 3 or sum(others) > room:
            first = self.largest(room - others[0], [length])
            single = self.largest(room, [length])
            second = self.largest(room - first, [length, first])
            half = self.largest(room // 2, [length])
            if first == single and second is not None and second >= half:
                return [length, first, second]
        return None

    def reduce(self) -> None:
        changed = True
        while changed:
            changed = False
            for length in reversed(list(self.lengths)):
                while self.left.get(length) and (found := self.dominating(length)):
                    self.fix(found)
                    changed = True

    def best_fit(self) -> None:
        """Falling lengths, each into the fullest sequences it fits."""
        rooms: list[int] = []
        groups: dict[int, list[tuple[int, int]]] = {}

        def open_rooms(room: int, sequence: int, times: int) -> None:
            if room and times:
                if room not in groups:
                    insort(rooms, room)
                groups.setdefault(room, []).append((sequence, times))

        for length in reversed(list(self.lengths)):
            while n := self.left.get(length, 0):
                at = bisect_left(rooms, length)
                if at == len(rooms):
                    copies = min(n, self.capacity // length)
                    room, sequence, times = self.capacity, self.sequences, n // copies
                    self.sequences += times
                else:
                    room = rooms[at]
                    sequence, times = groups[room].pop()
                    if not groups[room]:
                        del groups[room]
                        rooms.pop(at)
                    copies = min(n, room // length)
                    full = min(times, n // copies)
                    open_rooms(room, sequence + full, times - full)
                    times = full
                self.take(length, copies, times, sequence, self.capacity - room)
                open_rooms(room - copies * length, sequence, times)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Placements (length, first rank, pieces, pieces per sequence, first sequence, offset)."""
    made = _Plan(counts, capacity)
    made.reduce()
    made.best_fit()
    return made.placed


def _place(placements):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = np.array(sorted(placements.value), np.int64)
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.empty(len(length), np.int64)
            for own in np.unique(length):
                lo, hi = np.searchsorted(made[:, 0], [own, own + 1])
                mine = length == own
                at[mine] = lo + np.searchsorted(made[lo:hi, 1], rank[mine], "right") - 1
            first, copies, sequence, offset = (made[at, i] for i in (1, 3, 4, 5))
            turn = rank - first
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence + turn // copies),
                                   pa.array(offset + turn % copies * length)],
                                  ["doc", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def pack(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    A null or empty text is the end id alone. Repeated rows are packed each for itself; a null id
    stays null. Other columns are ignored.
    """
    spark = documents.sparkSession
    prepare(spark)
    cut = stored(pieces(documents, path, capacity), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = max(counts.values(), default=0)
    parts = most // RANKED + 1
    sent = spark.sparkContext.broadcast(plan(counts, capacity))

    # rank within a length: pieces before the part, then the place in the part
    row = F.struct("doc", "piece", "ids_crc32")
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc", "piece", "ids_crc32"), F.lit(parts)))
    sizes = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy(row))
    ranked = cut.withColumn("inside", inside).join(before.select("length", "part", "before"), ["length", "part"])
    ranked = ranked.select("doc", "piece", "start", "length", "ids_crc32",
                           (F.coalesce("before", F.lit(0)) + F.col("inside") - 1).cast("long").alias("rank"))
    return ranked.mapInArrow(_place(sent), (
        "doc long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")).withColumn(
        "doc_id", from_key("doc")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
