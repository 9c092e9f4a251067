"""Benchmark passages in documents, by Wu-Manber search over words.

Patterns are the windows of benchmark items. A table over blocks of two words says how far the
window may move on (most blocks occur in no pattern, so it moves by nine words at once); where it
may not move, the block selects a bucket of patterns, which are compared word by word. Patterns
are searched in blocks of bounded size, each broadcast in turn.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelgrove.llm.common import doc_key, from_key, prepare, stored

WINDOW = 10
#: Words of the block that indexes the shift table.
BLOCK = 2
#: Patterns searched at once.
PATTERNS = 200_000

#: Lower-cases A-Z and turns every byte that belongs to no word into a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = set()
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            words = words_of(text)
            for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
                out.add((item, b" ".join(words[i:i + WINDOW]).decode()))
        yield pa.record_batch([pa.array([x[0] for x in out], pa.string()),
                               pa.array([x[1] for x in out], pa.string())], ["item", "pattern"])


def item_patterns(benchmark: DataFrame) -> DataFrame:
    """(pattern, items): every distinct window, with the items that have it."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return items.mapInArrow(_patterns, "item string, pattern string").groupBy("pattern").agg(
        F.collect_set("item").alias("items"))


class WuManber:
    """Finds patterns of one length in a list of words."""

    def __init__(self, patterns: list[tuple[list[bytes], list[str]]]):
        self.size = len(patterns[0][0])
        self.block = min(BLOCK, self.size)
        self.most = self.size - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, list] = defaultdict(list)
        for words, items in patterns:
            for end in range(self.block, self.size + 1):
                key = b" ".join(words[end - self.block:end])
                self.shift[key] = min(self.shift.get(key, self.most), self.size - end)
            self.buckets[b" ".join(words[-self.block:])].append((words, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        at, n, size, most, shift, block = self.size, len(words), self.size, self.most, self.shift, self.block
        while at <= n:
            key = words[at - 1] if block == 1 else words[at - 2] + b" " + words[at - 1]
            step = shift.get(key, most)
            if step:
                at += step
                continue
            for pattern, items in self.buckets[key]:
                if words[at - size:at] == pattern:
                    yield at - size, items
            at += 1


def _searches(patterns) -> list[WuManber]:
    by_size = defaultdict(list)
    for pattern, items in patterns.value:
        words = pattern.encode().split(b" ")
        by_size[len(words)].append((words, items))
    return [WuManber(p) for p in by_size.values()]


def _scan(patterns):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = _searches(patterns)
        for batch in batches:
            n, hits, found = [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                words, hit, items = words_of(text), set(), set()
                for search in searches:
                    for start, of in search.search(words):
                        hit.update(range(start, start + search.size))
                        items.update(of)
                n.append(len(words))
                hits.append(list(hit))
                found.append(list(items))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()),
                                   pa.array(hits, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))],
                                  ["doc", "mark", "n_words", "hits", "items"])
    return run


def _clean(patterns):
    """The rows, with all columns, whose `text` holds no pattern."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = _searches(patterns)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
            clean = []
            for text in texts:
                words = words_of(text.as_py())
                clean.append(not any(True for search in searches for _ in search.search(words)))
            yield batch.filter(pa.array(clean, pa.bool_()))
    return run


def pattern_blocks(spark: SparkSession, benchmark: DataFrame, patterns_at_once: int) -> Iterator[Broadcast]:
    """The benchmark's patterns with their items, in blocks of about so many."""
    patterns = stored(item_patterns(benchmark), "patterns")
    blocks = max(1, math.ceil(patterns.count() / patterns_at_once))
    for b in range(blocks):
        rows = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == b).collect()
        yield spark.sparkContext.broadcast([(r.pattern, r["items"]) for r in rows])


def benchmark_hits(documents: DataFrame, benchmark: DataFrame, patterns_at_once: int = PATTERNS) -> DataFrame:
    """(doc_id, n_words, hits, items) for every document: positions of words inside any occurrence
    of a benchmark window, and the items (as strings) whose windows occur.

    Null or empty texts have no words, and such items no windows; an item of fewer than ten words
    is one window; a null item_id counts as the empty string. Rows stay as they are, also repeated
    ones and those with null ids. Other columns are ignored.
    """
    spark = documents.sparkSession
    prepare(spark)
    texts = documents.select(doc_key().alias("doc"), F.xxhash64("text").alias("mark"), "text")
    parts = [texts.mapInArrow(_scan(sent), "doc long, mark long, n_words long, hits array<int>, items array<string>")
             for sent in pattern_blocks(spark, benchmark, patterns_at_once)]
    if len(parts) == 1:
        return parts[0].select(from_key("doc").alias("doc_id"), "n_words", "hits", "items")
    every = stored(parts[0], "hits")
    for part in parts[1:]:
        every = every.unionByName(stored(part, "hits"))
    joined = every.groupBy("doc", "mark").agg(
        F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.sequence(F.lit(1), (F.count(F.lit(1)) / len(parts)).cast("int")).alias("copies"))
    return joined.select(from_key("doc").alias("doc_id"), "n_words", "hits", "items", F.explode("copies")).drop("col")


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every document."""
    hits = benchmark_hits(documents, benchmark)
    return hits.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"),
                       F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
                       (F.size("hits") > 0).alias("contaminated"))


def without_contaminated(documents: DataFrame, benchmark: DataFrame, patterns_at_once: int = PATTERNS) -> DataFrame:
    """The documents in which no benchmark window occurs, with their columns; each row is judged
    by its own text, whatever its id. Texts are read in place and never shuffled: a block of
    patterns passes on the rows that hold none of it."""
    prepare(documents.sparkSession)
    left = documents
    for i, sent in enumerate(pattern_blocks(documents.sparkSession, benchmark, patterns_at_once)):
        left = (stored(left, "clean") if i else left).mapInArrow(_clean(sent), documents.schema)
    return left
