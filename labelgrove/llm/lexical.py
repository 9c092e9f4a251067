"""Ranked lexical search by dense products of item and document tiles.

Items are taken in blocks. A block's terms are numbered compactly; a tile of them is one dense matrix of
item weights, which is multiplied with the dense matrix of the terms' impacts in a few hundred
documents. Weights and impacts are integers held in float64: a tile has so few terms that no partial
sum can reach 2**53, and the sums of tiles are added as 64-bit integers, so scores are exact.

Each task keeps the best documents of every item while it goes through its rows; only those lists are
shuffled. Nothing is kept of documents that hold none of a block's terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelgrove.llm.common import doc_key, from_key, prepare
from labelgrove.llm.kernels import Words, word_blocks

#: Bounds of a block of items: rows, and distinct terms (one item with more is a block by itself).
ITEMS, BLOCK_TERMS = 512, 200_000
#: Terms of a tile, and documents multiplied at once.
TILE_TERMS, TILE_DOCS = 4096, 512
IMPACT = 1_000_000
#: Partial results of a task that are merged with the others of their group before the last merge.
GROUPS = 64


def term_bytes() -> np.ndarray:
    """True for bytes of a term: digits, letters and everything beyond ASCII."""
    out = np.zeros(256, bool)
    out[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return out


@dataclass
class Block:
    """Some items and their distinct terms, sorted by hash; pairs (item, term) say who has which."""
    ids: list = field(default_factory=list)
    terms: dict = field(default_factory=dict)
    item: list = field(default_factory=list)
    term: list = field(default_factory=list)

    def add(self, item_id, terms: list[bytes]) -> None:
        for t in terms:
            self.item.append(len(self.ids))
            self.term.append(self.terms.setdefault(t, len(self.terms)))
        self.ids.append(item_id)


class Vocabulary:
    """Finds a block's terms among the words of documents; equal hashes are compared byte by byte."""

    def __init__(self, terms: list[bytes]):
        column = pa.array(terms, pa.binary()).cast(pa.string())
        found = [w.hash for _, _, w in word_blocks(column, True, np.ones(256, bool))]
        hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.size = np.array([len(t) for t in terms], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(terms), np.uint8)

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, term) for every word of a block of documents that is a term."""
        if not len(self.hashes) or not len(words.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.hashes, words.hash), len(self.hashes) - 1)
        word = np.flatnonzero(self.hashes[place] == words.hash)
        term = self.order[place[word]]
        same = words.end[word] - words.start[word] == self.size[term]
        word, term = word[same], term[same]
        if len(word):
            size = self.size[term]
            first = np.cumsum(size) - size
            step = np.arange(size.sum()) - np.repeat(first, size)
            text = words.data[np.repeat(words.start[word], size) + step]
            text = np.where((text >= 65) & (text <= 90), text + 32, text)
            equal = np.logical_and.reduceat(text == self.data[np.repeat(self.start[term], size) + step], first)
            word, term = word[equal], term[equal]
        return word, term

    def counts(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, occurrences) of a block of documents."""
        word, term = self.find(words)
        doc = words.doc_of_word()[word]
        pair, n = np.unique(doc * len(self.size) + term, return_counts=True)
        return pair // max(1, len(self.size)), pair % max(1, len(self.size)), n


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = term_bytes()
    for batch in batches:
        out = []
        for _, _, words in word_blocks(batch.column(1), True, kinds):
            folded = np.where((words.data >= 65) & (words.data <= 90), words.data + 32, words.data).tobytes()
            for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
                out.append(sorted({folded[words.start[i]:words.end[i]] for i in range(a, b)}))
        yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(pa.binary()))], ["item", "terms"])


def blocks_of(items: DataFrame) -> Iterator[Block]:
    """The items in blocks of bounded size; items without terms are left out."""
    split = items.select(F.col("item_id").alias("item"), "text").mapInArrow(
        _item_terms, f"item {items.schema['item_id'].dataType.simpleString()}, terms array<binary>")
    block = Block()
    for row in split.where(F.size("terms") > 0).toLocalIterator():
        if block.ids and (len(block.ids) == ITEMS or len(block.terms) + len(row.terms) > BLOCK_TERMS):
            yield block
            block = Block()
        block.add(row.item, [bytes(t) for t in row.terms])
    if block.ids:
        yield block


def _statistics(terms: list[bytes]):
    """(term, n): documents that hold a term; -1 counts documents with terms, -2 all their terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, kinds = Vocabulary(terms), term_bytes()
        total = np.zeros(len(terms) + 2, np.int64)
        for batch in batches:
            for _, _, words in word_blocks(batch.column(0), True, kinds):
                _, term, _ = vocabulary.counts(words)
                np.add.at(total, term, 1)
                total[-1] += np.count_nonzero(words.n)
                total[-2] += len(words.start)
        number = np.arange(len(total))
        number[-2:] = -2, -1
        yield pa.record_batch([pa.array(number), pa.array(total)], ["term", "n"])
    return run


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


class Best:
    """The k best documents of each item so far; equal scores by ascending document."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item, self.doc, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.ones(items, np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        """`scores` of items x documents; only scores above 0 that can still count are looked at."""
        item, at = np.nonzero(scores >= self.least[:, None])
        if not len(item):
            return
        item, doc, score = (np.concatenate(x) for x in (
            (self.item, item), (self.doc, docs[at]), (self.score, scores[item, at])))
        by = np.lexsort((doc, -score, item))
        item, doc, score = item[by], doc[by], score[by]
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        kept = nth < self.k
        self.item, self.doc, self.score = item[kept], doc[kept], score[kept]
        last = nth[kept] == self.k - 1
        self.least[self.item[last]] = self.score[last]


def _search(block: Block, weight: np.ndarray, n_docs: int, n_terms: int, k: int):
    terms, items = list(block.terms), len(block.ids)
    item, term = np.array(block.item), np.array(block.term)
    tile = int(min(TILE_TERMS, max(1, (2 ** 53 - 1) // (IMPACT * max(1, int(weight.max(initial=1)))))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, kinds, best = Vocabulary(terms), term_bytes(), Best(items, k)
        tiles = []
        for at in range(0, len(terms), tile):
            here = (term >= at) & (term < at + tile)
            dense = np.zeros((items, min(tile, len(terms) - at)))
            dense[item[here], term[here] - at] = weight[term[here]]
            tiles.append((at, dense))
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, _, words in word_blocks(batch.column(1), True, kinds):
                doc, t, tf = vocabulary.counts(words)
                m = 10 + (90 * words.n * n_docs) // max(1, n_terms)
                impact = (1000 * IMPACT * tf) // (1000 * tf + 8 * m[doc])
                held, place = np.unique(doc, return_inverse=True)
                for a in range(0, len(held), TILE_DOCS):
                    some = slice(*np.searchsorted(place, (a, a + TILE_DOCS)))
                    n = min(TILE_DOCS, len(held) - a)
                    scores = np.zeros((items, n), np.int64)
                    for at, dense in tiles:
                        of = (t[some] >= at) & (t[some] < at + dense.shape[1])
                        right = np.zeros((dense.shape[1], n))
                        right[t[some][of] - at, place[some][of] - a] = impact[some][of]
                        scores += (dense @ right).astype(np.int64)
                    best.add(scores, ids[first + held[a:a + n]])
        yield pa.record_batch([pa.array(best.item), pa.array(best.doc), pa.array(best.score)], ["item", "doc", "score"])
    return run


def search(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item, all if fewer score above 0.

    Null and empty texts have no terms: such a document is never found, such an item finds nothing.
    Every row counts as a document or an item by itself, also if its id is null or repeated; a null
    doc_id comes before all others in ties. Other columns are ignored.
    """
    prepare(documents.sparkSession)
    rows = documents.select(doc_key().alias("doc"), "text")
    out = None
    for number, block in enumerate(blocks_of(items)):
        sums = dict(rows.select("text").mapInArrow(_statistics(list(block.terms)), "term long, n long").groupBy("term").agg(
            F.sum("n")).collect())
        df = np.array([sums.get(i, 0) for i in range(len(block.terms))])
        n_docs, n_terms = sums.get(-1, 0), sums.get(-2, 0)
        found = rows.mapInArrow(_search(block, weights(n_docs, df), n_docs, n_terms, k), "item long, doc long, score long")
        found = found.withColumn("block", F.lit(number))
        ids = documents.sparkSession.createDataFrame(
            [(number, i, x) for i, x in enumerate(block.ids)],
            f"block int, item long, item_id {items.schema['item_id'].dataType.simpleString()}")
        out = _merged(found, k).join(ids, ["block", "item"]) if out is None else out.unionByName(
            _merged(found, k).join(ids, ["block", "item"]))
    if out is None:
        out = documents.sparkSession.createDataFrame(
            [], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc long, score long")
    return out.select("item_id", "rank", from_key("doc").alias("doc_id"), "score")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item from the lists of all tasks, first within groups of tasks."""
    order = [F.col("score").desc(), F.col("doc")]
    some = found.withColumn("part", F.spark_partition_id() % GROUPS)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    last = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    return last.where(F.col("rank") <= k).drop("part")
