"""Licence families of paragraphs: logistic regression on word n-grams, then template comparison.

A paragraph (line) is described by its hashed words and word pairs. A multinomial logistic
regression gives each licence family and `unknown` a probability, made honest by a temperature
fitted on labelled paragraphs that the regression did not see. A prediction is confirmed if most of
the paragraph's word pairs, or most of the template's, are common to both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelgrove.llm.common import doc_key, from_key, prepare, stored
from labelgrove.llm.kernels import Words, text_blocks

#: Short public notices of each family.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Phrases that label a paragraph without judgement.
PHRASES = {
    "apache-2.0": r"(?i)apache license,? version 2",
    "bsd-3-clause": r"(?i)redistribution and use in source and binary forms",
    "cc-by-nc-4.0": r"(?i)cc by-nc 4\.0",
    "gpl-3.0": r"(?i)gnu general public license,? version 3",
    "mit": r"(?i)\bmit license",
    "mpl-2.0": r"(?i)mozilla public license,? v",
}
UNKNOWN = "unknown"
CLASSES = (*TEMPLATES, UNKNOWN)
#: Hashed features, and labelled paragraphs of each class, at most.
FEATURES, SAMPLE = 1 << 14, 3_000
CONFIRMED = 0.6


def _word_bytes() -> np.ndarray:
    """Letters, digits and all bytes beyond ASCII belong to words."""
    return np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def _paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each paragraph (and the end of the last), and the row of each."""
    starts = np.union1d(np.flatnonzero(data == 10) + 1, offsets[:-1])
    starts = starts[starts < len(data)]
    return np.append(starts, len(data)), np.searchsorted(offsets, starts, "right") - 1


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words and word pairs, and the paragraph of each."""
    own, at = words.doc_of_word(), words.whole(2)
    pairs = words.grams(2)[at]
    numbers = np.concatenate([words.hash, pairs]) % np.uint64(FEATURES)
    return numbers.astype(np.int64), np.concatenate([own, own[at]])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, data, offsets in text_blocks(batch.column(1)):
            numbers, own = features(Words(data, offsets, _word_bytes(), True))
            by = np.argsort(own, kind="stable")
            bounds = np.searchsorted(own[by], np.arange(to - at + 1)).astype(np.int32)
            yield pa.record_batch([batch.column(0).slice(at, to - at), batch.column(2).slice(at, to - at),
                                   pa.ListArray.from_arrays(pa.array(bounds), pa.array(numbers[by]))],
                                  ["label", "fit", "numbers"])


def _vector(numbers: list[int]):
    found, n = np.unique(numbers, return_counts=True)
    return Vectors.sparse(FEATURES, found, n / max(1, len(numbers)))


def labelled_paragraphs(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(label, paragraph, fit): paragraphs that a phrase labels, others without `licen` or
    `copyright` as unknown, at most `sample` different ones of each class by hash, and the templates
    themselves. All classes come from one pass.
    `fit` is false for the fifth used for calibration."""
    lines = documents.where("text is not null").select(F.explode(F.split("text", "\n")).alias("paragraph")).where(
        "trim(paragraph) != ''")
    named = F.when(F.lit(False), None)
    for i, name in enumerate(TEMPLATES):
        named = named.when(F.col("paragraph").rlike(PHRASES[name]), F.lit(i))
    named = named.when(~F.col("paragraph").rlike("(?i)licen[sc]e|copyright"), F.lit(len(TEMPLATES)))
    h = F.xxhash64("paragraph")
    named = lines.select("paragraph", named.alias("label")).where(
        (F.col("label") < len(TEMPLATES)) | (F.col("label") == len(TEMPLATES)) & (F.pmod(h, F.lit(997)) < 100)).distinct()
    # a task keeps at most `sample` paragraphs of a class before they are shuffled
    nth = F.row_number().over(Window.partitionBy("label").orderBy(h, "paragraph"))
    some = named.withColumn("nth", nth).where(F.col("nth") <= sample).select(
        "label", "paragraph", (F.pmod(h, F.lit(5)) != 0).alias("fit"))
    rows = documents.sparkSession.createDataFrame(list(enumerate(TEMPLATES.values())), "label int, paragraph string")
    return rows.withColumn("fit", F.lit(True)).unionByName(some)


class Classifier:
    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.weights, self.bias, self.temperature = weights, bias, temperature

    def logits(self, numbers: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
        size = np.maximum(np.bincount(own, minlength=n), 1)
        sums = np.stack([np.bincount(own, self.weights[numbers, k], n) for k in range(len(CLASSES))], 1)
        return sums / size[:, None] + self.bias


def probabilities(logits: np.ndarray, temperature: float) -> np.ndarray:
    z = logits / temperature
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def train(documents: DataFrame) -> Classifier:
    """Regression on labelled paragraphs, and its temperature: the value with the least loss on
    the paragraphs left out (1 if there are none)."""
    rows = stored(labelled_paragraphs(documents).select("label", "paragraph", "fit").mapInArrow(
        _describe, "label int, fit boolean, numbers array<long>"), "paragraphs")
    vector = F.udf(_vector, VectorUDT())
    fitted = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=60, featuresCol="x").fit(
        rows.where("fit").unionByName(  # every class occurs, so that the matrix has a row for each
            rows.sparkSession.createDataFrame([(i, True, []) for i in range(len(CLASSES))], rows.schema)).select(
            F.col("label").cast("double").alias("label"), vector("numbers").alias("x")))
    model = Classifier(fitted.coefficientMatrix.toArray().T.copy(), fitted.interceptVector.toArray(), 1.0)
    left = rows.where("not fit").collect()
    if left:
        label = np.array([r.label for r in left])
        own = np.repeat(np.arange(len(left)), [len(r.numbers) for r in left])
        logits = model.logits(np.array([x for r in left for x in r.numbers], np.int64), own, len(left))
        grid = np.geomspace(0.25, 8, 41)
        loss = [-np.log(np.maximum(probabilities(logits, t)[np.arange(len(left)), label], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def _pairs_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return np.unique(Words(data, np.array([0, len(data)]), _word_bytes(), True).grams(2))


def _scan(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, templates = model.value, [_pairs_of(t) for t in TEMPLATES.values()]
        for batch in batches:
            docs = batch.column(0)
            for at, _, data, offsets in text_blocks(batch.column(1)):
                starts, row = _paragraphs(data, offsets)
                words = Words(data, starts, _word_bytes(), True)
                numbers, own = features(words)
                chances = probabilities(m.logits(numbers, own, len(row)), m.temperature)
                best = chances.argmax(1)
                out = []
                for p in np.flatnonzero((best < len(TEMPLATES)) & (words.n > 0)):
                    text = data[starts[p]:starts[p + 1]].tobytes().decode("utf-8", "replace")
                    mine, theirs = _pairs_of(text), templates[best[p]]
                    both = len(np.intersect1d(mine, theirs))
                    alike = both / max(1, min(len(mine), len(theirs)))
                    number = int(p - np.searchsorted(row, row[p]))
                    out.append((docs[at + int(row[p])].as_py(), number, CLASSES[best[p]], float(chances[p, best[p]]), alike))
                yield pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate(
                    (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64()))],
                    ["doc", "paragraph", "family", "probability", "similarity"])
    return run


def licence_findings(documents: DataFrame) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, confirmed): one row for each paragraph
    that is predicted to belong to a licence family; paragraphs are lines, numbered from 0 (an
    empty line is one too).

    Null and empty texts have none; null ids stay null; repeated rows are reported each. Other
    columns are ignored.
    """
    prepare(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(train(documents))
    found = documents.select(doc_key().alias("doc"), "text").mapInArrow(
        _scan(sent), "doc long, paragraph int, family string, probability double, similarity double")
    return found.select(from_key("doc").alias("doc_id"), "paragraph", "family", "probability", "similarity",
                        (F.col("similarity") >= CONFIRMED).alias("confirmed"))
