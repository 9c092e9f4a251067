"""Secret findings, with false positives removed by a random forest.

Candidates are long unbroken runs and values assigned to a credential's name. The forest sees a
candidate's length, kinds of characters and transitions between them, how much of it is made of
the letter triples of dictionary words, the path (source) of its document and its neighbours. It
is trained on labelled findings. All of it is DataFrame expressions and Spark ML.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelgrove.llm.common import crc_of_id, doc_key, from_key, prepare, stored

RUN = r"(?<![A-Za-z0-9+/_-])(?:(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}|[A-Za-z0-9+/_-]{20,})={0,2}"
ASSIGNED = (r"(?i)(?:pass(?:word|wd)?|secret|token|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
            r"([^\s\"',;<>]{6,})")
NAMED = r"(?i)(?:pass(?:word|wd)?|secret|token|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?$"
VENDOR = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[baprs]-[A-Za-z0-9-]{10,})$"
PLACEHOLDER = r"(?i)example|changeme|placeholder|x{4,}|1234567|your[_-]"
#: Characters of context on each side.
CONTEXT = 48
#: Dictionary: so many of the most frequent words of 3 to 6 lower-case letters.
DICTIONARY = 5_000
#: Labelled findings of each class that the forest is trained on, at most.
SAMPLE = 10_000
TREES, DEPTH, SEED = 20, 6, 7
MASK = "<SECRET>"

FEATURES = ("length", "digits", "upper", "lower", "symbols", "variety", "transitions", "covered", "assigned",
            "credential", "quoted", "path", "test_path")


def dictionary(documents: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The most frequent short words over all documents."""
    words = documents.select(F.explode(F.regexp_extract_all(
        "text", F.lit(r"(?<!\S)([a-z]{3,6})(?!\S)"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return sorted(r.word for r in words.orderBy(F.desc("n"), "word").limit(size).collect())


def _triples(words: list[str]) -> list[int]:
    """Whether each of the 26**3 letter triples occurs in a word."""
    out = [0] * 26 ** 3
    for word in words:
        for i in range(len(word) - 2):
            a, b, c = (ord(x) - 97 for x in word[i:i + 3])
            out[(a * 26 + b) * 26 + c] = 1
    return out


def _places(pattern: str, group: int) -> Column:
    """Every match of a pattern in `text` as (start, value), start from 0: the text between matches
    and the matches themselves add up to the places. A group lies at the end of its match."""
    between, whole = F.split("text", pattern), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    steps = F.zip_with(F.slice(between, 1, F.size(whole)), whole, lambda gap, m: F.struct(
        F.length(gap).alias("gap"), F.length(m).alias("size")))
    ends = F.aggregate(steps, F.array().cast("array<int>"), lambda done, x: F.array_append(
        done, F.coalesce(F.get(done, F.size(done) - 1), F.lit(0)) + x["gap"] + x["size"]))
    return F.zip_with(ends, value, lambda end, v: F.struct((end - F.length(v)).alias("start"), v.alias("value")))


def _path() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def _row_md5() -> Column:
    """Rows of one id with equal path and text are masked alike."""
    return F.md5(F.concat(F.length(_path()).cast("string"), F.lit(":"), _path(), F.col("text")))


def candidates(documents: DataFrame) -> DataFrame:
    """(doc, value, path, row_md5, before, after, start): every occurrence of a candidate value in
    each document, with its place (from 0) and context. Rows of one `row_md5` have the same
    candidates."""
    runs = _places(RUN, 0)
    found = F.concat(runs, F.array_except(_places(ASSIGNED, 1), runs))
    rows = documents.where("text is not null").select(
        doc_key().alias("doc"), _path().alias("path"), _row_md5().alias("row_md5"), "text", found.alias("found"))
    rows = rows.select("doc", "path", "row_md5", "text", F.inline("found"))
    return rows.select(
        "doc", "value", "path", "row_md5", "start",
        F.substring("text", F.greatest(F.col("start") - CONTEXT + 1, F.lit(1)),
                    F.least(F.col("start"), F.lit(CONTEXT))).alias("before"),
        F.substring("text", F.col("start") + F.length("value") + 1, F.lit(CONTEXT)).alias("after"))


def described(found: DataFrame, words: list[str]) -> DataFrame:
    """`found` with the forest's features."""
    v, size = F.col("value"), F.length("value")
    share = lambda pattern: F.length(F.regexp_replace(v, pattern, "")) / size
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        v, "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d"), "[^lud]", "s")
    table = F.lit(_triples(words))
    low = F.regexp_replace(F.lower(v), "[^a-z]", " ")
    code = lambda i: F.ascii(F.substring(low, i, F.lit(1))) - 97

    def known(i: Column) -> Column:
        a, b, c = code(i), code(i + 1), code(i + 2)
        inside = (a >= 0) & (b >= 0) & (c >= 0)
        return F.when(inside, F.element_at(table, (a * 26 + b) * 26 + c + 1)).otherwise(0)
    places = F.when(size > 2, F.sequence(F.lit(1), size - 2)).otherwise(F.array().cast("array<int>"))
    covered = F.aggregate(places, F.lit(0), lambda s, i: s + known(i)) / F.greatest(size - 2, F.lit(1))
    return found.withColumns({
        "length": size.cast("double"), "digits": share("[^0-9]"), "upper": share("[^A-Z]"), "lower": share("[^a-z]"),
        "symbols": share("[A-Za-z0-9]"), "variety": F.size(F.array_distinct(F.split(v, ""))) / size,
        "transitions": (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / size, "covered": covered,
        "assigned": F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double"),
        "credential": F.col("before").rlike(NAMED).cast("double"),
        "quoted": F.col("after").rlike(r"^[\"']").cast("double"),
        "path": F.pmod(F.xxhash64("path"), F.lit(64)).cast("double"),
        "test_path": F.col("path").rlike("(?i)test|example|sample|doc").cast("double")})


def weak_label() -> Column:
    """Label of a finding that needs no judgement: 1 for vendors' formats and credentials with a
    digit, 0 for placeholders and runs without any digit; null for the rest."""
    v = F.col("value")
    return (F.when(v.rlike(PLACEHOLDER) | ~v.rlike("[0-9]"), 0.0)
            .when(v.rlike(VENDOR) | F.col("before").rlike(NAMED), 1.0))


def train(labelled: DataFrame, sample: int = SAMPLE) -> RandomForestClassificationModel | None:
    """Forest from described findings with a `label` of 0 or 1; at most `sample` of each class, by
    a hash of the value. None if a class is missing."""
    chosen = [labelled.where(F.col("label") == x).orderBy(F.xxhash64("value", "doc"), "doc", "value").limit(sample)
              for x in (0.0, 1.0)]
    rows = stored(chosen[0].unionByName(chosen[1]).select("label", *FEATURES), "labelled")
    if rows.agg(F.count_distinct("label")).first()[0] < 2:
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))


def scan(documents: DataFrame) -> DataFrame:
    """(doc, row_md5, value, start, score, secret): every occurrence of a candidate with the
    forest's probability.

    Labelled findings are those of documents whose crc32(doc_id as text) mod 3 is not 1 and that
    `weak_label` can tell. Without both classes nothing is removed: every candidate scores 1.
    """
    prepare(documents.sparkSession)
    rows = documents.withColumn("__train", crc_of_id() % 3 != 1)
    words = dictionary(rows)
    known = rows.where("__train").select(doc_key().alias("doc")).distinct()
    found = stored(described(candidates(rows), words), "findings")
    model = train(found.join(known, "doc", "left_semi").withColumn("label", weak_label()).where("label is not null"))
    if model is None:
        scored = found.withColumn("score", F.lit(1.0))
    else:
        scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found))
        scored = scored.withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc", "row_md5", "value", "start", "score", (F.col("score") >= 0.5).alias("secret"))


def secret_findings(documents: DataFrame) -> DataFrame:
    """(doc_id, value_sha256, start, length, score, secret): one row per document and occurrence of
    a candidate value, with the score of that occurrence; a value is secret in all of a document if
    any of its occurrences is.

    Null and empty texts hold no candidate; a null source is the empty path; null ids count as one
    id. An occurrence at the same place in repeated rows of a document is one finding. Other
    columns are ignored.
    """
    found = scan(documents).groupBy("doc", "value", "start").agg(F.max("score").alias("score"), F.max("secret").alias("secret"))
    found = found.groupBy("doc", "value").agg(
        F.max("secret").alias("secret"), F.collect_list(F.struct("start", "score")).alias("places")).select(
        "doc", "value", "secret", F.inline("places"))
    return found.select(
        from_key("doc").alias("doc_id"), F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"),
        F.col("start").cast("long").alias("start"), F.length("value").cast("long").alias("length"), "score", "secret")


def secret_spans(documents: DataFrame) -> DataFrame:
    """(doc, row_md5, spans): for each different row with a secret, where its secrets lie as
    (start, stop, done) in order; `done` is where earlier spans end. All candidate places of a
    value that is secret at one of them count."""
    row = ["doc", "row_md5"]
    found = scan(documents).groupBy(*row, "value", "start").agg(F.max("secret").alias("secret"))
    found = found.groupBy(*row, "value").agg(F.max("secret").alias("secret"), F.collect_list("start").alias("starts")).where(
        "secret").select(*row, F.length("value").alias("size"), F.explode("starts").alias("start"))
    spans = found.select(*row, "start", (F.col("start") + F.col("size")).alias("stop"))
    earlier = Window.partitionBy(*row).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("done", F.coalesce(F.max("stop").over(earlier), F.lit(0)))
    return spans.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("start", "stop", "done"))).alias("spans"))


def redacted(documents: DataFrame, mask: str = MASK) -> DataFrame:
    """The documents, with their columns, where every secret is replaced by `mask`; n_chars follows.

    Only the places where a row's own secrets were found change: the same characters elsewhere,
    inside a longer word or in another row of the same (or no) id, stay. Overlapping secrets become
    one mask. Null texts stay null; repeated rows are masked alike.
    """
    row = ["__doc", "__md5"]
    spans = secret_spans(documents).toDF(*row, "__spans")
    pieces = F.transform("__spans", lambda s: F.when(
        s["start"] < s["done"], F.lit("")).otherwise(F.concat(
            F.substring(F.col("text"), s["done"] + 1, s["start"] - s["done"]), F.lit(mask))))
    end = F.array_max(F.transform("__spans", lambda s: s["stop"]))
    text = F.concat(F.array_join(pieces, ""), F.substring(F.col("text"), end + 1, F.length("text")))
    out = documents.withColumns({"__doc": doc_key(), "__md5": _row_md5()}).join(spans, row, "left")
    out = out.withColumn("text", F.when(F.col("__spans").isNotNull(), text).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*documents.columns)
