"""Cases in which the corpus operators once did less than their whole job."""

import collections
import hashlib
import itertools
import math
import zlib

import numpy as np

import corpus_pipeline
from labelgrove.llm import class_lm, decontaminate, secrets
from oracle import DATA


def ids(held_out):
    """Ids whose rows `class_lm.score` holds out, or not."""
    return (i for i in itertools.count() if (zlib.crc32(str(i).encode()) % 7 == 2) == held_out)


def test_every_word_has_a_class_of_its_own_context(spark):
    """20,100 more frequent words leave two rarer ones, of equal counts and endings, their own classes."""
    train, held = ids(False), list(itertools.islice(ids(True), 2))
    filler = [f"w{i:05d}" for i in range(20_100)]
    rows = [(next(train), " ".join(filler[i:] + filler[:i])) for i in range(12)]
    rows += [(next(train), "red aaxx runs") for _ in range(10)] + [(next(train), "blue bbxx stops") for _ in range(10)]
    rows += [(held[0], "red aaxx runs"), (held[1], "red bbxx runs")]
    got = {r.doc_id: r for r in class_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert abs(got[held[0]].base_score - got[held[1]].base_score) < 1e-9
    assert got[held[0]].score > got[held[1]].score


def test_exchange_ends_where_a_round_gains_nothing(spark):
    """Likelihood and scores by plain loops; a further round of moves gains less than the tolerance."""
    class_lm.prepare(spark)
    rows = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 120").select(
        "doc_id", "text", (class_lm.crc_of_id() % 7 == 2).alias("held_out"))
    model, _ = class_lm.train(rows)
    texts = {r.doc_id: (r.held_out, class_lm.words_of((r.text or "").encode())) for r in rows.collect()}
    count = collections.Counter(w for held, ws in texts.values() if not held for w in ws)
    number = {w: i for i, w in enumerate(sorted(count, key=lambda w: (-count[w], w)))}
    size = class_lm.class_count(len(number))
    assert len(model.classes) == len(number) + 1
    of = lambda w: int(model.classes[number[w]])
    after = collections.Counter()
    for held, ws in texts.values():
        path = [size - 1, *[of(w) for w in ws], size - 1] if not held else []
        after.update(zip(path, path[1:]))
    before = collections.Counter()
    for (a, _), n in after.items():
        before[a] += n
    mass = {c: sum(n + 1 for w, n in count.items() if of(w) == c) + 1 for c in range(size - 1)}
    p = lambda a, c: (after[a, c] + 0.1) / (before[a] + 0.1 * size)
    got = {r.doc_id: r.score for r in class_lm.score(rows.select("doc_id", "text")).collect()}
    assert set(got) == set(texts)
    for d, (_, ws) in texts.items():
        if all(w in number for w in ws):
            path = [size - 1, *[of(w) for w in ws], size - 1]
            want = sum(math.log10(p(a, c)) for a, c in zip(path, path[1:])) + sum(math.log10((count[w] + 1) / mass[of(w)]) for w in ws)
            assert abs(got[d] - want) < 1e-6 * max(1, abs(want))

    steps = [np.array([model.classes[number[w]] if w else size - 1 for w in [None, *ws, None]]) for held, ws in texts.values() if not held]
    words = [np.array([number[w] if w else len(number) for w in [None, *ws, None]]) for held, ws in texts.values() if not held]
    table = np.zeros((size, size))
    for x in steps:
        np.add.at(table, (x[:-1], x[1:]), 1)
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    bits = lambda t: (f(t) - f(t.sum(0)) - f(t.sum(1)) + f(t.sum())) / t.sum() / math.log(2)
    pairs = collections.Counter((int(a), int(b)) for x in words for a, b in zip(x, x[1:]))
    near = class_lm.neighbours(spark.createDataFrame([(*k, n) for k, n in pairs.items()], "a int, b int, n long"), len(number), [])
    new, now = model.classes, table
    for half in (0, 1):
        new = class_lm.moved_classes(near, new, now, half, 2, 0)
        now = np.zeros((size, size))
        for x in words:
            np.add.at(now, (new[x[:-1]], new[x[1:]]), 1)
    assert bits(now) - bits(table) < class_lm.TOLERANCE
    spread = class_lm.neighbours(spark.createDataFrame([(*k, n) for k, n in pairs.items()], "a int, b int, n long"), len(number), [3, 2])
    one, two = (class_lm.moved_classes(x, model.classes, table, 0, 1, s) for x, s in ((near, 0), (spread, 2)))
    assert (one == two).all()


def test_rows_of_one_id_are_scored_each_for_itself(spark):
    train = next(ids(False))
    filler = " ".join(f"w{i:05d}" for i in range(20_100))
    rows = [(train, filler), (train, filler), (None, "zz rare"), (None, "zz rare"), (None, "w00001 zz unseen"), (train, "zz rare")]
    got = class_lm.score(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id is None, r.n_tokens, r.n_known) for r in got.collect()) == [
        (False, 3, 3), (False, 20_101, 20_101), (False, 20_101, 20_101), (True, 3, 3), (True, 3, 3), (True, 4, 4)]
    alike = {round(r.score, 9) for r in got.where("doc_id is null and n_tokens = 3").collect()}
    assert len(alike) == 1


def test_pipeline_stages_judge_rows_not_ids(spark):
    """Texts that duplicate nothing stay, with null or shared ids; a contaminated row takes no other with it."""
    text = lambda x: " ".join(f"{x}{i}" for i in range(20))
    rows = [(None, text("a")), (None, text("b")), (None, text("a")), (5, text("c")), (5, text("d")), (7, text("d")), (4, text("c")),
            (None, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.near_duplicates(spark, docs, DATA)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    want = [(None, text("a")), (None, text("b")), (4, text("c")), (5, text("d")), (None, None), (8, "")]
    assert sorted(map(tuple, left.collect()), key=key) == sorted(want, key=key)
    bench = spark.createDataFrame([(1, text("a"))], "item_id long, text string")
    clean = decontaminate.without_contaminated(left, bench)
    assert sorted(map(tuple, clean.collect()), key=key) == sorted(want[1:], key=key)


def test_every_occurrence_of_a_value_is_described(spark):
    """First inside another run, then in plain text, then as a password; places count characters."""
    value = "45bb0d53635bf1b89d"
    text = f"\U0001f600 xx{value}yy then {value} and password={value}"
    rows = secrets.candidates(spark.createDataFrame([(1, text, "src")], "doc_id long, text string, source string")).collect()
    assert all(text[r.start:r.start + len(r.value)] == r.value and text[:r.start].endswith(r.before) for r in rows)
    assert sorted(r.start for r in rows if r.value == value) == [text.index(value, 20), text.rindex(value)]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source")
    got = secrets.secret_findings(docs.unionByName(spark.createDataFrame([(-1, text, "src")], docs.schema))).where("doc_id = -1")
    want = hashlib.sha256(value.encode()).hexdigest()
    assert {(r.start, r.secret) for r in got.collect() if r.value_sha256 == want} == {
        (text.index(value, 20), True), (text.rindex(value), True)}
