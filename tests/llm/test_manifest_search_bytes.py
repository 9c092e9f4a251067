"""Manifest, lexical search and byte repeats against brute force, on odd rows, crowds and empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from labelgrove.llm import bwt, byte_repeats, lexical, merkle

random.seed(5)
FOLD = {c: c + 32 for c in range(65, 91)}
LINE = "The Quick brown fox jumps over the lazy dog and runs away; "
PASSAGE = "".join(random.choice("abcdefgh ") for _ in range(700))
ROWS = [
    (1, PASSAGE, "en"), (2, "x" + PASSAGE[100:650] + "Y", "en"), (3, None, "en"), (4, "", None), (5, "MIT " * 300, "de"),
    (None, PASSAGE[:450] + "é" * 300, "en"), (None, "no id", None), (6, "z" * 9000, "fr"), (6, "second of six", "fr"),
    (6, "second of six", "fr"), (7, LINE * 30, "en"), (8, LINE * 9 + "ende", "é"), (9, "Fox DOG fox-dog", ""), (10, "ABC", "en"),
    *[(100 + i, f"{i:03d} start " + PASSAGE[200:520] + f" {i} end {i * i}" * 20, "en") for i in range(60)]]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lo long, tree string, copy int, score double, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, la, None if d == 1 else "s", len(t or ""), 1, "t", 2, 0.5, 3) for d, t, la in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, s, la, n, t: sha("".join(map(enc, (d, s, la, n, t))))

    def levels(hashes):
        out = [hashes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    def steps(lv, i):
        for level in lv[:-1]:
            run = level[i // 8 * 8:i // 8 * 8 + 8]
            yield "".join(run[:i % 8]), "".join(run[i % 8 + 1:])
            i //= 8
    trees = collections.defaultdict(list)
    for d, s, la, n, t in rows:
        bad = t.translate(FOLD) if t is not None and d is not None and zlib.crc32(str(d).encode()) % 3 == 0 else t
        trees[la].append((d, leaf(d, s, la, n, t), leaf(d, s, la, n, bad)))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for la in names:
        trees[la].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        built[la] = levels([x[1] for x in trees[la]])
    top = levels([built[la][-1][0] for la in names])
    out = []
    for at, la in enumerate(names):
        for i, (d, own, bad) in enumerate(trees[la]):
            path = [*steps(built[la], i), *steps(top, at)]
            node = bad
            for left, right in path:
                node = sha(left + node + right)
            out.append((d, own, built[la][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return out


def test_manifest_equals_brute_force(docs):
    rows = [(d, None if d == 1 else "s", la, len(t or ""), t) for d, t, la in ROWS]
    got = [tuple(r) for r in merkle.manifest(docs).collect()]
    assert sorted(got, key=repr) == sorted(brute_manifest(rows), key=repr)
    assert {r[-1] for r in got} == {True, False}


def test_one_tree_of_many_levels(spark):
    rows = [(i, f"Text {i}", "en") for i in range(600)]
    got = [tuple(r) for r in merkle.manifest(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(brute_manifest([(d, None if d == 1 else "s", la, len(t), t) for d, t, la in rows]))


def brute_search(docs, items, k=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    words = [(d, collections.Counter(split(t))) for d, t, *_ in docs]
    words = [(d, c, sum(c.values())) for d, c in words if c]
    n_docs, total = len(words), sum(n for *_, n in words)
    df = collections.Counter(t for _, c, _ in words for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in words:
            m = 10 + (90 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in set(split(text)) if t in c)
            if score > 0:
                found.append((-score, (d is not None, d or 0), d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(found, key=lambda x: x[:2])[:k])]
    return out


ITEMS = [(1, "the QUICK fox"), (2, None), (3, ""), (4, "start end 7 zzz"), (None, "dog, DOG; second"), (1, "é" * 300), (5, "nowhere"),
         (6, "MIT é abc no id of six")]


@pytest.mark.parametrize("bounds", [{}, {"ITEMS": 2, "TILE_TERMS": 3, "TILE_DOCS": 4, "BLOCK_TERMS": 4}])
def test_search_equals_brute_force(spark, docs, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(lexical, name, value)
    items = spark.createDataFrame([(*i, 5) for i in ITEMS], "item_id long, text string, rank int")
    got = [tuple(r) for r in lexical.search(docs, items).collect()]
    assert sorted(got, key=repr) == sorted(brute_search(ROWS, ITEMS), key=repr)


def test_a_tile_never_reaches_2_53():
    scores = np.full((1, lexical.TILE_TERMS), 10.0 ** 6 * lexical.weights(10 ** 15, np.array([1]))[0]).sum()
    assert scores < 2 ** 53


def brute_bytes(texts, length=byte_repeats.LENGTH):
    texts = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        gone = gone[:-1]
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize("group_bytes, crowd", [(1 << 20, 32), (3000, 32), (3000, 2), (500, 0)])
def test_byte_repeats_equal_brute_force(spark, docs, group_bytes, crowd):
    near = [list(PASSAGE * 3) for _ in range(40)]
    for i, text in enumerate(near):
        text[13 * i + 300] = "#"
    more = [(1000 + i, "".join(t), "en") for i, t in enumerate(near)] + [(2000 + i, f"{i}" * 3 + LINE * 7 + f"{i * 7}" * 5, "en") for i in range(40)]
    every = docs.unionByName(frame(spark, more)).repartition(5)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in
           byte_repeats.remove_byte_repeats(every, group_bytes, crowd).collect()]
    rows = ROWS + more
    want = [(d, *b) for (d, *_), b in zip(rows, brute_bytes([t for _, t, _ in rows]), strict=True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(w[2] and w[2] < w[1] for w in want) and any(not w[2] for w in want)


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(byte_repeats, "PIECE", 1000)
    monkeypatch.setattr(byte_repeats, "SEGMENT", 50)
    body = "".join(random.choice("abcdefghij") for _ in range(5000))
    texts = [body, "ab" * 900 + body[1300:3800], "q" * 3000]
    out = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in byte_repeats.remove_byte_repeats(out).collect())
    assert got == [(i, *b) for i, b in enumerate(brute_bytes(texts))]


def test_transform_equals_counting():
    for trial in range(150):
        length, letters = random.choice([3, 8, 13, 20]), random.choice(["ab", "abcd", "abcdefghijklmnopqrst"])
        base = [random.choice(letters) for _ in range(60)]
        strings = []
        for _ in range(random.randrange(1, 9)):
            text = base[random.randrange(30):random.randrange(31, 60)]
            text[random.randrange(len(text))] = random.choice(letters)
            strings.append("".join(text).encode())
        strings += [b"a" * 40] * (trial % 7 == 0) + [b""] * (trial % 5 == 0)
        seen = collections.Counter(s[i:i + length] for s in strings for i in range(len(s) - length + 1))
        want = [i + length <= len(s) and seen[s[i:i + length]] > 1 for s in strings for i in range(len(s))]
        got = bwt.repeated_starts(np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0, *map(len, strings)]), length)
        assert got.tolist() == want


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    items = spark.createDataFrame([(1, "fox")], "item_id long, text string")
    assert merkle.manifest(none).count() == 0
    assert byte_repeats.remove_byte_repeats(none).count() == 0
    assert lexical.search(none, items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
