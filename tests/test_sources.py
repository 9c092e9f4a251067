"""Readers and writers on small files, malformed ones included."""

import json

import pytest
from pyspark.sql import functions as F

from labelgrove.operators import labels as L
from labelgrove.operators import taxonomy as T
from labelgrove.sources import datasets as D
from labelgrove.sources import runs as R
from labelgrove.sources import schema as SCH
from labelgrove.sources import taxonomy_files as TF

TAXONOMY = {"version": "1.0.0", "nodes": [
    {"id": "guitar"}, {"id": "guitar.acoustic", "data": ["x"]}, {"id": "guitar.electric", "planned": ["y"]},
    {"id": "voice", "name": "Voice", "data": ["x"]}]}


def put(path, *docs):
    path.write_text("\n".join(d if isinstance(d, str) else json.dumps(d) for d in docs))
    return str(path)


def test_taxonomy(spark, tmp_path):
    e = TF.read_taxonomy_entries(spark, put(tmp_path / "t.json", TAXONOMY))
    assert TF.taxonomy_errors(e).count() == 0
    rows = {r["node"]: (r["level"], r["is_leaf"], r["ord"]) for r in TF.taxonomy_nodes(e).collect()}
    assert rows == {"guitar": (1, False, 0), "guitar.acoustic": (2, True, 1), "guitar.electric": (2, True, 2),
                    "voice": (1, True, 3)}
    flat = T.closure(TF.taxonomy_nodes(e))
    assert {tuple(r) for r in flat.select("node", "ancestor", "depth").collect()} == {
        tuple(r) for r in T.recursive_closure(TF.taxonomy_nodes(e)).collect()}


def test_broken_taxonomy(spark, tmp_path):
    bad = {"version": "1.0", "nodes": [{"id": "a.b", "data": ["x"]}, {"id": "a"}, {"id": "a"}, {"id": "c.d.e.f", "data": ["x"]}]}
    e = TF.read_taxonomy_entries(spark, put(tmp_path / "t.json", bad))
    errors = {(r["node"], r["error"]) for r in TF.taxonomy_errors(e).collect()}
    assert {("a", "duplicate node"), ("c.d.e.f", "too deep"), (None, "bad version"),
            ("a.b", "parent missing or listed after child")} <= errors
    with pytest.raises(Exception, match="invalid taxonomy"):
        TF.taxonomy_nodes(e).collect()
    with pytest.raises(Exception, match="major"):
        spark.range(1).select(TF.require_same_major(F.lit("2.1.0"), F.lit("3.0.0"))).collect()


def test_rules(spark, tmp_path):
    nodes = TF.taxonomy_nodes(TF.read_taxonomy_entries(spark, put(tmp_path / "t.json", TAXONOMY)))
    rows = [{"source": "s", "table": "map", "label": "gtr", "spec": "guitar"},
            {"source": "s", "table": "map", "label": "duo", "spec": json.dumps(["voice", "guitar.acoustic"])},
            {"source": "s", "table": "map", "label": "any", "spec": json.dumps({"node": "guitar", "children_unknown": False})},
            {"source": "s", "table": "ignore", "label": "fx", "spec": json.dumps({"reason": "noise", "unknown": ["voice"]})}]
    rules = TF.read_rules(spark, put(tmp_path / "r.json", *rows))
    assert TF.rule_errors(rules, nodes).count() == 0
    eff = {r["label"]: sorted(map(tuple, r["effects"])) for r in L.rule_effects(rules, nodes).collect()}
    assert eff["gtr"] == [("positive", "guitar"), ("unknown", "guitar")]
    assert eff["duo"] == [("positive", "guitar.acoustic"), ("positive", "voice")]
    assert eff["any"] == [("positive", "guitar")] and eff["fx"] == [("unknown", "voice")]


def test_multitrack(spark, tmp_path):
    doc = {"track_id": "Foo_Bar", "artist": None, "has_bleed": "Yes", "stems": {
        "S01": {"instrument": '["a", null, "b"]', "filename": "x.wav", "raw": {"R1": {"instrument": "c"}}},
        "S02": {"instrument": None, "raw": {}}}}
    t = D.multitrack(spark, put(tmp_path / "m.json", doc))
    item = t["items"].first()
    assert (item["artist"], item["bleed"]) == ("Foo", True)
    assert sorted(r["label"] for r in t["stem_labels"].collect()) == ["a", "b"]
    assert [r["label"] for r in t["raw_labels"].collect()] == ["c"]
    audio = spark.createDataFrame([("other",)], "track_id string")
    assert D.multitrack(spark, str(tmp_path / "m.json"), audio)["items"].count() == 0


def test_window_clip_schema_tag(spark, tmp_path):
    doc = {"schema": "other/1", "song_id": "s", "window": {"start_s": 1.0, "dur_s": 2.0}, "tracks": [{"trackType": "x"}]}
    with pytest.raises(Exception, match="unexpected clip schema"):
        D.window_clips(spark, put(tmp_path / "w.json", doc)).collect()


def test_partial_clip_errors(spark, tmp_path):
    labels = put(tmp_path / "l.csv", "sample_key,cls,prob,observed", "000001_1,piano,0.9,true", "000002_1,kazoo,0.4,true",
                 "000003_1,piano,1.4,true")
    meta = put(tmp_path / "m.csv", "track_id,artist_id,artist_name,license_title,sample_key,start_time",
               "1,1,A,CC-BY,000001_1,0.0", "2,1,A,CC-BY-NC,000002_1,0.0", "3,1,A,CC,000003_1,0.0")
    parts = {"train": put(tmp_path / "a", "000001_1", "oops"), "test": put(tmp_path / "b", "000001_1", "000009_1")}
    d = D.clip_labels(spark, labels, meta, parts, spark.createDataFrame([("piano",)], "cls string"))
    assert {tuple(r) for r in d["errors"].collect()} == {
        ("000002_1", "unknown class"), ("000003_1", "bad probability"), ("oops", "bad key"),
        ("000001_1", "key in several partitions"), ("000009_1", "partition key without metadata")}
    assert D.licences(spark, meta).count() == 3


def test_xml_tracks(spark, tmp_path):
    xml = "<r><event><pitch>40</pitch><onsetSec>0.1</onsetSec><offsetSec>0.5</offsetSec><excitationStyle>FS</excitationStyle></event></r>"
    put(tmp_path / "t1.xml", xml)
    rows = D.track_styles(D.annotated_tracks(spark, str(tmp_path / "t1.xml"))).collect()
    assert [(r["item"], r["label"]) for r in rows] == [("t1", "FS")]


def test_hand_labels_reader_and_semantics(spark, tmp_path):
    nodes = TF.taxonomy_nodes(TF.read_taxonomy_entries(spark, put(tmp_path / "t.json", TAXONOMY)))
    docs = [{"artist": "A", "title": "x", "listened_fully": True, "labels": {"guitar": {"state": "present", "intervals": [[0, 1]]}}},
            {"artist": "A", "title": "y", "labels": {"voice": {"state": "present"}}}]
    d = D.hand_labels(spark, put(tmp_path / "h.json", *docs))
    got = {(r["item"], r["node"]): r["y"] for r in L.hand_labels(d["items"], d["states"], nodes).collect()}
    assert got == {("A - x", "guitar"): True, ("A - x", "voice"): False, ("A - y", "voice"): True}
    assert d["intervals"].count() == 1


def test_predictions(spark, tmp_path):
    doc = {"taxonomy_version": "1.0.0", "nodes": ["a", "b"], "items": [
        {"item_id": "x", "scores": [.1, .2]}, {"item_id": "x", "scores": [.3, .4]}]}
    s = R.read_predictions(spark, put(tmp_path / "p.json", doc))
    nodes = spark.createDataFrame([("a",)], "node string")
    errors = sorted((r["node"], r["error"]) for r in R.prediction_errors(s, nodes).collect())
    assert errors == [("a", "duplicate"), ("b", "duplicate"), ("b", "unknown node"), ("b", "unknown node")]
    doc["items"] = [{"item_id": "x", "scores": [.1]}]
    with pytest.raises(Exception, match="score count"):
        R.read_predictions(spark, put(tmp_path / "q.json", doc)).collect()
    out = str(tmp_path / "out")
    R.write_predictions(s, out, {"run": "1"})
    assert R.read_written_predictions(spark, out).count() == 4
    with pytest.raises(Exception):
        R.write_predictions(s, out)


def test_archive_is_never_overwritten(spark, tmp_path):
    m = spark.createDataFrame([("map", .5)], "metric string, value double")
    R.archive_run(m, m, str(tmp_path / "runs"), "20240101T000000Z", "a")
    with pytest.raises(Exception):
        R.archive_run(m, m, str(tmp_path / "runs"), "20240101T000000Z", "a")
    with pytest.raises(ValueError):
        R.archive_run(m, m, str(tmp_path / "runs"), "20240101T000000Z", "../a")


def test_vector_alignment_and_reports(spark, tmp_path):
    cache = spark.createDataFrame([("a", [1.0])], "item string, vec array<float>")
    want = spark.createDataFrame([("a", 0), ("b", 1)], "item string, pos int")
    with pytest.raises(Exception, match="no vector for b"):
        R.align_vectors(want, cache).collect()
    doc = json.dumps({"instruments": [{"label": "Piano", "node": "keys.piano", "confidence": .8, "stem": "mix"},
                                      {"label": "Kazoo", "confidence": .4, "stem": "mix"}]})
    R.save_report(spark.createDataFrame([(1, 2, doc)], "analysis_id long, song_id long, report string"), str(tmp_path / "lib"))
    rows = spark.read.parquet(str(tmp_path / "lib/instruments")).collect()
    assert sorted(r["label"] for r in rows) == ["Kazoo", "keys.piano"]
    before = {p.name for p in (tmp_path / "lib/instruments").rglob("*.parquet")}
    again = doc.replace("Kazoo", "Zither")
    R.save_report(spark.createDataFrame([(5, 9, again)], "analysis_id long, song_id long, report string"), str(tmp_path / "lib"))
    assert before <= {p.name for p in (tmp_path / "lib/instruments").rglob("*.parquet")}  # the other song's files stay
    rows = spark.read.parquet(str(tmp_path / "lib/instruments")).collect()
    assert sorted((r["song_id"], r["label"]) for r in rows) == [(2, "Kazoo"), (2, "keys.piano"), (9, "Zither"), (9, "keys.piano")]


def test_library_schemas_parse(spark):
    assert all(SCH.library_schema(name).fieldNames() for name in SCH.LIBRARY)
    with pytest.raises(ValueError):
        D.load_dataset(spark, "nope")
