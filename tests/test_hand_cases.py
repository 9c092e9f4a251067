"""Hand-computed cases, one per operator."""

import math

import pytest
from pyspark.sql import functions as F

from labelgrove.functions import arrays as A
from labelgrove.functions import hashing as H
from labelgrove.functions import scores as S
from labelgrove.functions import text as X
from labelgrove.operators import calibrate as CAL
from labelgrove.operators import clips as C
from labelgrove.operators import gate as G
from labelgrove.operators import labels as L
from labelgrove.operators import library as LIB
from labelgrove.operators import metrics as M
from labelgrove.operators import report as R
from labelgrove.operators import selection as SEL
from labelgrove.operators import taxonomy as T


def obs(spark, y, s, node="a"):
    rows = [(i, node, bool(a), float(b)) for i, (a, b) in enumerate(zip(y, s))]
    return spark.createDataFrame(rows, "item long, node string, y boolean, score double")


def one(df, col):
    return df.first()[col]


@pytest.mark.parametrize("y,s,want", [
    ([1, 0, 1, 0], [.9, .8, .7, .1], 5 / 6),
    ([1, 0, 1], [.5, .5, .2], 0.25 + 1 / 3), ([0, 1, 1], [.5, .5, .2], 0.25 + 1 / 3)])
def test_average_precision(spark, y, s, want):
    assert one(M.average_precision(obs(spark, y, s)), "ap") == pytest.approx(want)


def test_skip_reasons(spark):
    o = obs(spark, [1, 1], [.1, .2]).unionByName(obs(spark, [0, 0], [.1, .2], "b"))
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    got = {r["node"]: (r["skipped"], r["ap"]) for r in M.per_class_ap(o, nodes).collect()}
    assert got == {"a": ("no_negatives", None), "b": ("no_positives", None), "c": ("unobserved", None)}
    assert one(M.macro(M.per_class_ap(o, nodes)), "value") is None


def test_micro_is_one_when_all_positive(spark):
    assert one(M.micro_average_precision(obs(spark, [1, 1], [.1, .2])), "ap") == 1.0


def test_f1_zero_and_null(spark):
    nothing = M.prf_at_threshold(obs(spark, [1, 0], [.1, .2]))
    assert one(nothing, "precision") == 0 and one(nothing, "f1") == 0
    assert one(M.micro_prf(M.threshold_counts(obs(spark, [0, 0], [.1, .2]))), "f1") is None


def test_random_ap(spark):
    f = lambda n, k: spark.range(1).select(M.random_ap(F.lit(n), F.lit(k)).alias("v")).first()[0]
    assert f(5, 5) == pytest.approx(1.0)
    assert f(25, 3) == pytest.approx(0.2233, abs=1e-4)
    h = sum(1 / i for i in range(1, 5001))
    assert f(5000, 7) == pytest.approx(6 / 4999 + h * 4993 / (5000 * 4999), abs=1e-12)
    with pytest.raises(Exception, match="positive"):
        f(5, 0)


def test_last_bin_and_range(spark):
    assert one(M.calibration_bins(obs(spark, [1], [1.0])), "bin") == 14
    with pytest.raises(Exception, match="probabilities"):
        M.calibration_bins(obs(spark, [1], [1.2])).collect()
    with pytest.raises(Exception, match="missing or NaN"):
        M.average_precision(M.require_scores(obs(spark, [1, 0], [float("nan"), .1]))).collect()


def test_hysteresis(spark):
    rows = [("x", i, p) for i, p in enumerate([.1, .4, .25, .2, .5])]
    f = spark.createDataFrame(rows, "s string, frame long, p double")
    got = R.hysteresis_intervals(f, ["s"], .3, .21).select("start_s", "end_s").collect()
    assert sorted(map(tuple, got)) == [(1.0, 3.0), (4.0, 5.0)]


def test_polyphony(spark):
    n = spark.createDataFrame([(1, 0., 1.), (1, 1., 2.), (1, .5, 1.5)], "k int, a double, b double")
    assert one(C.max_polyphony(n, ["k"], "a", "b", 1.0), "polyphony") == 2


def test_activity(spark):
    t = spark.createDataFrame([(1, "a", -20., -10.), (1, "b", -52., -40.), (1, "c", -90., -80.), (1, "d", None, None)],
                              "clip int, n string, rms_db double, peak_frame_db double")
    got = {r["n"]: r["state"] for r in L.activity_states(t).collect()}
    assert got == {"a": "active", "b": "uncertain", "c": "silent", "d": "silent"}


def test_closure_and_propagation(spark):
    df = spark.createDataFrame([("a.b.c",)], "node string")
    assert df.select(T.ancestors_of("node")).first()[0] == ["a", "a.b", "a.b.c"]
    assert df.select(T.parent_of("node"), T.level_of("node"), T.family_of("node")).first()[:] == ("a.b", 3, "a")
    s = spark.createDataFrame([(1, "a", .1), (1, "a.b", .2), (1, "a.b.c", .9)], "item int, node string, score double")
    assert {r["score"] for r in T.max_propagate(s).collect()} == {.9}
    full = {r["node"]: r["synthesised"] for r in T.complete_scores(s.where("node = 'a.b.c'")).collect()}
    assert full == {"a": True, "a.b": True, "a.b.c": False}
    bad = T.violations(s).first()
    assert (bad["checked"], bad["violations"]) == (2, 2)


def nodes(spark, *ids):
    return T.nodes_from_ids(spark.createDataFrame([(i,) for i in ids], "node string"))


def test_observed_set(spark):
    n = nodes(spark, "guitar.acoustic", "guitar.electric", "keys.piano")
    resolved = spark.createDataFrame([(1, "positive", "guitar"), (1, "unknown", "guitar")],
                                     "item int, kind string, node string")
    items = spark.createDataFrame([(1,), (2,)], "item int")
    got = {(r["item"], r["node"]): r["y"] for r in L.observed_exhaustive(items, resolved, n).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == 1} == {"guitar": True, "keys": False, "keys.piano": False}
    assert len([k for k in got if k[0] == 2]) == 5 and not any(v for k, v in got.items() if k[0] == 2)


def test_unmapped_label_masks_all_but_positives(spark):
    n = nodes(spark, "guitar.acoustic", "keys.piano")
    rules = spark.createDataFrame([("piano", ["keys.piano"], None, [], [], False)],
                                  "label string, nodes array<string>, children_unknown boolean, "
                                  "unknown array<string>, stem_unknown array<string>, ignored boolean")
    e = L.rule_effects(rules, n)
    il = spark.createDataFrame([(1, "piano"), (1, "kazoo"), (2, "piano")], "item int, label string")
    for got in (L.exhaustive_labels(il, e, n), L.observed_exhaustive(il, L.resolve(il, e), n)):
        rows = {(r["item"], r["node"]): r["y"] for r in got.collect()}
        assert {k[1] for k in rows if k[0] == 1} == {"keys", "keys.piano"}
        assert rows[(2, "guitar")] is False
    with pytest.raises(Exception, match="kazoo"):
        L.require_mapped(il, e).collect()


def test_drive_and_scores(spark):
    rows = spark.createDataFrame([(.03,), (.05,), (.10,)], "x double").select(S.drive_label(F.col("x")))
    assert [r[0] for r in rows.collect()] == ["clean", None, "distorted"]
    g = spark.range(1).select(S.gain_on_log_features(F.array(F.lit(math.log1p(2.0))), F.lit(3.0)).alias("v")).first()
    assert g["v"][0] == pytest.approx(math.log1p(6.0))


@pytest.mark.parametrize("name,want", [("C4", 60), ("Bb3", 58), ("F#-1", 6), ("H2", None), ("c4", None)])
def test_note_names(spark, name, want):
    assert spark.range(1).select(X.note_to_midi(F.lit(name))).first()[0] == want


@pytest.mark.parametrize("stem,want", [
    ("glock_loud_C6_01", (84, 110, 1)), ("Vibes_hard_A2_v2_rr1_Main", (45, 74, 1)),
    ("KSHarp_A2_mf1", (45, 80, 1)), ("Clap_rr3", (None, 80, 3))])
def test_layered_tokens(spark, stem, want):
    assert tuple(spark.range(1).select(X.layered_tokens(F.lit(stem)).alias("t")).first()["t"]) == want


def test_parse_tokens(spark):
    t = spark.range(1).select(X.parse_tokens(F.lit("Horn.ff.C3Bb3")).alias("t")).first()["t"]
    assert (list(t["pitches"]), t["velocity"]) == ([48, 58], 112)


def test_file_names(spark):
    b = spark.range(1).select(X.bass_note(F.lit("BS_1_EQ_2_FS_NO_3_7")).alias("b")).first()["b"]
    assert (b["bass"], b["pickup"], b["style"], b["pitch"]) == ("1", 2, "FS", 45)
    assert spark.range(1).select(X.bass_note(F.lit("nope")).alias("b")).first()["b"] is None
    e = spark.range(1).select(X.effect_note(F.lit("G12-34567-1234-9")).alias("e")).first()["e"]
    assert (e["instrument"], e["midi"], e["fxgroup"], e["fxtype"], e["fxsetting"], e["filenr"]) == (
        "G", "34", "1", "23", "4", "9")
    assert spark.range(1).select(X.effect_note(F.lit("G1-34567-1234-9")).alias("e")).first()["e"] is None
    assert spark.range(1).select(X.same_number(F.lit("007"), F.lit("7"))).first()[0]


def test_text_helpers(spark):
    row = spark.range(1).select(
        X.truth_value(F.lit(" YES ")), X.truth_value(F.lit("x")), X.instrument_key(F.lit("Yamaha BB604 (jazz)!")),
        X.window_tag(F.lit(20.0)), X.window_tag(F.lit(2.5)), X.redact_urls(F.lit("see http://a.b/c?d now"))).first()
    assert row[:] == (True, None, "yamaha_bb604_jazz", "w20", "w2.5", "see <url> now")
    df = spark.createDataFrame([("  THE  Ärtist’s ",), ("ＡＣＥ",), (None,)], "a string")
    got = {r["a"]: r["n"] for r in X.normalize_names(df, "a", "n").collect()}
    assert got == {"  THE  Ärtist’s ": "the ärtist's", "ＡＣＥ": "ace", None: None}
    with pytest.raises(Exception, match="out of range"):
        spark.range(1).select(X.track_split(F.lit("Track02101"))).collect()


def test_crc_split_equals_zlib(spark):
    import zlib
    names = [f"artist {i}" for i in range(50)]
    df = spark.createDataFrame([(n,) for n in names], "g string").select("g", H.crc_uniform(F.col("g")).alias("u"))
    for r in df.collect():
        assert r["u"] == (zlib.crc32(r["g"].encode()) & 0xFFFFFFFF) / 2 ** 32


def test_gate_order(spark):
    def gate(c, i, sec=(0.5, 0.5), **kw):
        rows = [("map_leaf", c, i), ("ece", *sec)]
        return G.promotion_gate(spark.createDataFrame(rows, "metric string, candidate double, incumbent double"),
                                "map_leaf", **kw).first()
    assert gate(.6, .5)["promote"]
    assert not gate(.5, .5)["promote"]
    assert not gate(None, .5)["comparable"]
    assert gate(.6, .5, (.505, .5))["promote"] and not gate(.6, .5, (.506, .5))["promote"]
    boot = lambda lo, v: spark.createDataFrame([(.1, lo, .2, v, 100)],
                                               "delta double, lo double, hi double, n_valid int, n_boot int")
    assert gate(.6, .5, bootstrap=boot(.01, 95))["promote"]
    assert not gate(.6, .5, bootstrap=boot(-.01, 100))["promote"]
    assert "unavailable" in gate(.6, .5, bootstrap=boot(.01, 94))["reasons"]
    diff = spark.createDataFrame([("taxonomy", "1", "2")], "key string, candidate string, incumbent string")
    assert gate(.6, .5, config_diff=diff)["reasons"] == "configurations differ"


def test_combine_keeps_mix_on_ties(spark):
    mix = spark.createDataFrame([(1, "drums", .5)], "song int, label string, confidence double")
    stems = spark.createDataFrame([(1, "drums", "drums", .5), (1, "vocals", "voice", .9), (1, "other", "bass", .9)],
                                  "song int, stem string, label string, confidence double")
    roles = spark.createDataFrame(list(R.STEM_ROLES), "stem string, label string")
    assert [(r["label"], r["stem"]) for r in R.combine(mix, stems, roles).collect()] == [("drums", "mix")]


def test_job_status_and_tags(spark):
    runs = spark.createDataFrame([
        (1, "transcode", "ok"), (1, "separation", "ok"), (2, "transcode", "failed"), (3, "transcode", "ok"),
        (3, "separation", "ok"), (3, "tagging_leaf", "failed"), (4, "transcode", "ok"), (4, "tagging_leaf", "ok")],
        "job_id int, stage string, status string")
    got = {r["job_id"]: r["status"] for r in LIB.job_status(runs, ["separation"], ["tagging_leaf"]).collect()}
    assert got == {1: "done", 2: "failed", 3: "partial", 4: "failed"}
    songs = spark.createDataFrame([(1, " Rock, ,JAZZ")], "song_id int, genres string")
    assert sorted(r["tag"] for r in LIB.genre_tags(songs).collect()) == ["jazz", "rock"]


def test_windows_and_levels(spark):
    df = spark.createDataFrame([(1, [1.0] * 7), (2, [2.0])], "k int, s array<double>")
    got = {(r["k"], r["w"]): list(r["part"]) for r in A.windows(df, ["k"], "s", 3, 2).collect()}
    assert got == {(1, 0): [1.0] * 3, (1, 1): [1.0] * 3, (2, 0): [2.0, 0.0, 0.0]}
    lv = A.levels(df, ["k"], "s", 2).where("k = 1").first()
    assert (lv["rms_db"], lv["peak_frame_db"]) == (0.0, 0.0)
    zero = spark.createDataFrame([(1, [0.0, 0.0])], "k int, s array<double>")
    assert A.levels(zero, ["k"], "s", 2).first()["rms_db"] is None


def test_key_of_a_profile(spark):
    turned = [A.MINOR[(b - 9) % 12] for b in range(12)]
    df = spark.createDataFrame([(1, turned)], "k int, chroma array<double>")
    assert A.detect_key(df, ["k"]).first()["key"] == "A minor"


def test_temperature_identity_without_both_classes(spark):
    o = obs(spark, [1, 1], [.6, .9]).withColumn("level", F.lit(1))
    assert CAL.fit_temperatures(o, ["level"], 1).first()["temperature"] == 1.0


def test_units_that_are_refused(spark):
    mix = spark.createDataFrame([(1, "a", True), (1, "b", False)], "item long, node string, y boolean")
    stems = spark.createDataFrame([(1, "s", "a", True, True), (1, "s", "a", True, True)], "item long, stem string, node string, y boolean, bleed boolean")
    assert SEL.require_single_labels(SEL.units(mix, stems, "mix"), "mix").count() == 2
    for kwargs, message in (({"unit": "mix", "exclude_bleed": True}, "only stems"), ({"unit": "stem", "exclude_bleed": True}, "no stems"),
                            ({"unit": "bar"}, "mix or stem")):
        with pytest.raises(ValueError, match=message):
            SEL.units(mix, stems, **kwargs)
    with pytest.raises(ValueError, match="occurs 2 times"):
        SEL.require_single_labels(SEL.units(mix, stems, "stem"), "stem")
