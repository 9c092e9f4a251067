"""The stored-table jobs and the stage runner."""

import random

import pytest

from labelgrove import jobs


def test_jobs(spark, tmp_path, capsys):
    rng = random.Random(0)
    rows = [(i, n, rng.random() < .4, rng.random(), f"g{i % 8}") for i in range(80) for n in ("a", "a.b")]
    obs = spark.createDataFrame(rows, "item long, node string, y boolean, score double, grp string")
    good = obs.withColumn("score", obs.score * 0.1 + obs.y.cast("double") * 0.8)
    p = lambda n: str(tmp_path / n)
    obs.write.parquet(p("inc"))
    good.write.parquet(p("cand"))
    spark.createDataFrame([("a", False), ("a.b", True)], "node string, is_leaf boolean").write.parquet(p("nodes"))
    jobs.main(["compare", "--input", p("cand"), "--scores", p("inc"), "--n-boot", "40"])
    assert "|true   |true" in capsys.readouterr().out
    good.withColumn("score", 0.98 + good.score * 0.02).write.parquet(p("loud"))  # same order, ruined calibration
    jobs.main(["compare", "--input", p("loud"), "--scores", p("inc"), "--nodes", p("nodes"), "--n-boot", "40"])
    out = capsys.readouterr().out
    assert "|false  |true" in out and "secondary ece regressed" in out
    jobs.main(["run", "--input", p("inc"), "--scores", p("inc"), "--nodes", p("nodes"), "--output", p("runs")])
    assert "map_leaf" in capsys.readouterr().out
    obs.where("item < 40").write.parquet(p("half"))
    part = ["run", "--input", p("inc"), "--scores", p("half"), "--nodes", p("nodes"), "--output", p("part")]
    with pytest.raises(ValueError, match="40 labelled items"):
        jobs.main(part)
    jobs.main([*part, "--allow-missing"])
    obs.union(obs.limit(1)).write.parquet(p("twice"))
    with pytest.raises(ValueError, match="occurs 2 times"):
        jobs.main(["run", "--input", p("twice"), "--scores", p("inc"), "--nodes", p("nodes"), "--output", p("no")])
    jobs.main(["make-split", "--input", p("inc"), "--output", p("pin")])
    jobs.main(["baseline", "--input", p("inc"), "--nodes", p("nodes"), "--output", p("prior")])
    assert spark.read.parquet(p("prior")).count() == 2


def test_archived_runs(spark, tmp_path, capsys):
    rng = random.Random(1)
    p = lambda n: str(tmp_path / n)
    rows = [(i, n, rng.random() < .4, f"g{i % 9}") for i in range(90) for n in ("a.b", "a.c", "d.e")]
    labels = spark.createDataFrame(rows, "item long, node string, y boolean, grp string")
    labels.write.parquet(p("labels"))
    spark.createDataFrame([("a", False), ("a.b", True), ("a.c", True), ("d", False), ("d.e", True)],
                          "node string, is_leaf boolean").write.parquet(p("nodes"))
    for k, (name, skill) in enumerate([("good_s0", .8), ("good_s1", .7), ("base_s0", .2), ("base_s1", .1), ("ref", .3)]):
        noise = random.Random(k)
        spark.createDataFrame([(i, n, skill * y + (1 - skill) * noise.random()) for i, n, y, _ in rows],
                              "item long, node string, score double").write.parquet(p(f"pred_{name}"))
        jobs.main(["run", "--input", p("labels"), "--scores", p(f"pred_{name}"), "--nodes", p("nodes"), "--output", p("runs"),
                   "--stamp", f"2024010{k + 1}T000000Z", "--name", name, "--train", p("labels")])
    run = lambda k, name: p(f"runs/run=2024010{k}T000000Z_{name}")
    metrics = {r.metric: r.value for r in spark.read.parquet(run(1, "good_s0") + "/metrics").collect()}
    assert 0 <= metrics["prior_ece_classwise"] < .01 and .2 < metrics["prior_brier"] < .25
    capsys.readouterr()
    pair = ["--input", run(1, "good_s0"), "--scores", run(3, "base_s0"), "--archived", "--n-boot", "50"]
    jobs.main(["compare", *pair, "--secondary", "f1_macro_leaf"])
    assert "|true   |true" in capsys.readouterr().out
    jobs.main(["compare", *pair, "--primary", "brier", "--secondary", "map_macro"])
    assert "|true   |true" in capsys.readouterr().out
    jobs.main(["run", "--input", p("labels"), "--scores", p("pred_base_s0"), "--nodes", p("nodes"), "--output", p("other"),
               "--stamp", "20240101T000000Z", "--threshold", "0.6"])
    jobs.main(["compare", "--input", run(1, "good_s0"), "--scores", p("other/run=20240101T000000Z_run"), "--archived", "--no-bootstrap"])
    assert "configurations differ" in capsys.readouterr().out
    spark.createDataFrame([("a.b", 5), ("a.c", 5)], "node string, n long").write.parquet(p("tc"))
    spark.createDataFrame([("a.b", 5), ("a.c", 0)], "node string, n long").write.parquet(p("ti"))
    for check in ("old", "new"):
        jobs.main(["adopt", *pair, "--check", check, "--train", p("tc"), "--inc-train", p("ti"), "--output", p(check)])
        assert spark.read.parquet(p(check)).first().passed
    jobs.main(["triangle", "--input", p("runs"), "--nodes", p("nodes"), "--n-boot", "30", "--output", p("arms")])
    arms = {r.arm: r for r in spark.read.parquet(p("arms")).collect()}
    assert {a: r.n_seeds for a, r in arms.items()} == {"good": 2, "base": 2, "ref": 1}
    assert all(r.lo <= r["max"] and r.min <= r["mean"] <= r["max"] and r.n_valid == 30 for r in arms.values())
    jobs.main(["triangle", "--input", p("runs"), "--nodes", p("nodes"), "--n-boot", "30", "--output", p("pairs"),
               "--pair", "good:base", "--pair", "good:ref", "--pair", "good:none"])
    got = sorted((r.incumbent, r.seed, r.incumbent_seed, r.excludes_0) for r in spark.read.parquet(p("pairs")).collect() if r.seed is not None)
    assert got == [("base", 0, 0, True), ("base", 1, 1, True), ("ref", 0, -1, True), ("ref", 1, -1, True)]
    assert spark.read.parquet(p("pairs")).where("incumbent = 'none' and delta is null").count() == 1
    jobs.main(["baseline", "--input", p("labels"), "--nodes", p("nodes"), "--kind", "random", "--output", p("rnd")])
    assert spark.read.parquet(p("rnd")).count() == 90 * 5


def test_stage_rows(spark, tmp_path):
    table = str(tmp_path / "stages")
    assert jobs.run_stage(spark, 1, "a", lambda: 5, table) == 5
    assert jobs.run_stage(spark, 1, "b", lambda: 1 / 0, table) is None
    jobs.skip_stage(spark, 1, "c", "no model", table)
    got = {r["stage"]: r["status"] for r in spark.read.parquet(table).collect()}
    assert got == {"a": "ok", "b": "failed", "c": "skipped"}
