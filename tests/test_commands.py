"""The command line over a table, splits and starts."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fogmeans.operators import starts
from fogmeans.plans import commands, jobs
from fogmeans.sources import points as pts


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    path = f"file://{tmp_path_factory.mktemp('t')}/points"
    rows = [(i, float(a), float(b), "xyz"[i % 3]) for i, (a, b) in enumerate(rng.normal(size=(240, 2)) + 5 * (np.arange(240) % 3)[:, None])]
    spark.createDataFrame([*rows, (999, None, 1.0, "x")], "id long, a double, b double, kind string").write.parquet(path)
    return path


@pytest.mark.parametrize("command,more,keys", [("cells", ["--only", "post,pre_mass_on"], {"post_none_off", "pre_mass_on"}), ("methods", ["--only", "F-FCM,scffcm,Stallmann-avg2"], {"F-FCM", "scffcm", "Stallmann-avg2"}), ("calibrate", [], None), ("audit", [], {"paper", "kmeanspp_best", "oracle"}), ("descent", ["--split", "dirichlet", "--alpha", "5"], {"pre_none", "post_none"})])
def test_commands(spark, table, tmp_path, command, more, keys, monkeypatch):
    monkeypatch.setattr(commands, "GRIDS", {"pedrycz": [{"step": 0.001}, {"step": 0.0001}]})
    out = f"file://{tmp_path}/out"
    if command == "audit":
        monkeypatch.setattr(commands.table_runs, "audit", lambda f, m, *_, real=commands.table_runs.audit: real(f, m, 5, 2))
    commands.main([command, "--points", table, "--out", out, "--row-id", "id", "--label", "kind", "--x", "a,b", "--scale", "--split", "labels", "--clients", "3", "--k", "3", "--rounds", "2", "--steps", "1", *more], spark)
    rows = spark.read.option("header", True).csv(out).collect()
    assert rows and rows[0]["dataset"] == "points" and rows[0]["seed"] == "0"
    if keys:
        column = {"cells": "cell", "methods": "method", "audit": "init", "descent": "cell"}[command]
        assert {r[column] for r in rows} == keys
    meta = json.loads(spark.read.text(f"{out}.meta").head()["value"])
    assert meta["args"]["command"] == command and meta["code"] == jobs.code_digests()


def test_splits_and_starts(spark):
    rows = [(i, 0, [float(i % 4), float(i)], "abcd"[i % 4]) for i in range(400)]
    p = spark.createDataFrame(rows, "row_id long, client int, x array<double>, y string")
    by_label = pts.split_points(p, "labels", 4, per_client=2)
    assert sorted(r["n"] for r in by_label.groupBy("client").agg(F.count("*").alias("n"), F.count_distinct("y").alias("k")).collect()) == [100] * 4 and sorted(by_label.columns) == sorted(p.columns)
    assert pts.split_points(p, "ids", 7).groupBy("client").count().count() == 7 and pts.split_points(p, "own") is p
    assert pts.split_points(p, "dirichlet", 3, alpha=10.0).count() == 400
    with pytest.raises(RuntimeError):
        pts.split_points(p, "ids", 300)
    with pytest.raises(ValueError):
        pts.split_points(p, "other")
    assert starts.class_means(p).tolist() == [[c, float(np.mean(range(c, 400, 4)))] for c in range(4)]
    a, b = starts.drawn_rows(p, 5, 1), starts.drawn_rows(p.repartition(9), 5, 1)
    assert np.array_equal(a, b) and len({tuple(r) for r in a.tolist()}) == 5 and not np.array_equal(a, starts.drawn_rows(p, 5, 2))
    with pytest.raises(ValueError):
        starts.drawn_rows(p.limit(2), 3)
    with pytest.raises(ValueError):
        commands.rule("nothing", commands.parser().parse_args(["cells", "--points", "", "--out", ""]))


def test_placeholders_and_uploads(spark):
    rng = np.random.default_rng(1)
    rows = [(i % 2, i, r.tolist(), int(i % 3)) for i, r in enumerate(rng.normal(size=(60, 2)))]
    f = commands.table_runs.Federation("t", spark.createDataFrame(rows, "client int, row_id long, x array<double>, y int"), np.array([[0.0, 0.0], [1.0, 1.0]]))

    def fails(_):
        raise FloatingPointError

    wild = lambda f: commands.clientstate.run(f.store, commands.clientstate.Variates(1e200, 1e200, 2), f.v0, 5)
    got = {r["method"]: r for r in commands.table_runs.rules(f, {"none": lambda f: None, "fails": fails, "wild": wild, "scffcm": lambda f: commands.clientstate.run(f.store, commands.clientstate.Variates(steps=1), f.v0, 2, tol=None)}).collect()}
    f.close()
    for name in ("none", "fails", "wild"):
        assert all(np.isnan(got[name][c]) for c in commands.table_runs.METRICS) and got[name]["upload_numbers"] == -1
    assert got["none"]["n_rounds"] == got["fails"]["n_rounds"] == -1 and got["wild"]["n_rounds"] > 0
    assert got["scffcm"]["upload_numbers"] == 2 * 2 * (2 * 2 * 2) and np.isfinite(got["scffcm"]["fcm_obj"])
