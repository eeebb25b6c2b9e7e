"""Operators on hot clients, chained rounds, partitions, readers and the analysis."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fogmeans.operators import gates, hypotheses, kernel, metrics, relation
from fogmeans.plans import analysis, experiments, posthoc, theory
from fogmeans.plans import rounds as fed
from fogmeans.sources import points as pts


def clients(n=4, rows=60, dim=3, seed=0):
    r = np.random.default_rng(seed)
    return [(r.normal(i, 1, (rows + 7 * i, dim)), r.integers(0, 3, rows + 7 * i)) for i in range(n)]


def test_quantiles_are_exact(spark):
    r = np.random.default_rng(1)
    groups = {0: r.normal(size=1001), 1: np.repeat([1.0, 2.0, 3.0], [5, 1, 700]), 2: np.array([4.0]), 3: np.array([1.0, 9.0]), 4: r.random(500) ** 20}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [(0, None)], "g int, v double")
    for q in (0.0, 0.25, 0.95, 1.0):
        for bins, passes in ((8, 1), (8, 3), (16_384, 1)):
            got = {x["g"]: (x["quantile"], x["n"]) for x in gates.quantiles(df, ["g"], "v", q, bins, passes).collect()}
            for g, vs in groups.items():
                assert got[g] == (pytest.approx(np.quantile(vs, q), abs=1e-12), len(vs))


def test_chained_rounds_scan_once(spark):
    p = pts.to_points(spark, clients())
    c = kernel.first_rows(p, 3)
    for _ in range(10):
        c = kernel.server_step(kernel.local_sums(p, c), kernel.settled(c))
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 8
    back = fed.LocalBackend([x for x, _ in clients()])
    v = np.array([r["v"] for r in kernel.first_rows(p, 3).orderBy("j").collect()])
    want = fed.run_cell(back, v, "pre", "none", rounds=10, steps=1).centers
    assert np.allclose(np.array([r["v"] for r in c.orderBy("j").collect()]), want)
    with pytest.raises(ValueError):
        kernel.centers_frame(spark, np.zeros((kernel.MOST_CENTERS + 1, 1)))
    with pytest.raises(ValueError):
        kernel.settled(spark.range(kernel.MOST_CENTERS + 1).select(F.col("id").cast("int").alias("j"), F.array(F.lit(0.0)).alias("v")))


def test_split_takes_the_smallest_hashes(spark):
    p = pts.to_points(spark, clients())
    for share in (0.0, 0.2, 0.99):
        rows = pts.split_rows(p, share, 5).withColumn("key", F.xxhash64("row_id", F.lit(5))).collect()
        assert len(rows) == p.count()
        for c in range(4):
            mine = [r for r in rows if r["client"] == c]
            k = max(1, min(len(mine) - 1, int(np.floor(share * len(mine) + 0.5))))
            # unsigned order of the hashes, as their leading bits are counted
            order = sorted(mine, key=lambda r: (r["key"] >> 52 & 0xFFF, r["key"], r["row_id"]))
            assert [r["test"] for r in order] == [True] * k + [False] * (len(mine) - k)


def test_dirichlet_split(spark):
    p = pts.to_points(spark, [(np.zeros((900, 1)), np.arange(900) % 3)])
    got = pts.dirichlet_split(p, 4, 0.5, 3)
    assert got.count() == 900 and sorted(got.columns) == sorted(p.columns)
    again = pts.dirichlet_split(p.repartition(3), 4, 0.5, 3)
    assert sorted(map(tuple, got.select("row_id", "client").collect())) == sorted(map(tuple, again.select("row_id", "client").collect()))
    assert min(r["count"] for r in got.groupBy("client").count().collect()) >= 5
    with pytest.raises(RuntimeError):
        pts.dirichlet_split(p, 4, 0.5, 3, least=400, attempts=3)
    ranks = pts.ranked(p, "y", F.xxhash64("row_id")).collect()
    for y in range(3):
        assert sorted(r["r"] for r in ranks if r["y"] == y) == list(range(300))


def test_feature_view():
    x = np.random.default_rng(0).normal(size=(50, 4)) @ np.diag([5, 2, 1, 0.0])
    z = pts.feature_view(x)
    assert np.allclose(z[:, :3].std(axis=0), 1) and (z[:, 3] == 0).all()
    plain, white = pts.feature_view(x, 2), pts.feature_view(x, 2, True)
    assert np.allclose(np.cov(plain.T)[0, 1], 0) and np.allclose(np.cov(white.T), np.eye(2))
    assert np.allclose(plain / plain.std(axis=0), white / white.std(axis=0))


def test_gate_variants():
    data = [x for x, _ in clients()]
    back, v = fed.LocalBackend(data), data[0][:3]
    one = fed.run_cell(back, v, "post", "footprint", True, 3, 2, server_gate=False, client_gate=False, track=True)
    free = fed.run_cell(back, v, "post", "none", True, 3, 2, track=True)
    assert np.allclose(one.centers, free.centers) and np.allclose(one.history, free.history) and len(one.history) == 3
    half = fed.run_cell(back, v, "post", "none", True, 3, 2, fixed_relevance=0.5)
    assert np.allclose(half.centers, fed.run_cell(back, v, "post", "none", True, 3, 2, fixed_relevance=0.5, server_gate=False).centers)
    assert not np.allclose(half.personal[0], free.personal[0])
    fed.register_gate("half", lambda back, v, m, clients, floor: {p: np.full(len(v), 0.5) for p in clients})
    assert np.allclose(half.personal[0], fed.run_cell(back, v, "post", "half", True, 3, 2).personal[0])
    fed.OWN_GATES.clear()
    for name in ("mass", "unknown"):
        with pytest.raises(ValueError):
            fed.register_gate(name, None) if name in fed.GATES else fed.run_cell(back, v, "post", name)


def test_counter_example():
    got = {r["steps"]: r for r in theory.counter_example()}
    assert got[1]["objective"] == pytest.approx(11.236762, abs=1e-6)
    for steps, target, shift, rise in ((1, 0, 0, 0), (2, 0.138457, 0.103843, 0.422833), (5, 0.260075, 0.195056, 1.490405)):
        assert (got[steps]["target_shift"], got[steps]["shift"], got[steps]["rise"]) == (pytest.approx(target, abs=1e-6), pytest.approx(shift, abs=1e-6), pytest.approx(rise, abs=1e-6))
    assert len({theory.blobs(o)[0][0, 1] for o in theory.ORDERS}) >= 2
    assert all(theory.counter_example(o)[2]["rise"] > 0 for o in theory.ORDERS)


def test_collapse_and_summary(spark):
    x = np.concatenate([np.zeros((10, 2)), np.full((10, 2), 10.0)])
    p = pts.to_points(spark, [(x, np.zeros(20, int)), (x[:10] + 1, np.zeros(10, int))])
    c = kernel.centers_frame(spark, np.array([[0.0, 0.0], [0.0, 0.01], [10.0, 10.0]]))
    got = {r["client"]: r for r in metrics.client_validity(p, c).collect()}
    scale = np.sqrt(((x - x.mean(axis=0)) ** 2).sum(axis=1).mean())
    assert got[0]["collapse_threshold"] == pytest.approx(0.03 * scale) and got[0]["collapsed_pairs"] == 1
    assert got[1]["collapse_threshold"] == 1e-8 and got[1]["collapsed_pairs"] == 0
    rows = spark.createDataFrame([(1.0, 5.0), (float("nan"), 7.0), (3.0, None)], "fpc double, xie_beni double")
    s = {r["metric"]: (r["mean"], r["worst"]) for r in metrics.summary(rows, ["fpc", "xie_beni"]).collect()}
    assert s == {"fpc": (2.0, 1.0), "xie_beni": (6.0, 7.0)}


def test_analysis(spark):
    r = np.random.default_rng(2)
    rows = []
    for d in ("wine", "mnist784_pca32 (20c)"):
        for seed in range(20):
            for method, cell, steps, off, gain in (("cells", "pre_mass_off", 5, 0, 0.3), ("cells", "post_none_off", 5, 0, 0.0), ("cells", "post_footprint_on", 1, 1, 0.0), ("cells", "pre_mass_off", 1, 0, 0.2), ("scffcm", None, 50, 0, 0.0)):
                acc = float(r.normal(gain, 0.01))
                rows.append((d, seed, method, cell, steps, 50, 1.0, 0.0, off, acc, -acc, 0))
            rows.append((d, seed, "cells", "pre_mass_off", 5, 50, 0.5, 0.0, 0, 9.0, 9.0, 0))
            rows.append((d, seed, "cells", "pre_mass_off", 5, 50, 1.0, 0.0, 0, 9.0, 9.0, 1))
    df = spark.createDataFrame(rows, "dataset string, seed int, method string, cell string, L int, rounds int, participation double, split double, no_earlystop int, mean_acc double, fcm_obj double, file_no int")
    named = analysis.arms(df)
    assert {x["arm"] for x in named.select("arm").distinct().collect()} == {"L5:pre_mass_off", "L5:post_none_off", "L1noES:post_footprint_on", "L1:pre_mass_off", "SC:L50"}
    assert named.count() == 200 and named.agg(F.max("mean_acc")).first()[0] < 1
    out = analysis.analyze(df, ["s00-09"], ["wine", "mnist784_pca32 (20c)"], metrics=("mean_acc",))
    s = {x["hyp"]: x for x in out["summary"].collect()}
    assert (s["H2"]["better_unadj"], s["H2"]["better_holm"], s["H2"]["replicates"]) == (2, 2, True)
    assert (s["H5"]["n_tested"], s["S-L50"]["family"], s["S-L50"]["better_holm"], s["H9"]["replicates"]) == (2, 1, 1, True)
    assert s["H1"]["n_tested"] == 0 and s["H1"]["replicates"] is False
    tests = {(x["hyp"], x["dataset"]): x for x in out["tests"].collect()}
    first = min(x["p_exact"] for (h, _), x in tests.items() if h in {f"H{i}" for i in range(1, 9)})
    assert tests["H2", "wine"]["p_holm_all"] == pytest.approx(min(1.0, 16 * first)) and tests["H9", "wine"]["p_holm_all"] is None
    assert "H2 mean_acc: 2 of 2: 2/0" in analysis.report(out)
    with pytest.raises(ValueError):
        analysis.analyze(df, ["s20-29"])
    changed = hypotheses.summarize_tests(out["tests"].withColumn("p_legacy", F.lit(0.9)), [*analysis.PRIMARY, *analysis.SECONDARY])
    assert {(x["hyp"], x["count"], x["legacy"], x["exact"]) for x in analysis.count_changes(changed).collect()} >= {("H2", "better", 0, 2)}


def test_held_out_analysis(spark):
    rows = [("wine", s, "cells", f"{g}_{on}", 0.2, 1.0, 5 if s else 9, 0.5 + (on == "on") * (0.1 + 0.01 * s)) for s in range(8) for g in ("post_footprint", "pre_mass") for on in ("on", "off")]
    df = spark.createDataFrame(rows, "dataset string, seed int, method string, cell string, split double, participation double, min_client_n_test int, v double")
    df = df.withColumns({m: F.col("v") for m in analysis.HELD_OUT_METRICS})
    got = {(r["hyp"], r["metric"]): r for r in analysis.held_out_tests(df, ["wine"]).collect()}
    assert got["EC-GF", "test_gacc"]["unreliable"] and not got["EC-GF", "gacc"]["unreliable"] and not got["EC-GF", "test_fcm_obj"]["unreliable"]
    assert got["EC-GF", "test_gacc"]["direction"] == "a" and got["EC-GF", "fcm_obj"]["direction"] == "b" and got["EC-PREMASS", "gacc"]["p_exact"] == pytest.approx(2 / 2**8)


def test_calibrated_steps_of_other_rounds_are_refused(spark):
    df = spark.createDataFrame([("wine", 5, "250", "1", "2")], "dataset string, L int, rounds string, eta_l string, eta_g string")
    assert analysis.steps_of(df, 5, 250).first()["eta_g"] == 2.0 and analysis.steps_of(df, 1).count() == 0
    with pytest.raises(Exception, match="other rounds"):
        analysis.steps_of(df, 5).collect()


def test_readers_and_reports(spark, tmp_path):
    (tmp_path / "a.log").write_text("x 1\ninteraction: -1.5 and 2e-3, .5\ninteraction none\n")
    got = relation.read_log(spark, str(tmp_path / "a.log"), "interaction").collect()
    assert sorted(r["value"] for r in got) == [-1.5, 0.002, 0.5] and got[0]["file"] == "a.log"
    (tmp_path / "jobs").mkdir()
    (tmp_path / "jobs" / "1.json").write_text(json.dumps({"rule": "pre", "J0": 1.5}) + "\n")
    assert relation.read_cache(spark, str(tmp_path / "jobs"), "rule string, J0 double").first()["J0"] == 1.5
    relation.write_report(spark, str(tmp_path / "report"), "line one\nline two")
    assert spark.read.text(str(tmp_path / "report")).count() == 2
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        relation.write_report(spark, str(tmp_path / "report"), "again")


def test_tables_as_data_sets(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(200, 3))
    df = spark.createDataFrame([([float(v) for v in a[:2]], float(a[2]), "abc"[i % 3]) for i, a in enumerate(x)], "v array<double>, w double, kind string")
    df.write.parquet(f"{tmp_path}/t.parquet")
    load = experiments.table_loader(spark, {"wine": (f"{tmp_path}/t.parquet", ["v", "w"], "kind")})
    a, b = load("wine"), load("wine")
    assert a[0].shape == (200, 3) and set(a[1]) == {0, 1, 2} and (a[0] == b[0]).all()
    rows = experiments.cell_rows({"dataset": "wine", "seed": 0, "cells": ["pre_none_off"], "rounds": 2, "steps": 1, "split": 0.2}, load)
    assert 0 <= rows[0]["test_gacc_trmap"] <= 1
    view = experiments.setting_rows({"dataset": "wine", "seed": 0, "cells": ["pre_none_off"], "rounds": 2, "steps": 1, "components": 2, "whiten": True}, load)
    assert view[0]["components"] == 2 and view[0]["fcm_obj"] > 0
    with pytest.raises(ValueError):
        experiments.table_loader(spark, {"wine": (f"{tmp_path}/t.parquet", ["w"], "kind")}, most=10)("wine")


def test_held_out_numbers_from_one_relation():
    train, test = clients(3, 40), clients(3, 12, seed=9)
    own = [x[:3] for x, _ in train]
    got = experiments.evaluate_held_out(train, test, own, 2.0)
    accs = []
    for (x, y), (tx, ty), v in zip(train, test, own, strict=True):
        names = experiments.label_map(y, experiments.labels_of(x, v, 2.0))
        accs.append(experiments.mapped_accuracy(names, ty, experiments.labels_of(tx, v, 2.0)))
    assert got["test_mean_acc_trmap"] == pytest.approx(np.mean(accs)) and got["test_worst_acc_trmap"] == min(accs)
    assert got["test_mean_acc_refit"] >= got["test_worst_acc_refit"] and got["test_fcm_obj"] > 0
    assert all(np.isnan(v) for v in experiments.evaluate_held_out(train, test, [np.full((3, 3), np.nan)] * 3, 2.0).values())


def test_descent_log_and_order():
    rows = experiments.descent_rows({"dataset": "overlap_noise", "seed": 0, "cell": "pre_none", "steps": 1, "rounds": 6})[0]
    assert rows["objective_last"] < rows["objective_first"] and rows["n_increases"] == 0 and rows["first_increase"] == -1
    tasks = [{"n": 1}, {"n": 5}, {"n": 3}, {"n": 5, "b": 1}]
    assert experiments.by_cost(tasks, lambda t: t["n"]) == [{"n": 5}, {"n": 5, "b": 1}, {"n": 3}, {"n": 1}]


def test_posthoc_variants(spark):
    rows = posthoc.step_rows({"action": "pre_mass_off (L=1)", "dataset": "overlap_noise", "rounds": 5})
    assert [r["step"] for r in rows] == list(posthoc.STEPS) and all(r["objective"] > 0 for r in rows)
    grid = spark.createDataFrame([("a", "d", 0, 0.25, 5.0, 4.0), ("a", "d", 1, 1.0, 4.1, 4.0), ("b", "d", 0, 0.25, float("nan"), 4.0)], "action string, dataset string, grid_idx int, step double, objective double, central double")
    assert {(r["action"], r["step"]) for r in posthoc.chosen(grid).collect()} == {("a", 1.0), ("b", 0.75)}
    u = posthoc.run_tasks("U", ["wine"], [10, 11])
    assert len(u) == 8 and all("GF" not in t["action"] for t in u)
    assert posthoc.run_tasks("C", ["wine"], [10], {("F-FCM (L=5)", "wine"): 0.5, ("GF-PFedFCM (L=5)", "wine"): 0.75}) == [{"variant": "C", "action": "F-FCM (L=5)", "dataset": "wine", "seed": 10, "step": 0.5}]
    run = posthoc.run_rows({"variant": "U", "action": "F-FCM (L=5)", "dataset": "overlap_noise", "seed": 10, "step": 0.75, "rounds": 4})[0]
    assert run["n_rounds"] <= 4 and run["cell"] == "post_none_off" and run["upload_numbers"] == run["n_rounds"] * 12 * 4 * 3


def test_views_and_geometry():
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(c, 0.2, (60, 4)) for c in (0, 3, 6)])
    y = np.repeat([0, 1, 2], 60)
    rows = experiments.whitening_rows({"dataset": "wine", "seed": 0, "components": 2, "m": 2.0}, lambda name: (x, y))
    assert [(a["variant"], a["d"], a["c"]) for a in rows] == [("whitened", 2, 3), ("components", 2, 3), ("scores", 4, 3)] and rows[2]["distinct"] == 3
    got = experiments.geometry([(x[:90], y[:90]), (x[90:], y[90:])], block=50)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))[np.triu_indices(len(x), 1)]
    assert got["pdist_mean"] == pytest.approx(d.mean()) and got["pdist_std"] == pytest.approx(d.std()) and 1 <= got["prank_pooled"] <= 4
