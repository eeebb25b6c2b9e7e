"""Sources, sweeps, hypothesis tests and round diagnostics against plain versions and identities."""

import itertools
import math

import numpy as np
import pytest

from fogmeans import config
from fogmeans.functions import numeric
from fogmeans.operators import diagnostics, hypotheses, kernel
from fogmeans.plans import experiments
from fogmeans.plans import rounds as fed
from fogmeans.sources import points as pts


def test_synthetic_sizes_and_shares():
    sizes = [len(y) for _, y in pts.synthetic("quantity_skew_extreme", 12, 220, 1)]
    g = np.geomspace(0.05, 8, 12)
    assert sizes == [max(20, round(220 * t / g.mean())) for t in g.tolist()]
    for scenario, expected in (("cluster_skew_hard", 2), ("cluster_skew_overlap", 2), ("cluster_skew", 2)):
        assert max(len(np.unique(y)) for _, y in pts.synthetic(scenario, 8, 100, 3)) <= expected
    private = pts.synthetic("private_cluster", 8, 200, 0)
    assert [bool((y == 3).any()) for _, y in private] == [True, True, *[False] * 6]
    minority = pts.synthetic("minority_private_cluster", 8, 200, 0)
    assert [c for c, (_, y) in enumerate(minority) if (y == 3).any()] == [0, 4]
    x, y = pts.synthetic("overlap_noise_hard", 1, 4000, 5)[0]
    far = np.linalg.norm(x - np.array(pts.NOISY_CENTERS)[y], axis=1) > 6
    assert 0.02 < far.mean() < 0.14
    assert all(np.array_equal(a[0], b[0]) for a, b in zip(pts.synthetic("iid", 3, 30, 9), pts.synthetic("iid", 3, 30, 9)))
    with pytest.raises(ValueError):
        pts.synthetic("unknown")


def test_seeded_splits():
    y = np.repeat(np.arange(4), 50)
    owner = pts.support_map(y, 5, 2, 1)
    assert all(len(np.unique(y[owner == c])) <= 2 for c in range(5)) and np.bincount(owner).min() >= 5
    with pytest.raises(RuntimeError):
        pts.support_map(y[:10], 5, 2, 1)
    masks = pts.split_positions([1, 2, 10, 13], 7)
    assert [int(m.sum()) for m in masks] == [0, 1, 2, 3]
    v = pts.sampled_centers(np.arange(20.0).reshape(10, 2), 4, 0)
    assert len(np.unique(v, axis=0)) == 4
    with pytest.raises(ValueError):
        pts.sampled_centers(v, 5, 0)


def test_names():
    assert len(config.parse_cells()) == 16 and config.parse_cells("GF, pre_mass_off,GF") == ["post_footprint_on", "pre_mass_off"]
    assert len(config.parse_datasets("nonmnist")) == 12 and config.parse_datasets("mnist50,wine") == ["mnist784_pca32 (50c)", "wine"]
    for wrong in (lambda: config.parse_cells("pre_mass"), lambda: config.parse_datasets("iris"), lambda: config.checked_seeds(18, 4)):
        with pytest.raises(ValueError):
            wrong()
    assert config.checked_seeds(18, 4, fresh=True) == [18, 19, 20, 21]
    assert experiments.uploaded("cells", 3, 2, 4, 5) == 144 and experiments.uploaded("scffcm", 3, 2, 4, 5) == 240 and experiments.uploaded("cells", -1, 2, 4, 5) == -1


def test_label_maps_are_accuracy():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, a, b = rng.integers(1, 30), rng.integers(1, 5), rng.integers(1, 5)
        y, p = rng.integers(0, a, n), rng.integers(0, b, n)
        k = max(a, b)
        want = max(np.mean([q[t] == s for s, t in zip(y, p)]) for q in itertools.permutations(range(k)))
        assert experiments.accuracy(y, p) == pytest.approx(want)
    one = [(np.array([[0.0, 0.0]]), np.array([1]))]
    train = [(np.array([[0.0, 0.0], [0.1, 0], [5, 5]]), np.array([0, 0, 1]))]
    v = np.array([[0.0, 0], [5, 5]])
    h = experiments.evaluate_held_out(train, one, [v], 2.0)
    assert h["test_mean_acc_refit"] == 1.0 and h["test_mean_acc_trmap"] == 0.0
    assert all(math.isnan(x) for x in experiments.evaluate(train, v * math.nan, [v], 2.0).values())


def test_bundle_of_the_toy():
    x, v = np.array([[0, 0], [1, 0], [0, 2], [3, 3]], float), np.array([[0, 0], [2, 2]], float)
    e = experiments.evaluate([(x, np.array([0, 0, 1, 1]))], v, [v], 2.0)
    assert e["xb"] == pytest.approx(0.144791667) and e["hnorm"] == pytest.approx(0.529754504) and e["min_dist"] == pytest.approx(math.sqrt(8))
    assert experiments.distinct_count(np.array([[0, 0], [0.0009, 0], [0.0018, 0], [1, 1]])) == 2


def test_common_signed_rank():
    rng = np.random.default_rng(3)
    for n in range(2, 9):
        d = rng.normal(size=n)
        r = numeric.mid_ranks(np.abs(d))
        every = np.array([sum(x for x, s in zip(r, signs) if s) for signs in itertools.product((0, 1), repeat=n)])
        assert numeric.signed_rank_auto(d, greater=True) == pytest.approx((every >= r[d > 0].sum()).mean())
        assert numeric.signed_rank_auto(d) == pytest.approx(numeric.signed_rank(d)[1])
    assert math.isnan(numeric.signed_rank_auto([0.0, 0.0]))
    assert 0 < numeric.signed_rank_auto([1, 1, 2, 3, -1, 4]) < 1
    assert numeric.t_interval([1.0, 3.0, math.nan])[0] == 2.0
    assert numeric.signed_rank([1.0, 2.0, -math.inf])[1] == numeric.signed_rank([1.0, 2.0, -9.0])[1]


def test_hypotheses(spark):
    rows = [("d", s, arm, v) for s in range(6) for arm, v in (("a", 1.0 + s / 10), ("b", 0.5))] + [("d", 6, "a", math.nan), ("d", 6, "b", 0.5), ("d", 7, "a", 1.0), ("e", 0, "a", None), ("e", 0, "b", 1.0)]
    df = spark.createDataFrame(rows, "dataset string, seed int, arm string, mean_acc double")
    hyps = [hypotheses.pair("h", "a", "b", "a")]
    t = {r["dataset"]: r for r in hypotheses.run_tests(df, hyps, "mean_acc", {"h": ["d", "e"]}).collect()}
    assert (t["d"]["n"], t["d"]["n_nan"], t["d"]["n_eff"], t["d"]["direction"]) == (7, 1, 6, "a")
    assert t["d"]["p_exact"] == pytest.approx(2 / 64) and t["d"]["p_holm"] == pytest.approx(4 / 64)
    assert t["d"]["p_exact_nanloss"] == pytest.approx(numeric.signed_rank([0.5, 0.6, 0.7, 0.8, 0.9, 1.0, -math.inf])[1])
    assert t["e"]["status"] == "no data" and t["e"]["p_exact"] == 1.0
    s = hypotheses.summarize_tests(hypotheses.run_tests(df, hyps, "mean_acc", {"h": ["d"]}), hyps).head()
    assert s["better_unadj"] == 1 and s["better_holm"] == 1 and s["better_holm_nanloss"] == 0 and s["replicates"]
    lower = hypotheses.run_tests(df.withColumnRenamed("mean_acc", "fcm_obj"), hyps, "fcm_obj", {"h": ["d"]}).head()
    assert lower["direction"] == "b" and lower["mean_diff"] > 0 > lower["mean_oriented"]


def test_decisions(spark):
    rows = [("s", 0, "a", 1.0, 10), ("s", 0, "b", math.nan, -1), ("s", 0, "c", 0.4, 30), ("s", 1, "a", 1.0, 10), ("s", 1, "b", 0.9, 5)]
    df = spark.createDataFrame(rows, "dataset string, seed int, arm string, mean_acc double, upload_numbers long")
    states = hypotheses.decision_states(df, {"A": "a", "B": "b", "C": "c"}, ["mean_acc", "upload_numbers"])
    got = {(r["criterion"], r["action"]): r for r in states.collect()}
    assert got["mean_acc", "B"]["value"] == 0.4 and got["mean_acc", "B"]["n_substituted"] == 1 and got["mean_acc", "B"]["regret"] == pytest.approx(0.6)
    assert got["upload_numbers", "B"]["value"] == 30 and got["upload_numbers", "C"]["regret"] == pytest.approx(2.0)
    best = {(r["criterion"], r["action"]) for r in hypotheses.decisions(states).where("rec_mean and rec_max").collect()}
    assert best == {("mean_acc", "A"), ("upload_numbers", "A")}


def test_round_state_against_plain(spark):
    clients = [x for x, _ in pts.synthetic("dirichlet_0.3", 3, 60, 1)]
    points = pts.to_points(spark, [(x, np.zeros(len(x))) for x in clients])
    v, back = np.array(pts.CENTERS), fed.LocalBackend(clients)
    c, pre, post = fed.local_steps(back, dict.fromkeys(back.clients, v), 1, 2.0)
    state = diagnostics.round_state(points, kernel.centers_frame(spark, v)).cache()
    q, r = (fed.gate_values(back, v, kind, 2.0, back.clients) for kind in ("mass", "footprint"))
    for s in state.collect():
        p, j = s["client"], s["j"]
        assert np.allclose([s["pre"], s["post"], s["q"], s["r"]], [pre[p][j], post[p][j], q[p][j], r[p][j]]) and np.allclose(s["c"], c[p][j])
    for s in diagnostics.tilt(state).collect():
        assert 0 <= s["share_q_u"] <= 1 and s["cv"] >= 0
    m = kernel.moments(points, "client").orderBy("client").collect()
    for s, x in zip(m, clients):
        assert np.allclose(s["mean"], x.mean(axis=0)) and np.allclose(s["cov"], np.cov(x.T)[np.tril_indices(2)])
    ranks = diagnostics.covariance_ranks(points).head()
    e = np.linalg.eigvalsh(np.cov(np.vstack(clients).T))
    assert ranks["participation"] == pytest.approx(e.sum() ** 2 / (e * e).sum())
    assert ranks["effective_rank"] == pytest.approx(math.exp(-sum(t * math.log(t) for t in e / e.sum())))


def test_sweeps(spark):
    task = {"dataset": "overlap_noise", "seed": 0, "cells": ["pre_none_off"], "rounds": 3}
    got = experiments.sweep(spark, [task, task], experiments.cell_rows, experiments.CELL_SCHEMA).collect()
    want = experiments.cell_rows(task)[0]
    assert [r["task_no"] for r in sorted(got)] == [0, 1] and all(r["gacc"] == pytest.approx(want["gacc"]) and r["upload_numbers"] == 3 * 12 * 12 for r in got)
    real = experiments.cell_rows({"dataset": "wine", "seed": 0, "cells": ["post_footprint_on"], "rounds": 2, "split": 0.2}, lambda name: (np.random.default_rng(0).normal(size=(178, 13)), np.arange(178) % 3))[0]
    assert real["n_clients"] == 10 and 0 <= real["test_gacc"] <= 1
    with pytest.raises(KeyError):
        experiments.build_clients("nowhere", 0)
    lost = experiments.rule_rows({"rule": "pedrycz", "dataset": "overlap_noise", "seed": 0})[0]
    assert lost["upload_numbers"] == -1 and math.isnan(lost["gacc"])
    a = experiments.audit_rows({"dataset": "overlap_noise", "seed": 0, "m": 2.0, "iterations": 5, "restarts": 2})
    assert [r["init"] for r in a] == ["paper", "kmeanspp_best10", "oracle", "fed_lossless_pre1"] and a[3]["gap"] < 1e-9
    audit = spark.createDataFrame([("d", "paper", 2.0, 3, 4), ("d", "paper", 1.5, 4, 4), ("d", "paper", 1.1, 4, 4), ("d", "x", 2.0, 1, 4)], "dataset string, init string, m double, distinct int, c int")
    assert {r["init"]: r["m_star"] for r in hypotheses.largest_distinct(audit).collect()} == {"paper": 1.5, "x": None}
    edges = spark.createDataFrame([(0.1,), (0.2,), (0.5,)], "s double").select(hypotheses.edge_label("s", [0.1, 0.2, 0.5]).alias("e"), hypotheses.edge_label("s", [0.1]).alias("f")).collect()
    assert [tuple(r) for r in edges] == [("low", "single"), ("interior", "single"), ("high", "single")]
