"""Clustering operators against hand-derived values, identities and plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fogmeans.functions import numeric
from fogmeans.operators import gates, kernel, metrics, relation, statistics
from fogmeans.plans import rounds as fed
from fogmeans.sources import points as pts

X = np.array([[0, 0], [1, 0], [0, 2], [3, 3]], float)
V = np.array([[0, 0], [2, 2]], float)


@pytest.fixture(scope="module")
def four(spark):
    return spark.createDataFrame([(i % 2, i, x.tolist(), i // 2) for i, x in enumerate(X)], "client int, row_id long, x array<double>, y int")


def test_toy_memberships_and_validity(spark, four):
    c = kernel.centers_frame(spark, V)
    rows = kernel.memberships(four, c)
    u = np.array([r["u"] for r in rows.orderBy("row_id").collect()])
    assert np.allclose(u, [[1, 0], [5 / 6, 1 / 6], [0.5, 0.5], [0.1, 0.9]])
    assert np.allclose(u, fed.fuzzy(fed.square_distances(X, V), 2.0))
    assert metrics.xie_beni(four, c).head()["xb"] == pytest.approx(0.144791667)
    assert metrics.validity(rows).head()["hnorm"] == pytest.approx(0.529754504)
    with pytest.raises(ValueError):
        kernel.membership(F.col("d2"), 1.0)


def test_coincident_centres_share_equally(spark, four):
    c = kernel.centers_frame(spark, np.array([[0, 0], [0, 0], [2, 2]], float))
    u = kernel.memberships(four, c).orderBy("row_id").head()["u"]
    assert u == [0.5, 0.5, 0.0]
    assert kernel.hard_labels(four, c).orderBy("row_id").head()["pred"] == 0
    assert metrics.xie_beni(four, c).head()["xb"] == math.inf
    assert metrics.distinct_prototypes(c) == 2


def test_backends_agree(spark):
    clients = [x for x, _ in pts.synthetic("dirichlet_0.3", 3, 60, 1)]
    points = pts.to_points(spark, [(x, np.zeros(len(x))) for x in clients])
    a, b = fed.LocalBackend(clients), fed.SparkBackend(points)
    v0 = np.array(pts.CENTERS[:3])
    for f in (
        lambda k: fed.run_cell(k, v0, "pre", "mass", True, 2, 1).centers,
        lambda k: fed.run_cell(k, v0, "post", "footprint", False, 2, 2).centers,
        lambda k: fed.gradient(k, v0, 0.001, rounds=2, steps=1).centers,
        lambda k: fed.variates(k, v0, 0.05, 1.0, rounds=2, steps=2, fraction=0.7, seed=1).centers,
    ):
        assert np.allclose(f(a), f(b), atol=1e-9)


def test_two_blob_counter_example():
    rng = np.random.default_rng(1)
    blobs = [rng.normal((0, 0), 0.3, (40, 2)), rng.normal((4, 4), 0.3, (40, 2))]
    back = fed.LocalBackend(blobs)
    star = fed.fcm(back, np.array([[0.0, 0], [4, 4]]), tol=1e-13, most=400).centers
    cost = lambda v: sum(back.beta[p] * s.objective for p, s in back.sums(dict.fromkeys([0, 1], v), 2.0).items())
    j = [cost(fed.run_cell(back, star, "pre", "none", rounds=1, steps=n).centers) - cost(star) for n in (1, 2, 5)]
    assert j[0] == pytest.approx(0, abs=1e-9) and 0 < j[1] < j[2]


def test_identities():
    clients = [x for x, _ in pts.synthetic("iid", 4, 50, 2)]
    back = fed.LocalBackend(clients)
    v0 = np.array(pts.CENTERS)
    nova = fed.normalized(back, v0, rounds=1, steps=3).centers
    c, pre, post = fed.local_steps(back, dict.fromkeys(back.clients, v0), 3, 2.0)
    assert np.allclose(nova, sum(back.beta[p] * c[p] for p in c))
    assert np.array_equal(fed.run_cell(back, v0, fraction=1.0, rounds=3).centers, fed.run_cell(back, v0, rounds=3).centers)
    assert np.array_equal(fed.run_cell(back, v0, fraction=0.5, seed=4, rounds=3).centers, fed.run_cell(back, v0, fraction=0.5, seed=4, rounds=3).centers)
    one = fed.fcm(back, v0, most=1).centers
    s = fed.sums_of(np.vstack(clients), v0, 2.0)
    assert np.allclose(one, s.means(v0))
    h = fed.fcm(back, v0, most=20).history
    assert all(a >= b - 1e-9 for a, b in itertools.pairwise(h))
    g = fed.gate_values(back, v0, "massmask", 2.0, back.clients)
    assert set(np.concatenate(list(g.values()))) <= {0.05, 1.0}
    models, pick = fed.clustered(back, [v0, v0 + 9], rounds=2, steps=1)
    assert set(pick.values()) == {0}
    assert fed.pooled_means(back, v0, rounds=2, steps=1).centers.shape == (4, 2)
    assert fed.model_averaging(back, v0, most=20).rounds == 3


def test_footprint_forms_agree(spark):
    clients = [x for x, _ in pts.synthetic("overlap_noise", 2, 80, 3)]
    points = pts.to_points(spark, [(x, np.zeros(len(x))) for x in clients])
    v = np.array(pts.CENTERS)
    for r in gates.footprint(points, kernel.centers_frame(spark, v)).collect():
        assert r["footprint"] == pytest.approx(fed.footprint_of(clients[r["client"]], v, 2.0)[r["j"]])


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for n in range(1, 7):
        for _ in range(20):
            c = rng.integers(0, 9, (n, n)).astype(float)
            got = numeric.best_assignment(c)
            assert sorted(got) == list(range(n))
            assert c[range(n), got].sum() == min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))


def test_statistics_by_enumeration(spark):
    assert numeric.signed_rank(range(1, 11))[1] == pytest.approx(1 / 512)
    assert numeric.holm([0.01, 0.04, 0.03, 0.005]) == pytest.approx([0.03, 0.06, 0.06, 0.02])
    assert numeric.t_quantile(0.975, 4) == pytest.approx(2.7764451, abs=1e-6)
    assert numeric.t_quantile(0.975, 1) == pytest.approx(12.7062047, abs=1e-5)
    rng = np.random.default_rng(1)
    for _ in range(40):
        d = np.round(rng.normal(size=rng.integers(1, 9)), 1)
        nz = d[np.abs(d) > 1e-12]
        r = numeric.mid_ranks(np.abs(nz))
        w = r[nz > 0].sum()
        every = np.array([sum(x for x, s in zip(r, signs) if s) for signs in itertools.product((0, 1), repeat=len(r))])
        want = min(1.0, 2 * min((every <= w).mean(), (every >= w).mean())) if len(nz) else 1.0
        assert numeric.signed_rank(d)[1] == pytest.approx(want)
    tests = spark.createDataFrame(list(zip("abcd", [0.01, 0.04, 0.03, 0.005])), "dataset string, p double")
    assert [r["p_holm"] for r in statistics.holm(tests).orderBy("dataset").collect()] == pytest.approx([0.03, 0.06, 0.06, 0.02])


def test_accuracy_by_permutations(spark):
    rng = np.random.default_rng(2)
    y, p = rng.integers(0, 3, 60), rng.integers(0, 4, 60)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(y, p)], "y int, pred int")
    want = max(np.mean([perm[b] == a for a, b in zip(y, p)]) for perm in itertools.permutations(range(4)))
    assert metrics.accuracy(df).head()["acc"] == pytest.approx(want)


def test_partitions(spark):
    y = np.repeat(np.arange(3), 100)
    m = pts.dirichlet_map(y, 4, 0.5, 1)
    assert len(m) == 300 and np.bincount(m, minlength=4).min() >= 5
    with pytest.raises(RuntimeError):
        pts.dirichlet_map(y, 400, 0.1, 1)
    df = spark.createDataFrame([(i, 0, [float(i)], int(v)) for i, v in enumerate(y)], "row_id long, client int, x array<double>, y int")
    s = pts.support_skew(df, 5, 2).groupBy("client").agg(F.countDistinct("y").alias("k")).collect()
    assert {r["client"] for r in s} == set(range(5)) and max(r["k"] for r in s) <= 2
    w = pts.pca_whitened(spark.createDataFrame([(i, 0, [float(i), float(i * i % 7), 1.0 * (i % 3)], 0) for i in range(50)], "row_id long, client int, x array<double>, y int"), 2)
    z = np.array([r["x"] for r in w.select("x").collect()])
    assert np.allclose(np.cov(z.T), np.eye(2), atol=1e-8)


def test_relation(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0, 1.0), ("a", 1, 1, float("nan")), ("b", 1, 0, 2.0)], "dataset string, seed int, arm int, value double")
    d = relation.contrast(rows, {0: 1.0, 1: -1.0}).collect()
    assert len(d) == 1 and math.isnan(d[0]["diff"])
    assert relation.substituted(rows).where("arm = 1").head()["value"] == 1.0
    relation.write_results(rows, f"{tmp_path}/r", ["arm"])
    back = relation.read_results(spark, f"{tmp_path}/r", schema="arm int, dataset string, seed int, value double")
    assert back.count() == 3 and relation.compare(back, rows, ["dataset", "seed", "arm"], ["value"]).where("not match").count() == 0
    with pytest.raises(Exception):
        relation.write_results(rows, f"{tmp_path}/r")
