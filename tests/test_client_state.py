"""Client states as tables against the driver loops, metrics under own prototypes, trajectories, ranks, matchings."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fogmeans.functions.numeric import first_matching
from fogmeans.operators import diagnostics, kernel, metrics, personal, ranks, trajectory
from fogmeans.plans import clientstate as cs
from fogmeans.plans import experiments
from fogmeans.plans import rounds as fed

SIZES = (260, 90, 7, 40, 1)


@pytest.fixture(scope="module")
def clients():
    rng = np.random.default_rng(8)
    return [(rng.normal(size=(n, 3)) + 2 * rng.integers(0, 3, n)[:, None], rng.integers(0, 4, n)) for n in SIZES]


@pytest.fixture(scope="module")
def points(spark, clients):
    rows = [(c, 1000 * c + i, x.tolist(), int(y)) for c, (a, b) in enumerate(clients) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    return spark.createDataFrame(rows, "client int, row_id long, x array<double>, y int").repartition(5).persist()


@pytest.fixture(scope="module")
def v0(clients):
    return clients[0][0][:3].copy()


def own_sets(run):
    return {r["client"]: np.array([c["v"] for c in r["cs"]]) for r in run.personal().collect()}


@pytest.mark.parametrize("most_values", [cs.MOST_VALUES, 200, 1])
def test_state_tables_are_the_loops(points, clients, v0, most_values):
    """All clients in tasks, the large ones beside, and every client beside."""
    back = fed.LocalBackend([x for x, _ in clients])
    store = cs.ClientStore(points, most_values=most_values)
    assert len(store.bulk) == {cs.MOST_VALUES: 0, 200: 2, 1: 4}[most_values]  # one row is always within bounds
    for gate in fed.GATES:
        for on in (False, True):
            got = cs.run(store, cs.Cell("pre", gate, on, 2), v0, 3)
            want = fed.run_cell(back, v0, "pre", gate, on, 3, 2)
            assert np.allclose(got.centers, want.centers, atol=1e-9)
            if on:
                assert all(np.allclose(v, want.personal[c], atol=1e-9) for c, v in own_sets(got).items())
        if most_values != cs.MOST_VALUES:
            break
    got, want = cs.run(store, cs.Tracks(2, prox=0.2, ditto=0.1), v0, 3), fed.federated(back, v0, rounds=3, steps=2, lr=0.75, prox=0.2, ditto=0.1)
    assert np.allclose(got.centers, want.centers) and all(np.allclose(v, want.personal[c]) for c, v in own_sets(got).items())
    got, want = cs.run(store, cs.Variates(steps=2), v0, 4, fraction=0.4, seed=2), fed.variates(back, v0, 0.05, 1.0, rounds=4, steps=2, fraction=0.4, seed=2)
    assert np.allclose(got.centers, want.centers)
    wild = cs.run(store, cs.Variates(1e200, 1e200, 2), v0, 6)
    assert wild.error == "diverged" and wild.rounds < 6
    store.close()


def test_a_round_has_no_shuffle_of_points_and_few_jobs(spark, points, v0):
    store = cs.ClientStore(points)
    states = store.states(v0)
    plan = cs.round_plan(store, states, cs.Cell(), v0, v0 * 0, None)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Exchange" not in plan
    for t in (store.points, states):  # a file a bucket
        assert t.select(F.input_file_name()).distinct().count() <= store.buckets
    jobs = []
    for steps in (1, 6):
        spark.sparkContext.setJobGroup(f"steps-{steps}", "")
        cs.run(store, cs.Cell("post", "none", True, steps), v0, 2, tol=None)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"steps-{steps}")))
    assert jobs[0] == jobs[1]
    store.close()


def test_ten_thousand_clients(spark):
    p = spark.range(30_000).select((F.col("id") % 10_000).cast("int").alias("client"), F.col("id").alias("row_id"), F.array(F.sin("id"), F.cos(F.col("id") * 3)).alias("x")).persist()
    v0 = np.array([[0.0, 0.0], [0.5, 0.5]])
    store = cs.ClientStore(p)
    assert store.n_clients == 10_000 and store.clients.agg(F.count_distinct("place"), F.max("place")).head() == (10_000, 9_999)
    got, want = cs.run(store, cs.Cell("post", "none", True, 1), v0, 2), fed.run_cell(fed.SparkBackend(p), v0, "post", "none", True, 2, 1)
    assert np.allclose(got.centers, want.centers)
    own = own_sets(got)
    assert len(own) == 10_000 and all(np.allclose(own[c], want.personal[c]) for c in range(0, 10_000, 997))
    store.close()


def test_odd_stores(spark, points, v0):
    odd = points.union(spark.createDataFrame([(None, 1, [1.0, 1.0, 1.0], 0), (2, 5, None, 0)], points.schema))
    a, b = cs.ClientStore(odd), cs.ClientStore(points)
    assert np.allclose(cs.run(a, cs.Cell("pre", "mass", True, 1), v0, 2).centers, cs.run(b, cs.Cell("pre", "mass", True, 1), v0, 2).centers)
    none = cs.ClientStore(points.limit(0))
    run = cs.run(none, cs.Cell(), v0, 3)
    assert run.rounds == 0 and np.array_equal(run.centers, v0) and run.personal().count() == 0
    with pytest.raises(ValueError):
        list(cs.Cell("post", "odd").program(v0, v0, v0, 1.0))
    for s in (a, b, none):
        s.close()


def test_bundle_and_held_out_numbers(spark, points, clients, v0):
    rng = np.random.default_rng(1)
    sets = [v0 + rng.normal(size=v0.shape) for _ in SIZES]
    own = spark.createDataFrame([(c, [(j, t.tolist()) for j, t in enumerate(s)]) for c, s in enumerate(sets)], "client int, cs array<struct<j: int, v: array<double>>>")
    for m in (2.0, 1.4):
        got = personal.bundle(points, own, kernel.centers_frame(spark, v0), m).head().asDict()
        assert got == pytest.approx(experiments.evaluate(clients, v0, sets, m))
    broken = spark.createDataFrame([(0, [(0, [math.nan, 0.0, 0.0])])], own.schema)
    assert all(math.isnan(v) for v in personal.bundle(points, broken, kernel.centers_frame(spark, v0)).head())
    sums = {(r["client"], r["j"]): r for r in personal.own_sums(points, own, 3).collect()}
    for c, (x, _) in enumerate(clients):
        s = fed.sums_of(x, sets[c], 2.0)
        for j in range(3):
            assert sums[c, j]["mass"] == pytest.approx(s.mass[j]) and np.allclose(sums[c, j]["s"], s.weighted[j]) and sums[c, j]["n"] == len(x)
    # held out: every third row; a client of one row has no train row, so all its clusters are unnamed
    test = [np.arange(len(y)) % 3 == 0 for _, y in clients]
    rows = personal.assigned(points, own).withColumn("test", F.col("row_id") % 1000 % 3 == 0)
    got = personal.held_out(rows).head().asDict()

    def agreed(a, b):
        t = pd.crosstab(pd.Series(a[1]), pd.Series(a[0])) if len(a[0]) else pd.DataFrame()
        names = {t.index[i]: t.columns[j] for i, j in enumerate(first_matching(t.to_numpy())) if j >= 0} if t.size else {}
        return float(np.mean([names.get(p) == y for y, p in zip(*b, strict=True)]))

    pred = [experiments.labels_of(x, v, 2.0) for (x, _), v in zip(clients, sets, strict=True)]
    parts = [((y[~t], p[~t]), (y[t], p[t])) for (_, y), p, t in zip(clients, pred, test, strict=True)]
    whole = [tuple(np.concatenate(z) for z in zip(*[part[i] for part in parts], strict=True)) for i in (0, 1)]
    each = [agreed(a, b) for a, b in parts]
    refit = [experiments.accuracy(*b) for _, b in parts]
    assert each[4] == 0.0
    want = experiments.evaluate_held_out([(x[~t], y[~t]) for (x, y), t in zip(clients[:4], test, strict=False)], [(x[t], y[t]) for (x, y), t in zip(clients[:4], test, strict=False)], sets[:4], 2.0)
    assert set(got) == set(want)
    assert got["test_gacc_trmap"] == pytest.approx(agreed(*whole)) and got["test_gacc"] == pytest.approx(experiments.accuracy(*whole[1]))
    assert got["test_mean_acc_trmap"] == pytest.approx(np.mean(each)) and got["test_worst_acc_trmap"] == pytest.approx(min(each))
    assert got["test_mean_acc_refit"] == pytest.approx(np.mean(refit)) and got["test_worst_acc_refit"] == pytest.approx(min(refit))


def test_first_matching_by_listing():
    rng = np.random.default_rng(0)
    for rows, cols in itertools.product(range(1, 5), range(1, 5)):
        for _ in range(8):
            gain = rng.integers(0, 3, (rows, cols))
            pairs, every = min(rows, cols), []
            for pick in itertools.product([*range(cols), -1], repeat=rows):
                real = [p for p in pick if p >= 0]
                if len(real) == pairs == len(set(real)):
                    every.append((-sum(gain[i, p] for i, p in enumerate(pick) if p >= 0), [p if p >= 0 else cols for p in pick]))
            best = min(every)[1]
            assert first_matching(gain) == [p if p < cols else -1 for p in best]


def test_rectangular_accuracy_by_listing(spark):
    rng = np.random.default_rng(5)
    y, pred = rng.integers(0, 5, 300), rng.integers(0, 3, 300)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(y, pred, strict=True)], "y int, pred int")
    best = max(sum(int(((pred == c) & (y == labels[c])).sum()) for c in range(3)) for labels in itertools.permutations(range(5), 3))
    assert metrics.accuracy(df).head()["acc"] == pytest.approx(best / 300)


def test_trajectory_is_its_rounds(spark, points, v0):
    store = cs.ClientStore(points.where("client < 4"), most_values=300)  # the largest client beside the others
    run = cs.run(store, cs.Cell(personalize=False, steps=1, track=True), v0, 3, tol=None)
    rows = run.trajectory.persist()
    assert rows.count() == 3 * 4 * 3
    first = diagnostics.round_state(points.where("client < 4"), kernel.centers_frame(spark, v0)).orderBy("client", "j").collect()
    for got, want in zip(rows.where("round = 0").orderBy("client", "j").collect(), first, strict=True):
        for c in ("share", "n", "pre", "post", "footprint", "r", "q"):
            assert got[c] == pytest.approx(want[c]), c
        assert np.allclose(got["c"], want["c"])
    one = rows.where("round = 2").drop("round")
    for many, single in ((trajectory.substitution(rows), diagnostics.substitution(one)), (trajectory.tilt(rows), diagnostics.tilt(one))):
        a = [r.asDict() for r in many.where("round = 2").drop("round").orderBy("j").collect()]
        b = [r.asDict() for r in single.orderBy("j").collect()]
        for x, y in zip(a, b, strict=True):
            assert x == pytest.approx(y)
    assert trajectory.prototype_shares(rows).where("round = 2").head()["prototype_share"] == pytest.approx(diagnostics.prototype_share(one).head()["prototype_share"])
    pdf = rows.toPandas()
    ends = [np.corrcoef(g["r"], g["q"])[0, 1] for _, g in pdf[pdf["round"] == 2].groupby("client")]
    got = trajectory.gate_correlations(rows).head()
    assert got["pearson_end"] == pytest.approx(np.mean(ends)) and got["pearson_all"] == pytest.approx(pdf["r"].corr(pdf["q"]))
    assert got["spearman_all"] == pytest.approx(pdf["r"].rank().corr(pdf["q"].rank()))
    store.close()


def test_ranks_over_many_ranges(spark):
    rng = np.random.default_rng(2)
    values = [*rng.integers(0, 40, 500).astype(float).tolist(), None, None, math.inf, -math.inf]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double").repartition(7)
    got = {r["id"]: r["r"] for r in ranks.mid_ranked(df, "v", "r").collect()}
    key = [(-2 if v is None else -1 if v == -math.inf else v) for v in values]
    assert got == pytest.approx(dict(enumerate(pd.Series(key).rank().tolist())))
    codes = {r["value"]: (r["code"], r["before"], r["n"]) for r in ranks.distinct_counts(df, "v").collect()}
    assert codes[None] == (0, 0, 2) and codes[-math.inf] == (1, 2, 1) and codes[math.inf][0] == len(codes) - 1
    assert ranks.mid_ranked(df.limit(0), "v", "r").count() == 0


def test_validity_of_each_client(spark, points, clients, v0):
    rng = np.random.default_rng(4)
    sets = [v0 + rng.normal(size=v0.shape) for _ in SIZES]
    sets[1][2] = sets[1][0]  # coincident prototypes
    own = spark.createDataFrame([(c, [(j, t.tolist()) for j, t in enumerate(s)]) for c, s in enumerate(sets)], "client int, cs array<struct<j: int, v: array<double>>>")
    got = {r["client"]: r for r in personal.client_validity(points, own).collect()}
    for c, (x, _) in enumerate(clients):
        d2 = fed.square_distances(x, sets[c])
        u = fed.fuzzy(d2, 2.0)
        d = np.array([np.linalg.norm(a - b) for a, b in itertools.combinations(sets[c], 2)])
        p = (u**2).sum(axis=0) / (u**2).sum()
        h = -(p * np.log(np.maximum(p, 1e-12))).sum()
        scale = max(1e-8, 0.03 * np.sqrt(((x - x.mean(axis=0)) ** 2).sum(axis=1).mean()))
        want = {"fpc": (u * u).sum(axis=1).mean(), "partition_entropy": -(u * np.log(np.maximum(u, 1e-12))).sum(axis=1).mean(), "min_center_distance": d.min(), "collapse_threshold": scale, "collapsed_pairs": (d < scale).sum(), "prototype_mass_entropy": h / np.log(3), "effective_prototypes": np.exp(h), "underused_prototypes": (p < 0.01).sum()}
        for k, v in want.items():
            assert got[c][k] == pytest.approx(v, abs=1e-9), (c, k)
        assert got[c]["xie_beni"] == (None if c == 1 else pytest.approx((u**2 * d2).sum() / len(x) / d.min() ** 2))
        lab = np.maximum(d2, 1e-12).argmin(axis=1)
        seen = np.unique(lab)
        if 1 < len(seen) < len(x):
            cent = {k: x[lab == k].mean(axis=0) for k in seen}
            s = {k: np.linalg.norm(x[lab == k] - cent[k], axis=1).mean() for k in seen}
            worst = [max((s[a] + s[b]) / np.linalg.norm(cent[a] - cent[b]) for b in seen if b != a) for a in seen]
            assert got[c]["davies_bouldin"] == pytest.approx(np.mean(worst))
        else:
            assert got[c]["davies_bouldin"] is None
    single = spark.createDataFrame([(0, [(0, v0[0].tolist())])], own.schema)
    row = personal.client_validity(points.where("client = 0"), single).head()
    assert row["fpc"] == 1.0 and row["min_center_distance"] is row["xie_beni"] is row["effective_prototypes"] is row["davies_bouldin"] is None
