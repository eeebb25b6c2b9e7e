"""Resumable jobs, replaced results, starts and k-means, geometry, views, quantiles with outliers, sources of arms."""

import itertools
import os
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fogmeans.operators import gates, geometry, relation, starts
from fogmeans.plans import analysis, clientstate, jobs
from fogmeans.plans import rounds as fed


# --- jobs -----------------------------------------------------------------------------------------------------------------
def counting_work(folder, broken):
    """Each run leaves a mark; ``broken`` kinds fail."""

    def work(kind, args):
        open(f"{folder}/{kind}-{args[0]}-{os.urandom(4).hex()}", "w").close()
        if kind in broken:
            raise RuntimeError("stopped")
        return {"square": args[0] ** 2, "name": f"{kind} {args}"}

    return work


def test_jobs_go_on_where_they_stopped(spark, tmp_path):
    marks, path = tmp_path / "marks", f"file://{tmp_path}/done"
    marks.mkdir()
    todo = jobs.enumerated(spark, {"a": [(i, "x (1)") for i in range(6)], "b": [(i,) for i in range(3)]}, {2: 9.0})
    assert todo.head()["cost"] == 9.0 and todo.select("key").distinct().count() == 9
    schema = "square long, name string"
    with pytest.raises(Exception, match="stopped"):
        jobs.run(todo, counting_work(marks, {"b"}), path, schema, tasks=9)
    time.sleep(4)  # tasks under way end
    first = sorted(os.listdir(marks))
    assert 0 < jobs.finished(spark, path).count() <= 6
    done = {r["key"] for r in jobs.finished(spark, path).collect()}
    got = jobs.run(todo, counting_work(marks, set()), path, schema)
    assert sorted(r["square"] for r in got.collect()) == sorted([i * i for i in range(6)] + [i * i for i in range(3)])
    again = [m for m in os.listdir(marks) if m not in first]
    names = {r["key"]: (r["kind"], eval(r["args"])[0]) for r in todo.collect()}
    rerun = {tuple(m.split("-")[:2]) for m in again}
    assert rerun == {(k, str(i)) for key, (k, i) in names.items() if key not in done}  # no finished job twice
    before = sorted(os.listdir(marks))
    same = jobs.run(todo.union(todo), counting_work(marks, {"a", "b"}), path, schema)
    assert sorted(os.listdir(marks)) == before and sorted(map(tuple, same.collect())) == sorted(map(tuple, got.collect()))
    assert jobs.run(todo.limit(0), counting_work(marks, set()), path, schema).count() == 0
    assert jobs.cache_key("eh", "mnist (20c)", 1) != jobs.cache_key("eh", "mnist 20c", 1)


# --- results --------------------------------------------------------------------------------------------------------------
def test_results_are_replaced_whole_or_not_at_all(spark, tmp_path):
    path = f"file://{tmp_path}/results"
    a = spark.createDataFrame([(1, "x", 0.5)], "seed int, cell string, acc double")
    b = spark.createDataFrame([("y", 7, None)], "cell string, alpha int, seed int")
    relation.replace_results([a, b], path, ["cell"])
    back = spark.read.option("header", True).option("inferSchema", True).csv(path)
    assert back.columns == ["cell", "seed", "acc", "alpha"]
    assert sorted(map(tuple, back.collect()), key=str) == sorted([("x", 1, 0.5, None), ("y", None, None, 7)], key=str)
    grown = [back, spark.createDataFrame([("z", 3, 0.1, 1)], "cell string, seed int, acc double, alpha int")]
    relation.replace_results(grown, path)  # reads what it replaces
    now = spark.read.option("header", True).csv(path)
    assert now.count() == 3
    with pytest.raises(Exception):
        relation.replace_results([now.withColumn("acc", F.raise_error(F.lit("broken")))], path)
    assert spark.read.option("header", True).csv(path).count() == 3 and os.listdir(tmp_path) == ["results"]


def test_scope_and_provenance(spark):
    rows = spark.createDataFrame([("wine", 5, 50, "a"), ("wine", 1, 50, None), ("letter", 5, 250, "a")], "dataset string, L int, rounds int, code string")
    assert relation.in_scope(rows, {"dataset": ["wine"], "L": []}).count() == 2
    got = {(r["dataset"], r["L"]): (r["fits"], r["misfit"]) for r in relation.provenance(rows, {"L": 5, "rounds": 50, "code": "a"}).collect()}
    assert got == {("wine", 5): (True, []), ("wine", 1): (False, ["L", "code"]), ("letter", 5): (False, ["rounds"])}
    assert relation.provenance(rows, {}).where("fits").count() == 3


def test_sources_and_parts_of_the_clients(spark, tmp_path):
    head = "dataset,seed,cell,L,rounds,participation,split,cfraction,mean_acc\n"
    (tmp_path / "one.csv").write_text(head + "wine,0,pre_none_off,5,50,1.0,0.0,,0.7\nwine,1,pre_none_off,5,50,0.5,0.0,,0.6\n")
    (tmp_path / "two.csv").write_text(head + "wine,0,pre_none_off,5,50,1.0,0.0,,0.9\n")
    (tmp_path / "sc.csv").write_text(head + "wine,0,,5,50,,,0.5,0.1\nwine,1,,5,50,,,1.0,0.2\nwine,2,,5,50,,,,0.3\n")
    schema = "dataset string, seed int, cell string, L int, rounds int, participation double, split double, cfraction double, mean_acc double"
    rows, missing = analysis.load_sources(spark, f"file://{tmp_path}", [("cells", "one.csv"), ("cells", "none.csv"), ("cells", "two.csv"), ("scffcm", "sc.csv")], schema)
    assert missing == ["none.csv"]
    got = sorted((r["arm"], r["seed"], r["mean_acc"]) for r in analysis.arms(rows.withColumn("no_earlystop", F.lit(0))).collect())
    assert got == [("L5:pre_none_off", 0, 0.7), ("SC:L5", 1, 0.2), ("SC:L5", 2, 0.3)]
    assert analysis.load_sources(spark, f"file://{tmp_path}", [("cells", "none.csv")]) == (None, ["none.csv"])


# --- starts ---------------------------------------------------------------------------------------------------------------
def test_starts_spread_and_repeat(spark):
    rng = np.random.default_rng(4)
    blobs = [(-40, 0), (40, 0), (0, 50), (0, -50)]
    x = np.concatenate([rng.normal(size=(50, 2)) + b for b in blobs])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id long, x array<double>").repartition(4)
    got = starts.greedy_starts(df, 4, 3, seed=5)
    assert np.array_equal(got, starts.greedy_starts(df.repartition(7), 4, 3, seed=5)) and got.shape == (3, 4, 2)
    for r in got:
        assert {int(np.argmin([np.hypot(*(c - b)) for b in blobs])) for c in r} == {0, 1, 2, 3}
        assert all(any(np.array_equal(c, p) for p in x) for c in r)
    centers, cost = starts.lloyd(df, got)
    means = sorted(tuple(np.round(x[50 * i : 50 * i + 50].mean(axis=0), 9)) for i in range(4))
    for r in centers:
        assert sorted(tuple(np.round(c, 9)) for c in r) == means
    assert np.allclose(cost, cost[0])
    # an empty cluster takes the farthest row; equal rows give equal starts; one start; no rows
    far, _ = starts.lloyd(df, np.array([[[-40.0, 0], [40, 0], [0, 0], [900, 900]]]), most=1)
    assert any(np.array_equal(far[0, 3], p) for p in x)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "row_id long, x array<double>")
    assert starts.greedy_starts(same, 3).tolist() == [[[1.0, 2.0]] * 3]
    assert starts.greedy_starts(df, 1, 2).shape == (2, 1, 2)
    with pytest.raises(ValueError):
        starts.greedy_starts(df.limit(0), 2)


def test_draws_follow_their_weights(spark):
    """A row twice as far from the only start is drawn about four times as often."""
    df = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [2.0])], "row_id long, x array<double>")
    second = starts.greedy_starts(df.where("row_id > 0").union(df.where("row_id = 0")), 2, 600, seed=1, trials=1)
    from_zero = second[second[:, 0, 0] == 0.0, 1, 0]
    assert len(from_zero) > 120 and 0.7 < (from_zero == 2.0).mean() < 0.9


def test_pooled_rule_clusters_local_centres(spark):
    rng = np.random.default_rng(3)
    clients = [rng.normal(size=(30, 2)) + 6 * np.array([c % 2, c % 3]) for c in range(5)]
    df = spark.createDataFrame([(c, 100 * c + i, r.tolist()) for c, x in enumerate(clients) for i, r in enumerate(x)], "client int, row_id long, x array<double>")
    v0 = np.array([[0.0, 0.0], [6.0, 12.0]])
    results = []
    for most_values in (clientstate.MOST_VALUES, 1):
        store = clientstate.ClientStore(df, most_values)
        results.append(clientstate.run(store, clientstate.Pooled(steps=2, restarts=6), v0, 1, tol=None).centers)
        store.close()
    back = fed.LocalBackend(clients)
    rows = np.vstack(list(fed.local_steps(back, dict.fromkeys(back.clients, v0), 2, 2.0)[0].values()))
    splits = [np.array([0, *s]) for s in itertools.product((0, 1), repeat=9) if any(s)]
    means = [np.stack([rows[s == j].mean(axis=0) for j in (0, 1)]) for s in splits]
    cost = [((rows - m[s]) ** 2).sum() for s, m in zip(splits, means, strict=True)]
    want = means[int(np.argmin(cost))]
    want = min((want, want[::-1]), key=lambda w: np.sqrt(((w - v0) ** 2).sum(axis=1)).sum())
    assert np.allclose(results[0], results[1]) and np.allclose(results[0], want)


# --- geometry -------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("block", [7, 40, 5000])
def test_pair_distances(spark, block):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 5)) + 1000
    x[:4] = x[4]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(900, None)], "row_id long, x array<double>")
    d = np.array([np.linalg.norm(a - b) for a, b in itertools.combinations(x, 2)])
    got = geometry.pair_distances(df, block).head()
    assert got["n"] == len(d) and got["mean"] == pytest.approx(d.mean(), rel=1e-6) and got["ratio"] == pytest.approx(d.mean() / d.std(), rel=1e-6)
    none = geometry.pair_distances(df.limit(0), block).head()
    assert none["n"] in (0, None) and none["mean"] is None


def test_rows_are_found_again(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 4)).round(3)
    x[:, 1] = 0.0005  # on a rounding edge
    x[50:90] = x[50]
    names = rng.permutation(1000)[:200]
    noise = rng.uniform(-5e-10, 5e-10, size=x.shape)
    noise[50:90] = noise[50]
    left = [(i, r.tolist()) for i, r in enumerate(x)] + [(5000, None), (5001, [9.0] * 4), (5002, [1.0])]
    right = [(int(names[i]), (x[i] + noise[i]).tolist()) for i in range(200) if i not in (3, 60, 61)] + [(7000, None), (7001, [8.0] * 4)]
    a, b = (spark.createDataFrame(v, "row_id long, x array<double>") for v in (left, right))
    got = geometry.same_rows(a, b).collect()
    pairs = {r["a_id"]: r["b_id"] for r in got if r["a_id"] is not None}
    assert len(pairs) == 203 and {r["b_id"] for r in got if r["a_id"] is None} == {7000, 7001}
    for i in range(200):
        if not 50 <= i < 90:
            assert pairs[i] == (None if i == 3 else names[i])
    tied = sorted(int(names[i]) for i in range(50, 90) if i not in (60, 61))
    assert [pairs[i] for i in range(50, 90)] == [*tied, None, None] and pairs[5000] is pairs[5001] is pairs[5002] is None
    assert geometry.same_rows(a, b.limit(0)).where("b_id is null").count() == 203


def test_quantiles_with_an_outlier(spark):
    rng = np.random.default_rng(0)
    v = np.append(rng.uniform(0, 1, 4000), 1e12)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "v": v}))
    for q in (0.0, 0.5, 0.95, 1.0):
        got = gates.quantiles(df, ["g"], "v", q, bins=16, few=50).head()
        assert got["quantile"] == pytest.approx(np.quantile(v, q)) and got["n"] == 4001
    flat = spark.createDataFrame(pd.DataFrame({"g": 1, "v": [2.0] * 500 + [7.0]}))
    assert gates.quantiles(flat, ["g"], "v", 0.9, bins=4, few=5).head()["quantile"] == 2.0
