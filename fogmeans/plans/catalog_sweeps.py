"""Registered sweeps: whole (short) runs over federations made of the given vectors, each against SQL of its own."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.sql import functions as F

from ..operators import kernel, statistics
from ..sources import points as pts
from . import clientstate, oracles, posthoc, table_runs
from . import rounds as fed
from .catalog import query, r6

#: Federations by name: the client of a vector, as SQL that both engines read.
FEDERATIONS = {"by_id": "vec_id % 4", "by_label": "(label + (case when vec_id % 7 = 0 then 1 else 0 end)) % 4"}


@contextmanager
def federation(spark, sf, name: str, k: int = 3):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("client", F.expr(FEDERATIONS[name]).cast("int"))
    p = pts.from_columns(e.select("vec_id", "client", "label"), F.col("vec_id"), F.col("client"), F.col("label"), []).drop("x").join(e.select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("x")), "row_id")
    v0 = np.array([r["v"] for r in kernel.first_rows(p, k).orderBy("j").collect()])
    f = table_runs.Federation(name, p, v0)
    try:
        yield f
    finally:
        f.close()


def _scored(rows, *names):
    return rows.select("dataset", *names, "n_rounds", "n_clients", "upload_numbers", *[F.round(c, 3).alias(c) if c == "xb" else r6(c, c) for c in table_runs.METRICS])  # xb is large where prototypes are near


def _named(name: str, **more) -> str:
    return ", ".join([f"'{name}' dataset", *[f"'{x}' {n}" if isinstance(x, str) else f"{x} {n}" for n, x in more.items()]])


_CELLS = {"by_id": ("pre_mass_off", "post_footprint_on"), "by_label": ("post_none_off", "post_footprint_on")}


@query(oracles.stacked_rows({_named(d, cell=c, n_rounds=2, n_clients=4, upload_numbers=2 * 4 * 3 * 65): oracles.cell(*c.split("_")[:2], c.endswith("on"), oracles.bundle, FEDERATIONS[d]) for d, cs in _CELLS.items() for c in cs}))
def sweep_cells(spark, sf):
    """Two rounds of one local step; the seven metrics under each client's own prototypes."""
    out = []
    for name, cells in _CELLS.items():
        with federation(spark, sf, name) as f:
            out.append(table_runs.cells(f, list(cells), 2, 1))
    return _scored(table_runs._all(out), "cell")


_C = FEDERATIONS["by_label"]


@query(oracles.stacked_rows({_named("by_label", method=n, n_rounds=3 if n == "cfcm" else 2, n_clients=4, upload_numbers=2 * 4 * 2 * 3 * 64 if n == "scffcm" else -1): sql for n, sql in {"cfcm": oracles.central(3, oracles.bundle, client=_C), "pedrycz": oracles.gradient(0.001, 2, 1, oracles.bundle, _C), "scffcm": oracles.variates(0.05, 1.0, 2, 2, 1.0, ending=oracles.bundle, client=_C)}.items()}))
def sweep_rules(spark, sf):
    with federation(spark, sf, "by_label") as f:
        runs = {"cfcm": lambda f: fed.fcm(f.back, f.v0, most=3), "pedrycz": lambda f: fed.gradient(f.back, f.v0, 0.001, rounds=2, steps=1), "scffcm": lambda f: clientstate.run(f.store, clientstate.Variates(0.05, 1.0, 2), f.v0, 2)}
        return _scored(table_runs.rules(f, runs), "method")


_TAUS = dict.fromkeys(range(4), 2)


@query(oracles.stacked_rows({_named("by_label", method=n, n_rounds=2, n_clients=4, upload_numbers=-1): sql for n, sql in {"F-FCM": oracles.federated(2, 2, 0.75, ending=oracles.bundle, client=_C), "FedProx-FCM": oracles.federated(2, 2, 0.75, prox=0.1, ending=oracles.bundle, client=_C), "Ditto-FCM": oracles.federated(2, 2, 0.75, ditto=0.1, ending=oracles.bundle, client=_C), "GF-PFedFCM": oracles.cell("post", "footprint", True, oracles.bundle, _C, steps=2), "PFedFCM(no-footprint)": oracles.cell("post", "none", True, oracles.bundle, _C, steps=2, fixed=0.5), "FedNova-FCM": oracles.normalized(_TAUS, 2, oracles.bundle, _C)}.items()}))
def sweep_methods(spark, sf):
    """The method suite: two rounds of two local steps each."""
    cell = lambda **more: lambda f: clientstate.run(f.store, clientstate.Cell(steps=2, **more), f.v0, 2)
    tracks = lambda **more: lambda f: clientstate.run(f.store, clientstate.Tracks(steps=2, **more), f.v0, 2)
    runs = {"F-FCM": tracks(), "FedProx-FCM": tracks(prox=0.1), "Ditto-FCM": tracks(ditto=0.1), "GF-PFedFCM": cell(), "PFedFCM(no-footprint)": cell(gate="none", fixed_relevance=0.5), "FedNova-FCM": lambda f: fed.normalized(f.back, f.v0, _TAUS, rounds=2, steps=2)}
    with federation(spark, sf, "by_label") as f:
        return _scored(table_runs.rules(f, runs), "method")


_ALPHAS = (0.0001, 0.001, 0.005)
_GAP = "arg_min({step}, (abs(objective - central) / central, grid_idx))"


def _grid_sql(scripts: list[str], central: str, step: list[float], name: str) -> str:
    rows = " union all ".join(f"select {i} grid_idx, {x}::double step, t.objective, c.objective central from ({sql}) t, ({central}) c" for i, (x, sql) in enumerate(zip(step, scripts, strict=True)))
    return f"select '{name}' dataset, round({_GAP.format(step='step')}, 6) step, round(min(abs(objective - central) / central), 6) gap, count(*) n_stable from ({rows}) where objective <= 5 * central"


_CENTRAL = oracles.central(4, oracles.cost, client=_C)


@query(_grid_sql([oracles.gradient(a, 2, 1, oracles.cost, _C) for a in _ALPHAS], _CENTRAL, list(_ALPHAS), "by_label"))
def sweep_calibration(spark, sf):
    """The step of the gradient exchange that comes nearest to the pooled objective."""
    with federation(spark, sf, "by_label") as f:
        rows = table_runs.grid(f, [{"step": a} for a in _ALPHAS], lambda f, step: fed.gradient(f.back, f.v0, step, rounds=2, steps=1), 4)
    return statistics.calibrated(rows).select("dataset", r6("step", "step"), r6("gap", "gap"), "n_stable")


_ACTIONS = ("F-FCM (L=5)", "pre_mass_off (L=1)")


def _steps_sql() -> str:
    out = []
    for a in _ACTIONS:
        mass, gate, on, steps = posthoc.cell_of(a)
        grid = _grid_sql([oracles.cell(mass, gate, on, oracles.cost, _C, steps=steps, lr=lr) for lr in posthoc.STEPS], _CENTRAL, list(posthoc.STEPS), "by_label")
        out.append(f"select '{a}' as action, dataset, step from ({grid})")
    return " union all ".join(out)


@query(_steps_sql())
def sweep_server_steps(spark, sf):
    """The server step of each action that comes nearest to the pooled objective in two rounds."""
    out = []
    with federation(spark, sf, "by_label") as f:
        for a in _ACTIONS:
            mass, gate, on, steps = posthoc.cell_of(a)
            make = lambda f, step, c=(mass, gate, on, steps): clientstate.run(f.store, clientstate.Cell(*c, lr=step), f.v0, 2, tol=None)
            out.append(table_runs.grid(f, [{"step": s} for s in posthoc.STEPS], make, 4).withColumn("action", F.lit(a)))
    return posthoc.chosen(table_runs._all(out)).select("action", "dataset", r6("step", "step"))


def _audit_sql(m: float) -> str:
    def summed(q, v):
        apart = f"exists (select 1 from {v} b where b.j < a.j and {oracles.DISTANCE.replace('(x, v)', '(a.v, b.v)')} < 1e-6)"
        u = q.add(f"select client, row_id, d2, w, pow(w, {1 / m}) u from {q.weights(q.spread(v), m)}")
        return q.ending(f"select (select count(*) from {v})::int c, (select count(*) filter (not {apart}) from {v} a)::int as distinct_, (select -sum(u * ln(greatest(u, 1e-300))) / count(distinct row_id) / ln((select count(*) from {v})) from {u}) entropy_norm, (select sum(w * d2) from {u}) objective")

    drawn = lambda r: lambda q: q.add(f"select j, v from {oracles.greedy_starts(q, q.add('select row_id id, x from pt'), 3, 2, 0, 3)} where r = {r}")
    classes = lambda q: q.add(f"select (dense_rank() over (order by label) - 1)::int j, v from (select label, list(t order by i) v from (select label, i, avg(x[i]) t from pt join embeddings on vec_id = row_id, {oracles.DIMS} group by label, i) group by label)")
    runs = [("paper", None), ("kmeanspp_best", drawn(0)), ("kmeanspp_best", drawn(1)), ("oracle", classes)]
    rows = oracles.stacked_rows({f"'{n}' init, {i} run": oracles.central(3, summed, m, start) for i, (n, start) in enumerate(runs)})
    return f"select 'by_id' dataset, {m}::double m, init, c, distinct_ as \"distinct\", round(entropy_norm, 6) entropy_norm, round(objective, 6) objective from ({rows}) qualify row_number() over (partition by init order by objective, run) = 1"


@query(" union all ".join(f"select * from ({_audit_sql(m)})" for m in (2.0, 1.5)))
def sweep_audit(spark, sf):
    """Prototypes that stay apart after three pooled iterations, by fuzzifier and start."""
    with federation(spark, sf, "by_id") as f:
        rows = table_runs._all([table_runs.audit(f, m, 3, 2) for m in (2.0, 1.5)])
    return rows.select("dataset", "m", "init", "c", "distinct", r6("entropy_norm", "entropy_norm"), r6("objective", "objective"))


def _descent_sql(mass: str, steps: int, rounds: int) -> str:
    q = oracles.Script(client=_C)
    v, _, log = oracles.cell_rounds(q, mass, "none", rounds=rounds, steps=steps)
    each = [q.add(f"select client, sum(w * d2) s from {q.weights(at)} group by client") for at in [*[shared for shared, *_ in log], q.spread(v)]]
    return q.ending(" union all ".join(f"select {t} round, round(sum(beta * s), 6) objective from {e} join cl using (client)" for t, e in enumerate(each)))


@query(oracles.stacked_rows({_named("by_label", cell=f"{mass}_none", L=n): _descent_sql(mass, n, 2) for mass in ("pre", "post") for n in (1, 2)}))
def sweep_descent(spark, sf):
    """The clients' weighted objective before and after each of two rounds."""
    with federation(spark, sf, "by_label") as f:
        rows = table_runs._all([table_runs.descent(f, mass, "none", n, 2) for mass in ("pre", "post") for n in (1, 2)])
    return rows.withColumn("objective", r6("objective"))


def _counter_sql() -> str:
    out = []
    for n in (1, 2, 5):
        def ending(q, v, n=n):
            local, pre, _ = q.steps(q.spread(v), n)
            moved = q.server(v, local, q.add(f"select client, j, beta * mass w from {pre} join cl using (client)"), 0.75)
            gap = q.add(f"select sqrt(sum({oracles.DISTANCE.replace('(x, v)', '(a.v, b.v)')})) d from {v} a join {moved} b using (j)")
            return q.ending(f"select round(o, 6) objective, round(d / 0.75, 6) target_shift, round(d, 6) shift, round(e - o, 6) + 0.0 rise from {gap}, (select sum(w * d2) o from {q.weights(q.spread(v))}), (select sum(w * d2) e from {q.weights(q.spread(moved))})")

        out.append(f"select 'by_label' dataset, {n} steps, t.* from ({oracles.central(3, ending, client=_C)}) t")
    return " union all ".join(out)


@query(_counter_sql())
def counter_example(spark, sf):
    """One round from the pooled prototypes moves them and can raise the objective, by local steps; over the given vectors (theory.py has the published blobs)."""
    with federation(spark, sf, "by_label") as f:
        rows = table_runs.fixed_point_steps(f, (1, 2, 5), 3)
    return rows.select("dataset", "steps", *[r6(c, c) for c in ("objective", "target_shift", "shift", "rise")])
