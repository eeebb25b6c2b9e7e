"""Sweeps of whole runs over tables of points: cells, rules, methods, grids, audits and descent logs, each a relation of rows.

Every run is Spark jobs over the points (clientstate.py, rounds.py on its Spark backend); the driver holds prototypes and the
few numbers of a row. points: client, row_id, x, y.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Protocol
from ..operators import kernel, metrics, personal, starts
from . import clientstate
from . import rounds as fed
from .experiments import uploaded

P = Protocol()
METRICS = ("min_dist", "mean_acc", "worst_acc", "fcm_obj", "gacc", "xb", "hnorm")


class Federation:
    """``points`` written by client, their backend and first prototypes; ``close()`` deletes what was written."""

    def __init__(self, name: str, points: DataFrame, v0: np.ndarray):
        self.name, self.v0 = name, v0
        self.points = points.persist()
        self.store, self.back, self.spark = clientstate.ClientStore(self.points), fed.SparkBackend(self.points), points.sparkSession

    def close(self) -> None:
        self.store.close()
        self.points.unpersist()

    def cost(self, v: np.ndarray, m: float = P.m) -> float:
        """The objective at shared prototypes; NaN where they are not finite."""
        if not np.isfinite(v).all():
            return math.nan
        return kernel.objective(self.points, kernel.centers_frame(self.spark, v), m).head()["objective"]

    def everywhere(self, v: np.ndarray) -> DataFrame:
        """``v`` as the prototypes of every client."""
        cs = F.array(*[F.struct(F.lit(j).alias("j"), F.array(*[F.lit(float(t)) for t in row]).alias("v")) for j, row in enumerate(v)])
        return self.store.clients.select("client", cs.alias("cs"))

    def scored(self, v: np.ndarray, own: DataFrame | None, m: float, **names) -> DataFrame:
        """One row: data set, ``names`` (n_rounds among them), n_clients, upload_numbers and the seven metrics, all NaN where the run diverged."""
        names |= {"n_clients": self.store.n_clients, "upload_numbers": uploaded(names.get("method", "cells"), names["n_rounds"], self.store.n_clients, *self.v0.shape)}
        if not np.isfinite(v).all():
            row = self.spark.createDataFrame([(math.nan,) * len(METRICS)], ", ".join(f"{c} double" for c in METRICS))
            return row.select(F.lit(self.name).alias("dataset"), *[F.lit(x).alias(n) for n, x in names.items()], *METRICS)
        row = personal.bundle(self.points, own if own is not None else self.everywhere(v), kernel.centers_frame(self.spark, v), m)
        return row.select(F.lit(self.name).alias("dataset"), *[F.lit(x).alias(n) for n, x in names.items()], *METRICS)


def _all(rows: list[DataFrame]) -> DataFrame:
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def cells(f: Federation, names: list[str], rounds: int = P.rounds, steps: int = P.local_steps, m: float = P.m) -> DataFrame:
    """dataset, cell, n_rounds and the metrics of each cell (mass_gate_personal), under each client's own prototypes."""
    out = []
    for name in names:
        mass, gate, on = name.split("_")
        run = clientstate.run(f.store, clientstate.Cell(mass, gate, on == "on", steps, m), f.v0, rounds, tol=P.tol if on == "on" else None)
        out.append(f.scored(run.centers, run.personal() if on == "on" else None, m, cell=name, n_rounds=run.rounds))
    return _all(out)


def rules(f: Federation, runs: dict[str, object], m: float = P.m) -> DataFrame:
    """dataset, method, n_rounds, n_clients, upload_numbers and the metrics of each of ``runs``: name to a function of the
    federation that returns a run. A run that raises ArithmeticError or ValueError, or is None (no stable setting), has a
    placeholder: n_rounds -1 and NaN."""
    out = []
    for name, make in runs.items():
        try:
            run = make(f)
        except (ArithmeticError, ValueError, np.linalg.LinAlgError):
            run = None
        if run is None:
            out.append(f.scored(np.full_like(f.v0, math.nan), None, m, method=name, n_rounds=-1))
            continue
        own = run.personal() if isinstance(run, clientstate.StateRun) and not isinstance(run.rule, (clientstate.Variates, clientstate.Pooled)) else None
        out.append(f.scored(run.centers, own, m, method=name, n_rounds=run.rounds))
    return _all(out)


def grid(f: Federation, points: list[dict], make, iterations: int = 150, m: float = P.m) -> DataFrame:
    """dataset, grid_idx, the numbers of each grid point, objective and central: the objective of make(f, **point) beside the pooled run's."""
    central = f.cost(fed.fcm(f.back, f.v0, m, iterations).centers, m)
    rows = [(f.name, i, *[float(x) for x in p.values()], f.cost(make(f, **p).centers, m), central) for i, p in enumerate(points)]
    return f.spark.createDataFrame(rows, ", ".join(["dataset string", "grid_idx int", *[f"{n} double" for n in points[0]], "objective double", "central double"]))


def audit(f: Federation, m: float, iterations: int = 300, restarts: int = 10, seed: int = 0) -> DataFrame:
    """dataset, m, init, c, distinct, entropy_norm, objective: how many prototypes stay apart in pooled runs from the given
    start, from k-means++ starts (the cheapest run counts) and from the means of the classes."""
    k = len(f.v0)
    means = f.points.groupBy("y").agg(*[F.avg(F.get("x", F.lit(d))).alias(f"m{d}") for d in range(f.v0.shape[1])]).orderBy("y").collect()  # a row a class
    drawn = starts.greedy_starts(f.points, k, restarts, seed)
    out = []
    for name, some in (("paper", [f.v0]), ("kmeanspp_best", list(drawn)), ("oracle", [np.array([list(r)[1:] for r in means])])):
        found = [fed.fcm(f.back, v, m, iterations).centers for v in some]
        costs = [f.cost(v, m) for v in found]
        v = kernel.centers_frame(f.spark, found[int(np.argmin(costs))])
        entropy = metrics.validity(kernel.memberships(f.points, v, m), 1e-300).head()["hnorm"]
        out.append((f.name, m, name, len(found[0]), metrics.distinct_prototypes(v), entropy, min(costs)))
    return f.spark.createDataFrame(out, "dataset string, m double, init string, c int, distinct int, entropy_norm double, objective double")


def descent(f: Federation, mass: str, gate: str, steps: int, rounds: int, m: float = P.m) -> DataFrame:
    """dataset, cell, L, round, objective: the clients' objectives, weighted by their shares, at the prototypes of each round."""
    v, log = f.v0, []
    for t in range(rounds + 1):
        log.append((f.name, f"{mass}_{gate}", steps, t, kernel.weighted_objective(f.points, kernel.centers_frame(f.spark, v), m).head()["objective"]))
        if t < rounds:
            v = clientstate.run(f.store, clientstate.Cell(mass, gate, False, steps, m), v, 1, tol=None).centers
    return f.spark.createDataFrame(log, "dataset string, cell string, L int, round int, objective double")


def fixed_point_steps(f: Federation, steps: tuple[int, ...], iterations: int, lr: float = P.server_lr, m: float = P.m) -> DataFrame:
    """dataset, steps, objective, target_shift, shift, rise: from the pooled prototypes, how far one round of so many local
    steps moves the target and the prototypes, and by how much the pooled objective rises."""
    v = fed.fcm(f.back, f.v0, m, iterations, tol=-1.0).centers
    base, out = f.cost(v, m), []
    for n in steps:
        moved = clientstate.run(f.store, clientstate.Cell("pre", "none", False, n, m, lr), v, 1, tol=None).centers
        # a damped step is lr times the way to the target
        out.append((f.name, n, base, float(np.linalg.norm(moved - v)) / lr, float(np.linalg.norm(moved - v)), f.cost(moved, m) - base))
    return f.spark.createDataFrame(out, "dataset string, steps int, objective double, target_shift double, shift double, rise double")
