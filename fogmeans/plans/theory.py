"""Rounds that raise the objective: two blobs, one a client, started from the pooled fixed point."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import rounds as fed

#: Points a blob, deviation and the second mean of the example; the first is the origin.
POINTS, SPREAD, FAR = 40, 0.3, (4.0, 4.0)
ORDERS = ("rows", "scaled", "joint", "columns")


def blobs(order: str = "rows", seed: int = 1) -> list[np.ndarray]:
    """The two clients; ``order`` is how the numbers are drawn: row by row, as standard normals scaled afterwards, jointly by covariance, or dimension by dimension."""
    rng, far, shape = np.random.default_rng(seed), np.array(FAR), (POINTS, 2)
    draw = {
        "rows": lambda mean: rng.normal(mean, SPREAD, shape),
        "scaled": lambda mean: mean + SPREAD * rng.standard_normal(shape),
        "joint": lambda mean: rng.multivariate_normal(mean, SPREAD**2 * np.eye(2), POINTS),
        "columns": lambda mean: mean + rng.normal(0.0, SPREAD, shape[::-1]).T,
    }[order]
    return [draw(np.zeros(2)), draw(far)]


def counter_example(order: str = "rows", steps: tuple[int, ...] = (1, 2, 5), lr: float = 0.75, m: float = 2.0) -> list[dict]:
    """Of each number of local steps: the fixed point's objective, how far one round moves the target and the prototypes, and by how much the objective rises."""
    clients = blobs(order)
    back, pooled = fed.LocalBackend(clients), fed.LocalBackend([np.vstack(clients)])
    v = fed.fcm(pooled, np.stack([c.mean(axis=0) for c in clients]), m, 100_000, 1e-12).centers
    cost = lambda at: pooled.sums({0: at}, m)[0].objective
    out = []
    for n in steps:
        moved, target = (fed.run_cell(back, v, "pre", "none", False, 1, n, m, a).centers for a in (lr, 1.0))
        out.append({"steps": n, "objective": cost(v), "target_shift": float(np.linalg.norm(target - v)), "shift": float(np.linalg.norm(moved - v)), "rise": cost(moved) - cost(v)})
    return out


def counter_example_frame(spark: SparkSession, order: str = "rows") -> DataFrame:
    return spark.createDataFrame([tuple(r.values()) for r in counter_example(order)], "steps int, objective double, target_shift double, shift double, rise double")
