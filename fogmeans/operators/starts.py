"""Starts by distance-weighted draws, and k-means from them, over tables of any size.

points: row_id, x. A draw with weights is the row with the smallest -ln(u) / weight, where u is made of an md5 of seed,
restart, step, candidate and row_id: one aggregation with a row a task, the same on every cluster and in other engines. All
restarts share each pass. The driver holds restarts times k centres.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel

#: Hexadecimal digits of an md5 that make a draw, so that every u is a whole double.
DIGITS = 13


def uniform(seed: int, restart: Column, step: int, candidate: int, row_id: Column) -> Column:
    """A number between 0 and 1 of a hash; never 0 or 1."""
    text = F.concat_ws("|", F.lit(str(seed)), restart.cast("string"), F.lit(str(step)), F.lit(str(candidate)), row_id.cast("string"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def _with(points: DataFrame, rows: list, fields: str) -> DataFrame:
    """Every point with every one of ``rows`` (a row a restart, sent to all tasks); partial sums follow before any shuffle."""
    return points.crossJoin(F.broadcast(points.sparkSession.createDataFrame(rows, fields)))


def _nearest(chosen: Column) -> Column:
    return F.array_min(F.transform(chosen, lambda c: kernel.squared_distance(F.col("x"), c)))


def greedy_starts(points: DataFrame, k: int, restarts: int = 1, seed: int = 0, trials: int | None = None) -> np.ndarray:
    """Array (restarts, k, d): k-means++ starts. The first is drawn evenly, each next one is the best of ``trials`` (2 + ln k)
    draws by the squared distance to the nearest start so far: the one that leaves the least sum of these distances.

    A step is one pass: it adds up that sum for each candidate and draws the next candidates under each. Where all rows
    coincide with a start, the next is drawn evenly. Null x and row_ids are left out; a repeated row_id draws alike. Fewer than one row is an error.
    """
    trials = 2 + int(math.log(k)) if trials is None else trials
    rows = points.where("x is not null and row_id is not null").select("row_id", "x")
    pick = lambda c, key: F.min_by("x", F.struct(key.alias("k"), "row_id")).alias(c)
    even = lambda step, c: -F.log(uniform(seed, F.col("r"), step, c, F.col("row_id")))
    runs = _with(rows, [(r,) for r in range(restarts)], "r int")
    first = {g["r"]: g for g in runs.groupBy("r").agg(pick("x", even(0, 0))).collect()}
    if not first:
        raise ValueError("no rows to start from")
    chosen = {r: [list(first[r]["x"])] for r in range(restarts)}

    def draws(step: int, cost: Column, name: str) -> list[Column]:
        """The candidates of ``step`` by weight ``cost``, and one drawn evenly in case no row has any."""
        made = [F.min_by("x", F.when(cost > 0, F.struct((even(step, c) / cost).alias("k"), "row_id"))).alias(f"{name}{c}") for c in range(trials)]
        return [*made, pick(f"{name}e", even(step, 0))]

    def taken(row, name: str) -> list[list[float]]:
        return [list(row[f"{name}{c}"] if row[f"{name}{c}"] is not None else row[f"{name}e"]) for c in range(trials)]

    if k == 1:
        return np.array([chosen[r] for r in range(restarts)])
    runs = _with(rows, [(r, chosen[r]) for r in range(restarts)], "r int, chosen array<array<double>>").withColumn("cost", _nearest(F.col("chosen")))
    candidates = {g["r"]: taken(g, "c") for g in runs.groupBy("r").agg(*draws(1, F.col("cost"), "c")).collect()}
    for step in range(1, k):
        runs = _with(rows, [(r, chosen[r], candidates[r]) for r in range(restarts)], "r int, chosen array<array<double>>, tried array<array<double>>").withColumn("cost", _nearest(F.col("chosen")))
        after = [F.least("cost", kernel.squared_distance(F.col("x"), F.get("tried", F.lit(c)))) for c in range(trials)]
        runs = runs.withColumns({f"a{c}": a for c, a in enumerate(after)})
        sums = [F.sum(f"a{c}").alias(f"s{c}") for c in range(trials)]
        more = [d for c in range(trials) for d in draws(step + 1, F.col(f"a{c}"), f"n{c}_")] if step < k - 1 else []
        for g in runs.groupBy("r").agg(*sums, *more).collect():
            best = min(range(trials), key=lambda c: (g[f"s{c}"], c))  # noqa: B023
            chosen[g["r"]].append(candidates[g["r"]][best])
            if more:
                candidates[g["r"]] = taken(g, f"n{best}_")
    return np.array([chosen[r] for r in range(restarts)])


def lloyd(points: DataFrame, starts: np.ndarray, most: int = 300, tol: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(centres, sum of squared distances of each restart) after at most ``most`` rounds, all restarts in one pass a round.

    Rows go to their nearest centre, ties to the first. An empty cluster takes the row farthest from its centre (ties to the
    smallest row_id), several ones the next farthest. Rounds end when no centre moves by more than ``tol``.
    """
    rows = points.where("x is not null").select("row_id", "x")
    v = np.array(starts, dtype=float)
    restarts, k, d = v.shape

    def near(v: np.ndarray) -> DataFrame:
        runs = _with(rows, [(r, v[r].tolist()) for r in range(len(v))], "r int, cs array<array<double>>")
        d2 = F.transform("cs", lambda c: kernel.squared_distance(F.col("x"), c))
        runs = runs.withColumn("d2", d2).withColumn("cost", F.array_min("d2"))
        return runs.withColumn("j", F.array_position("d2", F.col("cost")).cast("int") - 1).drop("cs", "d2")

    for _ in range(most):
        sums = kernel.vector_sums(near(v), ["r", "j"], F.lit(1.0), d).collect()  # restarts times k rows
        new, seen = v.copy(), np.zeros((restarts, k), bool)
        for g in sums:
            new[g["r"], g["j"]] = np.array(g["s"]) / g["mass"]
            seen[g["r"], g["j"]] = True
        for r in np.flatnonzero(~seen.all(axis=1)):
            holes = np.flatnonzero(~seen[r])
            far = near(v[[r]]).orderBy(F.col("cost").desc(), "row_id").limit(len(holes)).collect()
            for j, g in zip(holes, far, strict=False):
                new[r, j] = g["x"]
        moved, v = np.sqrt(((new - v) ** 2).sum(axis=2)).max(), new
        if moved <= tol:
            break
    inertia = {g["r"]: g["s"] for g in near(v).groupBy("r").agg(F.sum("cost").alias("s")).collect()}
    return v, np.array([inertia[r] for r in range(restarts)])


def k_means(points: DataFrame, k: int, restarts: int = 10, seed: int = 0, most: int = 300, tol: float = 0.0) -> np.ndarray:
    """The centres of the best of ``restarts`` runs of lloyd() from greedy_starts(); ties to the first."""
    centers, cost = lloyd(points, greedy_starts(points, k, restarts, seed), most, tol)
    return centers[int(np.argmin(cost))]


def drawn_rows(points: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    """k rows drawn evenly, those with the smallest hashes; fewer than k are an error."""
    rows = points.where("x is not null").orderBy(uniform(seed, F.lit(0), 0, 0, F.col("row_id")), "row_id").limit(k).collect()
    if len(rows) < k:
        raise ValueError(f"{len(rows)} rows for {k} centres")
    return np.array([r["x"] for r in rows])


def class_means(points: DataFrame) -> np.ndarray:
    """The mean of each label's rows, in order of labels; rows without a label are left out."""
    each = points.where("y is not null").select("y", F.posexplode("x").alias("i", "t")).groupBy("y", "i").agg(F.avg("t").alias("t"))
    rows = each.groupBy("y").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda z: z["t"]).alias("m")).orderBy("y").collect()  # a row a label
    return np.array([r["m"] for r in rows])
