"""Runs over a table of points from the command line: python -m fogmeans.plans.commands cells --points file:///... --out file:///...

Commands: cells, rules (scffcm, pedrycz, cfcm), methods, calibrate, audit, descent. Points are a parquet table with a row
number, a label and either an array column or number columns; results are CSV with the settings and code digests beside them.
"""

from __future__ import annotations

import argparse
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Protocol, parse_cells
from ..operators import kernel, relation, starts, statistics
from ..sources import points as pts
from . import clientstate, jobs, table_runs
from . import rounds as fed

P = Protocol()
#: Steps of the published baselines, where none is given.
SIZES = {"scffcm": (0.2, 1.0), "pedrycz": (0.001,)}
GRIDS = {"pedrycz": [{"step": a} for a in (0.0001, 0.0003, 0.001, 0.003, 0.01)], "scffcm": [{"eta_l": a, "eta_g": b} for a in (0.05, 0.1, 0.2) for b in (0.5, 1.0)]}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fogmeans")
    p.add_argument("command", choices=["cells", "rules", "methods", "calibrate", "audit", "descent"])
    p.add_argument("--points", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--name", default="points")
    p.add_argument("--row-id", default="row_id")
    p.add_argument("--label", default="y")
    p.add_argument("--x", default="x", help="an array column, or number columns separated by commas")
    p.add_argument("--client", default="client", help="the column of clients where --split is own")
    p.add_argument("--split", default="own", choices=["own", "ids", "labels", "dirichlet"])
    p.add_argument("--start", default="drawn", choices=["drawn", "first", "classes", "greedy"])
    p.add_argument("--scale", action="store_true", help="standard scores of number columns")
    for name, kind, value in (("clients", int, 10), ("per-client", int, 2), ("alpha", float, 0.1), ("k", int, 4), ("seed", int, 0), ("rounds", int, P.rounds), ("steps", int, P.local_steps), ("m", float, P.m), ("fraction", float, 1.0)):
        p.add_argument(f"--{name}", type=kind, default=value)
    p.add_argument("--only", help="cells (with groups) or rules, separated by commas")
    return p


def load(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Points with their clients: rows without a number in a column are left out."""
    t, columns = spark.read.parquet(a.points), a.x.split(",")
    client = F.col(a.client).cast("int") if a.split == "own" else F.lit(0)
    if len(columns) == 1 and dict(t.dtypes)[columns[0]].startswith("array"):
        p = t.select(F.col(a.row_id).cast("long").alias("row_id"), client.alias("client"), F.col(columns[0]).cast("array<double>").alias("x"), F.col(a.label).alias("y"))
    else:
        t = t.dropna(subset=columns)
        t = pts.standard_scaled(t, columns) if a.scale else t
        p = pts.from_columns(t, F.col(a.row_id).cast("long"), client, F.col(a.label), columns)
    return pts.split_points(p.where("x is not null"), a.split, a.clients, a.seed, a.per_client, a.alpha)


def first_prototypes(p: DataFrame, a: argparse.Namespace) -> np.ndarray:
    if a.start == "classes":
        return starts.class_means(p)
    if a.start == "greedy":
        return starts.greedy_starts(p, a.k, 1, a.seed)[0]
    if a.start == "first":
        return np.array([r["v"] for r in kernel.first_rows(p, a.k).orderBy("j").collect()])
    return starts.drawn_rows(p, a.k, a.seed)


def rule(name: str, a: argparse.Namespace, **sizes):
    """A function of a federation that runs the rule."""
    if name == "cfcm":
        return lambda f: fed.fcm(f.back, f.v0, a.m, 150)
    if name == "pedrycz":
        step = sizes.get("step", SIZES["pedrycz"][0])
        return lambda f: fed.gradient(f.back, f.v0, step, a.m, a.rounds, a.steps)
    if name == "scffcm":
        local, whole = sizes.get("eta_l", SIZES["scffcm"][0]), sizes.get("eta_g", SIZES["scffcm"][1])
        return lambda f: clientstate.run(f.store, clientstate.Variates(local, whole, a.steps, a.m), f.v0, a.rounds, a.fraction, a.seed)
    made = {
        "F-FCM": clientstate.Tracks(a.steps, a.m), "FedProx-FCM": clientstate.Tracks(a.steps, a.m, prox=0.1), "Ditto-FCM": clientstate.Tracks(a.steps, a.m, ditto=0.1),
        "GF-PFedFCM": clientstate.Cell(steps=a.steps, m=a.m), "PFedFCM(no-footprint)": clientstate.Cell(gate="none", steps=a.steps, m=a.m, fixed_relevance=0.5), "Stallmann-avg2": clientstate.Pooled(a.steps, a.m, seed=a.seed),
    }
    if name not in made:
        raise ValueError(f"unknown rule {name}; known are {['cfcm', 'pedrycz', 'scffcm', *made]}")
    return lambda f: clientstate.run(f.store, made[name], f.v0, a.rounds, a.fraction, a.seed)


def rows_of(f: table_runs.Federation, a: argparse.Namespace) -> DataFrame:
    some = [s for s in (a.only or "").split(",") if s]
    if a.command == "cells":
        return table_runs.cells(f, parse_cells(a.only), a.rounds, a.steps, a.m)
    if a.command in ("rules", "methods"):
        names = some or (["cfcm", "pedrycz", "scffcm"] if a.command == "rules" else ["F-FCM", "GF-PFedFCM", "PFedFCM(no-footprint)", "FedProx-FCM", "Ditto-FCM", "Stallmann-avg2"])
        return table_runs.rules(f, {n: rule(n, a) for n in names}, a.m)
    if a.command == "calibrate":
        name = (some or ["pedrycz"])[0]
        grid = table_runs.grid(f, GRIDS[name], lambda f, **sizes: rule(name, a, **sizes)(f), 150, a.m)
        if name == "pedrycz":
            return statistics.calibrated(grid)
        picks = statistics.calibrated(grid.withColumn("step", F.col("grid_idx").cast("double")))
        return picks.join(grid.select("dataset", F.col("grid_idx").cast("double").alias("step"), "eta_l", "eta_g"), ["dataset", "step"])
    if a.command == "audit":
        return table_runs.audit(f, a.m, 300, 10, a.seed)
    return table_runs._all([table_runs.descent(f, mass, "none", a.steps, a.rounds, a.m) for mass in ("pre", "post")])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    p = load(spark, a).persist()
    f = table_runs.Federation(a.name, p, first_prototypes(p, a))
    try:
        settings = {k: F.lit(v) for k, v in (("seed", a.seed), ("rounds", a.rounds), ("L", a.steps), ("participation", a.fraction))}
        rows = rows_of(f, a)
        relation.replace_results([rows.withColumns({k: v for k, v in settings.items() if k not in rows.columns})], a.out, ["dataset"])
        relation.write_report(spark, f"{a.out}.meta", json.dumps({"args": vars(a), "code": jobs.code_digests()}), "overwrite")
    finally:
        f.close()
        p.unpersist()


if __name__ == "__main__":
    main()
