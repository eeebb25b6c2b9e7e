"""Distances between all points, and rows of one feature view found again in another."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import block_pairs, delete_path, deleted, filed, part_of, written
from . import kernel
from .ranks import numbered

#: Points of a block, and rows of a block compared at a time.
BLOCK = 8192
STRIP = 512
#: Projections whose cells must agree before two rows are compared, and the width of a cell in tolerances.
PROJECTIONS = 3
CELL = 1e4


def pair_distances(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row: n (pairs), mean, std and ratio (mean / std) of the distances between all points.

    Points are dealt to blocks by hash, each block is written once, and a task opens two blocks and returns three sums, so the
    work is all pairs but nothing else is multiplied. Null x is left out; fewer than two points give no pairs and nulls.
    """
    rows = points.where("x is not null")
    n = rows.count()
    spark = points.sparkSession
    blocks = max(1, -(-n // block))
    # distances don't change when the centre is taken off; the products lose fewer digits then
    center = np.array([r["m"] for r in rows.select(F.posexplode("x").alias("d", "t")).groupBy("d").agg(F.avg("t").alias("m")).orderBy("d").collect()])
    path = filed(rows.select("x", F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int").alias("block")).repartition(blocks, "block"), "block", "points")

    def of(b: int) -> np.ndarray:
        t = part_of(path, "block", b, ["x"])
        return np.array(t["x"].combine_chunks().flatten()).reshape(t.num_rows, -1) - center if t.num_rows else np.zeros((0, len(center)))

    def add(batches):
        for batch in batches:
            for i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = of(i)
                b = a if i == j else of(j)
                bb = (b * b).sum(axis=1)
                n = s = ss = 0.0
                for k in range(0, len(a), STRIP):
                    some = a[k : k + STRIP]
                    d2 = np.maximum((some * some).sum(axis=1)[:, None] + bb - 2 * some @ b.T, 0.0)
                    if i == j:
                        d2 = d2[np.triu(np.ones(d2.shape, bool), k + 1)]
                    n, s, ss = n + d2.size, s + np.sqrt(d2).sum(), ss + d2.sum()
                yield pa.RecordBatch.from_arrays([pa.array([float(t)]) for t in (n, s, ss)], names=["n", "s", "ss"])

    pairs = block_pairs(spark, [(i, 0, i) for i in range(blocks)], min(20_000, blocks * (blocks + 1) // 2))
    sums = pairs.mapInArrow(add, "n double, s double, ss double").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")])
    mean = F.try_divide("s", "n")
    std = F.sqrt(F.greatest(F.try_divide("ss", "n") - mean * mean, F.lit(0.0)))
    out = written(sums.select(F.col("n").cast("long").alias("n"), mean.alias("mean"), std.alias("std"), F.try_divide(mean, std).alias("ratio")), "pair-distances")
    delete_path(spark, path)
    return out


def _classes(view: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): row_id, place among the rows of equal x; x of each class with its smallest row_id."""
    rows = numbered(view.where("x is not null").select("row_id", "x"), ["x", "row_id"], "number")
    classes = rows.groupBy("x").agg(F.min("number").alias("first"), F.count("*").alias("n"))
    return rows, written(classes, name)


def same_rows(a: DataFrame, b: DataFrame, tol: float = 1e-9) -> DataFrame:
    """a_id, b_id: each row of view ``a`` with the row of view ``b`` whose x is equal in every number up to ``tol``; null where there is none.

    Rows of either view that find no partner stay with a null on the other side. Equal rows are one class: classes meet where
    the cells of PROJECTIONS projections of x agree (a projection near the edge of its cell stands in the next one too, so
    none is lost to rounding), are compared number by number, and the i-th row of one class in order of row_id is paired with
    the i-th of the other. Of several classes within ``tol`` the nearest is taken. Views are dealt by cells, never gathered;
    a class of very many rows is numbered in ranges. Rows with a null x have no partner.
    """
    rows_a, of_a = _classes(a, "view-a")
    rows_b, of_b = _classes(b, "view-b")
    dim = max(kernel.dimension(of_a), kernel.dimension(of_b), 1)
    rng = np.random.default_rng(11)
    lines = rng.standard_normal((PROJECTIONS, dim))
    # a projection of two rows within tol differs by this at most, and a cell is much wider
    reach = tol * np.abs(lines).sum(axis=1) * (1 + 1e-6) + 1e-12

    def celled(classes: DataFrame, prefix: str, both: bool) -> DataFrame:
        cells = []
        for w, r in zip(lines, reach, strict=True):
            t = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(z)) for z in w]), lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
            width = float(r * CELL)
            # the row lies in one cell; the other view looks into the neighbour too where it is within reach
            cells.append(F.array_distinct(F.array(*[F.floor((t + F.lit(z)) / width) for z in ((-r, r) if both else (0.0,))])))
        out = classes.select(F.col("x").alias(f"{prefix}x"), F.col("first").alias(f"{prefix}first"), *[c.alias(f"c{i}") for i, c in enumerate(cells)])
        for i in range(PROJECTIONS):
            out = out.withColumn(f"c{i}", F.explode(f"c{i}"))
        return out

    apart = F.aggregate(F.zip_with("ax", "bx", lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, z: F.greatest(s, z))
    met = celled(of_a, "a", False).join(celled(of_b, "b", True), [f"c{i}" for i in range(PROJECTIONS)])
    close = met.where(F.size("ax") == F.size("bx")).withColumn("apart", apart).where(F.col("apart") <= tol).drop(*[f"c{i}" for i in range(PROJECTIONS)])
    best = lambda df, by, other: df.groupBy(by).agg(F.min_by(other, F.struct("apart", other)).alias(other))
    pairs = written(best(close, "afirst", "bfirst").join(best(close, "bfirst", "afirst"), ["afirst", "bfirst"]), "view-pairs")
    left = rows_a.join(of_a.select("x", "first"), "x").select(F.col("row_id").alias("a_id"), F.col("first").alias("afirst"), (F.col("number") - F.col("first")).alias("place"))
    right = rows_b.join(of_b.select("x", "first"), "x").select(F.col("row_id").alias("b_id"), F.col("first").alias("bfirst"), (F.col("number") - F.col("first")).alias("place"))
    named = left.join(pairs, "afirst", "left").withColumn("key", F.coalesce("bfirst", -1 - F.col("afirst"))).join(right.withColumnRenamed("bfirst", "key"), ["key", "place"], "full").select("a_id", "b_id")
    blank = lambda v, i, j: v.where("x is null").select(*[(F.col("row_id") if c == i else F.lit(None)).alias(c) for c in (("a_id", "b_id") if i == "a_id" else (j, i))])
    out = written(named.union(blank(a, "a_id", "b_id")).union(blank(b, "b_id", "a_id")), "same-rows")
    deleted(of_a, of_b, pairs, rows_a, rows_b)
    return out
