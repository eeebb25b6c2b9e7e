"""Relevance gates of (client, centre) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import EPS, Protocol
from ..sources.shared import deleted, written
from . import kernel

P = Protocol()
#: Values of a group that are counted one by one, at most, unless they are equal; passes over the bins, at most (doubles have no finer ranges then).
FEW = 100_000
MOST_PASSES = 8


def clipped(value: Column, floor: float = P.min_relevance) -> Column:
    """Value over the client's largest, clipped to [floor, 1]; all at the floor where the largest is nothing."""
    top = F.max(value).over(Window.partitionBy("client"))
    return F.when(top > EPS, F.least(F.lit(1.0), F.greatest(F.lit(floor), value / top))).otherwise(F.lit(floor))


def mass_gate(sums: DataFrame, floor: float = P.min_relevance) -> DataFrame:
    return sums.withColumn("gate", clipped(F.col("mass"), floor))


def masked(gate: Column, floor: float = P.min_relevance) -> Column:
    return F.when(gate > floor, F.lit(1.0)).otherwise(F.lit(floor))


def quantiles(rows: DataFrame, by: list[str], value: str, q: float, bins: int = 16_384, few: int = FEW) -> DataFrame:
    """``by``, n, quantile: the exact linear quantile of each group, without holding a group's values in one place.

    A pass counts each group in ``bins`` equal bins of the range that still holds the two ranks in question and keeps the
    bins they fall into. Passes go on until no group has more than ``few`` values left (one far value puts nearly all into
    one bin of the first pass) or its values left are equal; these are counted value by value. Counts are combined map-side.
    Groups are joined as rows, so their number has no bound; each pass's ranges are written to the shared folder. Nulls are
    left out.
    """
    v = F.col(value)
    rows = rows.where(v.isNotNull()).select(*by, v.alias("__v"))
    at = (F.col("n") - 1) * F.lit(q)
    found = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    found = found.withColumn("first", F.floor(at).cast("long")).withColumn("second", F.least(F.col("first") + 1, F.col("n") - 1)).withColumn("part", at - F.col("first")).withColumn("skipped", F.lit(0).cast("long"))
    keep, old = ["n", "first", "second", "part"], []
    run = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    for _ in range(MOST_PASSES):
        place = F.floor((F.col("__v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int")
        inside = rows.join(found, by).where((F.col("__v") >= F.col("lo")) & (F.col("__v") <= F.col("hi"))).withColumn("__b", F.when(F.col("hi") > F.col("lo"), F.least(place, F.lit(bins - 1))).otherwise(0))
        each = inside.groupBy(*by, "__b").agg(F.count("*").alias("c"), F.min("__v").alias("l"), F.max("__v").alias("h"), *[F.first(k).alias(k) for k in [*keep, "skipped"]])
        each = each.withColumn("upto", F.col("skipped") + F.sum("c").over(run))
        holds = lambda rank: (F.col("upto") > F.col(rank)) & (F.col("upto") - F.col("c") <= F.col(rank))
        found = each.groupBy(*by).agg(*[F.first(k).alias(k) for k in keep], F.min(F.when(holds("first"), F.col("l"))).alias("lo"), F.max(F.when(holds("second"), F.col("h"))).alias("hi"), F.min(F.when(holds("first"), F.col("upto") - F.col("c"))).alias("skipped"), F.sum(F.when(holds("first") | holds("second"), F.col("c"))).alias("left"))
        found = written(found, "quantile-ranges")
        old.append(found)
        if (found.where("hi > lo").agg(F.max("left").alias("m")).head()["m"] or 0) <= few:
            break
    found = found.drop("left")
    inside = rows.join(found, by).where((F.col("__v") >= F.col("lo")) & (F.col("__v") <= F.col("hi")))
    each = inside.groupBy(*by, F.col("__v").alias("__b")).agg(F.count("*").alias("c"), *[F.first(k).alias(k) for k in [*keep, "skipped"]])
    each = each.withColumn("upto", F.col("skipped") + F.sum("c").over(run))
    pick = lambda rank: F.min(F.when(F.col("upto") > F.col(rank), F.col("__b")))
    ends = each.groupBy(*by).agg(F.first("n").alias("n"), F.first("part").alias("part"), pick("first").alias("a"), pick("second").alias("b"))
    out = written(ends.select(*by, "n", (F.col("a") + F.col("part") * (F.col("b") - F.col("a"))).alias("quantile")), "quantiles")
    deleted(*old)
    return out


def footprint(points: DataFrame, centers: DataFrame, m: float = P.m, grid: int = P.grid, quantile: float = P.quantile) -> DataFrame:
    """client, j, footprint, rho, radius: the largest coverage times specificity over a grid of radii; the first maximum wins.

    rho is the radius as a share of the largest one.
    Each row is put in the bin of the smallest radius that covers it, so a client's rows are aggregated once into at most
    ``grid`` bins; a running sum over bins replaces the range join of rows with radii.
    """
    centers = kernel.settled(centers)
    by = ["client", "j"]
    # read five times: for the ranges, the bins, what is left of them, and the radii
    rows = written(kernel.long_form(kernel.memberships(points, centers, m), m).select(*by, F.sqrt("d2").alias("dist"), "w"), "footprint-rows")
    top = quantiles(rows, by, "dist", quantile)
    found, top = top, top.select(*by, F.greatest("quantile", F.lit(EPS)).alias("top"), "n")
    radius = lambda g: F.col("top") * g / F.lit(float(grid - 1))
    near = F.ceil(F.col("dist") / F.col("top") * (grid - 1)).cast("int")
    # the float radii decide at the edges, as in a comparison of each distance with each radius
    g = F.when(radius(near - 1) >= F.col("dist"), near - 1).when(radius(near) >= F.col("dist"), near).otherwise(near + 1)
    binned = rows.join(top, by).withColumn("g", F.greatest(F.lit(0), g)).where(F.col("g") < grid)
    sums = binned.groupBy(*by, "g").agg(F.sum("w").alias("w"))
    all_g = top.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).join(sums, [*by, "g"], "left")
    run = Window.partitionBy(*by).orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    value = F.sum(F.coalesce("w", F.lit(0.0))).over(run) / F.col("n") * (1 - F.col("g") / F.lit(float(grid - 1)))
    scored = all_g.withColumn("value", value).withColumn("r", radius(F.col("g"))).withColumn("rho", F.col("g") / F.lit(float(grid - 1)))
    best = scored.groupBy(*by).agg(F.max_by(F.struct("value", "r", "rho"), F.struct("value", -F.col("g"))).alias("b"))
    out = written(best.select(*by, F.col("b.value").alias("footprint"), *[F.when(F.col("b.value") > 0, F.col(f"b.{c}")).otherwise(0.0).alias(name) for c, name in (("rho", "rho"), ("r", "radius"))]), "footprints")
    deleted(rows, found)
    return out


def footprint_gate(points: DataFrame, centers: DataFrame, m: float = P.m, floor: float = P.min_relevance) -> DataFrame:
    return footprint(points, centers, m).withColumn("gate", clipped(F.col("footprint"), floor))


def relevance_stats(gates: DataFrame, low: float = 0.2) -> DataFrame:
    g = F.col("gate")
    return gates.agg(F.avg(g).alias("mean"), F.stddev_pop(g).alias("std"), F.min(g).alias("min"), F.max(g).alias("max"), F.avg((g <= low).cast("double")).alias("low_share"))


def gate_correlation(gates: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson and Spearman of two gate columns over all pairs; null where one is constant."""
    w = lambda c: (F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2).cast("double")  # noqa: E731  mid-ranks; one row a client and centre
    r = gates.withColumn("ra", w(a)).withColumn("rb", w(b))
    flat = lambda c: F.stddev_pop(c) > EPS
    both = lambda x, y: F.when(flat(x) & flat(y), F.corr(x, y))
    return r.agg(both(a, b).alias("pearson"), both("ra", "rb").alias("spearman"))
