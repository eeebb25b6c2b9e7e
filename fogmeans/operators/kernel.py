"""Fuzzy c-means as DataFrame expressions: array columns, no Python, partial aggregation before every shuffle.

points: client, row_id, x array<double>, y. centers: j, v array<double> (at most some dozens of rows, so broadcast).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import EPS

#: Centres are broadcast up to this many; the kernel refuses more instead of broadcasting without a bound.
MOST_CENTERS = 10_000


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, t: s + t)


def first_rows(points: DataFrame, k: int) -> DataFrame:
    """Centres from the k points with the smallest row_id."""
    top = points.orderBy("row_id").limit(k)
    return top.select((F.row_number().over(Window.orderBy("row_id")) - 1).alias("j"), F.col("x").alias("v"))


def centers_frame(spark: SparkSession, centers: np.ndarray) -> DataFrame:
    return _local(spark, [(j, [float(t) for t in v]) for j, v in enumerate(centers)])


def _local(spark: SparkSession, rows: list[tuple[int, list[float]]]) -> DataFrame:
    if len(rows) > MOST_CENTERS:
        raise ValueError(f"more than {MOST_CENTERS} centres: they are broadcast")
    out = spark.createDataFrame(rows, "j int, v array<double>")
    out.center_dim = len(rows[0][1]) if rows else 0
    return out


def settled(centers: DataFrame) -> DataFrame:
    """``centers`` as a local table of at most MOST_CENTERS rows; more are refused, not broadcast.

    Every operator below begins with this, so a round runs once and its plan does not hold the rounds before it: ten chained
    rounds scan the points as often as one. Centres made by centers_frame() or by this are taken as they are.
    """
    if hasattr(centers, "center_dim"):
        return centers
    rows = centers.select("j", "v").limit(MOST_CENTERS + 1).collect()
    return _local(centers.sparkSession, [(r["j"], list(r["v"])) for r in rows])


def with_centers(points: DataFrame, centers: DataFrame) -> DataFrame:
    """``points`` with column cs: all centres in order of j. One row is broadcast and no row is multiplied."""
    packed = settled(centers).agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("cs"))
    return points.crossJoin(F.broadcast(packed))


def distances(points: DataFrame, centers: DataFrame) -> DataFrame:
    """``points`` with d2 array<double>, the squared distance to each centre."""
    return with_centers(points, centers).withColumn("d2", F.transform("cs", lambda c: squared_distance(F.col("x"), c["v"]))).drop("cs")


def membership(d2: Column, m: float) -> Column:
    """Memberships from squared distances; a point on centres belongs to them in equal parts."""
    if m <= 1:
        raise ValueError("the fuzzifier must be over 1")
    zeros = F.aggregate(d2, F.lit(0.0), lambda s, d: s + F.when(d <= EPS, 1.0).otherwise(0.0))
    power = lambda d: F.pow(F.greatest(d, F.lit(EPS)), F.lit(-1.0 / (m - 1)))
    total = F.aggregate(d2, F.lit(0.0), lambda s, d: s + power(d))
    return F.when(zeros > 0, F.transform(d2, lambda d: F.when(d <= EPS, 1.0 / zeros).otherwise(0.0))).otherwise(F.transform(d2, lambda d: power(d) / total))


def memberships(points: DataFrame, centers: DataFrame, m: float = 2.0) -> DataFrame:
    """``points`` with d2 and u."""
    return distances(points, centers).withColumn("u", membership(F.col("d2"), m))


def long_form(rows: DataFrame, m: float = 2.0) -> DataFrame:
    """memberships() with a row for each (point, centre): j, d2, u, w = u**m."""
    zipped = F.arrays_zip(F.col("d2"), F.col("u"))
    keep = [c for c in rows.columns if c not in ("d2", "u")]
    return rows.select(*keep, F.posexplode(zipped).alias("j", "z")).select(*keep, "j", F.col("z.d2").alias("d2"), F.col("z.u").alias("u"), F.pow("z.u", F.lit(m)).alias("w"))


def vector_sums(rows: DataFrame, keys: list[str], weight: Column, dim: int, *more: Column) -> DataFrame:
    """sum(weight * x) for each key as array s, and sum(weight) as mass: one map-side combined aggregation, no explode of x."""
    sums = [F.sum(weight * F.get("x", F.lit(d))).alias(f"s{d}") for d in range(dim)]
    return rows.groupBy(*keys).agg(F.sum(weight).alias("mass"), *sums, *more).withColumn("s", F.array(*[f"s{d}" for d in range(dim)])).drop(*[f"s{d}" for d in range(dim)])


def dimension(points: DataFrame) -> int:
    row = points.select(F.size("x").alias("n")).head()
    return row["n"] if row else 0


def update_centers(points: DataFrame, centers: DataFrame, m: float = 2.0) -> DataFrame:
    """j, v: weighted means; a centre without mass keeps its place."""
    centers = settled(centers)
    sums = vector_sums(long_form(memberships(points, centers, m), m), ["j"], F.col("w"), centers.center_dim)  # a row a centre
    new = F.when(F.col("mass") > EPS, F.transform("s", lambda t: t / F.col("mass"))).otherwise(F.col("v"))
    return centers.join(F.broadcast(sums), "j", "left").select("j", F.coalesce(new, F.col("v")).alias("v"))


def objective(points: DataFrame, centers: DataFrame, m: float = 2.0) -> DataFrame:
    rows = memberships(points, centers, m)
    term = F.aggregate(F.zip_with("u", "d2", lambda u, d: F.pow(u, F.lit(m)) * d), F.lit(0.0), lambda s, t: s + t)
    return rows.agg(F.sum(term).alias("objective"))


def client_objective(points: DataFrame, centers: DataFrame, m: float = 2.0) -> DataFrame:
    """client, n, beta (its share of the rows), objective."""
    rows = memberships(points, centers, m)
    term = F.aggregate(F.zip_with("u", "d2", lambda u, d: F.pow(u, F.lit(m)) * d), F.lit(0.0), lambda s, t: s + t)
    one = rows.groupBy("client").agg(F.count("*").alias("n"), F.sum(term).alias("objective"))
    total = one.agg(F.sum("n").alias("__all"))
    return one.crossJoin(F.broadcast(total)).withColumn("beta", F.col("n") / F.col("__all")).drop("__all")  # one row


def weighted_objective(points: DataFrame, centers: DataFrame, m: float = 2.0) -> DataFrame:
    """The clients' objectives, weighted by their shares of the rows."""
    return client_objective(points, centers, m).agg(F.sum(F.col("beta") * F.col("objective")).alias("objective"))


def hard_labels(points: DataFrame, centers: DataFrame) -> DataFrame:
    """``points`` with pred: the nearest centre, ties (and coincident centres) to the smallest j."""
    d = F.transform(F.col("d2"), lambda x: F.greatest(x, F.lit(EPS)))
    return distances(points, centers).withColumn("pred", (F.array_position(d, F.array_min(d)) - 1).cast("int")).drop("d2")


def local_sums(points: DataFrame, centers: DataFrame, m: float = 2.0) -> DataFrame:
    """client, j, mass, s, share (of all points): what a client sends in a round of one step."""
    centers = settled(centers)
    rows = long_form(memberships(points, centers, m), m)
    sums = vector_sums(rows, ["client", "j"], F.col("w"), centers.center_dim, F.count("*").alias("n"))
    return sums.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("j")))


def server_step(sums: DataFrame, centers: DataFrame, gate: Column | None = None, lr: float = 0.75, weight: Column | None = None) -> DataFrame:
    """j, v: damped weighted mean of the clients' local centres. ``weight`` defaults to share * mass * gate."""
    w = F.col("share") * F.col("mass") if weight is None else weight
    w = w * (F.lit(1.0) if gate is None else gate)
    centers = settled(centers)
    dim = centers.center_dim
    local = F.when(F.col("mass") > EPS, F.transform("s", lambda t: t / F.col("mass")))
    rows = sums.join(F.broadcast(centers), "j").withColumn("x", F.coalesce(local, F.col("v"))).withColumn("w", w)
    target = vector_sums(rows, ["j"], F.col("w"), dim)
    damped = F.when(F.col("mass") > EPS, F.zip_with("v", F.transform("s", lambda t: t / F.col("mass")), lambda a, b: (1 - lr) * a + lr * b)).otherwise(F.col("v"))
    return centers.join(F.broadcast(target), "j").select("j", damped.alias("v"))


def moments(points: DataFrame, *by: str) -> DataFrame:
    """Of each group: n, mean array<double> and cov array<double>, the lower triangle of the sample covariance of x by rows.

    A task adds up its batches in matrix products and sends one row of d (d + 3) / 2 + 1 numbers a group it saw; they are
    summed by number. Sums are taken about one row of the table, so that large means don't eat the digits.
    """
    top = points.select("x").head()
    shift = np.array(top["x"] if top else [])
    d = len(shift)
    low = np.tril_indices(d)
    kinds = dict(points.dtypes)
    keys = "".join(f"`{b}` {kinds[b]}, " for b in by)

    def add(batches):
        import pandas as pd

        total: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, g in pdf.groupby(list(by), dropna=False) if by else [((), pdf)]:
                if len(g):
                    z = np.stack(g["x"].to_list()) - shift
                    total[key] = total.get(key, 0.0) + np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z)[low]])
        if total:
            yield pd.DataFrame([(*k, t.tolist()) for k, t in total.items()], columns=[*by, "flat"])

    rows = points.select(*by, "x").mapInPandas(add, f"{keys}flat array<double>").select(*by, F.posexplode("flat").alias("i", "s"))
    sums = rows.groupBy(*by, "i").agg(F.sum("s").alias("s")).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda t: t["s"]).alias("flat"))

    def finish(batches):
        for pdf in batches:
            n, mean, cov = [], [], []
            for flat in pdf["flat"]:
                k, z, zz = flat[0], flat[1 : d + 1], flat[d + 1 :]
                n.append(int(k))
                mean.append((z / k + shift).tolist())
                cov.append(((zz - np.outer(z, z)[low] / k) / (k - 1) if k > 1 else np.full(len(zz), np.nan)).tolist())
            yield pdf.drop(columns="flat").assign(n=n, mean=mean, cov=cov)

    return sums.mapInPandas(finish, f"{keys}n long, mean array<double>, cov array<double>")
