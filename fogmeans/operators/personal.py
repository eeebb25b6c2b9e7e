"""Memberships and metrics where every client has prototypes of its own, and accuracy of held-out rows.

points: client, row_id, x, y. personal: client, cs array<struct<j, v>>, one row a client. The two are joined by client: the
optimizer broadcasts a small ``personal``, and a client with very many rows is split by the adaptive skew join. A point whose
client has no prototypes is left out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EPS
from ..functions.numeric import first_matching
from ..sources.shared import deleted, written
from . import kernel, metrics


def memberships(points: DataFrame, personal: DataFrame, m: float = 2.0) -> DataFrame:
    """``points`` with d2 and u under their client's prototypes, in the order of ``cs``."""
    rows = points.join(personal.select("client", "cs"), "client")
    rows = rows.withColumn("d2", F.transform("cs", lambda c: kernel.squared_distance(F.col("x"), c["v"]))).drop("cs")
    return rows.withColumn("u", kernel.membership(F.col("d2"), m))


def packed(centers: DataFrame) -> DataFrame:
    """client, cs from rows (client, j, v)."""
    return centers.groupBy("client").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("cs"))  # k rows a client


def own_sums(points: DataFrame, personal: DataFrame, dim: int, m: float = 2.0) -> DataFrame:
    """client, j, mass, s, cost, n: what each client's rows add up to under its own prototypes; combined map-side."""
    rows = kernel.long_form(memberships(points, personal, m), m)
    return kernel.vector_sums(rows, ["client", "j"], F.col("w"), dim, F.sum(F.col("w") * F.col("d2")).alias("cost"), F.count("*").alias("n"))


def assigned(points: DataFrame, personal: DataFrame, m: float = 2.0) -> DataFrame:
    """``points`` with pred (the nearest prototype, ties to the first), cost and entropy of each point under its client's set."""
    rows = memberships(points, personal, m)
    d = F.transform("d2", lambda t: F.greatest(t, F.lit(EPS)))
    cost = F.aggregate(F.zip_with("u", "d2", lambda u, t: F.pow(u, F.lit(m)) * t), F.lit(0.0), lambda s, t: s + t)
    entropy = F.aggregate("u", F.lit(0.0), lambda s, u: s - u * F.ln(F.greatest(u, F.lit(1e-300))))
    out = rows.withColumn("pred", (F.array_position(d, F.array_min(d)) - 1).cast("int")).withColumn("cost", cost).withColumn("entropy", entropy).withColumn("k", F.size("u"))
    return out.drop("d2", "u")


def cells(rows: DataFrame, *by: str) -> DataFrame:
    """``by``, y, pred, n, cost, entropy, k: all the metrics need of assigned() rows, written to the shared folder."""
    return written(rows.groupBy(*by, "y", "pred").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"), F.sum("entropy").alias("entropy"), F.max("k").alias("k")), "metric-cells")


def bundle(points: DataFrame, personal: DataFrame, centers: DataFrame, m: float = 2.0) -> DataFrame:
    """One row: min_dist and xb of the shared ``centers``; mean_acc, worst_acc, fcm_obj, gacc and hnorm under each client's own.

    gacc matches all clients' clusters to labels at once, mean_acc and worst_acc each client's alone; fcm_obj is the mean
    objective of a point, hnorm its mean entropy over ln k. The points are read twice: for the own sets and the shared ones.
    Prototypes that are not finite make all seven NaN. No points give nulls.
    """
    names = ("min_dist", "mean_acc", "worst_acc", "fcm_obj", "gacc", "xb", "hnorm")
    centers = kernel.settled(centers)
    odd = personal.where(F.exists("cs", lambda c: F.exists(c["v"], lambda t: F.isnan(t) | (F.abs(t) == math.inf) | t.isNull()))).limit(1).count()
    if odd or centers.where(F.exists("v", lambda t: F.isnan(t) | (F.abs(t) == math.inf))).limit(1).count():
        return points.sparkSession.createDataFrame([(math.nan,) * 7], ", ".join(f"{n} double" for n in names))
    t = cells(assigned(points, personal, m), "client")
    one = t.agg((F.sum("cost") / F.sum("n")).alias("fcm_obj"), (F.sum("entropy") / F.sum("n") / F.ln(F.max("k").cast("double"))).alias("hnorm"))
    each = metrics.matched(t.select("client", "y", "pred", "n"), "client").agg(F.avg("acc").alias("mean_acc"), F.min("acc").alias("worst_acc"))
    pooled = metrics.matched(t.groupBy("y", "pred").agg(F.sum("n").alias("n"))).agg(F.max("acc").alias("gacc"))
    shared = metrics.xie_beni(points, centers, m).crossJoin(metrics.min_center_distance(centers))
    out = written(one.crossJoin(each).crossJoin(pooled).crossJoin(shared).select(*names), "metric-bundle")  # one row each
    deleted(t)
    return out


def davies_bouldin(rows: DataFrame) -> DataFrame:
    """client, davies_bouldin of assigned() rows: the mean over a client's clusters of the worst (scatter + scatter) / separation.

    Clusters are the points' own groups, not the prototypes; null unless a client has 2 to n - 1 of them. Centroids are sums
    of each (client, cluster), joined to the points by client and cluster; pairs of one client's clusters are k * k rows.
    """
    by = ["client", "pred"]
    each = rows.select(*by, F.posexplode("x").alias("i", "t")).groupBy(*by, "i").agg(F.avg("t").alias("t"), F.count("*").alias("n"))
    cent = each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda z: z["t"]).alias("c"), F.max("n").alias("n"))  # one number a dimension
    away = rows.select(*by, "x").join(cent.select(*by, "c"), by).groupBy(*by).agg(F.avg(F.sqrt(kernel.squared_distance(F.col("x"), F.col("c")))).alias("s"))
    s = cent.join(away, by)
    o = s.select("client", F.col("pred").alias("p2"), F.col("s").alias("s2"), F.col("c").alias("c2"))
    worst = s.join(o, "client").where("pred <> p2").withColumn("r", F.try_divide(F.col("s") + F.col("s2"), F.sqrt(kernel.squared_distance(F.col("c"), F.col("c2")))))
    mean = worst.groupBy("client", "pred").agg(F.max("r").alias("r")).groupBy("client").agg(F.avg("r").alias("r"))
    n = cent.groupBy("client").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    return n.join(mean, "client", "left").select("client", F.when((F.col("k") > 1) & (F.col("k") < F.col("n")), F.col("r")).alias("davies_bouldin"))


def client_validity(points: DataFrame, personal: DataFrame, m: float = 2.0, ratio: float = metrics.COLLAPSE) -> DataFrame:
    """A row a client, under its own prototypes: fpc, partition_entropy, xie_beni, davies_bouldin, min_center_distance,
    collapse_threshold, collapsed_pairs, prototype_mass_entropy, effective_prototypes, underused_prototypes.

    What needs two prototypes is null for a client with one, xie_beni also where two coincide, the masses' numbers where there
    is no mass. Points are read for the sums and for the clusters; everything else has a row a client.
    """
    rows = memberships(points, personal, m)
    u2 = F.aggregate("u", F.lit(0.0), lambda s, u: s + u * u)
    h = F.aggregate("u", F.lit(0.0), lambda s, u: s - u * F.ln(F.greatest(u, F.lit(EPS))))
    cost = F.aggregate(F.zip_with("u", "d2", lambda u, d: F.pow(u, F.lit(m)) * d), F.lit(0.0), lambda s, t: s + t)
    one = rows.groupBy("client").agg(F.avg(u2).alias("fpc"), F.avg(h).alias("partition_entropy"), F.avg(cost).alias("cost"))
    mass = kernel.long_form(rows, m).groupBy("client", "j").agg(F.sum("w").alias("w"))
    p = F.transform("ws", lambda w: F.try_divide(w, F.aggregate("ws", F.lit(0.0), lambda s, t: s + t)))
    used = mass.groupBy("client").agg(F.collect_list("w").alias("ws")).withColumn("p", p)  # k numbers a client
    raw = F.aggregate("p", F.lit(0.0), lambda s, t: s - t * F.ln(F.greatest(t, F.lit(EPS))))
    many = F.size("p") > 1
    used = used.select("client", F.when(many, raw / F.ln(F.size("p").cast("double"))).alias("prototype_mass_entropy"), F.when(many, F.exp(raw)).alias("effective_prototypes"), F.when(many, F.size(F.filter("p", lambda t: t < 0.01))).alias("underused_prototypes"))
    scale = points.select("client", F.posexplode("x").alias("i", "t")).groupBy("client", "i").agg(F.var_pop("t").alias("v")).groupBy("client").agg(F.sqrt(F.sum("v")).alias("scale"))
    pairs = F.flatten(F.transform("cs", lambda a: F.transform(F.filter("cs", lambda b: b["j"] > a["j"]), lambda b: F.sqrt(kernel.squared_distance(a["v"], b["v"])))))
    gap = personal.select("client", pairs.alias("d")).join(scale, "client").withColumn("collapse_threshold", F.greatest(F.lit(1e-8), F.lit(ratio) * F.col("scale")))
    apart = F.size("d") > 0
    gap = gap.select("client", F.array_min("d").alias("min_center_distance"), F.when(apart, F.col("collapse_threshold")).alias("collapse_threshold"), F.size(F.filter("d", lambda t: t < F.col("collapse_threshold"))).alias("collapsed_pairs"))
    near = F.col("min_center_distance") * F.col("min_center_distance")
    out = one.join(used, "client").join(gap, "client").join(davies_bouldin(assigned(points, personal, m)), "client")
    return out.withColumn("xie_beni", F.when(near > EPS, F.col("cost") / near)).drop("cost")


def label_maps(table: DataFrame, *by: str) -> DataFrame:
    """``by``, pred, name: the label of each cluster in the matching with most agreement on a contingency table (``by``, y, pred, n).

    As many pairs as the fewer of clusters and labels; of equal matchings the one whose labels, in order of clusters, come
    first. Clusters that remain without a label have no row.
    """
    kinds = dict(table.dtypes)

    def match(key, pdf):
        t = pdf.pivot_table(index="pred", columns="y", values="n", aggfunc="sum", fill_value=0)
        found = first_matching(t.to_numpy().astype(np.int64))
        rows = [(*key, t.index[i], t.columns[j]) for i, j in enumerate(found) if j >= 0]
        return pd.DataFrame(rows, columns=[*by, "pred", "name"])

    fields = ", ".join([*[f"{b} {kinds[b]}" for b in by], f"pred {kinds['pred']}", f"name {kinds['y']}"])
    return table.groupBy(*[F.col(b) for b in by]).applyInPandas(match, fields)


def mapped_accuracy(train: DataFrame, test: DataFrame, *by: str) -> DataFrame:
    """``by``, acc: the share of ``test`` that agrees when clusters are named on ``train`` (both contingency tables with n).

    Clusters that ``train`` does not name are wrong; groups without test rows have no row. All groups are one plan.
    """
    names = label_maps(train, *by).withColumnRenamed("name", "__name")
    joined = test.join(names, [*by, "pred"], "left")
    return joined.groupBy(*by).agg((F.sum(F.when(F.col("y") == F.col("__name"), F.col("n")).otherwise(0)) / F.sum("n")).alias("acc"))


def held_out(rows: DataFrame) -> DataFrame:
    """One row of eight numbers of the test rows of assigned() points with a boolean column test.

    trmap: clusters are named on the other rows, of all clients (gacc) or of each (mean, worst); refit: on each client's own
    test rows. test_fcm_obj, test_hnorm and test_gacc are those of bundle() on the test rows. A client none of whose clusters
    was named counts 0.
    """
    t = cells(rows, "test", "client")
    train, test = t.where("not test").select("client", "y", "pred", "n"), t.where("test")
    tested = test.select("client", "y", "pred", "n")
    whole = lambda x: x.groupBy("y", "pred").agg(F.sum("n").alias("n"))
    numbers = test.agg((F.sum("cost") / F.sum("n")).alias("test_fcm_obj"), (F.sum("entropy") / F.sum("n") / F.ln(F.max("k").cast("double"))).alias("test_hnorm"))
    both = lambda x, name: x.agg(F.avg("acc").alias(f"test_mean_acc_{name}"), F.min("acc").alias(f"test_worst_acc_{name}"))
    parts = [
        mapped_accuracy(whole(train), whole(tested)).agg(F.max("acc").alias("test_gacc_trmap")),
        both(mapped_accuracy(train, tested, "client"), "trmap"),
        metrics.matched(whole(tested)).agg(F.max("acc").alias("test_gacc")),
        both(metrics.matched(tested, "client"), "refit"),
    ]
    for part in parts:
        numbers = numbers.crossJoin(part)  # one row each
    out = written(numbers, "held-out")
    deleted(t)
    return out
