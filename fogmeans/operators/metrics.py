"""Clustering metrics over a contingency table, memberships and centres."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import EPS
from ..functions.numeric import best_assignment
from . import kernel


def contingency(labels: DataFrame, *by: str) -> DataFrame:
    return labels.groupBy(*by, "y", "pred").agg(F.count("*").alias("n"))


def accuracy(labels: DataFrame, *by: str) -> DataFrame:
    """acc of each group ``by``: the share of points whose cluster is matched to their label, by the best matching."""
    return matched(contingency(labels, *by), *by)


def matched(table: DataFrame, *by: str) -> DataFrame:
    """accuracy() from a contingency table (``by``, y, pred, n); clusters and labels may differ in number, the surplus is wrong.

    Only contingency tables (classes times clusters) reach Python, one group at a time.
    """
    import numpy as np
    import pandas as pd

    def match(key, pdf):
        t = pdf.pivot_table(index="y", columns="pred", values="n", aggfunc="sum", fill_value=0).to_numpy(float)
        size = max(t.shape)
        full = np.zeros((size, size))
        full[: t.shape[0], : t.shape[1]] = t
        pairs = best_assignment(-full)
        return pd.DataFrame([(*key, float(full[range(size), pairs].sum() / t.sum()))])

    kinds = dict(table.dtypes)
    return table.groupBy(*[F.col(b) for b in by]).applyInPandas(match, ", ".join([*[f"{b} {kinds[b]}" for b in by], "acc double"]))


def nmi_ari(labels: DataFrame, *by: str) -> DataFrame:
    """nmi (arithmetic mean) and ari of each group ``by``, from counts alone."""
    t = contingency(labels, *by)
    n = F.sum("n").over(Window.partitionBy(*by))  # contingency cells only
    t = t.withColumn("a", F.sum("n").over(Window.partitionBy(*by, "y"))).withColumn("b", F.sum("n").over(Window.partitionBy(*by, "pred"))).withColumn("t", n)
    c2 = lambda x: x * (x - 1) / 2
    x = t.groupBy(*by).agg(
        F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"),
        (-F.sum(F.col("n") / F.col("t") * F.ln(F.col("a") / F.col("t")))).alias("hy"),
        (-F.sum(F.col("n") / F.col("t") * F.ln(F.col("b") / F.col("t")))).alias("hp"),
        F.sum(c2(F.col("n"))).alias("idx"),
        F.sum(F.col("n") / F.col("a") * c2(F.col("a"))).alias("sa"),
        F.sum(F.col("n") / F.col("b") * c2(F.col("b"))).alias("sb"),
        c2(F.max("t")).alias("all"),
    )
    nmi = F.when(F.col("hy") + F.col("hp") > 0, 2 * F.col("mi") / (F.col("hy") + F.col("hp"))).otherwise(1.0)
    expected = F.col("sa") * F.col("sb") / F.col("all")
    top = (F.col("sa") + F.col("sb")) / 2 - expected
    return x.select(*by, nmi.alias("nmi"), F.when(F.abs(top) > EPS, (F.col("idx") - expected) / top).otherwise(1.0).alias("ari"))


def label_agreement(labels: DataFrame) -> DataFrame:
    """One row: acc, nmi and ari of all labelled points (pooled_*) and over the clients (mean_client_*, worst_client_*)."""
    names = ("acc", "nmi", "ari")
    whole = accuracy(labels).crossJoin(nmi_ari(labels))  # one row each
    each = accuracy(labels, "client").join(nmi_ari(labels, "client"), "client")
    own = each.agg(*[f(c).alias(f"{w}_client_{c}") for c in names for f, w in ((F.avg, "mean"), (F.min, "worst"))])
    return whole.select(*[F.col(c).alias(f"pooled_{c}") for c in names]).crossJoin(own)


def validity(rows: DataFrame, floor: float = 1e-12) -> DataFrame:
    """fpc, entropy and hnorm of memberships()."""
    u2 = F.aggregate("u", F.lit(0.0), lambda s, u: s + u * u)
    h = F.aggregate("u", F.lit(0.0), lambda s, u: s - u * F.ln(F.greatest(u, F.lit(floor))))
    return rows.agg(F.avg(u2).alias("fpc"), F.avg(h).alias("entropy"), F.avg(h / F.ln(F.size("u").cast("double"))).alias("hnorm"))


def center_pairs(centers: DataFrame) -> DataFrame:
    centers = kernel.settled(centers)
    other = centers.select(F.col("j").alias("l"), F.col("v").alias("w"))
    return centers.join(F.broadcast(other), F.col("j") < F.col("l")).withColumn("d2", kernel.squared_distance(F.col("v"), F.col("w")))


def min_center_distance(centers: DataFrame) -> DataFrame:
    return center_pairs(centers).agg(F.sqrt(F.min("d2")).alias("min_dist"))


def xie_beni(points: DataFrame, centers: DataFrame, m: float = 2.0, skip_coincident: bool = False) -> DataFrame:
    """Objective over n times the smallest squared separation; infinite for coincident centres, unless those are skipped."""
    total = kernel.objective(points, centers, m).crossJoin(points.agg(F.count("*").alias("n")))
    pairs = center_pairs(centers)
    sep = (pairs.where(F.col("d2") > EPS) if skip_coincident else pairs).agg(F.min("d2").alias("sep"))
    xb = F.when(F.col("sep") > 0, F.col("objective") / (F.col("n") * F.col("sep"))).otherwise(F.lit(0.0) if skip_coincident else F.lit(float("inf")))
    return total.crossJoin(sep).select(xb.alias("xb"))


def prototype_diagnostics(points: DataFrame, centers: DataFrame, m: float = 2.0) -> DataFrame:
    """Mass entropy over ln k, effective prototypes exp(H) and prototypes with under 1 % of the mass."""
    mass = kernel.long_form(kernel.memberships(points, centers, m), m).groupBy("j").agg(F.sum("w").alias("mass"))
    s = mass.withColumn("p", F.col("mass") / F.sum("mass").over(Window.partitionBy()))
    h = -F.sum(F.col("p") * F.ln(F.greatest("p", F.lit(1e-12))))
    return s.agg((h / F.ln(F.count("*").cast("double"))).alias("mass_entropy"), F.exp(h).alias("effective"), F.sum((F.col("p") < 0.01).cast("long")).alias("underused"))


#: Two centres are collapsed below this share of the data's scale; of these metrics the smallest client is the worst.
COLLAPSE = 0.03
LOWER_IS_WORSE = ("fpc", "min_center_distance", "prototype_mass_entropy", "effective_prototypes", "acc", "nmi", "ari")


def collapse(points: DataFrame, centers: DataFrame, *by: str, ratio: float = COLLAPSE) -> DataFrame:
    """Of each group ``by``: min_center_distance, collapse_threshold (a share of the root mean square distance from the mean) and collapsed_pairs."""
    centers = kernel.settled(centers)
    sums = [F.var_pop(F.get("x", F.lit(d))) for d in range(centers.center_dim)]
    scale = points.groupBy(*by).agg(F.sqrt(sum(sums[1:], sums[0])).alias("scale")).withColumn("collapse_threshold", F.greatest(F.lit(1e-8), F.lit(ratio) * F.col("scale")))
    apart = center_pairs(centers).agg(F.array_sort(F.collect_list(F.sqrt("d2"))).alias("d"))  # one row of pairs of checked centres
    return scale.crossJoin(F.broadcast(apart)).select(*by, F.array_min("d").alias("min_center_distance"), "collapse_threshold", F.size(F.filter("d", lambda t: t < F.col("collapse_threshold"))).cast("long").alias("collapsed_pairs"))


def client_validity(points: DataFrame, centers: DataFrame, m: float = 2.0) -> DataFrame:
    """client and its fpc, partition_entropy, xie_beni, prototype_mass_entropy, effective_prototypes, underused_prototypes and collapse()."""
    centers = kernel.settled(centers)
    rows = kernel.memberships(points, centers, m)
    u2 = F.aggregate("u", F.lit(0.0), lambda s, u: s + u * u)
    h = F.aggregate("u", F.lit(0.0), lambda s, u: s - u * F.ln(F.greatest(u, F.lit(1e-12))))
    cost = F.aggregate(F.zip_with("u", "d2", lambda u, d: F.pow(u, F.lit(m)) * d), F.lit(0.0), lambda s, t: s + t)
    one = rows.groupBy("client").agg(F.avg(u2).alias("fpc"), F.avg(h).alias("partition_entropy"), F.avg(cost).alias("cost"))
    mass = kernel.long_form(rows, m).groupBy("client", "j").agg(F.sum("w").alias("mass"))
    share = F.col("mass") / F.sum("mass").over(Window.partitionBy("client"))
    raw = -F.sum(F.col("p") * F.ln(F.greatest("p", F.lit(1e-12))))
    used = mass.withColumn("p", share).groupBy("client").agg((raw / F.ln(F.count("*").cast("double"))).alias("prototype_mass_entropy"), F.exp(raw).alias("effective_prototypes"), F.count_if(F.col("p") < 0.01).alias("underused_prototypes"))
    gap = collapse(points, centers, "client")
    xb = F.when(F.pow("min_center_distance", F.lit(2.0)) > EPS, F.col("cost") / F.pow("min_center_distance", F.lit(2.0)))
    return one.join(used, "client").join(gap, "client").withColumn("xie_beni", xb).drop("cost")


def summary(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, mean, worst over the rows, NaN and null left out: the worst is the smallest or the largest value, by metric."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in metrics]))
    good = F.when(~F.isnan("v"), F.col("v"))
    worst = F.when(F.col("metric").isin(*LOWER_IS_WORSE), F.min(good)).otherwise(F.max(good))
    return rows.select(each.alias("x")).select("x.*").groupBy("metric").agg(F.avg(good).alias("mean"), worst.alias("worst"))


def davies_bouldin(labels: DataFrame) -> DataFrame:
    """Mean over clusters of the worst (scatter + scatter) / separation; null unless there are 2 to n - 1 clusters."""
    dim = kernel.dimension(labels)
    cent = kernel.vector_sums(labels, ["pred"], F.lit(1.0), dim).select("pred", F.transform("s", lambda t: t / F.col("mass")).alias("c"), "mass")
    s = labels.join(F.broadcast(cent), "pred").groupBy("pred").agg(F.avg(F.sqrt(kernel.squared_distance(F.col("x"), F.col("c")))).alias("s")).join(cent, "pred")
    o = s.select(F.col("pred").alias("p2"), F.col("s").alias("s2"), F.col("c").alias("c2"))
    r = s.join(o, F.col("pred") != F.col("p2")).withColumn("r", F.try_divide(F.col("s") + F.col("s2"), F.sqrt(kernel.squared_distance(F.col("c"), F.col("c2")))))
    return r.groupBy("pred").agg(F.max("r").alias("r")).agg(F.avg("r").alias("dbi"))


def client_summary(scores: DataFrame) -> DataFrame:
    """Mean, worst and population deviation of per-client scores (column acc)."""
    return scores.agg(F.avg("acc").alias("mean_acc"), F.min("acc").alias("worst_acc"), F.stddev_pop("acc").alias("std_acc"))


def distinct_prototypes(centers: DataFrame, tol: float = 1e-3) -> int:
    """Centres after merging pairs nearer than ``tol``, transitively. ``centers`` is a bounded table of prototypes."""
    near = [(r["j"], r["l"]) for r in center_pairs(centers).where(F.sqrt("d2") < tol).select("j", "l").collect()]
    up = {r["j"]: r["j"] for r in centers.select("j").collect()}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in near:
        up[root(b)] = root(a)
    return len({root(a) for a in up})
