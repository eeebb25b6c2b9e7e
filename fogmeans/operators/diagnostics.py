"""One round of a federation, looked at prototype by prototype: substitution, tilt, clipping, coverage over mass.

state: client, j, share, n, pre, post (masses before and after the local step), r and q (footprint and mass gate), footprint,
c (local centre). It has clients times prototypes rows, whatever the number of points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import EPS, Protocol
from . import gates, kernel

FLOOR = Protocol().min_relevance


def round_state(points: DataFrame, centers: DataFrame, m: float = 2.0) -> DataFrame:
    """The state after one local step from shared centres. Tables of clients times prototypes are joined, not broadcast by force."""
    centers = kernel.settled(centers)
    sums = gates.mass_gate(kernel.local_sums(points, centers, m)).withColumnRenamed("gate", "q")
    local = F.when(F.col("mass") > EPS, F.transform("s", lambda t: t / F.col("mass"))).otherwise(F.col("v"))
    own = sums.join(F.broadcast(centers), "j").select("client", "j", "share", "n", F.col("mass").alias("pre"), "q", local.alias("c"))
    packed = own.groupBy("client").agg(F.array_sort(F.collect_list(F.struct("j", "c"))).alias("cs"))  # k rows a client
    rows = points.join(packed, "client").withColumn("d2", F.transform("cs", lambda t: kernel.squared_distance(F.col("x"), t["c"]))).drop("cs")
    post = kernel.long_form(rows.withColumn("u", kernel.membership(F.col("d2"), m)), m).groupBy("client", "j").agg(F.sum("w").alias("post"))
    foot = gates.footprint_gate(points, centers, m).select("client", "j", "footprint", F.col("gate").alias("r"))
    return own.join(post, ["client", "j"]).join(foot, ["client", "j"])


def targets(state: DataFrame, **weights: Column) -> DataFrame:
    """j and, under each name, the weighted mean of the local centres; null without weight.

    All are taken in one aggregation, so that equal weights give equal numbers in whatever order rows and partial sums come.
    The dimension need not be known: numbers meet by place.
    """
    each = state.select("j", *[w.alias(f"w_{n}") for n, w in weights.items()], F.posexplode("c").alias("i", "t"))
    sums = each.groupBy("j", "i").agg(*[F.sum(F.col(f"w_{n}") * F.col("t")).alias(f"s_{n}") for n in weights], *[F.sum(f"w_{n}").alias(f"m_{n}") for n in weights])
    means = F.array_sort(F.collect_list(F.struct("i", *[F.try_divide(f"s_{n}", f"m_{n}").alias(n) for n in weights])))  # one number a dimension
    every = sums.groupBy("j").agg(means.alias("means"), *[F.max(f"m_{n}").alias(f"m_{n}") for n in weights])
    return every.select("j", *[F.when(F.col(f"m_{n}") > 0, F.col(f"means.{n}")).alias(n) for n in weights])


def _length(a: str, b: str) -> Column:
    return F.sqrt(kernel.squared_distance(F.col(a), F.col(b)))


def substitution(state: DataFrame) -> DataFrame:
    """j, lhs, rhs, holds, ratio: how far masses before and after the local step move the target, with and without the gate.

    The covariance of pre/post with the centres over its mean, under weights w * post, is the difference of the targets under
    w * pre and w * post; so both sides are lengths between targets. Prototypes with an empty client are left out. A gate that
    is the same for all clients narrows nothing: taken relative to the largest it is 1, and both sides are equal to the last digit.
    """
    own = Window.partitionBy("j")
    full = state.withColumns({"least": F.min("post").over(own), "gate": F.try_divide("r", F.max("r").over(own))}).where("least > 0")
    b, pre, post, r = F.col("share"), F.col("pre"), F.col("post"), F.col("gate")
    out = targets(full, a=b * pre * r, b=b * post * r, e=b * pre, f=b * post)
    s = out.select("j", _length("a", "b").alias("lhs"), _length("e", "f").alias("rhs"))
    return s.withColumn("holds", F.col("lhs") < F.col("rhs")).withColumn("ratio", F.when(F.col("rhs") > 1e-12, F.col("lhs") / F.col("rhs")))


def tilt(state: DataFrame, mass: str = "post") -> DataFrame:
    """j, cv, displacement, spread, rel; cv_u and cv_c on pairs off and on the gates' floor; share_q_u, share_r_u, pairs_u.

    The base measure is share * mass * q, the server's share * mass * r and the tilt r / q. A subset of under two clients has
    no variation (null).
    """
    w = F.col("share") * F.col(mass)
    s = state.withColumn("wq", w * F.col("q")).withColumn("wr", w * F.col("r")).withColumn("g", F.col("r") / F.col("q"))
    s = s.withColumn("u", (F.col("r") > FLOOR + 1e-12) & (F.col("q") > FLOOR + 1e-12))
    s = s.join(targets(s, tq=F.col("wq"), tr=F.col("wr")), "j")

    def cv(on: Column) -> Column:
        wq = F.when(on, F.col("wq"))
        total, mean = F.sum(wq), F.try_divide(F.sum(wq * F.col("g")), F.sum(wq))
        var = F.try_divide(F.sum(wq * F.col("g") * F.col("g")), F.sum(wq)) - mean * mean
        return F.when((F.count_if(on) >= 2) & (total > 0), F.try_divide(F.sqrt(F.greatest(var, F.lit(0.0))), mean))

    part = lambda c: F.try_divide(F.sum(F.when(F.col("u"), F.col(c)).otherwise(0.0)), F.sum(c))
    spread = F.sqrt(F.try_divide(F.sum(F.col("wq") * kernel.squared_distance(F.col("c"), F.col("tq"))), F.sum("wq")))
    out = s.groupBy("j").agg(
        cv(F.lit(True)).alias("cv"), F.first(_length("tr", "tq")).alias("displacement"), spread.alias("spread"), cv(F.col("u")).alias("cv_u"), cv(~F.col("u")).alias("cv_c"),
        part("wq").alias("share_q_u"), part("wr").alias("share_r_u"), F.avg(F.col("u").cast("double")).alias("pairs_u"),
    )
    return out.withColumn("rel", F.when(F.col("spread") > 1e-12, F.col("displacement") / F.col("spread")))


def prototype_share(state: DataFrame) -> DataFrame:
    """Share of the variance of ln r - ln q, on pairs off the floor, that the prototype explains; null under four pairs."""
    on = state.where((F.col("r") > FLOOR + 1e-12) & (F.col("q") > FLOOR + 1e-12)).withColumn("d", F.ln("r") - F.ln("q"))
    each = on.groupBy("j").agg(F.count("*").alias("n"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("ss"))
    total = F.sum("ss") - F.sum("s") * F.sum("s") / F.sum("n")
    within = F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n"))
    return each.agg(F.when((F.sum("n") >= 4) & (total > 1e-15), 1 - within / total).alias("prototype_share"))


def clip_and_coverage(state: DataFrame) -> DataFrame:
    """clip_rate: share of footprint gates at the floor; phi_cv, phi_ratio: medians over clients of footprint * n / mass.

    Prototypes under a thousandth of the client's rows are left out, and clients with fewer than two others.
    """
    n = F.sum("n").over(Window.partitionBy("client")) / F.count("*").over(Window.partitionBy("client"))
    s = state.withColumn("rows", n).withColumn("phi", F.when(F.col("pre") > 1e-3 * F.col("rows"), F.col("footprint") * F.col("rows") / F.col("pre")))
    each = s.groupBy("client").agg(F.avg((F.col("r") <= FLOOR + 1e-12).cast("double")).alias("clip"), F.count("phi").alias("k"), F.min("phi").alias("lo"), F.max("phi").alias("hi"), (F.stddev_pop("phi") / F.avg("phi")).alias("cv"))
    ok = (F.col("k") >= 2) & (F.col("lo") > 0)
    return each.agg(F.avg("clip").alias("clip_rate"), F.median(F.when(ok, F.col("cv"))).alias("phi_cv"), F.median(F.when(ok, F.col("hi") / F.col("lo"))).alias("phi_ratio"))


def covariance_ranks(points: DataFrame, *by: str) -> DataFrame:
    """participation (squared trace over the trace of the square) and effective rank exp(H) of the covariance of x.

    Points are added up where they lie (kernel.moments); only d x d numbers of a group meet its task.
    """
    import numpy as np
    import pandas as pd

    d = kernel.dimension(points)
    kinds = dict(points.dtypes)

    def ranks(batches):
        for pdf in batches:
            rows = []
            for flat in pdf["cov"]:
                full = np.zeros((d, d))
                full[np.tril_indices(d)] = np.nan_to_num(flat)
                e = np.maximum(np.linalg.eigvalsh(full), 0.0)
                p = e / e.sum() if e.sum() > 0 else e
                p = p[p > 1e-15]
                rows.append((e.sum() ** 2 / (e * e).sum(), float(np.exp(-(p * np.log(p)).sum()))) if len(p) else (math.nan, math.nan))
            yield pd.concat([pdf.drop(columns="cov").reset_index(drop=True), pd.DataFrame(rows, columns=["participation", "effective_rank"])], axis=1)

    return kernel.moments(points, *by).select(*by, "cov").mapInPandas(ranks, ", ".join([*[f"{b} {kinds[b]}" for b in by], "participation double, effective_rank double"]))
