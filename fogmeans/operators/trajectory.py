"""Diagnostics over all rounds of a run.

A trajectory has a row for each (round, client, j): share, n, pre, post (masses before and after the local steps), footprint,
r and q (footprint and mass gate), c (local centre); a tracked clientstate run writes one. Every diagnostic of one round
(diagnostics.py) is taken with (round, j) in place of j, all rounds in one plan; tables of rounds times clients times
prototypes are grouped and joined, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EPS
from . import diagnostics
from .ranks import mid_ranked


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("j", F.struct("round", "j"))


def _split(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("j.round").alias("round"), F.col("j.j").alias("number"), *[c for c in rows.columns if c != "j"]).withColumnRenamed("number", "j")


def substitution(rows: DataFrame) -> DataFrame:
    """round, j, lhs, rhs, holds, ratio: diagnostics.substitution() of each round."""
    return _split(diagnostics.substitution(_keyed(rows)))


def tilt(rows: DataFrame, mass: str = "post") -> DataFrame:
    """round, j and the columns of diagnostics.tilt() of each round."""
    return _split(diagnostics.tilt(_keyed(rows), mass))


def prototype_shares(rows: DataFrame) -> DataFrame:
    """round, prototype_share: of the variance of ln r - ln q on pairs off the floor; null under four pairs."""
    floor = diagnostics.FLOOR + 1e-12
    on = rows.where((F.col("r") > floor) & (F.col("q") > floor)).withColumn("d", F.ln("r") - F.ln("q"))
    each = on.groupBy("round", "j").agg(F.count("*").alias("n"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("ss"))
    total = F.sum("ss") - F.sum("s") * F.sum("s") / F.sum("n")
    within = F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n"))
    return each.groupBy("round").agg(F.when((F.sum("n") >= 4) & (total > 1e-15), 1 - within / total).alias("prototype_share"))


def substitution_summary(rows: DataFrame) -> DataFrame:
    """One row: ineq_frac (how often the gate narrows the step), ratio_median, proto_share_median, over all rounds and prototypes."""
    s = substitution(rows).agg(F.avg(F.col("holds").cast("double")).alias("ineq_frac"), F.median("ratio").alias("ratio_median"))
    return s.crossJoin(prototype_shares(rows).agg(F.median("prototype_share").alias("proto_share_median")))  # one row each


def tilt_summary(rows: DataFrame, mass: str = "post") -> DataFrame:
    """One row of medians and means over all rounds and prototypes of tilt(); nulls are left out."""
    t = tilt(rows, mass)
    medians = {"tilt_cv_median": "cv", "disp_median": "displacement", "spread_median": "spread", "rel_median": "rel", "cv_unclipped_median": "cv_u", "cv_clipped_median": "cv_c", "share_q_unclipped_median": "share_q_u", "share_r_unclipped_median": "share_r_u"}
    means = {"share_q_unclipped_mean": "share_q_u", "share_r_unclipped_mean": "share_r_u", "pairs_unclipped_frac_mean": "pairs_u"}
    return t.agg(*[F.median(c).alias(n) for n, c in medians.items()], *[F.avg(c).alias(n) for n, c in means.items()], F.count("cv_c").alias("n_cv_clipped_defined"), F.count("spread").alias("n_round_proto"))


def clip_rates(rows: DataFrame) -> DataFrame:
    """One row: clip_rate_all_rounds and clip_rate_final, the share of footprint gates at the floor."""
    at = (F.col("r") <= diagnostics.FLOOR + 1e-12).cast("double")
    each = rows.groupBy("round").agg(F.sum(at).alias("s"), F.count("r").alias("n"))
    return each.agg((F.sum("s") / F.sum("n")).alias("clip_rate_all_rounds"), F.max_by(F.col("s") / F.col("n"), "round").alias("clip_rate_final"))


def _correlation(a: str, b: str):
    flat = (F.stddev_pop(a) > EPS) & (F.stddev_pop(b) > EPS)
    return F.when(flat, F.corr(a, b))


def client_correlations(rows: DataFrame, a: str = "r", b: str = "q") -> DataFrame:
    """round, client, pearson, spearman across the client's prototypes; null where one gate is constant."""
    from pyspark.sql.window import Window

    own = Window.partitionBy("round", "client")
    rank = lambda c: (F.rank().over(own.orderBy(c)) + (F.count("*").over(Window.partitionBy("round", "client", c)) - 1) / 2).cast("double")
    ranked = rows.select("round", "client", a, b).withColumn("ra", rank(a)).withColumn("rb", rank(b))  # k rows a window
    return ranked.groupBy("round", "client").agg(_correlation(a, b).alias("pearson"), _correlation("ra", "rb").alias("spearman"))


def gate_correlations(rows: DataFrame, a: str = "r", b: str = "q") -> DataFrame:
    """One row: pearson_end, spearman_end (means over clients in the last round) and pearson_all, spearman_all (over all rounds, clients and prototypes)."""
    last = rows.agg(F.max("round").alias("round"))
    end = client_correlations(rows.join(last, "round"), a, b).agg(F.avg("pearson").alias("pearson_end"), F.avg("spearman").alias("spearman_end"))
    every = mid_ranked(mid_ranked(rows.select(a, b), a, "ra"), b, "rb")
    return end.crossJoin(every.agg(_correlation(a, b).alias("pearson_all"), _correlation("ra", "rb").alias("spearman_all")))  # one row each
