"""Paired tests and their corrections over contrasts (dataset, seed, diff): a bounded number of seeds in each data set."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import signed_rank, spearman, t_interval


def mid_ranks(diffs: DataFrame) -> DataFrame:
    """``diffs`` without zeros, with rank: the mid-rank of the size at 12 decimals within the data set."""
    size = F.round(F.abs("diff"), 12)
    d = diffs.where(F.abs("diff") > 1e-12).withColumn("size", size)
    r = F.rank().over(Window.partitionBy("dataset").orderBy("size"))
    same = F.count("*").over(Window.partitionBy("dataset", "size"))
    return d.withColumn("rank", r + (same - 1) / 2.0).drop("size")


def signed_rank_sums(diffs: DataFrame) -> DataFrame:
    r = mid_ranks(diffs)
    return r.groupBy("dataset").agg(F.sum(F.when(F.col("diff") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.count("*").alias("n"))


def exact_tests(diffs: DataFrame) -> DataFrame:
    """dataset, n, w_plus, p, mean, low, high: exact signed-rank p and t interval; NaN differences are left out of p."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf["diff"].to_list()
        w, p = signed_rank(d)
        mean, low, high = t_interval(d)
        return pd.DataFrame([(pdf["dataset"].iloc[0], sum(not math.isnan(x) and abs(x) > 1e-12 for x in d), w, p, mean, low, high)])

    return diffs.groupBy("dataset").applyInPandas(run, "dataset string, n long, w_plus double, p double, mean double, low double, high double")


def holm(tests: DataFrame, p: str = "p", key: str = "dataset") -> DataFrame:
    """``tests`` with p_holm: step-down adjusted, monotone and capped. One row a test, so one window over all is small."""
    order = Window.orderBy(p, key)
    step = F.least(F.lit(1.0), F.col(p) * (F.count("*").over(Window.partitionBy()) - F.row_number().over(order) + 1))
    return tests.withColumn("s", step).withColumn("p_holm", F.max("s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("s")


def mean_sd(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy("dataset").agg(F.count("*").alias("n"), F.avg("diff").alias("mean"), F.stddev_samp("diff").alias("sd"))


def calibrated(grid: DataFrame, factor: float = 5.0, by: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Of each group ``by`` (dataset) the step whose objective is nearest to the central one: finite, at most ``factor`` times it, first in grid order.

    ``grid`` has dataset, grid_idx, step, objective, central. A dataset without a stable step has nulls and n_stable 0.
    """
    gap = F.abs(F.col("objective") - F.col("central")) / F.col("central")
    ok = F.coalesce(~F.isnan("objective") & (F.col("objective") <= factor * F.col("central")), F.lit(False))
    rows = grid.withColumn("ok", ok).withColumn("gap", gap)
    best = F.min_by(F.struct("step", "gap"), F.when(F.col("ok"), F.struct("gap", "grid_idx")))
    return rows.groupBy(*by).agg(best.alias("b"), F.count_if("ok").alias("n_stable")).select(*by, "b.step", "b.gap", "n_stable")


def rank_correlation(rows: DataFrame, a: str, b: str) -> DataFrame:
    """n, r, p: Spearman's correlation of two columns over a bounded table (a row a configuration); null values are left out."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r, p = spearman(pdf[a].to_numpy(float), pdf[b].to_numpy(float))
        return pd.DataFrame([(len(pdf), r, p)])

    return rows.select(a, b).dropna().groupBy().applyInPandas(one, "n long, r double, p double")


def in_order(rows: DataFrame, column: str, order: list[str], ties: list[str], n: int) -> DataFrame:
    """The first ``n`` rows, by the place of ``column`` in ``order`` (others last), then by ``ties``, with column place."""
    at = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(column))
    keyed = rows.withColumn("__at", F.when(at > 0, at).otherwise(len(order) + 1)).orderBy("__at", column, *ties).limit(n)
    return keyed.withColumn("place", F.row_number().over(Window.orderBy("__at", column, *ties))).drop("__at")  # n rows
