"""Tests of many hypotheses over experiment rows, their summaries, and the analysis of decisions.

rows: dataset, seed, arm (string) and value columns. NULL or no row is a missing run, NaN a diverged one.
A hypothesis is (name, [(coefficient, arm), ...], expect), expect one of "a", "b", "none-better" or None.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import signed_rank, signed_rank_auto, t_interval

Hypothesis = tuple[str, list[tuple[float, str]], str | None]
ALPHA = 0.05
LOWER_IS_BETTER = ("fcm_obj", "xb", "hnorm", "upload_numbers", "test_fcm_obj", "test_hnorm")
#: Criteria whose scale differs between data sets: their regret is relative to the best.
RELATIVE = ("fcm_obj", "upload_numbers")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf))


def pair(name: str, a: str, b: str, expect: str | None = None) -> Hypothesis:
    return name, [(1.0, a), (-1.0, b)], expect


def melted(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """dataset, seed, arm, metric, v: a row for each metric."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics]))
    return rows.select("dataset", "seed", "arm", each.alias("x")).select("dataset", "seed", "arm", "x.*")


def contrasts(rows: DataFrame, hypotheses: list[Hypothesis], metric: str) -> DataFrame:
    """hyp, dataset, seed, diff, side. A key with a missing arm gives no row; a diverged arm gives NaN.

    side says which side of the contrast diverged by the sign of the NaN terms' coefficients; null if neither or both.
    """
    return contrasts_by(melted(rows, [metric]), hypotheses, []).drop("metric")


def contrasts_by(long: DataFrame, hypotheses: list[Hypothesis], by: list[str]) -> DataFrame:
    """contrasts() of melted() rows within each group ``by``.

    The terms are a table of a few rows a hypothesis, so they are broadcast; one shuffle adds up the terms.
    """
    terms = long.sparkSession.createDataFrame([(h, float(c), a, len(t)) for h, t, _ in hypotheses for c, a in t], "hyp string, coef double, arm string, terms int")
    v, c = F.col("v"), F.col("coef")
    lost = F.sum(F.when(F.isnan(v), c))
    sums = long.where("v is not null").join(F.broadcast(terms), "arm").groupBy(*by, "hyp", "dataset", "seed").agg(F.count("*").alias("k"), F.max("terms").alias("terms"), F.sum(c * v).alias("diff"), lost.alias("lost"))
    side = F.when(F.col("lost") > 0, "a").when(F.col("lost") < 0, "b")
    return sums.where("k = terms").select(*by, "hyp", "dataset", "seed", "diff", side.alias("side"))


def run_tests(rows: DataFrame, hypotheses: list[Hypothesis], metric: str, families: dict[str, list[str]]) -> DataFrame:
    """test_all() of one metric."""
    return test_all(melted(rows, [metric]), hypotheses, families, [{"metric": metric}])


def test_all(long: DataFrame, hypotheses: list[Hypothesis], families: dict[str, list[str]], groups: list[dict]) -> DataFrame:
    """One row for each group, hypothesis and data set of its family: exact and common p, interval, Holm adjustments, direction.

    ``long`` is melted() with the columns that ``groups`` name, metric among them. Differences are turned so that positive
    speaks for the first side. p_exact_nanloss counts a diverged run as the largest loss of its side. A pair without runs
    has status "no data" and p 1. Python sees one difference a seed of one group, hypothesis and data set.
    """
    by = list(groups[0])
    at = by.index("metric")

    def test(key, pdf: pd.DataFrame) -> pd.DataFrame:
        sign = -1.0 if key[at] in LOWER_IS_BETTER else 1.0
        raw = pdf["diff"].to_list()
        fin = [x for x in raw if not math.isnan(x)]
        turned = [sign * x for x in fin]
        n = sum(abs(x) > 1e-12 for x in turned)
        w, p = signed_rank(turned)
        losses = [-math.inf if s == "a" else math.inf for s in pdf["side"] if s in ("a", "b")]
        p_loss = signed_rank(turned + losses)[1] if len(fin) < len(raw) else p
        mean, low, high = t_interval(fin)
        middle = sum(turned) / len(turned) if turned else math.nan
        way = "a" if middle > 0 else "b" if middle < 0 else "a" if n and w > n * (n + 1) / 4 else "0"
        common = signed_rank_auto(turned)
        return pd.DataFrame([(*key, len(raw), len(raw) - len(fin), n, w if n else math.nan, p, common, mean, low, high, middle, way, p_loss, "ok" if n else "all zero")])

    names = "".join(f"{c} string, " for c in by)
    fields = f"{names}hyp string, dataset string, n long, n_nan long, n_eff long, w_plus double, p_exact double, p_legacy double, mean_diff double, low double, high double, mean_oriented double, direction string, p_exact_nanloss double, status string"
    done = contrasts_by(long, hypotheses, by).groupBy(*by, "hyp", "dataset").applyInPandas(test, fields)
    family = long.sparkSession.createDataFrame([(*g.values(), h, d) for g in groups for h, _, _ in hypotheses for d in families[h]], f"{names}hyp string, dataset string")
    whole = family.join(done, [*by, "hyp", "dataset"], "left").withColumn("status", F.coalesce("status", F.lit("no data")))
    whole = whole.fillna({"n": 0, "n_nan": 0, "n_eff": 0}).withColumn("p_exact", F.coalesce("p_exact", F.lit(1.0))).withColumn("p_exact_nanloss", F.coalesce("p_exact_nanloss", F.lit(1.0)))
    for p, name in (("p_exact", "p_holm"), ("p_exact_nanloss", "p_holm_nanloss")):
        whole = with_holm(whole, p, name, [*by, "hyp"], ["dataset"])
    return whole


def with_holm(tests: DataFrame, p: str, name: str, within: list[str], ties: list[str]) -> DataFrame:
    """``tests`` with column ``name``: p adjusted step down over the rows of each group ``within``. A row a test, so windows are small."""
    by = Window.partitionBy(*within)
    step = F.least(F.lit(1.0), F.col(p) * (F.count("*").over(by) - F.row_number().over(by.orderBy(p, *ties)) + 1))
    return tests.withColumn("s", step).withColumn(name, F.max("s").over(by.orderBy(p, *ties).rowsBetween(Window.unboundedPreceding, 0))).drop("s")


def summarize_tests(tests: DataFrame, hypotheses: list[Hypothesis]) -> DataFrame:
    """better_* and worse_* counts of significant data sets under each correction, and whether the expectation replicates.

    By block too, and with the correction over all tests, where ``tests`` has these columns.
    """
    expect = tests.sparkSession.createDataFrame([(h, e) for h, _, e in hypotheses], "hyp string, expect string")
    ok = F.col("status") == "ok"
    sig = lambda p, side: F.count_if(ok & ~F.isnan(p) & (F.col(p) < ALPHA) & (F.col("direction") == side))
    kinds = {"unadj": "p_exact", "holm": "p_holm", "legacy": "p_legacy", "holm_nanloss": "p_holm_nanloss"}
    if "p_holm_all" in tests.columns:
        kinds["holm_all"] = "p_holm_all"
    by = [c for c in ("block",) if c in tests.columns]
    counts = [sig(p, side).alias(f"{word}_{k}") for k, p in kinds.items() for word, side in (("better", "a"), ("worse", "b"))]
    s = tests.groupBy(*by, "hyp", "metric").agg(F.count("*").alias("family"), F.count_if(ok).alias("n_tested"), F.count_if(F.col("n_nan") > 0).alias("n_with_nan"), *counts)
    up, down = F.col("better_holm"), F.col("worse_holm")
    rule = F.when(F.col("expect") == "a", (up >= 1) & (down <= up)).when(F.col("expect") == "b", (down >= 1) & (up <= down)).when(F.col("expect") == "none-better", up == 0)
    return s.join(F.broadcast(expect), "hyp").withColumn("replicates", rule)


def decision_states(rows: DataFrame, actions: dict[str, str], criteria: list[str]) -> DataFrame:
    """criterion, dataset, action, value, regret, n_substituted, best.

    A seed counts where every action has a run with the criterion. A run that is not finite, or has a negative number of
    uploads, scores the worst value any action had there.
    """
    names = rows.sparkSession.createDataFrame([(a, n) for n, a in actions.items()], "arm string, action string")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).cast("double").alias("v")) for c in criteria]))
    low = F.col("criterion").isin(*LOWER_IS_BETTER)
    long = rows.join(F.broadcast(names), "arm").select("dataset", "seed", "action", each.alias("x")).select("dataset", "seed", "action", "x.*").where("v is not null")
    good = F.when(finite(F.col("v")) & ~((F.col("criterion") == "upload_numbers") & (F.col("v") < 0)), F.col("v"))
    cell = Window.partitionBy("criterion", "dataset", "seed")
    worst = F.when(low, F.max("g").over(cell)).otherwise(F.min("g").over(cell))
    full = long.withColumn("g", good).withColumn("k", F.count("*").over(cell)).withColumn("worst", worst).where((F.col("k") == len(actions)) & F.col("worst").isNotNull())
    v = full.groupBy("criterion", "dataset", "action").agg(F.avg(F.coalesce("g", "worst")).alias("value"), F.count_if(F.col("g").isNull()).alias("n_substituted"))
    state = Window.partitionBy("criterion", "dataset")
    v = v.withColumn("top", F.when(low, F.min("value").over(state)).otherwise(F.max("value").over(state)))
    gap = F.abs(F.col("value") - F.col("top"))
    relative = F.when(F.col("top") != 0, F.try_divide(gap, F.abs("top"))).otherwise(F.when(gap == 0, 0.0).otherwise(math.inf))
    return v.withColumn("regret", F.when(F.col("criterion").isin(*RELATIVE), relative).otherwise(gap)).withColumn("best", F.col("value") == F.col("top")).drop("top")


def decisions(states: DataFrame) -> DataFrame:
    """Of each criterion and action the mean and largest regret over data sets, where the largest is, and both recommendations."""
    one = states.groupBy("criterion", "action").agg(
        F.count("*").alias("n_states"), F.avg("regret").alias("mean_regret"), F.max("regret").alias("max_regret"), F.max_by("dataset", F.struct("regret", "dataset")).alias("argmax_state"), F.sum("n_substituted").alias("n_substituted")
    )
    by = Window.partitionBy("criterion")
    return one.withColumn("rec_mean", F.col("mean_regret") == F.min("mean_regret").over(by)).withColumn("rec_max", F.col("max_regret") == F.min("max_regret").over(by))


def paired_one_sided(rows: DataFrame, target: str, baseline: str, metric: str = "value") -> DataFrame:
    """Of each data set: does ``target`` beat ``baseline``? Means, mean and median raw difference, wins, ties, losses, p (greater)."""
    sign = -1.0 if metric in LOWER_IS_BETTER else 1.0
    a = rows.where(F.col("arm") == target).select("dataset", "seed", F.col(metric).cast("double").alias("t"))
    b = rows.where(F.col("arm") == baseline).select("dataset", "seed", F.col(metric).cast("double").alias("b"))
    both = a.join(b, ["dataset", "seed"]).where(~F.isnan("t") & ~F.isnan("b")).withColumn("raw", F.col("t") - F.col("b")).withColumn("d", sign * F.col("raw"))

    def p_of(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, signed_rank_auto(pdf["d"], greater=True) if len(pdf) >= 2 else math.nan)])

    ps = both.select("dataset", "d").groupBy("dataset").applyInPandas(p_of, "dataset string, p double")
    d = F.col("d")
    one = both.groupBy("dataset").agg(
        F.count("*").alias("n_pairs"), F.avg("t").alias("target_mean"), F.avg("b").alias("baseline_mean"), F.avg("raw").alias("mean_diff"), F.median("raw").alias("median_diff"),
        F.count_if(d > 1e-12).alias("wins"), F.count_if(F.abs(d) <= 1e-12).alias("ties"), F.count_if(d < -1e-12).alias("losses"),
    )
    return one.join(ps, "dataset")


def largest_distinct(audit: DataFrame) -> DataFrame:
    """dataset, init, m_star: the largest fuzzifier at which every seed kept all c prototypes apart; null if none did."""
    m = audit.groupBy("dataset", "init", "m").agg(F.bool_and(F.col("distinct") == F.col("c")).alias("whole"))
    return m.groupBy("dataset", "init").agg(F.max(F.when(F.col("whole"), F.col("m"))).alias("m_star"))


def edge_label(value: str, axis: list[float]) -> Column:
    """Where a picked step lies on its grid axis: single, low, high or interior; null without a pick."""
    v = F.col(value)
    where = F.lit("single") if len(axis) == 1 else F.when(v == min(axis), "low").when(v == max(axis), "high").otherwise("interior")
    return F.when(v.isNotNull(), where)
