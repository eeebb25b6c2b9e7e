"""From result rows to tests, summaries and decisions: one plan over one relation of runs.

results: dataset, seed, method (cells or scffcm), cell, L, rounds, participation, split, no_earlystop, metrics, and file_no
(which of several rows of a run counts: the first file's).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONFIGS
from ..operators import hypotheses, relation
from ..operators.hypotheses import pair

#: Rounds of the protocol, and the seeds of each block.
ROUNDS = 50
BLOCKS = {"s00-09": range(0, 10), "s10-19": range(10, 20), "s20-29": range(20, 30)}
#: The primary hypotheses, by name: terms over arms and which side is expected to be better.
PRIMARY = [
    pair("H1", "L5:pre_mass_off", "L5:post_footprint_on", "a"),
    pair("H2", "L5:pre_mass_off", "L5:post_none_off", "a"),
    ("H3", [(1.0, "L5:pre_none_off"), (-1.0, "L5:post_none_off"), (-1.0, "L5:pre_footprint_off"), (1.0, "L5:post_footprint_off")], "a"),
    pair("H4", "L1:pre_none_off", "L1:post_none_off", "a"),
    pair("H5", "L1:pre_mass_off", "L1noES:post_footprint_on", "a"),
    pair("H6", "L1:pre_mass_off", "SC:L1", "a"),
    pair("H7", "L1:pre_mass_off", "SC:L5", "a"),
    pair("H8", "L5:pre_mass_off", "SC:L5", "b"),
    pair("H9", "L5:post_footprint_on", "L5:post_footprint_off", "none-better"),
]
#: The secondary hypotheses.
SECONDARY = [
    pair("H5-ES", "L1:pre_mass_off", "L1:post_footprint_on", "a"),
    pair("S-L50", "L1:pre_mass_off", "SC:L50", "a"),
    pair("S-PRE-SC1", "L1:pre_none_off", "SC:L1"),
    pair("S-PRE-SC5", "L1:pre_none_off", "SC:L5"),
    pair("ED-mass", "L1R250:pre_mass_off", "SC:L1R250"),
    pair("ED-none", "L1R250:pre_none_off", "SC:L1R250"),
]
#: Does a gate stand in for the weights before the local steps? One interaction a gate.
INTERACTIONS = [(f"EA-{g}", [(1.0, "L5:pre_none_off"), (-1.0, "L5:post_none_off"), (-1.0, f"L5:pre_{g}_off"), (1.0, f"L5:post_{g}_off")], None) for g in ("footprint", "mass", "fpmask", "massmask")]
#: Personalization on against off, on runs with held-out rows.
HELD_OUT = [pair("EC-GF", "EC:post_footprint_on", "EC:post_footprint_off"), pair("EC-PREMASS", "EC:pre_mass_on", "EC:pre_mass_off")]
HELD_OUT_METRICS = ("test_fcm_obj", "test_gacc_trmap", "test_mean_acc_trmap", "test_worst_acc_trmap", "test_gacc", "test_mean_acc_refit", "fcm_obj", "mean_acc", "gacc")
#: The actions of the decision analysis, their arms, and its criteria.
ACTIONS = {
    "F-FCM (L=5)": "L5:post_none_off",
    "GF-PFedFCM (L=5)": "L5:post_footprint_on",
    "ungated PRE (L=1)": "L1:pre_none_off",
    "pre_mass_off (L=1)": "L1:pre_mass_off",
    "pre_mass_off (L=5)": "L5:pre_mass_off",
    "SC-FFCM (L=5)": "SC:L5",
    "SC-FFCM (L=1)": "SC:L1",
}
CRITERIA = ("mean_acc", "worst_acc", "gacc", "fcm_obj", "upload_numbers")
METRICS = ("mean_acc", "fcm_obj", "worst_acc", "gacc")
#: Held-out accuracies count as unreliable where a client has this many held-out rows or fewer.
FEW_TEST_ROWS = 5


def arm_name() -> Column:
    """The arm of a run: steps and cell, marked where early stopping is off or the rounds are not the protocol's; SC for control variates."""
    steps, rounds = F.col("L").cast("string"), F.col("rounds").cast("string")
    usual = F.col("rounds") == ROUNDS
    cells = F.when(F.coalesce(F.col("no_earlystop"), F.lit(0)) == 1, F.concat(F.lit("L"), steps, F.lit("noES:"), "cell"))
    cells = cells.when(usual, F.concat(F.lit("L"), steps, F.lit(":"), "cell")).otherwise(F.concat(F.lit("L"), steps, F.lit("R"), rounds, F.lit(":"), "cell"))
    variates = F.when(usual, F.concat(F.lit("SC:L"), steps)).otherwise(F.concat(F.lit("SC:L"), steps, F.lit("R"), rounds))
    return F.when(F.col("method") == "cells", cells).when(F.col("method") == "scffcm", variates)


def arms(results: DataFrame) -> DataFrame:
    """``results`` with arm: whole runs with all clients, the first file's row of each (arm, dataset, seed).

    Runs with a part of the clients are no arm, by ``participation`` or, for control variates, ``cfraction``; null is all.
    """
    all_of = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(1.0)) == 1.0
    whole = results.where(all_of("participation") & (F.coalesce(F.col("split"), F.lit(0.0)) == 0.0))
    if "cfraction" in results.columns:
        whole = whole.where((F.col("method") != "scffcm") | all_of("cfraction"))
    named = whole.withColumn("arm", arm_name()).where("arm is not null")
    return relation.first_rows(named, ["arm", "dataset", "seed"], [F.col("file_no")]) if "file_no" in results.columns else named


def load_sources(spark, folder: str, sources: list[tuple[str, str]], schema: str | None = None) -> tuple[DataFrame | None, list[str]]:
    """(results, missing): the runs of every (method, file name) under ``folder`` that is there, in that order, and the names that are not.

    file_no says which file a row came from; the first file's row counts where several have the same run (arms()).
    """
    at = spark._jvm.org.apache.hadoop.fs.Path
    store = at(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(m, f) for m, f in sources if store.exists(at(f"{folder}/{f}"))]
    parts = [relation.read_results(spark, f"{folder}/{f}", schema=schema).drop("file_no").withColumn("method", F.lit(m)).withColumn("file_no", F.lit(i)) for i, (m, f) in enumerate(found)]
    return (relation.ordered_union(parts) if parts else None), [f for m, f in sources if (m, f) not in found]


def held_out_arms(results: DataFrame) -> DataFrame:
    """Runs with held-out rows, by cell."""
    return results.where((F.col("method") == "cells") & (F.col("split") > 0) & (F.coalesce(F.col("participation"), F.lit(1.0)) == 1.0)).withColumn("arm", F.concat(F.lit("EC:"), "cell"))


def _families(hyps: list, datasets: list[str]) -> dict[str, list[str]]:
    return {h: [d for d in datasets if not (h == "S-L50" and d.startswith("mnist"))] for h, _, _ in hyps}


def block_tests(rows: DataFrame, hyps: list, metrics: list[str], blocks: dict, datasets: list[str]) -> DataFrame:
    """test_all() of each block of seeds and metric."""
    seeds = rows.sparkSession.createDataFrame([(b, s) for b, of in blocks.items() for s in of], "block string, seed int")
    long = hypotheses.melted(rows, metrics).join(F.broadcast(seeds), "seed")
    return hypotheses.test_all(long, hyps, _families(hyps, datasets), [{"block": b, "metric": m} for b in blocks for m in metrics])


def holm_over_all(tests: DataFrame, metric: str = "mean_acc") -> DataFrame:
    """``tests`` with p_holm_all: adjusted over all of H1 to H8 of a block on ``metric``; null elsewhere."""
    some = F.col("hyp").isin(*[f"H{i}" for i in range(1, 9)]) & (F.col("metric") == metric)
    inside = hypotheses.with_holm(tests.where(some), "p_exact", "p_holm_all", ["block"], ["hyp", "dataset"])
    return inside.unionByName(tests.where(~some).withColumn("p_holm_all", F.lit(None).cast("double")))


def count_changes(summary: DataFrame) -> DataFrame:
    """block, hyp, metric, count, legacy, exact: counts of significant data sets that differ between the two unadjusted tests."""
    each = F.explode(F.array(*[F.struct(F.lit(side).alias("count"), F.col(f"{side}_legacy").alias("legacy"), F.col(f"{side}_unadj").alias("exact")) for side in ("better", "worse")]))
    return summary.select("block", "hyp", "metric", each.alias("x")).select("block", "hyp", "metric", "x.*").where("legacy != exact")


def held_out_tests(results: DataFrame, datasets: list[str], metrics: tuple = HELD_OUT_METRICS) -> DataFrame:
    """Tests of HELD_OUT over all seeds, with min_client_n_test and whether an accuracy on held-out rows is unreliable."""
    rows = held_out_arms(results)
    long = hypotheses.melted(rows, list(metrics)).withColumn("block", F.lit("all"))
    tests = hypotheses.test_all(long, HELD_OUT, _families(HELD_OUT, datasets), [{"block": "all", "metric": m} for m in metrics])
    least = rows.groupBy("dataset").agg(F.min("min_client_n_test").alias("min_client_n_test"))
    accuracy = F.col("metric").startswith("test_") & F.col("metric").contains("acc")
    return tests.join(least, "dataset", "left").withColumn("unreliable", accuracy & (F.coalesce("min_client_n_test", F.lit(99)) <= FEW_TEST_ROWS))


def analyze(results: DataFrame, blocks: list[str], datasets: list[str] | None = None, fresh: bool = False, metrics: tuple = METRICS) -> dict[str, DataFrame]:
    """All tables of the analysis, lazily: tests, summary, changes, interactions, held_out (and their summaries), decision_values, decisions.

    The fresh block is refused unless asked for. Decisions use the blocks beyond the first.
    """
    if wrong := [b for b in blocks if b not in BLOCKS]:
        raise ValueError(f"unknown blocks {wrong}")
    if "s20-29" in blocks and not fresh:
        raise ValueError("block s20-29 is kept for the last confirmatory run")
    datasets = datasets or list(CONFIGS)
    chosen = {b: BLOCKS[b] for b in blocks}
    rows, hyps = arms(results), [*PRIMARY, *SECONDARY]
    tests = holm_over_all(block_tests(rows, hyps, list(metrics), chosen, datasets))
    summary = hypotheses.summarize_tests(tests, hyps)
    inter = block_tests(rows, INTERACTIONS, [m for m in ("mean_acc", "fcm_obj") if m in metrics], chosen, datasets)
    out = {"tests": tests, "summary": summary, "changes": count_changes(summary), "interactions": inter, "interaction_summary": hypotheses.summarize_tests(inter, INTERACTIONS)}
    if all(c in results.columns for c in (*HELD_OUT_METRICS, "min_client_n_test")):
        out["held_out"] = held_out_tests(results, datasets)
        out["held_out_summary"] = hypotheses.summarize_tests(out["held_out"], HELD_OUT)
    seeds = [s for b in blocks if b != "s00-09" for s in BLOCKS[b]]
    criteria = [c for c in CRITERIA if c in results.columns]
    if seeds and criteria:
        out["decision_values"] = hypotheses.decision_states(rows.where(F.col("seed").isin(seeds)), ACTIONS, criteria)
        out["decisions"] = hypotheses.decisions(out["decision_values"])
    return out


def report(tables: dict[str, DataFrame]) -> str:
    """The summaries as text: bounded tables of some rows a hypothesis or action."""
    lines = ["hypotheses: better/worse, unadjusted | Holm | common test | Holm over all | diverged runs as losses"]
    for r in tables["summary"].orderBy("block", "hyp", "metric").collect():
        counts = " | ".join(f"{r[f'better_{k}']}/{r[f'worse_{k}']}" for k in ("unadj", "holm", "legacy", "holm_all", "holm_nanloss"))
        said = {True: "replicates", False: "does not replicate", None: ""}[r["replicates"]]
        lines.append(f"{r['block']} {r['hyp']} {r['metric']}: {r['n_tested']} of {r['family']}: {counts} {said}".rstrip())
    if "decisions" in tables:
        lines.append("decisions: mean regret | largest regret, * recommended")
        for r in tables["decisions"].orderBy("criterion", "action").collect():
            lines.append(f"{r['criterion']} {r['action']}: {r['mean_regret']:.4g}{'*' if r['rec_mean'] else ''} | {r['max_regret']:.4g}{'*' if r['rec_max'] else ''} ({r['argmax_state']}, {r['n_substituted']} substituted)")
    return "\n".join(lines) + "\n"


def steps_of(calibration: DataFrame, L: int, rounds: int = ROUNDS, axes: tuple[str, ...] = ("eta_l", "eta_g")) -> DataFrame:
    """dataset and its calibrated steps for ``L``: of repeated data sets the last file's; nulls where no step was stable.

    A calibration at other rounds than ``rounds`` is refused when rows are read; missing rounds count as the protocol's.
    """
    rows = calibration.where(F.col("L") == L)
    given = F.coalesce(F.col("rounds").cast("int"), F.lit(ROUNDS))
    checked = F.when(given == rounds, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("calibrated at other rounds: "), given.cast("string"))).cast("boolean"))
    whole = F.lit(True)
    for a in axes:
        whole = whole & F.col(a).isNotNull() & (F.trim(F.col(a).cast("string")) != "")
    steps = [F.when(whole, F.col(a).cast("double")).alias(a) for a in axes]
    last = [-F.col("file_no")] if "file_no" in calibration.columns else [F.lit(0)]
    return relation.first_rows(rows.where(checked), ["dataset"], last).select("dataset", *steps)


def sweep_report(rows: DataFrame, column: str, a: str, b: str, metric: str = "mean_acc") -> DataFrame:
    """dataset, ``column``, n, mean_a, mean_b, mean_diff, wins, losses of arm a against arm b at each value of a swept column (rounds, L)."""
    one = lambda arm, name: rows.where(F.col("arm") == arm).select("dataset", "seed", column, F.col(metric).cast("double").alias(name))
    both = one(a, "x").join(one(b, "y"), ["dataset", "seed", column]).where(~F.isnan("x") & ~F.isnan("y")).withColumn("d", F.col("x") - F.col("y"))
    return both.groupBy("dataset", column).agg(F.count("*").alias("n"), F.avg("x").alias("mean_a"), F.avg("y").alias("mean_b"), F.avg("d").alias("mean_diff"), F.count_if(F.col("d") > 1e-12).alias("wins"), F.count_if(F.col("d") < -1e-12).alias("losses"))
