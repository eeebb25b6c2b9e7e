"""The analysis on results as they come: diverged runs, parts of the clients, held-out splits, two files, runs without early stopping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from . import analysis
from .catalog import RUNS, TQ, query, r6

#: Pretended runs: those of the catalog and one without early stopping, which H5 needs.
FLAWED = (*[(*r, 0) for r in RUNS], ("cells", "post_footprint_on", 1, 50, 1))
#: Runs diverge where seed + run leaves 3 by 7; of run 5 the seeds that leave 4 by 5 are in the second file only.
_LOST = "({seed} + {run}) % 7 = 3"
_LATE = "{run} = 5 and {seed} % 5 = 4"


def results(spark, sf):
    """Whole runs in a first file, and rows that must not count: parts of the clients, splits, partial variates, repeats in a second file."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    runs = spark.createDataFrame([(i, *r) for i, r in enumerate(FLAWED)], "run int, method string, cell string, L int, rounds int, no_earlystop int")
    one = e.groupBy(F.col("event_type").alias("dataset"), (F.col("event_id") % 20).cast("int").alias("seed"), F.pmod(F.floor(F.col("event_id") / 20), F.lit(len(FLAWED))).cast("int").alias("run")).agg(F.avg("value").alias("v"))
    rows = one.withColumn("v", F.when(F.expr(_LOST.format(seed="seed", run="run")), F.lit(float("nan"))).otherwise(F.col("v"))).join(F.broadcast(runs), "run")
    late = F.expr(_LATE.format(seed="seed", run="run"))
    plain = {"participation": F.lit(1.0), "split": F.lit(0.0), "cfraction": F.lit(None).cast("double"), "file_no": F.lit(0)}
    parts = [
        rows.where(~late).withColumns(plain),
        rows.withColumns(plain | {"v": F.col("v") + 3, "file_no": F.lit(1)}),
        rows.where("seed % 3 = 0").withColumns(plain | {"v": F.col("v") + 7, "participation": F.lit(0.5), "file_no": F.lit(-1)}),
        rows.where("method = 'cells'").withColumns(plain | {"v": F.col("v") + 9, "split": F.lit(0.2), "file_no": F.lit(-1)}),
        rows.where("method = 'scffcm'").withColumns(plain | {"v": F.col("v") + 5, "cfraction": F.lit(0.5), "participation": F.lit(None).cast("double"), "file_no": F.lit(-1)}),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts).withColumns({"mean_acc": F.col("v"), "fcm_obj": F.col("v") + 100}).drop("run", "v")


def _analyzed(spark, sf):
    rows = results(spark, sf)
    names = [r["dataset"] for r in rows.select("dataset").distinct().orderBy("dataset").collect()]  # one name a data set
    return analysis.analyze(rows, ["s00-09", "s10-19"], names, metrics=("mean_acc", "fcm_obj"))


def _arm(method, cell, n, rounds, no_stop):
    late = "" if rounds == 50 else f"R{rounds}"
    return f"SC:L{n}{late}" if method == "scffcm" else f"L{n}noES:{cell}" if no_stop else f"L{n}{late}:{cell}"


_RUN_SQL = ", ".join(f"({i}, '{_arm(*r)}')" for i, r in enumerate(FLAWED))
ARM = f"with ru(run, arm) as (values {_RUN_SQL}), b as (select event_type dataset, (event_id % 20)::int seed, run, arm, avg(value) v from events join ru on run = (event_id // 20) % {len(FLAWED)} group by all), r as (select dataset, seed, arm, case when {_LOST.format(seed='seed', run='run')} then 'nan'::double when {_LATE.format(seed='seed', run='run')} then v + 3 else v end v from b)"


@query(f"{ARM} select arm, dataset, seed, case when not isnan(v) then round(v, 6) end mean_acc from r")
def flawed_arms(spark, sf):
    return analysis.arms(results(spark, sf)).select("arm", "dataset", "seed", F.when(~F.isnan("mean_acc"), r6("mean_acc")).alias("mean_acc"))


def _tests_sql(hyps) -> str:
    terms = ", ".join(f"('{h}', '{a}', {c}::double, {len(t)})" for h, t, _ in hyps for c, a in t)
    expect = ", ".join(f"('{h}', {repr(e) if e else 'null'})" for h, _, e in hyps)
    key = "block, metric, hyp, dataset"
    holm = lambda p, name: f"least(1.0, {p} * (count(*) over (partition by block, metric, hyp) - row_number() over (partition by block, metric, hyp order by {p}, dataset) + 1)) {name}"
    return f"""{ARM}, te(hyp, arm, coef, terms) as (values {terms}), ex(hyp, expect) as (values {expect}),
l as (select dataset, seed, arm, metric, v + shift v, case when seed < 10 then 's00-09' else 's10-19' end block from r, (values ('mean_acc', 0), ('fcm_obj', 100)) m(metric, shift)),
d as (select {key}, seed, sum(coef * v) diff, sum(coef) filter (isnan(v)) lost from l join te using (arm) group by all having count(*) = max(terms)), {TQ},
z as (select 0 loss, {key}, case when metric = 'fcm_obj' then -diff else diff end o from d where not isnan(diff) union all select 1, {key}, case when not isnan(diff) then (case when metric = 'fcm_obj' then -diff else diff end) when lost > 0 then '-infinity'::double else 'infinity'::double end from d where not isnan(diff) or lost <> 0),
k as (select *, rank() over (partition by loss, {key} order by round(abs(o), 12)) + (count(*) over (partition by loss, {key}, round(abs(o), 12)) - 1) / 2.0 rk from z where abs(o) > 1e-12),
wx as (select loss, {key}, sum(case when o > 0 then rk else 0 end) wp, list(rk order by o) rs, count(*) n from k group by all),
en as (select loss, {key}, wp, list_sum(list_transform(range(0, n), lambda i: case when (b >> i) & 1 = 1 then rs[i + 1] else 0 end)) v from wx, lateral (select unnest(range(0, (1 << n)::bigint)) b)),
px as (select loss, {key}, any_value(wp)::double wp, least(1.0, 2 * least(avg((v <= wp)::int), avg((v >= wp)::int)))::double p from en group by all),
g as (select {key}, count(*) n, count(*) filter (isnan(diff)) n_nan, avg(diff) filter (not isnan(diff)) mean, stddev_samp(diff) filter (not isnan(diff)) sd from d group by all),
f as (select * from ex, (select distinct dataset from r), (select distinct block from l), (select distinct metric from l)),
w as (select f.*, coalesce(n, 0) n, coalesce(n_nan, 0) n_nan, a.wp w_plus, coalesce(a.p, 1.0) p_exact, a.p p_legacy, coalesce(c.p, 1.0) p_exact_nanloss, mean, mean - q * sd / sqrt(n - n_nan) low, mean + q * sd / sqrt(n - n_nan) high, case when n is null then null when (metric = 'fcm_obj') = (mean > 0) then 'b' else 'a' end direction, case when n is null then 'no data' else 'ok' end status
 from f left join g using ({key}) left join px a on a.loss = 0 and a.block = f.block and a.metric = f.metric and a.hyp = f.hyp and a.dataset = f.dataset left join px c on c.loss = 1 and c.block = f.block and c.metric = f.metric and c.hyp = f.hyp and c.dataset = f.dataset left join tq on df = n - n_nan - 1),
h as (select *, {holm('p_exact', 's')}, {holm('p_exact_nanloss', 'sn')}, hyp in ('H1', 'H2', 'H3', 'H4', 'H5', 'H6', 'H7', 'H8') and metric = 'mean_acc' whole from w),
h2 as (select *, max(s) over (partition by block, metric, hyp order by p_exact, dataset rows unbounded preceding) p_holm, max(sn) over (partition by block, metric, hyp order by p_exact_nanloss, dataset rows unbounded preceding) p_holm_nanloss, case when whole then least(1.0, p_exact * (count(*) over (partition by block, whole) - row_number() over (partition by block, whole order by p_exact, hyp, dataset) + 1)) end s2 from h),
t as (select *, case when whole then max(s2) over (partition by block, whole order by p_exact, hyp, dataset rows unbounded preceding) end p_holm_all from h2)"""


_HYPS = [*analysis.PRIMARY, *analysis.SECONDARY]
_P = ("p_exact", "p_legacy", "p_exact_nanloss", "p_holm", "p_holm_nanloss")
_SHOWN = ", ".join(["block, metric, hyp, dataset, n, n_nan, w_plus, direction, status", *[f"round({p}, 9) {p}" for p in _P], *[f"round({c}, 6) + 0.0 {n}" for c, n in (("mean", "mean_diff"), ("low", "low"), ("high", "high"))]])


def _shown(tests, *more):
    return tests.select("block", "metric", "hyp", "dataset", "n", "n_nan", "w_plus", "direction", "status", *[F.round(p, 9).alias(p) for p in (*_P, *more)], *[r6(c, c) for c in ("mean_diff", "low", "high")])


@query(f"{_tests_sql(_HYPS)} select {_SHOWN}, round(p_holm_all, 9) p_holm_all from t")
def flawed_tests(spark, sf):
    return _shown(_analyzed(spark, sf)["tests"], "p_holm_all")


@query(f"{_tests_sql(analysis.INTERACTIONS)} select {_SHOWN} from t")
def flawed_interactions(spark, sf):
    return _shown(_analyzed(spark, sf)["interactions"])


_KINDS = (("unadj", "p_exact"), ("holm", "p_holm"), ("legacy", "p_legacy"), ("holm_nanloss", "p_holm_nanloss"), ("holm_all", "p_holm_all"))
_COUNTS = ", ".join(f"count(*) filter (status = 'ok' and {p} < 0.05 and direction = '{side}') {word}_{name}" for name, p in _KINDS for word, side in (("better", "a"), ("worse", "b")))


@query(f"{_tests_sql(_HYPS)}, o as (select block, hyp, metric, count(*) family, count(*) filter (status = 'ok') n_tested, count(*) filter (n_nan > 0) n_with_nan, {_COUNTS}, any_value(expect) expect from t group by block, hyp, metric) select *, case expect when 'a' then better_holm >= 1 and worse_holm <= better_holm when 'b' then worse_holm >= 1 and better_holm <= worse_holm when 'none-better' then better_holm = 0 end replicates from o")
def flawed_summary(spark, sf):
    """With the three columns of diverged runs, and H5 with data."""
    return _analyzed(spark, sf)["summary"]
