"""Registered queries of the clustering operators, each with SQL that computes the same another way."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import diagnostics, gates, hypotheses, kernel, metrics, relation, statistics
from ..sources import points as pts
from . import analysis, oracles, posthoc
from . import rounds as fed

K = 4
QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c, name=None):
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c, 6) + 0.0).alias(name) if name else F.round(c, 6) + 0.0


def _p(spark, sf):
    p = pts.from_embeddings(spark, sf)
    return p, kernel.settled(kernel.first_rows(p, K))


# --- SQL building blocks -------------------------------------------------------------------------------------------------
P_SQL = """p as (select vec_id row_id, (vec_id % 8)::int client, label y, list_transform(embedding, lambda e: e::double) x from embeddings),
c as (select (row_number() over (order by row_id) - 1)::int j, x v from p order by row_id limit 4)"""
DIST = "list_sum(list_transform(list_zip(x, v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def u_sql(src: str, dst: str, cent: str = "c", m: float = 2.0, key: str = "row_id") -> str:
    e = -1.0 / (m - 1)
    return f"""{dst}d as (select {src}.*, j, v, {DIST} d2 from {src}, {cent}),
{dst}z as (select *, count(*) filter (d2 <= 1e-12) over (partition by {key}) nz, sum(pow(greatest(d2, 1e-12), {e})) over (partition by {key}) tot from {dst}d),
{dst} as (select *, u_ u, pow(u_, {m}) w from (select *, case when nz > 0 then (case when d2 <= 1e-12 then 1.0 / nz else 0 end) else pow(greatest(d2, 1e-12), {e}) / tot end u_ from {dst}z))"""


def means_sql(src: str, dst: str, cent: str, keys: str = "j", weight: str = "w", lr: float = 1.0) -> str:
    """Weighted means of x by j as next centres."""
    return f"""{dst}s as (select j, i, sum({weight} * x[i]) s, sum({weight}) mass from {src}, range(1, 65) t(i) group by j, i),
{dst} as (select c0.j, list((1 - {lr}) * c0.v[i] + {lr} * (case when mass > 1e-12 then s / mass else c0.v[i] end) order by i) v from {dst}s join {cent} c0 using (j) group by c0.j)"""


def flat_sql(cent: str) -> str:
    return f"select j, i::int d, round(v[i + 1], 6) + 0.0 val from {cent}, range(0, 64) t(i)"


def flat(centers):
    return centers.select("j", F.posexplode("v").alias("d", "val")).select("j", "d", r6("val", "val"))


U = f"with {P_SQL}, {u_sql('p', 'u')}"


# --- kernel --------------------------------------------------------------------------------------------------------------
def _m_long(spark, sf, m=2.0):
    p, c = _p(spark, sf)
    return kernel.long_form(kernel.memberships(p, c, m), m), p, c


@query(f"{U} select row_id, j, round(d2, 6) + 0.0 d2 from u")
def sq_distance(spark, sf):
    rows, _, _ = _m_long(spark, sf)
    return rows.select("row_id", "j", r6("d2", "d2"))


@query(f"{U} select row_id, j, round(u, 6) + 0.0 u from u")
def membership_m2(spark, sf):
    return _m_long(spark, sf)[0].select("row_id", "j", r6("u", "u"))


@query(f"with {P_SQL}, {u_sql('p', 'u', m=1.5)} select row_id, j, round(u, 6) + 0.0 u from u")
def membership_m15(spark, sf):
    return _m_long(spark, sf, 1.5)[0].select("row_id", "j", r6("u", "u"))


@query(f"{U} select row_id, j, round(u, 6) + 0.0 u from u where nz > 0")
def membership_zero_rows(spark, sf):
    p, c = _p(spark, sf)
    rows = kernel.memberships(p, c).where(F.exists("d2", lambda d: d <= 1e-12))
    return kernel.long_form(rows).select("row_id", "j", r6("u", "u"))


@query(f"{U}, {means_sql('u', 'n', 'c')} {flat_sql('n')}")
def center_update(spark, sf):
    return flat(kernel.update_centers(*_p(spark, sf)))


@query(f"{U} select round(sum(w * d2), 6) objective from u")
def fcm_objective(spark, sf):
    return kernel.objective(*_p(spark, sf)).select(r6("objective", "objective"))


@query(f"{U} select row_id, y, arg_min(j, (greatest(d2, 1e-12), j)) pred from u group by row_id, y")
def hard_labels(spark, sf):
    return kernel.hard_labels(*_p(spark, sf)).select("row_id", "y", "pred")


@query(f"{U}, {means_sql('u', 'n', 'c')}, {u_sql('p', 'u2', 'n')}, {means_sql('u2', 'n2', 'n')} {flat_sql('n2')}")
def fcm_2iter(spark, sf):
    p, c = _p(spark, sf)
    return flat(kernel.update_centers(p, kernel.update_centers(p, c)))


# --- federated, one or two rounds ----------------------------------------------------------------------------------------
@query(f"with {P_SQL} select client, round(count(*) / sum(count(*)) over (), 6) beta from p group by client")
def client_weights(spark, sf):
    p, _ = _p(spark, sf)
    total = p.agg(F.count("*").alias("t"))
    return p.groupBy("client").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("client", r6(F.col("n") / F.col("t"), "beta"))


@query(f"{U} select client, j, round(sum(w), 6) mass from u group by client, j")
def local_mass(spark, sf):
    return kernel.local_sums(*_p(spark, sf)).select("client", "j", r6("mass", "mass"))


@query(f"{U}, {means_sql('u', 'n', 'c')} {flat_sql('n')}")
def lossless_step(spark, sf):
    """Unweighted sums over clients are the pooled update."""
    p, c = _p(spark, sf)
    return flat(kernel.server_step(kernel.local_sums(p, c), c, lr=1.0, weight=F.col("mass")))


LOCAL = """ls as (select client, j, i, sum(w * x[i]) s, sum(w) mass, count(*) n from {u}, range(1, 65) t(i) group by client, j, i),
lc as (select ls.*, n / sum(n) over (partition by j, i) share, case when mass > 1e-12 then s / mass else v[i] end cx, v[i] old from ls join {c} c1 using (j))"""


def server_sql(weight: str, out: str = "n", lr: float = 0.75) -> str:
    return f"""{out}g as (select j, i, any_value(old) old, sum({weight} * cx) a, sum({weight}) b from lc group by j, i),
{out} as (select j, list((1 - {lr}) * old + {lr} * (case when b > 1e-12 then a / b else old end) order by i) v from {out}g group by j)"""


@query(f"{U}, {LOCAL.format(u='u', c='c')}, {server_sql('share * mass')} {flat_sql('n')}")
def server_step_pre_l1(spark, sf):
    p, c = _p(spark, sf)
    return flat(kernel.server_step(kernel.local_sums(p, c), c))


@query(
    f"{U}, {LOCAL.format(u='u', c='c')}, cc as (select client, j, list(cx order by i) v2 from lc group by client, j), q as (select p.*, j, v2 v, {DIST.replace('v)', 'v2)')} d2 from p join cc using (client)),"
    " qz as (select *, 1 / greatest(d2, 1e-12) / sum(1 / greatest(d2, 1e-12)) over (partition by row_id) uu from q), pm as (select client, j, sum(uu * uu) post from qz group by client, j),"
    f" l2 as (select lc.*, post from lc join pm using (client, j)), {server_sql('share * post').replace('from lc', 'from l2')} {flat_sql('n')}"
)
def server_step_post_l1(spark, sf):
    """Weights by the masses at the local centres."""
    p, c = _p(spark, sf)
    sums = kernel.local_sums(p, c)
    own = sums.join(F.broadcast(c), "j").select("client", "j", F.when(F.col("mass") > 1e-12, F.transform("s", lambda t: t / F.col("mass"))).otherwise(F.col("v")).alias("v"))
    packed = own.groupBy("client").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("cs"))
    rows = p.join(packed, "client").withColumn("d2", F.transform("cs", lambda q: kernel.squared_distance(F.col("x"), q["v"]))).drop("cs")
    post = kernel.long_form(rows.withColumn("u", kernel.membership(F.col("d2"), 2.0))).groupBy("client", "j").agg(F.sum("w").alias("post"))
    return flat(kernel.server_step(sums.join(post, ["client", "j"]), c, weight=F.col("share") * F.col("post")))


@query(f"{U}, {LOCAL.format(u='u', c='c')}, {server_sql('share * mass')}, {u_sql('p', 'u2', 'n')}, {LOCAL.format(u='u2', c='n').replace('ls as', 'ls2 as').replace('ls.*', 'ls2.*').replace('from ls ', 'from ls2 ').replace('lc as', 'lc2 as')}, {server_sql('share * mass', 'n2').replace('from lc', 'from lc2')} {flat_sql('n2')}")
def fed_2round(spark, sf):
    p, c = _p(spark, sf)
    c1 = kernel.server_step(kernel.local_sums(p, c), c)
    return flat(kernel.server_step(kernel.local_sums(p, c1), c1))


@query(f"{U}, {LOCAL.format(u='u', c='c')}, var as (select client, i, greatest(var_pop(x[i]), 1e-12) s2 from p, range(1, 65) t(i) group by client, i), g as (select j, i, old + 0.001 * sum(share * 2 * mass * (cx - old) / s2) val from lc join var using (client, i) group by j, i, old) select j, (i - 1)::int d, round(val, 6) + 0.0 val from g")
def pedrycz_step(spark, sf):
    """One gradient step with the masses at the broadcast prototypes."""
    p, c = _p(spark, sf)
    dim = kernel.dimension(p)
    var = p.groupBy("client").agg(F.array(*[F.greatest(F.var_pop(F.get("x", F.lit(d))), F.lit(1e-12)) for d in range(dim)]).alias("s2"))
    rows = kernel.local_sums(p, c).join(F.broadcast(c), "j").join(var, "client")
    # x holds the scaled displacement: share-weighted sums of it are the step
    step = F.transform(F.arrays_zip("s", "v", "s2"), lambda z: 2 * (z["s"] - F.col("mass") * z["v"]) / z["s2"])
    total = kernel.vector_sums(rows.withColumn("x", step), ["j"], F.col("share"), dim)
    return flat(c.join(F.broadcast(total), "j").select("j", F.zip_with("v", "s", lambda a, b: a + 0.001 * b).alias("v")))


@query(f"{U}, {LOCAL.format(u='u', c='c')}, g as (select j, i, old - sum(share * (old - cx)) val from lc group by j, i, old) select j, (i - 1)::int d, round(val, 6) + 0.0 val from g")
def fednova_step(spark, sf):
    """Equal local steps and no damping: the share-weighted mean of local centres."""
    p, c = _p(spark, sf)
    return flat(kernel.server_step(kernel.local_sums(p, c), c, lr=1.0, weight=F.col("share")))


@query(f"{U}, {LOCAL.format(u='u', c='c')}, l2 as (select *, (s + 0.1 * n * old) / (mass + 0.1 * n) px from lc), {server_sql('share * mass').replace('from lc', 'from l2').replace('* cx', '* px')} {flat_sql('n')}")
def fedprox_step(spark, sf):
    """Local means pulled to the prototypes with 0.1 n, weighted by the masses at the prototypes."""
    p, c = _p(spark, sf)
    sums = kernel.local_sums(p, c).join(F.broadcast(c), "j")
    mu = 0.1 * F.col("n")
    pulled = F.zip_with("s", "v", lambda s, v: F.col("mass") * (s + mu * v) / (F.col("mass") + mu))
    return flat(kernel.server_step(sums.withColumn("s", pulled).drop("v"), c))


@query(f"{U}, {LOCAL.format(u='u', c='c')}, g as (select j, i, old - 0.05 * avg(2.0 / n * (mass * old - s)) val from lc group by j, i, old) select j, (i - 1)::int d, round(val, 6) + 0.0 val from g")
def scffcm_step(spark, sf):
    """First local gradient step with zero variates; clients weigh the same."""
    p, c = _p(spark, sf)
    rows = kernel.local_sums(p, c).join(F.broadcast(c), "j")
    grad = F.zip_with("s", "v", lambda s, v: 2.0 / F.col("n") * (F.col("mass") * v - s))
    mean = kernel.vector_sums(rows.withColumn("x", grad), ["j"], F.lit(1.0), kernel.dimension(p))
    return flat(c.join(F.broadcast(mean), "j").select("j", F.zip_with("v", "s", lambda a, b: a - 0.05 * b / F.col("mass")).alias("v")))


# --- federated, two rounds of the driver loops, each against SQL of its own -------------------------------------------------
def _run(spark, sf, f, clients=4, k=3):
    p = pts.from_embeddings(spark, sf, clients).persist()
    back = fed.SparkBackend(p)
    v0 = np.array([r["v"] for r in kernel.first_rows(p, k).orderBy("j").collect()])
    v = f(back, v0)
    p.unpersist()
    return flat(kernel.centers_frame(spark, v))


def _long(name, f, sql=None):
    def run(spark, sf):
        return _run(spark, sf, f)

    run.__name__ = name
    query(sql)(run)


def _with_own(run):
    """The server's prototypes, then each client's."""
    return np.vstack([run.centers, *[run.personal[p] for p in sorted(run.personal)]])


for _mass in ("pre", "post"):
    for _gate in fed.GATES:
        _long(f"run_cell_{_mass}_{_gate}", lambda b, v, m=_mass, g=_gate: fed.run_cell(b, v, m, g, rounds=2, steps=1).centers, oracles.cell(_mass, _gate))
_long("run_cell_pre_mass_personal", lambda b, v: _with_own(fed.run_cell(b, v, "pre", "mass", True, 2, 1)), oracles.cell("pre", "mass", True))
_long("run_cell_post_none_l2", lambda b, v: fed.run_cell(b, v, "post", "none", rounds=2, steps=2).centers, oracles.cell("post", "none", steps=2))
_long("gf_pfedfcm", lambda b, v: _with_own(fed.run_cell(b, v, "post", "footprint", True, 2, 1)), oracles.cell("post", "footprint", True))
_long("gf_client_gate_only", lambda b, v: _with_own(fed.run_cell(b, v, "post", "footprint", True, 2, 1, server_gate=False)), oracles.cell("post", "footprint", True, server_gate=False))
_long("gf_server_gate_only", lambda b, v: _with_own(fed.run_cell(b, v, "post", "footprint", True, 2, 1, client_gate=False)), oracles.cell("post", "footprint", True, client_gate=False))
_long("pfedfcm_fixed_relevance", lambda b, v: _with_own(fed.run_cell(b, v, "post", "none", True, 2, 1, fixed_relevance=0.5)), oracles.cell("post", "none", True, fixed=0.5))
_long("run_cell_participation", lambda b, v: fed.run_cell(b, v, "pre", "none", rounds=2, steps=1, fraction=0.5, seed=3).centers, oracles.cell("pre", "none", fraction=0.5, seed=3))
_long("fcm_central", lambda b, v: fed.fcm(b, v, most=4).centers, oracles.central(4))
_long("f_fcm", lambda b, v: fed.federated(b, v, rounds=2, steps=2).centers, oracles.federated(2, 2, 0.8))
_long("fedprox", lambda b, v: fed.federated(b, v, rounds=2, steps=2, lr=fed.BASELINE_LR, prox=0.1).centers, oracles.federated(2, 2, 0.75, prox=0.1))
_long("ditto", lambda b, v: _with_own(fed.federated(b, v, rounds=2, steps=1, lr=fed.BASELINE_LR, ditto=0.1)), oracles.federated(2, 1, 0.75, ditto=0.1))
_long("ifca", lambda b, v: np.vstack(fed.clustered(b, [v, v + 0.05], rounds=2, steps=1)[0]), oracles.clustered(0.05, 2, 1, 0.75))
_long("model_avg", lambda b, v: fed.model_averaging(b, v, most=2, starts={p: v + 0.02 * p for p in b.clients}).centers, oracles.averaged(2, shift=0.02))
_long("fednova", lambda b, v: fed.normalized(b, v, {0: 1, 1: 2, 2: 1, 3: 2}, rounds=2).centers, oracles.normalized({0: 1, 1: 2, 2: 1, 3: 2}, 2))
_long("pedrycz", lambda b, v: fed.gradient(b, v, 0.001, rounds=2, steps=1).centers, oracles.gradient(0.001, 2, 1))
_long("scffcm", lambda b, v: fed.variates(b, v, 0.05, 1.0, rounds=2, steps=2, fraction=0.5).centers, oracles.variates(0.05, 1.0, 2, 2, 0.5))
_long("local_only", lambda b, v: np.vstack(list(fed.local_only(b, dict.fromkeys(b.clients, v), most=3).values())), oracles.alone(3))


# --- gates ---------------------------------------------------------------------------------------------------------------
GATE = "case when max({v}) over (partition by client) > 1e-12 then least(1.0, greatest(0.05, {v} / max({v}) over (partition by client))) else 0.05 end"
MASS = f"{U}, gm as (select client, j, sum(w) mass from u group by client, j), gg as (select *, {GATE.format(v='mass')} gate from gm)"
FOOT = f"""{U}, gt as (select client, j, greatest(quantile_cont(sqrt(d2), 0.95), 1e-12) top, count(*) n from u group by client, j),
gr as (select client, j, g, top * g / 59.0 r, n from gt, range(0, 60) t(g)),
gv as (select gr.client, gr.j, g, r, coalesce(sum(w) filter (sqrt(d2) <= r), 0) / any_value(n) * (1 - g / 59.0) val from gr join u on u.client = gr.client and u.j = gr.j group by gr.client, gr.j, g, r),
gf as (select client, j, max(val) footprint, arg_max(g / 59.0, (val, -g))::double rho, arg_max(r, (val, -g)) radius from gv group by client, j), gg as (select *, {GATE.format(v='footprint')} gate from gf)"""


@query(f"{MASS} select client, j, round(gate, 6) gate from gg")
def gate_mass(spark, sf):
    return gates.mass_gate(kernel.local_sums(*_p(spark, sf))).select("client", "j", r6("gate", "gate"))


@query(f"{MASS} select client, j, round(case when gate > 0.05 then 1.0 else 0.05 end::double, 6) gate from gg")
def gate_massmask(spark, sf):
    return gates.mass_gate(kernel.local_sums(*_p(spark, sf))).select("client", "j", r6(gates.masked(F.col("gate")), "gate"))


@query(f"{FOOT} select client, j, round(footprint, 6) footprint, round(rho, 6) rho, round(radius, 6) radius, round(gate, 6) gate from gg")
def gate_footprint(spark, sf):
    return gates.footprint_gate(*_p(spark, sf)).select("client", "j", r6("footprint", "footprint"), r6("rho", "rho"), r6("radius", "radius"), r6("gate", "gate"))


@query(f"{FOOT} select client, j, round(case when gate > 0.05 then 1.0 else 0.05 end::double, 6) gate from gg")
def gate_fpmask(spark, sf):
    return gates.footprint_gate(*_p(spark, sf)).select("client", "j", r6(gates.masked(F.col("gate")), "gate"))


@query(f"{MASS} select round(avg(gate), 6) mean, round(stddev_pop(gate), 6) std, round(min(gate), 6) min, round(max(gate), 6) max, round(avg((gate <= 0.2)::int), 6) low_share from gg")
def relevance_stats(spark, sf):
    s = gates.relevance_stats(gates.mass_gate(kernel.local_sums(*_p(spark, sf))))
    return s.select(*[r6(c, c) for c in s.columns])


@query(f"{FOOT}, gm as (select client, j, sum(w) mass from u group by client, j), b as (select gf.footprint a, mass b from gf join gm using (client, j)), r as (select *, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2 ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2 rb from b) select round(corr(a, b), 6) pearson, round(corr(ra, rb), 6) spearman from r")
def gate_corr(spark, sf):
    p, c = _p(spark, sf)
    both = gates.footprint(p, c).join(kernel.local_sums(p, c).select("client", "j", "mass"), ["client", "j"])
    return gates.gate_correlation(both, "footprint", "mass").select(r6("pearson", "pearson"), r6("spearman", "spearman"))


# --- metrics -------------------------------------------------------------------------------------------------------------
LAB = f"{U}, lab as (select row_id, any_value(client) client, any_value(y) y, any_value(x) x, arg_min(j, (greatest(d2, 1e-12), j)) pred from u group by row_id)"
@query(f"{LAB} select client, pred, y, count(*) n from lab group by all")
def contingency(spark, sf):
    """Contingency tables of each client."""
    return metrics.contingency(kernel.hard_labels(*_p(spark, sf)), "client")


@query(f"{LAB}, t as (select y, pred, count(*)::double n from lab group by all), q as (select *, sum(n) over (partition by y) a, sum(n) over (partition by pred) b, sum(n) over () t from t), e as (select sum(n/t*ln(n*t/(a*b))) mi, sum(n*(n-1)/2) idx, max(t) t from q), hy as (select -sum(a/t*ln(a/t)) h, sum(a*(a-1)/2) s from (select distinct y, a, t from q)), hp as (select -sum(b/t*ln(b/t)) h, sum(b*(b-1)/2) s from (select distinct pred, b, t from q)) select round(2*mi/(hy.h+hp.h), 6) nmi, round((idx - hy.s*hp.s/(t*(t-1)/2)) / ((hy.s+hp.s)/2 - hy.s*hp.s/(t*(t-1)/2)), 6) ari from e, hy, hp")
def nmi_ari(spark, sf):
    return metrics.nmi_ari(kernel.hard_labels(*_p(spark, sf))).select(r6("nmi", "nmi"), r6("ari", "ari"))


@query(f"{LAB}, t as (select pred, y % 4 z, count(*) n from lab group by all), perm as (select a.z a, b.z b, c.z c, d.z d from (select unnest(range(0,4)) z) a, (select unnest(range(0,4)) z) b, (select unnest(range(0,4)) z) c, (select unnest(range(0,4)) z) d where a.z<>b.z and a.z<>c.z and a.z<>d.z and b.z<>c.z and b.z<>d.z and c.z<>d.z), s as (select a,b,c,d,(select coalesce(sum(n),0) from t where (pred=0 and z=a) or (pred=1 and z=b) or (pred=2 and z=c) or (pred=3 and z=d)) k from perm) select round(max(k)::double / (select count(*) from lab), 6) acc from s")
def acc_k4(spark, sf):
    """Best matching of four clusters to four label classes."""
    labels = kernel.hard_labels(*_p(spark, sf)).withColumn("y", F.col("y") % 4)
    return metrics.accuracy(labels).select(r6("acc", "acc"))


@query(f"{U} select round(sum(u*u)/count(distinct row_id), 6) fpc, round(-sum(u*ln(greatest(u,1e-12)))/count(distinct row_id), 6) entropy, round(-sum(u*ln(greatest(u,1e-12)))/count(distinct row_id)/ln(4), 6) hnorm from u")
def fpc_entropy(spark, sf):
    p, c = _p(spark, sf)
    v = metrics.validity(kernel.memberships(p, c))
    return v.select(*[r6(x, x) for x in v.columns])


@query(f"{U} select round(sum(w*d2)/(count(distinct row_id)*(select min({DIST.replace('(x, v)', '(a.v, b.v)')}) from c a, c b where a.j < b.j)), 6) xb from u")
def xie_beni(spark, sf):
    return metrics.xie_beni(*_p(spark, sf)).select(r6("xb", "xb"))


@query(f"with {P_SQL} select round(sqrt(min({DIST.replace('(x, v)', '(a.v, b.v)')})), 6) min_dist from c a, c b where a.j < b.j")
def min_center_distance(spark, sf):
    return metrics.min_center_distance(_p(spark, sf)[1]).select(r6("min_dist", "min_dist"))


@query(f"{U}, s as (select j, sum(w) / sum(sum(w)) over () p from u group by j) select round(-sum(p*ln(greatest(p,1e-12)))/ln(4), 6) mass_entropy, round(exp(-sum(p*ln(greatest(p,1e-12)))), 6) effective, sum((p < 0.01)::int)::bigint underused from s")
def proto_diagnostics(spark, sf):
    return metrics.prototype_diagnostics(*_p(spark, sf)).select(r6("mass_entropy", "mass_entropy"), r6("effective", "effective"), "underused")


@query(f"{LAB}, cs as (select pred, i, avg(x[i]) m from lab, range(1,65) t(i) group by pred, i), ce as (select pred, list(m order by i) v from cs group by pred), s as (select pred, any_value(v) v, avg(sqrt({DIST})) s from lab join ce using (pred) group by pred) select round(avg(r), 6) dbi from (select a.pred, max((a.s+b.s)/sqrt({DIST.replace('(x, v)', '(a.v, b.v)')})) r from s a, s b where a.pred<>b.pred group by a.pred)")
def davies_bouldin(spark, sf):
    return metrics.davies_bouldin(kernel.hard_labels(*_p(spark, sf))).select(r6("dbi", "dbi"))


SCALE = f"sc as (select client, greatest(1e-8, 0.03 * sqrt(sum(s2))) threshold from (select client, i, var_pop(x[i]) s2 from p, range(1, 65) t(i) group by client, i) group by client), cp as (select sqrt({DIST.replace('(x, v)', '(a.v, b.v)')}) d from c a, c b where a.j < b.j)"


@query(f"with {P_SQL}, {SCALE} select client, (select round(min(d), 6) from cp) min_center_distance, round(threshold, 6) collapse_threshold, (select count(*) from cp where d < 20 * threshold) collapsed_pairs from sc")
def collapsed_pairs(spark, sf):
    """With a threshold of 0.6 of the data's scale, so that some pairs count."""
    x = metrics.collapse(*_p(spark, sf), "client", ratio=20 * metrics.COLLAPSE)
    return x.select("client", r6("min_center_distance", "min_center_distance"), r6(F.col("collapse_threshold") / 20, "collapse_threshold"), "collapsed_pairs")


VALID = f"""{U}, {SCALE}, cv as (select client, sum(u * u) / count(distinct row_id) fpc, -sum(u * ln(greatest(u, 1e-12))) / count(distinct row_id) partition_entropy, sum(w * d2) / count(distinct row_id) cost from u group by client),
ms as (select client, j, sum(w) / sum(sum(w)) over (partition by client) q from u group by client, j),
me as (select client, -sum(q * ln(greatest(q, 1e-12))) / ln(4) prototype_mass_entropy, exp(-sum(q * ln(greatest(q, 1e-12)))) effective_prototypes, count(*) filter (q < 0.01) underused_prototypes from ms group by client),
va as (select client, fpc, partition_entropy, cost / pow((select min(d) from cp), 2) xie_beni, prototype_mass_entropy, effective_prototypes, underused_prototypes, (select count(*) from cp where d < threshold) collapsed_pairs from cv join me using (client) join sc using (client))"""
_VALID = ("fpc", "partition_entropy", "xie_beni", "prototype_mass_entropy", "effective_prototypes", "underused_prototypes", "collapsed_pairs")


@query(f"{VALID} select client, {', '.join(f'round({c}::double, 6) {c}' for c in _VALID)} from va")
def client_validity(spark, sf):
    v = metrics.client_validity(*_p(spark, sf))
    return v.select("client", *[r6(F.col(c).cast("double"), c) for c in _VALID])


@query(f"{VALID} " + " union all ".join(f"select '{c}' metric, round(avg({c}::double), 6) mean, round({'min' if c in metrics.LOWER_IS_WORSE else 'max'}({c}::double), 6) worst from va" for c in _VALID))
def validity_summary(spark, sf):
    s = metrics.summary(metrics.client_validity(*_p(spark, sf)), list(_VALID))
    return s.select("metric", r6("mean", "mean"), r6("worst", "worst"))


@query(f"{U}, o as (select client, sum(w * d2) cost, count(distinct row_id) n from u group by client) select round(sum(n * cost) / sum(n), 6) objective from o")
def weighted_objective(spark, sf):
    return kernel.weighted_objective(*_p(spark, sf)).select(r6("objective", "objective"))


@query(f"{LAB}, t as (select client, y, pred, count(*)::double n from lab group by all), q as (select *, sum(n) over (partition by client, y) a, sum(n) over (partition by client, pred) b, sum(n) over (partition by client) t from t), e as (select client, sum(n/t*ln(n*t/(a*b))) mi, sum(n*(n-1)/2) idx, max(t) t from q group by client), hy as (select client, -sum(a/t*ln(a/t)) h, sum(a*(a-1)/2) s from (select distinct client, y, a, t from q) group by client), hp as (select client, -sum(b/t*ln(b/t)) h, sum(b*(b-1)/2) s from (select distinct client, pred, b, t from q) group by client) select client, round(2*mi/(hy.h+hp.h), 6) nmi, round((idx - hy.s*hp.s/(t*(t-1)/2)) / ((hy.s+hp.s)/2 - hy.s*hp.s/(t*(t-1)/2)), 6) ari from e join hy using (client) join hp using (client)")
def client_nmi_ari(spark, sf):
    return metrics.nmi_ari(kernel.hard_labels(*_p(spark, sf)), "client").select("client", r6("nmi", "nmi"), r6("ari", "ari"))


# --- diagnostics ---------------------------------------------------------------------------------------------------------
@query(f"{U}, {LOCAL.format(u='u', c='c')}, q as (select client, j, any_value(share) b, any_value(mass) mass from lc group by client, j), r as (select j, mass / avg(mass) over (partition by j) tilt from q) select j, round(stddev_pop(tilt), 6) cv from r group by j")
def tilt_cv(spark, sf):
    """Variation over clients of each prototype's mass weight against its mean."""
    s = kernel.local_sums(*_p(spark, sf))
    return s.groupBy("j").agg((F.stddev_pop("mass") / F.avg("mass")).alias("cv")).select("j", r6("cv", "cv"))


@query(f"{U}, {LOCAL.format(u='u', c='c')}, t as (select j, i, sum(share*mass*cx)/sum(share*mass) tr, sum(share*cx)/sum(share) tq from lc group by j, i), s as (select lc.j, lc.client, any_value(share) b, sum((cx-tq)*(cx-tq)) q from lc join t on lc.j=t.j and lc.i=t.i group by lc.j, lc.client) select t.j, round(sqrt(sum((tr-tq)*(tr-tq))), 6) displacement, round((select sqrt(sum(b*q)/sum(b)) from s where s.j=t.j), 6) spread from t group by t.j")
def displacement_spread(spark, sf):
    """Distance between mass-weighted and share-weighted targets, and the spread of local centres about the latter."""
    p, c = _p(spark, sf)
    dim = kernel.dimension(p)
    rows = kernel.local_sums(p, c).withColumn("x", F.transform("s", lambda t: t / F.col("mass")))
    tr = kernel.vector_sums(rows, ["j"], F.col("share") * F.col("mass"), dim).select("j", F.transform("s", lambda t: t / F.col("mass")).alias("tr"))
    tq = kernel.vector_sums(rows, ["j"], F.col("share"), dim).select("j", F.transform("s", lambda t: t / F.col("mass")).alias("tq"))
    both = rows.join(F.broadcast(tr.join(tq, "j")), "j")
    spread = F.sqrt(F.sum(F.col("share") * kernel.squared_distance(F.col("x"), F.col("tq"))) / F.sum("share"))
    return both.groupBy("j").agg(F.first(F.sqrt(kernel.squared_distance(F.col("tr"), F.col("tq")))).alias("a"), spread.alias("b")).select("j", r6("a", "displacement"), r6("b", "spread"))


@query(f"{U}, o0 as (select sum(w*d2) o from u), {means_sql('u', 'n', 'c')}, {u_sql('p', 'u2', 'n')}, o1 as (select sum(w*d2) o from u2), {means_sql('u2', 'n2', 'n')}, {u_sql('p', 'u3', 'n2')}, o2 as (select sum(w*d2) o from u3) select 0 t, round(o0.o, 6) objective, null::double diff from o0 union all select 1, round(o1.o, 6), round(o1.o-o0.o, 6)+0.0 from o0, o1 union all select 2, round(o2.o, 6), round(o2.o-o1.o, 6)+0.0 from o1, o2")
def descent_log(spark, sf):
    from pyspark.sql.window import Window

    p, c = _p(spark, sf)
    logs = []
    for t in range(3):
        logs.append(kernel.objective(p, c).withColumn("t", F.lit(t)))
        c = kernel.centers_frame(spark, np.array([r["v"] for r in kernel.update_centers(p, c).orderBy("j").collect()]))
    rows = logs[0].union(logs[1]).union(logs[2])
    d = F.col("objective") - F.lag("objective").over(Window.orderBy("t"))  # one row a round
    return rows.select("t", r6("objective", "objective"), r6(d, "diff"))


# --- partitions and shaping ----------------------------------------------------------------------------------------------
@query(f"with {P_SQL}, s as (select row_id, y, row_number() over (partition by y order by row_id) - 1 r, count(*) over (partition by y) n from p), h as (select y, list(distinct c order by c) cs from (select (c + i) % 10 y, c from range(0, 10) t(c), range(0, 2) q(i)) group by y), e as (select *, len(cs) k, n // len(cs) big, n % len(cs) rest from s join h using (y)) select cs[case when r < rest*(big+1) then r // (big+1) else rest + (r - rest*(big+1)) // big end + 1]::int client, y, count(*) n, sum(row_id)::bigint ids from e group by all")
def support_skew(spark, sf):
    p = pts.support_skew(pts.from_embeddings(spark, sf), 10, 2)
    return p.groupBy("client", "y").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


def _dirichlet_sql(clients: int, alpha: float, seed: int) -> str:
    rng = np.random.default_rng(seed)
    cuts = ", ".join(f"({y}, {c}, {s}::double)" for y in range(10) for c, s in enumerate([0.0, *np.cumsum(rng.dirichlet(np.full(clients, alpha)))[:-1].tolist()]))
    return f"with s(y, client, lo) as (values {cuts}), n as (select label y, count(*) n from embeddings group by label), b as (select y, client, floor(lo * n)::bigint lo, n from s join n using (y)) select client::int client, y, coalesce(lead(lo) over (partition by y order by client), n) - lo n from b qualify coalesce(lead(lo) over (partition by y order by client), n) > lo"


@query(_dirichlet_sql(5, 0.5, 7))
def dirichlet_split(spark, sf):
    p = pts.dirichlet_split(pts.from_embeddings(spark, sf), 5, 0.5, 7, least=1, attempts=1)
    return p.groupBy("client", "y").agg(F.count("*").alias("n"))


@query(f"with {P_SQL} select client, y, count(*) n from p group by all")
def label_histogram(spark, sf):
    return pts.from_embeddings(spark, sf).groupBy("client", "y").agg(F.count("*").alias("n"))


@query("select round(sum(abs(a)), 4) a, round(sum(abs(b)), 4) b from (select (l_quantity - avg(l_quantity) over ()) / stddev_pop(l_quantity) over () a, (l_discount - avg(l_discount) over ()) / stddev_pop(l_discount) over () b from lineitem)")
def standard_scale(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_quantity", "l_discount")
    s = pts.standard_scaled(li, ["l_quantity", "l_discount"])
    return s.agg(F.round(F.sum(F.abs("l_quantity")), 4).alias("a"), F.round(F.sum(F.abs("l_discount")), 4).alias("b"))


@query("select (l_suppkey % 10)::int client, l_returnflag y, count(*) n, round(avg(l_extendedprice), 4) price from lineitem group by all")
def lineitem_clients(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    p = pts.from_columns(li, F.col("l_orderkey"), (F.col("l_suppkey") % 10).cast("int"), F.col("l_returnflag"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return p.groupBy("client", "y").agg(F.count("*").alias("n"), F.round(F.avg(F.get("x", F.lit(1))), 4).alias("price"))


@query("select c_mktsegment, y, count(*) n from (select c_mktsegment, (dense_rank() over (order by c_mktsegment) - 1)::int y from customer) group by all")
def label_codes(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_mktsegment")
    return pts.label_codes(c, "c_mktsegment").groupBy("c_mktsegment", "y").agg(F.count("*").alias("n"))


@query(f"with {P_SQL} select client, count(*) n, greatest(1, least(count(*) - 1, floor(0.2 * count(*) + 0.5)))::bigint n_test from p group by client")
def split_sizes(spark, sf):
    s = pts.split_rows(pts.from_embeddings(spark, sf))
    return s.groupBy("client").agg(F.count("*").alias("n"), F.count_if("test").alias("n_test"))


# --- experiment relation -------------------------------------------------------------------------------------------------
R = "with r as (select event_type dataset, user_id % 10 seed, (user_id // 10) % 4 arm, avg(value) as value from events group by all)"
D = f"{R}, d as (select a.dataset, a.seed, a.value - b.value diff from r a join r b on a.dataset=b.dataset and a.seed=b.seed and a.arm=0 and b.arm=1)"


def _r(spark, sf):
    return relation.results_from_events(spark, sf)


def _d(spark, sf):
    return relation.contrast(_r(spark, sf), {0: 1.0, 1: -1.0})


@query(f"{R} select dataset, arm::varchar arm, count(*) n_runs, round(avg(value), 6) value_mean, round(stddev_pop(value), 6) value_std from r group by all")
def aggregate_rows(spark, sf):
    a = relation.aggregate_rows(_r(spark, sf), ["dataset", "arm"], ["value"])
    return a.select("dataset", "arm", "n_runs", r6("value_mean", "value_mean"), r6("value_std", "value_std"))


@query(f"{D} select dataset, seed, round(diff, 6) + 0.0 diff from d")
def paired_join(spark, sf):
    return _d(spark, sf).select("dataset", "seed", r6("diff", "diff"))


@query(f"{R} select dataset, seed, arm, round(value, 6) as value from r where not exists (select 1 from r n where n.value > 50 and n.dataset=r.dataset and n.seed=r.seed and n.arm=r.arm)")
def anti_uncovered(spark, sf):
    r = _r(spark, sf)
    return relation.uncovered(r.where("value > 50"), r, ["dataset", "seed", "arm"]).select("dataset", "seed", "arm", r6("value", "value"))


@query(f"{R}, n as (select dataset, seed, arm, case when seed=3 then 'nan'::double when seed=4 then value + 1 else value end nv, case when seed=3 then 'nan'::double else value end ov from r) select dataset, nv is not distinct from ov as match, count(*) n from n group by all")
def null_safe_compare(spark, sf):
    r = _r(spark, sf)
    nan = F.when(F.col("seed") == 3, F.lit(float("nan")))
    new = r.withColumn("value", F.coalesce(nan, F.when(F.col("seed") == 4, F.col("value") + 1), F.col("value")))
    old = r.withColumn("value", F.coalesce(nan, F.col("value")))
    return relation.compare(new, old, ["dataset", "seed", "arm"], ["value"]).groupBy("dataset", "match").agg(F.count("*").alias("n"))


@query("select event_type, user_id, event_id from (select *, row_number() over (partition by event_type, user_id order by event_id) k from events) where k = 1")
def dedupe_first(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "user_id", "event_id")
    return relation.first_rows(e, ["event_type", "user_id"], [F.col("event_id")])


@query("select event_type, user_id, event_id from (select *, row_number() over (partition by event_type, user_id order by event_id desc) k from events) where k = 1")
def dedupe_last(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "user_id", "event_id")
    return relation.first_rows(e, ["event_type", "user_id"], [-F.col("event_id")])


@query(f"{R} select dataset, round(avg(value) filter (arm=0), 6) a0, round(avg(value) filter (arm=1), 6) a1, round(avg(value) filter (arm=2), 6) a2, round(avg(value) filter (arm=3), 6) a3 from r group by dataset")
def pivot_cells(spark, sf):
    p = relation.pivoted(_r(spark, sf), ["dataset"], "arm", [0, 1, 2, 3])
    return p.select("dataset", *[r6(F.col(str(a)), f"a{a}") for a in range(4)])


@query(f"{D} select dataset, count(*) filter (diff > 1e-12) wins, count(*) filter (abs(diff) <= 1e-12) ties, count(*) filter (diff < -1e-12) losses from d group by dataset")
def tally_better_worse(spark, sf):
    return relation.tally(_d(spark, sf))


@query(f"{R}, m as (select dataset, arm, avg(value) mean from r group by all) select dataset, arg_max(arm, (mean, -arm)) arm, round(max(mean), 6) mean from m group by dataset")
def argmax_cell(spark, sf):
    return relation.best_arm(_r(spark, sf)).select("dataset", "arm", r6("mean", "mean"))


@query("select d.dataset, s.seed::int seed, c.mass || '_' || c.gate cell from (select distinct event_type dataset from events) d, range(0, 3) s(seed), (select * from (values ('pre'), ('post')) a(mass), (values ('none'), ('footprint'), ('mass')) b(gate)) c")
def task_grid(spark, sf):
    d = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("dataset")).distinct()
    cells = [f"{m}_{g}" for m in ("pre", "post") for g in ("none", "footprint", "mass")]
    return d.withColumn("seed", F.explode(F.array(*[F.lit(i) for i in range(3)]))).withColumn("cell", F.explode(F.array(*[F.lit(c) for c in cells])))


# --- statistics ----------------------------------------------------------------------------------------------------------
RK = f"{D}, k as (select *, rank() over (partition by dataset order by round(abs(diff), 12)) + (count(*) over (partition by dataset, round(abs(diff), 12)) - 1) / 2.0 rk from d where abs(diff) > 1e-12)"
WX = f"{RK}, w as (select dataset, sum(case when diff > 0 then rk else 0 end) wp, list(rk order by seed) rs, count(*) n from k group by dataset), e as (select dataset, wp, n, list_sum(list_transform(range(0, n), lambda i: case when (b >> i) & 1 = 1 then rs[i + 1] else 0 end)) v from w, lateral (select unnest(range(0, (1 << n)::bigint)) b)), x as (select dataset, any_value(n) n, any_value(wp) w_plus, least(1.0, 2 * least(avg((v <= wp)::int), avg((v >= wp)::int))) p from e group by dataset)"


@query(f"{RK} select dataset, seed, rk::double rank from k")
def midranks(spark, sf):
    return statistics.mid_ranks(_d(spark, sf)).select("dataset", "seed", F.col("rank").cast("double").alias("rank"))


@query(f"{RK} select dataset, sum(case when diff > 0 then rk else 0 end)::double w_plus, count(*) n from k group by dataset")
def signed_rank_w(spark, sf):
    return statistics.signed_rank_sums(_d(spark, sf))


@query(f"{WX} select dataset, n, w_plus::double w_plus, round(p, 9) p from x")
def wilcoxon_exact(spark, sf):
    return statistics.exact_tests(_d(spark, sf)).select("dataset", "n", "w_plus", F.round("p", 9).alias("p"))


@query(f"{WX}, h as (select *, least(1.0, p * (count(*) over () - row_number() over (order by p, dataset) + 1)) s from x) select dataset, round(p, 9) p, round(max(s) over (order by p, dataset rows unbounded preceding), 9) p_holm from h")
def holm(spark, sf):
    return statistics.holm(statistics.exact_tests(_d(spark, sf))).select("dataset", F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"))


#: 0.975 quantiles of Student's t for 1 to 9 degrees of freedom.
T975 = (12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836, 2.446911851, 2.364624252, 2.306004135, 2.262157163)
TQ = "tq as (select * from (values " + ", ".join(f"({i + 1}, {t}::double)" for i, t in enumerate(T975)) + ") t(df, q))"


@query(f"{D}, {TQ}, a as (select dataset, count(*) n, avg(diff) mean, stddev_samp(diff) sd from d group by dataset) select dataset, round(mean, 6) + 0.0 mean, round(mean - q * sd / sqrt(n), 6) + 0.0 low, round(mean + q * sd / sqrt(n), 6) + 0.0 high from a join tq on df = n - 1")
def t_intervals(spark, sf):
    return statistics.exact_tests(_d(spark, sf)).select("dataset", *[r6(c, c) for c in ("mean", "low", "high")])


@query(f"{D} select dataset, count(*) n, round(avg(diff), 6) + 0.0 mean, round(stddev_samp(diff), 6) sd from d group by dataset")
def mean_sd(spark, sf):
    return statistics.mean_sd(_d(spark, sf)).select("dataset", "n", r6("mean", "mean"), r6("sd", "sd"))


@query(f"{R}, v as (select dataset, seed, max(value) filter (arm=0) a, max(value) filter (arm=1) b, max(value) filter (arm=2) c, max(value) filter (arm=3) d from r group by all) select dataset, seed, round(a - b - c + d, 6) + 0.0 diff from v where a + b + c + d is not null")
def diff_in_diff(spark, sf):
    return relation.contrast(_r(spark, sf), {0: 1.0, 1: -1.0, 2: -1.0, 3: 1.0}).select("dataset", "seed", r6("diff", "diff"))


@query(f"{R}, m as (select dataset, arm, avg(value) mean from r group by all), g as (select arm, max(mean) over (partition by dataset) - mean g from m), o as (select arm, avg(g) a, max(g) b from g group by arm) select arm, round(a, 6) mean_regret, round(b, 6) max_regret, a = min(a) over () least_mean, b = min(b) over () least_max from o")
def decision_regret(spark, sf):
    return relation.regret(_r(spark, sf)).select("arm", r6("mean_regret", "mean_regret"), r6("max_regret", "max_regret"), "least_mean", "least_max")


@query(f"{R}, g as (select dataset, seed grid_idx, seed / 10.0 step, max(value) filter (arm=0) o, max(value) filter (arm=1) c from r group by all), k as (select *, abs(o - c) / c gap from g where o <= 5 * c) select dataset, round(arg_min(step, (gap, grid_idx))::double, 6) step, round(min(gap), 6) gap, count(*) n_stable from k group by dataset")
def calibration_pick(spark, sf):
    g = _r(spark, sf).groupBy("dataset", "seed").agg(F.max(F.when(F.col("arm") == 0, F.col("value"))).alias("objective"), F.max(F.when(F.col("arm") == 1, F.col("value"))).alias("central"))
    grid = g.where("objective is not null and central is not null").withColumn("grid_idx", F.col("seed")).withColumn("step", F.col("seed") / 10.0)
    return statistics.calibrated(grid).select("dataset", r6("step", "step"), r6("gap", "gap"), "n_stable")


# --- one round, prototype by prototype -----------------------------------------------------------------------------------
STATE = f"""{FOOT}, gm as (select client, j, sum(w) mass from u group by client, j), qq as (select client, j, {GATE.format(v='mass')} q from gm), {LOCAL.format(u='u', c='c')},
cc as (select client, j, list(cx order by i) v2 from lc group by client, j), qd as (select p.*, j, v2 v, {DIST.replace('v)', 'v2)')} d2 from p join cc using (client)),
qz as (select *, 1 / greatest(d2, 1e-12) / sum(1 / greatest(d2, 1e-12)) over (partition by row_id) uu from qd), pm as (select client, j, sum(uu * uu) post from qz group by client, j),
sh as (select client, j, any_value(share) b, any_value(n) n, any_value(mass) pre from lc group by client, j),
st as (select sh.*, post, gate r, q, footprint, v2 c from sh join pm using (client, j) join gg using (client, j) join qq using (client, j) join cc using (client, j))"""


def _state(spark, sf):
    return diagnostics.round_state(*_p(spark, sf))


@query(
    f"{STATE}, w as (select j, c, pre / post om, b * post / sum(b * post) over (partition by j) pi, b * post * r / sum(b * post * r) over (partition by j) pg from st),"
    " e as (select j, i, sum(pg*om*c[i]) - sum(pg*om)*sum(pg*c[i]) cg, sum(pg*om) mg, sum(pi*om*c[i]) - sum(pi*om)*sum(pi*c[i]) cp, sum(pi*om) mp from w, range(1, 65) t(i) group by j, i)"
    " select j, round(sqrt(sum(cg*cg)) / any_value(mg), 6) lhs, round(sqrt(sum(cp*cp)) / any_value(mp), 6) rhs from e group by j"
)
def substitution_sides(spark, sf):
    """The SQL takes weighted covariances, the operator distances between targets; both are the same number."""
    return diagnostics.substitution(_state(spark, sf)).select("j", r6("lhs", "lhs"), r6("rhs", "rhs"))


@query(
    f"{STATE}, w as (select *, r > 0.05 + 1e-12 and q > 0.05 + 1e-12 uc, r / q g, b*post*q / sum(b*post*q) over (partition by j) pq, b*post*r / sum(b*post*r) over (partition by j) pr from st),"
    " m as (select j, sum(pq*g) gm, sum(pq*g*g) g2, sum(case when uc then pq else 0 end) sq, sum(case when uc then pr else 0 end) sr, avg(uc::int) pairs from w group by j),"
    " t as (select j, i, sum(pq*c[i]) tq, sum(pr*c[i]) tr, sum(pq*c[i]*c[i]) c2 from w, range(1, 65) t(i) group by j, i),"
    " d as (select j, sqrt(sum((tr-tq)*(tr-tq))) disp, sqrt(sum(c2 - tq*tq)) spread from t group by j)"
    " select j, round(sqrt(greatest(g2 - gm*gm, 0)) / gm, 6) cv, round(disp, 6) displacement, round(spread, 6) spread, round(sq, 6) share_q_u, round(sr, 6) share_r_u, round(pairs, 6) pairs_u from m join d using (j)"
)
def tilt_split(spark, sf):
    t = diagnostics.tilt(_state(spark, sf))
    return t.select("j", *[r6(c, c) for c in ("cv", "displacement", "spread", "share_q_u", "share_r_u", "pairs_u")])


@query(f"{STATE}, w as (select j, ln(r) - ln(q) d from st where r > 0.05 + 1e-12 and q > 0.05 + 1e-12), z as (select *, avg(d) over (partition by j) mj, avg(d) over () m from w) select case when count(*) >= 4 then round(1 - sum((d-mj)*(d-mj)) / sum((d-m)*(d-m)), 6) end prototype_share from z")
def prototype_share(spark, sf):
    return diagnostics.prototype_share(_state(spark, sf)).select(r6("prototype_share", "prototype_share"))


@query(f"{STATE}, w as (select client, r, case when pre > 1e-3 * n then footprint * n / pre end phi from st), e as (select client, avg((r <= 0.05 + 1e-12)::int) clip, count(phi) k, min(phi) lo, max(phi) hi, stddev_pop(phi) / avg(phi) cv from w group by client) select round(avg(clip), 6) clip_rate, round(median(cv) filter (k >= 2 and lo > 0), 6) phi_cv, round(median(hi / lo) filter (k >= 2 and lo > 0), 6) phi_ratio from e")
def clip_and_coverage(spark, sf):
    c = diagnostics.clip_and_coverage(_state(spark, sf))
    return c.select(*[r6(x, x) for x in c.columns])


@query(f"with {P_SQL}, k as (select client, i, j, covar_samp(x[i], x[j]) v from p, range(1, 65) a(i), range(1, 65) b(j) group by client, i, j) select client, round(pow(sum(v) filter (i = j), 2) / sum(v * v), 6) participation from k group by client")
def covariance_participation(spark, sf):
    return diagnostics.covariance_ranks(pts.from_embeddings(spark, sf), "client").select("client", r6("participation", "participation"))


# --- hypotheses and decisions --------------------------------------------------------------------------------------------
#: Runs of arm 1 at seed 3 and of arm 2 at seed 4 count as diverged here.
LOST = "case when (arm = 1 and seed = 3) or (arm = 2 and seed = 4) then 'nan'::double else value end"
HYPS = [hypotheses.pair("pair", "0", "1", "a"), ("inter", [(1.0, "0"), (-1.0, "1"), (-1.0, "2"), (1.0, "3")], None)]


def _lost(spark, sf):
    gone = ((F.col("arm") == 1) & (F.col("seed") == 3)) | ((F.col("arm") == 2) & (F.col("seed") == 4))
    return _r(spark, sf).withColumn("value", F.when(gone, F.lit(float("nan"))).otherwise(F.col("value"))).withColumn("arm", F.col("arm").cast("string"))


CON = f"{R}, n as (select dataset, seed, arm, {LOST} v from r), t as (select * from (values ('pair', 0, 1.0::double), ('pair', 1, -1.0), ('inter', 0, 1.0), ('inter', 1, -1.0), ('inter', 2, -1.0), ('inter', 3, 1.0)) t(hyp, arm, coef)), s as (select hyp, dataset, seed, count(*) k, sum(coef * v) diff, sum(coef) filter (isnan(v)) lost from n join t using (arm) group by all), f as (select hyp, dataset, seed, diff, case when lost > 0 then 'a' when lost < 0 then 'b' end side from s where k = case hyp when 'pair' then 2 else 4 end)"


@query(f"{CON} select hyp, dataset, seed, case when isnan(diff) then null else round(diff, 6) + 0.0 end diff, side from f")
def hypothesis_contrasts(spark, sf):
    c = hypotheses.contrasts(_lost(spark, sf), HYPS, "value")
    return c.select("hyp", "dataset", "seed", F.when(~F.isnan("diff"), r6("diff")).alias("diff"), "side")


def _tests(spark, sf):
    rows = _lost(spark, sf)
    names = [r["dataset"] for r in rows.select("dataset").distinct().orderBy("dataset").collect()]  # one name a data set
    return hypotheses.run_tests(rows, HYPS, "value", {h[0]: [*names, "absent"] for h in HYPS})


#: Every sign pattern of the ranks is listed, without lost runs (loss 0) and with them as infinite losses (loss 1).
TST = f"""{CON}, {TQ}, z as (select 0 loss, hyp, dataset, diff d from f where not isnan(diff) union all select 1, hyp, dataset, case when isnan(diff) then (case side when 'a' then '-infinity'::double when 'b' then 'infinity'::double end) else diff end from f),
rk as (select *, rank() over (partition by loss, hyp, dataset order by round(abs(d), 12)) + (count(*) over (partition by loss, hyp, dataset, round(abs(d), 12)) - 1) / 2.0 rk from z where abs(d) > 1e-12),
wx as (select loss, hyp, dataset, sum(case when d > 0 then rk else 0 end) wp, list(rk order by d) rs, count(*) n from rk group by all),
ex as (select loss, hyp, dataset, wp, list_sum(list_transform(range(0, n), lambda i: case when (b >> i) & 1 = 1 then rs[i + 1] else 0 end)) v from wx, lateral (select unnest(range(0, (1 << n)::bigint)) b)),
px as (select loss, hyp, dataset, any_value(wp) wp, least(1.0, 2 * least(avg((v <= wp)::int), avg((v >= wp)::int))) p from ex group by all),
g as (select hyp, dataset, count(*) n, count(*) filter (isnan(diff)) n_nan, count(*) filter (abs(diff) > 1e-12 and not isnan(diff)) n_eff, avg(diff) filter (not isnan(diff)) mean, stddev_samp(diff) filter (not isnan(diff)) sd from f group by all),
fam as (select * from (values ('pair', 'a'), ('inter', null)) h(hyp, expect), (select distinct dataset from r union all select 'absent')),
w as (select fam.*, coalesce(g.n, 0) n, coalesce(n_nan, 0) n_nan, coalesce(n_eff, 0) n_eff, a.wp::double w_plus, coalesce(a.p, 1.0)::double p_exact, a.p::double p_legacy, mean, mean - q * sd / sqrt(g.n - n_nan) low, mean + q * sd / sqrt(g.n - n_nan) high, case when mean > 0 then 'a' when mean < 0 then 'b' end direction, coalesce(b.p, 1.0)::double p_exact_nanloss, case when g.n is null then 'no data' when n_eff = 0 then 'all zero' else 'ok' end status
 from fam left join g using (hyp, dataset) left join px a on a.loss = 0 and a.hyp = fam.hyp and a.dataset = fam.dataset left join px b on b.loss = 1 and b.hyp = fam.hyp and b.dataset = fam.dataset left join tq on df = g.n - n_nan - 1),
h1 as (select *, least(1.0, p_exact * (count(*) over (partition by hyp) - row_number() over (partition by hyp order by p_exact, dataset) + 1)) s1, least(1.0, p_exact_nanloss * (count(*) over (partition by hyp) - row_number() over (partition by hyp order by p_exact_nanloss, dataset) + 1)) s2 from w),
te as (select *, max(s1) over (partition by hyp order by p_exact, dataset rows unbounded preceding) p_holm, max(s2) over (partition by hyp order by p_exact_nanloss, dataset rows unbounded preceding) p_holm_nanloss from h1)"""
_SIG = ", ".join(f"count(*) filter (status = 'ok' and {p} < 0.05 and direction = '{side}') {word}_{name}" for name, p in (("unadj", "p_exact"), ("holm", "p_holm"), ("legacy", "p_legacy"), ("holm_nanloss", "p_holm_nanloss")) for word, side in (("better", "a"), ("worse", "b")))


@query(f"{TST} select hyp, dataset, n, n_nan, n_eff, w_plus, round(p_exact, 9) p_exact, round(p_legacy, 9) p_legacy, round(mean, 6) + 0.0 mean_diff, round(low, 6) + 0.0 low, round(high, 6) + 0.0 high, round(mean, 6) + 0.0 mean_oriented, direction, round(p_exact_nanloss, 9) p_exact_nanloss, status, round(p_holm, 9) p_holm, round(p_holm_nanloss, 9) p_holm_nanloss, 'value' metric from te")
def hypothesis_tests(spark, sf):
    t = _tests(spark, sf)
    fine = {c: F.round(c, 9) for c in t.columns if c.startswith("p_")} | {c: r6(c) for c in ("mean_diff", "low", "high", "mean_oriented")}
    return t.withColumns(fine)


@query(f"{TST}, o as (select hyp, 'value' metric, count(*) family, count(*) filter (status = 'ok') n_tested, count(*) filter (n_nan > 0) n_with_nan, {_SIG}, any_value(expect) expect from te group by hyp) select *, case when expect = 'a' then better_holm >= 1 and worse_holm <= better_holm end replicates from o")
def hypothesis_summary(spark, sf):
    return hypotheses.summarize_tests(_tests(spark, sf), HYPS)


ONE = f"{R}, d as (select a.dataset, a.seed, a.value t, b.value b, a.value - b.value diff from r a join r b on a.dataset=b.dataset and a.seed=b.seed and a.arm=0 and b.arm=1), k as (select *, rank() over (partition by dataset order by abs(diff)) rk from d where diff <> 0), w as (select dataset, sum(case when diff > 0 then rk else 0 end) wp, list(rk order by seed) rs, count(*) n from k group by dataset), e as (select dataset, wp, list_sum(list_transform(range(0, n), lambda i: case when (b >> i) & 1 = 1 then rs[i + 1] else 0 end)) v from w, lateral (select unnest(range(0, (1 << n)::bigint)) b)), x as (select dataset, avg((v >= wp)::int) p from e group by dataset)"


@query(f"{ONE} select dataset, count(*) n_pairs, round(avg(t), 6) target_mean, round(avg(b), 6) baseline_mean, round(avg(diff), 6) + 0.0 mean_diff, round(median(diff), 6) + 0.0 median_diff, count(*) filter (diff > 1e-12) wins, count(*) filter (abs(diff) <= 1e-12) ties, count(*) filter (diff < -1e-12) losses, round(any_value(p), 9) p from d join x using (dataset) group by dataset")
def paired_one_sided(spark, sf):
    t = hypotheses.paired_one_sided(_r(spark, sf).withColumn("arm", F.col("arm").cast("string")), "0", "1")
    return t.select("dataset", "n_pairs", *[r6(c, c) for c in ("target_mean", "baseline_mean", "mean_diff", "median_diff")], "wins", "ties", "losses", F.round("p", 9).alias("p"))


DEC = f"{R}, n as (select dataset, seed, arm, {LOST} v from r), l as (select dataset, seed, arm, criterion, case when isnan(v) then null else v end g from n, (values ('fcm_obj'), ('mean_acc')) c(criterion)), f as (select *, count(*) over cell k, case when criterion = 'fcm_obj' then max(g) over cell else min(g) over cell end worst from l window cell as (partition by criterion, dataset, seed)), v as (select criterion, dataset, 'action' || arm::varchar as action, avg(coalesce(g, worst)) as value, count(*) filter (g is null) n_substituted from f where k = 4 and worst is not null group by all), t as (select *, case when criterion = 'fcm_obj' then min(value) over (partition by criterion, dataset) else max(value) over (partition by criterion, dataset) end top from v), s as (select *, case when criterion = 'fcm_obj' then abs(value - top) / abs(top) else abs(value - top) end regret from t)"


def _decision_states(spark, sf):
    rows = _lost(spark, sf).withColumn("fcm_obj", F.col("value")).withColumn("mean_acc", F.col("value"))
    return hypotheses.decision_states(rows, {f"action{a}": str(a) for a in range(4)}, ["fcm_obj", "mean_acc"])


@query(f"{DEC} select criterion, dataset, action, round(value, 6) as value, round(regret, 6) + 0.0 regret, n_substituted, value = top best from s")
def decision_states(spark, sf):
    return _decision_states(spark, sf).select("criterion", "dataset", "action", r6("value", "value"), r6("regret", "regret"), "n_substituted", "best")


@query(f"{DEC}, o as (select criterion, action, count(*) n_states, avg(regret) a, max(regret) b, sum(n_substituted)::bigint n_substituted from s group by all) select criterion, action, n_states, round(a, 6) + 0.0 mean_regret, round(b, 6) + 0.0 max_regret, n_substituted, a = min(a) over (partition by criterion) rec_mean, b = min(b) over (partition by criterion) rec_max from o")
def decision_criteria(spark, sf):
    d = hypotheses.decisions(_decision_states(spark, sf))
    return d.select("criterion", "action", "n_states", r6("mean_regret", "mean_regret"), r6("max_regret", "max_regret"), "n_substituted", "rec_mean", "rec_max")


@query(f"{R}, a as (select dataset, 'init' || (arm % 2)::varchar as init, 1.1 + arm / 10.0 m, case when value > 0 and seed <> arm + 6 then 4 else 3 end k from r) select dataset, init, round(max(m) filter (whole), 6) m_star from (select dataset, init, m, bool_and(k = 4) whole from a group by all) group by all")
def m_star_rule(spark, sf):
    a = _r(spark, sf)
    audit = a.select("dataset", F.concat(F.lit("init"), (F.col("arm") % 2).cast("string")).alias("init"), (1.1 + F.col("arm") / 10.0).alias("m"), F.lit(4).alias("c"), F.when((F.col("value") > 0) & (F.col("seed") != F.col("arm") + 6), 4).otherwise(3).alias("distinct"))
    return hypotheses.largest_distinct(audit).select("dataset", "init", r6("m_star", "m_star"))


# --- the whole analysis, on runs read off the events ---------------------------------------------------------------------
#: Pretended runs: method, cell, steps, rounds by number.
RUNS = (("cells", "pre_mass_off", 5, 50), ("cells", "post_footprint_on", 5, 50), ("cells", "post_none_off", 5, 50), ("cells", "pre_none_off", 5, 50), ("cells", "pre_footprint_off", 5, 50), ("cells", "post_footprint_off", 5, 50), ("scffcm", None, 5, 50), ("cells", "pre_mass_off", 1, 50), ("cells", "pre_none_off", 1, 50), ("scffcm", None, 1, 50), ("cells", "pre_mass_off", 1, 250), ("scffcm", None, 1, 250))


def _results(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    runs = spark.createDataFrame([(i, *r) for i, r in enumerate(RUNS)], "run int, method string, cell string, L int, rounds int")
    one = e.groupBy(F.col("event_type").alias("dataset"), (F.col("event_id") % 20).cast("int").alias("seed"), F.pmod(F.floor(F.col("event_id") / 20), F.lit(len(RUNS))).cast("int").alias("run")).agg(F.avg("value").alias("v"))
    rows = one.join(F.broadcast(runs), "run").withColumns({"participation": F.lit(1.0), "split": F.lit(0.0), "no_earlystop": F.lit(0), "mean_acc": F.col("v"), "fcm_obj": F.col("v") + 100})
    return rows.drop("run", "v")


def _analyzed(spark, sf):
    rows = _results(spark, sf)
    names = [r["dataset"] for r in rows.select("dataset").distinct().orderBy("dataset").collect()]  # one name a data set
    return analysis.analyze(rows, ["s00-09", "s10-19"], names, metrics=("mean_acc", "fcm_obj"))


_RUN_SQL = ", ".join(f"({i}, '" + (f"L{n}{'' if rounds == 50 else f'R{rounds}'}:{cell_}" if method == "cells" else f"SC:L{n}{'' if rounds == 50 else f'R{rounds}'}") + "')" for i, (method, cell_, n, rounds) in enumerate(RUNS))
ARM = f"with ru(run, arm) as (values {_RUN_SQL}), r as (select event_type dataset, (event_id % 20)::int seed, arm, avg(value) v from events join ru on run = (event_id // 20) % {len(RUNS)} group by all)"


@query(f"{ARM} select arm, dataset, seed, round(v, 6) mean_acc from r")
def analysis_arms(spark, sf):
    return analysis.arms(_results(spark, sf)).select("arm", "dataset", "seed", r6("mean_acc", "mean_acc"))


def _tests_sql(hyps) -> str:
    terms = ", ".join(f"('{h}', '{a}', {c}::double, {len(t)})" for h, t, _ in hyps for c, a in t)
    expect = ", ".join(f"('{h}', {repr(e) if e else 'null'})" for h, _, e in hyps)
    return f"""{ARM}, te(hyp, arm, coef, terms) as (values {terms}), ex(hyp, expect) as (values {expect}),
l as (select dataset, seed, arm, metric, v + shift v, case when seed < 10 then 's00-09' else 's10-19' end block from r, (values ('mean_acc', 0), ('fcm_obj', 100)) m(metric, shift)),
d as (select block, metric, hyp, dataset, seed, sum(coef * v) diff from l join te using (arm) group by all having count(*) = max(terms)), {TQ},
k as (select *, case when metric = 'fcm_obj' then -diff else diff end o, rank() over (partition by block, metric, hyp, dataset order by round(abs(diff), 12)) + (count(*) over (partition by block, metric, hyp, dataset, round(abs(diff), 12)) - 1) / 2.0 rk from d where abs(diff) > 1e-12),
wx as (select block, metric, hyp, dataset, sum(case when o > 0 then rk else 0 end) wp, list(rk order by o) rs, count(*) n from k group by all),
en as (select block, metric, hyp, dataset, wp, list_sum(list_transform(range(0, n), lambda i: case when (b >> i) & 1 = 1 then rs[i + 1] else 0 end)) v from wx, lateral (select unnest(range(0, (1 << n)::bigint)) b)),
px as (select block, metric, hyp, dataset, any_value(wp)::double wp, least(1.0, 2 * least(avg((v <= wp)::int), avg((v >= wp)::int)))::double p from en group by all),
g as (select block, metric, hyp, dataset, count(*) n, avg(diff) mean, stddev_samp(diff) sd from d group by all),
f as (select * from ex, (select distinct dataset from r), (select distinct block from l), (select distinct metric from l)),
w as (select f.*, coalesce(n, 0) n, wp w_plus, coalesce(p, 1.0) p_exact, p p_legacy, mean, mean - q * sd / sqrt(n) low, mean + q * sd / sqrt(n) high, case when n is null then null when (metric = 'fcm_obj') = (mean > 0) then 'b' else 'a' end direction, case when n is null then 'no data' else 'ok' end status from f left join g using (block, metric, hyp, dataset) left join px using (block, metric, hyp, dataset) left join tq on df = n - 1),
h as (select *, least(1.0, p_exact * (count(*) over (partition by block, metric, hyp) - row_number() over (partition by block, metric, hyp order by p_exact, dataset) + 1)) s, hyp in ('H1', 'H2', 'H3', 'H4', 'H5', 'H6', 'H7', 'H8') and metric = 'mean_acc' whole from w),
h2 as (select *, max(s) over (partition by block, metric, hyp order by p_exact, dataset rows unbounded preceding) p_holm, case when whole then least(1.0, p_exact * (count(*) over (partition by block, whole) - row_number() over (partition by block, whole order by p_exact, hyp, dataset) + 1)) end s2 from h),
t as (select *, case when whole then max(s2) over (partition by block, whole order by p_exact, hyp, dataset rows unbounded preceding) end p_holm_all from h2)"""


_SHOWN = "block, metric, hyp, dataset, n, w_plus, round(p_exact, 9) p_exact, round(p_legacy, 9) p_legacy, round(mean, 6) + 0.0 mean_diff, round(low, 6) + 0.0 low, round(high, 6) + 0.0 high, direction, status, round(p_holm, 9) p_holm"


def _shown(tests, *more):
    cols = ["block", "metric", "hyp", "dataset", "n", "w_plus", *[F.round(c, 9).alias(c) for c in ("p_exact", "p_legacy")], *[r6(c, c) for c in ("mean_diff", "low", "high")], "direction", "status", F.round("p_holm", 9).alias("p_holm")]
    return tests.select(*cols, *[F.round(c, 9).alias(c) for c in more])


_HYPS = [*analysis.PRIMARY, *analysis.SECONDARY]


@query(f"{_tests_sql(_HYPS)} select {_SHOWN}, round(p_holm_all, 9) p_holm_all from t")
def analysis_tests(spark, sf):
    return _shown(_analyzed(spark, sf)["tests"], "p_holm_all")


@query(f"{_tests_sql(analysis.INTERACTIONS)} select {_SHOWN} from t")
def analysis_interactions(spark, sf):
    return _shown(_analyzed(spark, sf)["interactions"])


_COUNTS = ", ".join(f"count(*) filter (status = 'ok' and {p} < 0.05 and direction = '{side}') {word}_{name}" for name, p in (("unadj", "p_exact"), ("holm", "p_holm"), ("legacy", "p_legacy"), ("holm_all", "p_holm_all")) for word, side in (("better", "a"), ("worse", "b")))


@query(f"{_tests_sql(_HYPS)}, o as (select block, hyp, metric, count(*) family, count(*) filter (status = 'ok') n_tested, {_COUNTS}, any_value(expect) expect from t group by block, hyp, metric) select *, case expect when 'a' then better_holm >= 1 and worse_holm <= better_holm when 'b' then worse_holm >= 1 and better_holm <= worse_holm when 'none-better' then better_holm = 0 end replicates from o")
def analysis_summary(spark, sf):
    return _analyzed(spark, sf)["summary"].drop("n_with_nan", "better_holm_nanloss", "worse_holm_nanloss")


_ACT = ", ".join(f"('{a}', '{n}')" for n, a in analysis.ACTIONS.items())


@query(f"{ARM}, ac(arm, action) as (values {_ACT}), l as (select dataset, seed, action, criterion, v + shift v from r join ac using (arm), (values ('mean_acc', 0), ('fcm_obj', 100)) m(criterion, shift) where seed >= 10), k as (select *, count(*) over (partition by dataset, seed, criterion) k from l), v as (select criterion, dataset, action, avg(v) as value from k where k = {len(analysis.ACTIONS)} group by all), t as (select *, case when criterion = 'fcm_obj' then min(value) over (partition by criterion, dataset) else max(value) over (partition by criterion, dataset) end top from v), s as (select *, case when criterion = 'fcm_obj' then abs(value - top) / abs(top) else abs(value - top) end regret from t), o as (select criterion, action, count(*) n_states, avg(regret) a, max(regret) b, arg_max(dataset, (regret, dataset)) argmax_state from s group by all) select criterion, action, n_states, round(a, 6) + 0.0 mean_regret, round(b, 6) + 0.0 max_regret, argmax_state, a = min(a) over (partition by criterion) rec_mean, b = min(b) over (partition by criterion) rec_max from o")
def analysis_decisions(spark, sf):
    d = _analyzed(spark, sf)["decisions"]
    return d.select("criterion", "action", "n_states", r6("mean_regret", "mean_regret"), r6("max_regret", "max_regret"), "argmax_state", "rec_mean", "rec_max")


def _variants(spark, sf):
    """The runs as they are, and with runs at even seeds of the arms of L = 1 made anew."""
    base = analysis.arms(_results(spark, sf)).withColumn("n_rounds", F.lit(50))
    anew = base.where(F.col("arm").startswith("L1:") & (F.col("seed") % 2 == 0)).withColumns({"mean_acc": F.col("mean_acc") + 1, "fcm_obj": F.col("fcm_obj") - 1, "n_rounds": (30 + F.col("seed")).cast("int")})
    return base, anew


@query(f"{ARM}, ac(arm, action) as (values {_ACT}), u as (select 'run' variant, dataset, seed, arm, v from r union all select 'U', dataset, seed, arm, case when arm like 'L1:%' and seed % 2 = 0 then v + 1 else v end from r), l as (select variant, dataset, seed, action, v from u join ac using (arm) where seed >= 10), k as (select *, count(*) over (partition by variant, dataset, seed) k from l), v as (select variant, dataset, action, avg(v) as value from k where k = {len(analysis.ACTIONS)} group by all), s as (select *, max(value) over (partition by variant, dataset) - value regret from v), o as (select variant, action, count(*) n_states, avg(regret) a, max(regret) b from s group by all) select variant, 's10-19' block, action, n_states, round(a, 6) + 0.0 mean_regret, round(b, 6) + 0.0 max_regret, a = min(a) over (partition by variant) rec_mean, b = min(b) over (partition by variant) rec_max from o")
def posthoc_decisions(spark, sf):
    base, anew = _variants(spark, sf)
    d = posthoc.decisions_by_variant({"run": base, "U": posthoc.overridden(base, anew)}, ["mean_acc"], {"s10-19": posthoc.BLOCKS["s10-19"]})
    return d.select("variant", "block", "action", "n_states", r6("mean_regret", "mean_regret"), r6("max_regret", "max_regret"), "rec_mean", "rec_max")


@query(f"{ARM}, k as (select arm, seed, v + 100 o, case when seed % 2 = 0 then 1.0::double end moved from r where arm like 'L1:%') select arm, count(*) n, 1.0::double max_abs_acc, round(max(1 / o), 6) max_rel_objective, round(avg(30 + seed), 6) mean_rounds, min(30 + seed)::int least_rounds, max(30 + seed)::int most_rounds, 1.0::double stopped_early from k where moved is not null group by arm")
def stopping_drift(spark, sf):
    d = posthoc.stopping_drift(*_variants(spark, sf))
    return d.select("arm", "n", *[r6(c, c) for c in ("max_abs_acc", "max_rel_objective", "mean_rounds")], "least_rounds", "most_rounds", "stopped_early")


@query(f"{R}, k as (select dataset, max(value) filter (arm = 0 and seed = 0) a, max(value) filter (arm = 1 and seed = 0) b from r group by dataset) select dataset, case when a > 50 and b > 50 then null else round(a, 6) end eta_l, case when a > 50 and b > 50 then null else round(b, 6) end eta_g from k")
def calibrated_steps(spark, sf):
    """Steps of L = 5 from a table with other L, blank steps and files that say otherwise."""
    g = _r(spark, sf).where("seed = 0").groupBy("dataset").agg(*[F.max(F.when(F.col("arm") == a, F.col("value"))).alias(n) for a, n in ((0, "eta_l"), (1, "eta_g"))])
    blank = (F.col("eta_l") > 50) & (F.col("eta_g") > 50)
    late = g.select("dataset", F.lit(5).alias("L"), F.lit(None).cast("int").alias("rounds"), *[F.when(blank & F.lit(n == "eta_g"), F.lit("")).otherwise(F.col(n).cast("string")).alias(n) for n in ("eta_l", "eta_g")], F.lit(1).alias("file_no"))
    early = late.withColumn("eta_l", F.lit("9")).withColumn("file_no", F.lit(0))
    steps = analysis.steps_of(early.union(late).union(late.withColumn("L", F.lit(1)).withColumn("rounds", F.lit(250))), 5)
    return steps.select("dataset", r6("eta_l", "eta_l"), r6("eta_g", "eta_g"))


@query(f"{R}, n as (select *, case when seed = 4 then value + 1 else value end nv from r where seed <> 7) select count(distinct (dataset, seed, arm)) filter (arm < 2) n_runs, count(*) filter (arm < 2) n_values, count(*) filter (arm < 2 and nv <> value) n_bad, count(distinct (dataset, seed, arm)) filter (arm >= 2) n_advisory_runs, count(*) filter (arm >= 2 and nv <> value) n_advisory_bad, (select count(*) from r where seed = 7 and arm < 2) n_uncovered, false ok from n")
def comparison_verdict(spark, sf):
    """Arms 0 and 1 strictly, others for advice; seed 4 differs and seed 7 is missing."""
    old = _r(spark, sf)
    new = old.where("seed != 7").withColumn("value", F.when(F.col("seed") == 4, F.col("value") + 1).otherwise(F.col("value")))
    keys = ["dataset", "seed", "arm"]
    part = lambda side, strict: {"source": side, "new": new.where(side), "prior": old.where(side), "keys": keys, "fields": ["value"], "strict": strict}
    return relation.comparison([part("arm < 2", True) | {"scope": old.where("arm < 2")}, part("arm >= 2", False)], least_runs=1)[1]


@query(f"{R} select 'value' field, count(*) n, count(*) filter (seed = 4) n_changed, round(max(case when seed = 4 then arm + 1 end)::double, 6) max_abs, round(avg(case when seed = 4 then arm + 1 end), 6) mean_abs from r")
def drift_report(spark, sf):
    old = _r(spark, sf)
    new = old.withColumn("value", F.when(F.col("seed") == 4, F.col("value") + F.col("arm") + 1).otherwise(F.col("value")))
    d = relation.drift(new, old, ["dataset", "seed", "arm"], ["value"])
    return d.select("field", "n", "n_changed", r6("max_abs", "max_abs"), r6("mean_abs", "mean_abs"))


@query(f"{R}, m as (select dataset, seed, avg(value) filter (arm = 0) a, avg(value) filter (arm = 1) b from r group by all), k as (select *, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 rb from m where a is not null and b is not null) select count(*) n, round(corr(ra, rb), 6) r from k")
def rank_correlation(spark, sf):
    w = _r(spark, sf).groupBy("dataset", "seed").agg(*[F.avg(F.when(F.col("arm") == i, F.col("value"))).alias(c) for i, c in enumerate("ab")])
    return statistics.rank_correlation(w, "a", "b").select("n", r6("r", "r"))


_ORDER = ("view", "click", "purchase")


@query(f"{R}, m as (select dataset, arm, avg(value) mean from r group by all), o as (select *, row_number() over (order by coalesce(list_position({list(_ORDER)}, dataset), 99), dataset, arm) place from m) select dataset, arm, round(mean, 6) mean, place::int place from o where place <= 9")
def report_order(spark, sf):
    m = _r(spark, sf).groupBy("dataset", "arm").agg(F.avg("value").alias("mean"))
    return statistics.in_order(m, "dataset", list(_ORDER), ["arm"], 9).select("dataset", "arm", r6("mean", "mean"), "place")


@query(f"{R}, p as (select a.dataset, a.seed, a.value x, b.value y from r a join r b on a.dataset = b.dataset and a.seed = b.seed and a.arm = 0 and b.arm = 1) select dataset, (seed % 2)::int L, count(*) n, round(avg(x), 6) mean_a, round(avg(y), 6) mean_b, round(avg(x - y), 6) + 0.0 mean_diff, count(*) filter (x - y > 1e-12) wins, count(*) filter (x - y < -1e-12) losses from p group by all")
def sweep_report(spark, sf):
    rows = _r(spark, sf).withColumn("L", (F.col("seed") % 2).cast("int")).withColumn("arm", F.col("arm").cast("string"))
    return analysis.sweep_report(rows, "L", "0", "1", "value").select("dataset", "L", "n", *[r6(c, c) for c in ("mean_a", "mean_b", "mean_diff")], "wins", "losses")
