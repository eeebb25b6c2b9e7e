"""Registered queries of runs whose client state is a table, and of metrics and diagnostics over them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import geometry, kernel, metrics, personal, starts, trajectory
from ..sources import points as pts
from . import clientstate, oracles
from .catalog import flat, query, r6

#: Clients of the queries whose states are tables.
MANY = 40


def _state_run(spark, sf, rule, clients=MANY, k=3, where="true", **more):
    """(all points, the run over those that ``where`` keeps), from the first rows of those."""
    p = pts.from_embeddings(spark, sf, clients)
    some = p.where(where)
    store = clientstate.ClientStore(some)
    v0 = np.array([r["v"] for r in kernel.first_rows(some, k).orderBy("j").collect()])
    out = clientstate.run(store, rule, v0, rounds=2, **more)
    store.close()
    return p, out


def _rows(spark, run, personal_too=True):
    """The prototypes, then each client's in order of client."""
    v = kernel.centers_frame(spark, run.centers)
    if not personal_too:
        return flat(v)
    own = run.personal().select("client", F.explode("cs").alias("c")).select((len(run.centers) * (F.col("client") + 1) + F.col("c.j")).cast("int").alias("j"), F.col("c.v").alias("v"))
    return flat(v.union(own))


@query(oracles.cell("post", "footprint", True, steps=2, clients=MANY))
def state_gf_pfedfcm(spark, sf):
    return _rows(spark, _state_run(spark, sf, clientstate.Cell(steps=2))[1])


@query(oracles.federated(2, 2, 0.75, ditto=0.1, clients=MANY))
def state_ditto(spark, sf):
    return _rows(spark, _state_run(spark, sf, clientstate.Tracks(steps=2, ditto=0.1))[1])


@query(oracles.federated(2, 2, 0.75, prox=0.1, clients=MANY))
def state_fedprox(spark, sf):
    return _rows(spark, _state_run(spark, sf, clientstate.Tracks(steps=2, prox=0.1))[1], False)


@query(oracles.variates(0.05, 1.0, 2, 2, 0.5, clients=MANY))
def state_scffcm(spark, sf):
    return _rows(spark, _state_run(spark, sf, clientstate.Variates(steps=2), fraction=0.5)[1], False)


@query(oracles.personal_bundle())
def personal_bundle(spark, sf):
    """The seven metrics under the personal sets of two rounds."""
    p, run = _state_run(spark, sf, clientstate.Cell(steps=1), clients=4)
    b = personal.bundle(p, run.personal(), kernel.centers_frame(spark, run.centers))
    return b.select(*[F.round(c, 3).alias(c) if c == "xb" else r6(c, c) for c in b.columns])


_V = oracles.VALIDITY


@query(oracles.personal_validity("select client, " + ", ".join(f"round({c}::double, {3 if c == 'xie_beni' else 6}) {c}" for c in _V) + " from val"))
def personal_validity(spark, sf):
    """Each client's validity under its own prototypes of two rounds."""
    p, run = _state_run(spark, sf, clientstate.Cell(steps=1), clients=4)
    v = personal.client_validity(p, run.personal())
    return v.select("client", *[F.round(c, 3).alias(c) if c == "xie_beni" else r6(F.col(c).cast("double"), c) for c in _V])


@query(oracles.personal_validity(" union all ".join(f"select '{c}' metric, round(avg({c}::double), {3 if c == 'xie_beni' else 6}) mean, round({'min' if c in metrics.LOWER_IS_WORSE else 'max'}({c}::double), {3 if c == 'xie_beni' else 6}) worst from val" for c in _V)))
def personal_validity_summary(spark, sf):
    """Mean and worst client of each."""
    p, run = _state_run(spark, sf, clientstate.Cell(steps=1), clients=4)
    s = metrics.summary(personal.client_validity(p, run.personal()), list(_V))
    shown = lambda c: F.when(F.col("metric") == "xie_beni", F.round(c, 3)).otherwise(r6(c)).alias(c)
    return s.select("metric", shown("mean"), shown("worst"))


@query(oracles.held_out())
def held_out_metrics(spark, sf):
    """Prototypes and cluster names from rows whose number is not divisible by 5, judged on the others."""
    p, run = _state_run(spark, sf, clientstate.Cell(steps=1), clients=4, where="row_id % 5 <> 0")
    rows = personal.assigned(p, run.personal()).withColumn("test", F.col("row_id") % 5 == 0)
    h = personal.held_out(rows)
    return h.select(*[r6(c, c) for c in h.columns])


# --- starts and pooled k-means -------------------------------------------------------------------------------------------
@query(oracles.starts(4, 2, 7, 3))
def kmeans_pp_starts(spark, sf):
    """Two greedy starts of four centres."""
    made = starts.greedy_starts(pts.from_embeddings(spark, sf), 4, 2, 7, 3)
    return flat(kernel.centers_frame(spark, made.reshape(-1, made.shape[2])))


@query(oracles.pooled(2, 1, 3, 4))
def stallmann_avg2(spark, sf):
    """Two rounds; k-means of three restarts and four rounds over the table of local centres."""
    return _rows(spark, _state_run(spark, sf, clientstate.Pooled(steps=1, restarts=3, most=4), clients=4, tol=None)[1], False)


def _drawn_sql() -> str:
    q = oracles.Script()
    u = f"(('0x' || md5('5|0|0|0|' || row_id)[1:13])::bigint + 0.5) / {16**13}.0"
    return q.flat(q.add(f"select (row_number() over (order by {u}, row_id) - 1)::int j, x v from pt qualify j < 3"))


@query(_drawn_sql())
def drawn_start(spark, sf):
    return flat(kernel.centers_frame(spark, starts.drawn_rows(pts.from_embeddings(spark, sf), 3, 5)))


def _means_sql() -> str:
    q = oracles.Script()
    return q.flat(q.add(f"select (dense_rank() over (order by label) - 1)::int j, v from (select label, list(t order by i) v from (select label, i, avg(x[i]) t from pt join embeddings on vec_id = row_id, {oracles.DIMS} group by label, i) group by label)"))


@query(_means_sql())
def class_means_start(spark, sf):
    return flat(kernel.centers_frame(spark, starts.class_means(pts.from_embeddings(spark, sf))))


def _global_sql() -> str:
    q = oracles.Script()
    lab = oracles.judged(q, q.spread("v0"))
    each = q.add(f"select client g, pred, y, count(*)::double n from {lab} group by all")
    table = q.add(f"select * from {each} union all select -1, pred, y, sum(n) from {each} group by all")
    c = q.add(f"select *, sum(n) over (partition by g, y) a, sum(n) over (partition by g, pred) b, sum(n) over (partition by g) t from {table}")
    e = q.add(f"select g, sum(n/t*ln(n*t/(a*b))) mi, sum(n*(n-1)/2) idx, max(t) t from {c} group by g")
    hy = q.add(f"select g, -sum(a/t*ln(a/t)) h, sum(a*(a-1)/2) s from (select distinct g, y, a, t from {c}) group by g")
    hp = q.add(f"select g, -sum(b/t*ln(b/t)) h, sum(b*(b-1)/2) s from (select distinct g, pred, b, t from {c}) group by g")
    m = q.add(f"select g, hits / t acc, 2*mi/(hy.h+hp.h) nmi, (idx - hy.s*hp.s/(t*(t-1)/2)) / ((hy.s+hp.s)/2 - hy.s*hp.s/(t*(t-1)/2)) ari from {e} join {hy} hy using (g) join {hp} hp using (g) join {oracles.best_hits(q, table, q.k)} using (g)")
    return q.ending("select " + ", ".join(f"round(max({x}) filter (g < 0), 6) pooled_{x}, round(avg({x}) filter (g >= 0), 6) mean_client_{x}, round(min({x}) filter (g >= 0), 6) worst_client_{x}" for x in ("acc", "nmi", "ari")) + f" from {m}")


@query(_global_sql())
def label_agreement(spark, sf):
    """Accuracy, NMI and ARI of all points and, as mean and worst, of the clients."""
    p = pts.from_embeddings(spark, sf, 4)
    a = metrics.label_agreement(kernel.hard_labels(p, kernel.first_rows(p, 3)))
    return a.select(*[r6(c, c) for c in a.columns])


# --- matchings of clusters and labels in different numbers ---------------------------------------------------------------
def _rect_sql() -> str:
    q = oracles.Script(4, 5)
    w = q.weights(q.spread("v0"))
    lab = q.add(f"select client, row_id, any_value(label) % 7 y, arg_min(j, (greatest(d2, 1e-12), j)) pred from {w} join embeddings on vec_id = row_id group by client, row_id")
    own = q.add(f"select client g, pred, y, count(*) n from {lab} group by all")
    whole = q.add(f"select -1 g, pred, y, sum(n) n from {own} group by all")
    every = q.add(f"select * from {own} union all select * from {whole}")
    return q.ending(f"select g::int client, round(hits / (select sum(n) from {every} e where e.g = h.g), 6) acc from {oracles.best_hits(q, every, 5)} h")


@query(_rect_sql())
def acc_rect(spark, sf):
    """Five clusters against seven labels, by client and (client -1) of all."""
    p = pts.from_embeddings(spark, sf, 4)
    labels = kernel.hard_labels(p, kernel.first_rows(p, 5)).withColumn("y", F.col("y") % 7)
    table = metrics.contingency(labels, "client")
    whole = table.groupBy("y", "pred").agg(F.sum("n").alias("n")).withColumn("client", F.lit(-1))
    return metrics.matched(table.unionByName(whole), "client").select("client", r6("acc", "acc"))


# --- all rounds of a run -------------------------------------------------------------------------------------------------
def _trajectory(spark, sf, rounds=3):
    p = pts.from_embeddings(spark, sf, 4)
    store = clientstate.ClientStore(p)
    v0 = np.array([r["v"] for r in kernel.first_rows(p, 3).orderBy("j").collect()])
    run = clientstate.run(store, clientstate.Cell(personalize=False, steps=1, track=True), v0, rounds=rounds, tol=None)
    store.close()
    return run.trajectory


def _substitution_sql(ending: str) -> str:
    q, st = oracles.trajectory()
    w = q.add(f"select round, j, c, pre / post om, b * post / sum(b * post) over g pi, b * post * r / sum(b * post * r) over g pg from {st} window g as (partition by round, j)")
    e = q.add(f"select round, j, i, sum(pg*om*c[i]) - sum(pg*om)*sum(pg*c[i]) cg, sum(pg*om) mg, sum(pi*om*c[i]) - sum(pi*om)*sum(pi*c[i]) cp, sum(pi*om) mp from {w}, range(1, 65) t(i) group by round, j, i")
    q.add(f"select round, j, sqrt(sum(cg*cg)) / any_value(mg) lhs, sqrt(sum(cp*cp)) / any_value(mp) rhs from {e} group by round, j", "sides")
    z = q.add(f"select round, j, ln(r) - ln(q) d from {st} where r > 0.05 + 1e-12 and q > 0.05 + 1e-12")
    y = q.add(f"select *, avg(d) over (partition by round, j) mj, avg(d) over (partition by round) m from {z}")
    q.add(f"select round, case when count(*) >= 4 then 1 - sum((d-mj)*(d-mj)) / sum((d-m)*(d-m)) end s from {y} group by round", "shares")
    return q.ending(ending)


@query(_substitution_sql("select round, j, round(lhs, 6) lhs, round(rhs, 6) rhs, lhs < rhs holds, round(lhs / rhs, 6) ratio from sides"))
def trajectory_substitution(spark, sf):
    return trajectory.substitution(_trajectory(spark, sf)).select("round", "j", r6("lhs", "lhs"), r6("rhs", "rhs"), "holds", r6("ratio", "ratio"))


@query(_substitution_sql("select round(avg((lhs < rhs)::int), 6) ineq_frac, round(median(lhs / rhs), 6) ratio_median, (select round(median(s), 6) from shares) proto_share_median from sides"))
def trajectory_link(spark, sf):
    s = trajectory.substitution_summary(_trajectory(spark, sf))
    return s.select(*[r6(c, c) for c in s.columns])


def _tilt_sql() -> str:
    q, st = oracles.trajectory()
    w = q.add(f"select *, r > 0.05 + 1e-12 and q > 0.05 + 1e-12 uc, r / q g, b*post*q / sum(b*post*q) over p pq, b*post*r / sum(b*post*r) over p pr from {st} window p as (partition by round, j)")
    cv = lambda name, on: f"case when count(*) filter ({on}) >= 2 and sum(pq) filter ({on}) > 0 then sqrt(greatest(sum(pq*g*g) filter ({on}) / sum(pq) filter ({on}) - pow(sum(pq*g) filter ({on}) / sum(pq) filter ({on}), 2), 0)) / (sum(pq*g) filter ({on}) / sum(pq) filter ({on})) end {name}"
    m = q.add(f"select round, j, {cv('cv', 'true')}, {cv('cu', 'uc')}, {cv('cc', 'not uc')}, sum(case when uc then pq else 0 end) sq, sum(case when uc then pr else 0 end) sr, avg(uc::int) pairs from {w} group by round, j")
    t = q.add(f"select round, j, i, sum(pq*c[i]) tq, sum(pr*c[i]) tr, sum(pq*c[i]*c[i]) c2 from {w}, range(1, 65) t(i) group by round, j, i")
    d = q.add(f"select round, j, sqrt(sum((tr-tq)*(tr-tq))) disp, sqrt(sum(c2 - tq*tq)) spread from {t} group by round, j")
    med = lambda e, n: f"round(median({e}), 6) {n}"
    return q.ending(f"select {med('cv', 'tilt_cv_median')}, {med('disp', 'disp_median')}, {med('spread', 'spread_median')}, {med('disp / spread', 'rel_median')}, {med('cu', 'cv_unclipped_median')}, {med('cc', 'cv_clipped_median')}, {med('sq', 'share_q_unclipped_median')}, {med('sr', 'share_r_unclipped_median')}, round(avg(sq), 6) share_q_unclipped_mean, round(avg(sr), 6) share_r_unclipped_mean, round(avg(pairs), 6) pairs_unclipped_frac_mean, count(cc) n_cv_clipped_defined, count(*) n_round_proto from {m} join {d} using (round, j)")


@query(_tilt_sql())
def trajectory_tilt(spark, sf):
    t = trajectory.tilt_summary(_trajectory(spark, sf))
    return t.select(*[c if c.startswith("n_") else r6(c, c) for c in t.columns])


def _gates_sql() -> str:
    q, st = oracles.trajectory()
    mid = lambda c, by: f"rank() over (partition by {by} order by {c}) + (count(*) over (partition by {by}, {c}) - 1) / 2.0"
    own = q.add(f"select round, client, r, q, {mid('r', 'round, client')} rr, {mid('q', 'round, client')} rq from {st}")
    each = q.add(f"select client, case when stddev_pop(r) > 1e-12 and stddev_pop(q) > 1e-12 then corr(r, q) end pe, case when stddev_pop(r) > 1e-12 and stddev_pop(q) > 1e-12 then corr(rr, rq) end sp from {own} where round = 2 group by client")
    every = q.add(f"select r, q, {mid('r', '1')} rr, {mid('q', '1')} rq from {st}")
    return q.ending(f"select round(avg((r <= 0.05 + 1e-12)::int), 6) clip_rate_all_rounds, round(avg((r <= 0.05 + 1e-12)::int) filter (round = 2), 6) clip_rate_final, (select round(avg(pe), 6) from {each}) pearson_end, (select round(avg(sp), 6) from {each}) spearman_end, (select round(corr(r, q), 6) from {every}) pearson_all, (select round(corr(rr, rq), 6) from {every}) spearman_all from {st}")


@query(_gates_sql())
def trajectory_gates(spark, sf):
    rows = _trajectory(spark, sf)
    g = trajectory.clip_rates(rows).crossJoin(trajectory.gate_correlations(rows))  # one row each
    return g.select(*[r6(c, c) for c in g.columns])


# --- geometry ------------------------------------------------------------------------------------------------------------
def _pairs_sql() -> str:
    q = oracles.Script()
    d = q.add(f"select sqrt({oracles.DISTANCE.replace('(x, v)', '(a.x, b.x)')}) d from pt a join pt b on a.row_id < b.row_id")
    return q.ending(f"select count(*) n, round(avg(d), 6) mean, round(stddev_pop(d), 6) std, round(avg(d) / stddev_pop(d), 6) ratio from {d}")


@query(_pairs_sql())
def pair_distances(spark, sf):
    d = geometry.pair_distances(pts.from_embeddings(spark, sf), block=128)
    return d.select("n", *[r6(c, c) for c in ("mean", "std", "ratio")])


#: Rows of the first view, every fifth vector standing there twice more; of the second, in other numbers, each x scaled, some rows left out.
_VIEWS = "e as (select vec_id, unnest([vec_id, vec_id + 1000000, vec_id + 2000000]) a from embeddings where vec_id % 5 = 0 union all select vec_id, vec_id from embeddings where vec_id % 5 <> 0), k as (select vec_id, a, (a * 7919) % 10000019 b from e), left_rows as (select vec_id, a, row_number() over (partition by vec_id order by a) n from k), right_rows as (select vec_id, b, row_number() over (partition by vec_id order by b) n from k where b % 11 <> 0)"


@query(f"with {_VIEWS} select a a_id, b b_id from left_rows l full join right_rows r on l.vec_id = r.vec_id and l.n = r.n")
def same_rows(spark, sf):
    """A view found again in a permuted, scaled one with copies and missing rows."""
    e = pts.from_embeddings(spark, sf)
    a = e.where("row_id % 5 <> 0").select("row_id", "x").union(e.where("row_id % 5 = 0").select(F.explode(F.array(*[F.col("row_id") + i * 1_000_000 for i in range(3)])).alias("row_id"), "x"))
    b = a.select(((F.col("row_id") * 7919) % 10_000_019).alias("row_id"), F.transform("x", lambda t: 3 * t - 2).alias("x")).where("row_id % 11 <> 0")
    return geometry.same_rows(a, b.withColumn("x", F.transform("x", lambda t: (t + 2) / 3)))
