"""SQL of whole federated runs: each round as common table expressions, for the queries that run the rules as driver loops.

The relations are points pt(row_id, client, x), clients cl(client, n, beta), prototypes of a client (client, j, v) and of the
server (j, v), with v a list. Nothing here is shared with the rules in rounds.py, so equal results say something.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np

from ..config import Protocol

P = Protocol()
DIM = 64
DISTANCE = "list_sum(list_transform(list_zip(x, v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
DIMS = f"range(1, {DIM + 1}) t(i)"


class Script:
    """Common table expressions one after another; each is computed once."""

    def __init__(self, clients: int = 4, k: int = 3, where: str = "true", client: str | None = None):
        self.k, self.parts = k, []
        self.add(f"select vec_id row_id, ({client or f'vec_id % {clients}'})::int client, list_transform(embedding, lambda e: e::double) x from embeddings where {where}", "pt")
        self.add("select client, count(*)::double n, count(*) / sum(count(*)) over () beta from pt group by client", "cl")
        self.add(f"select (row_number() over (order by row_id) - 1)::int j, x v from pt order by row_id limit {k}", "v0")

    def add(self, body: str, name: str | None = None) -> str:
        name = name or f"q{len(self.parts)}"
        self.parts.append(f"{name} as materialized ({body})")
        return name

    def ending(self, body: str) -> str:
        return f"with {', '.join(self.parts)} {body}"

    def flat(self, centers: str) -> str:
        """Rows j, d, val of a relation (j, v)."""
        return self.ending(f"select j::int j, d::int d, round(v[d + 1], 6) + 0.0 val from {centers}, range(0, {DIM}) t(d)")

    def spread(self, v: str, only: list[int] | None = None) -> str:
        """Server prototypes as those of every client, or of ``only`` some."""
        some = f" where client in ({', '.join(map(str, only))})" if only is not None else ""
        return self.add(f"select client, j, v from cl, {v}{some}")

    def weights(self, at: str, m: float = 2.0) -> str:
        """client, row_id, j, x, v, d2, w: the memberships of each client's rows in its prototypes, to the power m."""
        e = -1.0 / (m - 1)
        d = self.add(f"select pt.client, row_id, j, x, v, {DISTANCE} d2 from pt join {at} a on pt.client = a.client")
        z = self.add(f"select *, count(*) filter (d2 <= 1e-12) over (partition by row_id) hits, sum(pow(greatest(d2, 1e-12), {e})) over (partition by row_id) total from {d}")
        return self.add(f"select client, row_id, j, x, v, d2, pow(case when hits > 0 then (case when d2 <= 1e-12 then 1.0 / hits else 0 end) else pow(greatest(d2, 1e-12), {e}) / total end, {m}) w from {z}")

    def sums(self, at: str, m: float = 2.0) -> str:
        """client, j, i, s, mass, cost, v: sums of one dimension, the rest repeated."""
        return self.add(f"select client, j, i, sum(w * x[i]) s, sum(w) mass, sum(w * d2) cost, any_value(v) v from {self.weights(at, m)}, {DIMS} group by client, j, i")

    def means(self, sums: str, expression: str = "case when mass > 1e-12 then s / mass else v[i] end") -> str:
        return self.add(f"select client, j, list({expression} order by i) v from {sums} join cl using (client) group by client, j")

    def steps(self, at: str, n: int) -> tuple[str, str, str]:
        """(prototypes, masses at the start, masses at the end) after n local steps."""
        first = None
        for _ in range(n):
            s = self.sums(at)
            first, at = first or s, self.means(s)
        last = self.sums(at)
        mass = lambda t: self.add(f"select client, j, mass from {t} where i = 1")
        return at, mass(first or last), mass(last)

    def server(self, v: str, local: str, weight: str, lr: float) -> str:
        """Damped weighted mean; ``weight`` is a relation client, j, w."""
        s = self.add(f"select j, i, sum(w * v[i]) a, sum(w) b from {local} join {weight} using (client, j), {DIMS} group by j, i")
        return self.add(f"select o.j, list((1 - {lr}) * o.v[i] + {lr} * (case when b > 1e-12 then a / b else o.v[i] end) order by i) v from {v} o join {s} using (j) group by o.j")

    def gate(self, at: str, kind: str) -> str:
        """client, j, g at shared prototypes."""
        floor = P.min_relevance
        if kind == "none":
            return self.add(f"select client, j, 1.0::double g from {at}")
        if kind in ("mass", "massmask"):
            raw = self.add(f"select client, j, mass raw from {self.sums(at)} where i = 1")
        else:
            w, top = self.weights(at), P.grid - 1
            r = self.add(f"select client, j, greatest(quantile_cont(sqrt(d2), {P.quantile}), 1e-12) r, count(*) n from {w} group by client, j")
            g = self.add(f"select client, j, g, r * g / {top}.0 radius, n from {r}, range(0, {P.grid}) t(g)")
            c = self.add(f"select a.client, a.j, g, coalesce(sum(w) filter (sqrt(d2) <= radius), 0) / any_value(n) * (1 - g / {top}.0) val from {g} a join {w} b on a.client = b.client and a.j = b.j group by a.client, a.j, g")
            raw = self.add(f"select client, j, max(val) raw from {c} group by client, j")
        soft = f"case when max(raw) over (partition by client) > 1e-12 then least(1.0, greatest({floor}, raw / max(raw) over (partition by client))) else {floor} end"
        soft = self.add(f"select client, j, ({soft})::double g from {raw}")
        return self.add(f"select client, j, (case when g > {floor} then 1.0 else {floor} end)::double g from {soft}") if kind.endswith("mask") else soft

    def stacked(self, v: str, own: str) -> str:
        """The server's prototypes, then each client's, numbered through."""
        return self.add(f"select j, v from {v} union all select {self.k} * (client + 1) + j, v from {own}")


def cell_rounds(q: Script, mass: str, gate: str, personalize: bool = False, rounds: int = 2, steps: int = 1, fraction: float = 1.0, seed: int = 0, server_gate: bool = True, client_gate: bool = True, fixed: float | None = None, clients: int = 4, lr: float = P.server_lr) -> tuple[str, str | None, list[tuple]]:
    """Prototypes, offsets, and of each round (start, local centres, masses before and after) of a cell over the points of ``q``."""
    v, delta, log = "v0", None, []
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        present = sorted(rng.choice(clients, size=max(1, int(clients * fraction)), replace=False).tolist()) if fraction < 1 else None
        shared = q.spread(v, present)
        g = q.gate(shared, gate) if fixed is None else q.add(f"select client, j, {fixed}::double g from {shared}")
        start = q.add(f"select client, j, list_transform(list_zip(s.v, d.v), lambda z: z[1] + z[2]) v from {shared} s join {delta} d using (client, j)") if delta else shared
        local, pre, post = q.steps(start, steps)
        log.append((shared, local, pre, post))
        weight = q.add(f"select client, j, beta * mass * {'g' if server_gate else '1.0'} w from {pre if mass == 'pre' else post} join {g} using (client, j) join cl using (client)")
        new = q.server(v, local, weight, lr)
        if personalize:
            old = delta or q.add(f"select client, j, list_transform(v, lambda z: 0.0::double) v from {shared}")
            moved = f"(({1 - P.delta_lr}) * d.v[i] + {P.delta_lr} * {'g' if client_gate else '1.0'} * (c.v[i] - s.v[i])) * {1 - P.delta_reg}"
            delta = q.add(f"select client, j, list({moved} order by i) v from {old} d join {local} c using (client, j) join {shared} s using (client, j) join {g} using (client, j), {DIMS} group by client, j")
        v = new
    return v, delta, log


def cell(mass: str, gate: str, personalize: bool = False, ending=None, client: str | None = None, **more) -> str:
    q = Script(more.get("clients", 4), client=client)
    v, delta, _ = cell_rounds(q, mass, gate, personalize, **more)
    if ending:
        return ending(q, v, own_sets(q, v, delta) if personalize else None)
    return q.flat(q.stacked(v, own_sets(q, v, delta))) if personalize else q.flat(v)


def own_sets(q: Script, v: str, delta: str) -> str:
    return q.add(f"select client, j, list_transform(list_zip(a.v, d.v), lambda z: z[1] + z[2]) v from {delta} d join {v} a using (j)")


def judged(q: Script, own: str) -> str:
    """client, row_id, y, pred, cost, entropy of every point of ``q`` under its client's prototypes."""
    return q.add(f"select client, row_id, any_value(label) y, arg_min(j, (greatest(d2, 1e-12), j)) pred, sum(w * d2) cost, -sum(sqrt(w) * ln(greatest(sqrt(w), 1e-300))) entropy from {q.weights(own)} join embeddings on vec_id = row_id group by client, row_id")


def best_hits(q: Script, table: str, clusters: int) -> str:
    """g, hits: the most agreement of any matching in a contingency table (g, pred, y, n): the best of each set of labels used so far, cluster after cluster."""
    s = q.add(f"select distinct g, 0 used, 0::hugeint hits from {table}")
    for p in range(clusters):
        s = q.add(f"select g, used, max(hits) hits from (select g, used, hits from {s} union all select a.g, a.used | (1 << t.y), a.hits + t.n from {s} a join {table} t on t.g = a.g and t.pred = {p} and a.used & (1 << t.y) = 0) group by g, used")
    return q.add(f"select g, max(hits)::double hits from {s} group by g")


def names(q: Script, table: str, clusters: int) -> str:
    """g, pred, name: of all matchings with as many pairs as fit the one with most agreement, then the first labels."""
    labels = q.add(f"select distinct g, y from {table}")
    s = q.add(f"select distinct g, 0 used, 0::hugeint hits, 0::bigint code, 0 pairs from {table}")
    for p in range(clusters):
        here = q.add(f"select g, count(*) filter (pred = {p}) > 0 here from {table} group by g")
        pair = f"select a.g, a.used | (1 << l.y), a.hits + coalesce(t.n, 0), a.code * 100 + l.y, a.pairs + 1 from {s} a join {here} h on h.g = a.g and h.here join {labels} l on l.g = a.g and a.used & (1 << l.y) = 0 left join {table} t on t.g = a.g and t.pred = {p} and t.y = l.y"
        s = q.add(f"select g, used, hits, code * 100 + 99 code, pairs from {s} union all {pair}")
    best = q.add(f"select * from {s} qualify row_number() over (partition by g order by pairs desc, hits desc, code) = 1")
    return q.add(" union all ".join(f"select g, {p} pred, (code // {100 ** (clusters - 1 - p)}) % 100 as name from {best}" for p in range(clusters)))


def bundle(q: Script, v: str, own: str | None = None) -> str:
    """The seven metrics of prototypes ``v`` and, where clients have them, their own."""
    rows = judged(q, own or q.spread(v))
    each = q.add(f"select client g, pred, y, count(*) n from {rows} group by all")
    whole = q.add(f"select 0 g, pred, y, sum(n) n from {each} group by all")
    acc = q.add(f"select hits / n acc from {best_hits(q, each, q.k)} join cl on client = g")
    shared = q.weights(q.spread(v))
    apart = q.add(f"select min({DISTANCE.replace('(x, v)', '(a.v, b.v)')}) sep from {v} a, {v} b where a.j < b.j")
    return q.ending(f"""select round(sqrt(sep), 6) min_dist, (select round(avg(acc), 6) from {acc}) mean_acc, (select round(min(acc), 6) from {acc}) worst_acc, (select round(avg(cost), 6) from {rows}) fcm_obj,
(select round(hits / (select sum(n) from {whole}), 6) from {best_hits(q, whole, q.k)}) gacc, (select round(sum(w * d2) / count(distinct row_id) / (select sep from {apart}), 3) from {shared}) xb, (select round(avg(entropy) / ln({q.k}), 6) from {rows}) hnorm from {apart}""")


def cost(q: Script, v: str, own: str | None = None) -> str:
    """The clients' objective at ``v``."""
    return q.ending(f"select sum(w * d2) objective from {q.weights(q.spread(v))}")


def stacked_rows(named: dict[str, str]) -> str:
    """The rows of several scripts, each with the columns that its name (SQL) says."""
    return " union all ".join(f"select {name}, t.* from ({sql}) t" for name, sql in named.items())


def personal_bundle(rounds: int = 2, steps: int = 1) -> str:
    return cell("post", "footprint", True, bundle, rounds=rounds, steps=steps)


#: Columns of a client's validity.
VALIDITY = ("fpc", "partition_entropy", "xie_beni", "davies_bouldin", "min_center_distance", "collapse_threshold", "collapsed_pairs", "prototype_mass_entropy", "effective_prototypes", "underused_prototypes")


def personal_validity(ending: str, rounds: int = 2, steps: int = 1, ratio: float = 0.03) -> str:
    """Validity of each client under its own prototypes (relation ``val``), then ``ending``."""
    q = Script()
    v, delta, _ = cell_rounds(q, "post", "footprint", True, rounds=rounds, steps=steps)
    own = own_sets(q, v, delta)
    w, lab = q.weights(own), judged(q, own)
    u = q.add(f"select client, sum(w) / count(distinct row_id) fpc, -sum(sqrt(w) * ln(greatest(sqrt(w), 1e-12))) / count(distinct row_id) partition_entropy, sum(w * d2) / count(distinct row_id) cost from {w} group by client")
    m = q.add(f"select client, sum(w) / sum(sum(w)) over (partition by client) p from {w} group by client, j")
    e = q.add(f"select client, -sum(p * ln(greatest(p, 1e-12))) / ln({q.k}) prototype_mass_entropy, exp(-sum(p * ln(greatest(p, 1e-12)))) effective_prototypes, count(*) filter (p < 0.01) underused_prototypes from {m} group by client")
    s = q.add(f"select client, greatest(1e-8, {ratio} * sqrt(sum(t))) collapse_threshold from (select client, i, var_pop(x[i]) t from pt, {DIMS} group by client, i) group by client")
    d = q.add(f"select a.client, sqrt({DISTANCE.replace('(x, v)', '(a.v, b.v)')}) d from {own} a join {own} b on a.client = b.client and a.j < b.j")
    g = q.add(f"select client, min(d) min_center_distance, any_value(collapse_threshold) collapse_threshold, count(*) filter (d < collapse_threshold) collapsed_pairs from {d} join {s} using (client) group by client")
    pred = q.add(f"select l.client, l.row_id, pred, x from {lab} l join pt using (row_id)")
    cent = q.add(f"select client, pred, list(t order by i) v from (select client, pred, i, avg(x[i]) t from {pred}, {DIMS} group by client, pred, i) group by client, pred")
    sc = q.add(f"select client, pred, any_value(v) v, avg(sqrt({DISTANCE})) s from {pred} join {cent} using (client, pred) group by client, pred")
    worst = q.add(f"select a.client, a.pred, max((a.s + b.s) / sqrt({DISTANCE.replace('(x, v)', '(a.v, b.v)')})) r from {sc} a join {sc} b on a.client = b.client and a.pred <> b.pred group by a.client, a.pred")
    dbi = q.add(f"select cl.client, avg(r) davies_bouldin from cl left join {worst} using (client) group by cl.client")
    q.add(f"select client, fpc, partition_entropy, cost / pow(min_center_distance, 2) xie_beni, davies_bouldin, min_center_distance, collapse_threshold, collapsed_pairs, prototype_mass_entropy, effective_prototypes, underused_prototypes from {u} join {e} using (client) join {g} using (client) join {dbi} using (client)", "val")
    return q.ending(ending)


def held_out(rounds: int = 2, steps: int = 1) -> str:
    """The eight held-out numbers: fitted on rows whose number is not divisible by 5, judged on the others."""
    q = Script(where="vec_id % 5 <> 0")
    v, delta, _ = cell_rounds(q, "post", "footprint", True, rounds, steps)
    own = own_sets(q, v, delta)
    train = judged(q, own)
    q.add("select vec_id row_id, (vec_id % 4)::int client, list_transform(embedding, lambda e: e::double) x from embeddings where vec_id % 5 = 0", "held")
    body = q.weights(own)  # the same expressions once more over the held rows
    made = [i for i, part in enumerate(q.parts) if part.startswith(body)][0]
    q.parts[made - 2 : made + 1] = [part.replace("from pt join", "from held pt join") for part in q.parts[made - 2 : made + 1]]
    test = q.add(f"select client, row_id, any_value(label) y, arg_min(j, (greatest(d2, 1e-12), j)) pred, sum(w * d2) cost, -sum(sqrt(w) * ln(greatest(sqrt(w), 1e-300))) entropy from {body} join embeddings on vec_id = row_id group by client, row_id")
    cells = lambda rows, g: q.add(f"select {g} g, pred, y, count(*) n from {rows} group by all")
    parts = []
    for g in ("0", "client"):
        a, b = cells(train, g), cells(test, g)
        parts.append(q.add(f"select b.g, sum(case when b.y = m.name then b.n else 0 end) / sum(b.n) acc from {b} b left join {names(q, a, q.k)} m on m.g = b.g and m.pred = b.pred group by b.g"))
        parts.append(q.add(f"select g, hits / (select sum(n) from {b} b where b.g = h.g) acc from {best_hits(q, b, q.k)} h"))
    pooled, refit_all, mapped, refit = parts
    of = lambda t, f: f"(select round({f}(acc), 6) from {t})"
    return q.ending(f"select round(avg(cost), 6) test_fcm_obj, round(avg(entropy) / ln({q.k}), 6) test_hnorm, {of(pooled, 'max')} test_gacc_trmap, {of(mapped, 'avg')} test_mean_acc_trmap, {of(mapped, 'min')} test_worst_acc_trmap, {of(refit_all, 'max')} test_gacc, {of(refit, 'avg')} test_mean_acc_refit, {of(refit, 'min')} test_worst_acc_refit from {test}")


def trajectory(rounds: int = 3, steps: int = 1, clients: int = 4) -> tuple[Script, str]:
    """The relation (round, client, j, b, n, pre, post, r, q, c) of a run with the footprint gate after the local steps."""
    q = Script(clients)
    _, _, log = cell_rounds(q, "post", "footprint", rounds=rounds, steps=steps, clients=clients)
    parts = []
    for t, (shared, local, pre, post) in enumerate(log):
        r, m = q.gate(shared, "footprint"), q.gate(shared, "mass")
        parts.append(f"select {t} round, client, j, beta b, n, a.mass pre, z.mass post, r.g r, m.g q, c.v c from {local} c join {pre} a using (client, j) join {post} z using (client, j) join {r} r using (client, j) join {m} m using (client, j) join cl using (client)")
    return q, q.add(" union all ".join(parts))


def greedy_starts(q: Script, pts: str, k: int, restarts: int, seed: int, trials: int) -> str:
    """r, j, v: starts drawn step by step from a relation (id, x), all restarts side by side."""
    apart = DISTANCE.replace("(x, v)", "(p.x, c.v)")

    def even(step: int, candidate: str) -> str:
        return f"-ln((('0x' || md5('{seed}|' || r || '|{step}|' || {candidate} || '|' || id)[1:13])::bigint + 0.5) / {16**13}.0)"

    chosen = q.add(f"select r, 0 j, arg_min(x, ({even(0, '0')}, id)) v from {pts}, range({restarts}) t(r) group by r")
    for step in range(1, k):
        cost = q.add(f"select r, id, any_value(p.x) x, min({apart}) cost from {pts} p, {chosen} c group by r, id")
        tried = q.add(f"select r, n, arg_min(x, ({even(step, 'n')} / cost, id)) v from {cost}, range({trials}) t(n) where cost > 0 group by r, n")
        sums = q.add(f"select r, n, any_value(c.v) v, sum(least(cost, {apart})) s from {cost} p join {tried} c using (r) group by r, n")
        chosen = q.add(f"select * from {chosen} union all select r, {step}, arg_min(v, (s, n)) from {sums} group by r")
    return chosen


def k_means(q: Script, pts: str, k: int, restarts: int, seed: int, trials: int, rounds: int) -> str:
    """j, v: the centres of the best restart after so many rounds (a standing one stays)."""
    v = greedy_starts(q, pts, k, restarts, seed, trials)
    near = lambda v: q.add(f"select r, id, any_value(p.x) x, arg_min(j, ({DISTANCE.replace('(x, v)', '(p.x, c.v)')}, j)) j, min({DISTANCE.replace('(x, v)', '(p.x, c.v)')}) cost from {pts} p, {v} c group by r, id")
    for _ in range(rounds):
        v = q.add(f"select r, j, list(m order by i) v from (select r, j, i, avg(x[i]) m from {near(v)}, {DIMS} group by r, j, i) group by r, j")
    best = q.add(f"select arg_min(r, (s, r)) r from (select r, sum(cost) s from {near(v)} group by r)")
    return q.add(f"select j, v from {v} join {best} using (r)")


def starts(k: int, restarts: int, seed: int, trials: int) -> str:
    q = Script()
    pts = q.add("select row_id id, x from pt")
    chosen = greedy_starts(q, pts, k, restarts, seed, trials)
    return q.flat(q.add(f"select r * {k} + j j, v from {chosen}"))


def pooled(rounds: int, steps: int, restarts: int, lloyd: int, clients: int = 4) -> str:
    """Local centres of all clients clustered into the next prototypes, which take the order of the cheapest matching."""
    q, v = Script(clients), "v0"
    orders = q.add("select * from (values " + ", ".join(f"({n}, {j}, {g})" for n, order in enumerate(permutations(range(q.k))) for j, g in enumerate(order)) + ") t(n, j, g)")
    for t in range(rounds):
        local, _, _ = q.steps(q.spread(v), steps)
        new = k_means(q, q.add(f"select client * {q.k} + j id, v x from {local}"), q.k, restarts, t, 2 + int(np.log(q.k)), lloyd)
        apart = q.add(f"select a.j, b.j g, sqrt({DISTANCE.replace('(x, v)', '(a.v, b.v)')}) d from {new} a, {v} b")
        best = q.add(f"select arg_min(n, (cost, n)) n from (select n, sum(d) cost from {apart} join {orders} using (j, g) group by n)")
        v = q.add(f"select g j, v from {new} join {orders} using (j) join {best} using (n)")
    return q.flat(v)


def central(iterations: int, ending=None, m: float = 2.0, start=None, client: str | None = None, k: int = 3) -> str:
    q = Script(k=k, client=client)
    v = start(q) if start else "v0"
    for _ in range(iterations):
        s = q.sums(q.spread(v), m)
        one = q.add(f"select j, i, sum(s) s, sum(mass) mass, any_value(v) v from {s} group by j, i")
        v = q.add(f"select j, list(case when mass > 1e-12 then s / mass else v[i] end order by i) v from {one} group by j")
    return ending(q, v) if ending else q.flat(v)


def pulled(coef: float) -> str:
    """A local mean drawn to the server's prototype g by coef times the client's rows."""
    return f"(s + {coef} * n * g) / greatest(mass + {coef} * n, 1e-12)"


def federated(rounds: int, steps: int, lr: float, prox: float = 0.0, ditto: float | None = None, clients: int = 4, ending=None, client: str | None = None) -> str:
    q, v, own = Script(clients, client=client), "v0", None

    def drawn(at: str, server: str, coef: float) -> str:
        for _ in range(steps):
            s = q.sums(at)
            with_g = q.add(f"select s.*, a.v[i] g from {s} s join {server} a using (j)")
            at = q.means(with_g, pulled(coef))
        return at

    for _ in range(rounds):
        shared = q.spread(v)
        if prox:
            local = drawn(shared, v, prox)
            post = q.add(f"select client, j, mass from {q.sums(local)} where i = 1")
        else:
            local, _, post = q.steps(shared, steps)
        if ditto is not None:
            own = drawn(own or shared, v, ditto)
        weight = q.add(f"select client, j, beta * mass w from {post} join cl using (client)")
        v = q.server(v, local, weight, lr)
    if ending:
        return ending(q, v, own)
    return q.flat(q.stacked(v, own) if own else v)


def clustered(shift: float, rounds: int, steps: int, lr: float) -> str:
    """Two prototype sets, the second moved by ``shift``; each client trains the one that costs it least."""
    q = Script()
    models = ["v0", q.add(f"select j, list_transform(v, lambda z: z + {shift}) v from v0")]
    for _ in range(rounds):
        costs = q.add(" union all ".join(f"select client, {k} k, sum(cost) cost from {q.sums(q.spread(v))} where i = 1 group by client" for k, v in enumerate(models)))
        pick = q.add(f"select client, arg_min(k, (cost, k)) k from {costs} group by client")
        every = q.add(" union all ".join(f"select {k} k, j, v from {v}" for k, v in enumerate(models)))
        start = q.add(f"select client, j, v from {pick} join {every} using (k)")
        local, _, post = q.steps(start, steps)
        new = []
        for k, v in enumerate(models):
            weight = q.add(f"select client, j, case when k = {k} then beta * mass else 0 end w from {post} join cl using (client) join {pick} using (client)")
            new.append(q.server(v, local, weight, lr))
        models = new
    return q.flat(q.add(f"select j, v from {models[0]} union all select {q.k} + j, v from {models[1]}"))


def normalized(taus: dict[int, int], rounds: int, ending=None, client: str | None = None) -> str:
    q, v = Script(client=client), "v0"
    t = q.add("select * from (values " + ", ".join(f"({p}, {n}.0::double)" for p, n in taus.items()) + ") t(client, tau)")
    for _ in range(rounds):
        parts = []
        for n in sorted(set(taus.values())):
            some = q.spread(v, [p for p in taus if taus[p] == n])
            parts.append(q.steps(some, n)[0])
        local = q.add(" union all ".join(f"select client, j, v from {p}" for p in parts))
        move = q.add(f"select c.j, i, (select sum(beta * tau) from cl join {t} using (client)) * sum(beta * (a.v[i] - c.v[i]) / tau) d from {local} c join {v} a using (j) join cl using (client) join {t} using (client), {DIMS} group by c.j, i")
        v = q.add(f"select a.j, list(a.v[i] - d order by i) v from {v} a join {move} using (j) group by a.j")
    return ending(q, v) if ending else q.flat(v)


def gradient(alpha: float, rounds: int, steps: int, ending=None, client: str | None = None) -> str:
    q, v = Script(client=client), "v0"
    var = q.add(f"select client, i, greatest(var_pop(x[i]), 1e-12) s2 from pt, {DIMS} group by client, i")
    for _ in range(rounds):
        local, _, post = q.steps(q.spread(v), steps)
        g = q.add(f"select c.j, s.i, sum(beta * 2.0 * mass * (c.v[s.i] - a.v[s.i]) / s2) g from {local} c join {post} using (client, j) join {v} a using (j) join cl using (client) join {var} s using (client) group by c.j, s.i")
        v = q.add(f"select a.j, list(a.v[i] + {alpha} * g order by i) v from {v} a join {g} using (j) group by a.j")
    return ending(q, v) if ending else q.flat(v)


def variates(eta_l: float, eta_g: float, rounds: int, steps: int, fraction: float, seed: int = 0, clients: int = 4, ending=None, client: str | None = None) -> str:
    q, v = Script(clients, client=client), "v0"
    rng, n = np.random.default_rng(seed), max(1, int(clients * fraction))
    zero = "list_transform(v, lambda z: 0.0::double) v"
    cg, cl = q.add(f"select j, {zero} from v0"), q.add(f"select client, j, {zero} from cl, v0")
    for _ in range(rounds):
        some = sorted(rng.choice(clients, size=n, replace=False).tolist()) if n < clients else list(range(clients))
        start = at = q.spread(v, some)
        for _ in range(steps):
            s = q.add(f"select s.*, c.v[i] own, g.v[i] whole from {q.sums(at)} s join {cl} c using (client, j) join {cg} g using (j)")
            at = q.means(s, f"v[i] - {eta_l} * (2.0 / n * (mass * v[i] - s) - own + whole)")
        d = q.add(f"select client, j, i, c.v[i] old, c.v[i] - g.v[i] + (o.v[i] - a.v[i]) / ({steps} * {eta_l}) fresh, a.v[i] - o.v[i] moved from {at} a join {start} o using (client, j) join {cl} c using (client, j) join {cg} g using (j), {DIMS}")
        sums = q.add(f"select j, i, sum(moved) moved, sum(fresh - old) dc from {d} group by j, i")
        v = q.add(f"select o.j, list(o.v[i] + {eta_g} * moved / {n} order by i) v from {v} o join {sums} using (j) group by o.j")
        fresh = q.add(f"select client, j, list(fresh order by i) v from {d} group by client, j")
        cl = q.add(f"select client, j, coalesce(f.v, c.v) v from {cl} c left join {fresh} f using (client, j)")
        cg = q.add(f"select g.j, list(g.v[i] + {fraction} * dc / {n} order by i) v from {cg} g join {sums} using (j) group by g.j")
    return ending(q, v) if ending else q.flat(v)


def alone(iterations: int) -> str:
    q = Script()
    at = q.spread("v0")
    for _ in range(iterations):
        at = q.means(q.sums(at))
    return q.flat(q.add(f"select {q.k} * client + j j, v from {at}"))


def averaged(iterations: int, rounds: int = 3, lr: float = 1.0, shift: float = 0.0) -> str:
    """Each client alone, client p from the first prototypes moved by p times ``shift``, then means of the prototypes matched by the cheapest of all orders."""
    q, v = Script(), "v0"
    at = q.add(f"select client, j, list_transform(v, lambda z: z + {shift} * client) v from {q.spread(v)}")
    for _ in range(iterations):
        at = q.means(q.sums(at))
    mass = q.add(f"select client, j, mass from {q.sums(at)} where i = 1")
    orders = q.add("select * from (values " + ", ".join(f"({n}, {j}, {g})" for n, order in enumerate(permutations(range(q.k))) for j, g in enumerate(order)) + ") t(n, j, g)")
    for _ in range(rounds):
        apart = q.add(f"select client, a.j, b.j g, sqrt({DISTANCE.replace('(x, v)', '(a.v, b.v)')}) d from {at} a, {v} b")
        cost = q.add(f"select client, n, sum(d) cost from {apart} join {orders} using (j, g) group by client, n")
        best = q.add(f"select client, arg_min(n, (cost, n)) n from {cost} group by client")
        named = q.add(f"select client, g j, v, beta * mass w from {at} join {mass} using (client, j) join {best} using (client) join {orders} using (n, j) join cl using (client)")
        v = q.server(v, q.add(f"select client, j, v from {named}"), q.add(f"select client, j, w from {named}"), lr)
    return q.flat(v)
