"""Federated rules as driver loops over sufficient statistics.

A backend answers one question: given prototypes for each client, each client's (mass, weighted sum, objective, rows). The
Spark backend answers it with one job whose tasks add up their batches, so a client may hold any share of the rows and no
group is gathered; what returns is clients x prototypes x dimensions numbers. The local backend answers it in memory, for
sweeps of many small runs. The rules are the same code on either.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EPS, Protocol
from ..functions.numeric import best_assignment

P = Protocol()
#: Fixed value: server step of the published baselines (proximal, two-track and clustered rules).
BASELINE_LR = 0.75


def square_distances(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.stack([((x - c) ** 2).sum(axis=1) for c in v], axis=1)


def fuzzy(d2: np.ndarray, m: float) -> np.ndarray:
    if m <= 1:
        raise ValueError("the fuzzifier must be over 1")
    w = np.maximum(d2, EPS) ** (-1 / (m - 1))
    u = w / w.sum(axis=1, keepdims=True)
    on = d2 <= EPS
    rows = on.any(axis=1)
    u[rows] = on[rows] / on[rows].sum(axis=1, keepdims=True)
    return u


@dataclass
class Sums:
    mass: np.ndarray
    weighted: np.ndarray
    objective: float
    n: float

    def means(self, old: np.ndarray) -> np.ndarray:
        out, ok = old.copy(), self.mass > EPS
        out[ok] = self.weighted[ok] / self.mass[ok, None]
        return out


def sums_of(x: np.ndarray, v: np.ndarray, m: float) -> Sums:
    d2 = square_distances(x, v)
    w = fuzzy(d2, m) ** m
    return Sums(w.sum(axis=0), w.T @ x, float((w * d2).sum()), float(len(x)))


def footprint_of(x: np.ndarray, v: np.ndarray, m: float, grid: int = P.grid, q: float = P.quantile) -> np.ndarray:
    d2 = square_distances(x, v)
    w, dist, out = fuzzy(d2, m) ** m, np.sqrt(d2), np.zeros(len(v))
    steps = np.arange(grid) / (grid - 1)
    for j in range(len(v)):
        radii = max(float(np.quantile(dist[:, j], q)), EPS) * steps
        order = np.argsort(dist[:, j], kind="stable")
        total = np.concatenate([[0.0], np.cumsum(w[order, j])])
        out[j] = (total[np.searchsorted(dist[order, j], radii, side="right")] / len(x) * (1 - steps)).max()
    return out


class LocalBackend:
    def __init__(self, clients: list[np.ndarray]):
        self.x = clients
        self.clients = list(range(len(clients)))
        n = np.array([len(c) for c in clients], float)
        self.beta = dict(zip(self.clients, n / n.sum(), strict=True))
        self.rows = dict(zip(self.clients, n, strict=True))

    def sums(self, v: dict[int, np.ndarray], m: float) -> dict[int, Sums]:
        return {p: sums_of(self.x[p], c, m) for p, c in v.items()}

    def footprint(self, v: dict[int, np.ndarray], m: float) -> dict[int, np.ndarray]:
        return {p: footprint_of(self.x[p], c, m) for p, c in v.items()}

    def variance(self) -> dict[int, np.ndarray]:
        return {p: self.x[p].var(axis=0) for p in self.clients}

    def sample(self, p: int, k: int, rng) -> np.ndarray:
        return self.x[p][rng.choice(len(self.x[p]), size=k, replace=False)].copy()


class SparkBackend:
    """points: client, row_id, x. Cached by the caller if it fits; every call is one job over it."""

    def __init__(self, points: DataFrame):
        self.points = points.select("client", "row_id", "x")
        n = {r["client"]: float(r["n"]) for r in points.groupBy("client").agg(F.count("*").alias("n")).collect()}
        self.clients = sorted(n)
        self.rows, self.beta = n, {p: n[p] / sum(n.values()) for p in n}

    def sums(self, v: dict[int, np.ndarray], m: float) -> dict[int, Sums]:
        k, dim = next(iter(v.values())).shape

        def add(batches):
            import pandas as pd

            total: dict[int, np.ndarray] = {}
            for pdf in batches:
                for p, g in pdf.groupby("client"):
                    if p in v:
                        s = sums_of(np.stack(g["x"].to_list()), v[p], m)
                        flat = np.concatenate([s.mass, s.weighted.ravel(), [s.objective, s.n]])
                        total[p] = total.get(p, 0.0) + flat
            if total:
                yield pd.DataFrame({"client": list(total), "flat": [t.tolist() for t in total.values()]})

        rows = self.points.mapInPandas(add, "client int, flat array<double>").select("client", F.posexplode("flat").alias("i", "s"))
        out = {p: np.zeros(k * (dim + 1) + 2) for p in v}
        for r in rows.groupBy("client", "i").agg(F.sum("s").alias("s")).collect():
            out[r["client"]][r["i"]] = r["s"]
        return {p: Sums(a[:k], a[k : k + k * dim].reshape(k, dim), float(a[-2]), float(a[-1])) for p, a in out.items()}

    def footprint(self, v: dict[int, np.ndarray], m: float) -> dict[int, np.ndarray]:
        """All clients must share the prototypes, as the gates do."""
        from ..operators import gates, kernel

        shared = next(iter(v.values()))
        rows = gates.footprint(self.points, kernel.centers_frame(self.points.sparkSession, shared), m).collect()
        out = {p: np.zeros(len(shared)) for p in v}
        for r in rows:
            if r["client"] in out:
                out[r["client"]][r["j"]] = r["footprint"]
        return out

    def variance(self) -> dict[int, np.ndarray]:
        rows = self.points.select("client", F.posexplode("x").alias("d", "t")).groupBy("client", "d").agg(F.var_pop("t").alias("v")).collect()
        out: dict[int, dict] = {p: {} for p in self.clients}
        for r in rows:
            out[r["client"]][r["d"]] = r["v"]
        return {p: np.array([d[i] for i in sorted(d)]) for p, d in out.items()}

    def sample(self, p: int, k: int, rng) -> np.ndarray:
        seed = int(rng.integers(1 << 31))
        rows = self.points.where(F.col("client") == p).orderBy(F.xxhash64("row_id", F.lit(seed))).limit(k).collect()
        return np.array([r["x"] for r in rows])


@dataclass
class Run:
    centers: np.ndarray
    rounds: int
    history: list[float] = field(default_factory=list)
    personal: dict[int, np.ndarray] | None = None
    gates: list[dict[int, np.ndarray]] = field(default_factory=list)
    error: str | None = None


def local_steps(back, starts: dict[int, np.ndarray], steps: int, m: float) -> tuple[dict, dict, dict]:
    """(local centres, masses at the start, masses at the end) after ``steps`` local updates."""
    v, before = dict(starts), None
    for _ in range(steps):
        s = back.sums(v, m)
        before = s if before is None else before
        v = {p: s[p].means(v[p]) for p in v}
    last = back.sums(v, m)
    before = last if before is None else before
    return v, {p: s.mass for p, s in before.items()}, {p: s.mass for p, s in last.items()}


def damped_mean(v: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], lr: float) -> np.ndarray:
    """Parts of (weights, centres); prototypes without weight stay."""
    num = sum((w[:, None] * c for w, c in parts), np.zeros_like(v))
    den = sum((w for w, _ in parts), np.zeros(len(v)))
    target, ok = v.copy(), den > EPS
    target[ok] = num[ok] / den[ok, None]
    return (1 - lr) * v + lr * target


def fcm(back, v: np.ndarray, m: float = 2.0, most: int = 150, tol: float = 1e-5) -> Run:
    """Centralized: all clients' sums are one."""
    history = []
    for i in range(most):
        s = back.sums(dict.fromkeys(back.clients, v), m)
        one = Sums(sum(x.mass for x in s.values()), sum(x.weighted for x in s.values()), sum(x.objective for x in s.values()), 0)
        history.append(one.objective)
        new = one.means(v)
        shift, v = float(np.linalg.norm(new - v)), new
        if shift < tol:
            return Run(v, i + 1, history)
    return Run(v, most, history)


def relevance(value: np.ndarray, floor: float = P.min_relevance) -> np.ndarray:
    return np.clip(value / value.max(), floor, 1.0) if value.max() > EPS else np.full(len(value), floor)


GATES = ("none", "footprint", "mass", "fpmask", "massmask")
#: Gates of one's own by name: (backend, prototypes, fuzzifier, clients, floor) to each client's values.
OWN_GATES: dict = {}


def register_gate(name: str, gate) -> None:
    """Make ``gate`` a kind that run_cell() knows; the built-in names are taken."""
    if name in GATES:
        raise ValueError(f"{name} is built in")
    OWN_GATES[name] = gate


def gate_values(back, v: np.ndarray, kind: str, m: float, clients: list[int], floor: float = P.min_relevance) -> dict[int, np.ndarray]:
    shared = dict.fromkeys(clients, v)
    if kind in OWN_GATES:
        return OWN_GATES[kind](back, v, m, clients, floor)
    if kind == "none":
        return {p: np.ones(len(v)) for p in clients}
    raw = back.footprint(shared, m) if kind in ("footprint", "fpmask") else {p: s.mass for p, s in back.sums(shared, m).items()}
    soft = {p: relevance(r, floor) for p, r in raw.items()}
    return {p: np.where(g > floor, 1.0, floor) for p, g in soft.items()} if kind.endswith("mask") else soft


def run_cell(back, v0: np.ndarray, mass: str = "pre", gate: str = "none", personalize: bool = False, rounds: int = P.rounds, steps: int = P.local_steps, m: float = P.m, lr: float = P.server_lr, fraction: float = 1.0, seed: int = 0, early_stop: bool = True, stop_all: bool = False, server_gate: bool = True, client_gate: bool = True, fixed_relevance: float | None = None, delta_lr: float = P.delta_lr, delta_reg: float = P.delta_reg, floor: float = P.min_relevance, track: bool = False) -> Run:
    """A cell of the design space: mass point x gate x personalization; fraction < 1 draws clients each round.

    Without personalization all rounds are run, unless stop_all. Offsets move by the prototypes before the server's update.
    ``server_gate`` and ``client_gate`` say whether the gate weighs the server's mean and the offsets; ``fixed_relevance``
    takes its place. With ``track`` the history holds the clients' objective under their own prototypes after each round.
    """
    if mass not in ("pre", "post") or gate not in (*GATES, *OWN_GATES):
        raise ValueError(f"unknown cell {mass}_{gate}")
    v, rng = v0.astype(float).copy(), np.random.default_rng(seed)
    delta = {p: np.zeros_like(v) for p in back.clients}
    gates, history, one = [], [], np.ones(len(v))
    for t in range(rounds):
        present = back.clients
        if fraction < 1:
            n = max(1, int(len(present) * fraction))
            present = [back.clients[i] for i in sorted(rng.choice(len(present), size=n, replace=False).tolist())]
        g = gate_values(back, v, gate, m, present, floor) if fixed_relevance is None else {p: fixed_relevance * one for p in present}
        gates.append(g)
        c, pre, post = local_steps(back, {p: v + delta[p] if personalize else v for p in present}, steps, m)
        masses = pre if mass == "pre" else post
        new = damped_mean(v, [(back.beta[p] * masses[p] * (g[p] if server_gate else one), c[p]) for p in present], lr)
        if personalize:
            for p in present:
                aim = (g[p] if client_gate else one)[:, None] * (c[p] - v)
                delta[p] = ((1 - delta_lr) * delta[p] + delta_lr * aim) * (1 - delta_reg)
        shift, v = float(np.linalg.norm(new - v)), new
        if track:
            history.append(sum(s.objective for s in back.sums({p: v + delta[p] for p in back.clients}, m).values()))
        if shift < P.tol and (stop_all or personalize and early_stop):
            break
    own = {p: v + delta[p] for p in back.clients} if personalize else None
    return Run(v, t + 1 if rounds else 0, history, own, gates)


def federated(back, v0: np.ndarray, m: float = 2.0, rounds: int = 45, steps: int = 5, lr: float = 0.8, tol: float = 1e-5, prox: float = 0.0, ditto: float | None = None) -> Run:
    """F-FCM; with ``prox`` local means are pulled to the prototypes; with ``ditto`` a personal track is kept beside."""
    v = v0.astype(float).copy()
    own = {p: v.copy() for p in back.clients}

    def pulled(starts, coef):
        at = dict(starts)
        for _ in range(steps):
            s = back.sums(at, m)
            at = {p: (s[p].weighted + coef * s[p].n * v) / np.maximum(s[p].mass + coef * s[p].n, EPS)[:, None] for p in at}
        return at

    for t in range(rounds):
        if prox:
            c = pulled(dict.fromkeys(back.clients, v), prox)
            post = {p: s.mass for p, s in back.sums(c, m).items()}
        else:
            c, _, post = local_steps(back, dict.fromkeys(back.clients, v), steps, m)
        if ditto is not None:
            own = pulled(own, ditto)
        new = damped_mean(v, [(back.beta[p] * post[p], c[p]) for p in back.clients], lr)
        shift, v = float(np.linalg.norm(new - v)), new
        if shift < tol:
            break
    return Run(v, t + 1, [], own if ditto is not None else None)


def gradient(back, v0: np.ndarray, alpha: float, m: float = 2.0, rounds: int = 50, steps: int = 5, tol: float = 1e-5) -> Run:
    """Gradient exchange: feature variances of each client scale its mass times displacement; clients weigh by rows."""
    v, var = v0.astype(float).copy(), {p: np.maximum(s, EPS) for p, s in back.variance().items()}
    for t in range(rounds):
        c, _, post = local_steps(back, dict.fromkeys(back.clients, v), steps, m)
        step = sum(back.beta[p] * -2.0 * post[p][:, None] * (c[p] - v) / var[p] for p in back.clients)
        new = v - alpha * step
        shift, v = float(np.linalg.norm(new - v)), new
        if not np.isfinite(v).all():
            return Run(v, t + 1, error="diverged")
        if shift < tol:
            break
    return Run(v, t + 1)


def model_averaging(back, v0: np.ndarray, m: float = 2.0, rounds: int = 3, lr: float = 1.0, tol: float = 1e-5, seed: int = 0, most: int = 80, starts: dict[int, np.ndarray] | None = None) -> Run:
    """Local FCM to convergence once, then matching to the prototypes and mass-weighted means. Reports ``rounds`` always.

    A client starts from sampled rows of its own, or from ``starts``.
    """
    v, rng, models = v0.astype(float).copy(), np.random.default_rng(seed), {}
    for p in back.clients:
        at, prev = {p: starts[p] if starts else back.sample(p, len(v), rng)}, None
        for _ in range(most):
            prev, at = at, {p: back.sums(at, m)[p].means(at[p])}
            if np.linalg.norm(at[p] - prev[p]) < tol:
                break
        models[p] = (at[p], back.sums(at, m)[p].mass)
    for _ in range(rounds):
        parts = []
        for p, (c, mass) in models.items():
            order = np.argsort(best_assignment(np.sqrt(square_distances(c, v))))
            parts.append((back.beta[p] * mass[order], c[order]))
        new = damped_mean(v, parts, lr)
        shift, v = float(np.linalg.norm(new - v)), new
        if shift < tol:
            break
    return Run(v, rounds)


def clustered(back, models: list[np.ndarray], m: float = 2.0, rounds: int = 45, steps: int = 5, lr: float = BASELINE_LR, tol: float = 1e-5) -> tuple[list[np.ndarray], dict[int, int]]:
    """IFCA: each client trains the prototype set with its lowest objective (ties to the first)."""
    models = [v.astype(float).copy() for v in models]

    def choose():
        costs = [back.sums(dict.fromkeys(back.clients, v), m) for v in models]
        return {p: int(np.argmin([c[p].objective for c in costs])) for p in back.clients}

    for _ in range(rounds):
        pick = choose()
        c, _, post = local_steps(back, {p: models[k] for p, k in pick.items()}, steps, m)
        new = [damped_mean(v, [(back.beta[p] * post[p], c[p]) for p in back.clients if pick[p] == k], lr) for k, v in enumerate(models)]
        moved = max(float(np.linalg.norm(a - b)) for a, b in zip(new, models, strict=True))
        models = new
        if moved < tol:
            break
    return models, choose()


def k_means(x: np.ndarray, k: int, rng, starts: int = 10, most: int = 300) -> np.ndarray:
    """Lloyd from D^2 sampling, best of ``starts``; an empty cluster takes the farthest point."""
    best, best_cost = None, np.inf
    for _ in range(starts):
        v = x[[rng.integers(len(x))]]
        while len(v) < k:
            d = square_distances(x, v).min(axis=1)
            v = np.vstack([v, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
        for _ in range(most):
            d = square_distances(x, v)
            lab = d.argmin(axis=1)
            new = np.stack([x[lab == j].mean(axis=0) if (lab == j).any() else x[d.min(axis=1).argmax()] for j in range(k)])
            if np.array_equal(new, v):
                break
            v = new
        cost = square_distances(x, v).min(axis=1).sum()
        if cost < best_cost:
            best, best_cost = v, cost
    return best


def pooled_means(back, v0: np.ndarray, m: float = 2.0, rounds: int = 45, steps: int = 5, tol: float = 1e-5, seed: int = 0) -> Run:
    """Local centres of all clients, unweighted, clustered into the next prototypes."""
    v, rng = v0.astype(float).copy(), np.random.default_rng(seed)
    for t in range(rounds):
        c, _, _ = local_steps(back, dict.fromkeys(back.clients, v), steps, m)
        new = k_means(np.vstack([c[p] for p in back.clients]), len(v), np.random.default_rng(int(rng.integers(0, 2**31 - 1))))
        new = new[np.argsort(best_assignment(np.sqrt(square_distances(new, v))))]
        shift, v = float(np.linalg.norm(new - v)), new
        if shift < tol:
            break
    return Run(v, t + 1)


def normalized(back, v0: np.ndarray, taus: dict[int, int] | None = None, m: float = 2.0, rounds: int = 50, steps: int = 5, lr: float = 1.0, tol: float = 1e-5) -> Run:
    """FedNova: displacements for each local step, scaled back by the mean number of steps."""
    v = v0.astype(float).copy()
    taus = taus or dict.fromkeys(back.clients, steps)
    effective = sum(back.beta[p] * taus[p] for p in back.clients)
    for t in range(rounds):
        c: dict[int, np.ndarray] = {}
        for n in sorted(set(taus.values())):
            c |= local_steps(back, {p: v for p in back.clients if taus[p] == n}, n, m)[0]
        new = v - lr * effective * sum(back.beta[p] * (v - c[p]) / taus[p] for p in back.clients)
        shift, v = float(np.linalg.norm(new - v)), new
        if shift < tol:
            break
    return Run(v, t + 1)


def variates(back, v0: np.ndarray, eta_l: float, eta_g: float, m: float = 2.0, rounds: int = 50, steps: int = 5, fraction: float = 1.0, seed: int = 0, tol: float = 1e-5) -> Run:
    """SC-FFCM: local gradient steps corrected by control variates; clients weigh the same."""
    v, cg = v0.astype(float).copy(), np.zeros_like(v0, dtype=float)
    cl, rng = {p: np.zeros_like(cg) for p in back.clients}, np.random.default_rng(seed)
    n = max(1, int(len(back.clients) * fraction))
    for t in range(rounds):
        some = back.clients if n >= len(back.clients) else [back.clients[i] for i in sorted(rng.choice(len(back.clients), size=n, replace=False).tolist())]
        at = dict.fromkeys(some, v)
        for _ in range(steps):
            s = back.sums(at, m)
            at = {p: at[p] - eta_l * (2.0 / s[p].n * (s[p].mass[:, None] * at[p] - s[p].weighted) - cl[p] + cg) for p in some}
        fresh = {p: cl[p] - cg + (v - at[p]) / (steps * eta_l) for p in some}
        dc = sum(fresh[p] - cl[p] for p in some)
        new = v + eta_g * sum(at[p] - v for p in some) / n
        cl |= fresh
        cg = cg + fraction * dc / n
        shift, v = float(np.linalg.norm(new - v)), new
        if not np.isfinite(v).all():
            return Run(v, t + 1, error="diverged")
        if shift < tol:
            break
    return Run(v, t + 1)


def local_only(back, starts: dict[int, np.ndarray], m: float = 2.0, most: int = 150, tol: float = 1e-5) -> dict[int, np.ndarray]:
    """FCM of each client alone; clients that stand still are not asked again."""
    v, live = dict(starts), list(starts)
    for _ in range(most):
        if not live:
            break
        s = back.sums({p: v[p] for p in live}, m)
        new = {p: s[p].means(v[p]) for p in live}
        live = [p for p in live if np.linalg.norm(new[p] - v[p]) >= tol]
        v |= new
    return v
