"""Iterated rules whose client state is a table: offsets, personal prototypes, control variates.

A rule is a client's program and a server's step. A program asks for sums (or footprints) of its client's rows under given
prototypes, as often as it has local steps, and ends with its new state and with numbers to be added up for the server.

Points are written once, bucketed by client; a client's state is a row of a table with the same buckets. A round cogroups the
two without a shuffle, runs each program on its client's rows in one task, writes the new states, and adds up the server's
numbers: the same few jobs whatever the number of local steps and clients. The driver holds the k prototypes.

A client of more than MOST_VALUES numbers does not fit that: its rows stay dealt over all tasks, and its program is run on the
driver, which answers each request by one job for all such clients together. They are few (each holds that many numbers;
more than MOST_BULK are refused), so their states are, and no client is gathered however large its share of the rows.
"""

from __future__ import annotations

from collections.abc import Generator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EPS, Protocol
from ..functions.numeric import best_assignment
from ..operators import kernel, starts
from ..operators.ranks import numbered
from ..sources.shared import bucketed, deleted, written
from .rounds import BASELINE_LR, SparkBackend, footprint_of, relevance, square_distances, sums_of

P = Protocol()
#: Numbers (rows times dimensions) of a client that one task may hold, and clients beyond that at most.
MOST_VALUES = 16 << 20
MOST_BULK = 10_000
#: Rows of a bucket, about; buckets at least and at most.
BUCKET_ROWS = 500_000
BUCKETS = (8, 20_000)

Program = Generator[tuple, object, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _steps(at: np.ndarray, steps: int, m: float):
    """(local centres, masses at the start, masses at the end) of one client; a part of a program."""
    before = None
    for _ in range(steps):
        s = yield "sums", at, m
        before, at = s.mass if before is None else before, s.means(at)
    last = yield "sums", at, m
    return at, last.mass if before is None else before, last.mass


def _pulled(at: np.ndarray, to: np.ndarray, coef: float, steps: int, m: float):
    for _ in range(steps):
        s = yield "sums", at, m
        at = (s.weighted + coef * s.n * to) / np.maximum(s.mass + coef * s.n, EPS)[:, None]
    return at


def _damped(v: np.ndarray, total: np.ndarray, lr: float) -> np.ndarray:
    """``total`` holds weighted centres, then weights; prototypes without weight stay."""
    k, d = v.shape
    num, den = total[: k * d].reshape(k, d), total[k * d : k * d + k]
    target, ok = v.copy(), den > EPS
    target[ok] = num[ok] / den[ok, None]
    return (1 - lr) * v + lr * target


@dataclass(frozen=True)
class Cell:
    """A cell of the design space: mass point, gate, personalization by offsets (the state)."""

    mass: str = "post"
    gate: str = "footprint"
    personalize: bool = True
    steps: int = P.local_steps
    m: float = P.m
    lr: float = P.server_lr
    delta_lr: float = P.delta_lr
    delta_reg: float = P.delta_reg
    floor: float = P.min_relevance
    server_gate: bool = True
    client_gate: bool = True
    fixed_relevance: float | None = None
    track: bool = False

    def program(self, v: np.ndarray, server: np.ndarray, own: np.ndarray, beta: float) -> Program:
        one = np.ones(len(v))
        need_r = self.fixed_relevance is None and self.gate in ("footprint", "fpmask")
        need_q = self.fixed_relevance is None and self.gate in ("mass", "massmask")
        foot = (yield "footprint", v, self.m) if need_r or self.track else None
        shared = (yield "sums", v, self.m) if need_q or self.track else None
        if self.fixed_relevance is not None:
            g = self.fixed_relevance * one
        elif need_r or need_q:
            g = relevance(foot if need_r else shared.mass, self.floor)
            g = np.where(g > self.floor, 1.0, self.floor) if self.gate.endswith("mask") else g
        elif self.gate == "none":
            g = one
        else:
            raise ValueError(f"unknown gate {self.gate}")
        c, pre, post = yield from _steps(v + own if self.personalize else v, self.steps, self.m)
        w = beta * (pre if self.mass == "pre" else post) * (g if self.server_gate else one)
        if self.personalize:
            aim = (g if self.client_gate else one)[:, None] * (c - v)
            own = ((1 - self.delta_lr) * own + self.delta_lr * aim) * (1 - self.delta_reg)
        trace = np.concatenate([pre, post, foot, relevance(foot, self.floor), relevance(shared.mass, self.floor), c.ravel()]) if self.track else np.zeros(0)
        return own, np.concatenate([(w[:, None] * c).ravel(), w]), trace

    def start(self, v: np.ndarray) -> np.ndarray:
        return np.zeros_like(v)

    def update(self, v, server, total, present, clients):
        return _damped(v, total, self.lr), server

    def personal(self, v: np.ndarray, own: np.ndarray) -> np.ndarray:
        return v + own


@dataclass(frozen=True)
class Tracks:
    """F-FCM; with ``prox`` local means are pulled to the prototypes; with ``ditto`` personal prototypes (the state) are kept beside."""

    steps: int = P.local_steps
    m: float = P.m
    lr: float = BASELINE_LR
    prox: float = 0.0
    ditto: float | None = None

    def program(self, v, server, own, beta) -> Program:
        if self.prox:
            c = yield from _pulled(v, v, self.prox, self.steps, self.m)
            post = (yield "sums", c, self.m).mass
        else:
            c, _, post = yield from _steps(v, self.steps, self.m)
        if self.ditto is not None:
            own = yield from _pulled(own, v, self.ditto, self.steps, self.m)
        w = beta * post
        return own, np.concatenate([(w[:, None] * c).ravel(), w]), np.zeros(0)

    def start(self, v):
        return v

    def update(self, v, server, total, present, clients):
        return _damped(v, total, self.lr), server

    def personal(self, v, own):
        return v if self.ditto is None else own


@dataclass(frozen=True)
class Variates:
    """SC-FFCM: local gradient steps corrected by control variates (the state) and the server's; clients weigh the same."""

    eta_l: float = 0.05
    eta_g: float = 1.0
    steps: int = P.local_steps
    m: float = P.m

    def program(self, v, server, own, beta) -> Program:
        at = v
        for _ in range(self.steps):
            s = yield "sums", at, self.m
            at = at - self.eta_l * (2.0 / s.n * (s.mass[:, None] * at - s.weighted) - own + server)
        fresh = own - server + (v - at) / (self.steps * self.eta_l)
        return fresh, np.concatenate([(at - v).ravel(), (fresh - own).ravel()]), np.zeros(0)

    def start(self, v):
        return np.zeros_like(v)

    def update(self, v, server, total, present, clients):
        moved, dc = total.reshape(2, *v.shape)
        return v + self.eta_g * moved / present, server + (present / clients) * dc / present

    def personal(self, v, own):
        return v


@dataclass(frozen=True)
class Pooled:
    """Local centres of all clients (the state), unweighted, clustered into the next prototypes by k-means over their table.

    The next prototypes stand in the order of the cheapest matching with those before. Round t draws its starts with seed + t.
    """

    steps: int = P.local_steps
    m: float = P.m
    restarts: int = 10
    most: int = 300
    seed: int = 0

    def program(self, v, server, own, beta) -> Program:
        c, _, _ = yield from _steps(v, self.steps, self.m)
        return c, np.zeros(0), np.zeros(0)

    def start(self, v):
        return v

    def pool(self, states: DataFrame, v: np.ndarray, t: int) -> np.ndarray:
        k, d = v.shape
        each = F.explode(F.array(*[F.lit(j) for j in range(k)])).alias("j")
        rows = states.select("client", "own", each).select((F.col("client") * k + F.col("j")).cast("long").alias("row_id"), F.slice("own", F.col("j") * d + 1, F.lit(d)).alias("x"))
        rows = written(rows, "local-centers")
        new = starts.k_means(rows, k, self.restarts, self.seed + t, self.most)
        deleted(rows)
        return new[np.argsort(best_assignment(np.sqrt(square_distances(new, v))))]

    def personal(self, v, own):
        return v


@dataclass
class StateRun:
    """``centers`` and rounds; ``state`` (client, beta, own), the clients' last states; ``trajectory`` of a tracked Cell."""

    centers: np.ndarray
    rounds: int
    state: DataFrame
    trajectory: DataFrame | None = None
    error: str | None = None
    rule: object = None

    def personal(self) -> DataFrame:
        """client, cs array<struct<j, v>>: the prototypes by which each client is judged. One row a client, made where its state lies."""
        v, rule = self.centers, self.rule
        k, d = v.shape

        def unpack(batches):
            for b in batches:
                own = np.array(b.column(1).flatten()).reshape(-1, k, d)
                yield pa.RecordBatch.from_pylist([{"client": c, "cs": [{"j": j, "v": row.tolist()} for j, row in enumerate(rule.personal(v, o))]} for c, o in zip(b.column(0).to_pylist(), own, strict=True)], schema=pa.schema([("client", pa.int32()), ("cs", pa.list_(pa.struct([("j", pa.int32()), ("v", pa.list_(pa.float64()))])))]))

        return self.state.select("client", "own").mapInArrow(unpack, "client int, cs array<struct<j: int, v: array<double>>>")


class ClientStore:
    """``points`` (client, row_id, x) laid out by client. ``close()`` deletes what it wrote.

    Null clients and null x are left out; repeated rows count each. Every client's size is a row of ``clients``: client, n,
    beta (its share of the rows), place (its number in order of client), bulk.
    """

    def __init__(self, points: DataFrame, most_values: int = MOST_VALUES, buckets: int | None = None):
        self.spark = points.sparkSession
        rows = points.select(F.col("client").cast("int").alias("client"), "row_id", "x").where("client is not null and x is not null")
        self.dim = kernel.dimension(rows)
        each = rows.groupBy("client").agg(F.count("*").alias("n"))
        all_rows = each.agg(F.sum("n").alias("t"), F.count("*").alias("c")).head()
        self.n_rows, self.n_clients = all_rows["t"] or 0, all_rows["c"]
        self.buckets = buckets or int(min(BUCKETS[1], max(BUCKETS[0], -(-self.n_rows // BUCKET_ROWS))))
        ordered = numbered(each, ["client"], "place")
        limit = max(1, most_values // max(1, self.dim))
        self.clients = written(ordered.select("client", "n", (F.col("n") / F.lit(float(max(1, self.n_rows)))).alias("beta"), "place", (F.col("n") > limit).alias("bulk")), "clients")
        deleted(ordered)
        bulk = self.clients.where("bulk").limit(MOST_BULK + 1).collect()
        if len(bulk) > MOST_BULK:
            raise ValueError(f"over {MOST_BULK} clients of more than {most_values} numbers: raise most_values to what a task can hold")
        self.bulk = {r["client"]: r["beta"] for r in bulk}
        self.bulk_place = {r["client"]: r["place"] for r in bulk}
        big = list(self.bulk)
        self.points = bucketed(rows.where(~F.col("client").isin(big)) if big else rows, "client_points", "client", self.buckets)
        self.rest = written(rows.where(F.col("client").isin(big)), "bulk-points") if big else None
        self.back = SparkBackend(self.rest) if big else None

    def states(self, start: np.ndarray) -> DataFrame:
        """The first states of all clients but the bulk ones, bucketed like the points."""
        row = self.clients.where("not bulk").select("client", "beta", "place", F.array(*[F.lit(float(t)) for t in start.ravel()]).alias("own"), F.array().cast("array<double>").alias("sums"), F.array().cast("array<double>").alias("trace"), F.lit(True).alias("present"))
        return bucketed(row, "client_state", "client", self.buckets)

    def close(self) -> None:
        deleted(self.clients, self.points, self.rest)


FIELDS = "client int, beta double, place long, own array<double>, sums array<double>, trace array<double>, present boolean"
_SCHEMA = pa.schema([("client", pa.int32()), ("beta", pa.float64()), ("place", pa.int64()), ("own", pa.list_(pa.float64())), ("sums", pa.list_(pa.float64())), ("trace", pa.list_(pa.float64())), ("present", pa.bool_())])


def answered(program: Program, x: np.ndarray):
    """The end of a program whose client's rows are all here."""
    try:
        ask = next(program)
        while True:
            kind, v, m = ask
            ask = program.send(sums_of(x, v, m) if kind == "sums" else footprint_of(x, v, m))
    except StopIteration as end:
        return end.value


def round_plan(store: ClientStore, states: DataFrame, rule, v: np.ndarray, server: np.ndarray, present: frozenset | None) -> DataFrame:
    """New states of all clients but the bulk ones: points and states cogrouped by client, both by their buckets. ``present`` holds places."""
    k, d = v.shape

    def one(points: pa.Table, state: pa.Table) -> pa.Table:
        s = state.to_pylist()[0]
        if present is not None and s["place"] not in present:
            return pa.Table.from_pylist([s | {"sums": [], "trace": [], "present": False}], schema=_SCHEMA)
        x = points.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(points.num_rows, d)
        own, sums, trace = answered(rule.program(v, server, np.array(s["own"]).reshape(k, d), s["beta"]), x)
        return pa.Table.from_pylist([s | {"own": own.ravel().tolist(), "sums": sums.tolist(), "trace": trace.tolist(), "present": True}], schema=_SCHEMA)

    return store.points.select("client", "x").groupBy("client").cogroup(states.groupBy("client")).applyInArrow(one, FIELDS)


def _bulk_round(store: ClientStore, own: dict, rule, v, server, present):
    """The programs of the bulk clients in step: one job answers a request of all. Client to (own, sums, trace)."""
    live = {c: rule.program(v, server, own[c], b) for c, b in store.bulk.items() if present is None or store.bulk_place[c] in present}
    asked, done = {c: next(p) for c, p in live.items()}, {}
    while asked:
        answers = {}
        for kind in ("sums", "footprint"):
            some = {c: a for c, a in asked.items() if a[0] == kind}
            for m in {a[2] for a in some.values()}:
                ask = {c: a[1] for c, a in some.items() if a[2] == m}
                answers |= store.back.sums(ask, m) if kind == "sums" else store.back.footprint(ask, m)
        asked_now, asked = asked, {}
        for c in asked_now:
            try:
                asked[c] = live[c].send(answers[c])
            except StopIteration as end:
                done[c] = end.value
    return done


def run(store: ClientStore, rule, v0: np.ndarray, rounds: int = P.rounds, fraction: float = 1.0, seed: int = 0, tol: float | None = P.tol) -> StateRun:
    """Rounds of ``rule`` over all clients of ``store`` from the prototypes ``v0``.

    With ``fraction`` under 1 a seeded draw of places takes part in each round; the others keep their states. ``tol`` ends the
    run when the prototypes move less (None: never); prototypes that are not finite end it with an error. Without clients the
    prototypes stay.
    """
    v, server = np.array(v0, dtype=float), np.zeros_like(v0, dtype=float)
    k, d = v.shape
    rng = np.random.default_rng(seed)
    n_present = max(1, int(store.n_clients * fraction))
    states, own = store.states(rule.start(v)), {c: rule.start(v) for c in store.bulk}
    traces, error, t = [], None, -1
    for t in range(rounds if store.n_clients else 0):
        present = frozenset(rng.choice(store.n_clients, size=n_present, replace=False).tolist()) if fraction < 1 else None
        new = bucketed(round_plan(store, states, rule, v, server, present), "client_state", "client", store.buckets, dealt=True)
        rows = new.where("present").select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).collect()  # k (d + 1) numbers, or 2 k d
        total = np.zeros(2 * k * d if isinstance(rule, Variates) else k * (d + 1))
        for r in rows:
            total[r["i"]] = r["s"]
        made = _bulk_round(store, own, rule, v, server, present) if store.bulk else {}
        for c, (o, s, _) in made.items():
            own[c] = o
            total[: len(s)] += s
        if getattr(rule, "track", False):
            traces.append(_trace(store, new, made, t, v))
        else:
            deleted(states)
        states, old = new, v
        if hasattr(rule, "pool"):
            v = rule.pool(_states(store, states.where("present"), {c: own[c] for c in made}), v, t)
        else:
            v, server = rule.update(v, server, total, n_present if fraction < 1 else store.n_clients, store.n_clients)
        if not np.isfinite(v).all():
            error = "diverged"
            break
        if tol is not None and float(np.linalg.norm(v - old)) < tol:
            break
    last = _states(store, states, own)
    trajectory = traces[0] if traces else None
    for more in traces[1:]:
        trajectory = trajectory.union(more)
    return StateRun(v, t + 1, last, trajectory, error, rule)


def _states(store: ClientStore, states: DataFrame, own: dict) -> DataFrame:
    """client, beta, own of the written states and of the bulk clients."""
    last = states.select("client", "beta", "own")
    if own:
        last = last.union(store.spark.createDataFrame([(c, store.bulk[c], o.ravel().tolist()) for c, o in own.items()], "client int, beta double, own array<double>"))
    return last


def _trace(store: ClientStore, states: DataFrame, made: dict, t: int, v: np.ndarray) -> DataFrame:
    """Rows (round, client, j, share, n, pre, post, footprint, r, q, c) of one round, from its states."""
    k, d = v.shape
    rows = states.where("present").select("client", "beta", "trace")
    if made:
        rows = rows.union(store.spark.createDataFrame([(c, store.bulk[c], x[2].tolist()) for c, x in made.items()], "client int, beta double, trace array<double>"))
    part = lambda n: F.get("trace", F.lit(n * k) + F.col("j"))
    each = rows.select("client", F.col("beta").alias("share"), "trace", F.explode(F.array(*[F.lit(j) for j in range(k)])).alias("j"))
    n = F.round(F.col("share") * store.n_rows).cast("long")
    return each.select(F.lit(t).alias("round"), "client", "j", "share", n.alias("n"), *[part(i).alias(name) for i, name in enumerate(("pre", "post", "footprint", "r", "q"))], F.slice("trace", F.lit(5 * k + 1) + F.col("j") * d, F.lit(d)).alias("c"))
