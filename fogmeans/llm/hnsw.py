"""Near-duplicate vectors: a navigable small-world graph for each shard, every shard queried, links verified in doubles."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, block_pairs, components, drop_path, dropped, filed, part_of, pinned, places, spread_join

COSINE = 0.9
#: Vectors of a shard at most, and shards at least.
SHARD = 32_768
MIN_SHARDS = 6
LINKS = 12
BUILD_BEAM = 48
BEAM = 48
RECALL = 0.95
#: Queries of one draw of the audit, and queries with true links that it needs before it judges.
AUDIT = 128
LINKED = 128
#: Queries that walk the graph together.
TOGETHER = 512
#: Shards of a group: a task takes the shards of two groups, one of either at a time. Groups are smaller while there are fewer
#: than GROUPS of them.
GROUP = 4
GROUPS = 24


class Graph:
    """Hierarchical small-world graph over unit rows ``x`` (float32). Layer 0 holds all rows, layer l about n / 16**l.

    Queries walk in lockstep, so each step is a few numpy calls for hundreds of them. Construction adds rows in batches and
    keeps, of the candidates, those that are nearer to the row than to any kept one, which links tight groups to the rest.
    """

    def __init__(self, x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]] | None = None, links: int = LINKS):
        self.x, self.links = np.ascontiguousarray(x, dtype=np.float32), links
        self.layers = layers if layers is not None else self._build()

    def _build(self) -> list[tuple[np.ndarray, np.ndarray]]:
        n = len(self.x)
        level = np.minimum((-np.log(np.random.default_rng(7).random(n)) / np.log(16)).astype(int), 8)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for lv in range(int(level.max(initial=0)), -1, -1):
            ids = np.flatnonzero(level >= lv)
            if lv and len(ids) < 8:
                continue
            out.insert(0, (ids, self._layer(ids, out, 2 * self.links if lv == 0 else self.links)))
        return out

    def _layer(self, ids: np.ndarray, upper: list, width: int) -> np.ndarray:
        x, n = self.x[ids], len(ids)
        nbr = np.full((n, width), -1, dtype=np.int32)
        order = np.random.default_rng(11).permutation(n)
        done = min(n, 64)
        seed = order[:done]
        sims = x[seed] @ x[seed].T
        np.fill_diagonal(sims, -2)
        top = np.argsort(-sims, axis=1, kind="stable")[:, : min(self.links, max(0, done - 1))]
        if top.shape[1]:
            nbr[seed[:, None], np.arange(top.shape[1])[None, :]] = seed[top]
        place = {int(g): i for i, g in enumerate(ids)} if upper else {}
        while done < n:
            batch = order[done : done + min(TOGETHER, done)]
            entry = np.tile(seed[:4], (len(batch), 1))
            if upper:
                far, _ = walk(self.x[upper[0][0]], upper[0][1], x[batch], np.zeros((len(batch), 1), int) + np.arange(min(4, len(upper[0][0]))), 8)
                near = np.vectorize(lambda g: place[int(g)])(upper[0][0][np.maximum(far[:, :4], 0)])
                inserted = np.zeros(n, bool)
                inserted[order[:done]] = True
                entry = np.concatenate([np.where(inserted[near], near, entry[:, :1]), entry], axis=1)
            cand, _ = walk(x, nbr, x[batch], entry, BUILD_BEAM)
            own = x[batch] @ x[batch].T
            np.fill_diagonal(own, -2)
            k = min(16, len(batch) - 1)
            mates = batch[np.argpartition(-own, k - 1, axis=1)[:, :k]] if k > 0 else np.zeros((len(batch), 0), int)
            kept = self._choose(x, batch, np.concatenate([cand, mates], axis=1), self.links)
            nbr[batch, : self.links] = kept
            src, dst = np.repeat(batch, kept.shape[1]), kept.ravel()
            ok = dst >= 0
            src, dst = src[ok], dst[ok]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            targets, first, counts = np.unique(dst, return_index=True, return_counts=True)
            wide = int(min(counts.max(initial=1), 4 * width))
            lists = np.full((len(targets), width + wide), -1, dtype=np.int64)
            lists[:, :width] = nbr[targets]
            for j in range(wide):
                has = counts > j
                lists[has, width + j] = src[first[has] + j]
            nbr[targets] = self._choose(x, targets, lists, width)
            done += len(batch)
        return nbr

    @staticmethod
    def _choose(x: np.ndarray, rows: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates (-1: none) up to ``most``, diverse ones first."""
        out = np.full((len(rows), most), -1, dtype=np.int64)
        for a in range(0, len(rows), 256):
            r, c = rows[a : a + 256], np.sort(cand[a : a + 256], axis=1)
            c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
            c[c == r[:, None]] = -1
            sims = np.einsum("bd,bmd->bm", x[r], x[np.maximum(c, 0)])
            sims[c < 0] = -3
            order = np.argsort(-sims, axis=1, kind="stable")
            c, sims = np.take_along_axis(c, order, 1), np.take_along_axis(sims, order, 1)
            v = x[np.maximum(c, 0)]
            between = np.matmul(v, v.transpose(0, 2, 1))
            near = np.full(sims.shape, -3.0)
            rank = np.full(sims.shape, 2 * c.shape[1])
            for j in range(c.shape[1]):
                good = (sims[:, j] > near[:, j]) & (c[:, j] >= 0)
                rank[:, j] = np.where(c[:, j] < 0, 3 * c.shape[1], np.where(good, j, c.shape[1] + j))
                near = np.where(good[:, None], np.maximum(near, between[:, j, :]), near)
            first = np.argsort(rank, axis=1, kind="stable")[:, :most]
            got = np.take_along_axis(c, first, 1)
            out[a : a + 256, : got.shape[1]] = got
        return out

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and cosines of about the ``beam`` nearest rows of each query."""
        ids, nbr = self.layers[-1]
        entry = np.tile(np.arange(min(8, len(ids))), (len(q), 1))
        for depth in range(len(self.layers) - 1, 0, -1):
            ids, nbr = self.layers[depth]
            got, _ = walk(self.x[ids], nbr, q, entry, 16)
            below = self.layers[depth - 1][0]
            entry = np.searchsorted(below, ids[np.maximum(got, 0)])[:, :8]
        return walk(self.x, self.layers[0][1], q, entry, beam)


def walk(x: np.ndarray, nbr: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries in lockstep; four open rows of each beam are expanded at a step."""
    b, n = len(q), len(x)
    beam = min(beam, n)
    seen = np.zeros((b, n), bool)
    ids = np.full((b, beam), -1, dtype=np.int64)
    sims = np.full((b, beam), -9.0, dtype=np.float32)
    closed = np.ones((b, beam), bool)
    live = np.arange(b)
    fresh = entry
    while len(live):
        c = np.sort(fresh, axis=1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        c[seen[live[:, None], np.maximum(c, 0)]] = -1
        r, k = np.nonzero(c >= 0)
        seen[live[r], c[r, k]] = True
        s = np.full(c.shape, -9.0, dtype=np.float32)
        s[r, k] = np.einsum("bd,bd->b", q[live[r]], x[c[r, k]])
        alls, alli = np.concatenate([sims[live], s], axis=1), np.concatenate([ids[live], c], axis=1)
        shut = np.concatenate([closed[live], s < -8], axis=1)
        top = np.argpartition(-alls, beam - 1, axis=1)[:, :beam] if alls.shape[1] > beam else np.tile(np.arange(alls.shape[1]), (len(live), 1))
        sims[live, : top.shape[1]], ids[live, : top.shape[1]] = np.take_along_axis(alls, top, 1), np.take_along_axis(alli, top, 1)
        closed[live, : top.shape[1]] = np.take_along_axis(shut, top, 1)
        open_sims = np.where(closed[live], -9.0, sims[live])
        live = live[open_sims.max(axis=1) > -8]
        if not len(live):
            break
        open_sims = np.where(closed[live], -9.0, sims[live])
        e = min(4, beam)
        best = np.argpartition(-open_sims, e - 1, axis=1)[:, :e]
        usable = np.take_along_axis(open_sims, best, 1) > -8
        closed[live[:, None], best] = True
        step = nbr[np.maximum(ids[live[:, None], best], 0)]
        fresh = np.where(usable[:, :, None], step, -1).reshape(len(live), -1).astype(np.int64)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def links_of(graph: Graph, q: np.ndarray, cosine: float, beam: int = BEAM, recall: float = RECALL, audit: int = AUDIT, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) with float32 cosine of about ``cosine`` or more.

    A beam full of links is doubled for its query until it isn't. Then an audit compares random queries with all rows, draw
    by draw until LINKED of them have true links or all queries are drawn. Where their pooled links or the mean over linked
    queries are below ``recall``, every beam is doubled, up to all rows, which is exact. With ``own`` the queries are the rows
    themselves, and a row's link to itself does not count.
    """
    n, floor = len(graph.x), np.float32(cosine - 1e-5)
    if not n or not len(q):
        return np.zeros(0, int), np.zeros(0, int)
    rng = np.random.default_rng(5)
    while True:
        qs, rs, linked = [], [], np.zeros(len(q), bool)
        for a in range(0, len(q), TOGETHER):
            rows, width = np.arange(a, min(a + TOGETHER, len(q))), min(beam, n)
            while len(rows):
                ids, sims = graph.search(q[rows], width)
                full = (sims[:, -1] >= floor) & (width < n)
                i, j = np.nonzero((sims >= floor) & (ids >= 0) & ~full[:, None])
                qs.append(rows[i])
                rs.append(ids[i, j])
                linked[rows[i]] = True
                rows, width = rows[full], min(2 * width, n)
        qi, ri = np.concatenate(qs), np.concatenate(rs)
        if beam >= n:
            return qi, ri
        found = np.bincount(qi[qi != ri] if own else qi, minlength=len(q))
        order, at, truth = rng.permutation(len(q)), 0, np.zeros(len(q), dtype=np.int64)
        while at < len(q) and (truth > 0).sum() < LINKED:
            some = order[at : at + audit]
            hits = q[some] @ graph.x.T >= floor
            if own:
                hits[np.arange(len(some)), some] = False
            truth[some] = hits.sum(axis=1)
            at += len(some)
        with_links = np.flatnonzero(truth)
        have, want = np.minimum(found, truth)[with_links], truth[with_links]
        if not len(with_links) or have.sum() >= recall * want.sum() and (have / want).mean() >= recall:
            return qi, ri
        beam *= 2


def _unit(rows) -> np.ndarray:
    v = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    if len(v):
        # the largest component becomes 1 first, so that no square overflows or vanishes
        v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True) if len(v) else v


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, shard: int = SHARD, shards: int = MIN_SHARDS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding; more columns are ignored).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different length
    don't link either. Equal vectors are one class, found by a group-by with map-side combine, and only one of each class is
    indexed, so copies never become pairs; their links are counted by multiplicity. Classes have numbers of their own, so
    vec_id may be null, repeated or of another type: a null vec_id counts its links like others, is never the name of a
    component with another id in it, and is kept only where its component has no other id. A repeated vec_id is one more row
    with its own copy of the vector. Components of any finite size are scaled before they are squared. An empty table gives
    no rows.
    """
    e = F.col("embedding")
    fine = F.coalesce(e.isNotNull() & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0), F.lit(False))
    rows = vectors.select("vec_id", F.when(fine, e).alias("embedding"))
    good = rows.where("embedding is not null")
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = pinned(classes.withColumn("rep", F.monotonically_increasing_id()), "hnsw-classes")
    n = classes.count()
    count = max(shards, -(-n // shard))
    links = _class_links(classes.select("rep", "embedding", "copies"), count, cosine)
    comp = components(links.where("peer is not null").select(F.col("rep").alias("a"), F.col("peer").alias("b")))
    total = links.groupBy("rep").agg(F.sum("links").alias("links"))
    of_class = classes.drop("embedding").join(total, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = pinned(of_class.select("rep", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "hnsw-groups")
    names = pinned(of_class.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("size")), "hnsw-names")
    named = pinned(spread_join(of_class, names, "component", "size", "rep").select("rep", "n_links", "component_id"), "hnsw-named")
    # a row finds its class by 128 bits of hash; only if two classes share them (which is checked) by the vector itself
    key = F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit(1), "embedding").alias("b"))
    named = pinned(classes.withColumn("key", key).join(named, "rep").select("key", "embedding", "copies", "n_links", "component_id"), "hnsw-keys")
    apart = named.select("key").distinct().count() == n
    by = named.drop("embedding") if apart else named.drop("key").withColumnRenamed("embedding", "key")
    found = spread_join(good.select("vec_id", (key if apart else F.col("embedding")).alias("key")), by, "key", "copies", "vec_id").select("vec_id", "n_links", "component_id")
    alone = rows.where("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    dropped(links, comp, classes, of_class, names)
    return found.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def recall(vectors: DataFrame, found: DataFrame, cosine: float = COSINE, every: int = 50) -> DataFrame:
    """queries, true_links, found_links, recall: rows whose vec_id is divisible by ``every`` against all rows, by brute force.

    ``found`` is near_duplicates() of ``vectors``, of one length and with distinct vec_ids. The queries are compared in blocks
    with each batch of rows; only their counts meet. The links of a query are found as many as n_links says, at most the true ones.
    """
    good = vectors.where(F.col("embedding").isNotNull()).select("vec_id", "embedding")
    n, asked = good.count(), good.where(F.col("vec_id") % every == 0).count()
    n_blocks, n_parts = max(1, -(-asked // 2048)), max(1, -(-n // SHARD))
    queries = good.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int"))
    blocks = queries.groupBy("block").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("q"))
    rows = good.select(F.struct("vec_id", "embedding").alias("r")).withColumn("part", F.pmod(F.xxhash64("r.vec_id"), F.lit(n_parts)).cast("int")).groupBy("part").agg(F.collect_list("r").alias("r"))

    def compare(batches):
        for pdf in batches:
            for q, r in zip(pdf["q"], pdf["r"], strict=True):
                a, b = _unit([x["embedding"] for x in q]), _unit([x["embedding"] for x in r])
                same = np.array([x["vec_id"] for x in q])[:, None] == np.array([x["vec_id"] for x in r])[None, :]
                yield pd.DataFrame({"vec_id": [x["vec_id"] for x in q], "n": ((a @ b.T >= cosine) & ~same).sum(axis=1)})

    # about 2,048 queries meet about SHARD rows in a task: the stated query set against all rows, block by block
    every_block = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).repartition(n_blocks * n_parts, "block", "part").join(blocks, "block").select("q", "r")
    truth = every_block.mapInPandas(compare, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    both = truth.join(found.select("vec_id", "n_links"), "vec_id")
    return both.agg(F.count("*").alias("queries"), F.sum("n").alias("true_links"), F.sum(F.least("n", "n_links")).alias("found_links")).withColumn("recall", F.col("found_links") / F.col("true_links"))


def _class_links(classes: DataFrame, count: int, cosine: float) -> DataFrame:
    """(rep, peer, links): links to rows of other classes by multiplicity, and edges that join each component."""
    spark = classes.sparkSession
    label = lambda n, at: F.element_at(F.array(*[F.lit(i) for i in places(spark, n)]), (at + 1).cast("int")) if n <= 256 else at
    shard = F.pmod(F.xxhash64("rep"), F.lit(count)).cast("int")
    sharded = classes.select("rep", "copies", "embedding", shard.alias("shard")).withColumn("place", label(count, F.col("shard")))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim, some in pdf.groupby(pdf["embedding"].map(len)):
            some = some.sort_values("rep")
            x = _unit(some["embedding"])
            g = Graph(x)
            flat = [a.astype(np.int32) for ids, nbr in g.layers for a in (ids, nbr)]
            shapes = [s for a in flat for s in (*a.shape, *[0] * (2 - a.ndim))]
            head = np.array([len(flat), *shapes], dtype=np.int32).tobytes()
            out.append((int(some["shard"].iloc[0]), int(dim), some["rep"].to_numpy(np.int64).tobytes(), some["copies"].to_numpy(np.int64).tobytes(), x.tobytes(), head + b"".join(a.tobytes() for a in flat)))
        return pd.DataFrame(out, columns=["shard", "dim", "reps", "copies", "x", "graph"])

    kinds = "shard int, dim int, reps binary, copies binary, x binary, graph binary"
    graphs = filed(sharded.repartition(count, "place").groupBy("place").applyInPandas(build, kinds), "shard", "hnsw-graphs")
    # every vector meets every shard once: the later shard of a pair queries the earlier one's graph. A shard is written once;
    # a task opens the files of two shards at a time, so no vector is sent to more than one place
    group = max(1, min(GROUP, count // GROUPS))
    groups = -(-count // group)
    shards_of = lambda g: range(g * group, min(count, (g + 1) * group))

    def query(batches):
        for batch in batches:
            for i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for early in shards_of(j):
                    graph = _Shards(graphs, early)
                    for late in shards_of(i):
                        if late >= early:
                            for made in graph.links(graph if late == early else _Shards(graphs, late, ["dim", "reps", "copies", "x"]), cosine):
                                yield pa.RecordBatch.from_pandas(made, schema=pa.schema([("rep", pa.int64()), ("peer", pa.int64()), ("links", pa.int64())]), preserve_index=False)

    tasks = block_pairs(spark, [(i, 0, i) for i in range(groups)], groups * (groups + 1) // 2)
    links = pinned(tasks.mapInArrow(query, "rep long, peer long, links long"), "hnsw-links")
    drop_path(spark, graphs)
    return links


class _Shards:
    """What one shard has written, a row for each length of vectors."""

    def __init__(self, path: str, shard: int, columns: list[str] | None = None):
        rows = part_of(path, "shard", shard, columns)
        self.rows = [SimpleNamespace(shard=shard, **r) for r in rows.to_pylist()]

    def links(self, queries: _Shards, cosine: float):
        for b in self.rows:
            for a in queries.rows:
                if a.dim == b.dim:
                    yield _query(a, b, cosine)


def _query(a, b, cosine: float) -> pd.DataFrame:
    """Links of the vectors of shard row ``a`` with those of ``b``, by the graph of ``b``."""
    x = np.frombuffer(b.x, dtype=np.float64).reshape(-1, b.dim)
    head = np.frombuffer(b.graph, dtype=np.int32)
    k, at, arrays = int(head[0]), 1 + 2 * int(head[0]), []
    for i in range(k):
        n, width = int(head[1 + 2 * i]), int(head[2 + 2 * i])
        size = n * max(width, 1)
        arrays.append(head[at : at + size].reshape(n, width) if width else head[at : at + size])
        at += size
    g = Graph(x, [(arrays[i].astype(np.int64), arrays[i + 1]) for i in range(0, k, 2)])
    q = np.frombuffer(a.x, dtype=np.float64).reshape(-1, a.dim)
    lrep, rrep = np.frombuffer(a.reps, np.int64), np.frombuffer(b.reps, np.int64)
    lw, rw = np.frombuffer(a.copies, np.int64), np.frombuffer(b.copies, np.int64)
    same = a.shard == b.shard
    qi, ri = links_of(g, q.astype(np.float32), cosine, own=same)
    if same:
        key = np.unique(np.minimum(qi, ri)[qi != ri] * len(x) + np.maximum(qi, ri)[qi != ri])
        qi, ri = key // max(1, len(x)), key % max(1, len(x))
    good = np.concatenate([np.einsum("ij,ij->i", q[qi[k : k + 65_536]], x[ri[k : k + 65_536]]) >= cosine for k in range(0, len(qi), 65_536)] or [np.zeros(0, bool)])
    qi, ri = qi[good], ri[good]
    nl = len(lrep)
    reps, links = (lrep, np.zeros(nl, np.int64)) if same else (np.concatenate([lrep, rrep]), np.zeros(nl + len(rrep), np.int64))
    rj = ri if same else ri + nl
    np.add.at(links, qi, rw[ri])
    np.add.at(links, rj, lw[qi])
    forest = Forest(len(reps))
    by = np.argsort(qi, kind="stable")
    rows, first = np.unique(qi[by], return_index=True)
    for row, found in zip(rows, np.split(rj[by], first[1:])[: len(rows)], strict=True):
        forest.join(np.append(found, row))
    ids = np.flatnonzero(links)
    root = forest.roots(ids)
    peer = pd.Series(np.where(root != ids, reps[root], 0), dtype="Int64").mask(root == ids)
    return pd.DataFrame({"rep": reps[ids], "peer": peer, "links": links[ids]})


#: All pairs, so for small tables with distinct vec_ids and finite vectors; components by reaching from every vector.
SQL = f"""with recursive e as (select vec_id, list_transform(embedding, lambda z: z::double) x from embeddings),
n as (select vec_id, list_transform(x, lambda z: z / sqrt(list_inner_product(x, x))) u from e where list_inner_product(x, x) > 0),
links as materialized (select a.vec_id a, b.vec_id b from n a join n b on a.vec_id <> b.vec_id and len(a.u) = len(b.u) where list_inner_product(a.u, b.u) >= {COSINE}),
reach(a, b) as (select vec_id, vec_id from e union select r.a, l.b from reach r join links l on r.b = l.a)
select vec_id, (select count(*) from links where a = vec_id) n_links, c component_id, vec_id = c kept from (select a vec_id, min(b) c from reach group by a)"""
