"""Hard negatives by branch and bound over ball trees, a tree for each label of each partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, pinned

#: Rows of a partition and of a leaf, and anchors searched in one pass over all trees (sent to every task): as many as have ANCHOR_BYTES.
SHARD = 8192
LEAF = 64
ANCHORS = 32_768
ANCHOR_BYTES = 16 << 20
#: Components are whole numbers up to this; larger ones count as this, so that every product is exact.
LARGEST = 1 << 20
#: A bound is widened by this share of its terms, more than the error of a double.
SLACK = 1e-9

TREE = "label long, dim int, ids binary, vectors binary, centers binary, radii binary"


class BallTree:
    """Rows in an order in which every node is a span; node i has the children 2 i + 1 and 2 i + 2, each half of its rows.

    ``vectors`` are whole numbers. Rows are split at the median of their projection on the line between two far rows.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, centers: np.ndarray | None = None, radii: np.ndarray | None = None, leaf: int = LEAF):
        self.ids, self.x, self.leaf = ids, vectors.astype(np.float64), leaf
        self.depth = 0
        while len(ids) >> self.depth > leaf:
            self.depth += 1
        if centers is None:
            order = np.arange(len(ids))
            for level in range(self.depth):
                for a, b in self.spans(level):
                    order[a:b] = self._halved(order[a:b])
            self.ids, self.x = self.ids[order], self.x[order]
            spans = [s for level in range(self.depth + 1) for s in self.spans(level)]
            self.centers = np.stack([self.x[a:b].mean(axis=0) for a, b in spans])
            self.radii = np.array([np.sqrt(((self.x[a:b] - c) ** 2).sum(axis=1).max()) for (a, b), c in zip(spans, self.centers, strict=True)])
        else:
            self.centers, self.radii = centers, radii

    def spans(self, level: int) -> list[tuple[int, int]]:
        edges = [len(self.ids) * i >> level for i in range((1 << level) + 1)]
        return list(zip(edges[:-1], edges[1:], strict=True))

    def _halved(self, rows: np.ndarray) -> np.ndarray:
        x = self.x[rows]
        far = x[((x - x[0]) ** 2).sum(axis=1).argmax()]
        other = x[((x - far) ** 2).sum(axis=1).argmax()]
        # the halves are spans() of the next level: 2 i + 1 edges lie where the shift puts them, so a full sort serves all
        return rows[np.argsort(x @ (other - far), kind="stable")]

    def search(self, q: np.ndarray, keep: "Best", whom: np.ndarray) -> None:
        """Offer ``keep`` the rows that anchors ``q`` (numbered ``whom``) may need: nodes outside every window or strictly beneath what is kept are skipped."""
        norms = np.sqrt((q * q).sum(axis=1))
        stack = [(0, 0, np.arange(len(q)))]
        while stack:
            level, i, live = stack.pop()
            node = (1 << level) - 1 + i
            mid = q[live] @ self.centers[node]
            reach = norms[live] * self.radii[node]
            slack = SLACK * (np.abs(mid) + reach) + 1e-6
            live = live[keep.wanted(whom[live], mid - reach - slack, mid + reach + slack)]
            if not len(live):
                continue
            if level == self.depth:
                a, b = len(self.ids) * i >> level, len(self.ids) * (i + 1) >> level
                keep.offer(whom[live], q[live] @ self.x[a:b].T, self.ids[a:b])
                continue
            near = q[live].mean(axis=0) @ (self.centers[2 * node + 1] - self.centers[2 * node + 2])
            children = [(level + 1, 2 * i, live), (level + 1, 2 * i + 1, live)]
            stack += children[::-1] if near >= 0 else children  # the nearer child is taken first


class Best:
    """The first ``k`` (score, id) of each window (owner, low, high): higher scores first, then smaller ids."""

    def __init__(self, owner: np.ndarray, low: np.ndarray, high: np.ndarray, own: np.ndarray, k: int, n: int):
        order = np.argsort(owner, kind="stable")
        self.window, self.low, self.high, self.k = order, low[order].astype(float), high[order].astype(float), k
        self.first = np.searchsorted(owner[order], np.arange(n + 1))
        #: an anchor's own id is no row of its own
        self.own = own
        self.score = np.full((len(order), k), -np.inf)
        self.id = np.full((len(order), k), np.iinfo(np.int64).max)

    def _windows(self, whom: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows of the anchors, and which of ``whom`` each belongs to."""
        n = self.first[whom + 1] - self.first[whom]
        at = np.repeat(self.first[whom] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return at, np.repeat(np.arange(len(whom)), n)

    def wanted(self, whom: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        at, which = self._windows(whom)
        ok = (most[which] >= self.low[at]) & (least[which] <= self.high[at]) & (most[which] >= self.score[at, -1])
        out = np.zeros(len(whom), bool)
        out[which[ok]] = True
        return out

    def offer(self, whom: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        at, which = self._windows(whom)
        for a in range(0, len(at), 4096):
            w, i = at[a : a + 4096], which[a : a + 4096]
            s = scores[i]
            fits = (s >= np.maximum(self.low[w], self.score[w, -1])[:, None]) & (s <= self.high[w][:, None]) & (ids[None, :] != self.own[whom[i]][:, None])
            rows = np.flatnonzero(fits.any(axis=1))
            if not len(rows):
                continue
            s = np.concatenate([np.where(fits[rows], s[rows], -np.inf), self.score[w[rows]]], axis=1)
            d = np.concatenate([np.broadcast_to(ids, (len(rows), len(ids))), self.id[w[rows]]], axis=1)
            d = np.where(np.isinf(s), np.iinfo(np.int64).max, d)
            best = np.lexsort((d, -s), axis=1)[:, : self.k]
            self.score[w[rows]], self.id[w[rows]] = np.take_along_axis(s, best, 1), np.take_along_axis(d, best, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows, scores and ids of all that is kept."""
        r, c = np.nonzero(~np.isinf(self.score))
        return self.window[r], self.score[r, c].astype(np.int64), self.id[r, c]


def usable(vectors: DataFrame, label: Column | None = None) -> DataFrame:
    """vec_id, label, x (whole numbers floor(256 x)) of the rows that take part; of one vec_id the smallest row.

    Left out are null vec_ids, labels and vectors and vectors with null or non-finite components. Copies meet in a group-by
    with map-side combine.
    """
    e = F.col("embedding")
    fine = e.isNotNull() & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(e, lambda v: F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), F.floor(v.cast("double") * 256).cast("double"))).cast("int"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select("vec_id", (F.col("label") if label is None else label).cast("long").alias("label"), whole.alias("x")).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x")


def build_trees(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """A written table with a row for each (partition, label): its ball tree. Partitions are by hash of vec_id, about ``shard`` rows each."""
    n = rows.count()
    dealt = rows.repartition(max(1, -(-n // shard)), "vec_id")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).value_lengths().to_numpy(), b.column(2).flatten().to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        ids, labels, sizes, flat = (np.concatenate(c) for c in zip(*held, strict=True))
        # a shorter vector counts as one with zeros at its end
        x = np.zeros((len(ids), max(1, int(sizes.max()))), dtype=np.int32)
        x[np.arange(x.shape[1])[None, :] < sizes[:, None]] = flat
        for y in np.unique(labels):
            t = BallTree(ids[labels == y], x[labels == y])
            blobs = [t.ids.tobytes(), t.x.astype(np.int32).tobytes(), t.centers.tobytes(), t.radii.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([y], pa.int64()), pa.array([x.shape[1]], pa.int32()), *[pa.array([b], pa.binary()) for b in blobs]], names=["label", "dim", "ids", "vectors", "centers", "radii"])

    # trees of one partition stand together: a task that reads them keeps its best for all
    return pinned(dealt.select("vec_id", "label", "x").mapInArrow(grow, TREE), "ball-trees")


def _tree(row: dict) -> BallTree:
    dim = row["dim"]
    return BallTree(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.int32).reshape(-1, dim), np.frombuffer(row["centers"]).reshape(-1, dim), np.frombuffer(row["radii"]))


def _padded(q: np.ndarray, dim: int) -> np.ndarray:
    return q[:, :dim] if q.shape[1] >= dim else np.pad(q, ((0, 0), (0, dim - q.shape[1])))


def search(trees: DataFrame, ids: np.ndarray, q: np.ndarray, labels: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> DataFrame:
    """(window, score, id): the first k rows of each window (owner: an anchor's number, low, high) over all ``trees``.

    ``same`` searches the anchors' own label, otherwise all others. Every task keeps its best over all its trees and sends
    at most k rows a window; the first k of these are taken by a window function.
    """
    order = np.argsort(labels, kind="stable")
    firsts = dict(zip(*np.unique(labels[order], return_index=True), strict=True))
    numbers = {int(y): order[a : a + int((labels == y).sum())] for y, a in firsts.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(owner, low, high, ids, k, len(ids))
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                mine = numbers.get(row["label"], np.zeros(0, int))
                whom = mine if same else np.setdiff1d(np.arange(len(ids)), mine)
                whom = whom[np.diff(best.first)[whom] > 0]
                if len(whom):
                    _tree(row).search(_padded(q[whom], row["dim"]).astype(np.float64), best, whom)
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in best.rows()], names=["window", "score", "id"])

    found = trees.mapInArrow(run, "window long, score long, id long")
    first = Window.partitionBy("window").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, label: Column | None = None, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor.

    Scores are inner products of floor(256 x). An anchor's positives are its first ``positives`` other rows of its label; for
    each, the first ``negatives`` rows of other labels whose score is ``least`` to ``most`` hundredths of the positive's are
    given. Higher scores come first, ties by smaller vec_id. ``anchors`` says which rows are anchors, ``label`` replaces the
    label before anything else; both are columns over ``vectors``.

    Rows with a null vec_id, label, vector or component, or a component that is not finite, take no part. Equal rows count
    once; of rows that share a vec_id the smallest (label, vector) does. A missing component counts as 0, a component beyond
    2 ** 20 / 256 as that. An empty table gives no rows; other columns are ignored.

    Anchors are searched ``block`` at a time: a block (at most some MB) goes to every task, which reads the trees of its
    partitions from the shared folder; so no row of the table is multiplied in a shuffle.
    """
    spark = vectors.sparkSession
    rows = pinned(usable(vectors, label), "negatives-rows")
    trees = build_trees(rows)
    asked = pinned(rows.where(anchors), "negatives-anchors")
    shape = asked.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dim")).head()
    blocks = max(1, -(-shape["n"] // max(1, min(block, ANCHOR_BYTES // (4 * max(1, shape["dim"] or 1))))))
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for b in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()  # about ``block`` rows
        if not some.num_rows:
            continue
        ids, labels, x = some["vec_id"].to_numpy(), some["label"].to_numpy(), some["x"].to_pylist()
        dim = max(1, max(map(len, x)))
        q = np.array([v + [0] * (dim - len(v)) for v in x], dtype=np.int32)
        wide = np.full(len(ids), np.inf)
        found = search(trees, ids, q, labels, np.arange(len(ids)), -wide, wide, positives, True).toArrow()  # at most ``positives`` an anchor
        owner, score, positive = (found[c].to_numpy() for c in ("window", "score", "id"))
        # score * 100 is between least * positive and most * positive, in whole numbers
        low, high = -(-least * score // 100), most * score // 100
        got = search(trees, ids, q, labels, owner, low, high, negatives, False)
        pairs = spark.createDataFrame(pa.table({"window": np.arange(len(owner)), "anchor_id": ids[owner], "positive_id": positive, "positive_score": score})) if len(owner) else None
        if pairs is not None:
            part = got.join(pairs, "window").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            out = out.union(pinned(part, "negatives-found"))
    dropped(rows, trees, asked)
    return out


def contract(vectors: DataFrame) -> DataFrame:
    """mine() with anchors whose vec_id is divisible by 50; of rows whose vec_id is divisible by 7 the label moves on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors, F.col("vec_id") % 50 == 0, moved)


#: Every anchor against every row, so for small tables with distinct vec_ids.
SQL = """with r as (select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint y, list_transform(embedding, lambda z: floor(256 * z::double)::bigint) x from embeddings
where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda z: z is null or not isfinite(z))) = 0),
s as (select a.vec_id a, b.vec_id b, a.y = b.y same, list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2]))::bigint s from r a join r b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select a, b, s from s where same qualify row_number() over (partition by a order by s desc, b) <= 5),
n as (select p.a, p.b p, s.b n, p.s ps, s.s ns, row_number() over (partition by p.a, p.b order by s.s desc, s.b) k from p join s on s.a = p.a and not s.same and 50 * p.s <= 100 * s.s and 100 * s.s <= 95 * p.s)
select a anchor_id, p positive_id, k::int "rank", n negative_id, ps positive_score, ns negative_score from n where k <= 3"""
