"""Points from tables, splits over clients, and synthetic federations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def from_embeddings(spark: SparkSession, sf_dir: str, clients: int = 8) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("row_id"), F.pmod("vec_id", F.lit(clients)).cast("int").alias("client"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("y"))


def from_columns(df: DataFrame, row_id: Column, client: Column, y: Column, columns: list[str]) -> DataFrame:
    return df.select(row_id.alias("row_id"), client.alias("client"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), y.alias("y"))


def standard_scaled(points: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled by mean and population deviation; constant columns are only centred. One small row is broadcast."""
    stats = points.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = points.crossJoin(F.broadcast(stats))
    for c in columns:
        out = out.withColumn(c, (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}")))
    return out.select(*points.columns)


def pca_whitened(points: DataFrame, k: int, whiten: bool = True) -> DataFrame:
    """x replaced by its first k principal scores; column sums and products are aggregated, only d x d numbers reach the driver."""
    from ..operators.kernel import moments

    row = moments(points).head()
    mean, d = row["mean"], len(row["mean"])
    cov = np.zeros((d, d))
    cov[np.tril_indices(d)] = row["cov"]
    val, vec = np.linalg.eigh(cov)
    top = np.argsort(-val)[:k]
    base = vec[:, top] / (np.sqrt(np.maximum(val[top], 1e-12)) if whiten else 1.0)
    score = lambda w: F.aggregate(F.zip_with("x", F.array(*[F.lit(float(t)) for t in w]), lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t) - F.lit(float(np.dot(mean, w)))
    return points.withColumn("x", F.array(*[score(base[:, i]) for i in range(len(top))]))


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """``df`` with y: the rank of each distinct value, null first. Only distinct values are ranked, in ranges."""
    from ..operators.ranks import distinct_counts

    codes = distinct_counts(df, column).select(F.col("value").alias("__v"), F.col("code").cast("int").alias("y"))
    return df.join(codes, F.col(column).eqNullSafe(F.col("__v"))).drop("__v")


def support_skew(points: DataFrame, clients: int, per_client: int) -> DataFrame:
    """Client c supports labels (c + i) mod labels; a label's rows are dealt in row order to its clients in equal runs.

    A label without clients goes to client (label mod clients). ``y`` must be 0 .. labels - 1.
    """
    spark = points.sparkSession
    n = (points.agg(F.max("y").alias("m")).head()["m"] or 0) + 1
    hold: dict[int, list[int]] = {y: [] for y in range(n)}
    for c in range(clients):
        for i in range(per_client):
            if c not in hold[(c + i) % n]:
                hold[(c + i) % n].append(c)
    table = spark.createDataFrame([(y, sorted(cs) or [y % clients]) for y, cs in hold.items()], "y int, cs array<int>")
    sizes = points.groupBy("y").agg(F.count("*").alias("n"))
    # ranks within a label without gathering it: the rank of a row is its bucket's offset and its rank in the bucket
    width = 1 << 16
    b = points.withColumn("b", F.floor(F.col("row_id") / width))
    offsets = b.groupBy("y", "b").agg(F.count("*").alias("k")).withColumn("before", F.sum("k").over(Window.partitionBy("y").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = b.join(offsets.select("y", "b", F.coalesce("before", F.lit(0)).alias("before")), ["y", "b"]).withColumn("r", F.col("before") + F.row_number().over(Window.partitionBy("y", "b").orderBy("row_id")) - 1)
    whole = ranked.join(F.broadcast(table), "y").join(F.broadcast(sizes), "y")
    k, size = F.size("cs"), F.col("n")
    big, rest = F.floor(size / k), size % k  # the first ``rest`` runs are one longer
    i = F.when(F.col("r") < rest * (big + 1), F.floor(F.col("r") / (big + 1))).otherwise(rest + F.floor((F.col("r") - rest * (big + 1)) / F.greatest(big, F.lit(1))))
    return whole.withColumn("client", F.get("cs", i.cast("int"))).select(*points.columns)


def feature_view(x: np.ndarray, components: int | None = None, whiten: bool = False) -> np.ndarray:
    """Standard scores of the columns (constant ones are 0), or their first principal components, whitened or not.

    The sign of a component is that of its largest loading, so the view does not depend on the solver.
    """
    spread = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(spread > 0, spread, 1.0)
    if components is None:
        return z
    _, size, axes = np.linalg.svd(z, full_matrices=False)
    axes = axes[:components] * np.sign(axes[:components, :][np.arange(min(components, len(axes))), np.abs(axes[:components]).argmax(axis=1)])[:, None]
    scores = z @ axes.T
    return scores / (size[:components] / np.sqrt(len(x) - 1)) if whiten else scores


def ranked(points: DataFrame, by: str, order: Column, bits: int = 16) -> DataFrame:
    """``points`` with r: the rank from 0 of each row within its group by the hash ``order`` (a long) and row_id.

    Rows are counted by the first ``bits`` of the hash and only those of one bin are ranked together, so a group of any
    size is spread over 2 ** bits windows.
    """
    key = F.shiftrightunsigned(order, 64 - bits).cast("int")
    p = points.withColumn("__key", order).withColumn("__bin", key)
    run = Window.partitionBy(by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = p.groupBy(by, "__bin").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(run), F.lit(0))).drop("c")
    inside = F.row_number().over(Window.partitionBy(by, "__bin").orderBy("__key", "row_id"))
    return p.join(bins, [by, "__bin"]).withColumn("r", F.col("before") + inside - 1).drop("__key", "__bin", "before")


def dirichlet_split(points: DataFrame, clients: int, alpha: float, seed: int, least: int = 5, attempts: int = 200) -> DataFrame:
    """``points`` with client: each label's rows, in hash order, are cut at floor(cumulative Dirichlet share times rows).

    Shares are drawn on the driver, a vector a label; whether every client gets ``least`` rows follows from the label counts
    alone, so a draw that fails costs nothing. Labels may not be null.
    """
    sizes = {r["y"]: r["n"] for r in points.groupBy("y").agg(F.count("*").alias("n")).collect()}  # a row a label
    rng = np.random.default_rng(seed)
    for _ in range(attempts):
        cuts = {y: (np.cumsum(rng.dirichlet(np.full(clients, alpha)))[:-1] * sizes[y]).astype(int) for y in sorted(sizes)}
        got = sum(np.diff(np.concatenate([[0], cuts[y], [sizes[y]]])) for y in sizes)
        if np.min(got) >= least:
            table = points.sparkSession.createDataFrame([(y, c.tolist()) for y, c in cuts.items()], f"y {dict(points.dtypes)['y']}, cuts array<long>")
            rows = ranked(points.drop("client"), "y", F.xxhash64("row_id", F.lit(seed))).join(F.broadcast(table), "y")
            return rows.withColumn("client", F.size(F.filter("cuts", lambda c: c <= F.col("r")))).drop("cuts", "r")
    raise RuntimeError(f"no split with {least} rows for each client in {attempts} attempts")


def split_points(points: DataFrame, kind: str, clients: int = 10, seed: int = 0, per_client: int = 2, alpha: float = 0.1, least: int = 5) -> DataFrame:
    """``points`` with client by the split ``kind``: own (as they are), ids (row_id modulo clients), labels (each client supports
    ``per_client`` labels; any labels are numbered first) or dirichlet (label shares with concentration ``alpha``).

    Except for own, clients with fewer than ``least`` rows are an error.
    """
    if kind == "own":
        return points
    if kind == "ids":
        out = points.withColumn("client", F.pmod("row_id", F.lit(clients)).cast("int"))
    elif kind == "labels":
        coded = label_codes(points.withColumnRenamed("y", "__y").withColumn("client", F.lit(0)), "__y")
        out = support_skew(coded, clients, per_client).drop("y").withColumnRenamed("__y", "y")
    elif kind == "dirichlet":
        return dirichlet_split(points.withColumn("client", F.lit(0)), clients, alpha, seed, least)
    else:
        raise ValueError(f"unknown split {kind}")
    few = out.groupBy("client").agg(F.count("*").alias("n")).agg(F.min("n").alias("n"), F.count("*").alias("c")).head()
    if (few["n"] or 0) < least or few["c"] < clients:
        raise RuntimeError(f"a client has fewer than {least} rows")
    return out


def dirichlet_map(y: np.ndarray, clients: int, alpha: float, seed: int, least: int = 5, attempts: int = 200) -> np.ndarray:
    """Client of each row: each label's rows, shuffled, are cut at floor(cumulative Dirichlet share times rows)."""
    rng = np.random.default_rng(seed)
    for _ in range(attempts):
        out = np.empty(len(y), int)
        for label in np.unique(y):
            rows = np.flatnonzero(y == label)
            rng.shuffle(rows)
            cuts = (np.cumsum(rng.dirichlet(np.full(clients, alpha)))[:-1] * len(rows)).astype(int)
            for c, part in enumerate(np.split(rows, cuts)):
                out[part] = c
        if np.bincount(out, minlength=clients).min() >= least:
            return out
    raise RuntimeError(f"no split with {least} rows for each client in {attempts} attempts")


def split_rows(points: DataFrame, share: float = 0.2, seed: int = 0) -> DataFrame:
    """``points`` with test: in each client clip(floor(share n + 0.5), 1, n - 1) rows, those with the smallest hashes.

    Hashes are counted in bins, so that of each client only the one bin in which the limit lies is ranked row by row.
    """
    key = F.xxhash64("row_id", F.lit(seed))
    bin_of = F.shiftrightunsigned(key, 64 - SPLIT_BITS).cast("int")
    p = points.withColumn("__key", key).withColumn("__bin", bin_of)
    bins = p.groupBy("client", "__bin").agg(F.count("*").alias("c"))
    run = Window.partitionBy("client").orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    counted = bins.withColumn("upto", F.sum("c").over(run)).withColumn("n", F.sum("c").over(Window.partitionBy("client")))
    counted = counted.withColumn("k", F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(share * F.col("n") + 0.5))))
    # at most one bin of a client is cut; its rows alone are ranked
    cut = counted.where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("c") < F.col("k"))).select("client", F.col("__bin").alias("edge"), (F.col("k") - F.col("upto") + F.col("c")).alias("room"))
    q = p.join(cut, "client").withColumn("__at", F.col("__bin") == F.col("edge"))
    low = q.where(~F.col("__at")).withColumn("test", F.col("__bin") < F.col("edge"))
    rank = F.row_number().over(Window.partitionBy("client").orderBy("__key", "row_id"))
    edge = q.where("__at").withColumn("test", rank <= F.col("room"))
    return low.union(edge).drop("__key", "__bin", "edge", "room", "__at")


#: Hash bits by which a client's rows are counted before its last rows are ranked.
SPLIT_BITS = 12


#: Centres of the synthetic mixtures.
CENTERS = ((-5.0, -4.0), (-1.0, 5.0), (5.0, -3.5), (6.5, 5.0))
NOISY_CENTERS = ((-3.2, -2.8), (-1.2, 2.8), (2.7, -2.2), (3.4, 2.7))
OVERLAP_CENTERS = ((-2.6, -2.2), (-0.9, 2.3), (2.3, -1.8), (2.8, 2.3))
#: Fixed values of scenarios with a mixture of their own: centres, deviation, share of noise. Elsewhere CENTERS, 0.75, 0.
MIXTURES = {"overlap_noise": (NOISY_CENTERS, 1.25, 0.08), "overlap_noise_hard": (NOISY_CENTERS, 1.55, 0.14), "cluster_skew_overlap": (OVERLAP_CENTERS, 1.45, 0.0)}
#: Fixed values of scenarios with unequal clients: range of the geometric sizes, rows at least.
SIZES = {"quantity_skew": (0.25, 2.5, 40), "quantity_skew_extreme": (0.05, 8.0, 20)}
#: Concentration of the Dirichlet shares of scenarios named otherwise than dirichlet_<alpha>.
ALPHAS = {"cluster_skew": 0.08, "quantity_skew": 0.25, "quantity_skew_extreme": 0.25, "overlap_noise": 0.35, "overlap_noise_hard": 0.35}


def _holder_shares(rng, holds: bool, own: list[float], alphas: list[float]) -> np.ndarray:
    """Fixed shares for clients that hold the last cluster; the others draw theirs of the rest."""
    return np.array(own) if holds else np.append(rng.dirichlet(alphas), 0.0)


def shares_of(scenario: str, c: int, clients: int, k: int, rng) -> np.ndarray:
    """Cluster shares of client c. Clients must be asked in order, as all draw from one generator."""
    if scenario == "iid":
        return np.full(k, 1 / k)
    if scenario in ("cluster_skew_hard", "cluster_skew_overlap"):
        p = np.zeros(k)
        p[[c % k, (c + rng.integers(1, k)) % k]] = 0.92, 0.08
        return p
    if scenario == "private_cluster":
        return _holder_shares(rng, c < max(1, clients // 4), [0.25, 0.2, 0.1, 0.45], [1.2, 1.0, 1.0])
    if scenario == "minority_private_cluster":
        return _holder_shares(rng, c in (0, max(1, clients // 2)), [0.06, 0.07, 0.07, 0.8], [0.9, 0.9, 0.9])
    alpha = float(scenario.removeprefix("dirichlet_")) if scenario.startswith("dirichlet_") else ALPHAS.get(scenario)
    if alpha is None:
        raise ValueError(f"unknown scenario {scenario}")
    p = rng.dirichlet(np.full(k, alpha))
    if scenario == "cluster_skew":  # the two largest clusters only
        p[np.argsort(p)[:-2]] = 0
        p = p / p.sum()
    return p


def synthetic(scenario: str, clients: int = 12, rows: int = 220, seed: int | None = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """(x, y) of each client: draws from one mixture whose shares, sizes, overlap or noise the scenario sets.

    iid, dirichlet_<alpha>, cluster_skew, cluster_skew_hard, cluster_skew_overlap, private_cluster, minority_private_cluster,
    quantity_skew, quantity_skew_extreme, overlap_noise, overlap_noise_hard. Noise keeps the label of the point it replaces.
    """
    scenario, rng = scenario.lower(), np.random.default_rng(seed)
    centers, std, noise = MIXTURES.get(scenario, (CENTERS, 0.75, 0.0))
    v, sizes = np.array(centers), [rows] * clients
    if scenario in SIZES:
        lo, hi, least = SIZES[scenario]
        g = np.geomspace(lo, hi, num=clients)
        sizes = [max(least, round(float(t))) for t in rows * (g / g.mean())]
    out = []
    for c, n in enumerate(sizes):
        y = rng.choice(len(v), size=n, p=shares_of(scenario, c, clients, len(v), rng))
        x = v[y] + rng.normal(0.0, std, size=(n, v.shape[1]))
        if replaced := round(noise * n):
            at = rng.choice(n, size=replaced, replace=False)
            x[at] = rng.uniform(v.min(axis=0) - 4, v.max(axis=0) + 4, size=(replaced, v.shape[1]))
        out.append((x, y))
    return out


def support_map(y: np.ndarray, clients: int, per_client: int, seed: int, least: int = 5) -> np.ndarray:
    """Client of each row, as support_skew() deals them but with each label's rows shuffled; only ``y`` is needed here."""
    rng, labels, out = np.random.default_rng(seed), np.unique(y), np.empty(len(y), int)
    held = [{(c + i) % len(labels) for i in range(max(1, min(per_client, len(labels))))} for c in range(clients)]
    for at, label in enumerate(labels):
        rows = np.flatnonzero(y == label)
        rng.shuffle(rows)
        takers = [c for c in range(clients) if at in held[c]] or [at % clients]
        for c, part in zip(takers, np.array_split(rows, len(takers)), strict=True):
            out[part] = c
    if (sizes := np.bincount(out, minlength=clients)).min() < least:
        raise RuntimeError(f"a client has fewer than {least} rows: {sizes.tolist()}")
    return out


def split_positions(sizes: list[int], seed: int, share: float = 0.2) -> list[np.ndarray]:
    """Of each client which rows are held out: the first of one seeded permutation a client, from one generator."""
    rng, out = np.random.default_rng(seed), []
    for n in sizes:
        test = np.zeros(n, bool)
        test[rng.permutation(n)[: int(min(n - 1, max(1, np.floor(share * n + 0.5))))]] = True
        out.append(test)
    return out


def sampled_centers(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k distinct rows as first centres."""
    if len(x) < k:
        raise ValueError(f"{len(x)} rows for {k} centres")
    return x[np.random.default_rng(seed).choice(len(x), size=k, replace=False)].copy()


def to_points(spark: SparkSession, clients: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    rows = [(c, i, [float(t) for t in a], int(b)) for c, (x, y) in enumerate(clients) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "client int, row_id long, x array<double>, y int")
