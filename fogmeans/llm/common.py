"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import block_pairs, filed, part_of, shared_dir  # noqa: F401  shared with the clustering operators

#: Texts of one inner step of a Python task hold about this many bytes.
STEP_BYTES = 4 << 20
#: A key with more rows than HOT is dealt to SALTS places when its name is joined; at most MOST_HOT such keys, the largest, are broadcast (8 MB).
HOT = 10_000
SALTS = 16
MOST_HOT = 1_000_000
#: Partitions that are named one by one, at most; with more of them collisions of hashes even out.
MOST_PLACES = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def pinned(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there and lost executors cost nothing twice."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.pinned_path = path
    return out


def dropped(*frames: DataFrame | None) -> None:
    """Delete the files of pinned tables that nothing reads any more."""
    for df in frames:
        if df is not None and (path := getattr(df, "pinned_path", None)):
            drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def text_steps(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, list]]:
    """Slices (start, end, texts as bytes or None) of a batch, each of about STEP_BYTES; a longer text is a slice of its own."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    sizes = np.diff(np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]) if len(col) else np.zeros(0, int)
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > STEP_BYTES:
            yield start, i, col.slice(start, i - start).to_pylist()
            start, held = i, 0
        held += int(n)
    if start < len(col):
        yield start, len(col), col.slice(start).to_pylist()


def map_texts(df: DataFrame, keep: list[str], make: Callable[[], Callable[[list], list[list]]], fields: str, column: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``keep`` of ``df`` and, of each text, the columns ``fields`` (a DDL string).

    ``make()`` runs once a task and returns a function from a list of texts (UTF-8 bytes or None) to lists of values, one a
    field; of each column in ``also`` (columns of ``keep``) it gets the list of values too. Nothing is shuffled and a task
    holds one Arrow batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType(list(df.select(*keep).schema) + list(StructType.fromDDL(fields)))
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start, end, texts in text_steps(batch, column):
                rows = batch.slice(start, end - start)
                made = work(texts, *[rows.column(rows.schema.get_field_index(a)).to_pylist() for a in also])
                cols = [rows.column(rows.schema.get_field_index(k)) for k in keep]
                cols += [pa.array(v, type=arrow.field(len(keep) + i).type) for i, v in enumerate(made)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return df.select(*dict.fromkeys([*keep, column])).mapInArrow(run, out)


class Forest:
    """Union-find over dense local indices; the smallest index is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, ids: np.ndarray) -> np.ndarray:
        r = self.up[ids]
        while True:
            nxt = self.up[r]
            if np.array_equal(nxt, r):
                break
            r = nxt
        self.up[ids] = r
        return r

    def join(self, ids: np.ndarray) -> None:
        """All of ``ids`` are one group."""
        r = np.unique(self.roots(ids))
        if len(r) > 1:
            self.up[r[1:]] = r[0]


def components(edges: DataFrame, jumps: int = 3) -> DataFrame:
    """Connected components by contraction: (node, component), component the smallest node; only nodes with an edge.

    ``edges`` has long columns a and b. A round points each node at its smallest neighbour or itself, follows the pointers
    ``jumps`` doublings, relabels the edges and drops loops and repeats. Every component with an edge at least halves, so
    the rounds are logarithmic; each is written to the shared folder. Nulls and loops link nothing; no edges give no rows.
    """
    spark = edges.sparkSession
    edges = pinned(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    total: DataFrame | None = None
    while edges.head(1):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"), F.count("*").alias("n")).select("node", F.least("node", "m").alias("to"), "n")
        near = pinned(near, "cc-step")
        step = near.select("node", "to")
        for _ in range(jumps):
            step = step.alias("x").join(step.select(F.col("node").alias("n2"), F.col("to").alias("t2")), F.col("to") == F.col("n2"), "left").select("node", F.coalesce("t2", "to").alias("to"))
        # n: edges of the node, so that the hub of a large group is dealt to several places below
        step = pinned(step.join(near.select("node", "n"), "node"), "cc-step")
        if total is None:
            fresh = step.select("node", F.col("to").alias("component"))
        else:
            fresh = total.join(step.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        old, total = total, pinned(fresh, "cc-total")
        left = spread_join(edges, step.select(F.col("node").alias("a"), F.col("to").alias("ta"), "n"), "a", "n", "b").drop("n")
        left = spread_join(left, step.select(F.col("node").alias("b"), F.col("to").alias("tb"), "n"), "b", "n", "a").drop("n")
        links = pinned(left.where("ta != tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "cc-edges")
        dropped(edges, near, step, old)
        edges = links
    dropped(edges)
    return total if total is not None else spark.createDataFrame([], "node long, component long")


def places(spark: SparkSession, n: int) -> list[int]:
    """n integers that a hash repartition into n partitions puts into n different ones; 0 .. n - 1 for more than MOST_PLACES."""
    if n > MOST_PLACES:
        return list(range(n))
    ids = spark.range(40 * n + 2000).select(F.col("id").cast("int").alias("i"))
    found = ids.groupBy(F.pmod(F.hash("i"), F.lit(n)).alias("at")).agg(F.min("i").alias("i")).collect()  # n rows
    return sorted(r["i"] for r in found) if len(found) == n else list(range(n))


def spread_join(rows: DataFrame, names: DataFrame, key: str, size: str, by: str) -> DataFrame:
    """``rows`` inner joined with ``names`` (one row a key) on column ``key``; null keys meet nothing.

    ``size`` of ``names`` says about how many rows have the key. Keys of over HOT rows stand SALTS times in ``names``, and
    their rows are dealt among them by the hash of ``by``, so that no task gets all rows of one key. Hot keys are told by
    their 64-bit hash; a key that shares one is salted too, on both sides alike, so no row is lost. Where none is hot the
    join is a plain one.
    """
    hot = names.where(F.col(size) > HOT).select(F.xxhash64(key).alias("__hot"), size).orderBy(F.col(size).desc()).limit(MOST_HOT).select("__hot").distinct()
    if not hot.head(1):
        return rows.join(names, key)
    hot = pinned(hot, "hot-keys")
    is_hot = F.col("__hot").isNotNull()
    marked = lambda df: df.withColumn("__h", F.xxhash64(key)).join(F.broadcast(hot), F.col("__h") == F.col("__hot"), "left")
    dealt = marked(rows).withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0).cast("int")).drop("__h", "__hot")
    every = marked(names).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(is_hot, SALTS - 1).otherwise(0)))).drop("__h", "__hot")
    return dealt.join(every, [key, "__salt"]).drop("__salt")


def corpus_counts(docs: DataFrame, make: Callable[[], Callable[[bytes | None], Iterator[int]]], n: int, column: str = "text") -> tuple[int, np.ndarray]:
    """Rows of ``docs``, and of n numbered things in how many texts each is. ``make()`` gives a function from a text to numbers.

    Each step of a task sends one row of counts, so n must be bounded; all texts count.
    """

    def work():
        of = make()

        def counted(texts):
            total = np.zeros(n + 1, dtype=np.int64)
            total[0] = len(texts)
            for t in texts:
                for i in set(of(t)):
                    total[i + 1] += 1
            return [[total.tolist(), *[None] * (len(texts) - 1)]]

        return counted

    key = docs.columns[0]
    found = np.zeros(n + 1, dtype=np.int64)
    rows = map_texts(docs.select(F.col(f"`{key}`").alias("__key"), F.col(column).alias("text")), ["__key"], work, "counts array<long>")
    for r in rows.where("counts is not null").select(F.posexplode("counts").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect():
        found[r["i"]] = r["n"]
    return int(found[0]), found[1:]
