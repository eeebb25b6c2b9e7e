"""Operators over experiment rows: dataset, seed, arm, value."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written


def read_results(spark: SparkSession, *paths: str, schema: str | None = None) -> DataFrame:
    """CSV files with a header, as one relation over the union of their columns; column file_no says which file came later."""
    reader = spark.read.option("header", True)
    parts = [(reader.schema(schema) if schema else reader).csv(p).withColumn("file_no", F.lit(i)) for i, p in enumerate(paths)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_results(rows: DataFrame, path: str, leading: list[str] = (), mode: str = "errorifexists") -> None:
    """CSV with ``leading`` columns first. Existing output is refused unless ``mode`` says otherwise."""
    rest = [c for c in rows.columns if c not in leading]
    rows.select(*leading, *rest).write.mode(mode).option("header", True).csv(path)


def ordered_union(parts: list[DataFrame], leading: list[str] = ()) -> DataFrame:
    """The rows of all parts: ``leading`` columns first, the others in the order in which they first appear; missing ones are null."""
    names = list(dict.fromkeys([*leading, *[c for p in parts for c in p.columns]]))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every.select(*[F.col(f"`{c}`") if c in every.columns else F.lit(None).cast("string").alias(c) for c in names])


def replace_results(parts: list[DataFrame], path: str, leading: list[str] = ()) -> None:
    """Write ordered_union() of ``parts`` as CSV in place of what is at ``path``, which may be among what they read.

    The rows are written beside it; when all are there the old folder is set aside, the new one renamed into its place and
    the old one deleted. A write that fails leaves the old one as it was; a rename that fails puts it back.
    """
    rows = ordered_union(parts, leading)
    spark, mark = rows.sparkSession, uuid.uuid4().hex
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    old, staged, aside = hadoop(path), hadoop(f"{path}.staged-{mark}"), hadoop(f"{path}.old-{mark}")
    store = old.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        rows.write.option("header", True).csv(staged.toString())
        there = store.exists(old)
        if there and not store.rename(old, aside):
            raise OSError(f"{path} cannot be set aside")
        if not store.rename(staged, old):
            if there:
                store.rename(aside, old)
            raise OSError(f"{path} cannot be replaced")
        if there:
            store.delete(aside, True)
    finally:
        store.delete(staged, True)


def results_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result-shaped relation: dataset, seed, arm, value (a mean).

    It is written once: a mean taken twice may differ in its last digits, as partial sums come in any order, and
    whoever compares the relation with itself would find changes.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    means = e.groupBy(F.col("event_type").alias("dataset"), (F.col("user_id") % 10).alias("seed"), (F.floor(F.col("user_id") / 10) % 4).alias("arm")).agg(F.avg("value").alias("value"))
    return written(means, "results")


def aggregate_rows(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """n_runs, and of each value the mean and population deviation without NaN."""
    aggs = [F.count("*").alias("n_runs")]
    for v in values:
        clean = F.when(~F.isnan(v), F.col(v))
        aggs += [F.avg(clean).alias(f"{v}_mean"), F.stddev_pop(clean).alias(f"{v}_std")]
    return rows.groupBy(*[F.col(k).cast("string").alias(k) for k in keys]).agg(*aggs)


def first_rows(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first by ``order``. Map-side combined, so a key of any size is one row a task."""
    named = [c for c in rows.columns]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*named), F.struct(*order)).alias("r"))
    return best.select("r.*")


def compare(new: DataFrame, old: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """key columns, field, prior, new, match (equal, or both NaN) for keys in both."""
    a = new.select(*keys, *[F.col(f).cast("double").alias(f"n_{f}") for f in fields])
    b = old.select(*keys, *[F.col(f).cast("double").alias(f"o_{f}") for f in fields])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o_{f}").alias("prior"), F.col(f"n_{f}").alias("new")) for f in fields]))
    return a.join(b, keys).select(*keys, each.alias("x")).select(*keys, "x.*").withColumn("match", F.col("prior").eqNullSafe(F.col("new")))


def comparison(parts: list[dict], least_runs: int = 0) -> tuple[DataFrame, DataFrame]:
    """(values, verdict) of new rows against prior ones, part by part.

    A part is a dict: source, new, prior, keys, fields, strict (True: differences count; False: advisory), and optionally
    scope, the prior rows that must be covered. Values are the rows of compare() with source and strict. The verdict is one
    row: n_runs, n_values, n_bad, n_advisory_runs, n_advisory_bad, n_uncovered, ok. It is not ok with a strict difference,
    without runs, with uncovered rows, or with fewer runs than ``least_runs``.
    """
    rows, missing = [], []
    for p in parts:
        key = F.concat_ws("|", *[F.col(k).cast("string") for k in p["keys"]])
        each = compare(p["new"], p["prior"], p["keys"], p["fields"]).select(F.lit(p["source"]).alias("source"), key.alias("key"), "field", "prior", "new", "match", F.lit(p.get("strict", True)).alias("strict"))
        rows.append(each)
        if "scope" in p:
            missing.append(uncovered(p["new"], p["scope"], p["keys"]).select(key.alias("key")))
    values = reduce(DataFrame.unionByName, rows)
    strict = F.col("strict")
    run = F.concat_ws("|", "source", "key")
    one = values.agg(
        F.count_distinct(F.when(strict, run)).alias("n_runs"), F.count_if(strict).alias("n_values"), F.count_if(strict & ~F.col("match")).alias("n_bad"),
        F.count_distinct(F.when(~strict, run)).alias("n_advisory_runs"), F.count_if(~strict & ~F.col("match")).alias("n_advisory_bad"),
    )
    gaps = reduce(DataFrame.unionByName, missing).agg(F.count("*").alias("n_uncovered")) if missing else values.sparkSession.range(1).select(F.lit(0).cast("long").alias("n_uncovered"))
    verdict = one.crossJoin(F.broadcast(gaps))  # one row each
    return values, verdict.withColumn("ok", (F.col("n_bad") == 0) & (F.col("n_runs") > 0) & (F.col("n_uncovered") == 0) & (F.col("n_runs") >= least_runs))


def drift(new: DataFrame, old: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """field, n, n_changed, max_abs, mean_abs of the changes of compare(); NaN on both sides is no change."""
    d = compare(new, old, keys, fields).withColumn("d", F.when(~F.col("match"), F.abs(F.col("new") - F.col("prior"))))
    return d.groupBy("field").agg(F.count("*").alias("n"), F.count_if(~F.col("match")).alias("n_changed"), F.max("d").alias("max_abs"), F.avg("d").alias("mean_abs"))


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON rows of finished jobs, one object a line."""
    return spark.read.schema(schema).json(path)


def read_log(spark: SparkSession, path: str, marker: str) -> DataFrame:
    """file, line, value: the numbers that follow ``marker`` on the lines of text logs that hold it."""
    number = r"([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line")).where(F.col("line").contains(marker))
    after = F.expr("substring(line, locate(mark, line) + length(mark))")
    return rows.withColumn("mark", F.lit(marker)).withColumn("rest", after).select("file", "line", F.explode(F.regexp_extract_all("rest", F.lit(number), 1)).alias("value")).withColumn("value", F.col("value").cast("double"))


def write_report(spark: SparkSession, path: str, text: str, mode: str = "errorifexists") -> None:
    """Text (a report, or meta data as JSON) as one file under ``path``; existing output is refused unless ``mode`` says otherwise."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).option("lineSep", "\n").text(path)


def uncovered(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new, keys, "left_anti")


def in_scope(prior: DataFrame, asked: dict[str, list]) -> DataFrame:
    """The rows of ``prior`` that a run was asked for: of each named column only the listed values. Without a list all values are in scope, so that a changed name shows up as uncovered."""
    for column, values in asked.items():
        if values:
            prior = prior.where(F.col(column).isin(*values))
    return prior


def provenance(rows: DataFrame, expected: dict[str, object]) -> DataFrame:
    """``rows`` with fits (all ``expected`` columns have their value; null counts as no value) and misfit, the names of those that have not."""
    wrong = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.lit(v)), F.lit(c)) for c, v in expected.items()]), lambda c: c.isNotNull()) if expected else F.array().cast("array<string>")
    return rows.withColumn("misfit", wrong).withColumn("fits", F.size("misfit") == 0)


def pivoted(rows: DataFrame, key: list[str], column: str, values: list, value: str = "value") -> DataFrame:
    return rows.groupBy(*key).pivot(column, values).agg(F.avg(value))


def contrast(rows: DataFrame, terms: dict[int, float], keys: tuple[str, ...] = ("dataset", "seed")) -> DataFrame:
    """diff: the weighted sum over arms in each key; missing arms give no row, NaN values give NaN."""
    arms = rows.where(F.col("arm").isin(*terms)).groupBy(*keys).agg(*[F.max(F.when(F.col("arm") == a, F.col("value"))).alias(f"a{a}") for a in terms])
    whole = arms.where(reduce(lambda p, q: p & q, [F.col(f"a{a}").isNotNull() for a in terms]))
    return whole.select(*keys, reduce(lambda p, q: p + q, [F.lit(float(w)) * F.col(f"a{a}") for a, w in terms.items()]).alias("diff"))


def tally(diffs: DataFrame) -> DataFrame:
    d = F.col("diff")
    return diffs.groupBy("dataset").agg(F.count_if(d > 1e-12).alias("wins"), F.count_if(F.abs(d) <= 1e-12).alias("ties"), F.count_if(d < -1e-12).alias("losses"))


def best_arm(rows: DataFrame) -> DataFrame:
    means = rows.groupBy("dataset", "arm").agg(F.avg("value").alias("mean"))
    return means.groupBy("dataset").agg(F.max_by("arm", F.struct("mean", -F.col("arm"))).alias("arm"), F.max("mean").alias("mean"))


def substituted(rows: DataFrame, larger_is_better: bool = True) -> DataFrame:
    """``rows`` with NaN values replaced by the worst finite one of their (dataset, seed)."""
    finite = F.when(~F.isnan("value"), F.col("value"))
    w = Window.partitionBy("dataset", "seed")
    return rows.withColumn("value", F.coalesce(finite, (F.min if larger_is_better else F.max)(finite).over(w)))


def regret(rows: DataFrame, relative: bool = False) -> DataFrame:
    """arm, mean_regret, max_regret over data sets against the best arm of each, and recommended: the least of either."""
    means = substituted(rows).groupBy("dataset", "arm").agg(F.avg("value").alias("mean"))
    best = F.max("mean").over(Window.partitionBy("dataset"))
    r = means.withColumn("r", best - F.col("mean")).withColumn("r", F.try_divide("r", F.abs(best)) if relative else F.col("r"))
    one = r.groupBy("arm").agg(F.avg("r").alias("mean_regret"), F.max("r").alias("max_regret"))
    least = Window.partitionBy()  # one row an arm
    return one.withColumn("least_mean", F.col("mean_regret") == F.min("mean_regret").over(least)).withColumn("least_max", F.col("max_regret") == F.min("max_regret").over(least))
