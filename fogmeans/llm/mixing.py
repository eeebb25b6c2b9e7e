"""Mixing sources to target weights by Poisson replication. Native columns only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pinned

SEED = "mix-1"
#: Source tables of up to this many numbers (8 MB) are broadcast; larger ones are joined by source and salt.
SMALL = 1_000_000
SALTS = 64
#: Copies of one document that are made at a time.
COPIES = 4096


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by |: the first 52 bits, exact in a double."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, budget: float = 1.0) -> DataFrame:
    """source, n, rate: the mean repetition that gives each source its share of ``budget`` times all documents.

    ``weights`` has source and weight (relative, not negative; missing sources weigh 0); without it every source weighs the
    same. Null is a source of its own.
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        rows = counts.withColumn("weight", F.lit(1.0))
    else:
        w = weights.groupBy(F.col("source").alias("s2")).agg(F.sum("weight").cast("double").alias("weight"))
        rows = counts.join(w, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    total = rows.agg(F.sum("n").cast("double").alias("all_n"), F.sum("weight").alias("all_w"))
    out = rows.crossJoin(F.broadcast(total))  # one row
    share = F.when(F.col("all_w") > 0, F.col("weight") / F.col("all_w")).otherwise(0.0)
    return out.select("source", "n", (share * F.lit(float(budget)) * F.col("all_n") / F.col("n")).alias("rate"))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """source, rate, first, cdf: the Poisson distribution function of each rate, from count ``first`` to where its rest is below 1e-15.

    Probabilities are made in logarithms, so large rates don't underflow. Counts run from rate - 12 sqrt(rate) - 30 (0 where
    that is below 100; else less than 1e-15 lies before it) to rate + 12 sqrt(rate) + 30, so a table grows with the root of
    its rate. The first logarithm of a factorial is Stirling's series, exact to a double from 100.
    """
    wide = 12 * F.sqrt("rate") + 30
    low = F.floor(F.col("rate") - wide).cast("long")
    first, last = F.when(low >= 100, low).otherwise(F.lit(0).cast("long")), F.ceil(F.col("rate") + wide).cast("long")
    k, start = F.col("k").cast("double"), F.greatest("first", F.lit(1)).cast("double")
    stirling = start * F.ln(start) - start + F.ln(F.lit(2 * math.pi) * start) / 2 + 1 / (12 * start) - 1 / (360 * F.pow(start, F.lit(3.0)))
    rows = rates.where("rate > 0").select("source", "rate", first.alias("first"), last.alias("last")).select("source", "rate", "first", F.explode(F.sequence("first", "last")).alias("k"))
    by = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    term = F.when(F.col("k") == 0, F.lit(0.0)).when(F.col("k") == F.col("first"), stirling).otherwise(F.ln(F.greatest(k, F.lit(1.0))))
    rows = rows.withColumn("lf", F.sum(term).over(by))
    rows = rows.withColumn("p", F.exp(k * F.ln("rate") - F.col("rate") - F.col("lf"))).withColumn("c", F.sum("p").over(by))
    return rows.groupBy("source", "rate", "first").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf"))


def _replicated(docs: DataFrame, weights: DataFrame | None = None, budget: float = 1.0, seed: str = SEED) -> DataFrame:
    cols = docs.columns
    names = [f"__c{i}" for i in range(len(cols))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(cols, names, strict=True)], F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), F.col("source").alias("__s"))
    rates = poisson_tables(source_rates(docs, weights, budget)).withColumnRenamed("source", "__t")
    rates = pinned(rates, "mix-rates")
    numbers, most = rates.agg(F.sum(F.size("cdf") + 4), F.max("rate")).first()
    same = F.col("__s").eqNullSafe(F.col("__t"))
    if (numbers or 0) <= SMALL:
        drawn = rows.join(F.broadcast(rates), same)
    else:
        salted = rates.withColumn("__z", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        drawn = rows.withColumn("__y", F.pmod(F.xxhash64("__id"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("__y") == F.col("__z")))
    u = uniform(F.lit(seed), F.col("__id"))
    copies = drawn.withColumn("__n", F.col("first") + F.size(F.filter("cdf", lambda c: c <= u))).where("__n > 0").drop("cdf")
    # blocks of copies, then copies: no array grows with the rate
    copies = copies.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / COPIES))))
    if (most or 0) > COPIES / 2:
        # a document may have several blocks: they are dealt to all tasks before their copies are made
        copies = copies.repartition("__id", "__b")
    out = copies.withColumn("mix_copy", F.explode(F.sequence(F.col("__b") * COPIES, F.least(F.col("__n"), (F.col("__b") + 1) * COPIES) - 1).cast("array<int>")))
    out = out.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), "__id", "mix_copy").cast("binary")))
    out = out.select(*names, "mix_copy", F.col("rate").alias("mix_rate"), "mix_key")
    # rows are dealt by hash and sorted by it inside a partition: a whole shuffle without a sampling pass over the texts
    dealt = out.repartition(F.col("mix_key")).sortWithinPartitions("mix_key")
    return dealt


def replicate(docs: DataFrame, weights: DataFrame | None = None, budget: float = 1.0, seed: str = SEED) -> DataFrame:
    """``docs`` with each row repeated by a Poisson draw of its source's rate, in an order shuffled over all rows.

    Columns of ``docs``, then mix_copy (from 0), mix_rate and mix_key, which replace columns of
    these names. The draw inverts the distribution at a hash of seed
    and doc_id, so reruns and lost tasks give the same rows, and equal doc_ids draw alike. A null doc_id hashes as empty.
    Copies of one document are made in blocks of COPIES; where a rate allows more than one block, the blocks are dealt to all
    tasks first, so a source of one document is not made by one task. Sources are never gathered: each has one row of its rate and distribution, joined to the documents where they lie; these
    rows are broadcast only if they hold SMALL numbers at most. No documents, or
    weights that sum to 0, give no rows.
    """
    rows = _replicated(docs, weights, budget, seed)
    added = ("mix_copy", "mix_rate", "mix_key")
    return rows.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in added], *added)


def mixed(docs: DataFrame, weights: DataFrame | None = None, budget: float = 1.0, seed: str = SEED) -> DataFrame:
    """replicate() with only the columns of ``docs``."""
    return _replicated(docs, weights, budget, seed).select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])


def cte(docs: str, seed: str = SEED, weights: dict[str, float] | None = None) -> str:
    """Common table expressions that end in ``mix``: replicate() of ``docs`` in DuckDB, with equal weights or those of some sources."""
    if weights is not None:
        total, listed = sum(weights.values()), ", ".join(f"('{s}', {float(w)}::double)" for s, w in weights.items())
        equal = cte(docs, seed)
        start, end = equal.index("rates as ("), equal.index("ks as (")
        given = f"given(source, weight) as (values {listed}),\nrates as (select source, (weight / {float(total)}::double) * 1.0::double * (select sum(n) from counts)::double / n rate from counts join given using (source)),\n"
        return equal[:start] + given + equal[end:]
    return f"""
counts as (select source, count(*) n from {docs} group by source),
rates as (select source, (1.0::double / (select count(*) from counts)::double) * 1.0::double * (select sum(n) from counts)::double / n rate from counts),
ks as (select source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::int + 1)) k from rates),
lf as (select *, sum(case when k > 0 then ln(k::double) else 0 end) over (partition by source order by k) lf from ks),
cdf as (select source, rate, k, sum(exp(k * ln(rate) - rate - lf)) over (partition by source order by k) c from lf),
draws as (select d.*, ('0x' || substr(md5('{seed}|' || coalesce(d.doc_id::varchar, '')), 1, 13))::bigint::double / 4503599627370496.0::double u from {docs} d),
num as (select d.doc_id did, any_value(c.rate) rate, count(*) n from (select distinct doc_id, source, u from draws) d join cdf c on c.source is not distinct from d.source and c.c <= d.u group by d.doc_id),
mix as (select d.*, unnest(range(0, n)) mix_copy, rate mix_rate from draws d join num on did is not distinct from d.doc_id)
"""


SQL = f"with {cte('documents')} select doc_id, source, mix_copy::int mix_copy, round(mix_rate, 9) mix_rate, md5('{SEED}|order|' || coalesce(doc_id::varchar, '') || '|' || mix_copy) mix_key, md5(text) text_md5, lang, n_chars from mix"

#: Target weights of the second query: sources that are not named get nothing.
TARGETS = {"src0": 3.0, "src1": 1.0, "src2": 1.0, "src3": 0.5}
TARGETS_SQL = f"with {cte('documents', weights=TARGETS)} select doc_id, source, mix_copy::int mix_copy, round(mix_rate, 9) mix_rate from mix"
