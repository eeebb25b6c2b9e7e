"""Quality rules as a ledger of failure bits, and policies as masks over it. Native columns only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
#: Rule names in bit order (append only: stored ledgers keep their meaning).
RULES = ("few_words", "repeated_words", "symbols", "duplicate_lines", "exclamations", "long_words", "short_words")


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject a document in it."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES.index(r) for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
V1 = Policy("v1", RULES)
V2 = Policy("v2-no-shape", RULES[:5])
POLICIES = {p.version: p for p in (BASE, V1, V2)}


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with struct column ``m``: every measurement, taken once a row, without a shuffle.

    n_words, word_chars, n_symbols, n_exclamations, n_lines (lines with a word), n_dup_lines, n_repeat_words. Windows are
    compared by the 64-bit hash of their words' 64-bit hashes within one text. Null texts measure as empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    # one step for each array that later ones use twice, so that none is computed again
    zero = docs.withColumn("__v", F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")).withColumn("__l", F.transform(lines, lambda x: F.xxhash64(x)))
    one = zero.withColumn("__w", F.transform("__v", lambda w: F.xxhash64(w))).withColumn("__chars", F.length(F.array_join("__v", ""))).drop("__v")
    w, n = F.col("__w"), F.size("__w")
    # hashes of 2, 4 and 8 words from those of 1, 2 and 4
    cur, width = "__w", 1
    while width < WINDOW:
        size = F.greatest(n - 2 * width + 1, F.lit(0))
        one = one.withColumn(f"__h{2 * width}", F.zip_with(F.slice(cur, F.lit(1), size), F.slice(cur, F.lit(1 + width), size), lambda a, b: F.xxhash64(a, b)))
        width *= 2
        cur = f"__h{width}"
    windows = F.col(cur)
    two = one.withColumn("__h", windows)
    h = F.col("__h")
    pairs = F.array_sort(F.zip_with(h, F.sequence(F.lit(1), F.greatest(F.size(h), F.lit(1))), lambda a, i: F.struct(a.alias("h"), i.alias("p"))))
    three = two.withColumn("__s", F.when(F.size(F.array_distinct(h)) < F.size(h), pairs))
    s = F.col("__s")
    hash_at = lambda i: F.get(s, i)["h"]  # noqa: E731  null outside
    twice = F.filter(F.transform(s, lambda x, i: F.when((x["h"] == hash_at(i - 1)) | (x["h"] == hash_at(i + 1)), x["p"])), lambda p: p.isNotNull())
    four = three.withColumn("__p", F.array_sort(twice))
    p = F.col("__p")
    covered = F.aggregate(p, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda acc, x: F.struct((x + WINDOW).alias("end"), (acc["n"] + F.least(F.lit(WINDOW), x + WINDOW - acc["end"])).alias("n")), lambda acc: acc["n"])
    count = lambda c: c.cast("long")

    def without(chars: str) -> Column:
        left = text
        for c in chars:
            left = F.replace(left, F.lit(c), F.lit(""))
        return F.length(left)

    m = F.struct(
        count(F.size(w)).alias("n_words"),
        count(F.col("__chars")).alias("word_chars"),
        count(F.length(text) - without("#*$%&|<>")).alias("n_symbols"),
        count(F.length(text) - without("!")).alias("n_exclamations"),
        count(F.size("__l")).alias("n_lines"),
        count(F.size("__l") - F.size(F.array_distinct("__l"))).alias("n_dup_lines"),
        count(F.coalesce(covered, F.lit(0))).alias("n_repeat_words"),
    )
    # a generator is where the optimizer stops a filter on the measurements from being pushed down, and so taken again, below
    return four.withColumn("m", F.explode(F.array(m))).drop("__w", "__l", "__h2", "__h4", "__h8", "__h", "__s", "__p", "__chars")


def rule_columns(m: Column) -> dict[str, Column]:
    """Of each rule, whether it fails. Thresholds are shares of words or lines, so long and short texts are judged alike."""
    n = m["n_words"]
    return {
        "few_words": n < 20,
        "repeated_words": 100 * m["n_repeat_words"] > 30 * n,
        "symbols": 10 * m["n_symbols"] > n,
        "duplicate_lines": 100 * m["n_dup_lines"] > 30 * m["n_lines"],
        "exclamations": 10 * m["n_exclamations"] > n,
        "long_words": m["word_chars"] > 25 * n,
        "short_words": 2 * m["word_chars"] < 3 * n,
    }


def ledger(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (doc_id), the measurements and failure_bits: bit i is set if RULES[i] fails. Each rule runs once."""
    rules = rule_columns(F.col("m"))
    bits = sum((F.when(rules[r], F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(RULES)), F.lit(0).cast("long"))
    keep = keep or ["doc_id"]
    return measured(docs.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keep)], F.col("text"))).select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keep)], "m.*", bits.alias("failure_bits"))


def verdict(policy: Policy = V1) -> Column:
    """kept under ``policy``, from failure_bits."""
    return F.col("failure_bits").bitwiseAND(F.lit(policy.mask)) == 0


def ablations(rows: DataFrame, policies: tuple[Policy, ...] = (V1,)) -> DataFrame:
    """policy, rule, n_failed, n_failed_alone, n_kept_without of each rule of each policy, from a ledger.

    The ledger is aggregated once to its patterns of failure bits, at most 2 ** len(RULES) rows; all counts are bitwise
    operations on these. No documents give no rows.
    """
    patterns = rows.groupBy("failure_bits").agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(p.version).alias("policy"), F.lit(p.mask).cast("long").alias("mask"), F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for p in policies for r in p.rules]))
    x = patterns.select("n", "failure_bits", each.alias("x")).select("n", "x.policy", "x.rule", "x.bit", F.col("failure_bits").bitwiseAND(F.col("x.mask")).alias("bits"))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    return x.groupBy("policy", "rule").agg(count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), count(F.col("bits") == F.col("bit")).alias("n_failed_alone"), count(rest == 0).alias("n_kept_without"))


def quality(docs: DataFrame, policy: Policy = V1) -> DataFrame:
    """doc_id, measurements, failure_bits, base_failed and kept of every row.

    Null and empty texts have no words and fail the base. Repeated rows are judged one by one; other columns are ignored.
    """
    base = F.col("failure_bits").bitwiseAND(F.lit(BASE.mask)) != 0
    return ledger(docs).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(policy))


def keep_good(docs: DataFrame, policy: Policy = V1) -> DataFrame:
    """The rows of ``docs`` that pass the base and ``policy``, with the columns they came with."""
    cols = docs.columns
    good = Policy(policy.version, tuple(dict.fromkeys([*BASE.rules, *policy.rules])))
    names = [f"__c{i}" for i in range(len(cols))]
    rows = ledger(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(cols, names, strict=True)], "text"), names)
    return rows.where(verdict(good)).select(*[F.col(n).alias(c) for c, n in zip(cols, names, strict=True)])


_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
SQL = f"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') t, {_WORDS} w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) l from documents),
win as (select r, i, array_to_string(w[i:i+7], ' ') h from (select r, w, unnest(range(1, len(w) - 6)) i from d where len(w) >= 8)),
rep as (select r, i from win qualify count(*) over (partition by r, h) > 1),
cov as (select r, sum(least(8, coalesce(nxt - i, 8))) c from (select r, i, lead(i) over (partition by r order by i) nxt from rep) group by r),
m as (select doc_id, len(w)::bigint n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols, (length(t) - length(replace(t, '!', '')))::bigint n_exclamations,
  len(l)::bigint n_lines, (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(c, 0)::bigint n_repeat_words from d left join cov using (r)),
b as (select *, (case when n_words < 20 then 1 else 0 end + case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end + case when 10 * n_symbols > n_words then 4 else 0 end
  + case when 100 * n_dup_lines > 30 * n_lines then 8 else 0 end + case when 10 * n_exclamations > n_words then 16 else 0 end
  + case when word_chars > 25 * n_words then 32 else 0 end + case when 2 * word_chars < 3 * n_words then 64 else 0 end)::bigint failure_bits from m)
select *, failure_bits & 3 <> 0 base_failed, failure_bits & 127 = 0 kept from b
"""

ABLATIONS_SQL = f"with q as ({SQL}) " + " union all ".join(
    f"select '{p.version}' policy, '{r}' rule, count(*) filter (failure_bits & {p.mask} & {1 << RULES.index(r)} <> 0) n_failed, count(*) filter (failure_bits & {p.mask} = {1 << RULES.index(r)}) n_failed_alone, count(*) filter (failure_bits & {p.mask & ~(1 << RULES.index(r))} = 0) n_kept_without from q"
    for p in (V1, V2)
    for r in p.rules
)
