"""Documents, from toxicity to token ids, as stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fogmeans.llm import bpe, mixing, quality, simhash, toxicity
from fogmeans.llm.common import dropped, pinned, table


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3. Texts without words have the rate of such labelled texts; copies stay or go
    together, very long texts are scored whole, an empty table stays empty; all columns are kept, whatever their names."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy keeps. A null text has no words and goes; repeated rows stay or go together, very long
    texts are measured whole, an empty table stays empty; all columns are kept."""
    return quality.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id (null last). Of rows equal in doc_id and text
    one stays; texts without words are one group; an empty table stays empty; all columns are kept."""
    return simhash.keep_first(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources come to their target weights, with the columns they came with. A null source is a source
    of its own; repeated rows draw alike; an empty table stays empty."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes of every row. A null text is empty; repeated rows are encoded one by
    one, very long texts whole; an empty table gives no rows."""
    return bpe.digests(docs)


STAGES = [("toxicity", not_toxic), ("quality_rules", good_quality), ("simhash_dedup", one_of_each_group), ("mixing", mixed_sources), ("bpe", token_ids)]
#: Toxicity and byte-level BPE can't be put as SQL; tests/llm holds run() against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage has read is deleted when its output is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, pinned(stage(spark, docs, sf_dir), f"pipeline-{name}")
        dropped(before)
    return docs
