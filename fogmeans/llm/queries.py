"""The registered query of each operator, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, chat, counting, fim, hnsw, license, mixing, negatives, quality, simhash, tokenfile, toxicity, warc
from .common import table


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows = toxicity.score_documents(docs, model)
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence", "evidence_cosine")


def op2_quality_rules(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark, sf_dir):
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_mixing(spark, sf_dir):
    rows = mixing.replicate(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "source", "mix_copy", F.round("mix_rate", 9).alias("mix_rate"), "mix_key", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang", "n_chars")


def op5_license_scan(spark, sf_dir):
    return license.scan_documents(table(spark, sf_dir, "documents")).drop("spans")


def op6_chat_format(spark, sf_dir):
    return chat.format_chat(table(spark, sf_dir, "conversations"))


def op7_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    return counting.count_edited(table(spark, sf_dir, "documents"), counting.revision_edits())


def op9_simhash_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_warc(spark, sf_dir):
    rows = warc.round_trip(table(spark, sf_dir, "pages"), payloads=False)
    size = F.coalesce(F.col("response.payload_bytes"), F.col("metadata.payload_bytes"))
    return rows.select("page_id", size.alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("refers_to_page").alias("refers_to"))


def op11_token_output(spark, sf_dir):
    return tokenfile.round_trip(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark, sf_dir):
    return negatives.contract(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark, sf_dir):
    return fim.digests(table(spark, sf_dir, "documents"))


def quality_ablations(spark, sf_dir):
    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents")), (quality.V1, quality.V2))


def mixing_targets(spark, sf_dir):
    weights = spark.createDataFrame(list(mixing.TARGETS.items()), "source string, weight double")
    return mixing.replicate(table(spark, sf_dir, "documents"), weights).select("doc_id", "source", "mix_copy", F.round("mix_rate", 9).alias("mix_rate"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_quality_rules, op3_embedding_dedup, op4_mixing, op5_license_scan, op6_chat_format, op7_bpe, op8_token_counts, op9_simhash_dedup, op10_warc, op11_token_output, op12_hard_negatives, op13_fill_in_middle, quality_ablations, mixing_targets)}
SQL = {"op2_quality_rules": quality.SQL, "op4_mixing": mixing.SQL, "op6_chat_format": chat.SQL, "op10_warc": warc.SQL, "op12_hard_negatives": negatives.SQL, "op13_fill_in_middle": fim.SQL, "op3_embedding_dedup": hnsw.SQL, "quality_ablations": quality.ABLATIONS_SQL, "mixing_targets": mixing.TARGETS_SQL}
