"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm import (bpe_prefix, chat_format, decontaminate, hard_negatives, language_id, license_scan, line_dedup, ngram_join,
                           quality_rules, suffix_dedup, token_counts, turn_repair, warc)
from cohortlab.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.dedup_lines(docs).select("doc_id", "text")


def op2_bpe_prefix(spark, sf_dir):
    return bpe_prefix.encode_documents(table(spark, sf_dir, "documents"),
                                       public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op4_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                     public_tokenizers.PATTERN)


def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    model = language_id.fit_language_model(docs.where(~held))
    return language_id.predict_language(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op7_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.fit_quality_model(docs, table(spark, sf_dir, "labels"))
    return quality_rules.document_statistics(docs, model=model)


def op8_chat_format(spark, sf_dir):
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op9_ngram_join(spark, sf_dir):
    return ngram_join.link_components(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark, sf_dir):
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark, sf_dir):
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=shifted)


def op12_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op13_turn_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    return turn_repair.repair_report(turn_repair.damage(conversations), conversations)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_bpe_prefix, op3_license_scan, op4_warc, op5_token_counts,
                                   op6_language_id, op7_quality_rules, op8_chat_format, op9_ngram_join,
                                   op10_decontaminate, op11_hard_negatives, op12_suffix_dedup,
                                   op13_turn_repair)}
ORACLE = {"op8_chat_format": chat_format.ORACLE, "op10_decontaminate": decontaminate.ORACLE,
          "op11_hard_negatives": hard_negatives.ORACLE}
