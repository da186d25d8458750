"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm import chat_format, collocations, decontamination, filter_audit, html_text, language_id, quality_model, quality_rules, secret_scan, sentence_pieces, similarity_join, token_counts, toxicity
from harrow.session import table


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join.similarity_components(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.render(table(spark, sf_dir, "conversations"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.predict(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.withColumn("n_passages", F.size("passages").cast("long")).drop("passages")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_model, op2_token_counts, op3_similarity_join, op4_chat_format, op5_quality_rules, op6_html_text, op7_decontamination, op8_language_id,
        op9_sentence_pieces, op10_secret_scan, op11_toxicity, op12_collocations, op13_filter_audit,
    )
}
SQL: dict[str, str] = {
    "op3_similarity_join": similarity_join.SQL, "op4_chat_format": chat_format.SQL, "op5_quality_rules": quality_rules.SQL, "op7_decontamination": decontamination.SQL,
    "op12_collocations": collocations.SQL, "op13_filter_audit": filter_audit.SQL,
}
