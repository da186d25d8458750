"""The corpus pipeline: five stages, each over all that its predecessor kept.

1. quality classifier: documents that the language model rejects go;
2. n-gram Jaccard join (five words, 0.8): of each group of near copies the document of the smallest id stays;
3. benchmark decontamination: documents that the test set contaminates go;
4. secret scan: secrets are masked in the texts;
5. SentencePiece: texts become token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from harrow.llm import decontamination, quality_model, secret_scan, sentence_pieces, similarity_join
from harrow.session import shared_dir, table

PIECES, RANKS = "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similarity_join.keep_first(docs, size=5, percent=80)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, public_tokenizers.path(RANKS))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(docs, public_tokenizers.path(PIECES))


STAGES = [("quality", quality), ("near copies", near_copies), ("contamination", contamination), ("secrets", secrets), ("pieces", pieces)]

#: The language model and the tokenizer have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each one's result written to the shared folder and read again."""
    docs, at = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{at}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
