"""Rows that every operator has to bear: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LONG = " ".join(f"word{i % 997} and{i}" for i in range(20_000))
HARD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, "a"), (4, "one", "en", None), (5, "one", "en", None), (5, "one", "en", None),
    (6, LONG, "en", "b"), (7, LONG + " more", "en", "b"), (8, "漢字 🎉 Ünï çödé ΑΣ", "xx", "b"), (9, "a\x00b\x1cc\x85d", "en", "b"), (10, "x" * 5000, "en", "b"),
    (11, "AKIA" + "A1B2" * 5 + " password = 'abcdefghijkl' deadbeefdeadbeef <|endoftext|>", "en", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, token string, g long, key string, `__n_words` string"


def hard(spark: SparkSession) -> DataFrame:
    """The rows, with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 0, "t", 1, "k", "w") for i, t, lang, s in HARD], SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def texts(spark: SparkSession, sf: str) -> dict:
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
