"""Tokenising a stream of documents. The transformation keeps no state, so the stream runs the
batch operators; counts of typed tokens are kept by a windowed aggregation with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dokuma.functions.lexicon import Lexicon
from dokuma.functions.text import typed_token
from dokuma.operators.tokenizer import tokens


def read_documents(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    """Documents of new Parquet files in a folder."""
    return spark.readStream.schema("doc_id bigint, text string, fetched_at timestamp").option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def tokenised(stream: DataFrame, lex: Lexicon | None = None) -> DataFrame:
    """(doc_id, tokens) of a stream of (doc_id, text)."""
    return tokens(stream, lex)


def typed_counts(stream: DataFrame, lateness: str = "1 day", width: str = "1 day") -> DataFrame:
    """(window, token, n) of a stream of token rows (token, token_type, loaded_at); rows later than
    ``lateness`` are dropped by the watermark."""
    typed = stream.withWatermark("loaded_at", lateness).select("loaded_at", typed_token(F.col("token"), F.col("token_type")).alias("token")).filter("token is not null")
    return typed.groupBy(F.window("loaded_at", width), "token").agg(F.count("*").alias("n"))
