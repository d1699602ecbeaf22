"""The tokenizer and the text functions under names that SQL can call."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dokuma.functions.lexicon import Lexicon
from dokuma.operators.tokenizer import FIELDS, TOKEN, Tokenizer


def register(spark: SparkSession, lex: Lexicon | None = None) -> None:
    """Registers the table function ``tokenize_text(text)``, one row for each token, and the function
    ``token_types(text)``, the array of its token types; a null text has no tokens."""
    held = lex or Lexicon()
    cache: dict = {}  # a worker's tokenizer with its memo
    columns = ", ".join(f"{f} {TOKEN[f].dataType.simpleString()}" for f in FIELDS)

    class TokenizeText:
        def __init__(self):
            self.tokenizer = Tokenizer(held)

        def eval(self, text: str):
            yield from self.tokenizer.rows(text)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def token_types(texts: pd.Series) -> pd.Series:
        if "t" not in cache:
            cache["t"] = Tokenizer(held)
        tokenizer = cache["t"]
        return texts.map(lambda t: [row[1] for row in tokenizer.rows(t)])

    spark.udtf.register("tokenize_text", F.udtf(TokenizeText, returnType=columns))
    spark.udf.register("token_types", token_types)
