"""Records that are the same but for formatting: one record each, with its copies counted.

``keyed`` brings every record to a 256-bit key over the letters and digits of its
fields. ``collapse`` then groups them in a way that no key's size can hurt:

1. partial counts, of hash classes first and then of the keys of heavy classes, find the hot keys
   exactly (more copies than a ``hot_parts``-th of all rows, so there are fewer than
   ``hot_parts`` of them, which is what makes broadcasting them safe);
2. rows of hot keys get a salt and are aggregated per (key, salt), then per key;
3. all other rows are shuffled once, by key.

The representative is the smallest identifier.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dokuma.session import materialise
from dokuma.sources.tables import table

#: A key is hot when it holds more than one part in so many of all rows.
HOT_PARTS = 1024
#: Hash classes of keys in which hot ones are looked for.
CLASSES = 1 << 16
#: Salts over which a hot key's rows are spread.
SALTS = 32
FIELDS = ("instruction", "input", "output")


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def canonical(text: Column) -> Column:
    """Letters and digits in order, in one case, with i, ı, I and İ as one letter.

    Null and blank give ''. Other accents count; decomposed letters are composed
    first (only texts holding combining marks go through Python).
    """
    composed = F.coalesce(_nfc(F.when(text.rlike(r"\p{M}"), text)), text)
    return F.coalesce(F.regexp_replace(F.lower(F.translate(composed, "İIı", "iii")), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def keyed(records: DataFrame, id_col: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(rec_id, key): the identifier, and a digest of all canonical fields; rows without one are no records."""
    parts = [canonical(F.col(f"`{f}`")) for f in fields]
    return records.filter(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("rec_id"), F.unhex(F.sha2(F.concat_ws("\x1f", *parts), 256)).alias("key"))


def hot_keys(keys: DataFrame, hot_parts: int = HOT_PARTS) -> list[bytes]:
    """The keys with more than rows / hot_parts rows, which are fewer than hot_parts.

    Partial counts of CLASSES hash classes of keys, combined before the shuffle, tell in which classes a hot key can
    be; only the keys of these are counted one by one, which is exact, as a hot key makes its class hot.
    """
    klass = F.xxhash64("key").bitwiseAND(CLASSES - 1)
    counts = keys.groupBy(klass.alias("class")).agg(F.count("*").alias("n")).collect()  # CLASSES rows at most
    most = max(sum(r.n for r in counts) / hot_parts, 1)
    heavy = [r["class"] for r in counts if r.n > most]
    if not heavy:
        return []
    some = keys.filter(klass.isin(heavy)).groupBy("key").agg(F.count("*").alias("n"))
    return [bytes(r.key) for r in some.filter(F.col("n") > most).select("key").collect()]


def _rest(keys: DataFrame, hot: list[bytes]) -> DataFrame:
    """Each (rec_id, key) of a key that is not hot once, by the one shuffle by key that all else rests on."""
    rest = keys.filter(~F.col("key").isin(hot)) if hot else keys
    return rest.repartition("key").dropDuplicates(["rec_id", "key"])


def _salted(keys: DataFrame, hot: list[bytes], salts: int) -> DataFrame:
    """(key, kept_id, copies) of the hot keys, in two levels; the salt follows from the identifier, so a repeated one
    counts once."""
    both = [F.min("rec_id").alias("kept_id"), F.count_distinct("rec_id").alias("copies")]
    salted = keys.filter(F.col("key").isin(hot)).withColumn("salt", F.pmod(F.xxhash64("rec_id"), F.lit(salts))).groupBy("key", "salt").agg(*both)
    return salted.groupBy("key").agg(F.min("kept_id").alias("kept_id"), F.sum("copies").alias("copies"))


def collapse(keys: DataFrame, hot: list[bytes] | None = None, salts: int = SALTS) -> DataFrame:
    """(key, kept_id, copies), one row per group of same records.

    keys: (rec_id, key); hot: as ``hot_keys`` gives it. A repeated identifier counts
    once in its group. An empty table gives no rows.
    """
    hot = hot_keys(keys) if hot is None else hot
    one_level = _rest(keys, hot).groupBy("key").agg(F.min("rec_id").alias("kept_id"), F.count("*").alias("copies"))
    return one_level.unionByName(_salted(keys, hot, salts)) if hot else one_level


def copies(keys: DataFrame, hot_parts: int = HOT_PARTS, salts: int = SALTS) -> DataFrame:
    """(kept_id, copy_id): one row for every record but its group's representative.

    Members of hot keys meet their group by a broadcast of fewer than ``hot_parts``
    rows; all others find the smallest identifier beside them after the shuffle by key.
    """
    hot = hot_keys(keys, hot_parts)
    pairs = _rest(keys, hot).select(F.min("rec_id").over(Window.partitionBy("key")).alias("kept_id"), "rec_id")
    if hot:
        groups = _salted(keys, hot, salts)
        pairs = pairs.unionByName(keys.filter(F.col("key").isin(hot)).join(F.broadcast(groups), "key").select("kept_id", "rec_id"))
    return pairs.filter("rec_id <> kept_id").distinct().withColumnRenamed("rec_id", "copy_id")


def all_records(spark: SparkSession, folder: str) -> DataFrame:
    """(rec_id, instruction, input, output) of sft_examples and of the readable
    payloads of sft_raw. A null or broken payload, or one that is no object, is no record."""
    own = table(spark, folder, "sft_examples").select(F.col("example_id").alias("rec_id"), *FIELDS)
    raw = table(spark, folder, "sft_raw").select(F.col("record_id").alias("rec_id"), F.from_json("payload", "struct<instruction:string,input:string,output:string,_bad:string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("p"), "payload")
    raw = raw.filter(F.col("payload").rlike(r"^\s*\{") & F.col("p").isNotNull() & F.col("p._bad").isNull())
    return own.unionByName(raw.select("rec_id", *[F.col(f"p.{f}").alias(f) for f in FIELDS]))


def _keys(spark: SparkSession, folder: str) -> DataFrame:
    return materialise(keyed(all_records(spark, folder), "rec_id"), "record-keys")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return copies(_keys(spark, folder))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every group with its number of copies."""
    return collapse(_keys(spark, folder)).select("kept_id", "copies")
