"""Annotations of token rows (doc_id, pos, token, token_type, ...) as plain columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dokuma.functions import tables
from dokuma.functions.text import as_map
from dokuma.operators.spans import NUMBER


def _low() -> Column:
    return F.lower(F.trim("token"))


def delivered_once(rows: DataFrame) -> DataFrame:
    """One row for each (doc_id, pos): of rows delivered twice the later, ties by token and type."""
    last = rows.groupBy("doc_id", "pos").agg(F.max(F.struct("loaded_at", "token", "token_type")).alias("r"))
    return last.select("doc_id", "pos", "r.token", "r.token_type")


def reclassify(rows: DataFrame) -> DataFrame:
    """Roots and foreign words that are numbers, units, Roman numerals or month names get their
    type and a flag (num, unit, roman, month); all other rows keep their type with a null flag."""
    word = F.col("token_type").isin("ROOT", "FOREIGN")
    flag = (
        F.when(word & F.trim("token").rlike(rf"^(?:{NUMBER})$"), "num")
        .when(word & _low().isin(tables.UNITS), "unit")
        .when(word & _low().isin(tables.ROMAN), "roman")
        .when(word & _low().isin(tables.MONTHS), "month")
    )
    kind = F.when(flag.isin("num", "roman"), "NUM").when(flag == "unit", "UNIT").when(flag == "month", "ROOT").otherwise(F.col("token_type"))
    return rows.withColumn("flag", flag).withColumn("token_type", kind)


def canonical(rows: DataFrame) -> DataFrame:
    """Adds the morpheme of suffixes; null for all else."""
    return rows.withColumn("canonical", F.when(F.col("token_type") == "SUFFIX", F.element_at(as_map(tables.MORPHEMES), _low())))


def compounds(rows: DataFrame) -> DataFrame:
    """Adds the parts of roots that are known compounds; null for all else."""
    parts = F.element_at(as_map({k: "+".join(v) for k, v in tables.COMPOUNDS.items()}), _low())
    return rows.withColumn("parts", F.when((F.col("token_type") == "ROOT") & ~F.trim("token").startswith("<"), F.split(parts, r"\+")))


def acronyms(rows: DataFrame, caps: Column) -> DataFrame:
    """Adds the expansion of known acronyms; roots for which ``caps`` holds become ACRONYM if known."""
    full = F.element_at(as_map(tables.ACRONYMS), F.upper(F.trim("token")))
    own = (F.col("token_type") == "ACRONYM") | ((F.col("token_type") == "ROOT") & caps)
    out = rows.withColumn("expansion", F.when(own, full))
    return out.withColumn("token_type", F.when(F.col("expansion").isNotNull(), "ACRONYM").otherwise(F.col("token_type")))


def morph_pos(rows: DataFrame) -> DataFrame:
    """Place of each token in its word: suffixes count up from the last token that is none, blanks
    aside, and all others have 0. One sort by document gives both running sums."""
    doc = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.col("token_type")
    starts = F.sum(F.when(kind.isin("SUFFIX", "SPACE"), 0).otherwise(1)).over(doc)
    word = Window.partitionBy("doc_id", "word").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum(F.when(kind == "SUFFIX", 1).otherwise(0)).over(word)
    return rows.withColumn("word", starts).withColumn("morph_pos", F.when(kind == "SUFFIX", run).otherwise(0).cast("int")).drop("word")


def stats(rows: DataFrame, special: list[str]) -> DataFrame:
    """Per document the counts by class of token and the shares of known tokens and of words, in per cent."""
    n = lambda *kinds: F.count_if(F.col("token_type").isin(*kinds))
    base = rows.groupBy("doc_id").agg(
        F.count("*").alias("total"), n("ROOT").alias("roots"), n("SUFFIX").alias("suffixes"), n("FOREIGN").alias("foreign_words"), n("PUNCT").alias("punct"), n(*special).alias("special"),
        F.count_if(F.col("token_type").isin("ROOT", "SUFFIX", "FOREIGN") & ~F.trim("token").startswith("<")).alias("pure"),
    )
    known = F.col("roots") + F.col("suffixes") + F.col("foreign_words") + F.col("punct") + F.col("special")
    return base.withColumn("tr_pct", F.round(known / F.col("total") * 100, 2)).withColumn("pure_pct", F.round(F.col("pure") / F.col("total") * 100, 2)).drop("pure")
