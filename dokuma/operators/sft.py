"""Instruction pairs: from sources of any shape to masked, padded training batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dokuma.functions.text import clean

IGNORE = -100
#: Columns of splits that are tokenised already, and chat markers of spoilt pairs; fixed values.
TOKENISED = {"input_ids", "labels", "attention_mask", "token_type_ids", "position_ids"}
MARKERS = ["<s>[INST]", "[/INST]", "</s>"]


def normalise(rows: DataFrame, source: Column, instruction: str = "instruction", given: str | None = "input", output: str = "output") -> DataFrame:
    """(instruction, input, output, source) of a source with columns of its own names; missing input is ''."""
    return rows.select(clean(F.col(instruction)).alias("instruction"), (clean(F.col(given)) if given else F.lit("")).alias("input"), clean(F.col(output)).alias("output"), source.alias("source"))


def union(sources: list[DataFrame]) -> DataFrame:
    """All sources, each with its place in the list as ``source_rank``; tokenised ones are left out."""
    usable = [s for s in sources if not TOKENISED & set(s.columns)]
    return reduce(DataFrame.unionByName, [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(usable)])


def inspect(frame: DataFrame) -> tuple[str, list[str]]:
    """(SKIP_TOKENIZED or RAW_TEXT, the columns that tell) from the schema alone."""
    hit = sorted(TOKENISED & set(frame.columns))
    return ("SKIP_TOKENIZED" if hit else "RAW_TEXT"), hit


def _unmarked(text: Column, markers: list[str]) -> Column:
    return ~reduce(lambda a, b: a | b, [text.contains(m) for m in markers])


def good_mix() -> Column:
    """The wide filter: lengths within 4..4000 and 4..8000, no chat markers."""
    joined = F.concat_ws("\n", "instruction", "input", "output")
    return F.length("instruction").between(4, 4000) & F.length("output").between(4, 8000) & _unmarked(joined, MARKERS)


def good_clean(with_input: Column) -> Column:
    """The narrow filter: lengths within 5..1000 and 10..2500, no chat markers or headings; for rows of
    ``with_input`` the input counts with the instruction."""
    ins = F.when(with_input, F.concat("instruction", F.lit("\n"), "input")).otherwise(F.col("instruction"))
    return F.length(ins).between(5, 1000) & F.length("output").between(10, 2500) & _unmarked(F.concat(ins, F.lit("\n"), "output"), [*MARKERS, "###"])


def keep_first(rows: DataFrame, *order: str) -> DataFrame:
    """Of rows that are the same but for letter case in all three texts the first in ``order``. Only the
    key's digest and the order are compared, so a key of a third of all rows costs one row a task."""
    key = F.sha2(F.concat_ws("\x1f", *[F.lower(c) for c in ("instruction", "input", "output")]), 256)
    cols = rows.columns
    best = rows.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r"))
    return best.select(*[F.col(f"r.{c}").alias(c) for c in cols])


def shuffle_cap(rows: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` rows in an order drawn from the seed: a distributed top-k by digest."""
    drawn = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), "instruction", "input", "output"))
    return rows.orderBy(drawn, *rows.columns).limit(most)


def mask(rows: DataFrame, block: int) -> DataFrame:
    """Adds x and labels to rows of ids (prompt, then answer) and prompt_len: cut to block + 1 ids, the labels
    are x moved on by one, those within the prompt ignored. Rows of under four ids are left out."""
    ids = F.slice("ids", 1, block + 1)
    y = F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))
    hide = F.greatest(F.least(F.col("prompt_len"), F.size(y)) - 1, F.lit(0))
    out = rows.filter(F.size("ids") >= 4).withColumn("x", F.slice(ids, F.lit(1), F.size(ids) - 1))
    return out.withColumn("labels", F.transform(y, lambda v, i: F.when(i < hide, IGNORE).otherwise(v)))


def collate(rows: DataFrame, batch: Column, block: int, pad: int = 0) -> DataFrame:
    """Pads x with ``pad`` and labels with IGNORE to the longest of each batch, ``block`` at most."""
    longest = F.least(F.max(F.size("x")).over(Window.partitionBy("batch")), F.lit(block))
    fill = lambda c, v: F.concat(F.slice(c, F.lit(1), F.col("longest")), F.array_repeat(F.lit(v), F.greatest(F.col("longest") - F.size(c), F.lit(0))))
    out = rows.withColumn("batch", batch).withColumn("longest", longest)
    return out.withColumn("x", fill("x", pad)).withColumn("labels", fill("labels", IGNORE)).drop("longest")


def answer_tokens(labels: str = "labels") -> Column:
    return F.size(F.filter(labels, lambda v: v != IGNORE))
