"""Sampling filters and training formulas over relations of logits (seq_id, token_id, logit)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def softmax(logits: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Adds ``p``, the probability of each token within its sequence."""
    seq = Window.partitionBy("seq_id")
    z = F.col("logit") / max(temperature, 1e-6)
    e = logits.withColumn("_e", F.exp(z - F.max(z).over(seq)))
    return e.withColumn("p", F.col("_e") / F.sum("_e").over(seq)).drop("_e")


def top_p(logits: DataFrame, p: float = 0.95) -> DataFrame:
    """Adds ``kept``: the tokens before which less than p of the probability lies, the likeliest always."""
    order = Window.partitionBy("seq_id").orderBy(F.desc("logit"), "token_id").rowsBetween(Window.unboundedPreceding, 0)
    before = F.round(F.sum("p").over(order) - F.col("p"), 9)
    return softmax(logits).withColumn("kept", before <= p)


def repetition_penalty(logits: DataFrame, seen: DataFrame, penalty: float) -> DataFrame:
    """Logits of tokens seen in the sequence are divided by the penalty if positive, else multiplied."""
    known = seen.select("seq_id", "token_id").distinct().withColumn("_seen", F.lit(True))
    v = F.col("logit")
    new = F.when(F.col("_seen"), F.when(v < 0, v * penalty).otherwise(v / penalty)).otherwise(v)
    return logits.join(known, ["seq_id", "token_id"], "left").withColumn("logit", new).drop("_seen")


def banned_ngrams(history: DataFrame, n: int) -> DataFrame:
    """(seq_id, token_id): tokens that would repeat an n-gram of (seq_id, pos, token_id)."""
    seq = Window.partitionBy("seq_id").orderBy("pos")
    gram = history.withColumn("gram", F.array(*[F.lead("token_id", k).over(seq) for k in range(n)]))
    whole = gram.filter(F.col("gram")[n - 1].isNotNull())
    last = history.groupBy("seq_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token_id"))), lambda x: x["token_id"]).alias("all"))
    last = last.filter(F.size("all") + 1 >= n).select("seq_id", (F.slice("all", F.size("all") - (n - 2), F.lit(n - 1)) if n > 1 else F.array().cast("array<int>")).alias("prefix"))
    met = whole.join(last, "seq_id").filter(F.slice("gram", 1, n - 1) == F.col("prefix"))
    return met.select("seq_id", F.col("gram")[n - 1].alias("token_id")).distinct()


def draw(logits: DataFrame, seed: int = 0) -> DataFrame:
    """(seq_id, token_id): one token of each sequence drawn by its probability (Gumbel maximum with hashed noise)."""
    u = (F.pmod(F.xxhash64("seq_id", "token_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / (1 << 52)
    return logits.withColumn("g", F.col("logit") - F.log(-F.log(u))).groupBy("seq_id").agg(F.max_by("token_id", "g").alias("token_id"))


def learning_rate(step: Column, peak: float, warmup: int, steps: int) -> Column:
    """Linear warm-up, then half a cosine down to 0."""
    progress = (step - warmup) / max(1, steps - warmup)
    return F.when(step <= warmup, F.lit(peak) * step / max(1, warmup)).otherwise(peak * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * progress)))


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(20.0)))


def tokens_seen(step: Column, batch: int, accumulate: int, block: int, world: int) -> Column:
    return step * (batch * accumulate * block * world)


def losses(logits: DataFrame, targets: DataFrame, ignore: int = -100) -> DataFrame:
    """(seq_id, target, loss): -log p(target) of each sequence; targets of ``ignore`` do not count."""
    used = targets.filter(F.col("target") != ignore).select("seq_id", "target")
    met = softmax(logits).join(used, "seq_id").filter(F.col("token_id") == F.col("target"))
    return met.select("seq_id", "target", (-F.log("p")).alias("loss"))


def cross_entropy(logits: DataFrame, targets: DataFrame, ignore: int = -100) -> DataFrame:
    """(loss): the mean over sequences of -log p(target)."""
    return losses(logits, targets, ignore).agg(F.avg("loss").alias("loss"))


def state_summary(tensors: DataFrame) -> DataFrame:
    """(dtype, tensors, parameters) of a checkpoint given as (name, dtype, numel)."""
    return tensors.groupBy("dtype").agg(F.count("*").alias("tensors"), F.sum("numel").alias("parameters"))
