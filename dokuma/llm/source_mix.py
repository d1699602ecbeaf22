"""Mixing sources to target shares of the total size by entropy balancing.

Each record gets a rate w, the smallest change (in relative entropy) from one copy
each under which every source's sizes add up to its target. The solution has the
form w = min(cap, exp(lambda_source * x)), x being the record's size over its source's
mean size; the dual is convex and its Hessian is diagonal, as each record counts for
one source only. So the sources are solved side by side, each in a task of its own, by Newton steps
on its (size, count) rows, safeguarded by bisection, since the caps make the dual only piecewise
smooth. A source of t characters has fewer than sqrt(2 t) different sizes, which bounds a task.

Where the dual has no maximum, because even the rates at lambda = infinity miss the target, the source is
short: it cannot reach its share, is reported and gets ``max_repeats`` copies of everything.

The rates are rounded into whole copies, systematically within salted groups; what the groups
miss together is then made up by one copy more or less of some records, so that every other source ends
within one record's size of its target.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dokuma.session import materialise
from dokuma.sources.tables import table

MAX_STEPS = 80
#: Relative miss of a source's target at which Newton stops.
TOLERANCE = 1e-9
#: Bound of lambda within which a maximum is looked for.
MOST = 700.0
#: Records of one rounding group, and groups whose miss one group makes up.
GROUP_ROWS, GROUPS_EACH = 20_000, 1000
_BLANKS = r"(?U)^\s+|\s+$"
_PLAN = "source string, target_share double, max_repeats int, size bigint, records bigint, goal double, lambda double, scale double, short boolean"


def folded(source: Column) -> Column:
    """A source's name without blanks at the ends and letter case; i, ı, I and İ are one letter."""
    return F.lower(F.translate(F.regexp_replace(source, _BLANKS, ""), "İIı", "iii"))


def records(examples: DataFrame) -> DataFrame:
    """(rec_id, source, size): each example_id once, the latest added_at winning; blanks
    around the source and its letter case do not count; a null output has size 0."""
    last = examples.filter("example_id is not null").groupBy("example_id").agg(F.max(F.struct("added_at", "source", F.coalesce(F.length("output"), F.lit(0)).alias("size"))).alias("r"))
    return last.select(F.col("example_id").alias("rec_id"), folded(F.col("r.source")).alias("source"), F.col("r.size").cast("bigint").alias("size"))


def balance(size: np.ndarray, n: np.ndarray, goal: float, cap: float) -> tuple[float, bool]:
    """(lambda, short) of one source with so many records of each size."""
    if float((n * size).sum() * cap) < goal:  # the rates at lambda = infinity
        return 0.0, True
    live = size > 0
    size, n = size[live].astype(float), n[live].astype(float)
    if not len(size) or goal <= 0:
        return 0.0, False
    x = size / ((n * size).sum() / n.sum())
    lam, low, high = 0.0, -MOST, MOST
    for _ in range(MAX_STEPS):
        tilt = np.exp(np.clip(lam * x, -MOST, MOST))
        miss = (n * size * np.minimum(tilt, cap)).sum() - goal
        if abs(miss) <= TOLERANCE * goal:
            break
        low, high = (lam, high) if miss < 0 else (low, lam)
        slope = (n * size * np.where(tilt < cap, tilt * x, 0.0)).sum()
        newton = lam - miss / slope if slope > 0 else np.inf
        lam = newton if low < newton < high else (low + high) / 2
    return float(lam), False


def solve(recs: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, size, records, goal, lambda, scale, short), one row a target source.

    goal: share x total, total being the sizes of all target sources together. Names are compared as ``folded`` has
    them. A source without records has size 0 and is short whenever its goal is over 0. Null sources are no targets.
    """
    want = targets.filter("source is not null").select("source", F.coalesce("target_share", F.lit(0.0)).cast("double").alias("target_share"), F.coalesce("max_repeats", F.lit(0)).cast("int").alias("max_repeats"), folded(F.col("source")).alias("own"))
    by_size = materialise(recs.filter("source is not null").groupBy(F.col("source").alias("own"), "size").agg(F.count("*").alias("n")), "mix-sizes")
    total = by_size.join(want.select("own").distinct(), "own", "left_semi").agg(F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)).alias("t")).first().t
    met = want.withColumn("goal", F.col("target_share") * total).join(by_size, "own", "left")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        size, n = pdf["size"].fillna(0).to_numpy(np.int64), pdf["n"].fillna(0).to_numpy(np.int64)
        first = pdf.iloc[0]
        lam, short = balance(size, n, float(first["goal"]), float(first["max_repeats"]))
        whole, count = int((size * n).sum()), int(n.sum())
        used = int(n[size > 0].sum())
        row = (first["source"], float(first["target_share"]), int(first["max_repeats"]), whole, count, float(first["goal"]), lam, whole / used if used else 1.0, bool(short))
        return pd.DataFrame([row], columns=[c.split()[0] for c in _PLAN.split(", ")])

    return materialise(met.groupBy("source").applyInPandas(run, _PLAN), "mix-plan")


def mix(recs: DataFrame, plan: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(rec_id, source, size, copies): how often each record of a target source is used; source is the target's name.

    Rounding groups are hashed slices of a source of about ``group_rows`` rows, so a
    source with a third of all rows is spread over many tasks.
    """
    cap = F.col("max_repeats").cast("double")
    rate = F.when(F.col("short"), cap).when(F.col("goal") <= 0, 0.0)
    rate = rate.otherwise(F.least(F.exp(F.least(F.col("lambda") * F.col("size") / F.col("scale"), F.lit(MOST))), cap))
    p = plan.select(folded(F.col("source")).alias("own"), "source", "max_repeats", "goal", "lambda", "scale", "short", F.greatest(F.ceil(F.col("records") / group_rows), F.lit(1)).alias("groups"))
    rated = recs.withColumnRenamed("source", "own").join(F.broadcast(p), "own").withColumn("rate", rate).withColumn("slice", F.pmod(F.xxhash64("rec_id"), F.col("groups")))
    order = Window.partitionBy("source", "slice").orderBy("size", "rec_id").rowsBetween(Window.unboundedPreceding, 0)
    whole, part = F.floor("rate"), F.col("rate") - F.floor("rate")
    run = F.sum(part).over(order) + F.pmod(F.xxhash64("source", "slice"), F.lit(1000)) / 1000
    extra = F.floor(F.col("run") + 1e-9) - F.floor(F.col("run") - F.col("part") + 1e-9)
    cols = ["rec_id", "source", "size", "copies", "slice"]
    rounded = rated.withColumn("run", run).withColumn("part", part).withColumn("whole", whole).withColumn("copies", (F.col("whole") + extra).cast("int")).select(*cols)
    rounded = materialise(rounded, "rounded")
    # what all groups of a source miss together is made up by its first ones
    got = rounded.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("got"))
    open_ = plan.filter("not short and goal > 0").join(got, "source").select("source", "max_repeats", (F.col("goal") - F.col("got")).alias("miss"), F.ceil(F.ceil(F.col("records") / group_rows) / GROUPS_EACH).alias("first"))
    met = rounded.join(F.broadcast(open_), "source", "left")
    mends = F.col("slice") < F.col("first")
    step = F.when(F.col("miss") > 0, 1).otherwise(-1)
    may = (F.col("size") > 0) & F.when(F.col("miss") > 0, F.col("copies") < F.col("max_repeats")).otherwise(F.col("copies") > 0)
    some = met.filter(mends)
    upto = F.sum(F.when(may, F.col("size")).otherwise(0)).over(Window.partitionBy("source").orderBy(F.desc("size"), "rec_id").rowsBetween(Window.unboundedPreceding, 0))
    mended = some.withColumn("upto", upto).withColumn("copies", F.when(may & (F.col("upto") <= F.abs("miss")), F.col("copies") + step).otherwise(F.col("copies")))
    return met.filter(~F.coalesce(mends, F.lit(False))).select("rec_id", "source", "size", "copies").unionByName(mended.select("rec_id", "source", "size", "copies"))


def report(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, records, used, size_out, most_copies, short)."""
    got = mixed.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size_out"), F.sum((F.col("copies") > 0).cast("bigint")).alias("used"), F.max("copies").alias("most_copies"))
    joined = plan.select("source", "target_share", "records", "short").join(F.broadcast(got), "source", "left").na.fill(0)
    total = F.sum("size_out").over(Window.partitionBy(F.lit(1)))  # one row a source
    share = F.when(total > 0, F.col("size_out") / total).otherwise(0.0)
    return joined.select("source", "target_share", share.alias("actual_share"), "records", "used", "size_out", "most_copies", "short")


def _solved(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    recs = materialise(records(table(spark, folder, "sft_examples")), "mix-records")
    return recs, solve(recs, table(spark, folder, "mix_targets"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _solved(spark, folder)[1].filter("short").select("source")


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """The shares reached."""
    recs, plan = _solved(spark, folder)
    return report(mix(recs, plan), plan)
