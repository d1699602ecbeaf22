"""Text, JSON-lines and token-shard files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window
from pyspark.taskcontext import TaskContext

#: Types of ids in shards, little-endian.
ID_TYPES = {"uint16": "<u2", "uint32": "<u4"}


def parse_lines(lines: DataFrame, column: str, key: str = "text") -> DataFrame:
    """Adds ``text``: the string under ``key`` of each JSON line; null where the line is no JSON object."""
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("_bad", T.StringType())])
    parsed = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.withColumn("_p", parsed).withColumn("text", F.when(F.col(column).rlike(r"^\s*\{") & F.col("_p._bad").isNull(), F.col("_p").getField(key))).drop("_p")


def scan_jsonl(spark: SparkSession, path: str, key: str = "text", keep: Column | None = None) -> DataFrame:
    """(text) of JSON-lines files, split by bytes as Spark splits text, so no line is lost or read twice."""
    text = parse_lines(spark.read.text(path), "value", key).filter("text is not null").select("text")
    return text.filter(keep) if keep is not None else text


def scan_errors(lines: DataFrame, column: str, worker: Column, key: str = "text", least: int = 50) -> DataFrame:
    """(worker, lines, json_errors, short, kept): what a run reads of JSON lines. An error is a line that is no
    JSON object, null and empty ones included; short is an object without a text of ``least`` characters."""
    parsed = parse_lines(lines.withColumn("_own", F.col(column)), column, key)
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("_bad", T.StringType())])
    whole = F.from_json("_own", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    bad = ~F.coalesce(F.col("_own").rlike(r"^\s*\{") & whole["_bad"].isNull(), F.lit(False))
    kept = F.coalesce(F.length("text") >= least, F.lit(False))
    return parsed.withColumn("worker", worker).groupBy("worker").agg(F.count("*").alias("lines"), F.count_if(bad).alias("json_errors"), F.count_if(~bad & ~kept).alias("short"), F.count_if(kept).alias("kept"))


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One object a line, letters unescaped."""
    rows.write.json(path)


def read_instructions(spark: SparkSession, path: str) -> DataFrame:
    """(instruction, input, output, source); missing fields are ''; blank lines are left out."""
    fields = ["instruction", "input", "output", "source"]
    rows = spark.read.schema(", ".join(f"{f} string" for f in fields)).json(path)
    return rows.filter(F.coalesce(*fields).isNotNull()).select(*[F.coalesce(f, F.lit("")).alias(f) for f in fields])


def write_shard(docs: DataFrame, path: str, kind: str = "uint16") -> None:
    """Writes ids as flat little-endian integers of the type ``kind`` (see ``encode.narrow``): rows (part, chunk, n,
    data), the range partitions of documents in the order of doc_id and the runs of ids within each. An id
    that the type cannot hold is an error."""
    code, most = ID_TYPES[kind], np.iinfo(ID_TYPES[kind]).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk = TaskContext.get().partitionId(), 0
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(False)
            if len(flat):
                if flat.min() < 0 or flat.max() > most:
                    raise OverflowError(f"id {flat.max() if flat.max() > most else flat.min()} does not fit {kind}")
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([len(flat)], pa.int64()), pa.array([flat.astype(code).tobytes()], pa.binary())], ["part", "chunk", "n", "data"])
                chunk += 1

    ordered = docs.filter("ids is not null").select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, "part int, chunk int, n bigint, data binary").write.parquet(path)


def shard_length(spark: SparkSession, path: str) -> int:
    """The number of ids of a shard, from its counts alone."""
    return spark.read.parquet(path).agg(F.sum("n").alias("n")).first().n or 0


def read_shard(spark: SparkSession, path: str, kind: str = "uint16", least: int = 0) -> DataFrame:
    """(place, id): the ids of a shard as the one sequence that its parts make in order, ``place`` from 0. A shard of fewer
    than ``least`` ids is an error. Only the counts, a row a run of ids, are ordered."""
    code = ID_TYPES[kind]
    rows = spark.read.parquet(path)
    if least and shard_length(spark, path) < least:
        raise ValueError(f"a shard of fewer than {least} ids: {path}")
    before, sums = 0, []
    for r in rows.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # one row a part
        sums.append((r.part, before))
        before += r.n
    offsets = F.broadcast(spark.createDataFrame(sums, "part int, before bigint"))
    run_before = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.select("part", "chunk", "n").withColumn("run", run_before).join(offsets, "part").select("part", "chunk", (F.col("before") + F.col("run")).alias("begin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(data, code).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(begin, begin + len(ids))), pa.array(ids)], ["place", "id"])

    return rows.select("part", "chunk", "data").join(placed, ["part", "chunk"]).select("begin", "data").mapInArrow(run, "place bigint, id bigint")


def read_prompt(spark: SparkSession, prompt: str | None = None, path: str | None = None) -> str:
    """The prompt of a file if one is named, else the one given; an error if there is neither."""
    if path:
        return spark.read.text(path, wholetext=True).first().value
    if prompt:
        return prompt
    raise ValueError("a prompt or a file is needed")


def write_meta(one_row: DataFrame, path: str) -> None:
    """The metadata of a run as JSON, one object."""
    one_row.coalesce(1).write.json(path)


def run_config(spark: SparkSession, settings: dict, path: str) -> None:
    """The settings of a run as one JSON object, keys in order."""
    spark.createDataFrame([(json.dumps(settings, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.text(path)


def preview(rows: DataFrame, main: tuple[str, ...] = (), most: int = 2) -> DataFrame:
    """The first rows, in the order the rows have, with every column as text, cut at 300 signs for the main columns and 200 for others."""
    cut = [F.substring(F.col(c).cast("string"), 1, 300 if c in main else 200).alias(c) for c in rows.columns]
    return rows.limit(most).select(*cut)
