"""From token rows to ids, splits, shards and blocks, and back to text.

Documents stay arrays: places are worked out on rows of (doc_id, size), and only then are
the arrays cut where blocks begin, so no operator here makes a row of every id but
``flatten``, whose result that is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dokuma.functions.text import typed_token
from dokuma.session import materialise, small_batches

BOS, EOS, UNK, PAD = 1, 2, 3, 0
MIN_IDS, VAL_EVERY = 16, 100
#: Vocabulary sizes up to which ids are written in 16 bits, by either encoder.
NARROW_SEQUENTIAL, NARROW_PARALLEL = 65_535, 65_536
#: Vocabulary rows that may be broadcast for decoding, checked.
MAX_VOCAB = 5_000_000


def long_enough(text: Column, least: int = 50, strict: bool = True) -> Column:
    """The corpus filter: over ``least`` characters (one encoder) or at least as many (the other)."""
    return F.length(text) > least if strict else F.length(text) >= least


def keep_last(vocab: DataFrame) -> DataFrame:
    """(token, id): of tokens that occur twice the highest id."""
    return vocab.filter("token is not null").groupBy("token").agg(F.max("id").alias("id"))


def build_vocab(rows: DataFrame, size: int, skip_space: bool = True) -> DataFrame:
    """(token, id, n): the ``size`` most frequent typed tokens, ties in order, ids from 4.

    The frequent ones are picked by a distributed top-k; only they are numbered.
    """
    typed = rows.filter("token_type <> 'SPACE'") if skip_space else rows
    counts = typed.select(typed_token(F.col("token"), F.col("token_type")).alias("token")).filter("token is not null").groupBy("token").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(size)
    return top.withColumn("id", (F.row_number().over(Window.orderBy(F.desc("n"), "token")) + 3).cast("int"))


def lookup(rows: DataFrame, vocab: DataFrame, keep_space: bool = False, most_broadcast: int = 1_000_000) -> DataFrame:
    """(doc_id, pos, id): the id of each non-empty token, UNK if it has none. The vocabulary is
    broadcast only if it is counted to have at most ``most_broadcast`` rows, else shuffled."""
    rows = rows if keep_space else rows.filter("token_type <> 'SPACE'")
    typed = rows.select("doc_id", "pos", typed_token(F.col("token"), F.col("token_type")).alias("token")).filter("token is not null")
    ids = keep_last(vocab)
    small = vocab.limit(most_broadcast + 1).count() <= most_broadcast
    return typed.join(F.broadcast(ids) if small else ids, "token", "left").select("doc_id", "pos", F.coalesce("id", F.lit(UNK)).alias("id"))


def frame(ids: DataFrame, least: int = MIN_IDS) -> DataFrame:
    """(doc_id, ids): the ids of each document in order between BOS and EOS, at least ``least`` in all."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"])
    return ids.groupBy("doc_id").agg(F.concat(F.array(F.lit(BOS)), in_order, F.array(F.lit(EOS))).alias("ids")).filter(F.size("ids") >= least)


def with_ordinal(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``ordinal``, the place of each row in the order of the given columns, from 0.

    Rows are sorted within range partitions; only one count for each partition meets
    the driver, so no task sees all rows.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialise(ranged, "ordinals").withColumn("_part", F.shiftright("_at", 33))
    joined = ranged.join(_offsets(ranged, "_part", F.count("*")), "_part")
    return joined.withColumn("ordinal", (F.col("before") + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("bigint")).drop("_at", "_part", "before")


def _offsets(rows: DataFrame, part: str, size: Column) -> DataFrame:
    """(part, before): what all partitions before each add up to; one row a partition, so broadcast."""
    sums, before = [], 0
    for r in rows.groupBy(part).agg(size.cast("bigint").alias("n")).orderBy(part).collect():
        sums.append((r[0], before))
        before += r.n or 0
    return F.broadcast(rows.sparkSession.createDataFrame(sums, f"{part} {rows.schema[part].dataType.simpleString()}, before bigint"))


def places(keys: DataFrame, *order: str) -> DataFrame:
    """(order columns, ordinal) of rows that the order tells apart; nothing else is shuffled or written."""
    return with_ordinal(keys.select(*order), *order)


def split_global(docs: DataFrame, every: int = VAL_EVERY) -> DataFrame:
    """Adds ``part``: every ``every``-th kept document in the order of doc_id is val, all others train.
    doc_id is unique; it alone is numbered, and its place is joined back."""
    part = F.when(F.col("ordinal") % every == 0, "val").otherwise("train")
    return docs.join(places(docs, "doc_id").select("doc_id", part.alias("part")), "doc_id")


def first_kept(docs: DataFrame, most: int) -> DataFrame:
    """The first ``most`` documents in the order of doc_id: the stop of an encoding run after so many kept ones."""
    return docs.join(places(docs, "doc_id").filter(F.col("ordinal") < most).select("doc_id"), "doc_id")


def split_by_worker(docs: DataFrame, worker: Column, every: int = VAL_EVERY) -> DataFrame:
    """The same with places counted within each worker's documents: global places in the order of worker
    and document, less the worker's first, which is one row a worker. The worker follows from the doc_id."""
    placed = places(docs.select(worker.alias("worker"), "doc_id"), "worker", "doc_id")
    first = placed.groupBy("worker").agg(F.min("ordinal").alias("first"))
    part = F.when((F.col("ordinal") - F.col("first")) % every == 0, "val").otherwise("train")
    return docs.join(placed.join(F.broadcast(first), "worker").select("doc_id", part.alias("part")), "doc_id")


def sizes(ids: DataFrame) -> DataFrame:
    """(doc_id, n, unk): tokens and unknown tokens of each document, combined before the shuffle."""
    return ids.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("id") == UNK).alias("unk"))


def narrow(vocab_size: Column, most: int = NARROW_SEQUENTIAL) -> Column:
    """The type of written ids: uint16 up to ``most`` entries, which the two encoders put at
    NARROW_SEQUENTIAL and NARROW_PARALLEL, else uint32."""
    return F.when(vocab_size <= most, "uint16").otherwise("uint32")


def counters(of_docs: DataFrame, vocab: DataFrame, least: int = MIN_IDS, every: int = VAL_EVERY, most: int = NARROW_SEQUENTIAL) -> DataFrame:
    """One row of run metadata of documents given as ``sizes``: kept documents, train and val tokens with BOS
    and EOS, vocabulary size, type of the ids, and unknown tokens of all, those of dropped documents included."""
    of_docs = materialise(of_docs, "sizes")
    kept = with_ordinal(of_docs.filter(F.col("n") + 2 >= least).select("doc_id", "n"), "doc_id")
    val = F.col("ordinal") % every == 0
    part = lambda own: F.coalesce(F.sum(F.when(own, F.col("n") + 2)), F.lit(0))
    of_kept = kept.agg(F.count("*").alias("docs"), part(~val).alias("train_tokens"), part(val).alias("val_tokens"))
    of_all = of_docs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_tokens"), F.coalesce(F.sum("unk"), F.lit(0)).alias("unk_count"))
    size = keep_last(vocab).agg(F.count("*").alias("vocab_size"))
    one = of_kept.crossJoin(of_all).crossJoin(size)  # one row each
    return one.withColumn("dtype", narrow(F.col("vocab_size"), most)).withColumn("unk_ratio", F.col("unk_count") / F.greatest("total_tokens", F.lit(1)))


def worker_counters(of_docs: DataFrame, worker: Column, least: int = MIN_IDS, every: int = VAL_EVERY) -> DataFrame:
    """(worker, docs, kept, tokens, unk_tokens, train_ids, val_ids) of documents given as ``sizes``: the totals
    of each worker of a parallel run, whose split counts its own kept documents."""
    of_docs = materialise(of_docs.withColumn("worker", worker), "worker-sizes")
    kept = split_by_worker(of_docs.filter(F.col("n") + 2 >= least), F.col("worker"), every)
    part = lambda name: F.coalesce(F.sum(F.when(F.col("part") == name, F.col("n") + 2)), F.lit(0))
    of_kept = kept.groupBy("worker").agg(F.count("*").alias("kept"), part("train").alias("train_ids"), part("val").alias("val_ids"))
    of_all = of_docs.groupBy("worker").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"), F.sum("unk").alias("unk_tokens"))
    return of_all.join(of_kept, "worker", "left").na.fill(0, ["kept", "train_ids", "val_ids"])


def begins(docs: DataFrame) -> DataFrame:
    """(doc_id, begin): where each document begins in the sequence of all ids in the order of doc_id. Worked
    out on (doc_id, size) rows: one sum for each range partition, and a running sum within it."""
    ranged = docs.select("doc_id", F.size("ids").alias("size")).repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, "sequence")
    run = F.sum("size").over(Window.partitionBy("part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1))
    running = ranged.withColumn("run", F.coalesce(run, F.lit(0))).join(_offsets(ranged, "part", F.sum("size")), "part")
    return running.select("doc_id", (F.col("before") + F.col("run")).cast("bigint").alias("begin"))


def flatten(docs: DataFrame) -> DataFrame:
    """(place, id): all ids of all documents in the order of doc_id as one sequence, ``place`` from 0. doc_id is unique."""
    placed = docs.select("doc_id", "ids").join(begins(docs), "doc_id")
    return placed.select("begin", F.posexplode("ids").alias("i", "id")).select((F.col("begin") + F.col("i")).cast("bigint").alias("place"), "id")


def _cells(docs: DataFrame, width: int, beyond: int) -> DataFrame:
    """(cell, begin, own): the pieces of each document's array that lie in places cell * width to
    (cell + 1) * width + beyond - 1; ``begin`` is the place of a piece's first id."""
    placed = docs.filter(F.size("ids") > 0).select("doc_id", "ids").join(begins(docs), "doc_id")
    end = F.col("begin") + F.size("ids")
    first = F.greatest(F.floor((F.col("begin") - beyond) / width), F.lit(0))
    listed = placed.select("begin", "ids", end.alias("end"), F.explode(F.sequence(first, F.floor((end - 1) / width))).alias("cell"))
    low, high = F.greatest("begin", F.col("cell") * width), F.least("end", (F.col("cell") + 1) * width + beyond)
    piece = F.slice("ids", (low - F.col("begin") + 1).cast("int"), (high - low).cast("int"))
    return listed.filter(high > low).select("cell", low.alias("begin"), piece.alias("own"))


def _in_order(begin: str = "begin", own: str = "own") -> Column:
    return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(begin, own))), lambda p: p[own]))


def pack(docs: DataFrame, block: int) -> DataFrame:
    """(block_id, x, y): full blocks of ``block`` ids of the sequence and the same moved on by one. Documents are
    cut where blocks begin, so a block is put together of a few pieces, each with the one id after it."""
    whole = _cells(docs, block, 1).groupBy(F.col("cell").alias("block_id")).agg(_in_order().alias("ids")).filter(F.size("ids") == block + 1)
    return whole.select("block_id", F.slice("ids", 1, block).alias("x"), F.slice("ids", 2, block).alias("y"))


def draw_starts(spark: SparkSession, draws: int, length: int, block: int, seed: int = 42) -> DataFrame:
    """(draw, start): places drawn evenly from those at which a block and the id after it fit, by the digest
    of seed and draw. A sequence that is too short for any is an error."""
    most = length - block - 1
    if most <= 0:
        raise ValueError(f"a sequence of {length} ids is too short for blocks of {block}")
    number = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), "id")), 1, 15), 16, 10).cast("bigint")
    return spark.range(draws).select(F.col("id").alias("draw"), (number % most).alias("start"))


def blocks_at(docs: DataFrame, starts: DataFrame, block: int) -> DataFrame:
    """(start, x, y): the blocks that begin at given places, met by equality on the cell (a block
    touches two at most), not by a range join. Columns of ``starts`` but start are left out; a place drawn twice is one row."""
    cells = starts.select("start").distinct().select("start", F.explode(F.array(F.floor(F.col("start") / (block + 1)), F.floor(F.col("start") / (block + 1)) + 1)).alias("cell"))
    met = cells.join(_cells(docs, block + 1, 0), "cell")
    low, high = F.greatest("begin", "start"), F.least(F.col("begin") + F.size("own"), F.col("start") + block + 1)
    cut = met.filter(high > low).select("start", low.alias("at"), F.slice("own", (low - F.col("begin") + 1).cast("int"), (high - low).cast("int")).alias("own"))
    whole = cut.groupBy("start").agg(_in_order("at").alias("ids")).filter(F.size("ids") == block + 1)
    return whole.select("start", F.slice("ids", 1, block).alias("x"), F.slice("ids", 2, block).alias("y"))


_TYPED = re.compile(r"<([^>]*)>(.*)", re.S)
_SILENT = {"<pad>", "<bos>", "<eos>"}


class _Pieces:
    """What each id adds to a text, as arrays over vocabulary rows; the last row is that of unknown ids."""

    def __init__(self, vocab: list[tuple[int, str]]):
        rows = sorted(dict(sorted(vocab)).items())  # of tokens with one id the greatest
        self.ids = np.array([i for i, _ in rows], np.int64)
        typed = [t for _, t in rows] + ["<unk>"]
        parts = [m.groups() if (m := _TYPED.fullmatch(t)) else ("UNK", t) for t in typed]
        self.silent = np.array([t in _SILENT for t in typed])
        self.glued = np.array([k in ("SUFFIX", "PUNCT") for k, _ in parts])
        self.opens = np.array([s[-1:] in (" ", "\n", "'", "’", "(", "[", "{", "/") and s != "" for _, s in parts])
        self.text = pa.array([s for _, s in parts] + [" " + s for _, s in parts])

    def rows(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.zeros(len(ids), np.int64)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, len(self.ids))


def decode(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, text): special tokens left out, suffixes and punctuation put on, all else parted by
    a blank unless an opening sign, an apostrophe, a slash or white space is before it. A null or empty array
    gives ''. One pass over Arrow arrays with the vocabulary, of at most MAX_VOCAB rows, broadcast."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = vocab.filter("id is not null and token is not null").select(F.col("id").cast("bigint").alias("id"), "token").limit(MAX_VOCAB + 1).collect()
    if len(rows) > MAX_VOCAB:
        raise ValueError(f"a vocabulary of more than {MAX_VOCAB} rows")
    held = spark.sparkContext.broadcast(_Pieces([(r.id, r.token) for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        n = len(p.silent)
        for batch in batches:
            lists = batch.column(1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(False)
            doc = np.repeat(np.arange(len(size)), size)
            at = p.rows(pc.fill_null(lists.flatten(), -1).to_numpy(False).astype(np.int64))
            keep = ~p.silent[at]
            doc, at = doc[keep], at[keep]
            first = np.ones(len(at), bool)
            first[1:] = doc[1:] != doc[:-1]
            free = first | p.glued[at]
            free[1:] |= p.opens[at[:-1]] & ~first[1:]
            pieces = p.text.take(pa.array(np.where(free, at, at + n)))
            ends = np.searchsorted(doc, np.arange(len(size) + 1)).astype(np.int32)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), pieces), "")
            yield pa.RecordBatch.from_arrays([batch.column(0), text], ["doc_id", "text"])

    return docs.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
