"""Filling blocks of fixed capacity with whole items: conflict-constrained best fit.

Items of a kind are spread by hash over slices of about ``SLICE_ROWS`` items; each slice
is packed on its own, texts with copies first, then the longest item first. Open blocks are kept in order of their
residual space and carry two bitmaps, of the sources and of the duplicate clusters
they hold. An item goes to the tightest block it fits into that is compatible: no block
takes two items of one duplicate cluster (same text), nor of two sources named as a
conflicting pair. The successor search walks on through larger residuals until it finds
one, and else opens a block. The unused space a slice leaves is at most its last few
blocks, one part in thousands of a slice.

An item longer than the capacity is cut into pieces of exactly one block, which fill
their blocks, and a rest that is packed as an item.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dokuma.session import materialise
from dokuma.sources.tables import table

SLICE_ROWS = 50_000
_OUT = "item_kind string, item_id bigint, piece int, pieces int, begin bigint, length bigint, block string, cut boolean"


class Shelf:
    """Open blocks by residual space. Residuals are whole numbers up to the capacity,
    so their order is a bit set: the successor of r is its lowest set bit from r on."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.some = 0  # bit r: there is a block with residual r
        self.clusters: list[int] = []
        self.sources: list[int] = []

    def successors(self, length: int) -> Iterator[int]:
        """Residuals of at least length that some block has, tightest first."""
        rest = self.some >> length << length
        while rest:
            low = rest & -rest
            yield low.bit_length() - 1
            rest ^= low

    def put(self, length: int, cluster: int, source: int, against: int, copies: int = 1) -> list[int]:
        """The blocks for so many items of one length, cluster and source; cluster and
        source are one-bit masks, against the mask of the sources they must not meet.

        One walk serves all copies: a block that cannot take the first cannot take the
        others, so a cluster with a third of all items still costs one pass.
        """
        got: list[int] = []
        moved: list[tuple[int, int]] = []
        for r in self.successors(length):
            here, stay = self.at[r], []
            while here and len(got) < copies:
                b = here.pop()
                if self.clusters[b] & cluster or self.sources[b] & against:
                    stay.append(b)
                    continue
                got.append(b)
                if cluster or r - length < length:
                    moved.append((b, r - length))
                else:  # it may take a further item of this kind at once
                    here_again = r - length
                    while here_again >= length and len(got) < copies:
                        got.append(b)
                        here_again -= length
                    moved.append((b, here_again))
            here.extend(reversed(stay))
            if not here:
                self.some &= ~(1 << r)
            if len(got) == copies:
                break
        for b, residual in moved:
            self._keep(b, residual, cluster, source)
        while len(got) < copies:
            self.clusters.append(0)
            self.sources.append(0)
            b, residual = len(self.clusters) - 1, self.capacity
            while residual >= length and len(got) < copies:
                got.append(b)
                residual -= length
                if cluster or not length:
                    break
            self._keep(b, residual, cluster, source)
        return got

    def _keep(self, b: int, residual: int, cluster: int, source: int) -> None:
        self.clusters[b] |= cluster
        self.sources[b] |= source
        if residual:  # a full block takes nothing more
            self.at[residual].append(b)
            self.some |= 1 << residual


def pack_slice(ids: Iterable[int], lengths: Iterable[int], clusters: Iterable[int], sources: Iterable, capacity: int, conflicts: dict | None = None) -> list[tuple[int, int, int, int, int, int]]:
    """(index, piece, pieces, begin, length, block) of every piece of a slice's items.

    Only clusters that occur twice or more in the slice need a bit. They are placed first, the
    largest before, as they are the hardest to place: left to the end, the copies of a short
    text would each open a block. All others follow, longest first. Ties of length are
    packed in the order of their ids, those of one cluster and source together.
    """
    lengths, ids, clusters, sources = list(lengths), list(ids), list(clusters), list(sources)
    seen: dict = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    bit = {c: 1 << k for k, c in enumerate(c for c, n in seen.items() if n > 1)}
    copies = {bit[c]: n for c, n in seen.items() if n > 1}
    source_bit = {s: 1 << k for k, s in enumerate(dict.fromkeys(sources))}
    against = {s: sum(source_bit[o] for o in (conflicts or {}).get(s, ()) if o in source_bit) for s in source_bit}
    shelf, out, full = Shelf(capacity), [], 0
    rests = []
    for i, n in enumerate(lengths):
        whole = n // capacity if n > capacity else 0
        pieces = whole + (n > whole * capacity or n == 0)
        for p in range(whole):
            full -= 1
            out.append((i, p, pieces, p * capacity, capacity, full))
        if pieces > whole:
            rests.append((n - whole * capacity, i, whole, pieces))
    same: dict = {}
    for n, i, p, pieces in sorted(rests, key=lambda x: (-x[0], ids[x[1]])):
        same.setdefault((-n, bit.get(clusters[i], 0), sources[i]), []).append((i, p, pieces))
    for (n, cluster, s), own in sorted(same.items(), key=lambda kv: (-copies.get(kv[0][1], 0), kv[0][0])):
        for (i, p, pieces), block in zip(own, shelf.put(-n, cluster, source_bit[s], against[s], len(own)), strict=True):
            out.append((i, p, pieces, lengths[i] + n, -n, block))
    return out


def items(spark: SparkSession, folder: str) -> DataFrame:
    """(item_kind, item_id, length, cluster, source): texts and outputs that are not
    null. Rows of sft_examples delivered twice are one item. Only lengths and digests
    leave the scan, never the texts."""
    docs = table(spark, folder, "documents").filter("text is not null")
    docs = docs.select(F.lit("text").alias("item_kind"), F.col("doc_id").alias("item_id"), F.length("text").alias("length"), F.xxhash64("text").alias("cluster"), "source")
    sft = table(spark, folder, "sft_examples").filter("output is not null")
    sft = sft.select(F.lit("output").alias("item_kind"), F.col("example_id").alias("item_id"), F.length("output").alias("length"), F.xxhash64("output").alias("cluster"), "source").dropDuplicates(["item_id"])
    return docs.unionByName(sft)


def pack(things: DataFrame, limits: DataFrame, slice_rows: int = SLICE_ROWS, conflicts: dict[str, list[str]] | None = None) -> DataFrame:
    """Every piece of every item with its block, as ``item_kind, item_id, piece, pieces,
    begin, length, block, cut``.

    things: item_kind, item_id, length, cluster, source; null ids and lengths are no items, a
    null cluster is a text of its own, an
    empty text is an item of length 0; kinds without a limit are left out. limits: item_kind,
    capacity over 0, one row a kind (the largest if there are more). conflicts: source ->
    sources it must not share a block with.
    """
    things = things.filter("item_id is not null and item_kind is not null").select("item_kind", "item_id", "length", F.coalesce("cluster", F.xxhash64("item_id", F.lit("own"))).alias("cluster"), "source")
    limits = limits.filter("capacity > 0").groupBy("item_kind").agg(F.max("capacity").alias("capacity"))
    things = things.filter("length is not null")
    slices = {r.item_kind: max(1, -(-r.n // slice_rows)) for r in things.groupBy("item_kind").agg(F.count("*").alias("n")).collect()}  # one row a kind
    if not slices:
        slices = {"": 1}
    of_kind = F.element_at(F.create_map(*[F.lit(x) for kv in slices.items() for x in kv]), F.col("item_kind"))
    sliced = things.join(F.broadcast(limits), "item_kind").withColumn("slice", F.pmod(F.xxhash64("item_id"), of_kind))
    rules: dict[str, list[str]] = {}
    for a, others in (conflicts or {}).items():
        for b in others:
            rules.setdefault(a, []).append(b)
            rules.setdefault(b, []).append(a)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kind, part = key
        capacity = int(pdf["capacity"].iloc[0])
        got = pack_slice(pdf["item_id"].tolist(), pdf["length"].tolist(), pdf["cluster"].tolist(), pdf["source"].tolist(), capacity, rules)
        i, piece, pieces, begin, length, block = (np.array(x) for x in zip(*got, strict=True))
        name = np.array([f"{kind}-{part}-{b}" if b >= 0 else f"{kind}-{part}-w{-b}" for b in block.tolist()], object)
        return pd.DataFrame({"item_kind": kind, "item_id": pdf["item_id"].to_numpy()[i], "piece": piece, "pieces": pieces, "begin": begin, "length": length, "block": name, "cut": pieces > 1})

    cols = sliced.select("item_kind", "item_id", "length", "cluster", "source", "capacity", "slice")
    return cols.groupBy("item_kind", "slice").applyInPandas(run, _OUT)


def p2_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Per kind the blocks when no block may hold two sources that follow each other in the order of their names
    (those of the target table), and the blocks that do, of which there are none."""
    names = sorted(r.source for r in table(spark, folder, "mix_targets").filter("source is not null").select("source").distinct().collect())
    rules = {a: [b] for a, b in zip(names, names[1:])}
    things = materialise(items(spark, folder), "items")
    placed = pack(things, table(spark, folder, "pack_limits"), conflicts=rules).join(things.select("item_kind", "item_id", "source"), ["item_kind", "item_id"])
    held = placed.groupBy("item_kind", "block").agg(F.collect_set("source").alias("sources"), F.sum("length").alias("chars"))
    clash = F.lit(False)
    for a, b in zip(names, names[1:]):
        clash = clash | (F.array_contains("sources", a) & F.array_contains("sources", b))
    return held.groupBy("item_kind").agg(F.count("*").alias("blocks"), F.sum("chars").alias("chars"), F.count_if(clash).alias("clashes"))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return pack(items(spark, folder), table(spark, folder, "pack_limits"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The items that the packing had to cut: the first piece of each."""
    return _packed(spark, folder).filter("cut and piece = 0").select("item_kind", "item_id")


def p2_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Per kind the blocks, the characters in them and the unused share."""
    per_kind = _packed(spark, folder).groupBy("item_kind").agg(F.count_distinct("block").alias("blocks"), F.sum("length").alias("chars"), F.count_distinct("item_id").alias("items"))
    return per_kind.join(F.broadcast(table(spark, folder, "pack_limits")), "item_kind").select("item_kind", "items", "blocks", "chars", (1 - F.col("chars") / (F.col("blocks") * F.col("capacity"))).alias("unused_share"))
