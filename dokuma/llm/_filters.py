"""Bit filters over 64-bit hashes, of a size that their counted number asks for.

An entry sets three bits, all in one row of the filter: bits 16 on of the entry tell the row, and
its 16-bit pieces from bits 0, 32 and 48 on the bits, so that one look at one row answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dokuma.session import materialise

#: Bits for each entry, and bits of a filter at least and at most (64 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 22, 1 << 29
#: Entries beyond which no filter is made.
MOST_ENTRIES = MOST_BITS // 4
#: Words of 64 bits in one row of a filter.
ROW_WORDS = 1024
ROW_BITS = 64 * ROW_WORDS
#: Where the pieces of an entry begin that tell its bits.
SHIFTS = (0, 32, 48)


class BitFilter:
    """Tells entries that are surely not among those of a (written) column ``entry`` from those that may be.

    It is held as rows (row, words) of ROW_WORDS words, made in tasks; for more than ``most_entries`` entries none
    is made, and every entry may be among them.
    """

    def __init__(self, entries: DataFrame, most_entries: int = MOST_ENTRIES):
        n = entries.count()
        self.bits = min(max(LEAST_BITS, 1 << max(n * BITS_EACH - 1, 0).bit_length()), MOST_BITS)
        self.rows: DataFrame | None = None
        if n <= most_entries:
            placed = entries.select(self._row(F.col("entry")).alias("row"), "entry").repartition("row")
            self.rows = materialise(placed.mapInArrow(_set_bits, "row int, words array<bigint>"), "bit-filter")

    def _row(self, entry: Column) -> Column:
        return F.shiftrightunsigned(entry, 16).bitwiseAND(self.bits // ROW_BITS - 1).cast("int")

    def mask(self) -> np.ndarray | None:
        """All words, bits / 8 bytes in all, or None."""
        if self.rows is None:
            return None
        mask = np.zeros(self.bits // 64, np.int64)
        for r in self.rows.toLocalIterator():
            mask[r.row * ROW_WORDS : (r.row + 1) * ROW_WORDS] = r.words
        return mask.view(np.uint64)

    def flag(self, rows: DataFrame, entry: Column) -> DataFrame:
        """Adds ``maybe``, by a broadcast of the filter's rows."""
        if self.rows is None:
            return rows.withColumn("maybe", F.lit(True))
        cols = rows.columns
        held = F.broadcast(self.rows.select(F.col("row").alias("_row"), F.col("words").alias("_words")))
        met = rows.withColumn("_entry", entry).withColumn("_row", self._row(F.col("_entry"))).join(held, "_row", "left")
        bit = "(shiftright(_words[cast(shiftright({0}, 6) as int)], cast({0} & 63 as int)) & 1L) = 1"
        all_set = " and ".join(bit.format(f"(shiftrightunsigned(_entry, {k}) & 65535)") for k in SHIFTS)
        return met.select(*cols, F.coalesce(F.expr(f"_words is not null and {all_set}"), F.lit(False)).alias("maybe"))


def maybe(mask: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which of the entries may be among those of a filter's ``mask``."""
    row = (entries >> np.uint64(16) & np.uint64(len(mask) // ROW_WORDS - 1)) * np.uint64(ROW_WORDS)
    at = np.arange(len(entries))
    for k in SHIFTS:
        bit = entries[at] >> np.uint64(k) & np.uint64(ROW_BITS - 1)
        at = at[(mask[(row[at] + (bit >> np.uint64(6))).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)]
    out = np.zeros(len(entries), bool)
    out[at] = True
    return out


def _set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own: dict[int, np.ndarray] = {}
    for batch in batches:
        row, entry = batch.column(0).to_numpy(False), batch.column(1).to_numpy(False).view(np.uint64)
        for r in np.unique(row).tolist():
            bits = own.setdefault(r, np.zeros(ROW_BITS, bool))
            for k in SHIFTS:
                bits[(entry[row == r] >> np.uint64(k) & np.uint64(ROW_BITS - 1)).astype(np.int64)] = True
    for r, bits in own.items():
        words = np.packbits(bits, bitorder="little").view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([words])], ["row", "words"])
