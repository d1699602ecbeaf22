"""Documents that hold passages of held-out evaluation items.

Texts are compared as streams of folded letters and digits, so case, accents, blanks,
line breaks and punctuation do not matter. A qualifying passage is a run of at least half of
an item's words that a document holds with at most ``CHANGED`` word edits (words changed, lost
or added) a word of the run, as ``passage`` finds it over the whole table.

By the q-gram lemma a passage keeps at least its q-grams but those that the edited words
touch. For each item the least number of counted q-grams that any qualifying passage keeps,
of whatever length from half of the words on, is worked out beforehand (``Index.need``).
Shared q-grams of a document and an item are counted in diagonal bands. Diagonals are
differences of word numbers, so an edit moves a passage by one at most, however long the
word; bands are as wide as twice the item's edit budget and overlap by half, so every passage
lies in one. Bands reaching the least number are verified by a word alignment of that
band. No qualifying passage is lost.

Q-grams that many items share (a common lead-in) are not counted; the items' thresholds
are lowered by them exactly, and an item whose threshold would fall under one gets its
frequent q-grams back. An item of so short words that its q-grams promise nothing even then is
looked for by runs of ``RUN`` words, one of which every qualifying passage holds unedited.

The items are the query side: they are indexed in blocks of bounded size, each
broadcast and held against all documents in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dokuma.llm._codes import SEP, Words, blocks, powers
from dokuma.session import small_batches, spread
from dokuma.sources.tables import table

Q = 12
MIN_WORDS = 10
#: Edited words (changed, lost or added) over the item's words in the passage.
CHANGED = 0.15
#: Words that every passage of at least half of MIN_WORDS words holds unedited in a row: with s words and
#: k = CHANGED * s edits, (s - k) / (k + 1) rounded up, which is least for s = 7.
RUN = 3
#: Items that may share a q-gram for it to be counted.
FREQUENT = 12
#: Letters of the items of one block, which bounds what is broadcast to some 60 MB.
BLOCK_LETTERS = 1_000_000
_BITS = 22


class _Stream:
    """The folded letters of a block of texts, without blanks, with q-gram hashes."""

    def __init__(self, texts: list[str]):
        self.words = w = Words(texts)
        letter = (w.chars != 32) & (w.chars != ord(SEP))
        c = w.chars[letter]
        at = np.cumsum(letter) - letter  # letter index of each character
        self.word_at = at[w.start] if len(w.start) else np.zeros(0, np.int64)
        self.word_len = w.end - w.start
        last = np.searchsorted(w.doc, np.arange(len(texts) + 1))
        self.first = np.concatenate((self.word_at, [len(c)]))[last]  # first letter of each text
        n = len(c) - Q + 1
        if n <= 0:
            self.grams, self.at, self.doc, self.word = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        up, down = powers(len(c) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(c.astype(np.uint64) * up[: len(c)], dtype=np.uint64)))
            h = (sums[Q:] - sums[:-Q]) * down[:n] * np.uint64(0x9FB21C651E98DF25)
        doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        inside = doc[:n] == doc[Q - 1 :]
        self.at = np.flatnonzero(inside)
        self.grams, self.doc = h[self.at], doc[self.at]
        self.word = (np.cumsum(np.bincount(self.word_at, minlength=len(c))) - 1)[self.at]  # index of the word each begins in


class Index:
    """Q-grams of one block of items, and runs of words of those that q-grams cannot tell."""

    def __init__(self, items: list[tuple[int, str]]):
        s = _Stream([t for _, t in items])
        w = s.words
        n = len(items)
        self.ids = [i for i, _ in items]
        self.item_words = [w.hash[w.first[i] : w.first[i + 1]].tolist() for i in range(n)]
        n_words = np.diff(w.first)
        #: Half a band: word edits may move a passage by less.
        self.half = (n_words * CHANGED).astype(np.int64) + 1
        code, inverse = np.unique(s.grams, return_inverse=True)
        pairs = np.unique(inverse.astype(np.int64) * max(n, 1) + s.doc)
        spread = np.bincount(pairs // max(n, 1), minlength=len(code))
        counted = spread[inverse] <= FREQUENT
        bounds = np.searchsorted(s.doc, np.arange(n + 1))
        self.need = np.full(n, 1 << 40)
        by_run = np.zeros(n, bool)
        for i in np.flatnonzero(n_words >= MIN_WORDS):
            own = slice(bounds[i], bounds[i + 1])
            need = self._least(s, i, s.at[own][counted[own]])
            if need < 1:
                counted[own] = True
                need = self._least(s, i, s.at[own])
            by_run[i] = need < 1
            self.need[i] = need
        use = counted & (n_words[s.doc] >= MIN_WORDS) & ~by_run[s.doc]
        self.grams = _Postings(s.grams[use], s.doc[use], s.word[use] - w.first[s.doc[use]])
        h, at = w.shingles(RUN)
        use = by_run[w.doc[at]]
        self.need[by_run] = 1
        self.runs = _Postings(h[use], w.doc[at][use], (at - w.first[w.doc[at]])[use])

    @staticmethod
    def _least(s: _Stream, i: int, at: np.ndarray) -> int:
        """The least number of the q-grams beginning at the given letters that a qualifying passage of item i keeps,
        whatever its length and whichever of its words are edited. An edited word spoils the q-grams that
        begin in it or less than Q letters before it; the longest words are taken to be the edited ones."""
        a, b = s.words.first[i], s.words.first[i + 1]
        n, lo = b - a, s.first[i]
        begin = s.word_at[a:b] - lo
        end = begin + s.word_len[a:b]
        flags = np.zeros(s.first[i + 1] - lo + 1, np.int64)
        flags[at - lo + 1] = 1
        upto = np.cumsum(flags)
        spoilt = np.concatenate(([0], np.cumsum(np.sort(s.word_len[a:b])[::-1] + Q - 1)))
        least = 1 << 40
        for span in range(-(-n // 2), n + 1):
            first = begin[: n - span + 1]
            inside = upto[np.maximum(end[span - 1 :] - Q + 1, first)] - upto[first]
            least = min(least, int(inside.min() - spoilt[int(span * CHANGED)]))
        return least


class _Postings:
    """Where codes occur in the items: (item, word number) in runs by code."""

    def __init__(self, codes: np.ndarray, item: np.ndarray, word: np.ndarray):
        order = np.argsort(codes, kind="stable")
        self.code, self.begin, self.count = np.unique(codes[order], return_index=True, return_counts=True)
        self.item, self.word = item[order], word[order]
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.code >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def meet(self, codes: np.ndarray, doc: np.ndarray, word: np.ndarray, least: int, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, difference of word numbers) of all occurrences of the items' codes, in documents with at least so many."""
        none = np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.bitmap[(codes >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(maybe) or not len(self.code):
            return none, none, none
        g = codes[maybe]
        spot = np.minimum(np.searchsorted(self.code, g), len(self.code) - 1)
        hit = self.code[spot] == g
        maybe, spot = maybe[hit], spot[hit]
        n = self.count[spot]
        keep = np.bincount(doc[maybe], weights=n, minlength=docs)[doc[maybe]] >= least
        maybe, spot, n = maybe[keep], spot[keep], n[keep]
        if not len(maybe):
            return none, none, none
        which = np.repeat(self.begin[spot] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return np.repeat(doc[maybe], n), self.item[which], np.repeat(word[maybe], n) - self.word[which]


def passage(item: list, doc: list, low: int | None = None, high: int | None = None, changed: float = CHANGED) -> tuple[int, int]:
    """(words spanned, words matched) of the longest run of item words that doc holds as
    one running passage with at most that share of them edited, by a local alignment
    in which a changed, lost or added word costs three matches.

    low, high: the diagonals (number of the doc word less that of the item word) that the alignment keeps to,
    high not included. Without them the whole table is computed.
    """
    best = (0, 0)
    none = (0, 0, 0, 0)  # a cell: (score, item word begun at, matched, edits saved)
    row: dict[int, tuple[int, int, int, int]] = {}
    for i, x in enumerate(item, 1):
        lo = 0 if low is None else max(0, i - 1 + low)
        hi = len(doc) if high is None else min(len(doc), i - 1 + high)
        new: dict[int, tuple[int, int, int, int]] = {}
        left = none
        for j in range(lo, hi):
            s, b, m, e = row.get(j - 1, none)
            if x == doc[j]:
                if not s:
                    b, m, e = i - 1, 0, 0
                left = new[j] = (s + 1, b, m + 1, e)
                if (i - b, m + 1) > best and -e <= (i - b) * changed:
                    best = (i - b, m + 1)
                continue
            top = max((s, b, m, e), row.get(j, none), left)
            if top[0] > 3:
                left = new[j] = (top[0] - 3, top[1], top[2], top[3] - 1)
            else:
                left = none
        row = new
    return best


def _scan(index: Index, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, words spanned, words matched) of the texts of a block."""
    s = _Stream(texts)
    w = s.words
    n = len(texts)
    items = max(len(index.ids), 1)
    met = [index.grams.meet(s.grams, s.doc, s.word - w.first[s.doc], index.need.min(), n)]
    if len(index.runs.code):
        h, at = w.shingles(RUN)
        met.append(index.runs.meet(h, w.doc[at], at - w.first[w.doc[at]], 1, n))
    doc, item, shift = (np.concatenate(x) for x in zip(*met, strict=True))
    if not len(doc):
        return
    cell = shift // index.half[item] + (1 << 30)
    key = (doc.astype(np.uint64) * np.uint64(items) + item.astype(np.uint64)) << np.uint64(32) | cell.astype(np.uint64)
    cells, count = np.unique(key, return_counts=True)
    # a band is a cell and the next; a passage may begin in the cell before with words too few for a q-gram
    joined = cells[1:] == cells[:-1] + np.uint64(1)
    after, alone = np.zeros(len(cells), np.int64), np.ones(len(cells), np.int64)
    after[:-1] = np.where(joined, count[1:], 0)
    alone[1:] = ~joined
    pair = (cells >> np.uint64(32)).astype(np.int64)
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for c in np.flatnonzero(count + after >= index.need[pair % items]):
        d, i = divmod(int(pair[c]), items)
        words = index.item_words[i]
        if found.get((d, i), (0, 0))[0] * 2 >= len(words):
            continue
        half, at = int(index.half[i]), int(cells[c] & np.uint64(0xFFFFFFFF)) - (1 << 30)
        low, high = (at - int(alone[c])) * half, (at + 2) * half
        a, b, lo = w.first[d], w.first[d + 1], max(0, low)
        hashes = w.hash[a + lo : max(a + lo, min(b, a + len(words) + high))].tolist()
        got = passage(words, hashes, low - lo, high - lo)
        found[d, i] = max(found.get((d, i), (0, 0)), got)
    for (d, i), (span, matched) in found.items():
        if span * 2 >= len(index.item_words[i]):
            yield d, i, span, matched


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Blocks of at most BLOCK_LETTERS characters (or one item) of the items, streamed
    through the driver one partition at a time."""
    block, size = [], 0
    for r in items.filter("item_id is not null and text is not null").select("item_id", "text").toLocalIterator():
        if block and size + len(r.text) > BLOCK_LETTERS:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += len(r.text)
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id, words, spanned, matched), one row for each document that holds at
    least half of an item's words as one running passage.

    Items under MIN_WORDS words are never reported. Null texts hold nothing; repeated
    rows are reported once; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    schema = "item_id bigint, doc_id bigint, words int, spanned int, matched int"
    out = spark.createDataFrame([], schema)
    for block in _item_blocks(items):
        held = spark.sparkContext.broadcast(Index(block))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), []
                for start, texts in blocks(batch.column(1).to_pylist()):
                    rows += [(index.ids[i], ids[start + d], len(index.item_words[i]), span, m) for d, i, span, m in _scan(index, texts)]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["item_id", "doc_id", "words", "spanned", "matched"])

        out = out.unionByName(spread(docs.filter("doc_id is not null and text is not null").select("doc_id", "text")).mapInArrow(run, schema))
    return out.groupBy("item_id", "doc_id").agg(F.max("words").alias("words"), F.max("spanned").alias("spanned"), F.max("matched").alias("matched"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark_items")).select("item_id", "doc_id")


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """Which items leaked, and into how many documents."""
    found = leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark_items"))
    items = table(spark, folder, "benchmark_items").select("item_id", "task")
    return items.join(found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("spanned").alias("longest")), "item_id")
