"""Texts of the evaluation splits that are also, wholly or nearly, in the training split.

Two texts meet when their words (folded: case, accents, punctuation, spacing and line
breaks aside) differ by at most ``EDIT_SHARE`` of the longer text's words, counted as
word edits. The join is an exact prefix filter over rare shingles:

1. One pass over all texts of at least ``MIN_WORDS`` words gives each a digest of its words, and
   counts all shingles of ``Q`` words by ``CLASSES`` hash classes, in which boilerplate stands out.
   Same texts collapse into one class by digest, with map-side combine.
2. An evaluation text of which e words may be edited is cut into e + 1 stretches. An edit touches one
   stretch at most, so whatever is edited, one stretch stays whole. The rarest shingle of each
   stretch makes the text's prefix: a partner must hold one of them. Places, not sets, are cut, so texts that
   repeat themselves need no other treatment.
3. Training texts probe with all their shingles. A bit filter over the evaluation prefixes, its size
   taken from their counted number, keeps nearly all other shingles from being written; where they are
   too many for a filter, all training shingles are shuffled instead.
4. Both meet on (shingle, length class), which also parts boilerplate, and must pass the length
   filter and the position filter: the words before and after the shingle differ in number by no more
   than the edits.
5. Candidates fetch the texts of their classes, by another such filter over identifiers, and the word edit
   distance is computed on the diagonals within the budget.
6. Class pairs within the budget, and classes that lie in both splits, are expanded to the pairs of
   documents; the report is counted from the sizes of the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dokuma.llm._codes import Words, blocks, mix
from dokuma.llm._filters import MOST_ENTRIES, BitFilter, maybe
from dokuma.session import materialise, small_batches, spread
from dokuma.sources.tables import table

Q = 5
MIN_WORDS = 20
#: Word edits over words of the longer text.
EDIT_SHARE = 0.11
#: Hash classes in which shingles are counted to tell rare from frequent ones.
CLASSES = 1 << 16
#: A class of same texts is hot when it holds more than one part in so many of all texts.
HOT_PARTS = 64


def budget(words: np.ndarray | int, share: float = EDIT_SHARE):
    """Word edits allowed against a text of so many words, when it is the longer one."""
    return np.floor(np.asarray(words) * share + 1e-9).astype(np.int64)


def widest(words: np.ndarray | int, share: float = EDIT_SHARE):
    """Word edits allowed against a text of so many words, whatever the partner's length."""
    return np.floor(np.asarray(words) * (share / (1 - share)) + 1e-9).astype(np.int64)


def length_class(words: np.ndarray | int, share: float = EDIT_SHARE):
    """Classes of lengths each longer by the edit share than the one before."""
    return np.floor(np.log(np.maximum(np.asarray(words), 1)) / -np.log(1 - share) + 1e-9).astype(np.int64)


def _counted(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of the texts of at least MIN_WORDS words and the number of the word each begins at."""
    h, at = w.shingles(Q)
    keep = np.diff(w.first)[w.doc[at]] >= MIN_WORDS
    return h[keep], at[keep]


def signatures(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """((doc_id, train, d1, d2, words) of the texts of at least MIN_WORDS words, shingles in each hash class).

    d1, d2: 128 bits over all folded words. A repeated row is one. Both come from one pass, which
    writes CLASSES rows of counts a task at most.
    """
    small_batches(docs.sparkSession)
    names = ["doc_id", "train", "d1", "d2", "words", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CLASSES, np.int64)
        for batch in batches:
            ids, train = batch.column(0).to_numpy(False), batch.column(1).to_numpy(False)
            for start, texts in blocks(batch.column(2).to_pylist()):
                w = Words(texts)
                n = np.diff(w.first)
                keep = np.flatnonzero(n >= MIN_WORDS)
                seen += np.bincount((_counted(w)[0] & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES)
                d1, d2 = _digests(w)
                cols = [pa.array(ids[start + keep]), pa.array(train[start + keep]), pa.array(d1[keep].view(np.int64)), pa.array(d2[keep].view(np.int64)), pa.array(n[keep].astype(np.int32)), pa.nulls(len(keep), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names)
        at = np.flatnonzero(seen)
        cols = [pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.bool_()), pa.array(at), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int32()), pa.array(seen[at])]
        yield pa.RecordBatch.from_arrays(cols, names)

    cols = docs.filter("doc_id is not null and text is not null").select("doc_id", (F.col("split") == "train").alias("train"), "text")
    rows = materialise(spread(cols).mapInArrow(run, "doc_id bigint, train boolean, d1 bigint, d2 bigint, words int, n bigint"), "overlap-signatures")
    counts = rows.filter("n is not null").groupBy("d1").agg(F.sum("n").alias("n")).toArrow()  # CLASSES rows at most
    seen = np.zeros(CLASSES, np.int64)
    seen[counts["d1"].to_numpy()] = counts["n"].to_numpy()
    return rows.filter("n is null").drop("n").distinct(), seen


def _digests(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each text's word sequence. Each word is mixed with its place: sums weighted by powers
    modulo 2**64 are the same for different texts that can be built of two words."""
    a, b = w.first[:-1], w.first[1:]
    place = (np.arange(len(w.hash)) - w.first[w.doc]).astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for salt in (1, 2):
            h = mix(w.hash + mix(place * np.uint64(2) + np.uint64(salt)))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)))
            out.append(mix(sums[b] - sums[a] + (b - a).astype(np.uint64)))
    return out[0], out[1]


def prefixes(docs: DataFrame, seen: np.ndarray) -> DataFrame:
    """(shingle, low, high, d1, d2, words, pos): the rarest shingle of each stretch of every evaluation text, and the
    length classes from low to high that a partner may be of; same texts give the same rows once."""
    held = docs.sparkSession.sparkContext.broadcast(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = held.value
        for batch in batches:
            for _, texts in blocks(batch.column(0).to_pylist()):
                w = Words(texts)
                h, at = _counted(w)
                doc = w.doc[at]
                n = np.diff(w.first)[doc]
                pos = at - w.first[doc]
                parts = widest(n) + 1
                part = ((pos + 1) * parts - 1) // n
                whole = pos + Q <= ((part + 1) * n) // parts
                h, doc, n, pos, part = h[whole], doc[whole], n[whole], pos[whole], part[whole]
                order = np.lexsort((h, seen[(h & np.uint64(CLASSES - 1)).astype(np.int64)], part, doc))
                first = np.ones(len(order), bool)
                first[1:] = (doc[order][1:] != doc[order][:-1]) | (part[order][1:] != part[order][:-1])
                at = order[first]
                d1, d2 = _digests(w)
                low, high = length_class(n[at] - widest(n[at])), length_class(n[at] + widest(n[at]))
                cols = [h[at].view(np.int64), low.astype(np.int32), high.astype(np.int32), d1[doc[at]].view(np.int64), d2[doc[at]].view(np.int64), n[at].astype(np.int32), pos[at].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["shingle", "low", "high", "d1", "d2", "words", "pos"])

    texts = docs.filter("doc_id is not null and text is not null and split <> 'train'").select("text")
    return spread(texts).mapInArrow(run, "shingle bigint, low int, high int, d1 bigint, d2 bigint, words int, pos int").distinct()


def probes(docs: DataFrame, filt: BitFilter) -> DataFrame:
    """(shingle, length, d1, d2, words, pos) of the training texts' shingles that may be in the filter; same texts
    give the same rows once."""
    held = docs.sparkSession.sparkContext.broadcast(filt.mask())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = held.value
        for batch in batches:
            for _, texts in blocks(batch.column(0).to_pylist()):
                w = Words(texts)
                h, at = _counted(w)
                if mask is not None:
                    known = maybe(mask, h)
                    h, at = h[known], at[known]
                doc = w.doc[at]
                d1, d2 = _digests(w)
                n = np.diff(w.first)[doc]
                cols = [h.view(np.int64), length_class(n).astype(np.int32), d1[doc].view(np.int64), d2[doc].view(np.int64), n.astype(np.int32), (at - w.first[doc]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["shingle", "length", "d1", "d2", "words", "pos"])

    texts = docs.filter("doc_id is not null and text is not null and split = 'train'").select("text")
    return spread(texts).mapInArrow(run, "shingle bigint, length int, d1 bigint, d2 bigint, words int, pos int").distinct()


def candidates(e: DataFrame, t: DataFrame) -> DataFrame:
    """(e1, e2, t1, t2): digests of the pairs of different texts that the filters leave, one row each."""
    e = e.select("shingle", F.explode(F.sequence("low", "high")).alias("length"), F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.col("words").alias("e_words"), F.col("pos").alias("e_pos"))
    t = t.select("shingle", "length", F.col("d1").alias("t1"), F.col("d2").alias("t2"), F.col("words").alias("t_words"), F.col("pos").alias("t_pos"))
    edits = F.floor(F.greatest("e_words", "t_words") * EDIT_SHARE + 1e-9)
    before, after = F.col("e_pos") - F.col("t_pos"), F.col("e_words") - F.col("e_pos") - F.col("t_words") + F.col("t_pos")
    met = e.join(t, ["shingle", "length"]).filter((F.abs(before) + F.abs(after) <= edits) & ((F.col("e1") != F.col("t1")) | (F.col("e2") != F.col("t2"))))
    return met.select("e1", "e2", "t1", "t2").distinct()


def word_edits(a: list, b: list, most: int) -> int:
    """Word edit distance if it is at most ``most``, else most + 1.

    For each number of edits the farthest word reached on each diagonal is kept, so the
    work is bounded by the words and the square of the edits, and only diagonals within
    the budget are ever looked at.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1

    def slide(i: int, k: int) -> int:
        while i < n and i + k < m and a[i] == b[i + k]:
            i += 1
        return i

    reach = {0: slide(0, 0)}
    for e in range(most + 1):
        if reach.get(m - n, -1) >= n:
            return e
        new = {}
        for k in range(max(-e - 1, -most), min(e + 1, most) + 1):
            i = max(reach.get(k, -2) + 1, reach.get(k + 1, -2) + 1, reach.get(k - 1, -2))
            if i >= 0 and i <= n and i + k <= m and i + k >= 0:
                new[k] = slide(i, k)
            elif i > n and k in reach:
                new[k] = n
            elif k in reach:
                new[k] = reach[k]
        reach = new
    return most + 1


def some_texts(docs: DataFrame, ids: DataFrame, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """The rows of (doc_id, text) whose doc_id may be among ``ids``, told by a broadcast filter; all rows if there
    are too many ids for one."""
    rows = docs.filter("doc_id is not null and text is not null").select("doc_id", "text")
    filt = BitFilter(materialise(ids.distinct().select(F.xxhash64("id").alias("entry")), "wanted"), most_entries)
    return filt.flag(rows, F.xxhash64("doc_id")).filter("maybe").drop("maybe")


def at_least(x: np.ndarray, y: np.ndarray) -> int:
    """Word edits that two texts of the given word hashes differ by at least: an edit takes one word out of
    one of 256 classes of words, puts one in, or both."""
    d = np.bincount((x & np.uint64(255)).astype(np.int64), minlength=256) - np.bincount((y & np.uint64(255)).astype(np.int64), minlength=256)
    return int(max(d[d > 0].sum(), -d[d < 0].sum()))


def verified(pairs: DataFrame, docs: DataFrame, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """(eval_id, train_id, edits) of the pairs within the budget. Texts travel as the hashes of their words, so
    each is parted into words once."""
    some = some_texts(docs, pairs.select(F.explode(F.array("eval_id", "train_id")).alias("id")), most_entries)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for _, texts in blocks(batch.column(1).to_pylist()):
                w = Words(texts)
                own += [w.hash[a:b].tobytes() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["id", "words"])

    texts = materialise(some.mapInArrow(words, "id bigint, words binary"), "overlap-words").dropDuplicates(["id"])
    e = texts.select(F.col("id").alias("eval_id"), F.col("words").alias("e_words"))
    t = texts.select(F.col("id").alias("train_id"), F.col("words").alias("t_words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edits = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                most = int(budget(max(len(x), len(y))))
                d = at_least(x, y)
                d = word_edits(x.tolist(), y.tolist(), most) if d <= most else d
                edits.append(d if d <= most else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(edits, pa.int32())], ["eval_id", "train_id", "edits"])

    joined = pairs.join(e, "eval_id").join(t, "train_id").select("eval_id", "train_id", "e_words", "t_words")
    return joined.mapInArrow(run, "eval_id bigint, train_id bigint, edits int").filter("edits is not null")


class Overlaps:
    """The pairs of classes of same texts that overlap, and the documents of each class.

    docs: doc_id, text, split. Every split but 'train' is evaluation; null texts and texts under MIN_WORDS
    words have no pairs; repeated rows count once; an empty table gives no rows.
    """

    def __init__(self, docs: DataFrame, most_entries: int = MOST_ENTRIES):
        sigs, seen = signatures(docs)
        self.sigs = materialise(sigs, "overlap-documents")
        classes = self.sigs.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count_if("train").alias("n_train"), F.count_if(~F.col("train")).alias("n_eval"))
        #: (d1, d2, rep, n_train, n_eval): the classes, rep being the smallest doc_id.
        self.classes = materialise(classes, "overlap-classes")
        #: (eval_id, train_id, edits): pairs of classes by their rep.
        self.pairs = self._pairs(docs, seen, most_entries)

    def _pairs(self, docs: DataFrame, seen: np.ndarray, most_entries: int) -> DataFrame:
        e = materialise(prefixes(docs, seen), "overlap-prefixes")
        keys = materialise(e.select(F.col("shingle").alias("entry")).distinct(), "overlap-keys")
        t = probes(docs, BitFilter(keys, most_entries))
        digests = materialise(candidates(e, t), "overlap-digests")
        named = [self.classes.select(F.col("d1").alias(f"{s}1"), F.col("d2").alias(f"{s}2"), F.col("rep").alias(name)) for s, name in (("e", "eval_id"), ("t", "train_id"))]
        met = materialise(digests.join(named[0], ["e1", "e2"]).join(named[1], ["t1", "t2"]).select("eval_id", "train_id"), "overlap-candidates")
        same = self.classes.filter("n_train > 0 and n_eval > 0").select(F.col("rep").alias("eval_id"), F.col("rep").alias("train_id"), F.lit(0).alias("edits"))
        return materialise(verified(met, docs, most_entries).unionByName(same), "overlap-pairs")

    def members(self, of: DataFrame) -> DataFrame:
        """(doc_id, train, rep) of the documents of the classes whose rep is in ``of``. Documents of hot classes, of which
        there are fewer than HOT_PARTS, meet them by broadcast, so none is gathered in one task."""
        total = self.classes.agg(F.sum(F.col("n_train") + F.col("n_eval")).alias("n")).first().n or 0
        is_hot = F.col("n_train") + F.col("n_eval") > max(total / HOT_PARTS, 1)
        hot = [(r.d1, r.d2) for r in self.classes.filter(is_hot).select("d1", "d2").collect()]
        wanted = self.classes.join(of.distinct(), "rep", "left_semi").select("d1", "d2", "rep")
        of_hot = F.struct("d1", "d2").isin([F.struct(F.lit(a), F.lit(b)) for a, b in hot]) if hot else F.lit(False)
        out = self.sigs.filter(~of_hot).join(wanted.filter(~of_hot), ["d1", "d2"])
        if hot:
            out = out.unionByName(self.sigs.filter(of_hot).join(F.broadcast(wanted.filter(of_hot)), ["d1", "d2"]))
        return out.select("doc_id", "train", "rep")


def overlaps(docs: DataFrame, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """(eval_doc, train_doc, edits): all pairs of an evaluation and a training document whose
    texts are the same or within the budget; see ``Overlaps``."""
    found = Overlaps(docs, most_entries)
    members = found.members(found.pairs.select(F.explode(F.array("eval_id", "train_id")).alias("rep")))
    e = members.filter("not train").select(F.col("rep").alias("eval_id"), F.col("doc_id").alias("eval_doc"))
    t = members.filter("train").select(F.col("rep").alias("train_id"), F.col("doc_id").alias("train_doc"))
    return found.pairs.join(e, "eval_id").join(t, "train_id").select("eval_doc", "train_doc", "edits")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = overlaps(table(spark, folder, "documents").select("doc_id", "text", "split"))
    return pairs.select(F.least("eval_doc", "train_doc").alias("doc_id_a"), F.greatest("eval_doc", "train_doc").alias("doc_id_b"))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per split and source the evaluation documents that overlap with training, and the pairs, counted from
    the sizes of the classes without making the pairs."""
    docs = table(spark, folder, "documents")
    found = Overlaps(docs.select("doc_id", "text", "split"))
    sizes = found.classes.select(F.col("rep").alias("train_id"), "n_train")
    per_class = found.pairs.join(sizes, "train_id").groupBy(F.col("eval_id").alias("rep")).agg(F.sum("n_train").alias("partners")).filter("partners > 0")
    members = found.members(per_class.select("rep")).filter("not train").join(docs.select("doc_id", "split", "source"), "doc_id")
    sized = members.groupBy("rep", "split", "source").agg(F.count("*").alias("n")).join(per_class, "rep")
    return sized.groupBy("split", "source").agg(F.sum("n").alias("documents"), F.sum(F.col("n") * F.col("partners")).alias("pairs"))
