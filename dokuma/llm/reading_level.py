"""How demanding each Turkish prose text is to read.

Every sentence is classified by regularised logistic models over its words (hashed) and
its character trigrams (hashed), with its length and its mean word length; the models
are fitted on the sentences of hand-marked documents. A document's level comes from the
distribution over its sentences, weighted by their words, through a second small model
calibrated on whole marked documents. Documents that are no prose by their structural
profile, that are in another language, or that are verse have no level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dokuma.llm._codes import BLOCK_CHARS, SEP, Words, blocks, codepoints, mix
from dokuma.llm.structure import KINDS, Profiles, Stats, features, learn, marks
from dokuma.session import small_batches, spread
from dokuma.sources.tables import table

LEVELS = ("temel", "orta", "ileri")
#: Marked documents of each level used for fitting at most.
FIT_ROWS = 150
#: Hashed features of words and of character trigrams (powers of two), the strength of
#: the ridge penalty, and the steps of the fit.
WORD_BINS, GRAM_BINS, RIDGE, STEPS = 1 << 15, 1 << 15, 1e-4, 80


class Sentences:
    """Sentences of a block of texts and their features.

    A sentence ends at . ! ? or …, or at a blank line; a stop between digits or inside a
    word ends none. doc: index of the text; words: word count of each sentence;
    rows, cols, values: the sparse features (row is the sentence).
    """

    def __init__(self, texts: list[str]):
        cps, begin = codepoints(texts)
        stop = np.isin(cps, np.frombuffer(".!?…".encode("utf-32-le"), np.uint32))
        after = np.concatenate((cps[1:], [32]))
        blank_next = np.isin(after, [32, 9, 10, 13, 0x1E, 0xA0, 34, 39, 41, 0x201D, 0x2019])
        stop &= blank_next
        gap = (cps == 10) & (after == 10)
        cut = stop | gap | (cps == ord(SEP))
        # every text's sentences as texts of their own: a separator put after each cut
        joined = np.insert(cps, np.flatnonzero(cut & (cps != ord(SEP))) + 1, ord(SEP))
        ends = np.flatnonzero(joined == ord(SEP))
        shift = np.cumsum(cut & (cps != ord(SEP)))
        doc_end = begin[1:] - 1 + shift[begin[1:] - 1]
        owner = np.searchsorted(doc_end, ends)
        whole = joined.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        w = Words(whole[:-1].split(SEP))
        n = np.diff(w.first)
        keep = np.flatnonzero(n > 0)
        new = np.full(len(n), -1)
        new[keep] = np.arange(len(keep))
        self.doc, self.words = owner[keep], n[keep]
        self.count = len(keep)
        row = new[w.doc]
        size = w.end - w.start
        word_col = (w.hash & np.uint64(WORD_BINS - 1)).astype(np.int64)
        # character trigrams inside words, their bounds included
        c = w.chars.astype(np.uint64)
        inside = (w.chars != 32) & (w.chars != ord(SEP))
        c = np.where(inside, c, np.uint64(32))
        if len(c) >= 3:
            g = c[:-2] | c[1:-1] << np.uint64(21) | c[2:] << np.uint64(42)
            mid = inside[1:-1]
            at = np.flatnonzero(mid)
            word_of = np.searchsorted(w.start, at + 1, "right") - 1
            gram_row, gram_col = row[word_of], (mix(g[at]) & np.uint64(GRAM_BINS - 1)).astype(np.int64) + WORD_BINS
        else:
            gram_row = gram_col = np.zeros(0, np.int64)
        self.rows = np.concatenate((row, gram_row))
        self.cols = np.concatenate((word_col, gram_col))
        grams = np.maximum(np.bincount(gram_row, minlength=self.count), 1)
        self.values = np.concatenate((1 / np.sqrt(self.words[row]), 1 / np.sqrt(grams[gram_row])))
        mean = np.bincount(row, weights=size, minlength=self.count) / np.maximum(self.words, 1)
        long = np.bincount(row, weights=size >= 12, minlength=self.count) / np.maximum(self.words, 1)
        self.dense = np.stack((np.ones(self.count), np.log1p(self.words) / 3, mean / 10, long), 1)


class LevelModel:
    """Sentence models of words and characters, and the calibration over documents."""

    def __init__(self, sparse: np.ndarray, dense: np.ndarray):
        self.sparse, self.dense = sparse, dense  # (features, 3) and (4, 3)
        self.document = None

    def sentence(self, s: Sentences) -> np.ndarray:
        """Probabilities of the three levels of each sentence."""
        z = s.dense @ self.dense
        for k in range(len(LEVELS)):
            z[:, k] += np.bincount(s.rows, weights=self.sparse[s.cols, k] * s.values, minlength=s.count)
        return softmax(z)

    def documents(self, texts: list[str]) -> np.ndarray:
        """Features of each text's distribution over its sentences: mean probabilities and
        the shares of sentences won by each level, weighted by words."""
        out = np.zeros((len(texts), 6))
        for first, own in blocks(texts, BLOCK_CHARS // 2):
            s = Sentences(own)
            p = self.sentence(s)
            n = len(own)
            weight = np.maximum(np.bincount(s.doc, weights=s.words, minlength=n), 1)
            for k in range(3):
                out[first : first + n, k] = np.bincount(s.doc, weights=p[:, k] * s.words, minlength=n) / weight
                out[first : first + n, 3 + k] = np.bincount(s.doc, weights=(p.argmax(1) == k) * s.words, minlength=n) / weight
        return out

    def levels(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(index into LEVELS, its probability) of each text."""
        p = softmax(np.concatenate((np.ones((len(texts), 1)), self.documents(texts)), 1) @ self.document)
        return p.argmax(1), p.max(1)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def fit_sentences(s: Sentences, level: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> LevelModel:
    """Ridge-penalised softmax regression by accelerated gradient steps; sentences of each
    level weigh the same in all."""
    n, k = s.count, len(LEVELS)
    used, col = np.unique(s.cols, return_inverse=True)
    y = np.eye(k)[level]
    share = np.bincount(level, minlength=k)
    weight = (n / (k * np.maximum(share, 1)))[level] / n
    ws, wd = np.zeros((len(used), k)), np.zeros((s.dense.shape[1], k))
    vs, vd = ws.copy(), wd.copy()
    rate, t = 0.6, 1.0
    for _ in range(steps):
        z = s.dense @ vd
        for j in range(k):
            z[:, j] += np.bincount(s.rows, weights=vs[col, j] * s.values, minlength=n)
        r = (softmax(z) - y) * weight[:, None]
        gs = np.stack([np.bincount(col, weights=r[s.rows, j] * s.values, minlength=len(used)) for j in range(k)], 1) + ridge * vs
        gd = s.dense.T @ r + ridge * vd
        new_s, new_d = vs - rate * gs, vd - rate * gd
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vs, vd = new_s + (t - 1) / t1 * (new_s - ws), new_d + (t - 1) / t1 * (new_d - wd)
        ws, wd, t = new_s, new_d, t1
    sparse = np.zeros((WORD_BINS + GRAM_BINS, k))
    sparse[used] = ws
    return LevelModel(sparse, wd)


def calibrate(x: np.ndarray, level: np.ndarray, ridge: float = 1e-3, steps: int = 400) -> np.ndarray:
    """Weights of the document model: softmax regression on the sentence distributions."""
    x = np.concatenate((np.ones((len(x), 1)), x), 1)
    w, y, k = np.zeros((x.shape[1], len(LEVELS))), np.eye(len(LEVELS))[level], len(LEVELS)
    weight = (len(x) / (k * np.maximum(np.bincount(level, minlength=k), 1)))[level] / len(x)
    for _ in range(steps):
        w -= 1.0 * (x.T @ ((softmax(x @ w) - y) * weight[:, None]) + ridge * w)
    return w


def fit(texts: list[str], levels: np.ndarray) -> LevelModel:
    """The model of marked texts. The sentence models of one half calibrate on the other,
    then the sentence models are fitted on all; wrong marks are outvoted by their
    level's other texts."""
    for k, sentences in enumerate(SEEDS):
        if (levels == k).sum() < FEW:
            texts = [*texts, *(" ".join(sentences[(i + j) % len(sentences)] for j in range(3)) for i in range(FEW))]
            levels = np.concatenate((levels, np.full(FEW, k)))
    halves = np.arange(len(texts)) % 2
    x = np.zeros((len(texts), 6))
    for h in (0, 1):
        own = np.flatnonzero(halves == h)
        other = np.flatnonzero(halves != h)
        m = _fit_on(texts, levels, own if len(own) else other)
        if len(other):
            x[other] = m.documents([texts[i] for i in other])
    model = _fit_on(texts, levels, np.arange(len(texts)))
    model.document = calibrate(x, levels)
    return model


def _fit_on(texts: list[str], levels: np.ndarray, rows: np.ndarray) -> LevelModel:
    s = Sentences([texts[i] for i in rows])
    return fit_sentences(s, levels[rows][s.doc])


#: Marked documents of a level under which seeds help it out.
FEW = 12
#: Plain, middling and scholarly sentences for a table with few marks or none.
SEEDS = [
    ["Ev büyük.", "Kedi uyudu.", "Anne geldi.", "Okul yakın.", "Çocuk süt içti.", "Top kırmızı.", "Kuş ağaca kondu.", "Bu elma tatlı.", "Baba evde oturdu."],
    [
        "Belediye yeni otobüs hatlarını dün akşam duyurdu ve pazar günü seferlerin başlayacağını söyledi.", "Üreticiler fiyatların yükselmesinden yakınıyor, ama kooperatif destek vereceğini açıkladı.",
        "Geçen yıl kurulan dernek, bu hafta mahallede ücretsiz bir kurs başlatacak.", "Yağmur yüzünden ertelenen maç önümüzdeki çarşamba oynanacak.", "Müze yaz boyunca akşam saatlerinde de açık kalacak, böylece turistler daha rahat gezebilecek.",
    ],
    [
        "Kuramsal çerçevenin yöntembilimsel varsayımlarla ilişkilendirilmesi, kavramsallaştırmanın bağlamsal boyutlarının yeniden değerlendirilmesini gerektirdiğinden, bulguların genellenebilirliği sorgulanmaktadır.",
        "Toplumsallaşma süreçlerinin çokkatmanlı yapılandırılması, kurumsal söylemin belirsizliğini derinleştiren epistemolojik kırılmalarla açıklanmaktadır.",
        "Niceliksel parametrelerin istatistiksel olarak sınanması, değişkenler arasındaki nedensellik bağıntısının yalnızca belirli koşullarda geçerli olduğunu göstermektedir.",
        "Küreselleşmenin sosyokültürel yansımalarına ilişkin çözümlemeler, modernleşme kuramlarının disiplinlerarası bir yaklaşımla yeniden yorumlanmasını zorunlu kılmaktadır.",
    ],
]


def verse_like(s: Stats) -> np.ndarray:
    """Texts set in short lines that mostly end without a stop and begin in capitals, and
    bear no bullets: verse, not wrapped prose, whose lines begin in small letters."""
    return (s.n_lines >= 4) & (s.line_words <= 7.5) & (s.ended < 0.35) & (s.lower_starts < 0.35) & (s.bullets < 0.3)


def turkish(s: Stats) -> np.ndarray:
    """Texts whose function words are Turkish rather than of any other language, or that
    have next to none and bear Turkish endings."""
    tr, other = s.langs[:, 0], s.langs[:, 1:].max(1)
    return (tr + 0.35 * s.counts[:, 8] > other) | (other < 0.04)


def assess(docs: DataFrame, profiles: Profiles, model: LevelModel) -> DataFrame:
    """(doc_id, level, confidence, kind): level is null where it does not apply: null and
    blank texts, documents that are no prose, verse, other languages."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast((profiles, model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prof, mod = held.value
        for pdf in batches:
            for start, texts in blocks(pdf["text"].tolist()):
                s = Stats(texts)
                dists, counts = features(s)
                kind, _ = prof.nearest([*(x.astype(np.float32) for x in dists), counts.astype(np.float32)])
                fits = (kind == 0) & (s.n_words > 0) & turkish(s) & ~verse_like(s)
                at = np.flatnonzero(fits)
                level, sure = np.full(len(texts), None, object), np.zeros(len(texts))
                if len(at):
                    got, p = mod.levels([texts[i] for i in at])
                    level[at], sure[at] = np.array(LEVELS, object)[got], p
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[start : start + len(texts)], "level": level, "confidence": sure, "kind": np.where(s.n_lines > 0, np.array(KINDS, object)[kind], None)})

    return spread(docs.filter("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).mapInPandas(run, "doc_id bigint, level string, confidence double, kind string")


def learn_levels(docs: DataFrame, labels: DataFrame, per_level: int = FIT_ROWS) -> LevelModel:
    """The model of at most ``per_level`` marked documents of each level, whole texts of up to a
    million characters, which bounds what comes to the driver."""
    chosen = F.broadcast(marks(labels.filter(F.col("reading_level").isin(*LEVELS)), "reading_level", per_level, per_value=True))
    rows = docs.select("doc_id", "text").filter("text is not null and length(text) <= 1000000").join(chosen, "doc_id").select("doc_id", "text", "value").collect()
    rows.sort(key=lambda r: r.doc_id)
    return fit([r.text for r in rows], np.array([LEVELS.index(r.value) for r in rows], np.int64))


def _assessed(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return assess(docs, learn(docs, labels), learn_levels(docs, labels))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _assessed(spark, folder).filter("level in ('temel', 'ileri')").select("doc_id", "level")


def p10_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each kind and level."""
    return _assessed(spark, folder).groupBy("kind", "level").agg(F.count("*").alias("documents"))
