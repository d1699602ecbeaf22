"""Per-document text statistics and the structural profile each document is nearest to.

For each text the operator counts words, signs and lines, and forms distributions over
function words (and the endings that do their work in Turkish), over character classes,
over the shapes of words and over the shapes of lines. Profiles of such distributions
are learnt from hand-marked documents, several a kind, since prose in five languages,
verse, bulleted and bare lists, tables of all layouts and all sorts of junk look nothing
like each other. A document gets the kind of the profile that is nearest by
Jensen-Shannon divergence of the distributions together with the distance of the
basic counts.

All counting is done on numpy arrays of code points, whole texts, in one pass without
a shuffle; only the marks (a bounded sample) are joined to their texts for fitting.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dokuma.llm._codes import PLAIN_LETTERS, VARIED, Words, blocks, codepoints, word_hash
from dokuma.session import small_batches, spread
from dokuma.sources.tables import table

KINDS = ("prose", "list", "table", "junk")
#: Marked documents used for fitting at most, those of the smallest hash of doc_id, so
#: that kinds come in their natural shares.
FIT_ROWS = 1600
#: Profiles of each kind at most, the weight of the distance of the basic counts (the
#: divergences have weight 1), and neighbours that vouch for a mark.
PROFILES, COUNT_WEIGHT, NEIGHBOURS = 24, 3.0, 7#: How much more than other counts those of repetition weigh.
REPEATS = 4.0

#: Frequent function words of five languages, folded; fixed values.
FUNCTION_WORDS = {
    "tr": "ve bir bu da de icin ile cok daha en gibi kadar ama ancak oysa cunku ki ne o her olarak sonra once gore hem var yok degil veya ya hangi boylece ustelik".split(),
    "en": "the of and to in is that it was for on are with as be this not have by from or we an there every but".split(),
    "de": "der die das und ist nicht ein eine einen mit von zu den dem es wir sie auch auf ohne weil man nach".split(),
    "fr": "le la les de des du et un une est que qui pas dans pour nous il elles avec sont mais tres".split(),
    "es": "el la los las de que y en un una es por con para no hay muchos muy pero esta ellos sin".split(),
}
#: Endings of Turkish finite verbs and of bound function morphemes, folded, longest first; fixed values.
ENDINGS = ["yor", "yorlar", "acak", "ecek", "mis", "mus", "diler", "dilar", "dular", "tiler", "tilar", "di", "du", "ti", "tu", "nin", "nun", "lari", "leri", "larin", "lerin", "da", "de", "ta", "te", "dan", "den", "tan", "ten", "arak", "erek", "an", "en", "lar", "ler", "ya", "ye", "la", "le"]
VERBAL = {"yor", "yorlar", "acak", "ecek", "mis", "mus", "diler", "dilar", "dular", "tiler", "tilar", "di", "du", "ti", "tu"}

_CLASS: np.ndarray | None = None
#: Classes of characters.
CLASSES = ("vowel", "consonant", "upper", "digit", "blank", "newline", "tab", "stop", "comma", "quote", "dash", "bar", "bullet", "slash", "bracket", "colon", "equal", "hash", "math", "odd", "mark", "otherletter")


def class_table() -> np.ndarray:
    global _CLASS
    if _CLASS is None:
        ix = {c: i for i, c in enumerate(CLASSES)}
        t = np.full(0x110000, ix["odd"], np.uint8)
        for a, b in PLAIN_LETTERS:
            t[a:b] = ix["otherletter"]
        for cp in VARIED:
            c, k = chr(cp), unicodedata.category(chr(cp))
            if k[0] == "L":
                base = unicodedata.normalize("NFD", c)[0].lower()
                latin = base.isascii() or c in "ıİß"
                t[cp] = ix["upper"] if k in ("Lu", "Lt") else ix["vowel"] if base in "aeiouıy" else ix["consonant"] if latin else ix["otherletter"]
                if not latin:
                    t[cp] = ix["otherletter"]
                if cp in (0xC2, 0xC3, 0xC4, 0xC5):
                    t[cp] = ix["odd"]  # as lead bytes read in the wrong encoding
            elif k == "Nd":
                t[cp] = ix["digit"]
            elif k[0] == "Z":
                t[cp] = ix["blank"]
            elif k[0] == "M":
                t[cp] = ix["mark"]
        for chars, name in ((" ", "blank"), ("\n\r\x0b\x0c  ", "newline"), ("\t", "tab"), (".!?…", "stop"), (",", "comma"), ("'\"’‘“”«»", "quote"), ("-–—", "dash"), ("|", "bar"), ("•▪*·◦‣●○■□►✓", "bullet"), ("/\\", "slash"), ("()[]{}", "bracket"), (":;", "colon"), ("=_~", "equal"), ("#@", "hash"), ("+<>^%$&", "math"), ("﻿​‌‍", "mark")):
            for c in chars:
                t[ord(c)] = ix[name]
        _CLASS = t
    return _CLASS


_LEX: tuple | None = None


def _lexicon() -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted hashes, column of each, columns) of the function words; a word of several
    languages gets a column of its own."""
    global _LEX
    if _LEX is None:
        words = sorted({w for ws in FUNCTION_WORDS.values() for w in ws})
        h = word_hash(words)
        order = np.argsort(h)
        _LEX = h[order], order, len(words)
    return _LEX


def function_columns() -> list[str]:
    return sorted({w for ws in FUNCTION_WORDS.values() for w in ws})


_END: dict[int, tuple[np.ndarray, np.ndarray]] | None = None


def _pack(chars: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """The last ``size`` folded letters of each word as one number."""
    code = np.zeros(len(end), np.int64)
    for k in range(size, 0, -1):
        code = code << 10 | (chars[end - k] & 0x3FF).astype(np.int64)
    return code


def ending_of(w: Words) -> np.ndarray:
    """Index into ENDINGS of each word's longest ending there, for words longer than it; -1 if none."""
    out = np.full(len(w.hash), -1)
    size = w.end - w.start
    for n in sorted({len(e) for e in ENDINGS}):
        own = [(i, e) for i, e in enumerate(ENDINGS) if len(e) == n]
        codes = np.array([_code_of(e) for _, e in own], np.int64)
        order = np.argsort(codes)
        long = np.flatnonzero(size > n)
        if not len(long):
            continue
        c = _pack(w.chars, w.end[long], n)
        spot = np.minimum(np.searchsorted(codes[order], c), len(codes) - 1)
        hit = codes[order][spot] == c
        out[long[hit]] = np.array([i for i, _ in own])[order][spot[hit]]
    return out


def _code_of(e: str) -> int:
    code = 0
    for c in e:
        code = code << 10 | ord(c)
    return code


LINE_SHAPES = ("sentence", "open", "bullet", "numbered", "cells", "pair", "short", "code")
WORD_SHAPES = ("1", "2-3", "4-6", "7-9", "10-14", "15+", "number", "mixed", "novowel", "oov")
COUNTS = ("words", "word_length", "symbol_ratio", "digit_ratio", "lines", "words_per_line", "lines_ended", "function_share", "verb_share", "distinct_share", "trigram_share", "upper_words", "separators_per_line", "line_regularity", "stop_per_word", "comma_per_word", "lower_starts")


class Stats:
    """Statistics of a block of texts; every array has a row for each text.

    chars: shares of CLASSES; func: shares of function words, of ENDINGS and, last, of all
    other words; shapes: shares of WORD_SHAPES; lines: shares of characters in lines of
    LINE_SHAPES; counts: COUNTS; langs: share of the words that are function words of each language.
    """

    def __init__(self, texts: list[str]):
        n = len(texts)
        cps, begin = codepoints(texts)
        cls = class_table()[np.minimum(cps, 0x10FFFF)]
        sep = np.zeros(len(cps), bool)
        sep[begin[1:] - 1] = True
        doc = np.repeat(np.arange(n), np.diff(begin))
        k = len(CLASSES)
        ix = {c: i for i, c in enumerate(CLASSES)}
        table_ = np.bincount((doc * k + cls)[~sep], minlength=n * k).reshape(n, k).astype(float)
        length = np.maximum(table_.sum(1), 1)
        self.chars = table_ / length[:, None]
        w = self.words = Words(texts)
        nw = np.diff(w.first)
        nw1 = np.maximum(nw, 1)
        # function words and endings
        h, col, width = _lexicon()
        spot = np.minimum(np.searchsorted(h, w.hash), len(h) - 1)
        isf = h[spot] == w.hash if len(w.hash) else np.zeros(0, bool)
        end = ending_of(w)
        what = np.where(isf, col[spot], np.where(end >= 0, width + end, width + len(ENDINGS))) if len(w.hash) else np.zeros(0, np.int64)
        fw = width + len(ENDINGS) + 1
        self.func = np.bincount(w.doc * fw + what, minlength=n * fw).reshape(n, fw) / nw1[:, None]
        langs = []
        cols = function_columns()
        for ws in FUNCTION_WORDS.values():
            langs.append(self.func[:, [cols.index(x) for x in ws]].sum(1))
        self.langs = np.stack(langs, 1)
        verbal = np.array([e in VERBAL for e in ENDINGS])
        isverb = (end >= 0) & verbal[np.maximum(end, 0)] & ~isf if len(w.hash) else np.zeros(0, bool)
        # word shapes
        size = w.end - w.start
        digit = (w.chars >= 48) & (w.chars <= 57)
        vowel = np.isin(w.chars, np.frombuffer("aeiouy".encode("utf-32-le"), np.uint32))
        dsum, vsum = np.concatenate(([0], np.cumsum(digit))), np.concatenate(([0], np.cumsum(vowel)))
        nd, nv = dsum[w.end] - dsum[w.start], vsum[w.end] - vsum[w.start]
        shape = np.select([nd == size, nd > 0, (nv == 0) & (size > 2), nv * 4 < size, size == 1, size <= 3, size <= 6, size <= 9, size <= 14], [6, 7, 8, 9, 0, 1, 2, 3, 4], 5) if len(size) else np.zeros(0, np.int64)
        s = len(WORD_SHAPES)
        self.shapes = np.bincount(w.doc * s + shape, minlength=n * s).reshape(n, s) / nw1[:, None]
        # repetition
        distinct = distinct_per_text(w.doc, w.hash, n) / nw1
        g, at = w.shingles(3)
        ng = np.bincount(w.doc[at], minlength=n)
        trigram = np.where(ng > 0, distinct_per_text(w.doc[at], g, n) / np.maximum(ng, 1), 1.0)
        self._line_stats(texts, cps, cls, sep, doc, begin, ix, n)
        verb_share = np.bincount(w.doc[isverb], minlength=n) / nw1 if len(isverb) else np.zeros(n)
        letters = self.chars[:, [ix["vowel"], ix["consonant"], ix["upper"], ix["otherletter"]]].sum(1)
        blank = self.chars[:, [ix["blank"], ix["newline"]]].sum(1)
        digits = self.chars[:, ix["digit"]]
        # where words begin in capitals or small letters, in the original text
        inside = np.isin(cls, [ix["vowel"], ix["consonant"], ix["upper"], ix["otherletter"]])
        starts = inside & np.concatenate(([True], ~inside[:-1] | sep[:-1]))
        ns = np.maximum(np.bincount(doc[starts], minlength=n), 1)
        up = np.bincount(doc[starts & (cls == ix["upper"])], minlength=n) / ns
        self.n_words, self.n_chars = nw, table_.sum(1).astype(np.int64)
        self.counts = np.stack(
            [
                np.log1p(nw) / 8,
                np.minimum(np.bincount(w.doc, weights=size, minlength=n) / nw1 / 15, 2),
                np.maximum(1 - letters - blank - digits, 0),
                digits,
                np.log1p(self.n_lines) / 6,
                np.minimum(np.log1p(nw / np.maximum(self.n_lines, 1)) / 5, 1.5),
                self.ended,
                isf_share(isf, w.doc, nw1, n),
                verb_share,
                distinct,
                trigram,
                up,
                np.minimum(self.seps / np.maximum(self.n_lines, 1) / 4, 1.5),
                self.regular,
                np.minimum(table_[:, ix["stop"]] / nw1, 1.0),
                np.minimum(table_[:, ix["comma"]] / nw1, 1.0),
                self.lower_starts,
            ],
            1,
        )

    def _line_stats(self, texts, cps, cls, sep, doc, begin, ix, n) -> None:
        """Lines that are not blank: how they begin and end, their cells, and what shape they have."""
        brk = sep | (cps == 10) | (cps == 13)
        line = np.cumsum(brk) - brk
        total = int(line[-1]) + 1 if len(line) else 0
        solid = ~brk & ~np.isin(cls, [ix["blank"], ix["tab"], ix["mark"], ix["newline"]])
        at = np.flatnonzero(solid)
        of = line[at]
        lines = np.unique(of)
        first = at[np.searchsorted(of, lines)]
        last = at[np.searchsorted(of, lines, "right") - 1]
        ldoc = doc[first] if len(first) else np.zeros(0, np.int64)
        m = len(lines)
        count = lambda mask: np.bincount(line[mask], minlength=total)[lines].astype(float)
        nchar = np.bincount(of, minlength=total)[lines].astype(float) if m else np.zeros(0)
        letter = np.isin(cls, [ix["vowel"], ix["consonant"], ix["upper"], ix["otherletter"]]) & ~brk
        wstart = letter & np.concatenate(([True], ~letter[:-1]))
        words = count(wstart)
        nextc = np.minimum(first + 1, len(cps) - 1)
        c0, c1 = cls[first], cls[nextc]
        bullet = ((c0 == ix["bullet"]) | (c0 == ix["dash"])) & np.isin(c1, [ix["blank"], ix["tab"]])
        onlyd = cls == ix["digit"]
        # a number or one letter, then . or ) or -
        run_end = first.copy()
        for _ in range(3):
            run_end = np.where(onlyd[run_end] & (run_end < len(cps) - 1), run_end + 1, run_end)
        mark = np.isin(cps[run_end], [46, 41, 45]) & (run_end > first)
        single = letter[first] & np.isin(cps[nextc], [46, 41])
        numbered = mark | single
        quantity = onlyd[first] & ~mark
        tabs, bars, semis, commas = count(cls == ix["tab"]), count(cls == ix["bar"]), count(cps == 59), count(cls == ix["comma"])
        colons, slashes = count(cps == 58), count((cls == ix["slash"]))
        blank2 = np.zeros(len(cps), bool)
        if len(cps) > 2:
            b = cps == 32
            blank2[2:] = b[2:] & b[1:-1] & ~b[:-2]
        gaps = count(blank2)
        cells = np.maximum.reduce([tabs, bars - 1, semis, np.where(words <= 2 * (commas + 1), commas, 0), np.where(words <= 2 * (slashes + 1), slashes, 0), gaps])
        digits = count(onlyd)
        ended = np.isin(cls[last], [ix["stop"], ix["quote"], ix["bracket"]]) | (cps[last] == 58)
        code = (nchar > 30) & (words * 12 < nchar)
        shape = np.select(
            [cells >= 2, bullet, numbered, (colons >= 1) & (words <= 8) & (colons <= 3) & (words >= 1), code, (words >= 3) & np.isin(cls[last], [ix["stop"]]), (words >= 5)],
            [4, 2, 3, 5, 7, 0, 1],
            6,
        )
        s = len(LINE_SHAPES)
        weight = np.bincount(ldoc * s + shape, weights=nchar, minlength=n * s).reshape(n, s)
        self.lines = weight / np.maximum(weight.sum(1), 1)[:, None]
        self.n_lines = np.bincount(ldoc, minlength=n)
        nl = np.maximum(self.n_lines, 1)
        self.ended = np.bincount(ldoc, weights=ended, minlength=n) / nl
        self.seps = np.bincount(ldoc, weights=cells, minlength=n)
        self.quantities = np.bincount(ldoc, weights=quantity, minlength=n) / nl
        self.bullets = np.bincount(ldoc, weights=bullet | numbered, minlength=n) / nl
        self.digit_lines = np.bincount(ldoc, weights=digits > 0, minlength=n) / nl
        self.short_lines = np.bincount(ldoc, weights=words <= 4, minlength=n) / nl
        # how alike the cells of neighbouring lines are
        same = np.zeros(m)
        if m > 1:
            same[1:] = (ldoc[1:] == ldoc[:-1]) & (cells[1:] == cells[:-1]) & (cells[1:] >= 1)
        self.regular = np.bincount(ldoc, weights=same, minlength=n) / nl
        self.lower_starts = np.bincount(ldoc, weights=np.isin(c0, [ix["vowel"], ix["consonant"]]), minlength=n) / nl
        self.line_words = np.bincount(ldoc, weights=words, minlength=n) / nl


def distinct_per_text(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each text; 44 bits of a hash tell apart those of one text."""
    key = np.sort(doc.astype(np.uint64) << np.uint64(44) | h >> np.uint64(20))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=n)


def isf_share(isf: np.ndarray, doc: np.ndarray, nw1: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc[isf], minlength=n) / nw1 if len(isf) else np.zeros(n)


def features(s: Stats) -> tuple[list[np.ndarray], np.ndarray]:
    """(distributions, basic counts) that profiles are compared by."""
    extra = np.stack([s.quantities, s.bullets, s.digit_lines, s.short_lines, np.minimum(s.line_words / 20, 1.5)], 1)
    dists = [s.chars, s.func, s.shapes, s.lines]
    counts = s.counts.copy()
    counts[:, [COUNTS.index("distinct_share"), COUNTS.index("trigram_share")]] *= REPEATS
    for d in dists:
        d /= np.maximum(d.sum(1, keepdims=True), 1e-12)
    return dists, np.concatenate((counts, extra), 1)


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Divergence in bits of each row of p from each row of q."""
    p, q = p.astype(np.float32), q.astype(np.float32)
    tiny = np.float32(1e-12)

    def entropy(x: np.ndarray) -> np.ndarray:
        return -np.einsum("ij,ij->i", x, np.log2(x + tiny))

    hp, hq = entropy(p), entropy(q)
    out = np.empty((len(p), len(q)), np.float32)
    for j in range(len(q)):
        out[:, j] = entropy((p + q[j]) / 2) - (hp + hq[j]) / 2
    return np.maximum(out, 0)


def distance(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Distances of all rows of a from all rows of b; both are the distributions, then the counts."""
    d = sum(jensen_shannon(x, y) for x, y in zip(a[:-1], b[:-1], strict=True))
    counts = np.stack([np.abs(a[-1] - row).mean(1) for row in b[-1]], 1) if len(b[-1]) else np.zeros((len(a[-1]), 0))
    return d + COUNT_WEIGHT * counts


class Profiles:
    """Structural profiles: mean distributions and counts of groups of marked texts."""

    def __init__(self, parts: list[np.ndarray], kinds: np.ndarray):
        self.parts, self.kinds = parts, kinds

    def nearest(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(index into KINDS, distance) of the nearest profile."""
        d = distance(parts, self.parts)
        best = d.argmin(1)
        return self.kinds[best], d[np.arange(len(d)), best]


def fit(parts: list[np.ndarray], kinds: np.ndarray, trusted: int = 0, most: int = PROFILES) -> Profiles:
    """Profiles of marked texts.

    A mark is dropped as wrong when most neighbours bear one other mark and one at most
    bears the same; the last ``trusted`` rows are kept. Groups are made around texts that
    are chosen farthest first, so rare structures get a profile of their own; a marked
    text that is left alone in its group makes none.
    """
    d = distance(parts, parts)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, 1)[:, :NEIGHBOURS]
    usual = np.median(d.min(1)) if len(d) > 1 else 0.0
    votes = np.stack([(kinds[near] == k).sum(1) for k in range(len(KINDS))], 1)
    same = votes[np.arange(len(kinds)), kinds]
    wrong = (same <= 1) & (votes.max(1) * 2 > NEIGHBOURS)
    sure = np.zeros(len(kinds), bool)
    if trusted:
        sure[-trusted:] = True
        wrong[-trusted:] = False
    np.fill_diagonal(d, 0)
    out, out_kinds = [], []
    for k in range(len(KINDS)):
        own = np.flatnonzero((kinds == k) & ~wrong)
        if not len(own):
            continue
        dk = d[np.ix_(own, own)]
        centres = [int(dk.sum(1).argmin())]
        while len(centres) < min(most, len(own)) and dk[:, centres].min(1).max() > usual:
            centres.append(int(dk[:, centres].min(1).argmax()))
        group = dk[:, centres].argmin(1)
        for g in range(len(centres)):
            members = own[group == g]
            if len(members) == 1 and len(own) > 20 and not sure[members[0]]:
                continue
            out.append([x[members].mean(0) for x in parts])
            out_kinds.append(k)
    return Profiles([np.array([o[i] for o in out]) for i in range(len(parts))], np.array(out_kinds))


def seeds() -> tuple[list[str], list[str]]:
    """(texts, kinds) made by rule of structures that everybody knows, so that few marks, or
    none, still give profiles: bullets, numbers and bare items; separated, framed and
    labelled values; noise, repetition, dumps and logs; prose of each language."""
    import random

    r = random.Random(7)
    nouns = "elma armut kitap masa deniz okul yol ev kalem su bahce orman köprü pazar şehir müze".split()
    item = lambda: f"{r.choice(nouns)} {r.choice(nouns)}ı"
    num = lambda: str(r.randint(10, 99999))
    n = range(14)
    texts, kinds = [], []

    def add(kind: str, *own: str) -> None:
        texts.extend(own)
        kinds.extend([kind] * len(own))

    add("list", "\n".join(f"- {item()}" for _ in n), "\n".join(f"• {item()}" for _ in n), "\n".join(f"{i + 1}. {item()}" for i in n), "\n".join(f"{chr(97 + i)}) {item()}" for i in n))
    add("list", "\n".join(item() for _ in n), ", ".join(item() for _ in n), "; ".join(item() for _ in n), " ".join(f"#{r.choice(nouns)}{r.choice(nouns)}" for _ in n), "\n".join(f"{r.randint(2, 900)} {r.choice(['kg', 'gram', 'litre', 'adet'])} {item()}" for _ in n))
    for s in (",", ";", "\t", " / ", " | "):
        add("table", "\n".join(s.join([item(), num(), num(), r.choice(nouns)]) for _ in n))
    add("table", "| a | b | c |\n| --- | --- | --- |\n" + "\n".join(f"| {item()} | {num()} | {num()} |" for _ in n), "\n".join(f"{item():<24}{num():<14}{num()}" for _ in n), "\n".join(f"{item()}: {num()} kg" for _ in n))
    letters = "abcdefghijklmnopqrstuvwxyz"
    add("junk", " ".join("".join(r.choice(letters) for _ in range(r.randint(3, 11))) for _ in range(60)), "".join(r.choice(letters + letters.upper() + "0123456789+/") for _ in range(500)), "\n".join(" ".join(f"{r.randint(0, 255):02x}" for _ in range(16)) for _ in n))
    add("junk", "".join(r.choice("#%$&*<>=+-_/|^~") * r.randint(1, 8) for _ in range(90)), (item() + " ") * 40, (item() + ", ") * 40, (item() + " - ") * 40, "\n".join([item()] * 40), "".join(r.choice("�?¿§¤ eatlnk") for _ in range(400)))
    add("junk", "\n".join(f"[{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}] {r.choice(['ERR', 'WARN', 'DBG'])} {r.choice(nouns)}_{num()} rc={r.randint(1, 99)} 0x{r.randint(1 << 28, 1 << 31):08x}" for _ in n))
    tr = "Bu sabah erkenden kalktık ve denize doğru yürüdük. Yolda eski bir köprü gördük, ama kimse onu geçmiyordu. Akşam olunca herkes evine döndü ve çocuklar kitap okudu. "
    add("junk", (tr * 3).encode().decode("latin-1"), (tr * 3).encode().decode("latin-1").encode().decode("latin-1"))
    add("prose", tr * 3, tr.replace(". ", ".\n") * 3, (tr * 3).upper(), tr[:70] + "\n" + tr[70:140] + "\n" + tr[140:], "- " + tr.replace(". ", ".\n- ") * 2)
    plain = "Ev büyük. Kedi sütü içti. Çocuk okula gitti. Anne elma aldı. Bu top çok kırmızı. Kuş ağaca kondu. "
    learned = "Kuramsal çerçevenin yöntembilimsel varsayımlarla ilişkilendirilmesi, kavramsallaştırmanın bağlamsal boyutlarının yeniden değerlendirilmesini gerektirmektedir. Toplumsallaşma süreçlerinin yapılandırılması, kurumsal söylemin belirsizliğini derinleştiren kırılmalarla açıklanmaktadır. "
    add("prose", plain * 2, learned * 2, learned)
    add("prose", "The people of the village have a river that they like, and it is not far from the old bridge. There was a boat, but nobody could use it. " * 3)
    add("prose", "Die Leute in dem Dorf haben einen Fluss, und sie gehen nicht ohne das Boot zu der Brücke. Es gibt auch eine Schule, die alt ist. " * 3)
    add("prose", "Les gens du village ont une rivière qui est belle, et ils ne vont pas sans le bateau dans la ville. Il y a beaucoup de ponts pour nous. " * 3)
    add("prose", "La gente del pueblo tiene un río que es muy largo, y no van sin el barco a la ciudad. Hay muchos puentes para las personas. " * 3)
    return texts, kinds


def parts_of(texts: list[str]) -> list[np.ndarray]:
    """The distributions and, last, the counts of texts of any number and length."""
    got = []
    for _, own in blocks(texts):
        dists, counts = features(Stats(own))
        got.append([*dists, counts])
    return [np.concatenate(x).astype(np.float32) for x in zip(*got, strict=True)]


def marks(labels: DataFrame, column: str, rows: int, per_value: bool = False) -> DataFrame:
    """(doc_id, value) of at most ``rows`` marked documents, or of so many for each value, those
    of the smallest hash of doc_id. The value is what most annotators gave, ties by the smaller."""
    from pyspark.sql.window import Window

    votes = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id", F.col(column).alias("value")).agg(F.count("*").alias("n"))
    one = votes.groupBy("doc_id").agg(F.min(F.struct(-F.col("n"), "value")).alias("best")).select("doc_id", "best.value")
    if not per_value:
        return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    rank = F.row_number().over(Window.partitionBy("value").orderBy(F.xxhash64("doc_id"), "doc_id"))
    return one.withColumn("rank", rank).filter(F.col("rank") <= rows).select("doc_id", "value")


def marked_vectors(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[list[np.ndarray], np.ndarray]:
    """The parts and kinds of the marked documents. Only their vectors, of fixed size and at
    most ``rows``, come to the driver."""
    chosen = F.broadcast(marks(labels.filter(F.col("doc_kind").isin(*KINDS)), "doc_kind", rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = np.concatenate(parts_of([t or "" for t in batch.column(1).to_pylist()]), 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in flat], pa.binary())], ["value", "vector"])

    got = docs.select("doc_id", "text").filter("text is not null").join(chosen, "doc_id").select("value", "text").mapInArrow(run, "value string, vector binary").collect()
    got.sort(key=lambda r: (r.value, bytes(r.vector)))
    sizes = [x.shape[1] for x in parts_of(["a"])]
    flat = np.array([np.frombuffer(r.vector, np.float32) for r in got], np.float32).reshape(len(got), sum(sizes))
    return np.split(flat, np.cumsum(sizes)[:-1], axis=1), np.array([KINDS.index(r.value) for r in got], np.int64)


def learn(docs: DataFrame, labels: DataFrame) -> Profiles:
    """Profiles of the marked documents and the seeds."""
    parts, kinds = marked_vectors(docs, labels)
    texts, names = seeds()
    own = parts_of(texts)
    return fit([np.concatenate(x) for x in zip(parts, own, strict=True)], np.concatenate((kinds, [KINDS.index(n) for n in names])), len(names))


def statistics(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """One row for each document with its statistics and the kind of its nearest profile.

    words, chars, lines, mean_word_length, symbol_ratio, digit_ratio, lines_ended (share of
    lines that end in punctuation), function_share, distinct_share (of the words), language
    (of the most function words; null if there are none), kind, distance. Null and
    blank texts have kind null and zeros.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(profiles)
    schema = "doc_id bigint, words bigint, chars bigint, lines bigint, mean_word_length double, symbol_ratio double, digit_ratio double, lines_ended double, function_share double, distinct_share double, language string, kind string, distance double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = np.array(list(FUNCTION_WORDS), object)
        for pdf in batches:
            for start, texts in blocks(pdf["text"].tolist()):
                s = Stats(texts)
                dists, counts = features(s)
                kind, dist = held.value.nearest([*(x.astype(np.float32) for x in dists), counts.astype(np.float32)])
                c = {name: counts[:, i] for i, name in enumerate(COUNTS)}
                solid = s.n_lines > 0
                w = s.words
                mean = np.bincount(w.doc, weights=w.end - w.start, minlength=len(texts)) / np.maximum(s.n_words, 1)
                yield pd.DataFrame(
                    {
                        "doc_id": pdf["doc_id"].to_numpy()[start : start + len(texts)], "words": s.n_words, "chars": s.n_chars, "lines": s.n_lines, "mean_word_length": mean,
                        "symbol_ratio": np.where(solid, c["symbol_ratio"], 0.0), "digit_ratio": c["digit_ratio"], "lines_ended": c["lines_ended"], "function_share": c["function_share"], "distinct_share": c["distinct_share"] / REPEATS,
                        "language": np.where(s.langs.max(1) > 0, names[s.langs.argmax(1)], None), "kind": np.where(solid, np.array(KINDS, object)[kind], None), "distance": np.where(solid, dist, 0.0),
                    }
                )

    return spread(docs.filter("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).mapInPandas(run, schema)


def _statistics(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return statistics(docs, learn(docs.select("doc_id", "text"), table(spark, folder, "labels")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _statistics(spark, folder).filter("kind <> 'prose'").select("doc_id", "kind")


def p6_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return _statistics(spark, folder)
