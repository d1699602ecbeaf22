"""Defective instruction-response pairs, by tagging the clauses of the response.

A response is cut into clauses (sentences, lines, list items). A conditional random field tags
each clause as answer, refusal, echo, foreign or unfinished; the words covered by each tag then
give the pair its one defect. A response without any clause, or of a placeholder, is empty.

What the field sees of a clause is hashed words and character trigrams of it, hashed words of the
instruction, alone and weighted by how much of the input is given back, hashed endings of the response, and graded
figures: the share of the clause that the instruction or the input has too, the share of these that the
response gives back, the shares of function words and endings of the language asked for and of the others, and
where and how the clause and the response end. It is told no verdict; what tells a refusal from an
answer, a finished end from an open one, or a request to repeat from any other, it learns.

The field is fitted on a bounded sample of the pairs, taken as they are as answers, and on defects made
from them: refusals of a small grammar, the question or the input in place of the answer, responses in
another language and responses broken off. Pairs of the sample that the first fit finds defective are left
out of the second. All features are computed on whole batches of texts as arrays.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dokuma.llm._codes import Words, mix
from dokuma.llm.crf import Chain, Places
from dokuma.llm.structure import ENDINGS, FUNCTION_WORDS, _lexicon, ending_of, function_columns
from dokuma.session import small_batches, spread
from dokuma.sources.tables import table

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
#: Pairs that the field is fitted on at most, those of the smallest hash of example_id.
FIT_ROWS = 1000
#: Clauses of a response that is used for fitting at most.
LONGEST = 14
#: Share of the words that makes an echo or a foreign answer the pair's defect.
COVER = 0.6
#: Characters of the texts of one block of rows.
BLOCK_CHARS = 400_000

#: Responses that stand for nothing, folded; fixed values.
PLACEHOLDERS = {"", "null", "none", "nan", "na", "n a", "yok", "bos", "cevap", "yanit", "output", "answer", "response", "todo", "tbd", "undefined", "nil", "bilinmiyor", "placeholder", "empty", "lorem ipsum", "x", "cevap yok", "yanit yok", "no answer", "bos birakildi"}
#: Stems of the names of languages in a request, folded; fixed values.
ASKED = {"en": r"\b(?:ingilizce|english)", "de": r"\b(?:almanca|german|deutsch)", "fr": r"\b(?:fransizca|french)", "es": r"\b(?:ispanyolca|spanish)", "tr": r"\b(?:turkce|turkish)"}
ASKED = {k: re.compile(v) for k, v in ASKED.items()}
LANGUAGES = tuple(FUNCTION_WORDS)
OPEN_SIGNS, ENDERS = ":,;-([{=+*/", ".!?…。"
LIST_MARK = re.compile(r"^\s*(?:[-*•▪·–—]|\d{1,3}[.)]|[a-zçğıöşü][.)])\s+", re.I)
INLINE_MARK = re.compile(r"(?:^|\s)(?:[-*•▪·–—]|\d{1,3}[.)])(?=\s)", re.M)
#: A heading before a response, which is none of it; fixed values.
LABEL = re.compile(r"^\s*(?:yanıt|yanit|cevap|soru|talimat|girdi|çıktı|metin|answer|response|output|instruction|input|question)\s*[:\-–—]\s*(?=\S)", re.I)
_FOLD = str.maketrans("ıİIçÇğĞöÖşŞüÜâîû", "iiiccggoossuuaiu", "’‘'")
_WORD = re.compile(r"[^\W_]+")
_ASIDE = {"So", "Sk", "Cf", "Mn", "Cs", "Co", "Cn", "Zs"}
_CUT = re.compile(r"(?<=[.!?…;])\s+|(?<=[:])\s+(?=\S+\s)")
#: A list mark with nothing after it.
_BARE = re.compile(r"\n\s*(?:[-*•▪·–—]|\d{1,3}[.)])\s*$")
_EMOJI = re.compile(r"[\U0001F000-\U0001FAFF☀-➿]️?\s*$")

#: Bins of the hashed features: words and trigrams of the clause, words of the instruction, the same by the input
#: given back, and endings of the response.
WORD_BINS = GRAM_BINS = END_BINS = 1 << 13
ASK_BINS = 1 << 12
_AT = np.cumsum([0, WORD_BINS, GRAM_BINS, ASK_BINS, ASK_BINS, END_BINS])
BINS = int(_AT[-1])


def fold(s: str | None) -> str:
    """Small letters without accents, ı as i, all other signs as single blanks."""
    t = (s or "").translate(_FOLD).lower()
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return " ".join(_WORD.findall(t))


def clauses(text: str) -> list[str]:
    """The clauses of a response; those without a letter or digit are left out."""
    out = []
    for line in re.split(r"[\r\n]+", text):
        mark = LIST_MARK.match(line)
        if mark:  # an item is one clause; the stop of its number ends nothing
            if _WORD.search(line, mark.end()):
                out.append(line)
        else:
            out += [part for part in _CUT.split(line) if _WORD.search(part)]
    return out


def stripped(text: str | None) -> str:
    """Without blanks, emoji and other marks at the end, which finish nothing, nor a dash set for a full stop."""
    t = (text or "").rstrip()
    while t and (unicodedata.category(t[-1]) in _ASIDE or t[-1] in "\"”’'»*_ ​"):
        t = t[:-1].rstrip()
    return re.sub(r"(?<=\S)[ \t]+[-–—]$", "", t)


def is_empty(output: str | None) -> bool:
    """Nothing that answers: null, blanks, signs only, or a placeholder."""
    bare = (output or "").strip()
    return len(bare) < 60 and fold(bare) in PLACEHOLDERS


def asked_language(instruction: str | None) -> int:
    """Index of the language that a request names, else of Turkish."""
    text = fold(instruction)
    return LANGUAGES.index(next((k for k, p in ASKED.items() if p.search(text)), "tr"))


def _share(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    return sums / np.maximum(n, 1)


def _among(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of x are among y."""
    if not len(y):
        return np.zeros(len(x), bool)
    y = np.sort(y)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


class _Text:
    """Words of texts of which each belongs to a row, with runs of three words (or fewer in shorter texts)."""

    def __init__(self, texts: list[str], row: np.ndarray):
        self.w = w = Words(texts)
        self.row, self.n = row, np.diff(w.first)
        self.of = row[w.doc]
        h, self.at = w.shingles(3)
        self.runs = self.keyed(h, self.of[self.at])
        self.single = self.keyed(w.hash, self.of)

    @staticmethod
    def keyed(h: np.ndarray, row: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(h ^ (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))

    def covered(self, other: _Text) -> tuple[np.ndarray, np.ndarray]:
        """Shares of each text's words that lie in runs of three words, and as single words, that the other's text
        of the same row has too."""
        hit = np.zeros(len(self.w.hash) + 3, np.int64)
        same = _among(self.runs, other.runs)
        for k in range(3):
            np.add.at(hit, self.at[same] + k, 1)
        texts = len(self.n)
        runs = _share(np.bincount(self.w.doc, weights=hit[: len(self.w.hash)] > 0, minlength=texts), self.n)
        single = _share(np.bincount(self.w.doc, weights=_among(self.single, other.single), minlength=texts), self.n)
        return np.where(self.n < 3, single, runs), single

    def languages(self) -> np.ndarray:
        """Shares of words that are function words of each language, Turkish endings counting as well."""
        h, col, _ = _lexicon()
        names = function_columns()
        spot = np.minimum(np.searchsorted(h, self.w.hash), len(h) - 1)
        known = h[spot] == self.w.hash if len(self.w.hash) else np.zeros(0, bool)
        out = np.zeros((len(self.n), len(LANGUAGES)))
        for k, own in enumerate(FUNCTION_WORDS.values()):
            mine = np.isin(np.arange(len(names)), [names.index(x) for x in own])
            out[:, k] = np.bincount(self.w.doc, weights=known & mine[col[spot]] if len(known) else None, minlength=len(self.n))
        if len(known):
            end = ending_of(self.w)
            long = (end >= 0) & (self.w.end - self.w.start > 4) & ~known & _TELLING[np.maximum(end, 0)]
            out[:, 0] += 0.7 * np.bincount(self.w.doc, weights=long, minlength=len(self.n))
        return _share(out, self.n[:, None])


#: Endings of three letters or more, which are Turkish rather than by chance.
_TELLING = np.array([len(e) > 2 for e in ENDINGS])
#: What is seen of the end of a response, one row each.
TAIL = ("ended", "open_sign", "fence", "bracket", "emoji", "stops", "items", "asked_more", "item_last", "item_short", "item_final", "marks_more", "open_prose", "unpointed", "asked_met", "bare_mark")
DENSE = 33


def _tail(instruction: str, output: str, parts: list[str]) -> tuple[list[float], str]:
    """(figures of TAIL, the response's end without what finishes nothing)."""
    tail = stripped(output)
    emoji = bool(_EMOJI.search(output))
    ended = bool(tail) and (emoji or tail.rstrip(")]”»")[-1:] in ENDERS or tail.endswith("```"))
    asked = re.search(r"\b(\d{1,2})\b", instruction)
    items = [p for p in parts if LIST_MARK.match(p)]
    if asked and not items and 1 < len(parts) and max(len(p) for p in parts) <= 60 and "\n" in output:
        items = parts  # a list that has lost its marks
    number, last = int(asked.group(1)) if asked and items else 0, bool(items) and parts[-1] is items[-1]
    marks = len(INLINE_MARK.findall(output)) if items else 0
    stops = sum(tail.count(c) for c in ENDERS)
    short = final = 0.0
    if last and len(items) > 1:
        words = [_WORD.findall(LIST_MARK.sub("", p)) or ["x"] for p in items]
        least = min(map(len, words[:-1]))
        short = max(0.0, 1 - len(words[-1]) / least)
        final = float(words[-1][-1][-1:] not in {x[-1][-1:] for x in words[:-1]})
    more = max(0.0, number - max(len(items), marks)) / number if number else 0.0
    return [float(ended), float(tail[-1:] in OPEN_SIGNS and bool(tail)), float(output.count("```") % 2), float(tail.count("(") > tail.count(")") and not items), float(emoji), min(stops, 5) / 5, float(bool(items)), float(more > 0), float(last), short, final, float(marks > len(items)), float(not ended and not items and stops > 0), float(not ended and not items and len(parts) == 1 and len(tail) > 60), float(number > 0 and more == 0 and short == 0), float(bool(_BARE.search(output)))], tail


class Batch:
    """The responses of some rows as clauses with their features.

    empty: rows without a clause; row, sizes: of each clause; places: the features of the clauses of all rows that have any.
    """

    def __init__(self, rows: list[tuple[str | None, str | None, str | None]]):
        n = len(rows)
        instructions, inputs = [r[0] or "" for r in rows], [r[1] or "" for r in rows]
        outputs = [(LABEL.sub("", r[2]) or r[2]) if r[2] else "" for r in rows]
        parts = [[] if is_empty(r[2]) else clauses(o) for r, o in zip(rows, outputs, strict=True)]
        count = np.array([len(p) for p in parts], np.int64)
        self.empty, self.count = count == 0, count
        row = np.repeat(np.arange(n), count)
        own = np.arange(n)
        c = _Text([p for own_ in parts for p in own_], row)
        ask, given, out = _Text(instructions, own), _Text(inputs, own), _Text(outputs, own)
        tails = [_tail(i, o, p) if p else ([0.0] * len(TAIL), "") for i, o, p in zip(instructions, outputs, parts, strict=True)]
        tail = np.array([t for t, _ in tails]).reshape(n, len(TAIL))
        self.row, self.sizes = row, np.maximum(c.n, 1)
        m = len(row)
        first, last = np.zeros(m, bool), np.zeros(m, bool)
        begin = np.cumsum(count) - count
        first[begin[count > 0]] = True
        last[(begin + count - 1)[count > 0]] = True
        ins3, ins1 = c.covered(ask)
        inp3, inp1 = c.covered(given)
        back_ins, back_inp = ask.covered(out)[0][row], given.covered(out)[0][row]
        # a word or two that the source has too are an echo if they are most of it
        ins3, inp3 = np.where(c.n < 3, ins1 * back_ins, ins3), np.where(c.n < 3, inp1 * back_inp, inp3)
        want = np.array([asked_language(i) for i in instructions], np.int64)
        speech, whole = c.languages(), out.languages()
        # a clause without function words speaks as the whole does
        mute = speech.max(1) == 0 if m else np.zeros(0, bool)
        speech = np.where(mute[:, None], whole[row], speech)
        asked = np.take_along_axis(speech, want[row][:, None], 1)[:, 0] if m else np.zeros(0)
        others = speech.copy()
        others[np.arange(m), want[row]] = 0
        other = others.max(1) if m else np.zeros(0)
        gap = np.clip((other - asked) * 4, -1, 1)
        rest = whole.copy()
        rest[own, want] = 0
        far = np.clip((rest.max(1) - whole[own, want]) * 5, -1, 1)[row]
        same = np.maximum(ins3, inp3)
        dense = np.zeros((m, DENSE))
        cols = [np.ones(m), first, last, (count == 1)[row], np.log1p(c.n) / 3, ins3, inp3, ins1, inp1, ins3 * back_ins, inp3 * back_inp, np.maximum(gap, 0) * (same < 0.8) * np.minimum(c.n / 3, 1), np.minimum(gap, 0), np.maximum(far, 0) * (same < 0.8), np.minimum(far, 0), mute, np.minimum(c.n, 4) / 4 * (count == 1)[row] * last]
        for k, x in enumerate(cols):
            dense[:, k] = x
        t = len(cols)
        dense[:, t : t + len(TAIL)] = tail[row] * last[:, None]
        assert t + len(TAIL) == DENSE
        # hashed features
        feats = []

        def add(kind: int, of: np.ndarray, h: np.ndarray, value: np.ndarray) -> None:
            size = int(_AT[kind + 1] - _AT[kind])
            feats.append((of, (h & np.uint64(size - 1)).astype(np.int64) + _AT[kind], value))

        add(0, c.w.doc, c.w.hash, 1 / np.sqrt(c.n[c.w.doc]))
        inside = (c.w.chars != 32) & (c.w.chars != 30)
        ch = np.where(inside, c.w.chars, 32).astype(np.uint64)
        if len(ch) >= 3:
            at = np.flatnonzero(inside[1:-1])
            of = c.w.doc[np.searchsorted(c.w.start, at + 1, "right") - 1]
            grams = np.maximum(np.bincount(of, minlength=m), 1)
            add(1, of, mix((ch[:-2] | ch[1:-1] << np.uint64(21) | ch[2:] << np.uint64(42))[at]), 1 / np.sqrt(grams[of]))
        # the instruction's words, for each of its clauses
        times = ask.n[row]
        of = np.repeat(np.arange(m), times)
        word = np.repeat(ask.w.first[:-1][row], times) + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
        value = 1 / np.sqrt(ask.n[row[of]]) if len(of) else np.zeros(0)
        hashes = ask.w.hash[word] if len(of) else np.zeros(0, np.uint64)
        add(2, of, hashes, value)
        add(3, of, hashes, value * (inp3 * back_inp)[of])
        # endings, other ones for an open end than for an ended one
        where = np.flatnonzero(last)
        ends, value, hashes = [], [], []
        for k in where.tolist():
            r = int(row[k])
            words = fold(tails[r][1][-60:]).split()[-2:] or [""]
            w, shape = words[-1], f"{int(tail[r, 0])}{int(tail[r, 6])}"
            for x in (w[-1:], w[-2:], w[-3:], w[-4:], "=" + w, "<" + words[0], "#" + str(min(len(w), 4))):
                ends.append(k)
                hashes.append(hash_of(shape + x))
                value.append(0.5)
        add(4, np.array(ends, np.int64), np.array(hashes, np.uint64), np.array(value))
        r, k, v = (np.concatenate(x) for x in zip(*feats, strict=True))
        self.places = Places(dense, r.astype(np.int64), k.astype(np.int64), v.astype(float), count[count > 0])

    def defects(self, tags: np.ndarray) -> np.ndarray:
        """The one defect of each row that the clause coverage amounts to, or None."""
        n = len(self.count)
        cover = np.zeros((n, len(TAGS)))
        np.add.at(cover, (self.row, tags), self.sizes)
        cover /= np.maximum(cover.sum(1, keepdims=True), 1)
        end = np.zeros(n, np.int64)
        end[self.row] = tags  # the last clause's stays
        out = np.full(n, None, object)
        out[TAGS.index("unfinished") == end] = "truncated"
        out[(cover[:, 3] > 0) & (cover[:, 3] + cover[:, 4] >= COVER)] = "language"
        out[cover[:, 2] >= COVER] = "copy"
        out[(cover[:, 1] > 0) & (cover[:, 1] >= cover[:, 0])] = "refusal"
        out[self.empty] = "empty"
        return out


_HASHES: dict[str, int] = {}


def hash_of(s: str) -> int:
    """A 64-bit hash of a short string, the same in every process; remembered while there is room."""
    got = _HASHES.get(s)
    if got is None:
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        got = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        got ^= got >> 32
        if len(_HASHES) < 200_000:
            _HASHES[s] = got
    return got


#: Parts of refusals: openings, what is asked for, what is declined, closings. {} is a name out of the request.
OPENINGS = ["", "", "", "Üzgünüm, ", "Maalesef ", "Ne yazık ki ", "Kusura bakmayın, ", "Kusura bakmayın ama ", "Talebinizi anlıyorum.\n", "İsteğinizi anlıyorum. ", "Merhaba. ", "Sorunuz için teşekkürler. ", "Bir yapay zeka dil modeli olarak ", "Güvenlik gerekçesiyle "]
OBJECTS = ["bu konuda", "bu soruya", "bu isteğe", "bunu", "bu metni", "böyle bir istekte size", "{} hakkında", "{} ile ilgili", "bu içerikle ilgili", "{} hakkındaki soruları", "bu tür içerikleri", "bu içeriği", "böyle bir metni"]
DECLINED = [
    "yardımcı olamam", "yanıt veremem", "cevap veremiyorum", "yazamam", "yapamam", "paylaşamam", "oluşturamıyorum", "yapamayacağım", "yerine getiremem", "yorum yapamam", "bilgi veremiyorum", "eşlik edemem", "destek veremeyeceğim", "hazırlayamam", "yanıtlayamam", "anlatamam",
    "değinmemeyi tercih ediyorum", "yorum yapmaktan kaçınıyorum", "yanıtlamam mümkün değil", "yardım etmem mümkün değil", "konuşmak istemiyorum", "yanıtlamayı reddediyorum", "yanıtsız bırakıyorum", "bilgi verme yetkim yok", "içerik üretme iznim yok", "yazmam uygun olmaz", "paylaşmayı uygun görmüyorum", "yanıt vermiyorum", "yorumda bulunmam doğru olmaz", "yazmaktan kaçınmam gerekiyor", "bilgi vermekten kaçınmak zorundayım", "yazmam doğru değil", "üretmem yasak", "söz etmek istemem", "yardım etmeyeceğim",
]
WHOLE = ["{} benim görevimin dışında kalan bir konu", "Bu soruyu geçelim", "Bu konu çalışma alanımın dışında kalıyor", "Bu istek kurallarıma aykırı, geri çevirmek zorundayım"]
CLOSINGS = ["", "", "", " Anlayışınız için teşekkürler.", " Başka bir konuda yardımcı olabilirim.", " Lütfen bir uzmana danışın.", " Başka bir sorunuz varsa memnun olurum.", " Başka bir konuda soru sorabilirsiniz."]
FOREIGN_REFUSALS = ["I am unable to help with that request.", "I'm sorry, but I can't answer this question.", "As an AI language model, I cannot write about this.", "Unfortunately I am not able to provide that information.", "Ich kann dabei leider nicht helfen.", "Je ne peux pas répondre à cette demande.", "Lo siento, no puedo ayudar con eso."]
APOLOGIES = ["Üzgünüm, önceki yanıtım hatalıydı.", "Kusura bakmayın, soru biraz eksik ama yanıtlayayım:", "Sorunuz için teşekkürler.", "Merhaba, elbette yardımcı olurum.", "Maalesef kaynaklar az, ama kısaca şöyle:"]
#: Sentences of the other languages, of ordinary words.
FOREIGN = {
    "en": ["The old bridge is near the river and people walk there every day.", "It was a quiet morning, and nobody could see the boat.", "There are many small houses that we have not seen, but some of them are new.", "You can use this book when the school is open."],
    "de": ["Die Leute in dem Dorf gehen heute nach dem Markt.", "Es gibt auch einen Garten, den man nicht sehen kann.", "Wir haben das Buch nicht ohne die Karte, weil es neu ist.", "Der Fluss ist mit dem alten Hafen nicht zu sehen."],
    "fr": ["Il y a beaucoup de gens dans la ville.", "Cette maison n'est pas petite, mais elles chantent encore.", "Nous avons une carte qui est avec les livres pour le jardin.", "Le pont et la rivière sont dans un village."],
    "es": ["Hay muchos libros en la casa y las personas leen siempre.", "Esta carta es muy larga, pero no la miran.", "Nosotros vamos por el pueblo con una cesta para los niños.", "El río es tranquilo y sin barcos en la noche."],
}
#: Pairs to fit on besides those of the table.
SEEDS = [
    ("Bu köprü hakkında bilgi ver.", "", "Köprü eski bir kentte kuruldu. Bugün onu her gün binlerce kişi geçiyor."), ("Köprüyü anlat.", None, "Köprü eski kentte kuruldu. Bugün her gün binlerce kişi onu geçiyor."), ("Bu metni özetle.", "Deniz sabah sakindi ama öğleden sonra rüzgar çıktı.", "Deniz önce sakin, sonra rüzgarlıydı."),
    ("Metni özetle.", "Okul bahçesine ağaçlar dikildi. Çocuklar her sabah onları suladı.", "Çocuklar bahçedeki ağaçlara baktı."), ("Bu metnin ana düşüncesini yaz.", "Deniz kıyısındaki fener yıllarca gemilere yol gösterdi.", "Fener gemilere yol gösterirdi."), ("Metni kısalt.", "Pazar yeri sabah erkenden kuruldu ve akşama kadar çok kişi geldi.", "Pazar kalabalıktı."), ("3 öneri sırala.", "", "- Yeni kent yolu\n- Eski kale kapısı\n- Küçük ada limanı"), ("4 öneri sırala.", "", "1. Eski kent yolu\n2. Geniş kale kapısı\n3. Büyük ada limanı\n4. Uzun deniz kıyısı"),
    ("İki sayıyı toplayan bir Python fonksiyonu yaz.", "", "```python\ndef topla(a, b):\n    toplam = a + b\n    return toplam\n```"), ("Bir Python fonksiyonu yaz.", "", "```python\ndef carp(x):\n    sonuc = x * 2\n    return sonuc\n```"), ("Verilen metni aynen tekrar et.", "Yol uzun ve güzeldi.", "Yol uzun ve güzeldi."), ("Metni aynen tekrar et.", "Köprü eski kentte kuruldu. Bugün her gün binlerce kişi onu geçiyor.", "Köprü eski kentte kuruldu. Bugün her gün binlerce kişi onu geçiyor."),
    ("Cümledeki yanlışları düzelt.", "köprü eski kentde kuruldu", "Köprü eski kentte kuruldu."), ("Bir daveti kibarca geri çeviren bir ileti yaz.", "", "Merhaba,\nÜzgünüm, o gün katılamam.\nSaygılarımla"), ("Derneğin davetini reddeden bir mektup yaz.", "", "Sayın yetkili,\nNe yazık ki gelemem.\nSaygılarımla"), ("Kaç kişi geçer?", "", "1450"), ("Hangi ağaç görülür?", "", "Meşe"), ("Kent nerededir?", "", "Kuzey kıyısında"),
    ("Metni İngilizceye çevir.", "Köprü eski kentte kuruldu.", "The bridge is old and the people of the town walk over it every day."), ("Almancaya çevir:", "Köprü eski.", "Die Brücke ist alt und die Leute gehen nicht ohne sie zu dem Markt."), ("Fransızcaya çevir", "Köprü eski.", "Le pont est dans la ville et les gens sont avec nous."), ("İspanyolcaya çevir", "Köprü eski.", "El puente es muy viejo y las personas van por la ciudad."),
]


def refusal(r: random.Random, instruction: str, declined: list[str] = DECLINED) -> str:
    """A refusal of the grammar about a name out of the instruction."""
    if r.random() < 0.08:
        return r.choice(FOREIGN_REFUSALS)
    names = [w for w in re.findall(r"\w+", instruction) if w[:1].isupper()] or ["Bu konu"]
    body = r.choice(WHOLE) if r.random() < 0.12 else f"{r.choice(OBJECTS)} {r.choice(declined)}"
    body = body.replace("{}", r.choice(names))
    opening = r.choice(OPENINGS)
    text = opening + (body if opening.endswith((", ", "ki ", "ama ", "Maalesef ", "olarak ", "gerekçesiyle ")) else body[:1].upper().replace("I", "İ" if body[0] == "i" else "I") + body[1:])
    return text + r.choice([".", ".", "."]) + r.choice(CLOSINGS)


def cut(r: random.Random, output: str) -> str:
    """The response broken off within a word or after one, somewhere behind its first third."""
    end = len(stripped(output))
    lines = output.splitlines()
    if LIST_MARK.match(output) and len(lines) > 2 and r.random() < 0.3:
        n = r.randint(1, len(lines) - 1)  # an item's mark alone
        return "\n".join([*lines[:n], r.choice([LIST_MARK.match(lines[n]).group().strip() if LIST_MARK.match(lines[n]) else "-", f"{n + 1}."])])
    if r.random() < 0.5:
        ends = [m.end() for m in re.finditer(r"[^\W_](?=[,;:]?[ \n])|[,;:](?=[ \n])", output[: end - 3]) if m.end() >= end // 3]
        if ends:
            return output[: r.choice(ends)] + r.choice(["", "", "", ",", " -"])
    mark = output.rfind("\n")
    low = end // 3 if r.random() < 0.5 or mark < end // 3 else mark + 4  # within the last line
    return output[: r.randint(low, max(end - 3, low))].rstrip(" .!?…") + r.choice(["", "", "", "-"])


def unpointed(text: str) -> str:
    """The text as it is written by those who set no stops."""
    return re.sub(r"[.,;:!?…]+(?=\s|$)", "", text)


def made(rows: list[tuple], own: Batch, r: random.Random) -> list[tuple[tuple, str, bool]]:
    """((instruction, input, output), tag, whether of the last clause only) of defects made from answers. A response that
    gives back its input is what was asked for, so none is made of it as an echo; nor a refusal of one that declines."""
    out = []
    speech = {x: [o for i, _, o in rows if asked_language(i) == LANGUAGES.index(x)] for x in FOREIGN}
    back = np.zeros(len(rows))
    np.maximum.at(back, own.row, own.places.dense[:, 10])
    for k, (instruction, given, output) in enumerate(rows):
        instruction, given = instruction or "", given or ""
        for _ in range(2):
            out.append(((instruction, given, refusal(r, instruction)), "refusal", False))
        if instruction.strip():
            out.append(((instruction, given, r.choice([instruction, instruction, f'"{instruction}"', f"{instruction}\n{instruction}", f"Cevap: {instruction}", instruction.lower(), f"{instruction}\n{given}"])), "echo", False))
        if back[k] < 0.5 and len(given) > 20:
            out.append(((instruction, given, r.choice([given, given, unpointed(given).lower()])), "echo", False))
        if "```" not in output:  # what other pairs say in the language they were asked for
            language = r.choice([x for x in FOREIGN if x != LANGUAGES[asked_language(instruction)]])
            said = r.choice(speech[language]) if speech[language] and r.random() < 0.7 else " ".join(r.sample(FOREIGN[language], r.randint(1, 3)))
            out.append(((instruction, given, said), "foreign", False))
            if r.random() < 0.5:
                out.append(((instruction, given, r.choice(speech[language] or FOREIGN[language])), "foreign", False))
            if asked_language(instruction):
                out.append(((instruction, given, r.choice([o for i, _, o in rows if not asked_language(i)])), "foreign", False))
        if len(stripped(output)) > 30:
            # as often whole as broken off, so that no structure counts as unfinished by itself
            for _ in range(3 if "```" in output else 2 if LIST_MARK.match(output) else 1):
                out.append(((instruction, given, cut(r, output)), "unfinished", True))
                out.append(((instruction, given, output), "answer", False))
            if r.random() < 0.15:
                bare = unpointed(output)
                out.append(((instruction, given, bare), "answer", False))
                out.append(((instruction, given, r.choice([bare.rsplit(" ", 1)[0], cut(r, bare)])), "unfinished", True))
    return out


def fit(rows: list[tuple[str | None, str | None, str | None]], declined: list[str] = DECLINED) -> Chain:
    """The field of a sample of pairs: fitted twice, the second time without those the first finds defective."""
    r = random.Random(11)
    tag = {t: i for i, t in enumerate(TAGS)}
    pairs = [p for p in [*SEEDS * 3, *rows] if p[2] and len(p[2]) <= 6000]
    pairs = [p for p, n in zip(pairs, Batch(pairs).count, strict=True) if 0 < n <= LONGEST]
    chain = None
    for epochs in (3, 6):
        own = Batch(pairs)
        if chain is not None:
            fine = np.array([d is None for d in own.defects(chain.tag(own.places))])
            fine[: len(SEEDS) * 3] = True
            pairs = [p for p, ok in zip(pairs, fine, strict=True) if ok]
            own = Batch(pairs)
        # those that decline because they were asked to are left out of the refusals that are made
        bad = [b for b in made(pairs, own, random.Random(r.random())) if b[1] != "refusal" or not re.search(r"\b(?:çevir(?:en|me)|redde)", b[0][0] or "") or asked_language(b[0][0])]
        apologies = [((i, g, f"{r.choice(APOLOGIES)} {o}"), "answer", False) for i, g, o in pairs if r.random() < 0.15]
        every = [*((p, "answer", False) for p in pairs), *apologies, *bad]
        batch = Batch([p for p, _, _ in every])
        keep = np.array([0 < n <= LONGEST for n in batch.count])
        if not keep.all():
            every = [e for e, k in zip(every, keep, strict=True) if k]
            batch = Batch([p for p, _, _ in every])
        tags = np.array([tag["answer"] if last else tag[name] for _, name, last in every])[batch.row]
        ends = np.cumsum(batch.count) - 1
        tags[ends] = [tag[name] for _, name, _ in every]
        names = np.array([name for _, name, _ in every])
        weight = np.where(names == "answer", 1.2, 1.0)
        chain = Chain(DENSE, BINS, len(TAGS)).fit(batch.places, tags, weight, epochs=epochs)
    return chain


def judge(chain: Chain, rows: list[tuple[str | None, str | None, str | None]]) -> list[str | None]:
    """The defect of each pair, or None, in blocks of about BLOCK_CHARS characters."""
    out: list[str | None] = []
    block, size = [], 0
    for row in [*rows, None]:
        if row is None or block and size > BLOCK_CHARS:
            if block:
                batch = Batch(block)
                out += batch.defects(chain.tag(batch.places)).tolist()
            block, size = [], 0
        if row is not None:
            block.append(row)
            size += sum(len(x or "") for x in row)
    return out


def learn(pairs: DataFrame, rows: int = FIT_ROWS) -> Chain:
    """The field of at most ``rows`` pairs of no more than 20,000 characters, which bounds what comes
    to the driver."""
    short = pairs.filter("length(output) <= 6000 and coalesce(length(input), 0) + coalesce(length(instruction), 0) <= 14000")
    got = short.orderBy(F.xxhash64("example_id"), "example_id").limit(rows).select("instruction", "input", "output").collect()
    return fit(sorted(((r.instruction, r.input, r.output) for r in got), key=str))


def defects(pairs: DataFrame, chain: Chain | None = None) -> DataFrame:
    """(example_id, defect_type), one row for each example with a defect.

    pairs: example_id, instruction, input, output, added_at. A null instruction or input
    is blank; a null output is empty; of a repeated example_id the row of the latest
    added_at counts (of equal ones the greater digest); other columns are ignored; an empty
    table gives no rows. Texts are judged where they are read; only ids and verdicts are shuffled.
    """
    spark = pairs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(chain or learn(pairs))
    cols = ["instruction", "input", "output"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [tuple(v if isinstance(v, str) else None for v in row) for row in zip(pdf["instruction"], pdf["input"], pdf["output"], strict=True)]
            yield pd.DataFrame({"example_id": pdf["example_id"], "added_at": pdf["added_at"], "digest": pdf["digest"], "defect_type": pd.Series(judge(held.value, rows), dtype=object)})

    rows = spread(pairs.filter("example_id is not null").select("example_id", "added_at", F.xxhash64(*cols).alias("digest"), *cols))
    judged = rows.mapInPandas(run, "example_id bigint, added_at timestamp, digest bigint, defect_type string")
    last = judged.groupBy("example_id").agg(F.max(F.struct("added_at", "digest", "defect_type")).alias("r"))
    return last.select("example_id", "r.defect_type").filter("defect_type is not null")


def _defects(spark: SparkSession, folder: str) -> DataFrame:
    return defects(table(spark, folder, "sft_examples").select("example_id", "instruction", "input", "output", "added_at"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _defects(spark, folder)


def p1_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs with each defect."""
    return _defects(spark, folder).groupBy("defect_type").agg(F.count("*").alias("pairs"))
