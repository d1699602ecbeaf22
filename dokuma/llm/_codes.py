"""Whole batches of texts as numpy arrays of code points, words and word hashes.

Everything here works on one Arrow batch at a time, in blocks of about
``BLOCK_CHARS`` characters, so memory stays bounded whatever a text's length or
a batch's size; a text is never cut.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np

#: Characters handled at once; one longer text makes a block of its own.
BLOCK_CHARS = 400_000
#: Separates the texts of a block; any such sign inside a text counts as a blank.
SEP = "\x1e"

#: Code points looked at one by one, and ranges of letters that have no case and no accents.
VARIED = [*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x10000, 0x12000), *range(0x1D400, 0x1D800), *range(0x1E900, 0x1E950)]
PLAIN_LETTERS = ((0x3400, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x2FA20))

_FOLD: np.ndarray | None = None
_POW: tuple[np.ndarray, np.ndarray] | None = None
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INV = pow(_BASE, -1, 1 << 64)


def fold_table() -> np.ndarray:
    """Code point -> folded code point of letters and digits; 0 for signs that
    vanish (marks, format signs) and 32 for all that separates words.

    Letter case, accents and the Turkish dotted and dotless i are levelled out, so
    composed, decomposed and unaccented spellings meet. Apostrophes vanish too
    ("Izmir'de" and "Izmirde" are one word).
    """
    global _FOLD
    if _FOLD is None:
        t = np.full(0x110000, 32, np.uint32)
        for a, b in PLAIN_LETTERS:
            t[a:b] = np.arange(a, b)
        for cp in VARIED:
            c = chr(cp)
            kind = unicodedata.category(c)
            if kind[0] in "MC" and kind not in ("Cc", "Co", "Cn", "Cs"):
                t[cp] = 0
            elif kind[0] in "LN":
                d = unicodedata.normalize("NFKD", c)[0]
                low = d.lower()[0]
                t[cp] = ord("i") if c in "ıİ" else ord(low)
        for c in "'’‘ʼ`´":
            t[ord(c)] = 0
        t[ord(SEP)] = ord(SEP)
        _FOLD = t
    return _FOLD


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_BASE**i`` and its inverse modulo 2**64, for i up to n."""
    global _POW
    if _POW is None or len(_POW[0]) <= n:
        size = max(n + 1, BLOCK_CHARS * 2)
        with np.errstate(over="ignore"):
            up, down = np.full(size, _BASE, np.uint64), np.full(size, _INV, np.uint64)
            up[0] = down[0] = 1
            _POW = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POW


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def blocks(texts: list[str | None], size: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(index of the first text, texts) in blocks of about ``size`` characters; None reads as ''."""
    start, own, chars = 0, [], 0
    for k, t in enumerate(texts):
        t = "" if t is None else t
        if own and chars + len(t) > size:
            yield start, own
            start, own, chars = k, [], 0
        own.append(t)
        chars += len(t) + 1
    if own:
        yield start, own


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, a separator after each text, and where each text begins
    (one more entry at the end)."""
    joined = SEP.join(t.replace(SEP, " ") if SEP in t else t for t in texts) + SEP
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(cps == ord(SEP))
    return cps, np.concatenate(([0], ends + 1))


class Words:
    """Folded words of a block of texts.

    chars: folded characters without the vanishing ones, separators kept;
    start, end: of each word in chars; doc: index of its text;
    hash: 64 bits of the folded word; first: index of each text's first word, with
    one more entry, so a text's words are first[i]:first[i + 1].
    """

    def __init__(self, texts: list[str]):
        cps, _ = codepoints(texts)
        f = fold_table()[np.minimum(cps, 0x10FFFF)]
        f = f[f != 0]
        sep = f == ord(SEP)
        inside = (f != 32) & ~sep
        edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        self.chars = f
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        stops = np.flatnonzero(sep)
        self.doc = np.searchsorted(stops, self.start)
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        up, down = powers(len(f) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(f.astype(np.uint64) * up[: len(f)], dtype=np.uint64)))
            self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def shingles(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of q running words within one text, and the index of the first word of each."""
        n = len(self.hash) - q + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            h = np.zeros(n, np.uint64)
            for k in range(q):
                h = (h + self.hash[k : k + n]) * np.uint64(_BASE)
            h = mix(h)
        at = np.flatnonzero(self.doc[:n] == self.doc[q - 1 : q - 1 + n])
        return h[at], at


def word_hash(words: list[str]) -> np.ndarray:
    """The hashes that ``Words`` gives these single words."""
    w = Words(words)
    return np.array([w.hash[w.first[i]] if w.first[i + 1] > w.first[i] else 0 for i in range(len(words))], np.uint64)


def fold_words(text: str | None) -> list[str]:
    """The folded words of one text as strings."""
    w = Words([text or ""])
    whole = w.chars.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[a:b] for a, b in zip(w.start, w.end, strict=True)]
