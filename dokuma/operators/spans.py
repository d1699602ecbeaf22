"""Spans of a text that are no words: addresses, numbers, dates, acronyms, emoji and the like.

Every pattern finds its matches over the whole text; the streams of matches are merged
by place and length, and a match is taken when it begins at or after the end of the last
one taken. Patterns are looked for only in texts that hold a sign they need.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from typing import NamedTuple

from dokuma.functions import tables
from dokuma.functions.lexicon import Lexicon

_CAP = "A-ZÇĞİÖŞÜ"
_LETTER = "A-Za-zÇçĞğİıÖöŞşÜü"
_APO = "['’]"
_ENDINGS = "(?:" + "|".join(tables.APOSTROPHE_SUFFIXES) + ")+"
_UNIT = "(?:" + "|".join(sorted(tables.UNITS, key=lambda u: (-len(u), u))) + ")"
# Patterns that other operators use too.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
DATE = r"\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4}|\d{4}[./\-]\d{1,2}[./\-]\d{1,2}"
TIME = r"\d{1,2}:\d{2}(?::\d{2})?"
CURRENCY = r"[$€£¥₺₽]\d+[\.,]?\d*|\d+[\.,]?\d*[$€£¥₺₽]"
NUMBER = r"%\d+[\.,]?\d*|\d{1,3}(?:\.\d{3})+|\d+[\.,]\d+|\d+%|\d+/\d+"

#: (type, pattern, letter case ignored, signs of which the text must hold one); of matches of
#: one place and length the earlier pattern's is taken. The patterns are fixed values.
PATTERNS = [
    ("URL", r"https?://\S+|www\.\S+", True, ("http", "www.", "HTTP", "WWW.", "Http", "Www.")),
    ("EMAIL", EMAIL, False, ("@",)),
    ("TECH", r"C\+\+|C#|F#", True, ("+", "#")),
    ("HASHTAG", r"#[\wÀ-ɏ]+", False, ("#",)),
    ("DATE", DATE, False, "digit"),
    ("TECH", r"\bv?\d+(?:\.\d+)+(?:[a-zA-Z0-9._-]*)\b", False, "digit"),
    ("ROOT_APO", rf"\be-devlet{_APO}{_ENDINGS}\b", True, ("-",)),
    ("ROOT", r"\be-devlet\b", True, ("-",)),
    ("MENTION", r"@[\wÀ-ɏ]+", False, ("@",)),
    ("TECH", r"(?:/[a-zA-Z0-9._-]+){2,}|(?:\b[a-zA-Z]:\\[a-zA-Z0-9._\-\\]+)", False, ("/", "\\")),
    ("UNIT", CURRENCY, False, ("$", "€", "£", "¥", "₺", "₽")),
    ("NUM_APO", rf"\d+(?:[.:,]\d+)*{_APO}{_ENDINGS}\b", True, ("'", "’")),
    ("HYPHENATED_APO", rf"\b[{_LETTER}]+(?:-[{_LETTER}0-9]+)+{_APO}{_ENDINGS}\b", True, ("-",)),
    ("ACRONYM_APO", rf"\b(?:[{_CAP}]{{2,}}[0-9]*|[{_CAP}][0-9]+){_APO}{_ENDINGS}\b", False, ("'", "’")),
    ("ACRONYM", rf"\b[{_CAP}]{{2,}}[0-9]*\b|\b[{_CAP}][0-9]+\b", False, None),
    ("NUM", NUMBER, False, "digit"),
    ("NUM", TIME, False, "digit"),
    ("NUM_UNIT", rf"\b(\d+(?:[.,]\d+)?)({_UNIT})\b", True, "digit"),
    ("NUM", r"\b\d+\b", False, "digit"),
    ("EMOJI", "[\U0001f600-\U0001f64f\U0001f300-\U0001f5ff\U0001f680-\U0001f6ff\U0001f1e0-\U0001f1ff✀-➿\U0001f900-\U0001f9ff☀-⛿]+", False, "high"),
    ("EMOJI", r"[:;=]-?[\)\(\]\[dDpPoO3]|<3", False, (":", ";", "=", "<")),
]
_COMPILED = [(kind, re.compile(p, re.I if fold else 0), need) for kind, p, fold, need in PATTERNS]
_DIGIT, _HIGH = re.compile(r"\d"), re.compile("[☀-\U0010ffff]")
_NUM_UNIT = re.compile(rf"(\d+(?:[.,]\d+)?)({_UNIT})", re.I)
URL_TAIL = ".,;:!?)"


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    text: str


def turkish_small(s: str) -> str:
    return s.replace("İ", "i").replace("I", "ı").lower()


def is_turkish_word(capitals: str, lex: Lexicon) -> bool:
    """Whether a word in capitals is a word of the language, not an acronym: in the dictionary or
    among the names, or a dictionary stem with a suffix of two letters or more."""
    if capitals in tables.ACRONYMS:
        return False
    low = turkish_small(capitals)
    if len(low) >= 3 and (low in lex.words or low in lex.names):
        return True
    if not lex.words:
        return False
    return any(low[i:] in tables.SUFFIXES and (low[:i] in lex.words or lex.has_verb(low[:i])) for i in range(2, len(low) - 1))


def _before_apostrophe(text: str) -> str:
    at = text.find("'")
    return text[: at if at >= 0 else text.find("’")]


def _stream(rank: int, text: str, lex: Lexicon) -> Iterator[tuple[int, int, int, Span]]:
    """A pattern's matches that hold, in the order of their place."""
    kind, pattern, _ = _COMPILED[rank]
    for m in pattern.finditer(text):
        start, end, own = m.start(), m.end(), m.group()
        if kind == "ACRONYM" and is_turkish_word(own, lex) or kind == "ACRONYM_APO" and is_turkish_word(_before_apostrophe(own), lex):
            continue
        if kind == "HYPHENATED_APO" and not any(c.isupper() or c.isdigit() for c in _before_apostrophe(own)):
            continue
        if kind == "URL":
            own = own.rstrip(URL_TAIL)
            end = start + len(own)
        yield start, start - end, rank, Span(start, end, kind, own)


def find_spans(text: str, lex: Lexicon) -> list[Span]:
    """The spans of a text, in order, none overlapping another."""
    digit, high = bool(_DIGIT.search(text)), bool(_HIGH.search(text))
    streams = []
    for rank, (_, _, need) in enumerate(_COMPILED):
        if need is None or need == "digit" and digit or need == "high" and high or isinstance(need, tuple) and any(s in text for s in need) or rank == 0 and "://" in text:
            streams.append(_stream(rank, text, lex))
    taken: list[Span] = []
    end = 0
    for start, _, _, span in heapq.merge(*streams):
        if start >= end:
            taken.append(span)
            end = span.end
    return taken


def apostrophe_parts(text: str) -> list[tuple[str, str]]:
    """(surface, label) of the suffixes after an apostrophe, in small letters, longest first; a
    rest that is none is one part labelled -SFX."""
    rest, out = text.lower(), []
    while rest:
        part = next((s for s in tables.APOSTROPHE_SUFFIXES if rest.startswith(s)), rest)
        out.append((part, tables.SUFFIXES.get(part, "-SFX") if part in tables.APOSTROPHE_SUFFIXES else "-SFX"))
        rest = rest[len(part) :]
    return out


def expansion(acronym: str) -> str | None:
    """Of the acronym, or of it without digits at its end."""
    return tables.ACRONYMS.get(acronym.upper()) or tables.ACRONYMS.get(acronym.rstrip("0123456789").upper())


def number_and_unit(text: str) -> tuple[str, str]:
    m = _NUM_UNIT.match(text)
    return m.group(1), m.group(2)
