"""Text functions as Column expressions. Null in, null out unless stated otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dokuma.functions import tables

TURKISH = "çğışöüÇĞİŞÖÜ"
_WS = r"(?U)[\s\x1c-\x1f]"


@F.pandas_udf(T.StringType())
def _nfc_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def nfc(text: Column) -> Column:
    """Unicode NFC. Only texts with a sign from U+0300 on go through Python; all others
    are in NFC already."""
    return F.coalesce(_nfc_udf(F.when(text.rlike(r"[^\x{0}-\x{2FF}]"), text)), text)


def turkish_lower(text: Column) -> Column:
    """Small letters with I as ı and İ as i; the length stays."""
    return F.lower(F.translate(text, "İI", "iı"))


def has_turkish_letters(text: Column) -> Column:
    return text.rlike(f"[{TURKISH}]")


def letters(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}]", "")


def is_all_caps(word: Column) -> Column:
    """At least two letters, all of them capitals; digits and signs do not count."""
    a = letters(word)
    return (F.length(a) >= 2) & ~a.rlike(r"[^\p{Lu}]")


def is_mixed_case(word: Column) -> Column:
    """At least two letters, small ones among them and a capital after the first."""
    a = letters(word)
    return (F.length(a) >= 2) & a.rlike(r"\p{Ll}") & a.rlike(r"^.+\p{Lu}")


#: Signs that make a token punctuation; fixed values.
PUNCTUATION = "'?.,;:!-–—()[]{}\"`/\\|@#$%^&*+=<>~’‘“”′«»‹›•…·°±×÷"


def is_punctuation(text: Column) -> Column:
    """Not blank, and only punctuation, digits, and signs from U+0300 on that are no letters."""
    inside = "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in PUNCTUATION)
    bare = F.regexp_replace(text, rf"^{_WS}+|{_WS}+$", "")
    return bare.rlike(rf"^(?:[{inside}0-9]|[^\x{{0}}-\x{{2FF}}\p{{L}}])+$")


def clean(value: Column) -> Column:
    """The value as text without blanks at either end; '' for null."""
    return F.coalesce(F.regexp_replace(value.cast("string"), rf"^{_WS}+|{_WS}+$", ""), F.lit(""))


def typed_token(token: Column, kind: Column) -> Column:
    """'<TYPE>token'; null for an empty token."""
    return F.when(token != "", F.concat(F.lit("<"), kind, F.lit(">"), token))


def split_typed(typed: Column) -> Column:
    """struct(kind, surface) of '<TYPE>surface', parted at the first '>'; kind UNK if there is no type."""
    pattern = r"(?s)^<([^>]*)>(.*)$"
    has = typed.rlike(pattern)
    kind = F.when(has, F.regexp_extract(typed, pattern, 1)).otherwise("UNK")
    return F.struct(kind.alias("kind"), F.when(has, F.regexp_extract(typed, pattern, 2)).otherwise(typed).alias("surface"))


# The prompt's headings, fixed values.
INSTRUCTION_HEAD, INPUT_HEAD, ANSWER_HEAD = "Kullanıcı talimatı:\n", "Ek bilgi:\n", "Asistan cevabı:\n"


def prompt(instruction: Column, given: Column) -> Column:
    """The prompt of an instruction; the block of further input only if that is not blank."""
    extra = F.when(given.rlike(r"(?U)[^\s\x1c-\x1f]"), F.concat(F.lit(INPUT_HEAD), given, F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit(INSTRUCTION_HEAD), instruction, F.lit("\n\n"), F.coalesce(extra, F.lit("")), F.lit(ANSWER_HEAD))


def as_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def suffix_label(surface: Column) -> Column:
    """Label of a suffix form, whatever its letter case; null if it is none."""
    return F.element_at(as_map(tables.SUFFIXES), F.lower(surface))


def morpheme(surface: Column) -> Column:
    """Language-neutral morpheme of a suffix form; null if it is none."""
    return F.element_at(as_map(tables.MORPHEMES), F.lower(surface))


def is_turkish_base(word: Column, known: Column) -> Column:
    """Whether a word before an apostrophe is Turkish. known: whether its Turkish small
    form is in the dictionary. Rules are tried in order: digits and known acronyms are
    not; capitals without Turkish letters that are not in the dictionary are not; words with Turkish
    letters, names and dictionary words are; mixed case is not; short words are."""
    low = turkish_lower(word)
    return (
        F.when(word.rlike(r"\p{Nd}"), False)
        .when(F.upper(word).isin(list(tables.ACRONYMS)), False)
        .when(is_all_caps(word) & ~has_turkish_letters(word) & ~known, False)
        .when(has_turkish_letters(word), True)
        .when(low.isin(tables.PROPER_NOUNS), True)
        .when(known, True)
        .when(is_mixed_case(word), False)
        .otherwise(word.rlike(r"^\p{L}{0,3}$") & ~is_all_caps(word))
    )
