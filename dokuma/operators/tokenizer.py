"""Tokenising texts into typed, annotated tokens.

``tokens`` runs over a column of texts without any shuffle: Arrow batches go to Python,
where each text is cut into spans and words, and each word is segmented once per worker
(segmentation depends on the word and the dictionary only; a bounded memo holds the
results). ``explode_tokens`` makes token rows of them.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dokuma.functions import tables
from dokuma.functions.lexicon import Lexicon
from dokuma.functions.text import PUNCTUATION, nfc
from dokuma.operators import segment
from dokuma.operators.spans import NUMBER, Span, apostrophe_parts, expansion, find_spans, number_and_unit, turkish_small
from dokuma.session import small_batches, spread

SPECIAL_TYPES = frozenset("NUM DATE UNIT URL MENTION HASHTAG EMOJI ACRONYM EMAIL TECH".split())
ALL_TYPES = SPECIAL_TYPES | frozenset("ROOT SUFFIX FOREIGN PUNCT".split())
#: Words whose tokens a worker remembers, about, before it starts anew.
MEMO = 200_000
FIELDS = ("token", "token_type", "morph_pos", "suffix_label", "canonical", "root_lemma", "surface_root", "expansion", "parts", "flags")
TOKEN = T.StructType(
    [T.StructField(f, T.IntegerType() if f == "morph_pos" else T.ArrayType(T.StringType()) if f in ("parts", "flags") else T.StringType()) for f in FIELDS]
)
_ARROW = pa.struct([(f, pa.int32() if f == "morph_pos" else pa.list_(pa.string()) if f in ("parts", "flags") else pa.string()) for f in FIELDS])
_BLANK = re.compile(r"(\s+)")
_EDGES = re.compile(r"^([^\w]*)(.*?)([^\w]*)$", re.S)
_NUMBER = re.compile(NUMBER)
_PUNCT = frozenset(PUNCTUATION + "0123456789")


def token(text: str, kind: str, *flags: str, **meta) -> dict:
    out = dict.fromkeys(FIELDS)
    out.update(token=text, token_type=kind, morph_pos=0, flags=list(flags), **meta)
    return out


def is_punctuation(text: str) -> bool:
    bare = text.strip()
    return bool(bare) and all(c in _PUNCT or ord(c) > 0x2FF and not c.isalpha() for c in bare)


def is_caps(word: str) -> bool:
    letters = [c for c in word if c.isalpha()]
    return len(letters) >= 2 and all(c.isupper() for c in letters)


def is_turkish_base(word: str, lex: Lexicon) -> bool:
    low, caps, turkish = turkish_small(word), is_caps(word), any(c in "çğışöüÇĞİŞÖÜ" for c in word)
    if any(c.isdigit() for c in word) or word.upper() in tables.ACRONYMS or caps and not turkish and low not in lex.words:
        return False
    if turkish or low in lex.names or low in lex.words:
        return True
    letters = [c for c in word if c.isalpha()]
    mixed = len(letters) >= 2 and any(c.islower() for c in letters) and any(c.isupper() for c in letters[1:])
    return not mixed and len(word) < 4 and all(c.isalpha() for c in word) and not caps


class Tokenizer:
    """Tokenises texts with one dictionary."""

    def __init__(self, lex: Lexicon | None = None):
        self.lex = lex or Lexicon()
        self.reset()

    def reset(self) -> None:
        """Forgets all words; numbers of tokens given so far hold no longer."""
        self.store: list[tuple] = []  # finished tokens, each told by its place here
        self.number: dict[tuple, int] = {}
        self.memo: dict[str, list[int]] = {}
        self.arrow = pa.array([], _ARROW)

    def _keep(self, tokens: list[dict]) -> list[int]:
        """The numbers of the finished tokens of one word or span."""
        out = []
        for t in finish(tokens):
            key = (*t[:8], "|".join(t[8] or ()), "|".join(t[9] or ()))
            at = self.number.get(key)
            if at is None:
                at = self.number[key] = len(self.store)
                self.store.append(t)
            out.append(at)
        return out

    def table(self) -> pa.StructArray:
        """All finished tokens, those new since the last time put on."""
        new = self.store[len(self.arrow) :]
        if new:
            columns = zip(*new, strict=True)
            more = pa.StructArray.from_arrays([pa.array(c, k.type) for c, k in zip(columns, _ARROW, strict=True)], fields=list(_ARROW))
            self.arrow = pa.concat_arrays([self.arrow, more])
        return self.arrow

    def _parts(self, reading: segment.Reading, word: str, caps: bool) -> list[dict]:
        """Tokens of a reading, cut out of the word as it is written."""
        out, begin, root = [], 0, reading.root
        cuts = list(reading.ends)
        if reading.source == "suffixes":
            labels = list(reading.labels)
        else:
            end = cuts.pop(0)
            if reading.source == "foreign":
                out.append(token(word[:end], "FOREIGN", "foreign"))
            else:
                flags = ["caps"] if caps and reading.source != "restored" else []
                meta = {}
                if root is not None:
                    meta = {"root_lemma": root.lemma, "surface_root": root.surface}
                    if root.restored:
                        flags.append("restored")
                    elif root.lemma != root.surface:
                        flags.append("ascii_normalized")
                out.append(token(word[:end], "ROOT", *flags, **meta))
            begin, labels = end, list(reading.labels)
        for end, label in zip(cuts, labels, strict=True):
            out.append(token(word[begin:end], "SUFFIX", suffix_label=label))
            begin = end
        return out

    def _plain(self, word: str) -> list[dict]:
        low, caps = turkish_small(word), is_caps(word)
        if low in tables.INTACT:
            return [token(word[: len(low)], "ROOT", *(["caps"] if caps else []))]
        return self._parts(segment.best(low, self.lex, caps), word, caps)

    def _apostrophe(self, word: str) -> list[dict]:
        at = max(word.find("'"), word.find("’"))
        base, rest = word[:at], word[at + 1 :]
        turkish, caps = is_turkish_base(base, self.lex), is_caps(base)
        flags = [f for f, on in (("caps", caps), ("foreign", not turkish)) if on]
        out = [token(base, "ROOT" if turkish else "FOREIGN", *flags), token(word[at], "PUNCT", "punct")]
        if rest:
            reading = segment.best_suffixes(rest.lower(), self.lex)
            parts = self._parts(reading, rest, False) if reading else [token(rest, "SUFFIX", suffix_label=tables.SUFFIXES.get(rest.lower(), "-SFX"))]
            for t in parts:
                t["token_type"] = "SUFFIX"
                t["flags"] = [*t["flags"], "apo_suffix"]
            out += parts
        return out

    def _word(self, word: str) -> list[dict]:
        if is_punctuation(word):
            return [token(word, "PUNCT", "punct")]
        lead, core, trail = _EDGES.match(word).groups()
        out = [token(c, "PUNCT", "punct") for c in lead]
        if "'" in core or "’" in core:
            out += self._apostrophe(core)
        elif len(core) > 2 and "-" in core.strip("-") and core[0] != "-" and core[-1] != "-":
            for i, part in enumerate(core.split("-")):
                if i:
                    out.append(token("-", "PUNCT", "punct"))
                out += self._plain(part)
        elif core:
            out += self._plain(core)
        return out + [token(c, "PUNCT", "punct") for c in trail]

    def word(self, word: str) -> list[int]:
        """The numbers of the finished tokens of a word between blanks, or of a blank; remembered, so not to be changed."""
        got = self.memo.get(word)
        if got is None:
            got = self.memo[word] = self._keep([token(word, "SPACE", "space")] if word.isspace() else self._word(word))
        return got

    def _special(self, span: Span) -> list[dict]:
        kind, text = span.kind, span.text
        if kind.endswith("_APO"):
            at = max(text.find("'"), text.find("’")) if kind == "ROOT_APO" else text.find("'") if "'" in text else text.find("’")
            base = text[:at]
            if kind == "NUM_APO":
                head = token(base, "NUM", "num")
            elif kind == "ROOT_APO":
                head = token(base, "ROOT", "root")
            elif kind == "HYPHENATED_APO":
                head = token(base, "ACRONYM", "acronym", "hyphenated")
            else:
                head = self._acronym(base)
            tail = [token(s, "SUFFIX", "apo_suffix", suffix_label=label) for s, label in apostrophe_parts(text[at + 1 :])]
            return [head, token(text[at], "PUNCT", "punct"), *tail]
        if kind == "NUM_UNIT":
            number, unit = number_and_unit(text)
            return [token(number, "NUM", "num"), token(unit, "UNIT", "unit")]
        return [self._acronym(text) if kind == "ACRONYM" else token(text, kind, kind.lower())]

    @staticmethod
    def _acronym(text: str) -> dict:
        full = expansion(text)
        return token(text, "ACRONYM", "acronym", *(["known_acronym"] if full else []), expansion=full)

    def codes(self, text: str | None) -> list[int]:
        """The numbers of all tokens of a text in NFC, blanks included."""
        out: list[int] = []
        text = text or ""
        at, word = 0, self.word
        for span in [*find_spans(text, self.lex), None]:
            for part in _BLANK.split(text[at : span.start if span else None]):
                if part:
                    out += word(part)
            if span:
                out += self._keep(self._special(span))
                at = span.end
        return out

    @property
    def full(self) -> bool:
        """Whether so many words are remembered that it is time to reset."""
        return len(self.memo) >= MEMO or len(self.store) >= 2 * MEMO

    def rows(self, text: str | None) -> list[tuple]:
        """All tokens of a text as tuples in the order of FIELDS."""
        if self.full:
            self.reset()
        return [self.store[i] for i in self.codes(text)]

    def tokenize(self, text: str | None) -> list[dict]:
        """The same as dictionaries."""
        return [dict(zip(FIELDS, t, strict=True)) for t in self.rows(text)]


def finish(tokens: list[dict]) -> list[tuple]:
    """Tokens of one word or span, annotated and with their places in it, as tuples. Every word and span
    begins with a token that is no suffix, so no place depends on what stands before."""
    return [tuple(t[f] for f in FIELDS) for t in place([annotate(t) for t in tokens])]


def annotate(t: dict) -> dict:
    """Adds what is looked up by the token: numbers, units, months and Roman numerals missed as
    spans, the morpheme of a suffix, the parts of a compound, the expansion of an acronym."""
    text = t["token"].strip()
    low = text.lower()
    if t["token_type"] in ("ROOT", "FOREIGN"):
        if _NUMBER.fullmatch(text):
            t.update(token_type="NUM", flags=[*t["flags"], "num"])
        elif low in tables.UNITS:
            t.update(token_type="UNIT", flags=[*t["flags"], "unit"])
        elif low in tables.ROMAN:
            t.update(token_type="NUM", flags=[*t["flags"], "roman"])
        elif low in tables.MONTHS:
            t.update(token_type="ROOT", flags=[*t["flags"], "month"])
    if t["token_type"] == "SUFFIX":
        t["canonical"] = tables.MORPHEMES.get(low)
    elif t["token_type"] == "ROOT" and not text.startswith("<") and low in tables.COMPOUNDS:
        t.update(parts=tables.COMPOUNDS[low], flags=[*t["flags"], "compound"])
    full = tables.ACRONYMS.get(text.upper())
    if full and (t["token_type"] == "ACRONYM" or t["token_type"] == "ROOT" and {"acronym", "caps"} & set(t["flags"])):
        known = [] if "known_acronym" in t["flags"] else ["known_acronym"]
        t.update(token_type="ACRONYM", expansion=full, flags=[*t["flags"], *known])
    return t


def place(tokens: list[dict]) -> list[dict]:
    """Tokens with morph_pos: suffixes count up from the last token that is none, blanks aside."""
    out, n = [], 0
    for t in tokens:
        if t["token_type"] != "SPACE":
            n = n + 1 if t["token_type"] == "SUFFIX" or "apo_suffix" in t["flags"] else 0
        out.append({**t, "morph_pos": n} if n and t["token_type"] != "SPACE" else t)
    return out


def tokens(docs: DataFrame, lex: Lexicon | None = None, id_col: str = "doc_id", text_col: str = "text", skip_errors: bool = False) -> DataFrame:
    """(id_col, tokens): an array of TOKEN for each row; empty for a null or empty text. With ``skip_errors``
    a text that cannot be tokenised gives null and does not end the job."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    held = spark.sparkContext.broadcast(lex or Lexicon())
    cache: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = cache.get("t")
        if tok is None:
            tok = cache["t"] = Tokenizer(held.value)
        gc.disable()  # what is remembered holds no cycles, and the collector would walk through it again and again
        try:
            for batch in batches:
                codes, ends, lost = [], [0], []
                if tok.full:
                    tok.reset()
                for t in batch.column(1).to_pylist():
                    try:
                        codes += tok.codes(t)
                        lost.append(False)
                    except Exception:
                        if not skip_errors:
                            raise
                        lost.append(True)
                    ends.append(len(codes))
                flat = tok.table().take(pa.array(codes, pa.int32()))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array(lost, pa.bool_()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], [id_col, "tokens"])
        finally:
            gc.enable()

    schema = T.StructType([docs.schema[id_col], T.StructField("tokens", T.ArrayType(TOKEN))])
    return spread(docs.select(id_col, text_col)).select(id_col, nfc(F.col(text_col)).alias(text_col)).mapInArrow(run, schema)


def explode_tokens(arrays: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each token with its place ``pos`` in the text, from 0."""
    return arrays.select(id_col, F.posexplode("tokens").alias("pos", "t")).select(id_col, "pos", "t.*")


def token_stats(arrays: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per text: all tokens, roots, suffixes, foreign ones, punctuation, special ones, and the
    percentages of these together and of words (roots, suffixes, foreign ones that do not
    begin with <) in all, rounded to 2; zeros for no tokens."""

    def count(kinds: list[str], plain: bool = False):
        return F.size(F.filter("tokens", lambda t: t["token_type"].isin(kinds) & (~F.trim(t["token"]).startswith("<") if plain else F.lit(True))))

    base = arrays.select(
        id_col, F.size("tokens").alias("total"), count(["ROOT"]).alias("roots"), count(["SUFFIX"]).alias("suffixes"), count(["FOREIGN"]).alias("foreign_words"),
        count(["PUNCT"]).alias("punct"), count(sorted(SPECIAL_TYPES)).alias("special"), count(["ROOT", "SUFFIX", "FOREIGN"], True).alias("pure"),
    )
    share = lambda n: F.when(F.col("total") > 0, F.round(n / F.col("total") * 100, 2)).otherwise(0.0)
    known = F.col("roots") + F.col("suffixes") + F.col("foreign_words") + F.col("punct") + F.col("special")
    return base.select(id_col, "total", "roots", "suffixes", "foreign_words", "punct", "special", share(known).alias("tr_pct"), share(F.col("pure")).alias("pure_pct"))
