"""The dictionary as an input relation, and what segmentation derives from it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dokuma.functions import tables

#: Dictionary words that may be broadcast; a dictionary of a language has far fewer.
MAX_WORDS = 5_000_000


def load_words(rows: DataFrame, column: str = "word") -> DataFrame:
    """(word): the non-blank words in small letters without blanks at the ends, and the
    stems of the infinitives (-mak, -mek of more than four letters), each once."""
    word = F.lower(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", "")).alias("word")
    words = rows.select(word).filter("word <> ''")
    stems = words.filter(F.col("word").rlike("m[ae]k$") & (F.length("word") > 4)).select(F.expr("substr(word, 1, length(word) - 3)").alias("word"))
    return words.unionByName(stems).distinct()


def load_names(rows: DataFrame, column: str = "name") -> DataFrame:
    """(name): names in small letters; blank lines and lines that begin with # are left out."""
    name = F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", "")
    return rows.filter((name != "") & ~name.startswith("#")).select(F.lower(name).alias("name")).distinct()


@dataclass
class Lexicon:
    """Words that roots are checked against. Without words it works as a dictionary-less
    tokenizer: names, domain terms and narrowed verb stems only."""

    words: frozenset[str] = frozenset()
    names: frozenset[str] = frozenset(tables.PROPER_NOUNS)
    domain: frozenset[str] = frozenset(tables.MEDICAL) | frozenset(tables.SPORTS) | frozenset(tables.TOURISM)
    unaccented: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self):
        plain = str.maketrans("çğıöşü", "cgiosu")
        for w in self.words:
            p = w.translate(plain)
            if p != w:
                self.unaccented.setdefault(p, []).append(w)

    @classmethod
    def of(cls, words: DataFrame) -> Lexicon:
        """From a (word) table as ``load_words`` gives it, at most MAX_WORDS rows, checked."""
        rows = words.limit(MAX_WORDS + 1).collect()
        if len(rows) > MAX_WORDS:
            raise ValueError(f"a dictionary of more than {MAX_WORDS} words")
        return cls(words=frozenset(r.word for r in rows))

    def accented(self, word: str) -> str | None:
        """The dictionary word that an unaccented spelling stands for: cheapest by the letters
        changed (c, g, s one each, i, o, u two), then first in order. Only the first eight
        letters that could change may."""
        found = self.unaccented.get(word)
        if not found or not word.isascii() or word in self.words:
            return None
        free = [i for i, c in enumerate(word) if c in "cgiosu"][:8]
        best = None
        for w in found:
            changed = [i for i, (a, b) in enumerate(zip(word, w, strict=True)) if a != b]
            if set(changed) <= set(free):
                key = (sum(1 if word[i] in "cgs" else 2 for i in changed), w)
                best = key if best is None or key < best else best
        return best[1] if best else None

    def form(self, word: str) -> str | None:
        """The word itself if it is in the dictionary, else its accented form, or None."""
        return word if word in self.words else self.accented(word)

    def has_verb(self, stem: str) -> bool:
        return stem + "mak" in self.words or stem + "mek" in self.words

    def is_verb(self, stem: str) -> bool:
        return stem in ("ye", "de", "et", "git", "tat") or self.has_verb(stem)
