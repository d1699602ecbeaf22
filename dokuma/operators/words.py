"""Words of texts: splitting, spans, accented forms, segmentation of distinct words, encoding."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dokuma.functions import tables
from dokuma.functions.lexicon import Lexicon
from dokuma.functions.text import nfc
from dokuma.operators import encode, tokenizer
from dokuma.operators.segment import best
from dokuma.operators.spans import CURRENCY, DATE, EMAIL, NUMBER, TIME, apostrophe_parts, find_spans, turkish_small
from dokuma.operators.tokenizer import is_caps, is_turkish_base
from dokuma.session import small_batches, spread

#: Patterns that count alike in any regular-expression engine.
COUNTED = {"email": EMAIL, "dates": DATE, "times": TIME, "currency": CURRENCY, "numbers": NUMBER}
BLANK = r"\s\x{1C}-\x{1F}\x{85}\p{Z}"


def split(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, pos, piece, blank): the runs of white space and of other signs of each text, in order."""
    runs = F.regexp_extract_all(text_col, F.lit(f"[{BLANK}]+|[^{BLANK}]+"), 0)
    return spread(docs.select(id_col, text_col)).select(id_col, F.posexplode(runs).alias("pos", "piece")).withColumn("blank", F.col("piece").rlike(f"^[{BLANK}]"))


def edges(words: DataFrame, column: str = "piece") -> DataFrame:
    """(piece, lead, core, trail): signs before and after a word, each a token of its own, and the word; of a
    word of signs only all is lead."""
    sign = r"[^\p{L}\p{N}_]"
    p = F.col(column)
    lead = F.regexp_extract(p, rf"^{sign}*", 0)
    rest = p.substr(F.length(lead) + 1, F.length(p))
    trail = F.regexp_extract(rest, rf"{sign}*$", 0)
    core = rest.substr(F.lit(1), F.length(rest) - F.length(trail))
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    return words.select(p.alias("piece"), chars(lead).alias("lead"), core.alias("core"), chars(trail).alias("trail"))


def spans(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """(doc_id, start, stop, kind, span): the special spans of each text in NFC."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, *s) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for s in find_spans(t, held.value)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "stop", "kind", "span"])

    texts = spread(docs.filter("text is not null").select("doc_id", "text")).select("doc_id", nfc(F.col("text")).alias("text"))
    return texts.mapInPandas(run, "doc_id bigint, start int, stop int, kind string, span string")


def accented(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, accented): the dictionary word an unaccented one stands for, by an equality join on the
    unaccented form; cheapest by letters changed (c, g, s one each, i, o, u two), then first in order; only
    the first eight letters that could change may."""
    plain = lexicon.select("word", F.translate("word", "çğıöşü", "cgiosu").alias("plain")).filter("plain <> word").withColumnRenamed("word", "accented")
    own = words.filter(~F.col("word").rlike(r"[^\x{00}-\x{7F}]")).join(lexicon, "word", "left_anti")
    met = own.join(plain, own["word"] == plain["plain"])
    letters = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.struct(i.alias("i"), F.substring(F.col("word"), i, F.lit(1)).alias("a"), F.substring(F.col("accented"), i, F.lit(1)).alias("b")))
    free = F.slice(F.filter("letters", lambda x: x["a"].isin(list("cgiosu"))), 1, 8)
    changed = F.filter("letters", lambda x: x["a"] != x["b"])
    cost = F.aggregate("changed", F.lit(0), lambda acc, x: acc + F.when(x["a"].isin("c", "g", "s"), 1).otherwise(2))
    met = met.withColumn("letters", letters).withColumn("changed", changed).withColumn("free", free)
    allowed = F.forall("changed", lambda x: F.array_contains(F.transform("free", lambda y: y["i"]), x["i"]))
    return met.filter(allowed).withColumn("cost", cost).groupBy("word").agg(F.min(F.struct("cost", "accented")).alias("m")).select("word", "m.accented")


def segment(words: DataFrame, lex: Lexicon) -> DataFrame:
    """(word, score, source, parts, labels, lemma) of distinct words taken as wholes."""
    small_batches(words.sparkSession)
    held = words.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for w in pdf["word"]:
                low = turkish_small(w)
                if low in tables.INTACT:
                    rows.append((w, 5000, "intact", [low], [], None))
                    continue
                r = best(low, held.value, is_caps(w))
                cuts = [0, *r.ends]
                rows.append((w, r.score, r.source, [low[a:b] for a, b in zip(cuts, cuts[1:])], list(r.labels), r.root.lemma if r.root else None))
            yield pd.DataFrame(rows, columns=["word", "score", "source", "parts", "labels", "lemma"])

    # distinct words are few bytes but much work, so they stay in as many partitions as a shuffle has
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return words.select("word").repartition(parts, "word").mapInPandas(run, "word string, score int, source string, parts array<string>, labels array<string>, lemma string")


# Fixed value: a word, an apostrophe and what may be its suffixes.
_APOSTROPHE = re.compile(r"([A-Za-zÇçĞğİıÖöŞşÜü0-9]{2,})['’]([A-Za-zÇçĞğİıÖöŞşÜü]{1,6})\b")


def part_foreign(text: str, lex: Lexicon) -> tuple[str, list[tuple[str, str]]]:
    """The text with a blank for the apostrophe between a foreign word and a suffix, and those (word, suffix)."""
    pairs: list[tuple[str, str]] = []

    def change(m: re.Match) -> str:
        suffix = m.group(2).lower()
        if suffix not in tables.APOSTROPHE_SUFFIXES or is_turkish_base(m.group(1), lex):
            return m.group()
        pairs.append((turkish_small(m.group(1)), suffix))
        return f"{m.group(1)} {m.group(2)}"

    return _APOSTROPHE.sub(change, text), pairs


def apostrophe_tokens(word: str, suffixes: str, foreign: bool) -> list[dict]:
    """Tokens of a word and the suffixes after its apostrophe, the word with a blank before it."""
    head = tokenizer.token(f" {word}", "FOREIGN", "foreign") if foreign else tokenizer.token(f" {word}", "ROOT")
    tail = [tokenizer.token(s, "SUFFIX", "apo_suffix", suffix_label=label) for s, label in apostrophe_parts(suffixes)]
    return tokenizer.place([head, tokenizer.token("'", "PUNCT", "punct"), *tail])


def foreign_apostrophes(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """(doc_id, text, bases, suffixes) of the texts that hold foreign words with suffixes after an apostrophe."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, new, [p[0] for p in pairs], [p[1] for p in pairs]) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for new, pairs in [part_foreign(t, held.value)] if pairs]
            yield pd.DataFrame(rows, columns=["doc_id", "text", "bases", "suffixes"])

    return docs.filter("text rlike \"['’]\"").select("doc_id", "text").mapInPandas(run, "doc_id bigint, text string, bases array<string>, suffixes array<string>")


def encode_texts(texts: DataFrame, vocab: DataFrame, lex: Lexicon, keep_space: bool = True) -> DataFrame:
    """(doc_id, ids) of texts; blanks are looked up too if kept, which gives UNK where the vocabulary has none."""
    rows = tokenizer.explode_tokens(tokenizer.tokens(texts, lex)).select("doc_id", "pos", "token", "token_type")
    ids = encode.lookup(rows, vocab, keep_space)
    lists = ids.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))
    return texts.select("doc_id").join(lists, "doc_id", "left").select("doc_id", F.coalesce("ids", F.array().cast(T.ArrayType(T.IntegerType()))).alias("ids"))
