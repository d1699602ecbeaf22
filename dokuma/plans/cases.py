"""Planted texts for the tokenizer, with the rows that are right for them.

The texts and the rows are written out by hand from the definitions of the patterns and of the
scores. The queries run the tokenizer's own operators; the SQL is the rows as VALUES.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dokuma.functions.lexicon import Lexicon
from dokuma.operators import tokenizer, words

#: A small dictionary.
WORDS = "çok ağaç gelmek gel kitap burun ev okul çocuk git gitmek yapmak yap başlamak başla".split()

#: text -> its special spans in order, as (kind, span). No dictionary.
SPANS = {
    "Bkz. https://ornek.invalid/a?b=1). Ya da www.ornek.invalid!": [("URL", "https://ornek.invalid/a?b=1"), ("URL", "www.ornek.invalid")],
    "Yaz: ali.veli@ornek.invalid, #gündem ve @kisi_1 burada": [("EMAIL", "ali.veli@ornek.invalid"), ("HASHTAG", "#gündem"), ("MENTION", "@kisi_1")],
    "C++ ile f# ve C# dilleri": [("TECH", "C++"), ("TECH", "f#"), ("TECH", "C#")],
    "12.05.2020 ile 2020-05-12, 1/2/99": [("DATE", "12.05.2020"), ("DATE", "2020-05-12"), ("DATE", "1/2/99")],
    "v1.2.3 ve 3.14 ve 1.000.000 ama 3,14": [("TECH", "v1.2.3"), ("TECH", "3.14"), ("TECH", "1.000.000"), ("NUM", "3,14")],
    "e-devlet'te ve E-Devlet üzerinden": [("ROOT_APO", "e-devlet'te"), ("ROOT", "E-Devlet")],
    "/usr/local/bin ile C:\\belge\\a.txt": [("TECH", "/usr/local/bin"), ("TECH", "C:\\belge\\a.txt")],
    "$15, 20€ ve 3,5₺": [("UNIT", "$15,"), ("UNIT", "20€"), ("UNIT", "3,5₺")],
    "1990'larda, 3'te ve 10:30'da": [("NUM_APO", "1990'larda"), ("NUM_APO", "3'te"), ("NUM_APO", "10:30'da")],
    "COVID-19'dan ve ali-veli'den": [("HYPHENATED_APO", "COVID-19'dan")],
    "NATO'nun, B2B ve TBMM'ye": [("ACRONYM_APO", "NATO'nun"), ("ACRONYM_APO", "TBMM'ye")],
    "ANKARA ve VAN gitti, ODTÜ ise B12": [("ACRONYM", "ODTÜ"), ("ACRONYM", "B12")],
    "ANKARA'dan İZMİR’e": [],
    "%45, 45%, 3/4 ve 1.234": [("NUM", "%45,"), ("NUM", "45%"), ("NUM", "3/4"), ("TECH", "1.234")],
    "saat 09:15:30 ve 9:05": [("NUM", "09:15:30"), ("NUM", "9:05")],
    "15kg, 2,5 km ve 10mb": [("NUM_UNIT", "15kg"), ("NUM", "2,5"), ("NUM_UNIT", "10mb")],
    "1453 yılı": [("NUM", "1453")],
    "🙂🙂 güldü ☀": [("EMOJI", "🙂🙂"), ("EMOJI", "☀")],
    "ne :) güzel :D <3 =P": [("EMOJI", ":)"), ("EMOJI", ":D"), ("EMOJI", "<3"), ("EMOJI", "=P")],
    "GPT-4'ün ve MP3'te": [("HYPHENATED_APO", "GPT-4'ün"), ("ACRONYM_APO", "MP3'te")],
    "a@b ve # ve @": [("MENTION", "@b")],
    "": [],
}

#: Tokens of a text without its blanks: "token TYPE morph_pos suffix_label canonical root_lemma expansion parts",
#: with - for nothing (a place that has nothing after it is left out).
PLAIN = {
    "İstanbul'da meeting'e katılamadım": ["İstanbul ROOT", "' PUNCT", "da SUFFIX 1 -LOC LOC", "meeting FOREIGN", "' PUNCT", "e SUFFIX 1 -DAT DAT", "katılamadım ROOT"],
    "meeting'lerden": ["meeting FOREIGN", "' PUNCT", "ler SUFFIX 1 -PL PL", "den SUFFIX 2 -ABL ABL"],
    "meeting'deki": ["meeting FOREIGN", "' PUNCT", "deki SUFFIX 1 -REL+LOC"],
    "NATO'nun": ["NATO ACRONYM 0 - - - Kuzey_Atlantik_Antlaşması_Örgütü", "' PUNCT", "nun SUFFIX 1 -GEN GEN"],
    "15kg elma": ["15 NUM", "kg UNIT", "elma ROOT"],
    "3,14 3.14 1.000.000": ["3,14 NUM", "3.14 TECH", "1.000.000 TECH"],
    "COVID-19": ["COVID ACRONYM", "- PUNCT", "19 NUM"],
    "COVID-19'dan": ["COVID-19 ACRONYM", "' PUNCT", "dan SUFFIX 1 -ABL ABL"],
    "diyor": ["di ROOT 0 - - de", "yor SUFFIX 1 -PROG PROG"],
    "hepatitler": ["hepatit ROOT 0 - - hepatit", "ler SUFFIX 1 -PL PL"],
    "window du nasıl": ["window FOREIGN", "du ROOT 0 - - de", "nasıl ROOT"],
    "x'nda": ["x ROOT", "' PUNCT", "nda SUFFIX 1 -SFX"],
    "3'te 1990'larda": ["3 NUM", "' PUNCT", "te SUFFIX 1 -LOC LOC", "1990 NUM", "' PUNCT", "lar SUFFIX 1 -PL PL", "da SUFFIX 2 -LOC LOC"],
    "e-devlet'te": ["e-devlet ROOT", "' PUNCT", "te SUFFIX 1 -LOC LOC"],
    "XIV ocak km 45 başbakan": ["XIV ACRONYM", "ocak ROOT", "km UNIT", "45 NUM", "başbakan ROOT 0 - - - - baş+bakan"],
    "KDV'ye": ["KDV ACRONYM 0 - - - Katma_Değer_Vergisi", "' PUNCT", "ye SUFFIX 1 -DAT DAT"],
    "(üre, doz)...": ["( PUNCT", "üre ROOT", ", PUNCT", "doz ROOT", ") PUNCT", ". PUNCT", ". PUNCT", ". PUNCT"],
    "çok-güzel 5ms": ["çok ROOT", "- PUNCT", "güzel ROOT", "5 NUM", "ms UNIT"],
    "iPhone'a abc'ye": ["iPhone FOREIGN", "' PUNCT", "a SUFFIX 1 -DAT DAT", "abc ROOT", "' PUNCT", "ye SUFFIX 1 -DAT DAT"],
    "": [],
}

#: The same with the small dictionary.
WITH_WORDS = {
    "kitabı geldi gidiyor": ["kitab ROOT 0 - - kitap", "ı SUFFIX 1 -ACC ACC", "gel ROOT 0 - - gel", "di SUFFIX 1 -PST PAST", "gid ROOT 0 - - git", "iyor SUFFIX 1 -PROG PROG"],
    "YAPTI evlerimizden": ["YAP ROOT 0 - - yap", "TI SUFFIX 1 -PST PAST", "ev ROOT 0 - - ev", "ler SUFFIX 1 -PL PL", "imiz SUFFIX 2 -P1PL", "den SUFFIX 3 -ABL ABL"],
    "burnu agac cok başlıyor": ["burn ROOT 0 - - burun", "u SUFFIX 1 -ACC ACC", "agac ROOT 0 - - ağaç", "cok ROOT 0 - - çok", "başlı ROOT 0 - - başla", "yor SUFFIX 1 -PROG PROG"],
    "gelmiyor geldim": ["gel ROOT 0 - - gel", "mi SUFFIX 1 -Q Q", "yor SUFFIX 2 -PROG PROG", "gel ROOT 0 - - gel", "di SUFFIX 1 -PST PAST", "m SUFFIX 2 -1SG"],
    "OKUL EV ABC": ["OKUL ROOT 0 - - okul", "EV ACRONYM", "ABC ACRONYM"],
    "okulda çocuklar gelecek": ["okul ROOT 0 - - okul", "da SUFFIX 1 -LOC LOC", "çocuk ROOT 0 - - çocuk", "lar SUFFIX 1 -PL PL", "gel ROOT 0 - - gel", "ecek SUFFIX 1 -FUT"],
}

#: text -> (the text with foreign apostrophes parted, the words before them, the suffixes after them). No dictionary.
FOREIGN = {
    "zoom'da İstanbul'da x'q": ("zoom da İstanbul'da x'q", "zoom", "da"),
    "iPhone’lar ve ODTÜ'den B2B'ye": ("iPhone lar ve ODTÜ den B2B ye", "iphone+odtü+b2b", "lar+den+ye"),
    "Ankara'dan geldi": None,
}

#: (word, suffixes, foreign) -> tokens "token|TYPE|morph_pos|label".
PARTED = {
    ("zoom", "larda", True): [" zoom|FOREIGN|0|", "'|PUNCT|0|", "lar|SUFFIX|1|-PL", "da|SUFFIX|2|-LOC"],
    ("İzmir", "deki", False): [" İzmir|ROOT|0|", "'|PUNCT|0|", "deki|SUFFIX|1|-REL+LOC"],
    ("zoom", "xyz", True): [" zoom|FOREIGN|0|", "'|PUNCT|0|", "xyz|SUFFIX|1|-SFX"],
}

#: Vocabulary and ids of texts, blanks left out or kept; 3 is the unknown token.
VOCAB = {"<ROOT>gel": 4, "<SUFFIX>di": 5, "<NUM>15": 6, "<UNIT>kg": 7, "<ROOT>ev": 8, "<SUFFIX>ler": 9, "<PUNCT>.": 10}
ENCODED = {"geldi": ([4, 5], [4, 5]), "15kg evler.": ([6, 7, 8, 9, 10], [6, 7, 3, 8, 9, 10]), "kitap": ([3], [3]), "": ([], [])}


def _texts(spark: SparkSession, texts) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def span_cases(spark: SparkSession, folder: str) -> DataFrame:
    return words.spans(_texts(spark, SPANS), Lexicon())


def _tokens(spark: SparkSession, cases: dict, lex: Lexicon) -> DataFrame:
    rows = tokenizer.explode_tokens(tokenizer.tokens(_texts(spark, cases), lex)).filter("token_type <> 'SPACE'")
    return rows.select("doc_id", "pos", "token", "token_type", "morph_pos", "suffix_label", "canonical", "root_lemma", "expansion", F.array_join("parts", "+").alias("parts"))


def token_cases(spark: SparkSession, folder: str) -> DataFrame:
    return _tokens(spark, PLAIN, Lexicon())


def token_cases_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    return _tokens(spark, WITH_WORDS, Lexicon(words=frozenset(WORDS)))


def foreign_cases(spark: SparkSession, folder: str) -> DataFrame:
    got = words.foreign_apostrophes(_texts(spark, FOREIGN), Lexicon())
    return got.select("doc_id", "text", F.array_join("bases", "+").alias("bases"), F.array_join("suffixes", "+").alias("suffixes"))


def parted_cases(spark: SparkSession, folder: str) -> DataFrame:
    rows = [(i, n, t["token"], t["token_type"], t["morph_pos"], t["suffix_label"]) for i, case in enumerate(PARTED) for n, t in enumerate(words.apostrophe_tokens(*case))]
    return spark.createDataFrame(rows, "id int, n int, token string, token_type string, morph_pos int, suffix_label string")


def encode_cases(spark: SparkSession, folder: str) -> DataFrame:
    vocab = spark.createDataFrame(list(VOCAB.items()), "token string, id int")
    lex, texts = Lexicon(words=frozenset(WORDS)), _texts(spark, ENCODED)
    bare = words.encode_texts(texts, vocab, lex, False).withColumnRenamed("ids", "bare")
    return bare.join(words.encode_texts(texts, vocab, lex, True).withColumnRenamed("ids", "spaced"), "doc_id")


def queries() -> dict:
    return {"span_cases": span_cases, "token_cases": token_cases, "token_cases_dictionary": token_cases_dictionary, "foreign_cases": foreign_cases, "parted_cases": parted_cases, "encode_cases": encode_cases}


def _q(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def _rows(rows: list[tuple], columns: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_q, r)) + ')' for r in rows)}) AS v({columns})"


def _placed(text: str, spans: list[tuple[str, str]]) -> list[tuple[int, int, str, str]]:
    out, at = [], 0
    for kind, span in spans:
        start = text.index(span, at)
        at = start + len(span)
        out.append((start, at, kind, span))
    return out


def _token_rows(cases: dict) -> list[tuple]:
    """Rows of the written tokens. pos counts blanks too: a run of them stands before a token that the text has one before."""
    rows = []
    for i, (text, tokens) in enumerate(cases.items()):
        at, pos = 0, 0
        for t in tokens:
            f = t.split(" ") + ["-"] * 8
            start = text.index(f[0], at)
            pos += start > at
            at = start + len(f[0])
            some = [None if x == "-" else x.replace("_", " ") for x in f[3:8]]
            if f[3] != "-":
                some[0] = f[3]
            rows.append((i, pos, f[0], f[1], int(f[2]) if f[2] != "-" else 0, *some))
            pos += 1
    return rows


def oracle_sql() -> dict[str, str]:
    tokens = "doc_id, pos, token, token_type, morph_pos, suffix_label, canonical, root_lemma, expansion, parts"
    return {
        "span_cases": _rows([(i, *s) for i, (text, spans) in enumerate(SPANS.items()) for s in _placed(text, spans)], "doc_id, start, stop, kind, span"),
        "token_cases": _rows(_token_rows(PLAIN), tokens),
        "token_cases_dictionary": _rows([(*r, None, None)[:10] for r in _token_rows(WITH_WORDS)], tokens),
        "foreign_cases": _rows([(i, *want) for i, want in enumerate(FOREIGN.values()) if want], "doc_id, text, bases, suffixes"),
        "parted_cases": _rows([(i, n, *[x or None for x in t.split("|")[:2]], int(t.split("|")[2]), t.split("|")[3] or None) for i, want in enumerate(PARTED.values()) for n, t in enumerate(want)], "id, n, token, token_type, morph_pos, suffix_label"),
        "encode_cases": f"SELECT * FROM (VALUES {', '.join(f'({i}, {a}::INT[], {b}::INT[])' for i, (a, b) in enumerate(ENCODED.values()))}) AS v(doc_id, bare, spaced)",
    }
