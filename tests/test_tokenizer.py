import itertools
import random

import pytest
from pyspark.sql import functions as F

from dokuma.functions import tables, text
from dokuma.functions.lexicon import Lexicon, load_words
from dokuma.operators import annotate, segment, spans, tokenizer, words
from dokuma.operators.tokenizer import Tokenizer

PLAIN = Tokenizer()
SMALL = Tokenizer(Lexicon(words=frozenset("çok ağaç gelmek gel kitap burun ev okul çocuk git gitmek yapmak yap".split())))


def short(t, s):
    return [(x["token"], x["token_type"], x["morph_pos"]) for x in t.tokenize(s) if x["token_type"] != "SPACE"]


GOLDEN = {
    "meeting'lerden": [("meeting", "FOREIGN", 0), ("'", "PUNCT", 0), ("ler", "SUFFIX", 1), ("den", "SUFFIX", 2)],
    "meeting'deki": [("meeting", "FOREIGN", 0), ("'", "PUNCT", 0), ("deki", "SUFFIX", 1)],
    "NATO'nun": [("NATO", "ACRONYM", 0), ("'", "PUNCT", 0), ("nun", "SUFFIX", 1)],
    "15kg elma": [("15", "NUM", 0), ("kg", "UNIT", 0), ("elma", "ROOT", 0)],
    "3,14": [("3,14", "NUM", 0)],
    "3.14": [("3.14", "TECH", 0)],
    "1.000.000": [("1.000.000", "TECH", 0)],
    "COVID-19": [("COVID", "ACRONYM", 0), ("-", "PUNCT", 0), ("19", "NUM", 0)],
    "COVID-19'dan": [("COVID-19", "ACRONYM", 0), ("'", "PUNCT", 0), ("dan", "SUFFIX", 1)],
    "diyor": [("di", "ROOT", 0), ("yor", "SUFFIX", 1)],
    "hepatitler": [("hepatit", "ROOT", 0), ("ler", "SUFFIX", 1)],
    "window": [("window", "FOREIGN", 0)],
    "du": [("du", "ROOT", 0)],
    "nasıl": [("nasıl", "ROOT", 0)],
    "x'nda": [("x", "ROOT", 0), ("'", "PUNCT", 0), ("nda", "SUFFIX", 1)],
    "3'te": [("3", "NUM", 0), ("'", "PUNCT", 0), ("te", "SUFFIX", 1)],
    "1990'larda": [("1990", "NUM", 0), ("'", "PUNCT", 0), ("lar", "SUFFIX", 1), ("da", "SUFFIX", 2)],
    "e-devlet'te": [("e-devlet", "ROOT", 0), ("'", "PUNCT", 0), ("te", "SUFFIX", 1)],
    "5ms": [("5", "NUM", 0), ("ms", "UNIT", 0)],
    "": [],
}


@pytest.mark.parametrize("given", list(GOLDEN))
def test_golden(given):
    assert short(PLAIN, given) == GOLDEN[given]


def test_sentence_without_dictionary():
    got = short(PLAIN, "İstanbul'da meeting'e katılamadım")
    assert got == [("İstanbul", "ROOT", 0), ("'", "PUNCT", 0), ("da", "SUFFIX", 1), ("meeting", "FOREIGN", 0), ("'", "PUNCT", 0), ("e", "SUFFIX", 1), ("katılamadım", "ROOT", 0)]


def test_scores():
    none = Lexicon()
    assert [segment.best(w, none, False).score for w in ("diyor", "hepatitler", "window", "du")] == [264, 124, 11, 170]
    assert segment.best_suffixes("lerden", none).score == segment.best_suffixes("deki", none).score == 13


def test_dictionary_helpers():
    lex = Lexicon(words=frozenset("çok ağaç gelmek gel kitap burun".split()))
    assert lex.accented("cok") == "çok" and lex.form("ağac") is None
    assert segment.noun_stem("kitab", lex) == "kitap" and segment.noun_stem("burn", lex) == "burun" and segment.noun_stem("ağac", lex) == "ağaç"
    assert segment.verb_stem("di", lex) == "de" and segment.verb_stem("y", lex) == "ye"


def test_with_dictionary():
    got = short(SMALL, "kitabı geldi gidiyor YAPTI evlerimizden")
    assert got == [("kitab", "ROOT", 0), ("ı", "SUFFIX", 1), ("gel", "ROOT", 0), ("di", "SUFFIX", 1), ("gid", "ROOT", 0), ("iyor", "SUFFIX", 1), ("YAP", "ROOT", 0), ("TI", "SUFFIX", 1), ("ev", "ROOT", 0), ("ler", "SUFFIX", 1), ("imiz", "SUFFIX", 2), ("den", "SUFFIX", 3)]


def every_cut(word):
    """All ways of cutting a word into parts."""
    for k in range(len(word)):
        for cuts in itertools.combinations(range(1, len(word)), k):
            yield [word[a:b] for a, b in zip((0, *cuts), (*cuts, len(word)))]


def slow_chains(word, lex):
    """Cuts whose parts but the first are suffixes and whose first is a root, scored by adding up the
    stated points, with the stated bans. Written from the definition over whole cuts."""
    out = {}
    for parts in every_cut(word):
        root = segment.root_of(parts[0], lex)
        if len(parts) < 2 or len(parts) > 11 or root is None or any(p not in tables.SUFFIXES for p in parts[1:]):
            continue
        labels = [tables.SUFFIXES[p] for p in parts[1:]]
        heads = list(itertools.accumulate(parts))[:-1]
        if any(a.endswith(("SG", "PL")) and b.startswith(("-PROG", "-PST", "-EVID", "-FUT", "-NEG", "-ABIL")) or b == "-PROG" and a in ("-AOR", "-PASS.AOR", "-ACC") for a, b in zip(labels, labels[1:])):
            continue
        if any(len(h) == 1 and not (h in "yd" and x.startswith(("-PROG", "-PST", "-EVID", "-FUT", "-NEG"))) for h, x in zip(heads, labels)):
            continue
        score, dead = root.score, False
        for i, (part, label, head) in enumerate(zip(parts[1:], labels, heads)):
            dead = dead or i > 0 and score <= -200
            verbal = label in ("-PST", "-PROG", "-EVID", "-FUT", "-NEG", "-AOR", "-PASS.AOR")
            score += 4 * len(part) - 8 + (60 * (label == "-PROG") + 40 * verbal if root.verb else -120 * (verbal or label == "-COND") - 90 * (part in "mnk" and len(part) == 1 and len(head) <= 2))
            score -= 150 * (part[0] in "tç" and head[-1] not in "pçtkfşsh")
            score += 100 * (label == "-PROG" and "-NEG" in labels[:i])
            if i == 0 and root.verb and root.lemma in ("de", "ye", "et", "git", "ol", "yap", "bul", "gel", "bak", "gör", "al", "ver"):
                score += 60 if root.lemma in ("de", "ye", "et", "git") else 30
        if not dead:
            out[tuple(parts)] = score
    return out


def test_lattice_finds_every_chain():
    lex = Lexicon(words=frozenset("gel gelmek ev at atmak git gitmek kal kalmak su ata".split()))
    r = random.Random(5)
    roots, ends = "gel ev at git gid kal su ata di du lig".split(), list(tables.SUFFIXES)
    for _ in range(400):
        word = r.choice(roots) + "".join(r.choice(ends) for _ in range(r.randint(1, 3)))
        if len(word) <= 12:
            got = {}
            for x in segment.chains(word, lex):
                cuts = [0, *x.ends]
                got[tuple(word[a:b] for a, b in zip(cuts, cuts[1:]))] = x.score
            assert got == slow_chains(word, lex), word


def test_spans_are_sorted_and_disjoint():
    s = "Bkz. www.ornek.invalid/a, ali@b.invalid #etiket @kisi 12.05.2020 saat 10:30'da %45 3/4 $15 :) 🙂🙂 C++ GPT-4'ün /usr/local v1.2.3"
    got = spans.find_spans(s, Lexicon())
    assert all(a.end <= b.start for a, b in zip(got, got[1:])) and all(s[x.start : x.end] == x.text for x in got)
    assert {"URL", "EMAIL", "HASHTAG", "MENTION", "DATE", "NUM", "UNIT", "EMOJI", "TECH", "HYPHENATED_APO"} <= {x.kind for x in got}


def test_surfaces_give_the_text_back():
    s = "Ankara'dan  gelen (3.14) kitaplar,\n\tçok-güzel!  a--b www.x.invalid."
    assert "".join(x["token"] for x in PLAIN.tokenize(s)) == s


def test_tables():
    assert (len(tables.SUFFIXES), len(tables.APOSTROPHE_SUFFIXES), len(tables.MORPHEMES), len(tables.ACRONYMS)) == (209, 67, 99, 90)
    assert tables.SUFFIXES["mi"] == "-Q" and tables.SUFFIXES["de"] == "-LOC" and tables.harmonise("AlI") == ["alı", "eli"] and tables.harmonise("IncA") == ["ınca", "unca", "ince", "ünce"]


def test_tokens_of_nulls_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "İzmir", None), (4, " " * 5000, "z"), (4, "tekrar", "z")], "doc_id bigint, text string, tokens string")
    got = {(r.doc_id, r.token) for r in tokenizer.explode_tokens(tokenizer.tokens(df)).collect()}
    assert got == {(3, "İzmir"), (4, " " * 5000), (4, "tekrar")}
    assert tokenizer.tokens(df.limit(0)).count() == 0
    stats = {r.doc_id: r for r in tokenizer.token_stats(tokenizer.tokens(df.filter("doc_id < 4"))).collect()}
    assert stats[1].total == 0 and stats[1].tr_pct == 0 and stats[3].pure_pct == 100


def test_columns_agree_with_the_tokenizer(spark):
    seen = ["NATO", "NVIDIA", "OpenAI", "B2B", "çay", "ab", "ABC", "ankara", "zoom", "İZMİR", "", "a1"]
    df = spark.createDataFrame([(w,) for w in seen], "w string")
    got = df.select("w", text.is_turkish_base(F.col("w"), F.lit(False)).alias("t"), text.is_all_caps(F.col("w")).alias("c")).collect()
    assert [r.t for r in got] == [tokenizer.is_turkish_base(w, Lexicon()) for w in seen]
    assert [r.c for r in got] == [tokenizer.is_caps(w) for w in seen]


def test_morph_pos_columns_agree(spark):
    df = spark.createDataFrame([(1, "Evlerimizden İstanbul'da 1990'larda geldiler ve NATO'nun")], "doc_id bigint, text string")
    rows = tokenizer.explode_tokens(tokenizer.tokens(df)).select("doc_id", "pos", "token", "token_type", F.col("morph_pos").alias("want"))
    assert annotate.morph_pos(rows).filter("want <> morph_pos").count() == 0


def test_lexicon_from_dirty_rows(spark):
    df = spark.createDataFrame([(" Gelmek ",), ("gelmek",), (None,), ("",), ("mek",)], "word string")
    assert {r.word for r in load_words(df).collect()} == {"gelmek", "gel", "mek"}


def test_foreign_apostrophes():
    assert words.part_foreign("zoom'da İstanbul'da x'q", Lexicon()) == ("zoom da İstanbul'da x'q", [("zoom", "da")])


def test_registered_functions(spark):
    from dokuma.functions.register import register

    register(spark)
    got = spark.sql("SELECT token, token_type, morph_pos FROM tokenize_text('NATO''nun üyesi')").collect()
    assert [tuple(r) for r in got][:3] == [("NATO", "ACRONYM", 0), ("'", "PUNCT", 0), ("nun", "SUFFIX", 1)]
    assert spark.sql("SELECT token_types('15kg') AS t, token_types(NULL) AS n").first() == (["NUM", "UNIT"], [])


def test_apostrophe_tokens():
    got = words.apostrophe_tokens("zoom", "larda", True)
    assert [(t["token"], t["token_type"], t["morph_pos"]) for t in got] == [(" zoom", "FOREIGN", 0), ("'", "PUNCT", 0), ("lar", "SUFFIX", 1), ("da", "SUFFIX", 2)]
