"""Pair defects, structure, reading level and tokenizer encoding."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
import tiktoken

from dokuma.llm import bpe, crf, pair_defects, reading_level, structure
from dokuma.llm._codes import Words, blocks, fold_words

PAIRS = "example_id bigint, instruction string, input string, output string, added_at timestamp, defect_type string"
GOOD = "Köprü eski kentte kuruldu. Bugün her gün binlerce kişi onu geçiyor."
CASES = [
    ("Köprüyü anlat.", None, GOOD, None), ("Köprüyü anlat.", "", None, "empty"), ("Köprüyü anlat.", "", " \n​", "empty"), ("Köprüyü anlat.", "", "N/A", "empty"), ("Köprüyü anlat.", "", "...", "empty"),
    ("Kaç kişi geçer?", "", "1450", None), ("Hangi ağaç görülür?", "", "Meşe", None), ("Köprüyü anlat.", "", "Köprü eski kentte kuruldu. Bugün her gün binlerce kişi ile", "truncated"),
    ("Köprüyü anlat.", "", "Bu konuda yardımcı olamam.", "refusal"), ("Köprüyü anlat.", "", "Üzgünüm, önceki yanıtım hatalıydı. " + GOOD, None), ("Köprüyü anlat.", "", "KÖPRÜYÜ ANLAT", "copy"),
    ("Derneğin davetini kibarca geri çeviren bir ileti yaz.", "", "Merhaba,\nÜzgünüm, o gün katılamam.\nSaygılarımla", None), ("Verilen metni aynen tekrar et.", GOOD, GOOD, None),
    ("Metni özetle.", GOOD, GOOD, "copy"), ("Köprüyü anlat.", "", "The bridge is old and the people of the town walk over it every day.", "language"),
    ("Metni İngilizceye çevir.", GOOD, "The bridge is old and the people of the town walk over it every day.", None), ("Metni Almancaya çevir.", GOOD, "The bridge is old and the people of the town walk over it every day.", "language"),
    ("4 öneri sırala.", "", "- Yeni kent yolu\n- Eski kale kapısı\n- Küçük ada limanı\n- Uzun deniz kıyısı", None), ("4 öneri sırala.", "", "- Yeni kent yolu\n- Eski kale ka", "truncated"),
    ("Bir Python fonksiyonu yaz.", "", "```python\ndef f(x):\n    retu", "truncated"), (None, None, "Kopru eski kentte kuruldu. Bugun her gun kisi onu geciyor.", None),
]


def test_pair_defects(spark):
    rows = [(i, *c[:3], None, "clash") for i, c in enumerate(CASES)]
    known = pd.read_parquet("/root/testdata/sf0.001/sft_examples.parquet")
    own = [tuple(x if isinstance(x, str) else None for x in row) for row in zip(known["instruction"], known["input"], known["output"])]
    chain = pair_defects.fit([*own, *(c[:3] for c in CASES if c[3] is None)])
    got = {r.example_id: r.defect_type for r in pair_defects.defects(spark.createDataFrame([*rows, rows[1]], PAIRS), chain).collect()}
    assert got == {i: c[3] for i, c in enumerate(CASES) if c[3]}


def test_pair_defects_of_long_and_no_rows(spark):
    rows = [(1, "Anlat.", None, GOOD * 20000, None, "")]
    assert pair_defects.defects(spark.createDataFrame(rows, PAIRS)).count() == 0
    assert pair_defects.defects(spark.createDataFrame([], PAIRS)).count() == 0


def test_chain_learns_and_marginals_are_probabilities():
    r = np.random.default_rng(1)
    length = r.integers(1, 6, 300)
    dense = np.c_[r.random((length.sum(), 2)), np.ones(length.sum())]
    col = r.integers(0, 8, length.sum())
    tags = ((dense[:, 0] > 0.5) | (col == 3)).astype(int)
    p = crf.Places(dense, np.arange(len(dense)), col, np.ones(len(dense)), length)
    chain = crf.Chain(3, 8, 2).fit(p, tags, np.ones(300), epochs=60, size=64)
    assert (chain.tag(p) == tags).mean() > 0.95
    live = np.array([[True, True, False]])
    one, two = chain._marginals(r.random((1, 3, 2)), live)
    assert np.allclose(one[0, :2].sum(1), 1) and one[0, 2].sum() == 0 and np.isclose(two.sum(), 1)


def test_tags_are_those_of_the_best_path():
    r = np.random.default_rng(2)
    chain = crf.Chain(2, 4, 3)
    chain.emit, chain.bins, chain.move, chain.start = r.normal(size=(2, 3)), r.normal(size=(4, 3)), r.normal(size=(3, 3)), r.normal(size=3)
    length = np.array([3, 1, 4, 2])
    n = length.sum()
    p = crf.Places(r.normal(size=(n, 2)), np.arange(n), r.integers(0, 4, n), np.ones(n), length)
    got, s, at = chain.tag(p), chain.scores(p), 0
    for k in length:
        paths = {t: chain.start[t[0]] + sum(s[at + i, x] for i, x in enumerate(t)) + sum(chain.move[x, y] for x, y in zip(t, t[1:])) for t in itertools.product(range(3), repeat=int(k))}
        assert tuple(got[at : at + k]) == max(paths, key=paths.get)
        at += k


def test_defects_of_other_wording_than_was_fitted_on():
    """Refusals with verbs the fit has not seen, and other defects made from pairs it has not seen."""
    rows = pd.read_parquet("/root/testdata/sf0.01/sft_examples.parquet").drop_duplicates("example_id")
    pairs = [tuple(x if isinstance(x, str) else None for x in row) for row in zip(rows["instruction"], rows["input"], rows["output"])]
    known, held = pairs[::2], [p for p in pairs[1::2] if p[2] and len(p[2]) > 30]
    chain = pair_defects.fit(known, pair_defects.DECLINED[::2])
    r = random.Random(3)
    asked = [p for p in held if "çevir" not in (p[0] or "")]
    refused = [(i, g, pair_defects.refusal(r, i or "", pair_defects.DECLINED[1::2])) for i, g, _ in asked]
    got = pair_defects.judge(chain, refused)
    assert sum(d == "refusal" for d in got) / len(got) > 0.95
    fine = [p for p, d in zip(held, pair_defects.judge(chain, held)) if d is None]
    own = pair_defects.Batch(fine)
    want = {"echo": "copy", "foreign": "language", "unfinished": "truncated"}
    made = [(p, want[t]) for p, t, _ in pair_defects.made(fine, own, r) if t in want]
    for name in want.values():
        some = [p for p, t in made if t == name]
        right = [d == name for d in pair_defects.judge(chain, some)]
        assert sum(right) / len(right) > (0.8 if name == "truncated" else 0.95), (name, sum(right) / len(right))  # some cuts leave a whole sentence
    assert len(fine) / len(held) > 0.8


DOCS = "doc_id bigint, text string, kind string, value string"
LABELS = "doc_id bigint, annotator int, doc_kind string, reading_level string"


def made(n, seed):
    """(text, kind) of structures by rule, of other words than the seeds have."""
    r = random.Random(seed)
    names = "Kavo Tuzi Lemora Badisu Nikola Serapa Gomeri Zeluta".split()
    out = []
    for i in range(n):
        k = i % 4
        if k == 0:
            out.append((" ".join(f"{r.choice(names)} ile kent arasında dar yollar uzanıyor, ama kimse bugün bu yolu kullanmadı." for _ in range(5)), "prose"))
        elif k == 1:
            out.append(("\n".join(f"- {r.choice(names)} kapısı" for _ in range(12)), "list"))
        elif k == 2:
            out.append(("\n".join(f"{r.choice(names)};{r.randint(1, 9999)};{r.randint(1, 9999)}" for _ in range(12)), "table"))
        else:
            out.append(("".join(r.choice("%#$*<>=+-_/|") * r.randint(1, 6) for _ in range(60)), "junk"))
    return out


def test_kinds_without_marks(spark):
    rows = made(40, 1)
    docs = spark.createDataFrame([(i, t, "clash", "") for i, (t, _) in enumerate(rows)] + [(90, None, "", ""), (91, " \n ", "", ""), (92, rows[0][0] * 300, "", ""), (93, "\x1e퟿", "", "")], DOCS)
    profiles = structure.learn(docs, spark.createDataFrame([], LABELS))
    got = {r.doc_id: r for r in structure.statistics(docs, profiles).collect()}
    assert [got[i].kind for i in range(40)] == [k for _, k in rows]
    assert got[90].kind is None and got[91].kind is None and got[90].words == 0 and got[92].kind == "prose" and len(got) == 44
    assert got[0].language == "tr" and got[0].words == 65 and got[0].lines == 1 and got[0].lines_ended == 1
    assert structure.statistics(docs.limit(0), profiles).count() == 0


def test_wrong_marks_are_outvoted():
    rows = made(400, 2)
    kinds = np.array([structure.KINDS.index(k) for _, k in rows])
    marks = kinds.copy()
    marks[::17] = (marks[::17] + 1) % 4
    parts = structure.parts_of([t for t, _ in rows])
    got, _ = structure.fit(parts, marks).nearest(structure.parts_of([t for t, _ in made(80, 3)]))
    assert (got == np.array([structure.KINDS.index(k) for _, k in made(80, 3)])).mean() > 0.97


def test_divergence():
    p = np.array([[0.5, 0.5, 0.0], [1.0, 0.0, 0.0]])
    d = structure.jensen_shannon(p, p)
    assert d[0, 0] == pytest.approx(0, abs=1e-5) and d[0, 1] == pytest.approx(0.3113, abs=1e-3)


TEMEL = ["Ev çok büyük.", "Kedi sütü içti.", "Çocuk okula gitti.", "Annem elma aldı.", "Top kırmızı."]
ILERI = ["Kuramsal çerçevenin yöntembilimsel varsayımlarla ilişkilendirilmesi, kavramsallaştırmanın bağlamsal boyutlarının yeniden değerlendirilmesini gerektirmektedir.", "Toplumsallaşma süreçlerinin çokkatmanlı yapılandırılması, kurumsal söylemin belirsizliğini derinleştiren epistemolojik kırılmalarla açıklanmaktadır."]
ORTA = ["Belediye yeni otobüs hatlarını dün akşam duyurdu ve pazar günü seferlerin başlayacağını söyledi.", "Üreticiler fiyatların yükselmesinden yakınıyor, ama kooperatif destek vereceğini açıkladı."]


def test_reading_levels(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(90):
        k = i % 3
        rows.append((i, " ".join(r.choice((TEMEL, ORTA, ILERI)[k]) for _ in range(6)), "", ""))
        if i < 60:
            labels.append((i, 1, "prose", reading_level.LEVELS[k] if i % 20 else "temel"))
    rows += [(200, None, "", ""), (201, "", "", ""), (202, "Bu yol uzun bir yoldur ki\nGider dağın ardına\nBekler orada bir eski han\nAçar bize kapısını\nGelir geceden bir ses", "", ""), (203, " ".join(["The people of the town walk over the old bridge and they like it."] * 5), "", ""), (204, "\n".join(f"- elma {i}" for i in range(12)), "", "")]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    got = {x.doc_id: x.level for x in reading_level.assess(docs, structure.learn(docs, marks), reading_level.learn_levels(docs, marks)).collect()}
    assert np.mean([got[i] == reading_level.LEVELS[i % 3] for i in range(60, 90)]) > 0.95
    assert all(got[i] is None for i in range(200, 205))


def test_reading_levels_without_marks(spark):
    docs = spark.createDataFrame([(1, " ".join(TEMEL), "", ""), (2, " ".join(ILERI), "", "")], DOCS)
    model = reading_level.learn_levels(docs, spark.createDataFrame([], LABELS))
    got = {x.doc_id: x.level for x in reading_level.assess(docs, structure.learn(docs, spark.createDataFrame([], LABELS)), model).collect()}
    assert got == {1: "temel", 2: "ileri"}


def test_sentences_keep_numbers_together():
    s = reading_level.Sentences(["Saat 3.14 idi. Sonra gitti!\n\nYeni bölüm", "", "Tek"])
    assert s.doc.tolist() == [0, 0, 0, 2] and s.words.tolist() == [4, 2, 2, 1]


@pytest.fixture(scope="module")
def vocabulary():
    data = bpe.read_vocabulary(f"{bpe.TOKENIZERS}/{bpe.VOCAB}")
    return data, tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.parse_ranks(data), special_tokens={})


ODD = ["", " ", "\n\n  x", "aaaaaaaa" * 50, "İstanbul’da 12'si  var\r\n", "日本語 🙂👍🏽", "<|endoftext|>", "é̈", "\x00\x1e", "don't I'll", "a" * 5000 + " " + "\t" * 300]


def test_ids_are_those_of_the_library(vocabulary):
    data, library = vocabulary
    enc, r = bpe.Encoder(data), random.Random(7)
    texts = ODD + ["".join(r.choice("abcçdeğıİöşü  \n.,0123'-日本🙂xyz") for _ in range(r.randint(0, 120))) for _ in range(1500)]
    for t in texts:
        assert enc.encode(t) == library.encode_ordinary(t)
    words = ["".join(r.choice("abcde") for _ in range(r.randint(1, 40))).encode() for _ in range(800)] * 3
    for w in words:  # the third time every transition is a made one
        assert enc.transducer.encode_bytes(w) == bpe.merge(w, enc.transducer.ranks)


def test_small_tables_start_anew(vocabulary, monkeypatch):
    data, library = vocabulary
    monkeypatch.setattr(bpe, "TRANSITIONS", 50)
    monkeypatch.setattr(bpe, "MEMO", 20)
    enc, r = bpe.Encoder(data), random.Random(8)
    for _ in range(400):
        t = "".join(r.choice("abcdefgh ") for _ in range(90))
        assert enc.encode(t) == library.encode_ordinary(t)


def test_streaming_decoder(vocabulary):
    data, library = vocabulary
    token = {i: t for t, i in bpe.parse_ranks(data).items()}
    for t in ODD:
        d = bpe.Decoder(token)
        assert "".join(d.feed([i]) for i in library.encode_ordinary(t)) + d.finish() == t
    d = bpe.Decoder({0: b"\xf0\x9f", 1: b"\x99\x82", 2: b"a", 3: b"\xff"})
    assert [d.feed([0]), d.feed([1]), d.feed([0]), d.feed([2]), d.feed([3])] == ["", "🙂", "", "�a", "�"]
    assert (d.feed([0]), d.finish()) == ("", "�")


def test_encode_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "ev", None), (3, "ev", None), (4, "z " * 200000, "")], "doc_id bigint, text string, ids string")
    got = bpe.encode(df)
    assert sorted((r.doc_id, r.n) for r in got.selectExpr("doc_id", "size(ids) as n").collect())[:2] == [(1, 0), (2, 0)] and got.count() == 5
    assert {r.doc_id: r.text for r in bpe.decode(got).filter("doc_id < 4").collect()} == {1: "", 2: "", 3: "ev"}
    assert bpe.encode(df.limit(0)).count() == 0


def test_folded_words_meet():
    assert fold_words("İZMİR’DE  Çay; é​") == fold_words("izmirde cay e") == ["izmirde", "cay", "e"]
    w = Words(["a b", "", "A  b."])
    assert w.first.tolist() == [0, 2, 2, 4] and (w.hash[:2] == w.hash[2:]).all()
    assert [t for _, own in blocks(["ab", None, "cde"], 3) for t in own] == ["ab", "", "cde"]
