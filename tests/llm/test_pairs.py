"""Overlaps across splits and leaked passages against brute force."""

import random

import numpy as np

from dokuma.llm import leakage, split_overlap
from dokuma.llm._codes import fold_words

DOCS = "doc_id bigint, text string, split string, eval_doc string"


def slow_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def change(r, words, n):
    words = list(words)
    for _ in range(n):
        i = r.randrange(len(words))
        kind = r.random()
        if kind < 0.6:
            words[i] = "yeni" + str(r.randrange(1000))
        elif kind < 0.8:
            del words[i]
        else:
            words.insert(i, "ek" + str(r.randrange(1000)))
    return words


def corpus(r, n):
    vocabulary = [f"söz{i}" for i in range(60)]
    docs = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.choice([10, 19, 20, 21, 40, 90, 200]))]
        if docs and i % 3:
            words = change(r, r.choice(docs), r.randrange(16))
        if len(words) > 1:
            docs.append(words)
    return docs


def test_overlaps_against_brute_force(spark):
    r = random.Random(1)
    texts = corpus(r, 200)
    texts += [next(w for w in texts if len(w) == 90)] * 40
    style = [" ".join, lambda w: "\n".join(w).upper(), lambda w: ", ".join(w) + "."]
    rows = [(i, r.choice(style)(w).replace("ö", r.choice(["ö", "o", "ö"])), r.choice(["train", "train", "val", "test"]), "clash") for i, w in enumerate(texts)]
    rows += [(900, None, "val", ""), (901, "", "test", ""), rows[0]]
    got = {(x.eval_doc, x.train_doc): x.edits for x in split_overlap.overlaps(spark.createDataFrame(rows, DOCS)).collect()}
    want = {}
    folded = {i: fold_words(t) for i, t, *_ in rows if t}
    for i, _, s, _ in rows:
        for j, _, q, _ in rows:
            if s in ("val", "test") and q == "train" and i in folded and j in folded and min(len(folded[i]), len(folded[j])) >= 20:
                longest = max(len(folded[i]), len(folded[j]))
                most = int(longest * split_overlap.EDIT_SHARE + 1e-9)
                if abs(len(folded[i]) - len(folded[j])) <= most and (d := slow_edits(folded[i], folded[j])) <= most:
                    want[i, j] = d
    assert got == want and len(want) > 100


def test_overlaps_of_nothing_and_boilerplate(spark):
    assert split_overlap.overlaps(spark.createDataFrame([], DOCS)).count() == 0
    same = "ortak giriş cümlesi her belgede durur ve hiç değişmez burada "
    r = random.Random(2)
    rows = [(i, same * 2 + " ".join(f"k{r.randrange(10**6)}" for _ in range(20)), "val" if i % 2 else "train", "") for i in range(60)]
    rows.append((99, rows[1][1] + " son", "train", ""))
    docs = spark.createDataFrame(rows, DOCS)
    assert {(x.eval_doc, x.train_doc) for x in split_overlap.overlaps(docs).collect()} == {(1, 99)}


def test_texts_that_repeat_a_word(spark):
    r = random.Random(9)
    words = ["aynı"] * 150 + [f"söz{i}" for i in range(50)]
    other = list(words)
    for j in r.sample(range(150, 200), 17):
        other[j] = "yeni" + str(j)
    rows = [(1, " ".join(words), "train", ""), (2, " ".join(other), "val", ""), (3, " ".join(["aynı"] * 200), "train", ""), (4, " ".join(["aynı"] * 190), "test", ""), (5, "aynı " * 30, "train", "")]
    docs = spark.createDataFrame(rows, DOCS)
    want = {(2, 1): 17, (4, 3): 10}
    for most in (split_overlap.MOST_ENTRIES, 0):  # with a filter and without
        assert {(x.eval_doc, x.train_doc): x.edits for x in split_overlap.overlaps(docs, most).collect()} == want


def test_texts_built_to_share_a_digest(spark):
    sign = [bin(i).count("1") % 2 for i in range(1024)]  # the two orders have equal sums weighted by powers of any odd number modulo 2**64
    text, other = ["ab"[x] for x in sign], ["ba"[x] for x in sign]
    near = ["yeni" + str(i) if i % 50 == 49 else x for i, x in enumerate(text)]
    assert slow_edits(text, other) > split_overlap.budget(1024) >= slow_edits(text, near) == 20
    rows = [(1, " ".join(other), "train", ""), (2, " ".join(text), "val", ""), (3, " ".join(near), "train", "")]
    assert {(x.eval_doc, x.train_doc): x.edits for x in split_overlap.overlaps(spark.createDataFrame(rows, DOCS)).collect()} == {(2, 3): 20}


def test_stretches_hold_a_shingle():
    n = np.arange(split_overlap.MIN_WORDS, 200_000)
    assert (n // (split_overlap.widest(n) + 1)).min() >= split_overlap.Q


def test_report_counts_pairs_without_making_them(spark, tmp_path):
    r = random.Random(12)
    text = lambda: " ".join(f"k{r.randrange(10**6)}" for _ in range(30))
    a, b = text(), text()
    rows = [(i, a if i < 12 else b if i < 20 else text(), "train" if i % 4 == 0 else "val" if i % 4 == 1 else "test", "x" if i % 2 else None) for i in range(40)]
    rows.append((50, a + " ek", "train", "x"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, split string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pairs = [tuple(x) for x in split_overlap.overlaps(docs).select("eval_doc", "train_doc").collect()]
    of = {i: (s, q) for i, _, s, q in rows}
    want = {}
    for e, _ in pairs:
        want.setdefault(of[e], []).append(e)
    got = {(x.split, x.source): (x.documents, x.pairs) for x in split_overlap.p7_report(spark, str(tmp_path)).collect()}
    assert got == {k: (len(set(v)), len(v)) for k, v in want.items()} and len(pairs) > 30


def test_word_edits():
    r = random.Random(3)
    for _ in range(1500):
        a, b = ([r.randrange(4) for _ in range(r.randrange(12))] for _ in "ab")
        most = r.randrange(10)
        assert split_overlap.word_edits(a, b, most) == min(slow_edits(a, b), most + 1)


def test_filters_lose_nothing(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'x' AS text")
    ids = spark.range(0, 1000, 7)
    want = {x.id for x in ids.collect()}
    passed = {x.doc_id for x in split_overlap.some_texts(docs, ids).collect()}
    assert want <= passed and len(passed) < 300
    assert split_overlap.some_texts(docs, ids, 10).count() == 3000 and split_overlap.some_texts(docs, ids.limit(0)).count() == 0


ITEMS = "item_id bigint, task string, text string, doc_id string"


def planted(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bcdfglmnrst") + r.choice("aeiou") for _ in range(r.randint(2, 4)))
    lead = "Aşağıdaki parçaya göre soruyu hemen yanıtlayınız"
    items = [(i, "t", (lead + ": " if i % 2 else "") + " ".join(word() for _ in range(r.choice([10, 24, 60]))), "") for i in range(40)]
    items += [(90, "t", "Doğru mu yanlış mı", ""), (91, None, None, ""), (92, "t", "", "")]
    docs, want = [], set()
    for d in range(160):
        filler = lambda n: [word() for _ in range(n)]
        i = r.randrange(40)
        words = items[i][2].split()
        n = len(words)
        share, changed = r.choice([(0.6, 0), (0.8, 0), (1.0, 1), (0.3, 0), (0.2, 0)])
        size = int(np.ceil(n * share))
        begin = r.randint(0, n - size)
        part = words[begin : begin + size]
        if changed and n >= 24:
            part[size // 2] = "degisik"
        text = " ".join(filler(r.randint(0, 80)) + part + filler(r.randint(0, 80)))
        docs.append((d, r.choice([text, text.upper(), text.replace(" ", "\n"), text.replace(" ", ", ")]), "train", ""))
        if share >= 0.6:
            want.add((i, d))
    docs += [(500, None, "train", ""), (501, "", "train", ""), (502, " ".join(items[0][2] for _ in range(300)), "train", ""), docs[0]]
    return items, docs, want | {(0, 502)}


def test_leaks(spark, monkeypatch):
    items, docs, want = planted(4)
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert {(x.item_id, x.doc_id) for x in leakage.leaks(d, i).collect()} == want
    monkeypatch.setattr(leakage, "BLOCK_LETTERS", 2000)
    assert len(list(leakage._item_blocks(i))) > 2
    assert {(x.item_id, x.doc_id) for x in leakage.leaks(d, i).collect()} == want
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0


def edited(r, part, k, mode):
    """The part with k words changed, lost or added, its ends kept."""
    part = list(part)
    for _ in range(k):
        j, m = r.randint(1, max(1, len(part) - 2)), r.choice("sdi") if mode == "x" else mode
        if m == "s":
            part[j] = "q" * r.randint(1, 20)
        elif m == "d":
            del part[j]
        else:
            part.insert(j, "w" * r.randint(1, 20))
    return part


def test_no_passage_is_lost():
    """Whatever is found by aligning every item with every document over the whole table is found by the index."""
    r = random.Random(6)
    word = lambda a, b: "".join(r.choice("bcdfglmnrst") + r.choice("aeiou") for _ in range(r.randint(a, b)))
    makers = [lambda: word(2, 4), lambda: word(1, 1), lambda: r.choice(["o", "bu", "ne", "da", "ve", "su"])]
    cases = [(240, 132, 13, "i"), (400, 220, 21, "i")] + [(n, None, None, m) for n in (10, 11, 14, 20, 33, 60, 120, 240) for m in "sdix" for _ in range(5)]
    qualify = 0
    for n, span, k, mode in cases:
        make = makers[0] if span else r.choice(makers)
        item = [make() for _ in range(n)]
        ix = leakage.Index([(1, " ".join(item)), (2, " ".join(word(2, 4) for _ in range(30)))])
        for _ in range(2):
            size = span or r.randint(-(-n // 2), n)
            at = r.randint(0, n - size)
            part = edited(r, item[at : at + size], int(size * leakage.CHANGED * r.random()) if k is None else k, mode)
            doc = " ".join([make() for _ in range(r.randint(0, 60))] + part + [make() for _ in range(r.randint(0, 60))])
            want = leakage.passage(fold_words(" ".join(item)), fold_words(doc))[0] * 2 >= n
            assert any(i == 0 for _, i, *_ in leakage._scan(ix, [doc])) == want
            qualify += want
    assert qualify > 200


def test_short_words_are_looked_for_by_runs():
    item = "o ne bu su da ve ki de mi ya"
    ix = leakage.Index([(7, item)])
    assert len(ix.runs.code) and [x[1:3] for x in leakage._scan(ix, ["ev " * 40 + "ne bu su da ve ki" + " ev" * 40, "ne bu su ki", ""])] == [(0, 6)]


def test_runs_are_long_enough():
    """Every passage holds RUN unedited words in a row."""
    for s in range(-(-leakage.MIN_WORDS // 2), 500):
        k = int(s * leakage.CHANGED)
        assert -(-(s - k) // (k + 1)) >= leakage.RUN


def test_passage():
    assert leakage.passage(list("abcdefgh"), list("xxabcdxx")) == (4, 4)
    assert leakage.passage(list("abcdefghij"), list("zabcdeXghijz")) == (10, 9)
    assert leakage.passage(list("abcd"), []) == (0, 0)
