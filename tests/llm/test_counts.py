"""Packing, formatting duplicates, term counts and mixing."""

import random
import re
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from dokuma.llm import formatting_dups as dups
from dokuma.llm import packing, source_mix, term_counts

ITEMS = "item_kind string, item_id bigint, length int, cluster bigint, source string, slice string"


def packed(spark, rows, capacity=100, **kw):
    things = spark.createDataFrame(rows, ITEMS)
    limits = spark.createDataFrame([("a", capacity), ("a", capacity), ("b", None)], "item_kind string, capacity int")
    return [r.asDict() for r in packing.pack(things, limits, **kw).collect()]


def test_packing_keeps_items_whole_and_blocks_within_capacity(spark):
    r = random.Random(1)
    rows = [("a", i, r.choice([0, 1, 7, 33, 60, 99, 100, 101, 250, 300, r.randint(0, 400)]), i % 50, None, "x") for i in range(400)] + [("a", 900, None, 1, "s", None), ("c", 901, 5, 1, "s", "x"), ("a", None, 5, 1, "s", "x"), (None, 902, 5, 1, "s", "x")]
    rows += [("a", 1000 + i, 10, None, None, None) for i in range(9)]
    out = packed(spark, rows)
    size = {i: n for k, i, n, *_ in rows if k == "a" and n is not None and i is not None}
    pieces = defaultdict(list)
    fill, clusters = Counter(), defaultdict(list)
    for x in out:
        pieces[x["item_id"]].append((x["begin"], x["length"]))
        fill[x["block"]] += x["length"]
        if x["length"] < 100 and x["item_id"] < 1000:
            clusters[x["block"]].append(x["item_id"] % 50)
    assert set(pieces) == set(size) and max(fill.values()) <= 100
    for i, own in pieces.items():
        own.sort()
        assert sum(n for _, n in own) == size[i] and (len(own) == 1) == (size[i] <= 100) and own[0][0] == 0
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
    assert all(len(set(c)) == len(c) for c in clusters.values())


def test_packing_is_tight_without_conflicts(spark):
    r = random.Random(2)
    rows = [("a", i, r.randint(1, 60), i, "s", "x") for i in range(2000)]
    out = packed(spark, rows)
    assert len({x["block"] for x in out}) <= sum(n for _, _, n, *_ in rows) / 100 * 1.02 + 1


def test_a_third_of_copies_and_conflicting_sources(spark):
    rows = [("a", i, 30, 1 if i % 3 == 0 else 1000 + i, "x" if i % 2 else "y", "t") for i in range(600)]
    out = packed(spark, rows, conflicts={"x": ["y"]})
    by = defaultdict(list)
    for o in out:
        by[o["block"]].append(o["item_id"])
    assert sum(map(len, by.values())) == 600
    for own in by.values():
        assert sum(i % 3 == 0 for i in own) <= 1 and len({i % 2 for i in own}) == 1


def test_fill_is_near_the_bound(spark):
    folder = "/root/testdata/sf0.01"
    for r in packing.p2_fill(spark, folder).collect():
        capacity = {x.item_kind: x.capacity for x in spark.read.parquet(f"{folder}/pack_limits.parquet").collect()}[r.item_kind]
        assert r.blocks <= -(-r.chars // capacity) * 1.01 + 2, r
    assert [x.clashes for x in packing.p2_conflicts(spark, folder).collect()] == [0, 0]


def test_best_fit_takes_the_tightest_compatible_block():
    shelf = packing.Shelf(10)
    assert [shelf.put(6, 1, 1, 0), shelf.put(7, 2, 1, 0), shelf.put(3, 2, 1, 0), shelf.put(3, 4, 1, 0)] == [[0], [1], [0], [1]]


def test_packing_nothing(spark):
    assert packed(spark, []) == []


def brute_key(fields):
    out = []
    for s in fields:
        s = unicodedata.normalize("NFC", s or "")
        s = re.sub("[iıIİ]", "i", s).lower()
        out.append("".join(c for c in s if unicodedata.category(c)[0] in "LN"))
    return tuple(out)


RECORDS = "rec_id bigint, instruction string, input string, output string, kept_id string"


def test_formatting_duplicates_against_brute_force(spark):
    r = random.Random(3)
    base = [("Şu metni düzelt!", "İyi gün", "Iyi  GÜN."), ("a b", None, "ÇÖĞÜ"), ("ab", "", "cogu"), ("", " ", None), ("x1", "2", "3")]
    rows = []
    for i in range(300):
        f = base[0] if i % 3 == 0 else r.choice(base)
        styled = [None if s is None else r.choice([s, s.upper(), s.lower().replace(" ", "\n"), unicodedata.normalize("NFD", s), f"“{s}” …"]) for s in f]
        rows.append((1000 - i, *styled, "clash"))
    rows.append(rows[0])
    df = spark.createDataFrame([*rows, (None, "ab", "", "cogu", "")], RECORDS)
    keys = dups.keyed(df, "rec_id")
    groups = defaultdict(set)
    for i, *f, _ in rows:
        groups[brute_key(f)].add(i)
    want = {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    for parts in (64, 1):  # with hot keys and without
        assert {(x.kept_id, x.copy_id) for x in dups.copies(keys, parts).collect()} == want
    assert len(dups.hot_keys(keys)) > 0
    assert {(x.kept_id, x.copies) for x in dups.collapse(keys).collect()} == {(min(g), len(g)) for g in groups.values()}
    assert dups.copies(keys.limit(0)).count() == 0 and dups.collapse(keys.limit(0)).count() == 0


def test_raw_payloads(spark, tmp_path):
    sft = [(1, "A b", None, "c")]
    raw = [(2, '{"output": "C", "x": [1], "instruction": "a  B!"}'), (3, "{broken"), (4, None), (5, "[1, 2]"), (6, '"text"'), (7, '{\n "instruction": "\\u0041B", "input": null, "output": "c."}')]
    spark.createDataFrame(sft, "example_id bigint, instruction string, input string, output string").write.parquet(f"{tmp_path}/sft_examples.parquet")
    spark.createDataFrame(raw, "record_id bigint, payload string").write.parquet(f"{tmp_path}/sft_raw.parquet")
    assert {(r.kept_id, r.copy_id) for r in dups.p3_found(spark, str(tmp_path)).collect()} == {(1, 2), (1, 7)}


TOKENS = "doc_id bigint, pos int, token string, token_type string, loaded_at timestamp, mark string"


def token_rows(spark, rows):
    return spark.createDataFrame([(*r, None, "clash") for r in rows], TOKENS)


def of(counts):
    return {(x.token, x.token_type): (x.occurrences, x.records, x.mark) for x in counts.marked().collect()}


def test_term_counts_by_deltas(spark):
    r = random.Random(4)
    rows = [(d, p, r.choice(["ev", " ev ", "su", "x", "", None]), r.choice(["ROOT", "root", "SPACE", None])) for d in range(30) for p in range(12)]
    rows += r.sample(rows, 40)
    rows += [(3, 5, "ev", "ROOT")] * 300 + [(d, p, "uzun", "ROOT") for d in (40, 41) for p in range(100_000, 100_040)] + [(None, 1, "ev", "ROOT")]
    docs = per = term_counts.per_document(token_rows(spark, rows))
    whole = of(term_counts.TermCounts(spark).merge(added=docs))
    seen, of_docs = Counter(), defaultdict(set)
    last = {}
    for d, p, t, k in rows:  # ties of load time: the greater token, then type, null least
        if d is not None:
            last[d, p] = max(last.get((d, p), ((False, ""), (False, ""))), ((t is not None, t or ""), (k is not None, k or "")))
    for (d, p), ((_, t), (has, k)) in last.items():
        if t.strip() and has and k.upper() != "SPACE":
            seen[t.strip(), k.upper()] += 1
            of_docs[t.strip(), k.upper()].add(d)
    assert {k: v[:2] for k, v in whole.items()} == {k: (seen[k], len(of_docs[k])) for k in seen}
    assert all(v[2] == ("rare" if v[1] <= 2 else "common" if v[1] > 16 else None) for v in whole.values())
    assert {tuple(x) for x in term_counts.per_document(token_rows(spark, rows), 0).collect()} == {tuple(x) for x in per.collect()}  # without a filter
    part, rest = per.filter("doc_id < 10"), per.filter("doc_id >= 10")
    steps = term_counts.TermCounts(spark).merge(added=rest).merge(added=part).merge(deleted=part).merge(deleted=per.filter("doc_id = 20"), added=per.filter("doc_id = 20 or doc_id < 10"))
    assert of(steps) == whole and steps.records() == 32
    again = term_counts.TermCounts(spark, steps.path)
    assert of(again) == whole and again.version == steps.version == 4


def test_rows_without_a_place_are_told_apart(spark):
    rows = [(1, None, "ev", "ROOT"), (1, None, "ev", "ROOT"), (1, None, "su", "ROOT"), (1, 0, "ev", "ROOT"), (2, -3, "ev", "ROOT"), (2, -3, "ev", "ROOT")]
    got = {(x.doc_id, x.token): x.n for x in term_counts.per_document(token_rows(spark, rows)).collect()}
    assert got == {(1, "ev"): 2, (1, "su"): 1, (1, None): 0, (2, "ev"): 1, (2, None): 0}


def test_a_small_delta_reads_and_writes_its_buckets_only(spark):
    import glob

    rows = [(d, p, f"t{d * 50 + p}", "ROOT") for d in range(40) for p in range(50)]
    counts = term_counts.TermCounts(spark, bucket_rows=100).merge(added=term_counts.per_document(token_rows(spark, rows)))
    assert counts.buckets == 16 and len(counts.at) == 16
    before, held = dict(counts.at), of(counts)
    one = term_counts.per_document(token_rows(spark, [(99, 0, "tek", "ROOT")]))
    counts.merge(added=one)
    touched = {b for b, v in counts.at.items() if before.get(b) != v}
    assert 1 <= len(touched) <= 2 and counts.records() == 41  # the term's and the null term's
    folder = counts.path.removeprefix("file://")
    files = lambda v: glob.glob(f"{folder}/v{v}/terms/bucket=*/*.parquet")
    assert len(files(2)) == len(touched) and of(counts) == held | {("tek", "ROOT"): (1, 1, "rare")}
    counts.merge(deleted=one)
    assert of(counts) == held and counts.records() == 40
    assert len(files(1)) == 16 - len(touched) and not glob.glob(f"{folder}/v1/manifest") and counts._versions() == [2, 3]
    more = [(200 + d, p, f"u{d * 50 + p}", "ROOT") for d in range(80) for p in range(50)]
    counts.merge(added=term_counts.per_document(token_rows(spark, more)))
    assert counts.buckets == 32 and len(of(counts)) == 6000 and of(term_counts.TermCounts(spark, counts.path)) == of(counts)


def test_term_counts_of_nothing(spark):
    counts = term_counts.TermCounts(spark).merge(added=term_counts.per_document(token_rows(spark, [])))
    assert counts.marked().count() == 0 and counts.records() == 0 and term_counts.TermCounts(spark, counts.path).version == 1


EXAMPLES = "example_id bigint, source string, output string, added_at timestamp, size string"
TARGETS = "source string, target_share double, max_repeats int"


def test_mix_reaches_shares_and_reports_short_sources(spark):
    r = random.Random(5)
    rows = [(i, " Büyük " if i % 3 else "BÜYÜK", "x" * r.randint(10, 90), None, "clash") for i in range(900)]
    rows += [(1000 + i, "orta", "y" * r.randint(1, 50), None, "") for i in range(300)] + [(2000, "az", "z" * 40, None, ""), (2000, "az", "z" * 40, None, ""), (3000, None, "q", None, ""), (3001, "başka", None, None, "")]
    recs = source_mix.records(spark.createDataFrame(rows, EXAMPLES))
    targets = spark.createDataFrame([("büyük", 0.5, 1), ("orta", 0.3, 4), ("az", 0.15, 3), ("yok", 0.05, 5)], TARGETS)
    plan = source_mix.solve(recs, targets)
    assert {x.source for x in plan.filter("short").collect()} == {"az", "yok"}
    total = sum(x.size for x in plan.collect())
    mixed = source_mix.mix(recs, plan, group_rows=100)
    got = {x.source: x for x in source_mix.report(mixed, plan).collect()}
    for name, share in (("büyük", 0.5), ("orta", 0.3)):
        assert got[name].size_out == pytest.approx(share * total, rel=0.02)
    assert got["az"].most_copies == 3 and got["az"].size_out == 120 and got["yok"].size_out == 0 and got["orta"].most_copies <= 4
    assert sum(x.actual_share for x in got.values()) == pytest.approx(1)


def test_small_sources_end_within_a_record_of_their_goal(spark):
    r = random.Random(8)
    rows, targets = [], []
    for k, n in enumerate([1, 2, 3, 5, 8, 40, 300]):
        rows += [(1000 * k + i, f"IŞIK{k} ", "x" * r.randint(1, 200), None, "") for i in range(n)]
        targets.append((f"ışık{k}", 0.0, 4))
    recs = source_mix.records(spark.createDataFrame(rows, EXAMPLES))
    size = {x.source: x.s for x in recs.groupBy("source").agg(F.sum("size").alias("s")).collect()}
    total = sum(size.values())
    shares = [size[f"işik{k}"] * f / total for k, f in enumerate([1.6, 2.3, 0.7, 3.1, 0.2, 1.9, 0.9])]
    plan = source_mix.solve(recs, spark.createDataFrame([(t[0], s, 4) for t, s in zip(targets, shares)], TARGETS))
    assert plan.filter("short").count() == 0
    biggest = {x.source: x.m for x in source_mix.mix(recs, plan).groupBy("source").agg(F.max("size").alias("m")).collect()}
    for group_rows in (20_000, 40):
        mixed = source_mix.mix(recs, plan, group_rows)
        assert mixed.count() == len(rows) and mixed.filter("copies < 0 or copies > 4").count() == 0
        for x in source_mix.report(mixed, plan).join(plan.select("source", "goal"), "source").collect():
            assert abs(x.size_out - x.goal) <= biggest[x.source], x


def test_balance_meets_its_goal():
    r = random.Random(10)
    import numpy as np

    for _ in range(200):
        size = np.array(sorted({r.randint(0, 500) for _ in range(r.randint(1, 30))}))
        n = np.array([r.randint(1, 50) for _ in size])
        cap = r.randint(1, 5)
        goal = float((size * n).sum()) * r.random() * cap * 1.2
        lam, short = source_mix.balance(size, n, goal, cap)
        assert short == (float((size * n).sum() * cap) < goal)
        if not short and goal > 0:
            x = size / ((n * size).sum() / n[size > 0].sum())
            got = (n * size * np.minimum(np.exp(np.clip(lam * x, -700, 700)), cap)).sum()
            assert got == pytest.approx(goal, rel=1e-6)


def test_mix_of_nothing(spark):
    recs = source_mix.records(spark.createDataFrame([], EXAMPLES))
    plan = source_mix.solve(recs, spark.createDataFrame([("a", 1.0, 2)], TARGETS))
    assert plan.count() == 1 and source_mix.mix(recs, plan).count() == 0
    assert source_mix.report(source_mix.mix(recs, plan), plan).select(F.sum("size_out")).first()[0] == 0
