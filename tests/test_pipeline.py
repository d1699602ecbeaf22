import math

import pytest

from pyspark.sql import functions as F

from dokuma.operators import encode, sampling, sft
from dokuma.sources import files
from dokuma.streaming import tokens as stream

IDS = "doc_id bigint, ids array<int>"


def test_flatten_and_pack_in_order(spark):
    docs = spark.createDataFrame([(5, [5, 6]), (1, [1, 2, 3]), (3, []), (9, [9])], IDS)
    rows = encode.flatten(docs).orderBy("place").collect()
    assert [(r.place, r.id) for r in rows] == list(enumerate([1, 2, 3, 5, 6, 9]))
    assert [(r.x, r.y) for r in encode.pack(docs, 2).orderBy("block_id").collect()] == [([1, 2], [2, 3]), ([3, 5], [5, 6])]
    long = spark.createDataFrame([(i, [i] * r) for i, r in enumerate([700, 0, 1, 63, 64, 65, 2])], IDS)
    flat = [x for i, r in enumerate([700, 0, 1, 63, 64, 65, 2]) for x in [i] * r]
    assert {r.block_id: (r.x, r.y) for r in encode.pack(long, 64).collect()} == {b: (flat[b * 64 : b * 64 + 64], flat[b * 64 + 1 : b * 64 + 65]) for b in range((len(flat) - 1) // 64)}
    assert encode.flatten(docs.limit(0)).count() == 0


def test_blocks_at(spark):
    docs = spark.createDataFrame([(1, list(range(10)))], IDS)
    starts = spark.createDataFrame([(0,), (3,), (7,)], "start bigint")
    got = {r.start: (r.x, r.y) for r in encode.blocks_at(docs, starts, 3).collect()}
    assert got == {0: ([0, 1, 2], [1, 2, 3]), 3: ([3, 4, 5], [4, 5, 6])}


def test_ordinal_is_global(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert [r.ordinal for r in encode.with_ordinal(rows, "k").orderBy("k").collect()] == list(range(1000))
    assert encode.with_ordinal(rows.limit(0), "k").count() == 0


def test_lookup_without_broadcast_is_the_same(spark):
    rows = spark.createDataFrame([(1, 0, "ev", "ROOT"), (1, 1, " ", "SPACE"), (1, 2, "", "ROOT"), (1, 3, "zz", "ROOT")], "doc_id bigint, pos int, token string, token_type string")
    vocab = spark.createDataFrame([("<ROOT>ev", 4), ("<ROOT>ev", 9), (None, 5)], "token string, id int")
    a = encode.lookup(rows, vocab).collect()
    assert {(r.pos, r.id) for r in a} == {(0, 9), (3, encode.UNK)} == {(r.pos, r.id) for r in encode.lookup(rows, vocab, most_broadcast=0).collect()}


def test_drawn_starts_fit(spark):
    got = [r.start for r in encode.draw_starts(spark, 500, 20, 10).collect()]
    assert set(got) == set(range(9))
    with pytest.raises(ValueError):
        encode.draw_starts(spark, 1, 11, 10)


def test_shard_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(2, [65535, 0]), (1, [7]), (3, []), (4, None)], IDS)
    files.write_shard(docs, f"{tmp_path}/s")
    assert [(r.place, r.id) for r in files.read_shard(spark, f"{tmp_path}/s").orderBy("place").collect()] == [(0, 7), (1, 65535), (2, 0)]
    with pytest.raises(ValueError):
        files.read_shard(spark, f"{tmp_path}/s", least=4)
    wide = spark.createDataFrame([(1, [70000])], IDS)
    with pytest.raises(Exception, match="does not fit uint16"):
        files.write_shard(wide, f"{tmp_path}/w")
    files.write_shard(wide, f"{tmp_path}/w4", "uint32")
    assert [r.id for r in files.read_shard(spark, f"{tmp_path}/w4", "uint32").collect()] == [70000]


def test_shard_places_do_not_depend_on_batches(spark, tmp_path):
    docs = spark.range(3000).selectExpr("id AS doc_id", "array(cast(id AS int), 1) AS ids")
    files.write_shard(docs, f"{tmp_path}/s")
    got = files.read_shard(spark, f"{tmp_path}/s").orderBy("place").collect()
    assert [r.place for r in got] == list(range(6000)) and [r.id for r in got[::2]] == list(range(3000))


def test_decode(spark):
    vocab = spark.createDataFrame([("<ROOT>ev", 4), ("<SUFFIX>ler", 5), ("<PUNCT>(", 6), ("<pad>", 0), ("<bos>", 1), ("<eos>", 2), ("<ROOT>aa", 4), ("çıplak", 7), (None, 8)], "token string, id int")
    docs = spark.createDataFrame([(1, [1, 4, 5, 7, 6, 4, 2]), (2, []), (3, None), (4, [9, 0, 9, None])], IDS)
    assert {r.doc_id: r.text for r in encode.decode(docs, vocab).collect()} == {1: "evler çıplak(ev", 2: "", 3: "", 4: "  "}
    assert {r.text for r in encode.decode(docs.filter("doc_id < 3"), vocab.limit(0)).collect()} == {"      ", ""}


def test_first_kept_and_splits(spark):
    docs = spark.range(250).selectExpr("id * 3 AS doc_id", "array(1) AS ids")
    assert {r.doc_id for r in encode.first_kept(docs, 7).collect()} == {i * 3 for i in range(7)}
    assert {r.doc_id for r in encode.split_global(docs).filter("part = 'val'").collect()} == {0, 300, 600}


def test_texts_that_fail_are_skipped_only_if_asked(spark, monkeypatch):
    from dokuma.operators import tokenizer

    class Breaks(tokenizer.Tokenizer):
        def codes(self, text):
            if text == "kötü":
                raise ValueError(text)
            return super().codes(text)

    monkeypatch.setattr(tokenizer, "Tokenizer", Breaks)
    docs = spark.createDataFrame([(1, "iyi"), (2, "kötü"), (3, "iyi gün")], "doc_id bigint, text string")
    assert {r.doc_id: r.tokens and len(r.tokens) for r in tokenizer.tokens(docs, skip_errors=True).collect()} == {1: 1, 2: None, 3: 3}
    with pytest.raises(Exception, match="kötü"):
        tokenizer.tokens(docs).collect()


def test_jsonl_drops_broken_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "iyi"}\nbozuk\n[1]\n\n{"text": 5}\n{"x": 1}\n', encoding="utf-8")
    assert sorted(r.text for r in files.scan_jsonl(spark, str(tmp_path)).collect()) == ["5", "iyi"]


def test_keep_first_ignores_case_and_keeps_order(spark):
    rows = spark.createDataFrame([(1, "A", "", "x", 2), (2, "a", "", "X", 1), (3, "b", "", "x", 1)], "example_id int, instruction string, input string, output string, source_rank int")
    assert {r.example_id for r in sft.keep_first(rows, "source_rank", "example_id").collect()} == {2, 3}


def test_tokenised_sources_are_left_out(spark):
    good = spark.createDataFrame([("a", "b")], "instruction string, output string")
    assert sft.union([good.withColumnRenamed("output", "input_ids"), good]).count() == 1
    assert sft.inspect(good.withColumnRenamed("output", "labels")) == ("SKIP_TOKENIZED", ["labels"])


def test_mask_and_collate(spark):
    rows = spark.createDataFrame([(1, [1, 5, 6, 7, 2], 3), (2, [1, 5, 2], 1), (3, [1, 8, 9, 2], 9)], "doc_id bigint, ids array<int>, prompt_len int")
    got = {r.doc_id: r for r in sft.mask(rows, 8).collect()}
    assert set(got) == {1, 3} and got[1].x == [1, 5, 6, 7] and got[1].labels == [-100, -100, 7, 2] and got[3].labels == [-100, -100, 2]
    padded = {r.doc_id: r for r in sft.collate(sft.mask(rows, 8), F.lit(0), 8).collect()}
    assert padded[3].x == [1, 8, 9, 0] and padded[3].labels == [-100, -100, 2, -100]


def test_sampling(spark):
    logits = spark.createDataFrame([(1, 0, 2.0), (1, 1, 1.0), (1, 2, -3.0)], "seq_id int, token_id int, logit double")
    p = {r.token_id: r.p for r in sampling.softmax(logits).collect()}
    assert math.isclose(sum(p.values()), 1) and p[0] > p[1] > p[2]
    assert {r.token_id for r in sampling.top_p(logits, 0.5).filter("kept").collect()} == {0}
    seen = spark.createDataFrame([(1, 0), (1, 2), (1, 2)], "seq_id int, token_id int")
    assert {r.token_id: r.logit for r in sampling.repetition_penalty(logits, seen, 2.0).collect()} == {0: 1.0, 1: 1.0, 2: -6.0}
    history = spark.createDataFrame([(1, i, t) for i, t in enumerate([4, 5, 6, 4, 5])], "seq_id int, pos int, token_id int")
    assert [r.token_id for r in sampling.banned_ngrams(history, 3).collect()] == [6]
    assert sampling.draw(logits).count() == 1


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "Ankara'ya geldi", None), (2, None, None)], "doc_id bigint, text string, fetched_at timestamp").write.parquet(f"{tmp_path}/in")
    q = stream.tokenised(stream.read_documents(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("tok").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.doc_id: len(r.tokens) for r in spark.table("tok").collect()} == {1: 5, 2: 0}


def test_prompt_meta_and_preview(spark, tmp_path):
    (tmp_path / "p.txt").write_text("Merhaba\ndünya", encoding="utf-8")
    assert files.read_prompt(spark, "x", str(tmp_path / "p.txt")) == "Merhaba\ndünya" and files.read_prompt(spark, "x") == "x"
    with pytest.raises(ValueError):
        files.read_prompt(spark)
    files.write_meta(spark.range(1).selectExpr("3 AS docs", "'uint16' AS dtype"), f"{tmp_path}/meta")
    assert spark.read.json(f"{tmp_path}/meta").first().docs == 3
    row = files.preview(spark.createDataFrame([("a" * 500, "b" * 500, None)], "t string, o string, n int"), ("t",)).first()
    assert (len(row.t), len(row.o), row.n) == (300, 200, None)


def test_stream_counts(spark, tmp_path):
    rows = [("ev", "ROOT", "2024-07-01 10:00:00"), ("ev", "ROOT", "2024-07-01 11:00:00"), ("ev", "ROOT", "2024-07-02 01:00:00"), (None, "ROOT", "2024-07-02 01:00:00")]
    spark.createDataFrame(rows, "token string, token_type string, t string").selectExpr("token", "token_type", "cast(t as timestamp) AS loaded_at").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("token string, token_type string, loaded_at timestamp").parquet(f"{tmp_path}/in")
    q = stream.typed_counts(source).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.token, r.n) for r in spark.table("counts").collect()) == [("<ROOT>ev", 1), ("<ROOT>ev", 2)]


def test_written_tables_are_released(spark):
    from pathlib import Path

    from dokuma import session

    df = session.materialise(spark.range(3), "kept")
    folder = Path(df.inputFiles()[0].removeprefix("file://")).parent
    assert df.count() == 3 and folder.exists()
    session.release()
    assert not folder.exists()
