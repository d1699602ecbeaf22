"""The core queries over a folder of tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dokuma.functions import text as tx
from dokuma.functions.lexicon import Lexicon, load_names, load_words
from dokuma.operators import annotate, encode, sampling, sft, tokenizer, words
from dokuma.plans import cases, sql
from dokuma.session import materialise, scratch
from dokuma.sources import files
from dokuma.sources.tables import table

__all__ = ["flagship", "oracle_sql", "queries"]

BLOCK = 64


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Documents tokenised, a vocabulary built from the tokens, every document encoded with it, and the counters of the run."""
    docs = table(spark, folder, "documents").filter(encode.long_enough(F.col("text")))
    rows = materialise(tokenizer.explode_tokens(tokenizer.tokens(docs, lexicon(spark, folder))).select("doc_id", "pos", "token", "token_type"), "tokens")
    vocab = encode.build_vocab(rows, 1000).select("token", "id")
    return encode.counters(encode.sizes(encode.lookup(rows, vocab)), vocab)


def lexicon(spark: SparkSession, folder: str) -> Lexicon:
    return Lexicon.of(load_words(table(spark, folder, "lexicon").filter(~F.coalesce(F.trim("word").startswith("#"), F.lit(False)))))


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return annotate.delivered_once(table(spark, folder, "token_rows"))


def _typed_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder).filter("token is not null and token_type is not null")


def _logits(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("seq_id"), F.posexplode("embedding").alias("token_id", "v"))
    return vectors.select("seq_id", "token_id", F.round(F.col("v").cast("double") * 20, 6).alias("logit"))


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("seq_id"), F.when(F.col("label") == 0, -100).otherwise(F.col("label")).alias("target"))


def _history(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "encoded_docs").select(F.col("doc_id").alias("seq_id"), F.posexplode(F.slice("ids", F.lit(1), F.size("ids") - 1)).alias("pos", "token_id"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "sft_examples").withColumnRenamed("source", "origin")
    rank = F.when(F.lower(F.trim("origin")).startswith("finans"), 2).when(F.col("input").isNull(), 1).otherwise(0)
    named = rows.withColumn("source_rank", rank)
    return named.select(
        "example_id", "added_at", "source_rank", tx.clean(F.col("instruction")).alias("instruction"), tx.clean(F.col("input")).alias("input"), tx.clean(F.col("output")).alias("output"),
        tx.clean(F.col("origin")).alias("source"),
    )


def _doc_ids(keep: Callable) -> Callable:
    return lambda spark, folder: table(spark, folder, "documents").filter(keep(F.col("text"))).select("doc_id", F.length("text").alias("chars"))


def jsonl_scan(spark: SparkSession, folder: str) -> DataFrame:
    lines = files.parse_lines(table(spark, folder, "sft_raw").select("record_id", "payload"), "payload", "output")
    return lines.filter(encode.long_enough(F.col("text"))).select("record_id", "text")


def jsonl_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "jsonl")
    files.write_jsonl(_pairs(spark, folder).select("instruction", "input", "output", "source"), path)
    return files.read_instructions(spark, path)


def corpus_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    """Texts written as JSON lines and scanned again under both length filters."""
    path = scratch(spark, "corpus")
    files.write_jsonl(table(spark, folder, "documents").select("text"), path)
    scan = files.scan_jsonl(spark, path)
    return scan.agg(F.count_if(encode.long_enough(F.col("text"))).alias("over_50"), F.count_if(encode.long_enough(F.col("text"), strict=False)).alias("from_50"))


def name_load(spark: SparkSession, folder: str) -> DataFrame:
    return load_names(table(spark, folder, "lexicon"), "word")


def schema_inspect(spark: SparkSession, folder: str) -> DataFrame:
    frames = {t: table(spark, folder, t) for t in ("documents", "sft_examples", "encoded_docs")}
    frames["tokenised"] = frames["encoded_docs"].withColumnRenamed("ids", "input_ids")
    return spark.createDataFrame([(n, *sft.inspect(f)) for n, f in frames.items()], "name string, status string, hit array<string>")


def _kind(spark: SparkSession, folder: str) -> str:
    """The type of ids that the vocabulary's size asks for."""
    return encode.keep_last(table(spark, folder, "vocab")).agg(encode.narrow(F.count("*"), encode.NARROW_PARALLEL).alias("kind")).first().kind


def shard_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Ids written as a shard of the type the vocabulary asks for and read again as one sequence."""
    path, kind = scratch(spark, "shard"), _kind(spark, folder)
    files.write_shard(table(spark, folder, "encoded_docs"), path, kind)
    return files.read_shard(spark, path, kind, least=BLOCK + 2)


def scan_errors(spark: SparkSession, folder: str) -> DataFrame:
    return files.scan_errors(table(spark, folder, "sft_raw").select("record_id", "payload"), "payload", F.pmod("record_id", F.lit(4)), "output")


def run_meta(spark: SparkSession, folder: str) -> DataFrame:
    """The counters of a run written as JSON and read again."""
    path, own = scratch(spark, "meta"), encode_meta(spark, folder)
    files.write_meta(own, path)
    return spark.read.schema(own.schema).json(path)


def run_config(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "config")
    files.run_config(spark, {"preset": "sanity", "block": BLOCK, "val_every": encode.VAL_EVERY, "dtype": _kind(spark, folder)}, path)
    return spark.read.schema("block int, dtype string, preset string, val_every int").json(path)


def prompt_source(spark: SparkSession, folder: str) -> DataFrame:
    """The prompt of a file, which goes before the one given."""
    path = scratch(spark, "prompt")
    spark.createDataFrame([("Kısa bir şiir yaz.",)], "value string").coalesce(1).write.text(path)
    got = [("file", files.read_prompt(spark, "verilen", path).rstrip("\n")), ("given", files.read_prompt(spark, "verilen"))]
    return spark.createDataFrame(got, "source string, prompt string")


def preview(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "sft_raw").select("record_id", "payload", "source")
    return files.preview(rows.orderBy("record_id"), ("payload",))


def dtype_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The types that both encoders choose about the limit."""
    n = spark.range(65_534, 65_539).select(F.col("id").alias("vocab_size"))
    return n.select("vocab_size", encode.narrow(F.col("vocab_size")).alias("sequential"), encode.narrow(F.col("vocab_size"), encode.NARROW_PARALLEL).alias("parallel"))


def text_forms(spark: SparkSession, folder: str) -> DataFrame:
    text = tx.nfc(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", text.alias("nfc")).select("doc_id", "nfc", tx.turkish_lower(F.col("nfc")).alias("small"))


def char_predicates(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("token")
    rows = table(spark, folder, "token_rows").select("token").filter("token is not null").distinct()
    return rows.select("token", tx.has_turkish_letters(t).alias("turkish"), tx.is_all_caps(t).alias("caps"), tx.is_mixed_case(t).alias("mixed"), tx.is_punctuation(t).alias("punct"))


def clean_fields(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sft_examples").select("example_id", *[tx.clean(F.col(c)).alias(c) for c in ("instruction", "input", "output", "source")])


def typed_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "token_rows").select(tx.typed_token(F.col("token"), F.col("token_type")).alias("typed"))
    return rows.groupBy("typed").agg(F.count("*").alias("n"))


def split_typed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "vocab").select("id", tx.split_typed(F.col("token")).alias("t")).select("id", "t.kind", "t.surface")


def prompts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sft_examples").select("example_id", tx.prompt(F.coalesce("instruction", F.lit("")), F.col("input")).alias("prompt"))


def suffix_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "token_rows").filter("upper(token_type) = 'SUFFIX'").select("token").distinct()
    return rows.select("token", tx.suffix_label(F.col("token")).alias("label"), tx.morpheme(F.col("token")).alias("morpheme"))


def accented_forms(spark: SparkSession, folder: str) -> DataFrame:
    lex = load_words(table(spark, folder, "lexicon"))
    seen = table(spark, folder, "token_rows").select(tx.turkish_lower(F.col("token")).alias("word")).filter("word <> ''").distinct()
    return words.accented(seen, lex)


def span_counts(spark: SparkSession, folder: str) -> DataFrame:
    n = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), 0))
    docs = table(spark, folder, "documents").filter("text is not null")
    return docs.select("doc_id", *[n(p).alias(name) for name, p in words.COUNTED.items()])


def spans(spark: SparkSession, folder: str) -> DataFrame:
    return words.spans(table(spark, folder, "documents"), lexicon(spark, folder))


def word_split(spark: SparkSession, folder: str) -> DataFrame:
    return words.split(table(spark, folder, "documents")).groupBy("doc_id").agg(F.count_if(~F.col("blank")).alias("words"), F.count_if(F.col("blank")).alias("gaps"), F.max(F.when(~F.col("blank"), F.length("piece"))).alias("longest"))


def punct_split(spark: SparkSession, folder: str) -> DataFrame:
    return words.edges(words.split(table(spark, folder, "documents")).filter("not blank").select("piece").distinct())


def turkish_bases(spark: SparkSession, folder: str) -> DataFrame:
    seen = table(spark, folder, "token_rows").filter("token <> '' and token_type in ('ROOT', 'FOREIGN')").select(F.trim("token").alias("word")).filter("word <> ''").distinct()
    lex = load_words(table(spark, folder, "lexicon")).select(F.col("word").alias("low"), F.lit(True).alias("known"))
    met = seen.withColumn("low", tx.turkish_lower(F.col("word"))).join(lex, "low", "left")
    return met.select("word", tx.is_turkish_base(F.col("word"), F.coalesce("known", F.lit(False))).alias("turkish"))


def acronyms(spark: SparkSession, folder: str) -> DataFrame:
    """Known acronyms among the words of the documents, taken as roots, those in capitals only."""
    cores = words.edges(words.split(table(spark, folder, "documents")).filter("not blank")).select(F.col("core").alias("token"), F.lit("ROOT").alias("token_type"))
    known = annotate.acronyms(cores, tx.is_all_caps(F.col("token"))).filter("expansion is not null")
    return known.groupBy("token", "token_type", "expansion").agg(F.count("*").alias("n"))


def foreign_apostrophes(spark: SparkSession, folder: str) -> DataFrame:
    return words.foreign_apostrophes(table(spark, folder, "documents"), lexicon(spark, folder))


def segment_words(spark: SparkSession, folder: str) -> DataFrame:
    seen = words.split(table(spark, folder, "documents")).filter("not blank").select(F.col("piece").alias("word")).distinct()
    return words.segment(seen, lexicon(spark, folder))


def tokenize(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.explode_tokens(tokenizer.tokens(table(spark, folder, "documents"), lexicon(spark, folder)))


def tokenize_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The surfaces of all tokens of a document put together, in small letters with i for ı, as the suffixes after apostrophes are
    given in small letters."""
    arrays = tokenizer.tokens(table(spark, folder, "documents"), lexicon(spark, folder))
    whole = F.array_join(F.transform("tokens", lambda t: t["token"]), "")
    return arrays.select("doc_id", F.translate(F.regexp_replace(tx.turkish_lower(whole), "\u0307", ""), "ı", "i").alias("text"))


def tokenize_no_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.token_stats(tokenizer.tokens(table(spark, folder, "documents")))


def encode_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts and answers tokenised, encoded with the given vocabulary, masked and padded."""
    pairs = table(spark, folder, "sft_examples").groupBy("example_id").agg(F.max(F.struct("added_at", "instruction", "input", "output")).alias("r"))
    both = pairs.select("example_id", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), tx.prompt(F.coalesce("r.instruction", F.lit("")), F.col("r.input")).alias("text")),
        F.struct(F.lit(1).alias("side"), F.coalesce("r.output", F.lit("")).alias("text")),
    )).alias("s")).select((F.col("example_id") * 2 + F.col("s.side")).alias("doc_id"), "s.text")
    ids = words.encode_texts(both, table(spark, folder, "vocab"), lexicon(spark, folder))
    prompt = ids.filter("doc_id % 2 = 0").select(F.floor(F.col("doc_id") / 2).alias("example_id"), F.concat(F.array(F.lit(encode.BOS)), "ids").alias("prompt"))
    answer = ids.filter("doc_id % 2 = 1").select(F.floor(F.col("doc_id") / 2).alias("example_id"), F.concat("ids", F.array(F.lit(encode.EOS))).alias("answer"))
    joined = prompt.join(answer, "example_id").select("example_id", F.concat("prompt", "answer").alias("ids"), F.size("prompt").alias("prompt_len"))
    masked = sft.mask(joined, 256)
    return sft.collate(masked.select("example_id", "x", "labels"), F.floor(F.col("example_id") / 16), 256)


def vocab_topk(spark: SparkSession, folder: str) -> DataFrame:
    return encode.build_vocab(_typed_rows(spark, folder), 1000)


def _framed(spark: SparkSession, folder: str, keep_space: bool = False) -> DataFrame:
    return encode.frame(encode.lookup(_typed_rows(spark, folder), table(spark, folder, "vocab"), keep_space))


def encode_meta(spark: SparkSession, folder: str) -> DataFrame:
    vocab = table(spark, folder, "vocab")
    return encode.counters(encode.sizes(encode.lookup(_typed_rows(spark, folder), vocab)), vocab)


def worker_meta(spark: SparkSession, folder: str) -> DataFrame:
    of_docs = encode.sizes(encode.lookup(_typed_rows(spark, folder), table(spark, folder, "vocab"), True))
    return encode.worker_counters(of_docs, F.pmod("doc_id", F.lit(4)))


def _sequence(spark: SparkSession, folder: str) -> DataFrame:
    return encode.flatten(table(spark, folder, "encoded_docs"))


def random_blocks(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "encoded_docs")
    length = docs.agg(F.sum(F.size("ids")).alias("n")).first().n
    return encode.blocks_at(docs, encode.draw_starts(spark, 200, length, BLOCK), BLOCK)


def _maskable(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "encoded_docs").select("doc_id", "ids", F.floor(F.size("ids") / 3).cast("int").alias("prompt_len"))


def sft_mask(spark: SparkSession, folder: str) -> DataFrame:
    return sft.mask(_maskable(spark, folder), BLOCK).select("doc_id", "x", "labels", sft.answer_tokens().alias("answer_tokens"))


def sft_collate(spark: SparkSession, folder: str) -> DataFrame:
    return sft.collate(sft_mask(spark, folder), F.floor(F.col("doc_id") / 50), BLOCK).select("doc_id", "batch", "x", "labels")


def sft_union(spark: SparkSession, folder: str) -> DataFrame:
    own = sft.normalise(table(spark, folder, "sft_examples"), F.lit("own"))
    chat = table(spark, folder, "sft_examples").select(F.col("instruction").alias("user"), F.col("output").alias("assistant"))
    both = sft.union([own, sft.normalise(chat, F.lit("chat"), "user", None, "assistant")])
    return both.filter(sft.good_mix()).groupBy("source", "source_rank").agg(F.count("*").alias("n"), F.sum(F.length("output")).alias("chars"))


def sft_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = _pairs(spark, folder).filter(sft.good_mix())
    return sft.keep_first(rows, "source_rank", "example_id", "added_at").select("example_id", "source_rank", "instruction", "input", "output")


def sft_shuffle_cap(spark: SparkSession, folder: str) -> DataFrame:
    rows = _pairs(spark, folder).filter(sft.good_clean(F.col("source").startswith("finans"))).select("instruction", "input", "output").distinct()
    return sft.shuffle_cap(rows, 20_000)


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql() | cases.oracle_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "corpus_filter_sequential": _doc_ids(lambda t: encode.long_enough(t)),
        "corpus_filter_parallel": _doc_ids(lambda t: encode.long_enough(t, strict=False)),
        "jsonl_scan": jsonl_scan,
        "jsonl_roundtrip": jsonl_roundtrip,
        "corpus_jsonl": corpus_jsonl,
        "vocab_scan": lambda s, f: encode.keep_last(table(s, f, "vocab")),
        "vocab_by_id": lambda s, f: table(s, f, "vocab").groupBy("id").agg(F.max("token").alias("token")),
        "lexicon_load": lambda s, f: load_words(table(s, f, "lexicon")),
        "name_load": name_load,
        "schema_inspect": schema_inspect,
        "shard_roundtrip": shard_roundtrip,
        "text_forms": text_forms,
        "char_predicates": char_predicates,
        "clean_fields": clean_fields,
        "typed_tokens": typed_tokens,
        "split_typed": split_typed,
        "prompts": prompts,
        "suffix_labels": suffix_labels,
        "accented_forms": accented_forms,
        "span_counts": span_counts,
        "spans": spans,
        "word_split": word_split,
        "punct_split": punct_split,
        "turkish_bases": turkish_bases,
        "foreign_apostrophes": foreign_apostrophes,
        "segment_words": segment_words,
        "tokenize": tokenize,
        "tokenize_roundtrip": tokenize_roundtrip,
        "tokenize_no_lexicon": tokenize_no_lexicon,
        "token_stats": lambda s, f: annotate.stats(_typed_rows(s, f), sorted(tokenizer.SPECIAL_TYPES)),
        "reclassify": lambda s, f: annotate.reclassify(_rows(s, f)).groupBy("token", "token_type", "flag").agg(F.count("*").alias("n")),
        "canonical": lambda s, f: annotate.canonical(_rows(s, f)).groupBy("canonical").agg(F.count("*").alias("n")),
        "compounds": lambda s, f: annotate.compounds(_rows(s, f)).filter("parts is not null").select("doc_id", "pos", "token", "parts"),
        "acronyms": acronyms,
        "morph_pos": lambda s, f: annotate.morph_pos(_typed_rows(s, f)).select("doc_id", "pos", "token_type", "morph_pos"),
        "vocab_topk": vocab_topk,
        "encode_docs": lambda s, f: _framed(s, f),
        "encode_docs_keep_space": lambda s, f: _framed(s, f, True),
        "split_global": lambda s, f: encode.split_global(table(s, f, "encoded_docs").select("doc_id")),
        "split_by_worker": lambda s, f: encode.split_by_worker(table(s, f, "encoded_docs").select("doc_id"), F.pmod("doc_id", F.lit(4))),
        "encode_max_docs": lambda s, f: encode.first_kept(_framed(s, f), 100),
        "encode_meta": encode_meta,
        "worker_meta": worker_meta,
        "run_meta": run_meta,
        "run_config": run_config,
        "dtype_rules": dtype_rules,
        "scan_errors": scan_errors,
        "prompt_source": prompt_source,
        "preview": preview,
        "flatten_ids": _sequence,
        "pack_blocks": lambda s, f: encode.pack(table(s, f, "encoded_docs"), BLOCK),
        "random_blocks": random_blocks,
        "decode_ids": lambda s, f: encode.decode(table(s, f, "encoded_docs"), table(s, f, "vocab")),
        "encode_pairs": encode_pairs,
        "sft_union": sft_union,
        "sft_good_mix": lambda s, f: _pairs(s, f).filter(sft.good_mix()).select("example_id", "instruction", "input", "output"),
        "sft_good_clean": lambda s, f: _pairs(s, f).filter(sft.good_clean(F.col("source").startswith("finans"))).select("example_id", "instruction", "input", "output"),
        "sft_dedup": sft_dedup,
        "sft_shuffle_cap": sft_shuffle_cap,
        "sft_by_source": lambda s, f: _pairs(s, f).groupBy("source").agg(F.count("*").alias("n")),
        "sft_mask": sft_mask,
        "sft_collate": sft_collate,
        "softmax": lambda s, f: sampling.softmax(_logits(s, f), 0.7).select("seq_id", "token_id", F.round("p", 6).alias("p")),
        "top_p": lambda s, f: sampling.top_p(_logits(s, f), 0.9).filter("kept").select("seq_id", "token_id"),
        "repetition_penalty": lambda s, f: sampling.repetition_penalty(_logits(s, f), _logits(s, f).filter("token_id % 3 = 0"), 1.3).select("seq_id", "token_id", F.round("logit", 9).alias("logit")),
        "ngram_ban": lambda s, f: sampling.banned_ngrams(_history(s, f), 2),
        "draw": lambda s, f: sampling.draw(_logits(s, f)),
        "lr_schedule": lambda s, f: s.range(1, 1001).select(F.col("id").alias("step"), F.round(sampling.learning_rate(F.col("id"), 3e-4, 100, 1000), 12).alias("lr"), sampling.tokens_seen(F.col("id"), 1, 64, 1024, 4).alias("tokens")),
        "perplexity": lambda s, f: sampling.losses(_logits(s, f), _targets(s, f)).groupBy("target").agg(F.round(sampling.perplexity(F.avg("loss")), 6).alias("ppl")),
        "masked_loss": lambda s, f: sampling.cross_entropy(_logits(s, f), _targets(s, f)).select(F.round("loss", 6).alias("loss")),
        "state_summary": lambda s, f: sampling.state_summary(table(s, f, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("dtype"), F.col("p_size").cast("bigint").alias("numel"))),
    } | cases.queries()
