"""DuckDB SQL with the same results as the core queries."""

from __future__ import annotations

from dokuma.functions import tables
from dokuma.operators.spans import NUMBER
from dokuma.operators.tokenizer import SPECIAL_TYPES
from dokuma.operators.words import COUNTED
from dokuma.plans.segment_sql import segment_sql
from dokuma.plans.spans_sql import spans_sql

BLANK = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}"


_LETTER = "A-Za-zÇçĞğİıÖöŞşÜü"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(pairs: dict[str, str], a: str, b: str) -> str:
    return f"(VALUES {', '.join(f'({_q(k)}, {_q(v)})' for k, v in pairs.items())}) AS m({a}, {b})"


def _in(words) -> str:
    return "(" + ", ".join(_q(w) for w in words) + ")"


def _clean(c: str) -> str:
    return f"coalesce(regexp_replace({c}, '^[{BLANK}]+|[{BLANK}]+$', '', 'g'), '')"


ROWS = """rows_once AS (
  SELECT doc_id, pos, token, token_type FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos
    ORDER BY loaded_at DESC NULLS LAST, token DESC NULLS LAST, token_type DESC NULLS LAST) AS rn FROM token_rows) WHERE rn = 1)"""
TYPED = f"WITH {ROWS}, typed_rows AS (SELECT * FROM rows_once WHERE token IS NOT NULL AND token_type IS NOT NULL)"
PAIRS = f"""pairs AS (SELECT example_id, added_at, CASE WHEN lower(trim(source)) LIKE 'finans%' THEN 2 WHEN input IS NULL THEN 1 ELSE 0 END AS source_rank,
  {_clean("instruction")} AS instruction, {_clean("input")} AS input, {_clean("output")} AS output, {_clean("source")} AS source FROM sft_examples)"""
_MARKED = "contains({0}, '<s>[INST]') OR contains({0}, '[/INST]') OR contains({0}, '</s>')"
GOOD_MIX = f"length(instruction) BETWEEN 4 AND 4000 AND length(output) BETWEEN 4 AND 8000 AND NOT ({_MARKED.format('(instruction || chr(10) || input || chr(10) || output)')})"
_INS = "(CASE WHEN source LIKE 'finans%' THEN instruction || chr(10) || input ELSE instruction END)"
_JOINED = f"({_INS} || chr(10) || output)"
GOOD_CLEAN = f"length({_INS}) BETWEEN 5 AND 1000 AND length(output) BETWEEN 10 AND 2500 AND NOT ({_MARKED.format(_JOINED)} OR contains({_JOINED}, '###'))"
VOCAB = "v AS (SELECT token AS typed, max(id) AS id FROM vocab WHERE token IS NOT NULL GROUP BY token)"
IDS = f"""{TYPED}, {VOCAB}, ids AS (SELECT doc_id, pos, coalesce(v.id, 3) AS id FROM typed_rows LEFT JOIN v ON v.typed = '<' || token_type || '>' || token
  WHERE token <> '' AND token_type <> 'SPACE')"""
FRAMED = "framed AS (SELECT doc_id, [1] || list(id ORDER BY pos) || [2] AS ids FROM ids GROUP BY doc_id HAVING count(*) + 2 >= 16)"
SEQUENCE = """offsets AS (SELECT doc_id, ids, coalesce(sum(len(ids)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM encoded_docs),
  seq AS (SELECT CAST(start + i - 1 AS BIGINT) AS place, ids[i] AS id FROM (SELECT start, ids, unnest(range(1, len(ids) + 1)) AS i FROM offsets))"""
LOGITS = "logits AS (SELECT vec_id AS seq_id, CAST(i - 1 AS INT) AS token_id, round(CAST(embedding[i] AS DOUBLE) * 20, 6) AS logit FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"
LEX = r"lex0 AS (SELECT DISTINCT lower(regexp_replace(word, '^\s+|\s+$', '', 'g')) AS word FROM lexicon WHERE regexp_replace(word, '^\s+|\s+$', '', 'g') <> ''), lex AS (SELECT word FROM lex0 UNION SELECT left(word, length(word) - 3) FROM lex0 WHERE regexp_matches(word, 'm[ae]k$') AND length(word) > 4)"
MASKED = """masked AS (SELECT doc_id, cut[1:len(cut) - 1] AS x,
    list_transform(range(1, len(cut)), lambda i: CASE WHEN i <= greatest(least(prompt_len, len(cut) - 1) - 1, 0) THEN -100 ELSE cut[i + 1] END) AS labels
  FROM (SELECT doc_id, ids[1:65] AS cut, CAST(floor(len(ids) / 3) AS INT) AS prompt_len FROM encoded_docs WHERE len(ids) >= 4))"""


def oracle_sql() -> dict[str, str]:
    low = "lower(replace(trim(token), 'İ', 'i' || chr(775)))"  # as Unicode has it: i and a dot above
    word = "token_type IN ('ROOT', 'FOREIGN')"
    flag = f"CASE WHEN {word} AND regexp_full_match(trim(token), '{NUMBER}') THEN 'num' WHEN {word} AND {low} IN {_in(tables.UNITS)} THEN 'unit' WHEN {word} AND {low} IN {_in(tables.ROMAN)} THEN 'roman' WHEN {word} AND {low} IN {_in(tables.MONTHS)} THEN 'month' END"
    letters = r"regexp_replace(token, '[^\p{L}]', '', 'g')"
    punct = "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in "'?.,;:!-–—()[]{}\"`/\\|@#$%^&*+=<>~’‘“”′«»‹›•…·°±×÷").replace("'", "''")
    caps = r"(length({0}) >= 2 AND NOT regexp_matches({0}, '[^\p{{Lu}}]'))"
    wl = r"regexp_replace(word, '[^\p{L}]', '', 'g')"
    out = {
        "corpus_filter_sequential": "SELECT doc_id, length(text) AS chars FROM documents WHERE length(text) > 50",
        "corpus_filter_parallel": "SELECT doc_id, length(text) AS chars FROM documents WHERE length(text) >= 50",
        "jsonl_scan": "SELECT record_id, payload ->> '$.output' AS text FROM (SELECT record_id, CASE WHEN json_valid(payload) THEN payload END AS payload FROM sft_raw) WHERE json_type(payload) = 'OBJECT' AND length(payload ->> '$.output') > 50",
        "tokenize_roundtrip": "SELECT doc_id, translate(replace(lower(translate(coalesce(nfc_normalize(text), ''), 'İI', 'iı')), chr(775), ''), 'ı', 'i') AS text FROM documents",
        "jsonl_roundtrip": f"WITH {PAIRS} SELECT instruction, input, output, source FROM pairs",
        "corpus_jsonl": "SELECT count(*) FILTER (length(text) > 50) AS over_50, count(*) FILTER (length(text) >= 50) AS from_50 FROM documents",
        "vocab_scan": "SELECT token, max(id) AS id FROM vocab WHERE token IS NOT NULL GROUP BY token",
        "vocab_by_id": "SELECT id, max(token) AS token FROM vocab GROUP BY id",
        "lexicon_load": f"WITH {LEX} SELECT word FROM lex",
        "name_load": r"SELECT DISTINCT lower(n) AS name FROM (SELECT regexp_replace(word, '^\s+|\s+$', '', 'g') AS n FROM lexicon) WHERE n <> '' AND NOT starts_with(n, '#')",
        "shard_roundtrip": f"WITH {SEQUENCE} SELECT place, CAST(id AS BIGINT) AS id FROM seq",
        "scan_errors": "WITH l AS (SELECT record_id % 4 AS worker, CASE WHEN json_valid(payload) THEN payload END AS p FROM sft_raw), o AS (SELECT worker, CASE WHEN json_type(p) = 'OBJECT' THEN p END AS p FROM l) SELECT worker, count(*) AS lines, count(*) FILTER (p IS NULL) AS json_errors, count(*) FILTER (p IS NOT NULL AND NOT coalesce(length(p ->> '$.output') >= 50, false)) AS short, count(*) FILTER (length(p ->> '$.output') >= 50) AS kept FROM o GROUP BY worker",
        "dtype_rules": "SELECT n AS vocab_size, CASE WHEN n > 65535 THEN 'uint32' ELSE 'uint16' END AS sequential, CASE WHEN n <= 65536 THEN 'uint16' ELSE 'uint32' END AS parallel FROM (VALUES (65534), (65535), (65536), (65537), (65538)) AS v(n)",
        "run_config": "SELECT 64 AS block, CASE WHEN count(DISTINCT token) <= 65536 THEN 'uint16' ELSE 'uint32' END AS dtype, 'sanity' AS preset, 100 AS val_every FROM vocab",
        "prompt_source": "SELECT * FROM (VALUES ('file', 'Kısa bir şiir yaz.'), ('given', 'verilen')) AS v(source, prompt)",
        "preview": "SELECT CAST(record_id AS VARCHAR) AS record_id, left(payload, 300) AS payload, left(source, 200) AS source FROM sft_raw ORDER BY sft_raw.record_id LIMIT 2",
        "text_forms": "SELECT doc_id, nfc_normalize(text) AS nfc, lower(translate(nfc_normalize(text), 'İI', 'iı')) AS small FROM documents",
        "char_predicates": f"SELECT DISTINCT token, regexp_matches(token, '[çğışöüÇĞİŞÖÜ]') AS turkish, {caps.format(letters)} AS caps, (length({letters}) >= 2 AND regexp_matches({letters}, '\\p{{Ll}}') AND regexp_matches({letters}, '^.+\\p{{Lu}}')) AS mixed, regexp_full_match(regexp_replace(token, '^[{BLANK}]+|[{BLANK}]+$', '', 'g'), '(?:[{punct}0-9]|[^\\x{{0}}-\\x{{2FF}}\\p{{L}}])+') AS punct FROM token_rows WHERE token IS NOT NULL",
        "clean_fields": f"SELECT example_id, {', '.join(f'{_clean(c)} AS {c}' for c in ('instruction', 'input', 'output', 'source'))} FROM sft_examples",
        "typed_tokens": "SELECT CASE WHEN token <> '' THEN '<' || token_type || '>' || token END AS typed, count(*) AS n FROM token_rows GROUP BY 1",
        "split_typed": r"SELECT id, CASE WHEN regexp_matches(token, '(?s)^<[^>]*>') THEN regexp_extract(token, '(?s)^<([^>]*)>', 1) WHEN token IS NOT NULL THEN 'UNK' ELSE 'UNK' END AS kind, CASE WHEN regexp_matches(token, '(?s)^<[^>]*>') THEN regexp_extract(token, '(?s)^<[^>]*>(.*)$', 1) ELSE token END AS surface FROM vocab",
        "prompts": f"SELECT example_id, 'Kullanıcı talimatı:' || chr(10) || coalesce(instruction, '') || chr(10) || chr(10) || CASE WHEN regexp_matches(input, '[^{BLANK}]') THEN 'Ek bilgi:' || chr(10) || input || chr(10) || chr(10) ELSE '' END || 'Asistan cevabı:' || chr(10) AS prompt FROM sft_examples",
        "suffix_labels": f"SELECT token, l.v AS label, m.v AS morpheme FROM (SELECT DISTINCT token FROM token_rows WHERE upper(token_type) = 'SUFFIX') LEFT JOIN (SELECT * FROM {_values(tables.SUFFIXES, 'k', 'v')}) l ON l.k = {low} LEFT JOIN (SELECT * FROM {_values(tables.MORPHEMES, 'k', 'v')}) m ON m.k = {low}",
        "accented_forms": f"""WITH {LEX}, seen AS (SELECT DISTINCT lower(translate(token, 'İI', 'iı')) AS word FROM token_rows WHERE token <> ''),
            met AS (SELECT s.word, l.word AS accented, list_filter(range(1, length(s.word) + 1), lambda i: s.word[i] <> l.word[i]) AS changed, list_filter(range(1, length(s.word) + 1), lambda i: s.word[i] IN ('c', 'g', 'i', 'o', 's', 'u'))[1:8] AS free
              FROM seen s JOIN lex l ON translate(l.word, 'çğıöşü', 'cgiosu') = s.word AND l.word <> s.word WHERE s.word NOT IN (SELECT word FROM lex) AND NOT regexp_matches(s.word, '[^\\x00-\\x7F]'))
            SELECT word, min((cost, accented))[2] AS accented FROM (SELECT word, accented, list_sum(list_transform(changed, lambda i: CASE WHEN word[i] IN ('c', 'g', 's') THEN 1 ELSE 2 END)) AS cost FROM met WHERE list_has_all(free, changed)) GROUP BY word""",
        "span_counts": "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {n}" for n, p in COUNTED.items()) + " FROM documents WHERE text IS NOT NULL",
        "word_split": f"SELECT doc_id, count(*) FILTER (NOT blank) AS words, count(*) FILTER (blank) AS gaps, max(length(piece)) FILTER (NOT blank) AS longest FROM (SELECT doc_id, piece, regexp_matches(piece, '^[{BLANK}]') AS blank FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[{BLANK}]+|[^{BLANK}]+')) AS piece FROM documents)) GROUP BY doc_id",
        "punct_split": f"""WITH p AS (SELECT DISTINCT piece FROM (SELECT unnest(regexp_extract_all(text, '[^{BLANK}]+')) AS piece FROM documents)), l AS (SELECT piece, regexp_extract(piece, '^[^\\p{{L}}\\p{{N}}_]*') AS lead FROM p), r AS (SELECT piece, lead, substr(piece, length(lead) + 1) AS rest FROM l), t AS (SELECT *, regexp_extract(rest, '[^\\p{{L}}\\p{{N}}_]*$') AS trail FROM r)
            SELECT piece, list_transform(range(1, length(lead) + 1), lambda i: substr(lead, i, 1)) AS lead, left(rest, length(rest) - length(trail)) AS core, list_transform(range(1, length(trail) + 1), lambda i: substr(trail, i, 1)) AS trail FROM t""",
        "turkish_bases": f"""WITH {LEX}, w AS (SELECT DISTINCT trim(token) AS word FROM token_rows WHERE trim(token) <> '' AND token_type IN ('ROOT', 'FOREIGN')), k AS (SELECT word, lower(translate(word, 'İI', 'iı')) AS low, lower(translate(word, 'İI', 'iı')) IN (SELECT word FROM lex) AS known, {caps.format(wl)} AS caps, regexp_matches(word, '[çğışöüÇĞİŞÖÜ]') AS tr FROM w)
            SELECT word, CASE WHEN regexp_matches(word, '\\p{{Nd}}') OR upper(word) IN {_in(tables.ACRONYMS)} OR (caps AND NOT tr AND NOT known) THEN false WHEN tr OR low IN {_in(tables.PROPER_NOUNS)} OR known THEN true WHEN length({wl}) >= 2 AND regexp_matches({wl}, '\\p{{Ll}}') AND regexp_matches({wl}, '^.+\\p{{Lu}}') THEN false ELSE regexp_full_match(word, '\\p{{L}}{{0,3}}') AND NOT caps END AS turkish FROM k""",
        "foreign_apostrophes": rf"""WITH {LEX.replace("<> '')", "<> '' AND NOT starts_with(trim(word), '#'))", 1)},
            cut AS (SELECT doc_id, string_split(regexp_replace(text, '([{_LETTER}0-9]{{2,}})([''’])([{_LETTER}]{{1,6}})([^\p{{L}}\p{{N}}_]|$)', chr(57344) || '\1' || chr(57345) || '\2' || chr(57346) || '\3' || chr(57347) || '\4', 'g'), chr(57344)) AS own FROM documents WHERE regexp_matches(text, '[''’]')),
            piece AS (SELECT doc_id, i, string_split(own[i], chr(57345))[1] AS word, string_split(string_split(own[i], chr(57345))[2], chr(57346))[1] AS apo, string_split(string_split(own[i], chr(57346))[2], chr(57347))[1] AS suffix, string_split(own[i], chr(57347))[2] AS rest, own[i] AS own FROM (SELECT doc_id, own, unnest(range(1, len(own) + 1)) AS i FROM cut)),
            k AS (SELECT *, lower(translate(word, 'İI', 'iı')) AS low, {caps.format(wl)} AS caps, regexp_matches(word, '[çğışöüÇĞİŞÖÜ]') AS tr FROM piece),
            t AS (SELECT *, i > 1 AND lower(replace(suffix, 'İ', 'i' || chr(775))) IN {_in(tables.APOSTROPHE_SUFFIXES)} AND NOT CASE WHEN regexp_matches(word, '\p{{Nd}}') OR upper(word) IN {_in(tables.ACRONYMS)} OR (caps AND NOT tr AND low NOT IN (SELECT word FROM lex)) THEN false WHEN tr OR low IN {_in(tables.PROPER_NOUNS)} OR low IN (SELECT word FROM lex) THEN true WHEN length({wl}) >= 2 AND regexp_matches({wl}, '\p{{Ll}}') AND regexp_matches({wl}, '^.+\p{{Lu}}') THEN false ELSE regexp_full_match(word, '\p{{L}}{{0,3}}') AND NOT caps END AS parted FROM k)
            SELECT doc_id, string_agg(CASE WHEN i = 1 THEN own ELSE word || CASE WHEN parted THEN ' ' ELSE apo END || suffix || rest END, '' ORDER BY i) AS text, list(low ORDER BY i) FILTER (parted) AS bases, list(lower(replace(suffix, 'İ', 'i' || chr(775))) ORDER BY i) FILTER (parted) AS suffixes FROM t GROUP BY doc_id HAVING count(*) FILTER (parted) > 0""",
        "schema_inspect": "SELECT * FROM (VALUES ('documents', 'RAW_TEXT', []::VARCHAR[]), ('sft_examples', 'RAW_TEXT', []), ('encoded_docs', 'RAW_TEXT', []), ('tokenised', 'SKIP_TOKENIZED', ['input_ids'])) AS v(name, status, hit)",
        "token_stats": f"""{TYPED}, c AS (SELECT doc_id, count(*) AS total, count(*) FILTER (token_type = 'ROOT') AS roots, count(*) FILTER (token_type = 'SUFFIX') AS suffixes, count(*) FILTER (token_type = 'FOREIGN') AS foreign_words, count(*) FILTER (token_type = 'PUNCT') AS punct, count(*) FILTER (token_type IN {_in(sorted(SPECIAL_TYPES))}) AS special, count(*) FILTER (token_type IN ('ROOT', 'SUFFIX', 'FOREIGN') AND NOT starts_with(trim(token), '<')) AS pure FROM typed_rows GROUP BY doc_id)
            SELECT * EXCLUDE (pure), round((roots + suffixes + foreign_words + punct + special) / total * 100, 2) AS tr_pct, round(pure / total * 100, 2) AS pure_pct FROM c""",
        "reclassify": f"WITH {ROWS}, f AS (SELECT token, token_type, {flag} AS flag FROM rows_once) SELECT token, CASE WHEN flag IN ('num', 'roman') THEN 'NUM' WHEN flag = 'unit' THEN 'UNIT' WHEN flag = 'month' THEN 'ROOT' ELSE token_type END AS token_type, flag, count(*) AS n FROM f GROUP BY ALL",
        "canonical": f"WITH {ROWS} SELECT m.v AS canonical, count(*) AS n FROM rows_once LEFT JOIN (SELECT * FROM {_values(tables.MORPHEMES, 'k', 'v')}) m ON token_type = 'SUFFIX' AND m.k = {low} GROUP BY 1",
        "compounds": f"WITH {ROWS} SELECT doc_id, pos, token, string_split(m.v, '+') AS parts FROM rows_once JOIN (SELECT * FROM {_values({k: '+'.join(v) for k, v in tables.COMPOUNDS.items()}, 'k', 'v')}) m ON token_type = 'ROOT' AND m.k = {low}",
        "acronyms": f"""WITH p AS (SELECT unnest(regexp_extract_all(text, '[^{BLANK}]+')) AS piece FROM documents), c AS (SELECT regexp_replace(piece, '^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+$', '', 'g') AS token FROM p)
            SELECT token, 'ACRONYM' AS token_type, m.v AS expansion, count(*) AS n FROM c JOIN (SELECT * FROM {_values(tables.ACRONYMS, 'k', 'v')}) m ON m.k = upper(token) WHERE {caps.format(letters)} GROUP BY ALL""",
        "morph_pos": f"""{TYPED}, g AS (SELECT *, sum(CASE WHEN token_type IN ('SUFFIX', 'SPACE') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS w FROM typed_rows)
            SELECT doc_id, pos, token_type, CAST(CASE WHEN token_type = 'SUFFIX' THEN sum(CASE WHEN token_type = 'SUFFIX' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, w ORDER BY pos) ELSE 0 END AS INT) AS morph_pos FROM g""",
        "vocab_topk": f"{TYPED}, c AS (SELECT '<' || token_type || '>' || token AS token, count(*) AS n FROM typed_rows WHERE token <> '' AND token_type <> 'SPACE' GROUP BY 1), r AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS rn FROM c) SELECT token, n, CAST(rn + 3 AS INT) AS id FROM r WHERE rn <= 1000",
        "encode_docs": f"{IDS}, {FRAMED} SELECT doc_id, ids FROM framed",
        "encode_docs_keep_space": f"{IDS.replace(' AND token_type <> ' + _q('SPACE'), '')}, {FRAMED} SELECT doc_id, ids FROM framed",
        "split_global": "SELECT doc_id, CASE WHEN (row_number() OVER (ORDER BY doc_id) - 1) % 100 = 0 THEN 'val' ELSE 'train' END AS part FROM encoded_docs",
        "split_by_worker": "SELECT doc_id, CASE WHEN (row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) - 1) % 100 = 0 THEN 'val' ELSE 'train' END AS part FROM encoded_docs",
        "encode_max_docs": f"{IDS}, {FRAMED} SELECT doc_id, ids FROM framed ORDER BY doc_id LIMIT 100",
        "worker_meta": f"""{IDS.replace(' AND token_type <> ' + _q('SPACE'), '')}, s AS (SELECT doc_id, doc_id % 4 AS worker, count(*) AS n, count(*) FILTER (id = 3) AS unk FROM ids GROUP BY doc_id), k AS (SELECT worker, n + 2 AS n, (row_number() OVER (PARTITION BY worker ORDER BY doc_id) - 1) % 100 = 0 AS val FROM s WHERE n + 2 >= 16)
            SELECT worker, count(*) AS docs, (SELECT count(*) FROM k WHERE k.worker = s.worker) AS kept, sum(n) AS tokens, sum(unk) AS unk_tokens, (SELECT coalesce(sum(n), 0) FROM k WHERE k.worker = s.worker AND NOT val) AS train_ids, (SELECT coalesce(sum(n), 0) FROM k WHERE k.worker = s.worker AND val) AS val_ids FROM s GROUP BY worker""",
        "encode_meta": f"""{IDS}, {FRAMED}, s AS (SELECT len(ids) AS n, (row_number() OVER (ORDER BY doc_id) - 1) % 100 = 0 AS val FROM framed)
            SELECT (SELECT count(*) FROM s) AS docs, (SELECT coalesce(sum(n), 0) FROM s WHERE NOT val) AS train_tokens, (SELECT coalesce(sum(n), 0) FROM s WHERE val) AS val_tokens, (SELECT count(*) FROM ids) AS total_tokens, (SELECT count(*) FROM ids WHERE id = 3) AS unk_count, (SELECT count(*) FROM v) AS vocab_size, CASE WHEN (SELECT count(*) FROM v) > 65535 THEN 'uint32' ELSE 'uint16' END AS dtype, (SELECT count(*) FROM ids WHERE id = 3) / greatest((SELECT count(*) FROM ids), 1) AS unk_ratio""",
        "flatten_ids": f"WITH {SEQUENCE} SELECT place, id FROM seq",
        "pack_blocks": f"WITH {SEQUENCE}, x AS (SELECT CAST(floor(place / 64) AS BIGINT) AS block_id, list(id ORDER BY place) AS x FROM seq GROUP BY 1), y AS (SELECT CAST(floor((place - 1) / 64) AS BIGINT) AS block_id, list(id ORDER BY place) AS y FROM seq WHERE place > 0 GROUP BY 1) SELECT block_id, x, y FROM x JOIN y USING (block_id) WHERE len(x) = 64 AND len(y) = 64",
        "random_blocks": f"WITH {SEQUENCE}, starts AS (SELECT DISTINCT CAST('0x' || substr(md5('42-' || range), 1, 15) AS BIGINT) % ((SELECT count(*) FROM seq) - 65) AS start FROM range(200)), b AS (SELECT start, list(id ORDER BY place) AS ids FROM starts JOIN seq ON place BETWEEN start AND start + 64 GROUP BY start) SELECT start, ids[1:64] AS x, ids[2:65] AS y FROM b WHERE len(ids) = 65",
        "decode_ids": r"""WITH n AS (SELECT id, max(token) AS typed FROM vocab WHERE id IS NOT NULL GROUP BY id), r AS (SELECT doc_id, i, coalesce(n.typed, '<unk>') AS typed FROM (SELECT doc_id, ids[i] AS id, i FROM (SELECT doc_id, ids, unnest(range(1, len(ids) + 1)) AS i FROM encoded_docs)) LEFT JOIN n USING (id)),
            s AS (SELECT doc_id, i, regexp_extract(typed, '(?s)^<([^>]*)>', 1) AS kind, regexp_replace(typed, '(?s)^<[^>]*>', '') AS surface FROM r WHERE typed NOT IN ('<pad>', '<bos>', '<eos>')),
            p AS (SELECT doc_id, i, kind, surface, lag(surface) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM s),
            t AS (SELECT doc_id, string_agg(CASE WHEN kind IN ('SUFFIX', 'PUNCT') OR b IS NULL OR regexp_matches(b, '[ \n''’(\[{/]$') THEN surface ELSE ' ' || surface END, '' ORDER BY i) AS text FROM p GROUP BY doc_id)
            SELECT doc_id, coalesce(text, '') AS text FROM (SELECT doc_id FROM encoded_docs) LEFT JOIN t USING (doc_id)""",
        "sft_union": f"WITH {PAIRS}, u AS (SELECT instruction, input, output, 'own' AS source, 0 AS source_rank FROM pairs UNION ALL SELECT instruction, '', output, 'chat', 1 FROM pairs) SELECT source, source_rank, count(*) AS n, sum(length(output)) AS chars FROM u WHERE {GOOD_MIX} GROUP BY ALL",
        "sft_good_mix": f"WITH {PAIRS} SELECT example_id, instruction, input, output FROM pairs WHERE {GOOD_MIX}",
        "sft_good_clean": f"WITH {PAIRS} SELECT example_id, instruction, input, output FROM pairs WHERE {GOOD_CLEAN}",
        "sft_dedup": f"WITH {PAIRS}, g AS (SELECT *, row_number() OVER (PARTITION BY lower(instruction), lower(input), lower(output) ORDER BY source_rank, example_id, added_at NULLS FIRST) AS rn FROM pairs WHERE {GOOD_MIX}) SELECT example_id, source_rank, instruction, input, output FROM g WHERE rn = 1",
        "sft_shuffle_cap": f"WITH {PAIRS}, d AS (SELECT DISTINCT instruction, input, output FROM pairs WHERE {GOOD_CLEAN}) SELECT * FROM d ORDER BY md5('42' || chr(31) || instruction || chr(31) || input || chr(31) || output), instruction, input, output LIMIT 20000",
        "sft_by_source": f"WITH {PAIRS} SELECT source, count(*) AS n FROM pairs GROUP BY source",
        "sft_mask": f"WITH {MASKED} SELECT doc_id, x, labels, CAST(len(list_filter(labels, lambda v: v <> -100)) AS INT) AS answer_tokens FROM masked",
        "sft_collate": f"WITH {MASKED}, b AS (SELECT doc_id, x, labels, CAST(floor(doc_id / 50) AS BIGINT) AS batch, least(max(len(x)) OVER (PARTITION BY floor(doc_id / 50)), 64) AS n FROM masked) SELECT doc_id, batch, list_transform(range(1, n + 1), lambda i: coalesce(x[i], 0)) AS x, list_transform(range(1, n + 1), lambda i: coalesce(labels[i], -100)) AS labels FROM b",
        "softmax": f"WITH {LOGITS}, e AS (SELECT *, exp(logit / 0.7 - max(logit / 0.7) OVER (PARTITION BY seq_id)) AS e FROM logits) SELECT seq_id, token_id, round(e / sum(e) OVER (PARTITION BY seq_id), 6) AS p FROM e",
        "top_p": f"WITH {LOGITS}, e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY seq_id)) AS e FROM logits), p AS (SELECT *, e / sum(e) OVER (PARTITION BY seq_id) AS p FROM e), c AS (SELECT *, round(sum(p) OVER (PARTITION BY seq_id ORDER BY logit DESC, token_id ROWS UNBOUNDED PRECEDING) - p, 9) AS before FROM p) SELECT seq_id, token_id FROM c WHERE before <= 0.9",
        "repetition_penalty": f"WITH {LOGITS} SELECT seq_id, token_id, round(CASE WHEN token_id % 3 <> 0 THEN logit WHEN logit < 0 THEN logit * 1.3 ELSE logit / 1.3 END, 9) AS logit FROM logits",
        "ngram_ban": "WITH h AS (SELECT doc_id AS seq_id, ids, len(ids) - 1 AS n FROM encoded_docs), g AS (SELECT seq_id, ids, n, unnest(range(1, n)) AS i FROM h) SELECT DISTINCT seq_id, ids[i + 1] AS token_id FROM g WHERE ids[i] = ids[n]",
        "lr_schedule": "SELECT range AS step, round(CASE WHEN range <= 100 THEN 3e-4 * range / 100 ELSE 3e-4 * 0.5 * (1 + cos(pi() * (range - 100) / 900)) END, 12) AS lr, range * 262144 AS tokens FROM range(1, 1001)",
        "perplexity": f"WITH {LOGITS}, e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY seq_id)) AS e FROM logits), p AS (SELECT *, e / sum(e) OVER (PARTITION BY seq_id) AS p FROM e) SELECT label AS target, round(exp(least(avg(-ln(p)), 20)), 6) AS ppl FROM p JOIN embeddings ON vec_id = seq_id AND token_id = label WHERE label <> 0 GROUP BY label",
        "masked_loss": f"WITH {LOGITS}, e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY seq_id)) AS e FROM logits), p AS (SELECT *, e / sum(e) OVER (PARTITION BY seq_id) AS p FROM e) SELECT round(avg(-ln(p)), 6) AS loss FROM p JOIN embeddings ON vec_id = seq_id AND token_id = label WHERE label <> 0",
        "state_summary": "SELECT p_type AS dtype, count(*) AS tensors, sum(CAST(p_size AS BIGINT)) AS parameters FROM part GROUP BY p_type",
    }
    return out | {"run_meta": out["encode_meta"], "segment_words": segment_sql(BLANK), "spans": spans_sql(BLANK)}
