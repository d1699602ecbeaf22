"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dokuma.llm import bpe, formatting_dups, leakage, packing, pair_defects, reading_level, source_mix, split_overlap, structure, term_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": pair_defects.p1_found,
        "p1_summary": pair_defects.p1_summary,
        "p2_found": packing.p2_found,
        "p2_fill": packing.p2_fill,
        "p2_conflicts": packing.p2_conflicts,
        "p3_found": formatting_dups.p3_found,
        "p3_groups": formatting_dups.p3_groups,
        "p4_found": term_counts.p4_found,
        "p4_terms": term_counts.p4_terms,
        "p5_found": source_mix.p5_found,
        "p5_report": source_mix.p5_report,
        "p6_found": structure.p6_found,
        "p6_statistics": structure.p6_statistics,
        "p7_found": split_overlap.p7_found,
        "p7_report": split_overlap.p7_report,
        "p8_ids": bpe.p8_ids,
        "p8_roundtrip": bpe.p8_roundtrip,
        "p9_found": leakage.p9_found,
        "p9_items": leakage.p9_items,
        "p10_found": reading_level.p10_found,
        "p10_levels": reading_level.p10_levels,
    }


_CANON = "coalesce(regexp_replace(lower(translate(nfc_normalize({0}), 'İIı', 'iii')), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), '')"
_KEY = " || chr(31) || ".join(_CANON.format(c) for c in ("instruction", "input", "output"))

_RECORDS = f"""
WITH records AS (
  SELECT example_id AS rec_id, instruction, input, output FROM sft_examples
  UNION ALL
  SELECT record_id, payload ->> '$.instruction', payload ->> '$.input', payload ->> '$.output'
  FROM (SELECT record_id, CASE WHEN json_valid(payload) THEN payload END AS payload FROM sft_raw)
  WHERE json_type(payload) = 'OBJECT'
), keyed AS (SELECT rec_id, {_KEY} AS k FROM records),
groups AS (SELECT k, min(rec_id) AS kept_id, count(DISTINCT rec_id) AS copies FROM keyed GROUP BY k)
"""

_TERMS = r"""
WITH last AS (
  SELECT doc_id, regexp_replace(token, '^\s+|\s+$', '', 'g') AS token, upper(token_type) AS token_type
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY loaded_at DESC NULLS LAST, token DESC NULLS LAST, token_type DESC NULLS LAST) AS rn
        FROM token_rows WHERE doc_id IS NOT NULL) WHERE rn = 1
), terms AS (
  SELECT token, token_type, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM last
  WHERE token <> '' AND token_type IS NOT NULL AND token_type <> 'SPACE' GROUP BY token, token_type
), marked AS (
  SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.5 * (SELECT count(DISTINCT doc_id) FROM last) THEN 'common' END AS mark FROM terms
)
"""

_MIX = r"""
WITH sizes AS (
  SELECT lower(translate(regexp_replace(source, '^\s+|\s+$', '', 'g'), 'İIı', 'iii')) AS source, coalesce(length(output), 0) AS size
  FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY added_at DESC NULLS LAST, source DESC NULLS LAST, coalesce(length(output), 0) DESC) AS rn FROM sft_examples)
  WHERE rn = 1
), targets AS (SELECT *, lower(translate(regexp_replace(source, '^\s+|\s+$', '', 'g'), 'İIı', 'iii')) AS own FROM mix_targets WHERE source IS NOT NULL),
per AS (SELECT m.source, m.target_share, m.max_repeats, coalesce(sum(s.size), 0) AS size FROM targets m LEFT JOIN sizes s ON s.source = m.own GROUP BY ALL)
SELECT source FROM per WHERE size * max_repeats < target_share * (SELECT sum(size) FROM per)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """
            SELECT 'text' AS item_kind, doc_id AS item_id FROM documents
            WHERE length(text) > (SELECT capacity FROM pack_limits WHERE item_kind = 'text')
            UNION
            SELECT 'output', example_id FROM sft_examples
            WHERE length(output) > (SELECT capacity FROM pack_limits WHERE item_kind = 'output')""",
        "p3_found": _RECORDS + "SELECT DISTINCT kept_id, rec_id AS copy_id FROM keyed JOIN groups USING (k) WHERE rec_id <> kept_id",
        "p3_groups": _RECORDS + "SELECT kept_id, copies FROM groups",
        "p4_found": _TERMS + "SELECT token, token_type, mark FROM marked WHERE mark IS NOT NULL",
        "p4_terms": _TERMS + "SELECT token, token_type, occurrences, records, mark FROM marked",
        "p5_found": _MIX,
        "p8_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
