"""The special spans of all documents as one SQL statement.

Every pattern is tried at every place that its first sign allows; what ``finditer`` would take of
them, and then what the merge would take, is found by following pointers from each match to the
next that begins after it. Written from the patterns' definition, without the lexer of ``operators.spans``.
"""

from __future__ import annotations

from dokuma.functions import tables

_W = r"\p{L}\p{N}_"
_CAP, _LETTER = "A-ZÇĞİÖŞÜ", "A-Za-zÇçĞğİıÖöŞşÜü"
_END = f"(?:[^{_W}]|$)"


def _suffixes(fold: bool) -> str:
    own = "|".join(tables.APOSTROPHE_SUFFIXES)
    if fold:  # letter case ignored as Unicode has it: all four letters i meet
        own = own.replace("ı", "i").replace("i", "[iıIİ]")
    return f"['’](?:{own})+"


def _patterns() -> list[tuple[int, str, str, bool, str, str]]:
    """(rank, kind, first signs, whether no word may be before, pattern with the match as group 1, sign the text must hold)."""
    unit = "|".join(sorted(tables.UNITS, key=lambda u: (-len(u), u))).replace("i", "[iıIİ]")
    return [
        (0, "URL", "hHwW", False, "(?i)^((?:https?://|www\\.)[^{blank}]+)", "."),
        (1, "EMAIL", "a-zA-Z0-9._%+\\-", False, r"^([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})", "@"),
        (2, "TECH", "cCfF", False, r"(?i)^(C\+\+|C#|F#)", ""),
        (3, "HASHTAG", "#", False, f"^(#[{_W}À-ɏ]+)", "#"),
        (4, "DATE", "0-9", False, r"^([0-9]{1,2}[./\-][0-9]{1,2}[./\-][0-9]{2,4}|[0-9]{4}[./\-][0-9]{1,2}[./\-][0-9]{1,2})", ""),
        (5, "TECH", "vV0-9", True, rf"^([vV]?[0-9]+(?:\.[0-9]+)+(?:[a-zA-Z0-9._-]*[a-zA-Z0-9_])?){_END}", "."),
        (5, "TECH", "vV0-9", True, rf"^([vV]?[0-9]+(?:\.[0-9]+)+[a-zA-Z0-9._-]*[.-])[{_W}]", "."),
        (6, "ROOT_APO", "eE", True, f"(?i)^(e-devlet{_suffixes(True)}){_END}", "-"),
        (7, "ROOT", "eE", True, f"(?i)^(e-devlet){_END}", "-"),
        (8, "MENTION", "@", False, f"^(@[{_W}À-ɏ]+)", "@"),
        (9, "TECH", "/", False, r"^((?:/[a-zA-Z0-9._-]+){2,})", "/"),
        (9, "TECH", "a-zA-Z", True, r"^([a-zA-Z]:\\[a-zA-Z0-9._\-\\]+)", "\\"),
        (10, "UNIT", "$€£¥₺₽0-9", False, r"^([$€£¥₺₽][0-9]+[\.,]?[0-9]*|[0-9]+[\.,]?[0-9]*[$€£¥₺₽])", ""),
        (11, "NUM_APO", "0-9", False, f"(?i)^([0-9]+(?:[.:,][0-9]+)*{_suffixes(True)}){_END}", ""),
        (12, "HYPHENATED_APO", _LETTER, True, f"(?i)^([{_LETTER}]+(?:-[{_LETTER}0-9]+)+{_suffixes(True)}){_END}", "-"),
        (13, "ACRONYM_APO", _CAP, True, f"^((?:[{_CAP}]{{2,}}[0-9]*|[{_CAP}][0-9]+){_suffixes(False)}){_END}", ""),
        (14, "ACRONYM", _CAP, True, f"^([{_CAP}]{{2,}}[0-9]*|[{_CAP}][0-9]+){_END}", ""),
        (15, "NUM", "%0-9", False, r"^(%[0-9]+[\.,]?[0-9]*|[0-9]{1,3}(?:\.[0-9]{3})+|[0-9]+[\.,][0-9]+|[0-9]+%|[0-9]+/[0-9]+)", ""),
        (16, "NUM", "0-9", False, r"^([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)", ":"),
        (17, "NUM_UNIT", "0-9", True, f"(?i)^([0-9]+(?:[.,][0-9]+)?(?:{unit})){_END}", ""),
        (18, "NUM", "0-9", True, f"^([0-9]+){_END}", ""),
        (19, "EMOJI", r"\x{1f600}-\x{1f64f}\x{1f300}-\x{1f5ff}\x{1f680}-\x{1f6ff}\x{1f1e0}-\x{1f1ff}\x{2700}-\x{27bf}\x{1f900}-\x{1f9ff}\x{2600}-\x{26ff}", False, "^([{first}]+)", ""),
        (20, "EMOJI", ":;=<", False, r"^([:;=]-?[\)\(\]\[dDpPoO3]|<3)", ""),
    ]


def spans_sql(blank: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    listed = lambda words: "(" + ", ".join(q(w) for w in sorted(words)) + ")"
    tries = []
    for rank, kind, first, left, pattern, sign in _patterns():
        pattern = pattern.replace("{blank}", blank).replace("{first}", first)
        boundary = f" AND NOT regexp_matches(p, '[{_W}]')" if left else ""
        held = f" AND contains(text, {q(sign)})" if sign else ""
        tries.append(f"SELECT doc_id, {rank} AS rank, {q(kind)} AS kind, i, regexp_extract(rest, {q(pattern)}, 1) AS span FROM cand WHERE regexp_matches(c, {q('[' + first + ']')}){boundary}{held}")
    union = "\n      UNION ALL ".join(tries)
    every = "".join(dict.fromkeys([f"[{p[2]}]" for p in _patterns()])).replace("][", "")
    chase = """{0}_next AS MATERIALIZED (SELECT a.*, b.i AS nxt FROM {0} a ASOF LEFT JOIN (SELECT {1}, i FROM {0}) b ON {2} AND b.i >= a.i + length(a.span)),
    {0}_taken AS (SELECT {1}, min(i) AS i FROM {0} GROUP BY {1} UNION ALL SELECT {3}, n.nxt FROM {0}_taken t JOIN {0}_next n ON {4} AND t.i = n.i WHERE n.nxt IS NOT NULL)"""
    base = "regexp_extract(span, '^[^''’]*')"
    return f"""WITH RECURSIVE lex0 AS (SELECT DISTINCT lower(regexp_replace(word, '^\\s+|\\s+$', '', 'g')) AS word FROM lexicon WHERE regexp_replace(word, '^\\s+|\\s+$', '', 'g') <> '' AND NOT starts_with(trim(word), '#')),
    lex AS (SELECT word FROM lex0 UNION SELECT left(word, length(word) - 3) FROM lex0 WHERE regexp_matches(word, 'm[ae]k$') AND length(word) > 4),
    chars AS (SELECT doc_id, nfc_normalize(text) AS text, regexp_extract_all(nfc_normalize(text), '(?s).') AS cs FROM documents WHERE text IS NOT NULL),
    places AS (SELECT doc_id, text, unnest(cs) AS c, unnest(list_prepend('', cs[1:len(cs) - 1])) AS p, unnest(range(1, len(cs) + 1)) AS i FROM chars),
    spots AS (SELECT *, regexp_matches(text, '@') AS mail, regexp_matches(text, '-') AS dash FROM places WHERE regexp_matches(c, {q(every)})),
    cand AS (SELECT doc_id, text, c, p, i, substr(text, i) AS rest FROM spots WHERE mail OR dash OR regexp_matches(c, '[^a-zçğıöşü]') OR regexp_matches(c, '[hwcfve]') OR contains(text, '\\')),
    m AS (SELECT doc_id, rank, kind, i, max_by(span, length(span)) AS span FROM (
      {union}) WHERE span <> '' GROUP BY ALL),
    {chase.format("m", "doc_id, rank", "a.doc_id = b.doc_id AND a.rank = b.rank", "t.doc_id, t.rank", "t.doc_id = n.doc_id AND t.rank = n.rank")},
    held AS (SELECT m.doc_id, m.rank, m.kind, m.i, CASE WHEN m.kind = 'URL' THEN regexp_replace(m.span, '[.,;:!?)]+$', '') ELSE m.span END AS span FROM m JOIN m_taken USING (doc_id, rank, i)),
    caps AS (SELECT DISTINCT {base} AS word, lower(translate({base}, 'İI', 'iı')) AS low FROM held WHERE kind IN ('ACRONYM', 'ACRONYM_APO')),
    stems AS (SELECT word, left(low, k) AS stem FROM (SELECT word, low, unnest(range(2, length(low) - 1)) AS k FROM caps) WHERE substr(low, k + 1) IN {listed(tables.SUFFIXES)}),
    turkish AS (SELECT word FROM (SELECT word FROM caps WHERE length(low) >= 3 AND (low IN (SELECT word FROM lex) OR low IN {listed(tables.PROPER_NOUNS)})
      UNION SELECT word FROM stems WHERE stem IN (SELECT word FROM lex) OR stem || 'mak' IN (SELECT word FROM lex) OR stem || 'mek' IN (SELECT word FROM lex)) WHERE word NOT IN {listed(tables.ACRONYMS)}),
    fine AS (SELECT * FROM held WHERE NOT (kind IN ('ACRONYM', 'ACRONYM_APO') AND {base} IN (SELECT word FROM turkish)) AND NOT (kind = 'HYPHENATED_APO' AND NOT regexp_matches({base}, '[\\p{{Lu}}\\p{{Nd}}]'))),
    s AS (SELECT doc_id, i, arg_max(kind, (length(span), -rank)) AS kind, arg_max(span, (length(span), -rank)) AS span FROM fine GROUP BY doc_id, i),
    {chase.format("s", "doc_id", "a.doc_id = b.doc_id", "t.doc_id", "t.doc_id = n.doc_id")}
    SELECT s.doc_id, CAST(s.i - 1 AS INT) AS start, CAST(s.i - 1 + length(s.span) AS INT) AS stop, s.kind, s.span FROM s JOIN s_taken USING (doc_id, i)"""
