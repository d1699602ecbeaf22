"""Segmentation of all words of the documents as one recursive SQL statement.

Suffixes are cut off from the right, all ways at once; every cut that leaves a root is then
scored suffix by suffix from the left. Written from the definition of the scores, without the
lattice of ``operators.segment``.
"""

from __future__ import annotations

from dokuma.functions import tables

_DOMAIN = sorted({*tables.MEDICAL, *tables.SPORTS, *tables.TOURISM})


def _list(words) -> str:
    return "(" + ", ".join("'" + w + "'" for w in words) + ")"


def segment_sql(blank: str) -> str:
    suffixes = ", ".join(f"('{s}', '{label}')" for s, label in tables.SUFFIXES.items())
    aspect = "regexp_matches({0}, '^-(PROG|PST|EVID|FUT|NEG|ABIL)')"
    hard = "translate(right({0}, 1), 'bcdgğ', 'pçtkk')"
    soft = "right({0}, 1) IN ('b', 'c', 'd', 'g', 'ğ')"
    drop = "(left({0}, length({0}) - 1) || translate(regexp_extract({0}, '([aeıioöuü])[^aeıioöuü]*$', 1), 'aeıioöuü', 'ıiıiuüuü') || right({0}, 1))"
    dropped = "length({0}) >= 2 AND regexp_matches({0}, '[aeıioöuü][^aeıioöuü]{{2,}}$') AND " + drop + " IN (SELECT word FROM lex)"
    hardened = f"(left(s, length(s) - 1) || {hard.format('s')})"
    verbal = "label IN ('-PST', '-PROG', '-EVID', '-FUT', '-NEG', '-AOR', '-PASS.AOR')"
    letters = r"regexp_replace(word, '[^\p{L}]', '', 'g')"
    return f"""WITH RECURSIVE lex0 AS (SELECT DISTINCT lower(regexp_replace(word, '^\\s+|\\s+$', '', 'g')) AS word FROM lexicon WHERE regexp_replace(word, '^\\s+|\\s+$', '', 'g') <> '' AND NOT starts_with(trim(word), '#')),
    lex AS (SELECT word FROM lex0 UNION SELECT left(word, length(word) - 3) FROM lex0 WHERE regexp_matches(word, 'm[ae]k$') AND length(word) > 4),
    w AS (SELECT word, lower(translate(word, 'İI', 'iı')) AS low, length({letters}) >= 2 AND NOT regexp_matches({letters}, '[^\\p{{Lu}}]') AS caps FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[^{blank}]+')) AS word FROM documents)),
    t AS (SELECT DISTINCT low FROM w WHERE low NOT IN {_list(tables.INTACT)}),
    suf AS (SELECT * FROM (VALUES {suffixes}) AS v(s, label)),
    down AS (
      SELECT low, low AS rest, []::VARCHAR[] AS labels, []::VARCHAR[] AS cuts FROM t
      UNION ALL
      SELECT d.low, left(d.rest, length(d.rest) - d.k), [suf.label] || d.labels, [suf.s] || d.cuts
      FROM (SELECT *, unnest(range(1, 7)) AS k FROM down WHERE len(labels) < 10) d JOIN suf ON length(d.rest) > d.k AND suf.s = right(d.rest, d.k)
      WHERE (d.labels = [] OR NOT (regexp_matches(suf.label, '(SG|PL)$') AND {aspect.format('d.labels[1]')}) AND NOT (d.labels[1] = '-PROG' AND suf.label IN ('-AOR', '-PASS.AOR', '-ACC')))
        AND (length(d.rest) - d.k >= 2 OR left(d.rest, 1) IN ('y', 'd') AND regexp_matches(suf.label, '^-(PROG|PST|EVID|FUT|NEG)'))
    ),
    s0 AS (SELECT DISTINCT rest AS s FROM down),
    near AS (SELECT s, l.word, list_filter(range(1, length(s) + 1), lambda i: s[i] <> l.word[i]) AS changed, list_filter(range(1, length(s) + 1), lambda i: s[i] IN ('c', 'g', 'i', 'o', 's', 'u'))[1:8] AS free
      FROM s0 JOIN lex l ON translate(l.word, 'çğıöşü', 'cgiosu') = s AND l.word <> s WHERE s NOT IN (SELECT word FROM lex) AND NOT regexp_matches(s, '[^\\x00-\\x7F]')),
    accents AS (SELECT s, min((list_sum(list_transform(changed, lambda i: CASE WHEN s[i] IN ('c', 'g', 's') THEN 1 ELSE 2 END)), word))[2] AS word FROM near WHERE list_has_all(free, changed) GROUP BY s),
    s1 AS (SELECT s0.s, s0.s IN (SELECT word FROM lex) AS known, CASE WHEN s0.s IN (SELECT word FROM lex) THEN s0.s ELSE a.word END AS form FROM s0 LEFT JOIN accents a USING (s)),
    s2 AS (SELECT *,
      CASE WHEN {soft.format('s')} AND NOT known AND {hardened} IN (SELECT word FROM lex) THEN {hardened}
           WHEN {dropped.format('s')} THEN {drop.format('s')}
           WHEN {soft.format('s')} AND {dropped.format(hardened)} THEN {drop.format(hardened)} END AS noun,
      CASE WHEN s IN ('y', 'yi', 'yu', 'yü') THEN 'ye' WHEN s IN ('d', 'di', 'du', 'dü') THEN 'de' END AS narrow,
      CASE WHEN right(s, 1) IN ('ı', 'u', 'a') THEN left(s, length(s) - 1) || 'a' WHEN right(s, 1) IN ('i', 'ü', 'e') THEN left(s, length(s) - 1) || 'e' END AS wide,
      CASE WHEN NOT known AND {soft.format('s')} AND (right(s, 1) <> 'd' OR {hardened} IN ('git', 'et', 'tat', 'güt', 'dit')) THEN {hardened} END AS firm FROM s1),
    s3 AS (SELECT *, coalesce(narrow, CASE WHEN wide IN (SELECT word FROM lex) OR wide || 'mak' IN (SELECT word FROM lex) OR wide || 'mek' IN (SELECT word FROM lex) THEN wide END,
      CASE WHEN firm IN (SELECT word FROM lex) OR firm || 'mak' IN (SELECT word FROM lex) OR firm || 'mek' IN (SELECT word FROM lex) THEN firm END) AS verb FROM s2),
    s4 AS (SELECT s, form, noun, verb, s IN {_list(_DOMAIN)} AS domain, CASE WHEN form IS NOT NULL THEN form WHEN s IN {_list(_DOMAIN)} THEN s ELSE coalesce(noun, verb) END AS lemma FROM s3),
    s5 AS (SELECT *, form IS NULL AND NOT domain AS restored, form IS NULL AND NOT domain AND noun IS NOT NULL AS as_noun,
      lemma IN ('ye', 'de', 'et', 'git', 'tat') OR lemma || 'mak' IN (SELECT word FROM lex) OR lemma || 'mek' IN (SELECT word FROM lex) AS v FROM s4 WHERE lemma IS NOT NULL),
    root AS (SELECT *, 10 * length(s) + CASE WHEN form IS NOT NULL THEN 80 + CASE WHEN form <> s THEN 25 ELSE 0 END WHEN domain THEN 50 ELSE 80 END - CASE WHEN length(s) <= 2 AND NOT v THEN 20 ELSE 0 END AS base FROM s5),
    chain AS (SELECT row_number() OVER () AS id, d.*, r.lemma, r.v, r.restored, r.as_noun, r.base FROM down d JOIN root r ON r.s = d.rest WHERE d.labels <> []),
    edge0 AS (SELECT id, k, v, base, lemma, rest, as_noun, labels[k] AS label, cuts[k] AS cut, left(low, length(rest) + length(array_to_string(cuts[1:k - 1], ''))) AS head, k > 1 AND list_contains(labels[1:k - 1], '-NEG') AS negated FROM (SELECT *, unnest(range(1, len(labels) + 1)) AS k FROM chain)),
    edge AS (SELECT id, k, base, 4 * length(cut) - 8 + CASE WHEN v AND label = '-PROG' THEN 60 ELSE 0 END + CASE WHEN v AND {verbal} THEN 40 ELSE 0 END
      - CASE WHEN NOT v AND ({verbal} OR label = '-COND') THEN 120 ELSE 0 END - CASE WHEN NOT v AND cut IN ('m', 'n', 'k') AND length(head) <= 2 THEN 90 ELSE 0 END
      - CASE WHEN left(cut, 1) IN ('t', 'ç') AND right(head, 1) NOT IN ('p', 'ç', 't', 'k', 'f', 'ş', 's', 'h') THEN 150 ELSE 0 END + CASE WHEN negated AND label = '-PROG' THEN 100 ELSE 0 END
      + CASE WHEN k > 1 OR NOT v THEN 0 WHEN lemma IN ('de', 'ye', 'et', 'git') THEN 60 WHEN lemma IN ('ol', 'yap', 'bul', 'gel', 'bak', 'gör', 'al', 'ver') OR regexp_matches(lemma, 'm[ae]k$') THEN 30 ELSE 0 END
      + CASE WHEN k = 1 AND as_noun AND rest = 'kanad' AND label = '-ACC' THEN 45 ELSE 0 END AS pts FROM edge0),
    sums AS (SELECT id, k, base + sum(pts) OVER (PARTITION BY id ORDER BY k) AS score, max(k) OVER (PARTITION BY id) AS n FROM edge),
    scored AS (SELECT id, max(score) FILTER (k = n) AS score FROM sums GROUP BY id HAVING coalesce(min(score) FILTER (k < n), 0) > -200),
    own AS (SELECT w.word, w.low, w.caps, r.form, coalesce(r.noun, r.verb) AS stem FROM w LEFT JOIN s3 r ON r.s = w.low WHERE w.low NOT IN {_list(tables.INTACT)}),
    found AS (
      SELECT o.word, CAST(x.score AS BIGINT) + CASE WHEN o.caps AND list_contains(c.labels, '-PST') THEN 45 ELSE 0 END AS score, 0 AS grp, list_reverse(list_transform(c.cuts, lambda z: -length(z))) AS place, 'chain' AS source,
        [c.rest] || c.cuts AS parts, c.labels, c.lemma, c.restored, CASE WHEN c.restored THEN length(c.lemma) ELSE length(c.rest) END AS size
      FROM own o JOIN chain c USING (low) JOIN scored x USING (id)
      UNION ALL
      SELECT word, 10 * length(low) + 80 + CASE WHEN length(low) <= 5 THEN 50 ELSE 0 END + CASE WHEN form <> low THEN 25 ELSE 0 END, 1, [], 'word', [low], [], coalesce(form, low), false, length(low) FROM own WHERE form IS NOT NULL OR low IN {_list(tables.PROPER_NOUNS)}
      UNION ALL
      SELECT word, 10 * length(low) + 150, 1, [], 'restored', [low], [], stem, true, length(stem) FROM own WHERE form IS NULL AND low NOT IN {_list(tables.PROPER_NOUNS)} AND stem IS NOT NULL
      UNION ALL
      SELECT word, 1 - 5 * greatest(0, length(low) - 2), 2, [], 'unknown', [low], [], NULL, false, length(low) FROM own WHERE form IS NULL AND low NOT IN {_list(tables.PROPER_NOUNS)}
    ),
    first AS (SELECT word, (min((grp, place, score)))[3] AS score FROM found GROUP BY word),
    every AS (SELECT * FROM found UNION ALL
      SELECT o.word, CASE WHEN (NOT regexp_full_match(o.low, '\\p{{L}}+') OR regexp_matches(o.low, '[qwx]')) AND f.score < 20 THEN 5 + length(o.low) ELSE -200 END, 3, [], 'foreign', [o.low], [], NULL, false, 0
      FROM own o JOIN first f USING (word) WHERE o.form IS NULL AND length(o.low) >= 3 AND NOT regexp_matches(o.low, '[çğışöü]')),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, len(parts), size DESC, len(list_intersect(labels, ['-PROG', '-PST', '-NEG', '-FUT'])) = 0, NOT restored, grp, place) AS rn FROM every)
    SELECT word, CAST(score AS INT) AS score, source, parts, labels, lemma FROM ranked WHERE rn = 1
    UNION ALL SELECT word, 5000, 'intact', [low], [], NULL FROM w WHERE low IN {_list(tables.INTACT)}"""
