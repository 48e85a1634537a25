"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from logsluice.llm import license_scan, quality_rules

ORACLES: dict[str, str] = {}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _licenses() -> str:
    known = ", ".join(f"({_quoted(s)}, {_quoted(i)})" for s, i in license_scan.KNOWN.items())
    rules = ", ".join(f"({k}, {_quoted(''.join(f'<{i}>' for i in ids.split()))}, {_quoted(name)})" for k, (ids, name) in enumerate(license_scan.RULES, 1))
    normal = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
    cut = license_scan.CUT.replace("\\t", "\t").replace("\\r", "\r").replace("\\n", "\n")
    return f"""
WITH RECURSIVE known(sentence, id) AS (VALUES {known}), rules(k, ids, name) AS (VALUES {rules}),
cut AS (SELECT doc_id, string_split_regex(coalesce(text, ''), {_quoted(cut)}) AS s FROM documents),
sentences AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM cut),
whole AS (SELECT c.*, k.id FROM sentences c LEFT JOIN known k ON k.sentence = {normal.format("c.s")}),
parts AS (SELECT doc_id, i, string_split(s, chr(10)) AS l FROM whole WHERE id IS NULL),
lines AS (SELECT doc_id, i, unnest(l) AS l, generate_subscripts(l, 1) AS j FROM parts),
hits AS (SELECT doc_id, i, 0 AS j, id FROM whole WHERE id IS NOT NULL UNION ALL
  SELECT l.doc_id, l.i, l.j, k.id FROM lines l JOIN known k ON k.sentence = {normal.format("l.l")}),
seqs AS (SELECT doc_id, string_agg('<' || id || '>', '' ORDER BY i, j) AS s, string_agg(id, ',' ORDER BY i, j) AS ids, count(*) AS n FROM hits GROUP BY doc_id),
folded(doc_id, k, s, found) AS (SELECT doc_id, 0, s, CAST([] AS VARCHAR[]) FROM seqs UNION ALL
  SELECT f.doc_id, r.k, replace(f.s, r.ids, '|'), CASE WHEN contains(f.s, r.ids) AND NOT list_contains(f.found, r.name) THEN list_append(f.found, r.name) ELSE f.found END
  FROM folded f JOIN rules r ON r.k = f.k + 1)
SELECT d.doc_id, coalesce(array_to_string(f.found, ','), '') AS licenses, coalesce(q.ids, '') AS sentence_ids, coalesce(q.n, 0)::BIGINT AS n_sentences,
  coalesce(length(f.s) - length(replace(f.s, '<', '')), 0)::BIGINT AS n_unmatched
FROM documents d LEFT JOIN seqs q USING (doc_id) LEFT JOIN folded f ON f.doc_id = d.doc_id AND f.k = {len(license_scan.RULES)}"""


ORACLES["op2_license_scan"] = _licenses()


def quality(documents: str = "documents") -> str:
    """One row per document of that table, with all that the adaptive verdict needs."""
    word = "[^\\x20\\x09-\\x0D]+"
    measures = quality_rules.MEASURES
    bins = "\nUNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM r WHERE n_words > 0" for m in measures)
    least = " ".join(f"WHEN '{m}' THEN {v[1]}" for m, v in measures.items())
    two = ", ".join(f"'{m}'" for m, v in measures.items() if v[2])
    unit, prior = quality_rules.UNIT, 100
    return f"""
words AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM {documents}),
wins AS (SELECT rid, unnest(range(1, len(w) - 3)) AS i, w FROM words WHERE len(w) >= 5),
keyed AS (SELECT rid, i, w[i:i + 4] AS k FROM wins),
repeated AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM keyed) WHERE c > 1),
covered AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n FROM repeated GROUP BY rid),
counted AS (SELECT x.rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(regexp_extract_all(text, '\\p{{Lu}}'))::BIGINT AS n_capitals,
  (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')))))::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM words x LEFT JOIN covered c ON c.rid = x.rid),
r AS (SELECT *, {", ".join(f"(({up}) // greatest(n_words, 1))::BIGINT AS {m}" for m, (up, _, _) in measures.items())} FROM counted),
sketch AS (SELECT lang, source, measure, CASE WHEN v < 64 THEN v ELSE v - v % (1::BIGINT << greatest(length(bin(v)) - 6, 0)::BIGINT) END AS bin, count(*) AS n FROM ({bins}) GROUP BY ALL),
every AS (SELECT measure, bin, (n * {unit} // sum(n) OVER (PARTITION BY measure))::BIGINT AS p FROM (SELECT measure, bin, sum(n)::BIGINT AS n FROM sketch GROUP BY measure, bin)),
by_lang AS (SELECT lang, measure, bin, sum(n)::BIGINT AS n FROM sketch GROUP BY lang, measure, bin),
lw AS (SELECT k.lang, e.measure, e.bin, coalesce(b.n, 0) * {unit} + {prior} * e.p AS w FROM (SELECT DISTINCT lang, measure FROM sketch) k JOIN every e USING (measure)
  LEFT JOIN by_lang b ON b.measure = e.measure AND b.bin = e.bin AND b.lang IS NOT DISTINCT FROM k.lang),
lp AS (SELECT lang, measure, bin, floor(w::DOUBLE / (sum(w) OVER (PARTITION BY lang, measure))::DOUBLE * {unit}.0::DOUBLE)::BIGINT AS p FROM lw),
fw AS (SELECT k.lang, k.source, l.measure, l.bin, coalesce(f.n, 0) * {unit} + {prior} * l.p AS w FROM (SELECT DISTINCT lang, source, measure FROM sketch) k
  JOIN lp l ON l.measure = k.measure AND l.lang IS NOT DISTINCT FROM k.lang
  LEFT JOIN sketch f ON f.measure = l.measure AND f.bin = l.bin AND f.lang IS NOT DISTINCT FROM k.lang AND f.source IS NOT DISTINCT FROM k.source),
run AS (SELECT lang, source, measure, bin, sum(w) OVER (PARTITION BY lang, source, measure ORDER BY bin)::BIGINT AS seen, sum(w) OVER (PARTITION BY lang, source, measure)::BIGINT AS total FROM fw),
chosen AS (SELECT lang, source, measure, min(bin) FILTER (seen >= (total * 100 + 999) // 1000) AS low, min(bin) FILTER (seen >= (total * 500 + 999) // 1000) AS middle, CASE measure {least} END AS least
  FROM run GROUP BY lang, source, measure),
failed AS (SELECT DISTINCT rid FROM (SELECT rid, lang, source, unnest([{", ".join(f"'{m}'" for m in measures)}]) AS measure, unnest([{", ".join(measures)}]) AS v FROM r) x
  JOIN chosen c ON x.measure = c.measure AND x.lang IS NOT DISTINCT FROM c.lang AND x.source IS NOT DISTINCT FROM c.source
  WHERE v > middle + 3 * greatest(middle - low, least) OR (c.measure IN ({two}) AND v < middle - 3 * greatest(middle - low, least))),
judged AS (SELECT r.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, f.rid IS NOT NULL AS adaptive_failed FROM r LEFT JOIN failed f ON f.rid = r.rid)"""


ORACLES["op5_quality_rules"] = f"""WITH {quality()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT adaptive_failed AS kept FROM judged"""

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def _reached(links: str) -> str:
    """reached (a, least): the least node that a node of links (a, b), both ways, leads to."""
    return f"walk(a, b) AS (SELECT a, b FROM {links} UNION SELECT w.a, l.b FROM walk w JOIN {links} l ON l.a = w.b), reached AS (SELECT a, least(a, min(b)) AS least FROM walk GROUP BY a)"


ORACLES["op6_substring_dedup"] = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM w WHERE len(w) >= 50),
keyed AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS k FROM starts),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM keyed) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
marked AS (SELECT s.doc_id, s.i, s.word, max(g.i) OVER (PARTITION BY s.doc_id ORDER BY s.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS cut FROM words s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.i = s.i),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (cut) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT cut), '') AS text FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM documents d LEFT JOIN kept k USING (doc_id)"""

ORACLES["op9_embedding_dedup"] = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.9),
{_reached("links")}, counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least, vec_id) AS component_id, coalesce(least, vec_id) = vec_id AS kept FROM v LEFT JOIN counted c ON c.a = vec_id LEFT JOIN reached r ON r.a = vec_id"""

ORACLES["op10_jaccard_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * common >= 75 * (s.n + t.n - common)),
{_reached("links")}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, d.doc_id) AS component_id FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN reached r ON r.a = d.doc_id"""
